import random
import re

from pyspark.sql import functions as F

from lexloom.llm.splitting import Measured, split_oversized, split_points

CJK = re.compile("[一-鿿㐀-䶿]")
PIECES = ["甲方应当付款。", "word ", "a longer clause of words; ", "\n", "No stop here ", "x.y ", "End. ", "中文没有标点", "!", "　", "é́ ", "𠮷", "？"]


def size(text):
    return int(0.6 * len(CJK.findall(text)) + len(CJK.sub(" ", text).split()))


def forced(text, limit):
    return any(size(p) > limit for p in re.split(r"(?<=[。！？!?；;\n\r])|(?<=\.)(?=\s)", text))


def check(text, limit, overlap):
    starts, ends, hard = split_points(text, limit, overlap)
    if size(text) <= limit:
        assert (starts, ends) == ([0], [len(text)])
        return
    assert hard == forced(text, limit)
    assert starts[0] == 0 and ends[-1] == len(text)
    assert all(size(text[a:b]) <= limit for a, b in zip(starts, ends))
    assert all(a < b and s <= a for s, a, b in zip(starts[1:], ends, ends[1:]))
    if not hard:
        natural = {m.end() for m in re.finditer(r"[。！？!?；;\n\r]|\.(?=\s)", text)}
        assert set(ends[:-1]) <= natural
    for s, e in zip(starts[1:], ends):
        assert size(text[s:e]) <= overlap


def test_pieces_keep_every_promise():
    rng = random.Random(9)
    for n in range(300):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 160)))
        check(text, rng.choice([8, 20, 60]), rng.choice([0, 3, 6]))
    for text in ["", " " * 500, "x" * 5000, "中" * 5000, "x " * 3000, "\n" * 100, "中.x" * 900]:
        check(text, 100, 10)


def test_overlap_is_as_asked_where_there_is_room():
    text = "。".join("甲乙丙丁戊己庚辛" for _ in range(400))
    starts, ends, _ = split_points(text, 100, 20)
    overlaps = [size(text[s:e]) for s, e in zip(starts[1:], ends)]
    assert min(overlaps) >= 10 and max(overlaps) <= 20


def test_sizes_agree_with_the_definition():
    rng = random.Random(2)
    text = "".join(rng.choice(PIECES) for _ in range(80))
    m = Measured(text)
    for _ in range(300):
        lo, hi = sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)))
        assert int(m.size(lo, hi)) == size(text[lo:hi])


def test_operator(spark):
    schema = "kind string, id string, text string, offset int, piece int, cut string, size string"
    long = "A clause of six words here. " * 60
    rows = [("chunk", "a", long, 100, 1, "", ""), ("chunk", "a", long, 100, 1, "", ""), ("chunk", "b", "short", 0, 1, "", ""), ("document", "a", long, None, 1, "", ""), (None, "a", long, 0, 1, "", ""), ("chunk", None, long, 0, 1, "", ""), ("chunk", "n", None, 0, 1, "", ""), ("chunk", "e", "", 0, 1, "", "")]
    df = spark.createDataFrame(rows, schema)
    got = split_oversized(df, "kind", "id", "text", F.col("offset"), limit=100, overlap=12).collect()
    assert {(r["kind"], r["id"], r["cut"]) for r in got} == {("chunk", "a", "natural"), ("document", "a", "natural")}
    for r in got:
        assert r["text"] == long[r["start"] : r["end"]] and size(r["text"]) == r["size"] <= 100
        assert (r["span_start"], r["span_end"]) == ((r["start"] + 100, r["end"] + 100) if r["kind"] == "chunk" else (None, None))
    assert len(got) == len({(r["kind"], r["piece"]) for r in got})
    assert split_oversized(df.limit(0), "kind", "id", "text").count() == 0


def cost_of(text, at):
    """Cost of a cut: after a blank line, at a line break, at a sentence end, elsewhere."""
    head = text[:at].replace("\r\n", "\n")
    if head.endswith(("\n", "\r")):
        return 0.0 if head[:-1].endswith(("\n", "\r")) else 0.02
    return 0.05 if head[-1] in "。！？!?；;" or (head[-1] == "." and text[at].isspace()) else 1.0


def cheapest(text, limit):
    """Least cost of cutting ``text`` at any place that is no inside of a word, or at natural boundaries only where these suffice."""
    aim = size(text) / -(-size(text) // limit)
    natural = {m.end() for m in re.finditer(r"[。！？!?；;\n\r]|\.(?=\s)", text)} - {len(text)}
    bounds = sorted({0, len(text)} | natural)
    places = set(bounds)
    for a, b in zip(bounds, bounds[1:]):
        if size(text[a:b]) > limit:
            plain = lambda c: not c.isspace() and not CJK.match(c)
            places |= {i for i in range(a + 1, b) if not (plain(text[i - 1]) and plain(text[i]))}
    best = {0: 0.0}
    for j in sorted(places)[1:]:
        prices = [best[i] + ((size(text[i:j]) - aim) / limit) ** 2 for i in best if size(text[i:j]) <= limit]
        best[j] = min(prices) + (cost_of(text, j) if j < len(text) else 0.0)
    return best[len(text)]


def test_cost_against_brute_force():
    rng = random.Random(31)
    pieces = [*PIECES, "\n\n", "\r\n", "\r\n\r\n"]
    for _ in range(60):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(20, 90)))
        limit = rng.choice([8, 15, 30])
        if size(text) <= limit:
            continue
        starts, ends, _ = split_points(text, limit, 0)
        aim = size(text) / -(-size(text) // limit)
        got = sum(((size(text[s:e]) - aim) / limit) ** 2 for s, e in zip(starts, ends)) + sum(cost_of(text, e) for e in ends[:-1])
        assert abs(got - cheapest(text, limit)) < 1e-9
