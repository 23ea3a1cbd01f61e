import random
import re

import numpy as np

from lexloom.llm import leakage
from lexloom.llm.leakage import FMIndex, leaked_spans, removal_spans, suffix_array

TOKEN = re.compile(r"[一-鿿㐀-䶿]|[^\W_一-鿿㐀-䶿]+")


def test_suffix_array_and_search_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(40):
        s = rng.integers(0, 4, rng.integers(1, 150)).astype(np.int32)
        s[-1] = 0
        place = np.cumsum(s == 0)
        keys = [(0, int(place[i])) if s[i] == 0 else (1, int(s[i])) for i in range(len(s))]
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: keys[i:])
        phrases = rng.integers(1, 4, (15, 3)).astype(np.int32)
        found = sorted(zip(*(x.tolist() for x in FMIndex(s, 4).find(phrases))))
        assert found == sorted((p, i) for p in range(15) for i in range(len(s) - 2) if (s[i : i + 3] == phrases[p]).all())


def brute(corpus, items, length):
    out = set()
    for item, passage in items:
        words = TOKEN.findall((passage or "").lower())
        grams = {tuple(words[i : i + length]) for i in range(len(words) - length + 1)}
        for key, text in corpus:
            own = TOKEN.findall((text or "").lower())
            if key is not None and item is not None and any(tuple(own[i : i + length]) in grams for i in range(len(own) - length + 1)):
                out.add((str(key), str(item)))
    return out


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    words = ["alpha", "Beta", "甲方", "支付", "x1", "of", "the"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(3, 40))) for i in range(12)] + [(90, None), (None, text(20)), (91, ""), (92, "short")]
    items.append((99, items[0][1]))
    corpus = []
    for i in range(80):
        body = text(rng.randrange(0, 60))
        if i % 3 == 0:
            passage = (items[i % 12][1]).split()
            cut = rng.randrange(len(passage))
            body += ";\n" + ", ".join(passage[cut : cut + 14]).upper() + " … " + text(5)
        corpus.append((i, body))
    corpus += [(200, None), (None, items[3][1]), (201, ""), (202, items[5][1] * 30), (203, corpus[0][1]), (0, corpus[0][1])]
    docs = spark.createDataFrame([(*r, "a", 1) for r in corpus], "doc_id long, text string, item string, start int")
    held = spark.createDataFrame([(*r, "b") for r in items], "item_id long, text string, id string")
    want = brute([c for c in corpus if c[1]], items, 8)
    for shard, block in ((1_000_000, 20_000), (60, 5)):
        monkeypatch.setattr(leakage, "SHARD_TOKENS", shard)
        monkeypatch.setattr(leakage, "ITEM_BLOCK", block)
        rows = leaked_spans(docs, "doc_id", "text", held, "item_id", "text", length=8).collect()
        assert {(r["id"], r["item"]) for r in rows} == want and want
        bodies = {str(k): t.lower() for k, t in corpus if k is not None and t}
        assert all(len(TOKEN.findall(bodies[r["id"]][r["start"] : r["end"]])) == r["tokens"] >= 8 for r in rows)
    assert leaked_spans(docs.limit(0), "doc_id", "text", held, "item_id", "text").count() == 0
    assert leaked_spans(docs, "doc_id", "text", held.limit(0), "item_id", "text").count() == 0


def test_removal_spans_merge(spark):
    rows = spark.createDataFrame([("d", "1", 0, 10), ("d", "2", 5, 20), ("d", "2", 20, 25), ("d", "3", 30, 40), ("e", "1", 0, 5)], "id string, item string, start long, end long")
    assert sorted(map(tuple, removal_spans(rows).collect())) == [("d", 0, 25, 2), ("d", 30, 40, 1), ("e", 0, 5, 1)]


def test_offsets_are_of_the_text_itself(spark):
    passage = "the İstanbul Supplier delivers İ goods to the buyer"
    texts = [("a", f"İİ. İ {passage.upper()}! İ"), ("b", f"x {passage}"), ("c", "İ ß ﬀ " + passage.replace(" ", " … "))]
    rows = leaked_spans(spark.createDataFrame(texts, "id string, text string"), "id", "text", spark.createDataFrame([("p", passage)], "item string, text string"), "item", "text", length=4).collect()
    cut = {r["id"]: dict(texts)[r["id"]][r["start"] : r["end"]] for r in rows}
    assert cut == {"a": passage.upper(), "b": passage, "c": passage.replace(" ", " … ")}


def test_short_passages_as_a_whole(spark):
    docs = spark.createDataFrame([("a", "we pay the fee today and the rest later"), ("b", "the fee"), ("c", "")], "id string, text string")
    items = spark.createDataFrame([("one", "The fee, today"), ("two", "the fee"), ("three", "later"), ("four", ""), ("five", "we pay the fee today and")], "item string, text string")
    found = lambda **o: sorted((r["id"], r["item"], r["tokens"]) for r in leaked_spans(docs, "id", "text", items, "item", "text", length=5, **o).collect())
    assert found() == [("a", "five", 6)]
    assert found(short=True) == [("a", "five", 6), ("a", "one", 3), ("a", "three", 1), ("a", "two", 2), ("b", "two", 2)] == found(short=True, item_block=1)
