import pytest

from lexloom.operators import evidence as ev
from lexloom.operators.slices import slices

CHUNKS = "id string, doc_id string, chunk_index int, text string, section_path array<string>, page_no int, charspan array<int>"
FULL = "alpha beta gamma delta " * 2000


def chunk(name, lo, hi, path, doc="doc1", n=0):
    return (name, doc, n, FULL[lo:hi], path, lo // 500 + 1, [lo, hi])


@pytest.fixture(scope="module")
def tables(spark):
    rows = [chunk(f"c{i}", 500 * i, 500 * i + 500, ["Art 1"], n=i) for i in range(4)]
    rows += [chunk("c4", 2000, 3000, ["Art 2"], n=4), chunk("c5", 3000, 4000, ["Art 2"], n=5), chunk("c6", 4000, 5000, ["Art 2"], n=6), chunk("c7", 5000, len(FULL), ["Art 2"], n=7)]
    rows += [chunk("cX", 0, 500, ["Art 1"], doc="doc2"), ("bad", "doc1", 9, "x", ["Art 1"], 1, [10, 5]), ("lost", "doc3", 0, "x", [], 1, [0, 1])]
    documents = spark.createDataFrame([("doc1", FULL, "Doc"), ("doc2", FULL, "Doc 2")], "doc_id string, full_text string, title string")
    return spark.createDataFrame(rows, CHUNKS), documents


def test_materialize(spark, tables):
    cases = {
        "null": (None, None), "none": ([], None), "blank": (["  "], None), "absent": (["c0", "nope"], None), "docs": (["c0", "cX"], None), "sections": (["c0", "c4"], None), "small": ([" c1", "c0", "c0"], "n" * 600),
        "large": (["c4", "c5"], "x"), "hole": (["c4", "c6"], None), "bad": (["bad"], None), "lost": (["lost"], None),
    }
    rows = spark.createDataFrame([(k, *v) for k, v in cases.items()], "key string, source_chunk_ids array<string>, relevance_note string")
    got = {r["key"]: r for r in ev.materialize(rows, *tables).collect()}
    reasons = {k: r["reason"] for k, r in got.items()}
    # "bad" lies in the small section: its span is checked before the section is taken
    assert reasons == {"null": "no-chunks", "none": "no-chunks", "blank": "no-chunks", "absent": "missing-chunk", "docs": "cross-document", "sections": "cross-section", "small": None, "large": None, "hole": "hole", "bad": "invalid-span", "lost": "no-full-text"}
    small, large = got["small"], got["large"]
    assert (small["start_offset"], small["end_offset"], small["page_no"], len(small["note"])) == (0, 2000, 1, 500)
    assert set(small["chunk_ids"]) >= {"c0", "c1", "c2", "c3"}
    assert (large["start_offset"], large["end_offset"], large["chunk_ids"]) == (2000, 4000, ["c4", "c5"])


def test_verify(spark):
    full = "alpha beta gamma"
    documents = spark.createDataFrame([("d", full), ("e", "")], "doc_id string, full_text string")
    chunks = spark.createDataFrame(
        [("a", "d", 0, "alpha", ["S"], 1, [0, 5]), ("b", "d", 1, " beta", ["S"], 1, [5, 10]), ("w", "d", 2, "wrong", ["S"], 1, [0, 5]), ("o", "d", 3, "alpha", ["Other"], 1, [0, 5]), ("x", "z", 0, "alpha", ["S"], 1, [0, 5]), ("g", "d", 4, "gamma", ["S"], 1, [11, 16]), ("i", "d", 5, "t", ["S"], 1, [9, 99])], CHUNKS,
    )
    cases = {
        "ok": ("d", 0, 10, "alpha beta", ["a", "b"], ""), "text": ("d", 0, 5, "alpha", ["w"], "chunk-text-mismatch"), "section": ("d", 0, 5, "alpha", ["o"], "off-section-chunk"), "doc": ("d", 0, 5, "alpha", ["x"], "off-doc-chunk"),
        "missing": ("d", 0, 5, "alpha", ["a", "no", "w"], "missing-chunk"), "quote": ("d", 0, 5, "alphx", ["a"], "quote-mismatch"), "range": ("d", 0, 99, "alpha", ["a"], "offsets-out-of-range"), "swap": ("d", 5, 0, "", ["a"], "offsets-out-of-range"),
        "null": ("d", None, 5, "alpha", ["a"], "offsets-not-int"), "empty": ("e", 0, 1, "a", ["a"], "no-full-text"), "none": (None, 0, 1, "a", ["a"], "no-full-text"), "low": ("d", 0, 10, "alpha beta", ["a"], "low-coverage"),
        "apart": ("d", 0, 5, "alpha", ["g"], "chunks-no-overlap"), "span": ("d", 0, 5, "alpha", ["i"], "invalid-chunk-span"), "nochunk": ("d", 0, 5, "alpha", [], "chunks-no-overlap"),
    }
    rows = spark.createDataFrame([(k, d, s, e, q, ["S"], ids) for k, (d, s, e, q, ids, _) in cases.items()], "evidence_id string, document_id string, start_offset int, end_offset int, quote string, section_path array<string>, source_chunk_ids array<string>")
    got = {r["evidence_id"]: (r["verified"], r["reason"]) for r in ev.verify(rows, chunks, documents).collect()}
    assert got == {k: (v[-1] == "", v[-1]) for k, v in cases.items()}


def test_register_and_audit(spark):
    rows = spark.createDataFrame([("q", "d", 0, 5, 1), ("q", "d", 0, 5, 2), ("q", "d", 5, 9, 3), ("r", "d", 0, 5, 4), ("q", None, 0, 5, 5)], "question_id string, document_id string, start_offset int, end_offset int, at int")
    got = sorted((r["at"], r["number"], r["first"]) for r in ev.register(rows, "question_id", ["at"]).collect())
    assert got == [(1, "E001", True), (2, "E001", False), (3, "E002", True), (4, "E001", True)]
    cited = spark.createDataFrame([("r", "E001"), ("r", "E001"), ("r", "E999"), ("s", "E002")], "report string, evidence_id string")
    store = spark.createDataFrame([("E001", True), ("E002", None)], "evidence_id string, verified boolean")
    assert sorted(map(tuple, ev.audit_citations(cited, store).collect())) == [("r", 2, 1, 1, 1, 0.5), ("s", 1, 1, 0, 0, 0.0)]


def test_slices_of_crowded_and_long_spans(spark, monkeypatch):
    from lexloom.operators import slices as module

    text = "".join(chr(0x4E00 + i % 997) for i in range(30_000))
    spans = [("k", str(i), "d", 37 * i % 29_000, 37 * i % 29_000 + 10 + i % 40, "t") for i in range(400)] + [("k", "long", "d", 100, 29_999, "t"), ("k", "over", "d", 29_990, 99_999, "t"), ("k", "out", "d", 30_000, 30_001, "t"), ("k", "neg", "d", -1, 5, "t"), ("k", "nodoc", "z", 0, 5, "t"), ("k", "nulls", "d", None, 5, "t")]
    rows = spark.createDataFrame(spans, "kind string, id string, doc string, lo int, hi int, text string")
    documents = spark.createDataFrame([("d", text), ("d", text), ("n", None)], "doc string, text string")
    want = {i: text[lo:hi] for _, i, d, lo, hi, _ in spans if d == "d" and lo is not None and 0 <= lo < len(text)}
    for crowd in (100_000, 20):
        monkeypatch.setattr(module, "CROWD", crowd)
        got = slices(rows, documents).collect()
        assert {r["id"]: r["slice"] for r in got} == want and len(got) == len(want)


def test_conflicting_pairs_are_whole(spark):
    spans = [("q", "d", 0, 20_000, True), ("q", "d", 10, 20, True), ("q", "d", 9000, 9500, False), ("q", "d", 9000, 9500, None), ("q", "d", 4095, 4097, False), ("q", "d", 20_000, 20_001, False), ("q", "e", 0, 9, False), ("r", "d", 0, 9, False), ("q", "d", 7, 7, False), (None, "d", 0, 9, False)]
    spans += [("q", "f", 5, 6, i % 2 == 0) for i in range(5)]
    spans = [(f"x{i:02d}", *x) for i, x in enumerate(spans)]
    want = {(q, i, j) for i, q, d, s, e, v in spans for j, q2, d2, s2, e2, v2 in spans if q and i < j and (q, d) == (q2, d2) and s < e and s2 < e2 and s < e2 and s2 < e and v is not v2}
    rows = spark.createDataFrame(spans, "evidence_id string, question_id string, document_id string, start_offset int, end_offset int, verified boolean")
    for width in (4096, 100):
        got = [tuple(r) for r in ev.conflicting_pairs(rows, width).collect()]
        assert set(got) == want and len(got) == len(want)
    assert {("q", "x00", "x02"), ("q", "x00", "x03"), ("q", "x00", "x04")} < want and len(want) == 10
