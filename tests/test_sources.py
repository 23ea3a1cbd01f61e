import json

import pytest
from pyspark.sql import functions as F

from lexloom.functions import json as js
from lexloom.functions import text as tx
from lexloom.operators import chunking, lookup, retrieval, sessions, summaries
from lexloom.sources import benchmarks, corpus


def one(spark, column, **values):
    """A column's value on one row of strings."""
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in values))
    return rows.select(column).first()[0]


@pytest.mark.parametrize(
    "answer,label",
    [
        ("Entailment", "entailment"), ("it is NOT neutral but contradiction", "contradiction"), ("neutral; entailing", "neutral"), ("The text entails it.", "entailment"), ("contradicting", "contradiction"),
        ("neutrally", None), ("entailment2", "entailment"), ("not supported", None), ("unknown", None), ("", None), (None, None), ("标签：neutral。", "neutral"), ("x_neutral", "neutral"),
    ],
)
def test_labels(spark, answer, label):
    # Joined to a digit or an underscore the word is no word, but its letters still are one.
    assert one(spark, tx.normal_label(F.col("t")), t=answer) == label


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"a": 1}', {"a": 1}), ('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}), ('Sure: {"a": {"b": 2}} done', {"a": {"b": 2}}), ("[1]", None), ("no json", None), ("{broken", None), ("", None), (None, None), ('{"a": 1} and {"b": 2}', None), ('{"a": "} {"}', {"a": "} {"}), ('{"a": "x\\"}"}', {"a": 'x"}'}),
    ],
)
def test_json_object(spark, text, want):
    got = one(spark, js.json_object(F.col("t")), t=text)
    assert (json.loads(got) if got else None) == want


def test_json_array_and_calls(spark):
    assert [one(spark, js.json_array(F.col("t")), t=t) for t in ("```\n[1, 2]\n```", 'x [{"a": 1}] y', '{"a": [1]}', "none", "[1, 2", None)] == ["[1, 2]", '[{"a": 1}]', None, None, None, None]
    text = '<tool_call>\n{"name": "grep", "arguments": {"k": 1}}</tool_call><tool_call>bad</tool_call><tool_call>{"name": "list"}</tool_call>'
    assert [tuple(c) for c in one(spark, js.tool_calls(F.col("t")), t=text)] == [("manual_0", "grep", '{"k":1}'), ("manual_2", "list", "{}")]
    assert one(spark, js.tool_calls(F.col("t")), t="nothing") == [] and one(spark, js.tool_calls(F.col("t")), t=None) is None


def test_search_tokens_fold_compatibility_forms(spark):
    assert one(spark, tx.search_tokens(F.col("t")), t="Ⅻ ﬁnal ＡＢ１２ № ７％ ⑦ ﾃ") == ["xii", "final", "ab12", "no", "7%", "7", "テ"]


def test_nli_lines(spark, tmp_path):
    lines = [{"premise": "P one", "subset": "a", "hypothesises/labels": [{"hypothesis": "h1", "label": "neutral"}, {"hypothesis": "h2"}]}, {"premise": "", "subset": "a", "hypothesises/labels": [{"hypothesis": "h3", "label": "x"}]}, {"premise": "P two", "subset": "b"}]
    (tmp_path / "nli.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    rows = benchmarks.nli_instances(spark, str(tmp_path / "nli.jsonl")).collect()
    assert sorted((r["subset"], r["premise"], r["n"], r["hypothesis"], r["label"]) for r in rows) == [("a", "", 0, "h3", "x"), ("a", "P one", 0, "h1", "neutral"), ("a", "P one", 1, "h2", "")]
    assert len({r["instance_id"] for r in rows}) == 3
    premises = benchmarks.nli_premises(spark, str(tmp_path / "nli.jsonl")).collect()
    assert sorted((r["premise"], r["premise_len"], r["n_hypotheses"]) for r in premises) == [("P one", 5, 2), ("P two", 5, 0)]
    assert benchmarks.nli_instances(spark, str(tmp_path / "nli.jsonl"), ["b"]).count() == 0


def test_span_benchmark_and_alignment(spark, tmp_path):
    body = {"tests": [{"query": "q", "snippets": [{"file_path": "a.txt", "span": [0, 3], "answer": "abc"}, {"file_path": "", "span": [0, 1]}, {"file_path": "a.txt", "span": [1]}]}, {"snippets": [{"file_path": "b.txt", "span": [2, 9]}]}, {"query": "none", "snippets": []}]}
    (tmp_path / "cuts.json").write_text(json.dumps(body, indent=1))
    rows = benchmarks.span_queries(spark, str(tmp_path / "cuts.json"))
    assert sorted((r["benchmark"], r["instance_id"], r["query"], r["file_path"], r["start"], r["end"], r["answer"]) for r in rows.collect()) == [("cuts", "cuts-0", "q", "a.txt", 0, 3, "abc"), ("cuts", "cuts-1", "", "b.txt", 2, 9, None)]
    gold = [("same", "d", 0, 5, "one\nt"), ("blank", "d", 0, 5, "one t"), ("holds", "d", 0, 3, "say one"), ("other", "d", 0, 3, "two"), ("none", "d", 0, 3, None), ("lost", "z", 0, 3, "one"), ("beyond", "d", 4, 99, "two")]
    texts = spark.createDataFrame([("d", "one\ntwo")], "file_path string, text string")
    got = benchmarks.gold_alignment(spark.createDataFrame(gold, "key string, file_path string, start int, end int, answer string"), texts)
    # An unknown text is empty, and every answer holds the empty text.
    assert {r["key"]: r["aligned"] for r in got.collect()} == {"same": True, "blank": False, "holds": True, "other": False, "none": True, "lost": True, "beyond": True}


def test_corpus_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.txt", "ARTICLE 1\r\nThe fee is due.\r\n\r\nPay it."), ("b.TXT", " \n\t"), ("c.md", "no"), ("d.txt", "\u3000"), ("e.txt", "")):
        (tmp_path / "in" / name).write_bytes(text.encode())
    documents, chunks = corpus.ingested(corpus.text_files(spark, str(tmp_path / "in")), "corpus", "ws")
    assert sorted((r["doc_id"], r["title"], r["skipped"], r["chunks"]) for r in documents.collect()) == [("corpus:a.txt", "a", None, 1), ("corpus:b.TXT", "b", "empty", 0), ("corpus:d.txt", "d", "empty", 0)]
    (row,) = chunks.collect()
    assert (row["id"], row["section"], row["charspan"], row["session_id"], row["text"]) == ("corpus:a.txt:0", "ARTICLE 1", [10, 34], "ws", "The fee is due.\n\nPay it.")
    assert "fee" in row["search_tokens"].split()


def test_chunk_rows_leave_gaps(spark):
    documents = spark.createDataFrame([("d", "abc   def")], "doc_id string, full_text string")
    spans = spark.createDataFrame([("d", 0, 0, 3, ["A", "B"]), ("d", 1, 3, 6, []), ("d", 2, 6, 9, [])], "doc_id string, n int, start_offset int, end_offset int, section_path array<string>")
    got = sorted((r["id"], r["text"], r["chapter"], r["section"], r["charspan"]) for r in chunking.chunk_rows(documents, spans).collect())
    assert got == [("d:0", "abc", "A", "B", [0, 3]), ("d:2", "def", "", "", [6, 9])]


def test_trimmed(spark):
    for text in ("one two three four", "甲乙丙丁戊己庚辛", "甲 a 乙 b", "", None):
        for keep in (0, 1, 2, 3, 100):
            fits = [text[:i] for i in range(len(text) + 1) if chunking.estimate(text[:i]) <= keep] if text is not None and keep else [""]
            assert one(spark, chunking.trimmed(F.col("t"), keep), t=text) == (None if text is None else fits[-1])


def test_sizes_are_estimates():
    text = "甲方 shall pay　100%，on 1.2\n中a文"
    size = chunking.Sizes(text)
    assert all(size(a, b) == chunking.estimate(text[a:b]) for a in range(len(text)) for b in range(a, len(text) + 1))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["x", "y"], ' " \n, '), ("b", None, ""), ("c", [], None)], "id string, parts array<string>, text string")
    for _ in range(2):
        corpus.append_jsonl(rows, str(tmp_path / "json"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "json")).groupBy("id", "parts", "text").count().filter("count = 2").count() == 3
    corpus.write_csv(rows, str(tmp_path / "csv"))
    read = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").option("nullValue", "\\N").csv(str(tmp_path / "csv"))
    assert sorted((r["id"], r["parts"], r["text"]) for r in read.collect()) == [("a", '["x","y"]', ' " \n, '), ("b", None, ""), ("c", "[]", None)]


def test_lookups(spark):
    schema = "id string, doc_id string, chunk_index int, text string, section_path array<string>, page_no int, charspan array<int>"
    rows = [("d:0", "d", 0, "Alpha ", ["A"], 1, [0, 6]), ("d:1", "d", 1, "beta", ["A", "B"], None, [6, 10]), ("d:2", "d", 2, "gamma", ["C", "D"], 3, [10, 15]), ("e:0", "e", 0, "lost", ["A"], 1, None), ("e:1", "e", 1, "text", ["A"], 1, [0, 4])]
    chunks = spark.createDataFrame(rows, schema)
    documents = spark.createDataFrame([("d", "Alpha betagamma", "s", "T", None), ("e", "", "t", None, "txt")], "doc_id string, full_text string, session_id string, title string, source_format string")
    asked = spark.createDataFrame([("d", ["A"]), ("d", ["C"]), ("d", ["X"]), ("d", []), ("e", ["A"]), ("d", ["A"])], "doc_id string, path array<string>")
    assert sorted((r["doc_id"], *r["path"], r["id"]) for r in lookup.sections(asked, chunks).collect()) == [("d", "A", "d:0"), ("d", "C", "d:2"), ("e", "A", "e:0"), ("e", "A", "e:1")]
    texts = sorted((r["doc_id"], *r["path"], r["start_offset"], r["end_offset"], r["text"], r["chunk_ids"]) for r in lookup.section_texts(asked, chunks, documents).collect())
    assert texts == [("d", "A", 0, 6, "Alpha ", ["d:0"]), ("d", "C", 10, 15, "gamma", ["d:2"]), ("e", "A", 0, 0, "text\nlost", ["e:1", "e:0"])]
    ids = spark.createDataFrame([("s", "d:1"), ("s", "d:9"), ("s", "e:0"), ("s", "bad"), ("s", "d:x"), ("", "d:1"), (None, "d:1"), ("s", "z:0"), ("s", None)], "session string, id string")
    found = {(r["session"], r["id"]): (r["outcome"], r["text"], r["page_no"]) for r in lookup.chunks_by_id(ids, chunks, documents).collect()}
    assert found == {("s", "d:1"): ("found", "beta", 0), ("s", "d:9"): ("missing", None, None), ("s", "e:0"): ("outside", None, None), ("s", "bad"): ("invalid", None, None), ("s", "d:x"): ("invalid", None, None), ("", "d:1"): ("outside", None, None), (None, "d:1"): ("outside", None, None), ("s", "z:0"): ("outside", None, None)}
    meta = {r["doc_id"]: (r["outcome"], r["title"], r["source_format"]) for r in lookup.documents_by_id(spark.createDataFrame([("s", "d"), ("s", "e"), ("s", " "), ("s", "q")], "session string, doc_id string"), documents).collect()}
    assert meta == {"d": ("found", "T", ""), "e": ("outside", None, None), " ": ("invalid", None, None), "q": ("outside", None, None)}


def test_summaries(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "query string, document string")
    scores = summaries.document_scores(pairs([("q", "a"), ("q", "a"), ("q", "b"), ("r", "a"), (None, "a")]), pairs([("q", "a"), ("s", "a"), ("s", None)]))
    assert {r["query"]: (r["precision"], r["recall"]) for r in scores.collect()} == {"q": (0.5, 1.0), "r": (0.0, 0.0), "s": (0.0, 0.0)}
    schema = "valid boolean, completed boolean, gold_label string, label string, stop_reason string, reasons map<string,string>, candidates int, cited int, cited_matched int, rounds int"
    records = [(True, True, "neutral", "neutral", "done", {"hole": "2"}, 3, 4, 3, 2), (True, True, "neutral", "entailment", "max", {"hole": "1", "blank": "x"}, None, 0, 0, 3), (False, False, "neutral", None, "", None, 5, 0, 0, 1)]
    row = summaries.run_summary(spark.createDataFrame(records, schema)).first().asDict()
    assert (row["records"], row["errors"], row["accuracy"], row["candidates"], row["tokens"], row["citation_rate"], row["rounds_avg"], row["reasons"], row["stop_reasons"]) == (3, 1, 0.5, 8, 0, 0.75, 3.0, "hole=3", "done=1,max=1")
    empty = summaries.run_summary(spark.createDataFrame([], schema)).first()
    assert (empty["records"], empty["accuracy"], empty["reasons"]) == (0, 0.0, "")


def test_samples(spark):
    rows = spark.createDataFrame([("a" if i % 4 else "b", i) for i in range(400)], "s string, k int")
    taken = sessions.subsample(rows, "s", "k", 0.1).collect()
    assert len(taken) == 40 and sum(r["s"] == "b" for r in taken) == 10 and len({r["k"] for r in taken}) == 40
    assert sessions.subsample(rows.limit(3), "s", "k", 0.01).count() == 1


def test_common_token_of_all_chunks_and_queries(spark):
    """A token that every chunk and every query has: the best of each task are enough."""
    chunks = spark.createDataFrame([(f"d:{i}", i, "the " + ("fee " * (i % 7)) + f"x{i}") for i in range(900)], "id string, chunk_index int, text string").repartition(5)
    queries = spark.createDataFrame([(str(q), f"the fee x{q}") for q in range(300)], "query_id string, query string")
    found = retrieval.bm25(queries, chunks, k=3).collect()
    assert len(found) == 900 and all(sum(r["query_id"] == str(q) for r in found) == 3 for q in (0, 150, 299))
    tied = sorted((r["rank"], r["id"]) for r in found if r["query_id"] == "0")
    assert tied[0][1] == "d:0" and [i for _, i in tied[1:]] == ["d:6", "d:13"]
