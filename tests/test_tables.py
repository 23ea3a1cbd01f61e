import pytest
from pyspark.sql import functions as F

from lexloom.operators import retrieval, sessions, storage
from lexloom.streaming import jobs

CHUNKS = "id string, doc_id string, chunk_index int, text string, session_id string, page_no int, section_path array<string>, charspan array<int>, embedding array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("d:0", "d", 0, "Payment of the fee; 100% due.", "s", 1, ["A"], [0, 29], [1.0, 0.0]), ("d:1", "d", 1, "The FEE is paid. The fee_x.", "s", 2, ["A", "B"], [29, 56], [0.0, 1.0]), ("e:0", "e", 0, "nothing here", "t", 0, [], [0, 12], None), ("e:2", "e", 2, "", "t", 0, None, None, [0.0, 0.0])]
    return spark.createDataFrame(rows, CHUNKS)


def test_scope(chunks):
    assert retrieval.scoped(chunks, "s").count() == 2 and retrieval.scoped(chunks, "s", []).count() == 0 and retrieval.scoped(chunks, "t", ["e"]).count() == 2
    with pytest.raises(ValueError):
        retrieval.scoped(chunks, " ")
    assert retrieval.effective_documents(None, ["a"]) == ["a"] and retrieval.effective_documents([], None) is None
    with pytest.raises(ValueError):
        retrieval.effective_documents(["b"], ["a"])


def test_grep(chunks):
    got = {r["id"]: r for r in retrieval.grep(chunks, "fee").collect()}
    assert {k: r["match_count"] for k, r in got.items()} == {"d:0": 1, "d:1": 2}
    assert [r["id"] for r in retrieval.grep(chunks, "FEE", case_sensitive=True).collect()] == ["d:1"]
    assert [r["id"] for r in retrieval.grep(chunks, "fee_x", k=0).collect()] == ["d:1"] and retrieval.grep(chunks, "0% due").count() == 1
    assert {r["id"]: r["match_count"] for r in retrieval.grep(chunks, "fee|paid", mode="regex").collect()} == {"d:0": 1, "d:1": 3}
    for bad in ({"pattern": ""}, {"pattern": "x", "mode": "glob"}):
        with pytest.raises(ValueError):
            retrieval.grep(chunks, **bad)


def test_searches(spark, chunks):
    queries = spark.createDataFrame([("1", "fee payment"), ("2", "!!!"), ("3", None)], "query_id string, query string")
    by_text = retrieval.bm25(queries, chunks)
    assert [(r["id"], r["rank"]) for r in by_text.orderBy("rank").collect()] == [("d:0", 1), ("d:1", 2)]
    vectors = spark.createDataFrame([("1", [0.1, 1.0]), ("2", None), ("3", [0.0, 0.0])], "query_id string, vector array<float>")
    by_vector = retrieval.vectors(vectors, chunks, dim=2)
    assert [(r["query_id"], r["id"]) for r in by_vector.orderBy("rank").collect()] == [("1", "d:1"), ("1", "d:0")]
    both = retrieval.fused(by_vector, by_text).orderBy("rank").collect()
    assert [(r["id"], r["vector_rank"], r["bm25_rank"]) for r in both] == [("d:1", 1, 2), ("d:0", 2, 1)]
    assert [r["id"] for r in retrieval.reranked(by_text, queries, chunks).orderBy("rank").collect()] == ["d:0", "d:1"]


def test_sections_and_pages(spark, chunks):
    assert {(r["doc_id"], tuple(r["section_path"]), r["start_offset"], r["end_offset"]) for r in retrieval.outline(chunks).collect()} == {("d", ("A",), 0, 29), ("d", ("A", "B"), 29, 56)}
    assert [r["id"] for r in retrieval.section(chunks, ["A"]).collect()] == ["d:0"]
    spans = spark.createDataFrame([("x", "d", 20, 40), ("y", "d", 30, 31), ("z", "d", 99, 100), ("w", "q", 0, 1)], "key string, doc_id string, lo int, hi int")
    assert {r["key"]: r["page_no"] for r in retrieval.pages_for_spans(spans, chunks).collect()} == {"x": 1, "y": 2, "z": 0, "w": 0}


def test_maintenance(spark):
    stored = spark.createDataFrame([("a", "old", 1), ("b", "old", 1)], "k string, v string, at int")
    new = spark.createDataFrame([("b", "mid", 2), ("b", "new", 3), ("c", "new", 1)], "k string, v string, at int")
    assert sorted(map(tuple, storage.upsert(stored, new, "k", "at").collect())) == [("a", "old", 1), ("b", "new", 3), ("c", "new", 1)]
    assert sorted(map(tuple, storage.replace_children(stored, new.filter("k = 'b'"), "k").collect())) == [("a", "old", 1), ("b", "mid", 2), ("b", "new", 3)]
    documents = spark.createDataFrame([("d", "Title\nbody text"), ("e", "")], "doc_id string, full_text string")
    assert dict(map(tuple, storage.restore_texts(documents, spark.createDataFrame([("e", "back")], "doc_id string, full_text string")).collect())) == {"d": "Title\nbody text", "e": "back"}
    chunks = spark.createDataFrame([("ok", "d", [6, 10], "body"), ("early", "d", [5, 10], "body"), ("wrong", "d", [0, 5], "Tidle"), ("long", "d", [0, 99], "x"), ("none", "d", None, "x")], "id string, doc_id string, charspan array<int>, text string")
    assert [tuple(r) for r in storage.repaired_spans(chunks, documents).collect()] == [("early", 6, 10)]
    assert dict(map(tuple, storage.misaligned(chunks, documents).collect())) == {"early": "text", "wrong": "text", "long": "span", "none": "span"}


def test_logs(spark):
    log = spark.createDataFrame([("r", i, role) for i, role in enumerate(["u", "u", "a", "u", "a", "a"])], "run string, at int, role string").withColumn("size", F.lit(10))
    assert [(r["role"], r["messages"]) for r in sessions.merged_messages(log, "run", ["at"], "role", "size").orderBy("n").collect()] == [("u", 2), ("a", 1), ("u", 1), ("a", 2)]
    assert [r["blocked"] for r in sessions.budgeted(log, "run", ["at"], F.col("role") == "u", 2).orderBy("at").collect()] == [False, False, False, True, False, False]
    assert sorted(r["at"] for r in sessions.bounded_history(log, "run", ["at"], "size", 45).collect()) == [2, 3, 4, 5]
    assert sorted(r["at"] for r in sessions.bounded_history(log, "run", ["at"], "size", 5).collect()) == [3, 4, 5]
    counts = spark.createDataFrame([({"a": "1", "b": "x"},), ({"a": "2"},), (None,)], "m map<string,string>")
    assert [tuple(r) for r in sessions.map_sums(counts, "m").collect()] == [("a", 3)]


def test_layers(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "c"), ("a", "b")], "parent string, child string")
    assert {r["node"]: r["layer"] for r in sessions.layers(edges).collect()} == {"a": 0, "x": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError):
        sessions.layers(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "parent string, child string"))


def test_incremental_ingest(spark, tmp_path):
    folder, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    first = spark.createDataFrame([("a", 1), ("b", 1), ("a", 1)], "k string, v int")
    first.write.parquet(folder)
    assert sorted(r["k"] for r in jobs.ingest(spark, folder, first.schema, "k", out, mark).collect()) == ["a", "b"]
    spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int").write.mode("append").parquet(folder)
    for _ in range(2):
        assert sorted(map(tuple, jobs.ingest(spark, folder, first.schema, "k", out, mark).collect())) == [("a", 1), ("b", 1), ("c", 2)]


def test_streams_keep_rows_of_any_lateness(spark, tmp_path):
    from datetime import datetime, timedelta

    # The newest row comes first: what follows lies years behind it.
    day = [datetime(2024, 6, 1) - timedelta(days=d) for d in (0, 1600, 2, 1600)]

    def delivered(job, name, rows, schema):
        folder, out, mark = (f"{tmp_path}/{name}{x}" for x in ("", "-out", "-mark"))
        for row in rows:
            frame = spark.createDataFrame([row], schema)
            frame.coalesce(1).write.mode("append").parquet(folder)
            got = job(spark, folder, frame.schema, out, mark)
        return sorted(map(tuple, got.collect()))

    chunks = [(i, "fee", d) for i, d in zip(("a", "b", "a", "b"), day)]
    assert delivered(jobs.backfill_tokens, "chunks", chunks, "id string, text string, ingested_at timestamp") == [("a", "fee"), ("b", "fee")]
    spans = [("d", n, 9, d) for n, d in zip((1, 2, 1, 2), day)]
    assert delivered(jobs.register_spans, "spans", spans, "document_id string, start_offset int, end_offset int, created_at timestamp") == [("d", 1, 9), ("d", 2, 9)]
    events = [(d, "x", 1.5) for d in day]
    assert delivered(jobs.windowed_counts, "events", events, "ts timestamp, event_type string, value double") == [(day[1], "x", 2, 3.0), (day[2], "x", 1, 1.5), (day[0], "x", 1, 1.5)]
