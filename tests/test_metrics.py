import random

from lexloom.operators import metrics


def spans(spark, rows):
    return spark.createDataFrame(rows, "entity string, start long, end long")


def covered(rows):
    return {(e, i) for e, s, t in rows if e is not None and s is not None and t is not None for i in range(s, t)}


def test_overlaps_and_scores_against_sets(spark):
    rng = random.Random(4)
    make = lambda n: [(rng.choice("abc"), s, s + rng.randrange(-1, 300)) for s in (rng.randrange(0, 9000) for _ in range(n))] + [(None, 0, 5)]
    a, b = make(60), make(60)
    x, y = covered(a), covered(b)
    row = metrics.span_scores(spans(spark, a), spans(spark, b)).first()
    assert (row["retrieved"], row["gold"], row["overlap"]) == (len(x), len(y), len(x & y))
    p, r = len(x & y) / len(x), len(x & y) / len(y)
    assert abs(row["precision"] - p) < 1e-6 and abs(row["recall"] - r) < 1e-6 and abs(row["f1"] - 2 * p * r / (p + r)) < 1e-6
    empty = metrics.span_scores(spans(spark, []), spans(spark, [])).first()
    assert tuple(empty) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_hit_rate_counts_positive_overlap_only(spark):
    rows = spark.createDataFrame([("1", "doc", 10, 10), ("2", "doc", 0, 10), ("3", "doc", 19, 30), ("4", "other", 10, 20)], "key string, entity string, start long, end long")
    assert tuple(metrics.hit_rate(rows, spans(spark, [("doc", 10, 20)])).first()) == (1, 3, round(1 / 3, 6))
    assert tuple(metrics.hit_rate(rows.limit(0), spans(spark, [])).first()) == (0, 0, 0.0)


def test_ranking(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "b", 3), ("q", "c", 4), ("r", "a", 1)], "query string, document string, rank int")
    gold = spark.createDataFrame([("q", "b"), ("q", "z"), ("s", "a")], "query string, document string")
    got = {r["query"]: r for r in metrics.ranking_scores(ranked, gold, (1, 2)).collect()}
    assert (got["q"]["recall_1"], got["q"]["recall_2"], got["q"]["precision_2"], got["q"]["mrr"]) == (0.0, 0.5, 0.5, 0.5)
    assert (got["r"]["recall_2"], got["r"]["mrr"], got["s"]["recall_2"], got["s"]["mrr"]) == (0.0, 0.0, 0.0, 0.0)


def test_classification(spark):
    pairs = [("e", "e"), ("e", "n"), ("n", "n"), ("c", "e"), (None, "c"), ("n", None)]
    df = spark.createDataFrame(pairs, "t string, p string")
    scores = {r["label"]: r for r in metrics.class_scores(df, "t", "p").collect()}
    assert (scores["e"]["support"], scores["e"]["predicted"], scores["e"]["hits"], scores["e"]["f1"]) == (2, 2, 1, 0.5)
    assert scores["None"]["support"] == 1 and scores["c"]["f1"] == 0.0
    row = metrics.classification_summary(df, "t", "p").first()
    assert row["n"] == 6 and abs(row["accuracy"] - 2 / 6) < 1e-6
    assert abs(row["f1_weighted"] - sum(s["support"] * s["f1"] for s in scores.values()) / 6) < 1e-6
    assert tuple(metrics.classification_summary(df.limit(0), "t", "p").first()) == (0, 0.0, 0.0)


def test_largest_remainder_golden_cases(spark):
    split = lambda w, n: [r["share"] for r in sorted(metrics.largest_remainder(spark.createDataFrame(list(enumerate(w)), "k int, w double"), "k", "w", n).collect())]
    assert split([220.0, 968.0, 903.0], 150) == [16, 69, 65]
    assert split([220.0, 968.0, 903.0], 15) == [2, 7, 6]
    assert split([1.0, 1.0, 1.0], 2) == [1, 1, 0]


def test_gold_of_cited_chunks_is_whole(spark, tmp_path):
    from lexloom.plans.evidence import QUERIES

    at = "timestamp'2024-01-01'"
    spark.sql(f"select concat('c', id) id, 'd' doc_id, cast(id as int) chunk_index, array(cast(10 * id as int), cast(10 * id + 10 as int)) charspan, {at} ingested_at from range(6)").write.parquet(f"{tmp_path}/chunks.parquet")
    rows = "('e1', array('c1', 'c2'), 10, 30, true), ('e2', array('c5'), 50, 55, true), ('e3', array('c0', 'c3'), 0, 10, false), ('e4', array('c4'), 25, 35, cast(null as boolean))"
    spark.sql(f"select *, 'd' document_id, {at} ingested_at from values {rows} as t(evidence_id, source_chunk_ids, start_offset, end_offset, verified)").write.parquet(f"{tmp_path}/evidence.parquet")
    assert [tuple(r) for r in QUERIES["span_scores_cited"](spark, str(tmp_path)).collect()] == [(25, 30, 25, 1.0, 0.833333, 0.909091)]
    assert [tuple(r) for r in QUERIES["evidence_hit_rate_cited"](spark, str(tmp_path)).collect()] == [(3, 4, 0.75)]
