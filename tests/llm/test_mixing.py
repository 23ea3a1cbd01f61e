import numpy as np
import pytest

from lexloom.llm import mixing
from lexloom.llm.mixing import mixture, shard_quotas, with_tokens


def test_splitting_tree_adds_up_and_is_hypergeometric():
    counts = np.array([700, 250, 50, 0])
    parts = [shard_quotas(counts, 7, k, 3) for k in range(7)]
    total = np.zeros(4, int)
    for first, number in parts:
        assert (first == total).all()
        total += number
    assert (total == counts).all()
    sizes = [int(n.sum()) for _, n in parts]
    assert max(sizes) - min(sizes) <= 3
    draws = np.array([shard_quotas(counts, 2, 0, seed)[1] for seed in range(400)])
    assert abs(draws.mean(axis=0) - counts / 2).max() < 3 and 3.5 < draws[:, 0].std() < 10  # sd of the exact law: 7.25


def rows(spark, data):
    return spark.createDataFrame([(*r, 0, "x") for r in data], "id long, source string, tokens int, block int, shard string")


def targets(spark, data):
    return spark.createDataFrame(data, "source string, weight double, max_repeats int")


def test_shares_caps_and_repeats(spark):
    data = [(i, "big" if i % 3 else "hot", 1 + i % 40) for i in range(6000)] + [(10_000 + i, "small", 5 + i % 7) for i in range(60)]
    data += [(20_000, None, 5), (None, "big", 5), (20_001, "big", None), (20_002, "big", 0), (5, "big", 1 + 5 % 40), (20_003, "unlisted", 9)]
    wanted = [("big", 5.0, 1), ("hot", 4.0, 2), ("small", 0.5, 4), ("absent", 0.5, 3), (None, 1.0, 1), ("zero", 0.0, 1), ("never", 1.0, 0)]
    mixed, report = mixture(rows(spark, data), targets(spark, wanted), block_tokens=300, shard_tokens=9000)
    got, shares = mixed.collect(), {r["source"]: r for r in report.collect()}
    assert len({(r["shard"], r["position"]) for r in got}) == len(got) == len({(r["id"], r["copy"]) for r in got})
    caps = {"big": 1, "hot": 2, "small": 4}
    assert all(r["copy"] < caps[r["source"]] for r in got)
    total = sum(r["tokens"] for r in got)
    for source, weight in (("big", 5.0), ("hot", 4.0), ("small", 0.5)):
        own = sum(r["tokens"] for r in got if r["source"] == source)
        assert own == shares[source]["tokens"] and shares[source]["quota"] <= own < shares[source]["quota"] + 40
        assert abs(own / total - weight / 9.5) < 0.01 and abs(shares[source]["actual_share"] - own / total) < 1e-9
    assert min(s["quota"] - s["available"] * s["max_repeats"] for n, s in shares.items() if n in caps) == 0 or any(abs(shares[n]["quota"] - shares[n]["available"] * caps[n]) <= 2 for n in caps)
    assert {n: shares[n]["tokens"] for n in ("absent", "zero", "never", "unlisted")} == dict.fromkeys(("absent", "zero", "never", "unlisted"), 0)
    per_shard = [sum(r["tokens"] for r in got if r["shard"] == s) for s in {r["shard"] for r in got}]
    assert len(per_shard) == -(-sum(s["quota"] for s in shares.values()) // 9000) and min(per_shard) > 0
    again = mixture(rows(spark, data), targets(spark, wanted), block_tokens=300, shard_tokens=9000)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_total_and_empty(spark):
    data = [(i, "a", 10) for i in range(100)] + [(1000 + i, "b", 10) for i in range(10)]
    report = {r["source"]: r for r in mixture(rows(spark, data), targets(spark, [("a", 1.0, None), ("b", 1.0, 2)]), total=800)[1].collect()}
    assert (report["a"]["tokens"], report["b"]["tokens"]) == (400, 200)  # b is used twice and falls short
    for d, t in ((data, []), ([], [("a", 1.0, 1)])):
        mixed, report = mixture(rows(spark, d), targets(spark, t))
        assert mixed.count() == 0 and all(r["tokens"] == 0 for r in report.collect())


def test_tokens_of_a_public_vocabulary(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    df = spark.createDataFrame([(1, "Hello <|endoftext|> 甲方", "z"), (2, "", "z"), (3, None, "z")], "id long, text string, tokens string")
    got = {r["id"]: r["tokens"] for r in with_tokens(df, "text", str(path), tokenizers.PATTERN).collect()}
    assert got[1] > 6 and got[2] == got[3] == 0


def test_hot_source_is_ranked_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 16)
    data = [(i, "hot" if i % 9 else "cold", 3) for i in range(4000)]
    mixed, report = mixture(rows(spark, data), targets(spark, [("hot", 3.0, 2), ("cold", 1.0, 3)]), block_tokens=15, shard_tokens=600)
    got = mixed.collect()
    assert len({(r["id"], r["copy"]) for r in got}) == len(got)
    shares = {r["source"]: r for r in report.collect()}
    assert all(shares[s]["quota"] <= shares[s]["tokens"] < shares[s]["quota"] + 4 for s in ("hot", "cold"))
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(source#" in plan and "_block" in plan
