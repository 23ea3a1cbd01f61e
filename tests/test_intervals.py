import random

from lexloom.operators.intervals import levels_for, periods_and_gaps

SCHEMA = "entity string, s int, e int, start string, kind int, rank int"


def brute(rows):
    spans = {}
    for entity, s, e, *_ in rows:
        if entity is not None and s is not None and e is not None and s < e:
            spans.setdefault(entity, []).append((s, e))
    out = set()
    for entity, own in spans.items():
        merged = []
        for s, e in sorted(own):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(entity, "period", s, e) for s, e in merged}
        out |= {(entity, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def found(spark, rows, block=4096):
    df = periods_and_gaps(spark.createDataFrame(rows, SCHEMA), "entity", "s", "e", block)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(600):
        s = rng.randrange(0, 400)
        rows.append((rng.choice(["a", "a", "a", "b", "c", "", None]), rng.choice([s, s, None]) if rng.random() < 0.1 else s, s + rng.randrange(-2, 6), "x", 1, 2))
    rows += rows[:50]
    for block in (7, 4096):
        assert found(spark, rows, block) == brute(rows)


def test_touching_nested_equal_and_swapped(spark):
    rows = [("d", 0, 5, None, None, None), ("d", 5, 9, None, None, None), ("d", 1, 2, None, None, None), ("d", 20, 30, None, None, None), ("d", 20, 30, None, None, None), ("d", 40, 35, None, None, None), ("d", 50, 50, None, None, None)]
    assert found(spark, rows) == {("d", "period", 0, 9), ("d", "gap", 9, 20), ("d", "period", 20, 30)}


def test_empty_and_hot(spark):
    assert found(spark, []) == set()
    rows = [("hot", 3 * i, 3 * i + 2, None, None, None) for i in range(2000)]
    assert found(spark, rows, 64) == brute(rows)


def test_hot_entity_with_microseconds(spark):
    """Sparse bounds: every first block holds one row, and the blocks are ranked in blocks themselves."""
    rng = random.Random(6)
    start = 1_600_000_000_000_000
    rows = []
    for i in range(3000):
        s = start + i * 7_000_000_000 + rng.randrange(6_000_000_000)
        rows.append(("hot" if i % 50 else "cold", s, s + rng.randrange(1, 9_000_000_000)))
    assert levels_for(3000 * 7_000_000_000) == 3 and levels_for(5000) == 1 and levels_for(4096**2) == 2
    df = spark.createDataFrame(rows, "entity string, s long, e long")
    for block in (16, 4096):
        assert {tuple(r) for r in periods_and_gaps(df, "entity", "s", "e", block).collect()} == brute(rows)
