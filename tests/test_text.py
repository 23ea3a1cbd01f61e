import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators import blocks, chunking

PIECES = ["甲方", "中文。", "word", "Word's", " ", "\n", "3.14", "8.5%", "$5,000.50", "5,000,000", "a_b", "___", "!", "?", "；", "。", "é", "　", "ＡＢ１", "4.2A", "7th", "x" * 70, "第三条 定义", "\n1.2 Scope\n", "(a) item", "IV. Roman", "\nARTICLE ONE\n", "😀", ""]


def texts(n=120):
    rng = random.Random(11)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", make(F.col("t")).alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


def test_estimate_is_the_same_in_python(spark):
    values = texts()
    assert column(spark, [*values, None], tx.estimated_tokens) == [chunking.estimate(v) for v in values] + [None]


def test_sentences_tile(spark):
    values = texts()
    for value, parts in zip(values, column(spark, values, tx.sentences)):
        assert "".join(parts) == value
        assert all(re.search("[。！？!?；;\n]", p) for p in parts[:-1])


def test_search_tokens(spark):
    assert column(spark, ["Pay $5,000.50k or 8.5% per 4.2A, 7th ___ x_y", "保密协议 A甲b", "ＡＢ１２", None, ""], tx.search_tokens) == [
        ["pay", "$5,000.50k", "or", "8.5%", "per", "4.2a", "7t", "h", "x_y"], ["保密", "密协", "协议", "a", "甲", "b"], ["ab12"], None, [],
    ]


@pytest.mark.parametrize("line,level", [("第三条 定义", 1), ("1. Scope", 1), ("1.2.3 Scope", 3), ("IV. Roman", 2), ("a) letter", 2), ("（一）项", 3), ("二、项", 3), ("1. A sentence.", None), ("plain", None), ("x" * 61, None), ("", None), ("12th floor", None)])
def test_heading_levels(spark, line, level):
    assert column(spark, [line], tx.heading_level) == [level]


def test_raw_heading_levels(spark):
    assert column(spark, ["Section 4.2 Payment", "CERTAIN DEFINITIONS", "CERTAIN DEFINITIONS.", "Partial words", "Some text", ""], tx.raw_heading_level) == [1, 1, None, None, None, None]


def test_snippets_and_keys(spark):
    make = lambda t: tx.around_snippet(t, F.lit(300), F.lit(10), 200)
    value = "".join(chr(97 + i % 26) for i in range(1000))
    assert column(spark, [value], make) == [value[300 - 95 : 300 + 105]]
    assert column(spark, ["a:b:7", "a:b:x", "a"], lambda t: tx.chunk_key_parts(t)[1]) == [7, None, None]
    assert column(spark, ["a:b:7"], lambda t: tx.chunk_key_parts(t)[0]) == ["a:b"]


def brute_budget(text, cap, overlap):
    rows, pos = [], 0
    for line in text.split("\n"):
        if line.strip():
            rows.append((pos, pos + len(line), chunking.estimate(line)))
        pos += len(line) + 1
    out, held = [], []
    for row in rows:
        if held and sum(r[2] for r in held) + row[2] > cap:
            out.append((held[0][0], held[-1][1]))
            carry = []
            for r in reversed(held):
                if sum(c[2] for c in carry) + r[2] > overlap:
                    break
                carry.insert(0, r)
            held = carry
        held.append(row)
    return out + ([(held[0][0], held[-1][1])] if held else [])


def test_token_budget_chunks(spark):
    values = texts(60)
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate([*values, None])], "doc_id string, full_text string")
    got = {}
    for r in chunking.token_budget_chunks(df, cap=12, overlap=4, headings=False).collect():
        got.setdefault(r["doc_id"], []).append((r["n"], r["start_offset"], r["end_offset"]))
    for i, v in enumerate(values):
        assert [x[1:] for x in sorted(got.get(str(i), []))] == brute_budget(v, 12, 4)


def test_heading_paths_nest_after_a_skipped_level():
    assert chunking.heading_paths([1, 3, 3, 2], ["A", "B", "C", "D"]) == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"]]


def test_sentence_groups_tile_within_the_cap():
    for value in texts():
        spans = chunking.sentence_groups(value, 5)
        assert "".join(value[a:b] for a, b in spans) == value
        assert all(chunking.estimate(value[a:b]) <= 5 for a, b in spans)
    with pytest.raises(ValueError):
        chunking.sentence_groups("x", 0)


def test_structural_chunks(spark):
    body = "\n".join(["第一条 总则", *["甲方应当按期付款。" * 6] * 8, "2.1 Payment", "short text", "word " * 900])
    df = spark.createDataFrame([("d", body)], "doc_id string, full_text string")
    made = blocks.parsed_blocks(df)
    full = blocks.assembled(made).first()["full_text"]
    chunks = sorted(chunking.structural_chunks(made, cap=100, overlap=20).collect(), key=lambda r: r["n"])
    assert len({(c["start_offset"], c["end_offset"]) for c in chunks}) == len(chunks) > 3
    assert all(chunking.estimate(full[c["start_offset"] : c["end_offset"]]) <= 100 for c in chunks)
    assert chunks[0]["section_path"] == ["第一条 总则"] and chunks[-1]["section_path"] == ["第一条 总则", "2.1 Payment"]
    assert not any("第一条" in full[c["start_offset"] : c["end_offset"]] for c in chunks)


def test_character_cuts_cover():
    for value in [*texts(), "a" * 2000]:
        spans = chunking.character_cuts(value, 60, 10)
        assert "".join(value[a:b] for a, b in spans) == value and all(0 < b - a <= 60 for a, b in spans)
