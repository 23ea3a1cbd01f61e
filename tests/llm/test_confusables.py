from collections import defaultdict

import pytest

from lexloom.llm.confusables import Prototypes, lookalike_groups, lookalike_slices, public_lookalikes, skeleton, with_skeleton


@pytest.fixture(scope="module")
def table(spark):
    return Prototypes(public_lookalikes(spark))


SAME = [
    ("Agreement", "Ａｇｒｅｅｍｅｎｔ"), ("Zürich", "Zürich"), ("the parties", "the par​ties"), ("soft", "so­ft"), ("office file", "oﬃce ﬁle"), ("case", "саѕе"), ("TOP", "ΤΟΡ"), ("non-stop", "non‐stop"),
    ("一方，乙", "一方,乙"), ("方人", "⽅⼈"), ("工厂", "エ厂"), ("年金", "年金"), ("a b", "a　b"), ("x\r\ny", "x\ny"), ("é", "е́"), ("“q”", '"q"'),
]
OTHER = [("Agreement", "agreement"), ("2 of 3", "3 of 2"), ("shall", "shal"), ("x²", "x2"), ("甲方", "乙方"), ("not now", "now"), ("a\nb", "ab"), ("½", "1/2"), ("①", "1")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(table, a, b):
    assert skeleton(a, table) == skeleton(b, table)


@pytest.mark.parametrize("a,b", OTHER)
def test_other_look(table, a, b):
    assert skeleton(a, table) != skeleton(b, table)


#: Scripts and letters that occur in none of the given tables.
SCRIPTS = [
    ("DEW", "ᎠᎬᎳ"), ("BOP", "ꓐꓳꓑ"), ("op", "ⲟⲣ"), ("Liability", "Ⅼiabⅰlity"), ("scope", "ѕсоре"), ("HOUSE", "ⲎՕՍЅЕ"), ("m", "ⅿ"), ("01", "𝟎𝟏"), ("fog", "ꬵоɡ"), ("Term", "𝐓𝐞𝐫𝐦"), ("x", "⨯"), ("a:b", "a꞉b"), ("二", "⼆"), ("coeur", "cœur"), ("Sheqel", "Ꮪheqeꓲ".replace("ꓲ", "l")),
]


@pytest.mark.parametrize("a,b", SCRIPTS)
def test_scripts_of_no_given_table(table, a, b):
    assert skeleton(a, table) == skeleton(b, table)


@pytest.mark.parametrize("a,b", [("l0", "1O"), ("I", "l"), ("m", "rn"), ("é", "è"), ("己", "已"), ("Ж", "ж")])
def test_kinds_stay_apart(table, a, b):
    assert skeleton(a, table) != skeleton(b, table)


def test_table_is_the_whole_public_one(spark):
    assert len(public_lookalikes(spark)) > 5000


def test_groups_against_brute_force(spark, table):
    words = [x for pair in SAME + OTHER + SCRIPTS for x in pair]
    rows = [(str(i), words[i % len(words)] + " " + words[(i * 7) % len(words)]) for i in range(400)]
    held = defaultdict(set)
    for i, text in rows:
        held[skeleton(text, table)].add((i, text))
    want = {i for group in held.values() if len({t for _, t in group}) > 1 for i, _ in group}
    got = lookalike_groups(spark.createDataFrame(rows, "id string, text string"), "id", "text").collect()
    assert {r["id"] for r in got} == want and len(got) == len(want)
    by = defaultdict(set)
    for r in got:
        by[r["group_id"]].add(r["id"])
    assert sorted(map(sorted, by.values())) == sorted(sorted(i for i, _ in g) for g in held.values() if len({t for _, t in g}) > 1)


def test_skeleton_is_stable(table):
    for a, b in SAME + OTHER:
        for text in (a, b):
            assert skeleton(skeleton(text, table), table) == skeleton(text, table)
            assert skeleton(text + " Ж", table) == skeleton(text, table) + " Ж"  # the short way for plain text gives the same


def test_groups(spark):
    rows = [("1", "case one", 0, "g"), ("2", "саѕе one", 0, "g"), ("3", "case two", 0, "g"), ("4", "case two", 0, "g"), ("5", None, 0, "g"), (None, "case one", 0, "g"), ("2", "саѕе one", 0, "g"), ("6", "", 0, "g"), ("7", "​", 0, "g")]
    df = spark.createDataFrame(rows, "id string, text string, form int, group_id string")
    got = sorted(map(tuple, lookalike_groups(df, "id", "text").select("id", "group_id").collect()))
    assert [i for i, _ in got] == ["1", "2", "6", "7"] and got[0][1] == got[1][1] != got[2][1] == got[3][1]
    assert lookalike_groups(df.limit(0), "id", "text").count() == 0
    kept = with_skeleton(df, "text")
    assert kept.columns == ["id", "text", "form", "group_id", "text_skeleton"] and kept.filter("text is null and text_skeleton is not null").count() == 0


def test_slices(spark):
    full = "The саѕе of Zürich is closed. " * 500
    spans = [("chunk", "same", "d", 0, 8, "The саѕе"), ("chunk", "look", "d", 0, 8, "The case"), ("chunk", "other", "d", 0, 8, "The Case"), ("evidence", "look", "d", 12, 18, "Zürich"), ("evidence", "swap", "d", 18, 12, "x"), ("evidence", "null", "d", None, 5, "x"), ("evidence", "text", "d", 0, 8, None), ("chunk", "long", "d", 0, 9000, full[:9000].replace("е", "e")), ("chunk", "lost", "z", 0, 8, "The case"), ("chunk", "look", "d", 0, 8, "The case")]
    rows = spark.createDataFrame(spans, "kind string, id string, doc string, lo int, hi int, text string")
    documents = spark.createDataFrame([("d", full), ("d", full), (None, full)], "doc string, text string")
    assert sorted(map(tuple, lookalike_slices(rows, documents).collect())) == [("chunk", "long"), ("chunk", "look"), ("evidence", "look")]
    assert lookalike_slices(rows.limit(0), documents).count() == 0 and lookalike_slices(rows, documents.limit(0)).count() == 0
