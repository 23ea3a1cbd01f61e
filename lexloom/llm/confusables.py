"""One consistent form of visually identical texts: the confusables skeleton.

A text is decomposed, every character is replaced by its prototype, and the result is decomposed
again. Texts with equal skeletons look the same to a reader. Prototypes come from the public table of confusables, of which the ICU library that
Spark ships holds a copy; the driver reads it once and broadcasts it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.slices import slices

#: A prototype, and characters that look like it to a reader of contracts, whether or not the public table joins them.
LOOKALIKES = {
    "A": "ΑАᎪ", "B": "ΒВ", "C": "СϹ", "E": "ΕЕ", "H": "ΗН", "I": "ΙІӀ", "J": "ЈͿ", "K": "ΚКK", "M": "ΜМ", "N": "Ν", "O": "ΟОՕ",
    "P": "ΡР", "Q": "Ԛ", "S": "ЅՏ", "T": "ΤТ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ΧХ", "Y": "ΥҮ", "Z": "Ζ",
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іιı", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ոռ", "o": "оοօ", "p": "рρ", "q": "ԛզ",
    "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уγү", "æ": "ӕ", "ə": "ә",
    "一": "ー", "丨": "〡", "丿": "ノ", "二": "ニ", "八": "ハ", "力": "カ", "千": "チ", "卜": "ト", "口": "ロ", "夕": "タ", "工": "エ", "匕": "ヒ",
    "'": "‘’‚‛ʼʹ′＇`´", '"': "“”„‟″＂", "/": "⁄∕", ":": "ː∶", ";": ";", "·": "•‧∙⋅・", "~": "∼～", "|": "ǀ∣",
}
#: Compatibility decompositions that keep the look; superscripts, fractions, circled and squared forms do not.
KEEPING = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>"}
#: Letters without a picture that are not in the format category (fixed values).
FILLERS = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
PROTOTYPE = {ord(c): p for p, group in LOOKALIKES.items() for c in group if c != p}
#: The public table joins these ASCII characters with others of ASCII. They stay apart here, since another letter case or another digit is
#: another text; what looks like them goes to the one of its own kind: prototype, then for capitals, digits, other letters and other marks.
JOINED = {"l": "I1l|", "O": "O0OO", "rn": "mmmm", "''": '""""', "º/₀": "%%%%"}


def public_lookalikes(spark: SparkSession) -> dict[int, str]:
    """Prototype of every character beyond ASCII that the public table of confusables gives another form."""
    global _PUBLIC
    if _PUBLIC is None:
        # Han characters, too; syllables of Hangul are decomposed before the table is used.
        points = [c for c in range(0x80, 0x30000) if not (0xAC00 <= c < 0xD7A4 or unicodedata.category(chr(c)) in ("Cn", "Cs", "Co", "Cc"))]
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        forms = checker.getSkeleton("\n".join(map(chr, points))).split("\n")
        _PUBLIC = {c: f for c, f in zip(points, forms) if f != unicodedata.normalize("NFD", chr(c))}
    return _PUBLIC


_PUBLIC: dict[int, str] | None = None


class Prototypes(dict):
    """Translation table that works out a character when it first occurs."""

    def __init__(self, public: dict[int, str]):
        super().__init__()
        self.public = public
        # Where a fixed prototype differs from the public one, all characters of the public one follow.
        self.renamed = {public[c]: p for c, p in PROTOTYPE.items() if c in public and public[c] != p and not public[c].isascii()}

    def __reduce__(self):
        return Prototypes, (self.public,)

    def __missing__(self, point: int) -> str:
        char = chr(point)
        category = unicodedata.category(char)
        if category == "Cf" or char in FILLERS or 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF:
            form = ""
        elif category == "Zs" or char == "\t":
            form = " "
        elif category == "Zl" or category == "Zp" or point == 0x85:
            form = "\n"
        elif category == "Pd" or point in (0x2212, 0x2043):
            form = "-"
        elif point in PROTOTYPE:
            form = "".join(self[ord(c)] for c in PROTOTYPE[point])
        elif point < 0x80:
            form = char
        else:
            tag, _, rest = unicodedata.decomposition(char).partition(" ")
            if tag in KEEPING:
                form = "".join(self[int(h, 16)] for h in rest.split())
            else:
                form = self._looks(char, category)
        self[point] = form
        return form

    def _looks(self, char: str, category: str) -> str:
        """The prototype of a character by the public table."""
        form = self.public.get(ord(char), char)
        if form in JOINED:
            capital, digit, small, other = JOINED[form]
            return capital if category == "Lu" else digit if category == "Nd" else small if category[0] == "L" else other
        return self.renamed.get(form, form)


def skeleton(text: str, table: Prototypes) -> str:
    """The skeleton of a text; letter case, digits and words stay as they are."""
    if text.isascii():
        return text.replace("\r\n", "\n").replace("\t", " ").replace("`", "'")
    text = unicodedata.normalize("NFD", text.replace("\r\n", "\n")).translate(table)
    return unicodedata.normalize("NFD", text)


def with_skeleton(df: DataFrame, *texts: str) -> DataFrame:
    """``df`` plus ``<column>_skeleton`` for each text column: the md5 of its skeleton, null for null.

    Works on whole texts, in one pass over the rows. Other columns are kept, except that an existing column of the new name is replaced.
    """
    kept = [c for c in df.columns if c not in {f"{t}_skeleton" for t in texts}]
    df = df.select(*kept)
    shared = df.sparkSession.sparkContext.broadcast(Prototypes(public_lookalikes(df.sparkSession)))
    schema = ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + [f"`{t}_skeleton` string" for t in texts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            for name in texts:
                made = (None if t is None else md5(skeleton(t, shared.value).encode("utf-8", "surrogatepass")).hexdigest() for t in batch.column(name).to_pylist())
                columns.append(pa.array(made, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(f"{t}_skeleton" for t in texts)])

    return df.mapInArrow(run, schema)


def lookalike_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, group_id)``: records whose text looks like a differently written text of another record.

    ``group_id`` is the md5 of the shared skeleton. Groups are counted by pre-aggregation, never collected, so one group may hold most rows.
    Rows with a null id or text are left out, repeated rows of an id count once, and exact copies alone make
    no group. An empty table gives no rows; extra columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    keyed = with_skeleton(rows, "text").select("id", F.col("text_skeleton").alias("group_id"), F.md5(F.col("text").cast("binary")).alias("form"))
    mixed = keyed.groupBy("group_id").agg(F.min("form").alias("low"), F.max("form").alias("high")).filter("low < high").select("group_id")
    return keyed.select("id", "group_id").distinct().join(mixed, "group_id").select("id", "group_id")


def lookalike_slices(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """``(kind, id)`` of the records whose ``text`` is not the stored slice but has its skeleton; see :func:`lexloom.operators.slices.slices`.

    Records with a null text, or equal to their slice, are none. Repeated rows count once; empty tables give no rows.
    """
    differing = slices(spans, documents).filter(F.col("text") != F.col("slice"))
    both = with_skeleton(differing.select("kind", "id", "text", "slice"), "text", "slice")
    return both.filter(F.col("text_skeleton") == F.col("slice_skeleton")).select("kind", "id").distinct()
