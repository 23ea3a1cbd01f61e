"""JSON out of free text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a call of a tool is marked in free text (fixed values).
CALL = "(?s)<tool_call>(.*?)</tool_call>"


def _unfenced(text: Column) -> Column:
    """Text without the code fence around it."""
    bare = F.regexp_replace(text, "^\\s+|\\s+$", "")
    return F.when(bare.startswith("```"), F.regexp_replace(F.regexp_replace(bare, "^```[^\\n]*(\\n|$)", ""), "\\s*```$", "")).otherwise(bare)


def _valid(body: Column, kind: str) -> Column:
    """The text if it is one JSON value of a kind; Spark's reader stops after the first value, so what follows it is looked at here."""
    opens, closes = ("{", "}") if kind == "OBJECT" else ("[", "]")
    # Brackets of this kind outside of strings, and how often they close to none.
    bare = F.regexp_replace(F.regexp_replace(body, '"(\\\\.|[^"\\\\])*"', ""), f"[^\\{opens}\\{closes}]", "")
    deep = F.aggregate(
        F.filter(F.split(bare, ""), lambda c: c != ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("ends")),
        lambda at, c: F.struct((at["depth"] + F.when(c == opens, 1).otherwise(-1)).alias("depth"), (at["ends"] + F.when((at["depth"] == 1) & (c == closes), 1).otherwise(0)).alias("ends")),
    )
    return F.when(F.schema_of_variant(F.try_parse_json(body)).startswith(kind) & (deep["ends"] == 1), body)


def json_object(text: Column) -> Column:
    """The outermost JSON object in free text as JSON text, commas before closing brackets mended; null where there is none that can be read."""
    bare = _unfenced(text)
    found = F.regexp_extract(bare, "(?s)\\{.*\\}", 0)
    body = F.regexp_replace(F.when(found != "", found).otherwise(bare), ",(\\s*[}\\]])", "$1")
    return _valid(body, "OBJECT")


def json_array(text: Column) -> Column:
    """The text as a JSON array if it is one, else the outermost array within it; null where neither can be read."""
    bare = _unfenced(text)
    return F.coalesce(_valid(bare, "ARRAY"), F.when(F.try_parse_json(bare).isNull(), _valid(F.regexp_extract(bare, "(?s)\\[.*\\]", 0), "ARRAY")))


def tool_calls(text: Column) -> Column:
    """``array<struct<id, name, arguments>>``: the marked calls of tools in a text, numbered as they come; those that are no JSON object are left out. ``arguments`` is JSON text."""
    bodies = F.transform(F.regexp_extract_all(text, F.lit(CALL), F.lit(1)), lambda body, n: F.struct(n.alias("n"), F.regexp_replace(body, "^\\s+|\\s+$", "").alias("body")))
    read = F.filter(bodies, lambda call: F.schema_of_variant(F.try_parse_json(call["body"])).startswith("OBJECT"))
    return F.transform(
        read,
        lambda call: F.struct(
            F.concat(F.lit("manual_"), call["n"].cast("string")).alias("id"), F.get_json_object(call["body"], "$.name").alias("name"), F.coalesce(F.get_json_object(call["body"], "$.arguments"), F.lit("{}")).alias("arguments")
        ),
    )
