"""Rows written inside free text: numbered lists and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playbill.functions import fixed_values as V
from playbill.functions.text import let, strip


def numbered_rows(df: DataFrame, text: str, key: str) -> DataFrame:
    """Items of ``1. text`` and ``2) text`` lines without outer quotes, each once whatever its case."""
    items = F.transform(F.regexp_extract_all(text, F.lit(V.NUMBERED_LINE_PATTERN), F.lit(1)), lambda i: strip(i))

    def bare(item):
        first, last = F.substring(item, 1, 1), F.right(item, F.lit(1))
        quoted = (F.length(item) >= 2) & (first == last) & first.isin('"', "'")
        return F.when(quoted, strip(F.substr(item, F.lit(2), F.length(item) - 2))).otherwise(item)

    rows = df.select(key, F.transform(items, bare).alias("items"))
    lows = F.transform(F.col("items"), lambda s: F.lower(s))
    once = let(lows, lambda low: F.filter("items", lambda s, i: (s != "") & (F.array_position(low, F.lower(s)) == i + 1)))
    return rows.select(key, F.posexplode(once).alias("pos", "item"))


def json_rows(df: DataFrame, text: str, key: str, item: str, field: str) -> DataFrame:
    """Typed rows of the JSON a text carries: fenced, bare, or the text itself.

    The JSON is an object with a list under ``field`` or the list itself; ``item`` is the DDL of its
    elements. Text without readable JSON gives no rows.
    """
    element = T.StructType.fromDDL(item)
    wrapped = T.StructType([T.StructField(field, T.ArrayType(element))])
    forms = [
        F.regexp_extract(text, V.FENCE_PATTERN, 1),
        F.regexp_extract(text, V.BARE_JSON_PATTERN, 1),
        strip(text),
    ]
    found = []
    for form in forms:
        body = strip(form)
        found.append(F.when(body.startswith("["), F.from_json(body, T.ArrayType(element))))
        found.append(F.when(body.startswith("{"), F.from_json(body, wrapped)[field]))
    return df.select(key, F.posexplode(F.coalesce(*found)).alias("pos", "r")).filter("r is not null").select(key, "pos", "r.*")
