"""Metadata of documents: overrides, unions of keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def override_metadata(docs: DataFrame, pairs: str, fields: tuple[str, ...] = ("title", "date", "abstract")) -> DataFrame:
    """Sets metadata from an array column of KEY=VALUE strings: named fields, else entries of `custom`.

    The last pair of a key wins; what follows the first = is the value. `custom` is a map of strings.
    """
    split = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p)).alias("v")))
    d = docs.withColumn("_p", split)
    last = lambda k: F.try_element_at(F.filter("_p", lambda x: x["k"] == k), F.lit(-1))["v"]
    rest = F.array_distinct(F.transform(F.filter("_p", lambda x: ~x["k"].isin(*fields)), lambda x: x["k"]))
    extra = F.map_from_entries(F.transform(rest, lambda k: F.struct(k, F.element_at(F.filter("_p", lambda x: x["k"] == k), -1)["v"])))
    kept = F.map_filter("custom", lambda k, _: ~F.array_contains(rest, k))
    return d.withColumns({**{f: F.coalesce(last(f), F.col(f)) for f in fields}, "custom": F.map_concat(kept, extra)}).drop("_p", pairs)


def keyword_union(docs: DataFrame, lists: list[str], to: str) -> DataFrame:
    """Array columns as one without repeats, in order of first appearance."""
    return docs.withColumn(to, F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists])))
