"""Relational helpers of the data adapters: keys, votes, codes, inner and outer joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 17 land-cover classes to 10 simpler ones; what isn't listed becomes 0.
LAND_COVER = {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2, 8: 3, 9: 3, 10: 4, 11: 5, 12: 6, 13: 7, 14: 6, 15: 8, 16: 9, 17: 10}


def patch_key(name: Column, drop: list[str]) -> Column:
    """The last two ``_`` parts of a file name without its ending and the sensor's token."""
    base = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")
    parts = F.filter(F.split(base, "_"), lambda p: ~F.lower(p).isin([d.lower() for d in drop]))
    return F.array_join(F.when(F.size(parts) > 2, F.slice(parts, -2, 2)).otherwise(parts), "_")


def majority(df: DataFrame, key: str, value: str, ignore: int = 0) -> DataFrame:
    """The most frequent value of each key but ``ignore``; ties go to the smaller."""
    counts = df.where((F.col(value) != ignore) & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    best = Window.partitionBy(key).orderBy(F.desc("_n"), value)
    return counts.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").select(key, value)


def remap(code: Column, mapping: dict[int, int] | None = None, missing: int = 0) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in (mapping or LAND_COVER).items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, code.cast("int")), F.lit(missing))


def encode_classes(df: DataFrame, name: str) -> DataFrame:
    """``class_index``: place of the name among the sorted distinct names, from 0.

    Distinct names are numbered on their own, so no task sorts all rows.
    """
    names = df.select(name).where(F.col(name).isNotNull()).distinct()
    codes = names.withColumn("class_index", F.row_number().over(Window.orderBy(name)) - 1)
    return df.join(codes, name, "left")


def paired_patches(s1: DataFrame, s2: DataFrame, cover: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Patches that both sensors have (roi, key), with the land cover of those that have one."""
    out = s1.join(s2, ["roi", "key"])
    if cover is not None:
        out = out.join(cover, ["roi", "key"], "left")
    return out.orderBy("roi", "key").limit(limit) if limit else out


def mean_logs(logs: DataFrame, map_column: str) -> DataFrame:
    """Mean of each key over all rows of maps; a key that a row lacks counts as zero there."""
    rows = logs.agg(F.count("*").alias("_n"))
    sums = logs.select(F.explode(map_column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("_s"))
    return sums.join(F.broadcast(rows)).select("key", (F.col("_s") / F.col("_n")).alias("mean"))
