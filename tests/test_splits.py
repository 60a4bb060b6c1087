"""Splits, subsets, pairs, sampling and the relational helpers."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from prismlake.operators import splits, tables
from prismlake.sources.samples import MODALITIES, band_table, check_modality, modality_table, normalization


def frame(spark, classes=4, per=12, kinds=("optical_rgb", "sar")):
    rows = [(i, str(i), kinds[i % len(kinds)], i % classes, str(i // 2)) for i in range(classes * per)]
    return spark.createDataFrame(rows, "gallery_index long, id string, modality string, label int, location_id string")


def test_stratified_and_balanced(spark):
    df = frame(spark).where("not (label = 0 and gallery_index > 30)")
    out = splits.query_gallery_split(df, 0.25, balanced=True, seed=3)
    parts = Counter((r["label"], r["part"]) for r in out.collect())
    sizes = Counter(r["label"] for r in df.collect())
    gallery = min(n - max(1, round(n * 0.25)) for n in sizes.values())
    for label, n in sizes.items():
        assert parts[(label, "query")] == max(1, round(n * 0.25))
        assert parts[(label, "gallery")] == gallery
    assert out.select("id").distinct().count() == out.count()
    again = splits.query_gallery_split(df.repartition(7), 0.25, balanced=True, seed=3)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in out.collect()}
    other = splits.query_gallery_split(df, 0.25, balanced=True, seed=4)
    assert {tuple(r) for r in other.collect()} != {tuple(r) for r in out.collect()}


def test_exact_counts(spark):
    out = splits.exact_count_split(frame(spark), gallery=5, queries=3)
    parts = Counter((r["label"], r["part"]) for r in out.collect())
    assert all(parts[(c, "gallery")] == 5 and parts[(c, "query")] == 3 for c in range(4))
    tiny = splits.exact_count_split(frame(spark, 1, 4), gallery=9, queries=3)
    assert Counter(r["part"] for r in tiny.collect()) == {"gallery": 3, "query": 1}


def test_subset_keeps_all_classes(spark):
    out = splits.balanced_subset(frame(spark, 5, 20), 30)
    assert out.count() == 30 and out.select("label").distinct().count() == 5


def test_pairs(spark):
    df = frame(spark)
    assert splits.cross_modal_pairs(df, "optical_rgb", "sar").count() == 24
    used = [i for r in splits.disjoint_pairs(df).collect() for i in (r["a_index"], r["b_index"])]
    assert len(used) == len(set(used)) == 48
    rows = [(0, "multispectral", "a"), (1, "multispectral", "a"), (2, "optical_rgb", "a"), *[(10 + i, m, "b") for i, m in enumerate("xxyzzzzy")], (30, "sar", "c"), (31, None, "c"), (32, "dem", None)]
    pairs = splits.disjoint_pairs(spark.createDataFrame(rows, "gallery_index long, modality string, location_id string"))
    kinds = {i: m for i, m, _ in rows}
    got = sorted((r["location_id"], r["a_index"], r["b_index"]) for r in pairs.collect())
    # b in order: x 10 11, y 12 17, z 13 14 15 16; the x take the y, then the z wait for nobody
    assert got == [("a", 0, 2), ("b", 10, 12), ("b", 11, 17)] and all(kinds[a] != kinds[b] for _, a, b in got)
    no_place = df.withColumn("location_id", F.lit(None).cast("string"))
    assert splits.cross_modal_pairs(no_place, "optical_rgb", "sar").count() == 0 and splits.disjoint_pairs(no_place).count() == 0
    assert splits.by_location(df).count() == 24
    assert splits.pooled_gallery(df, df.limit(5)).count() == 43


def test_pk_batches(spark):
    df = frame(spark, 6, 12, ("optical_rgb", "sar", "multispectral"))
    out = splits.pk_batches(df, p=3, k=4, batches=5, seed=1)
    rows = out.collect()
    assert len(rows) == 5 * 3 * 4
    for batch in range(5):
        mine = [r for r in rows if r["batch"] == batch]
        assert len({r["label"] for r in mine}) == 3
        for label in {r["label"] for r in mine}:
            kinds = Counter(r["modality"] for r in mine if r["label"] == label)
            assert sum(kinds.values()) == 4 and max(kinds.values()) - min(kinds.values()) <= 1
    assert {tuple(r) for r in splits.pk_batches(df.repartition(5), p=3, k=4, batches=5, seed=1).collect()} == {tuple(r) for r in rows}
    few = splits.pk_batches(df.where("gallery_index < 12"), p=3, k=9, batches=1)
    assert few.count() == 3 * 9 or few.groupBy("label").count().where("count = 9").count() > 0


def test_tables(spark):
    name = spark.createDataFrame([("a/b/ROIs1_s1_12_p30.tif",), ("s1_x.tif",)], "p string")
    assert [r[0] for r in name.select(tables.patch_key(F.col("p"), ["s1"])).collect()] == ["12_p30", "x"]
    votes = spark.createDataFrame([("a", 0), ("a", 0), ("a", 3), ("a", 2), ("b", 0), ("c", 5), ("c", 5), ("c", 4)], "k string, v int")
    assert {tuple(r) for r in tables.majority(votes, "k", "v").collect()} == {("a", 2), ("c", 5)}
    codes = tables.encode_classes(spark.createDataFrame([("z",), ("b",), (None,), ("b",)], "c string"), "c")
    assert {(r["c"], r["class_index"]) for r in codes.collect()} == {("z", 1), ("b", 0), (None, None)}
    logs = spark.createDataFrame([({"a": 1.0},), ({"a": 3.0, "b": 4.0},)], "m map<string,double>")
    assert {tuple(r) for r in tables.mean_logs(logs, "m").collect()} == {("a", 2.0), ("b", 2.0)}


def test_dimensions(spark):
    assert modality_table(spark).count() == len(MODALITIES) and band_table(spark).count() == 19
    assert normalization("sar", 2)[0] == [-11.5, -18.0] and normalization("sar", 3) == ([0.0] * 3, [1.0] * 3)
    assert check_modality("SAR") == "sar"
    with pytest.raises(ValueError):
        check_modality("xray")
