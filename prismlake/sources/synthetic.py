"""Synthetic samples: images rendered from shared layouts, and embeddings with a modality gap.

Rows are made by the tasks that hold them; every row's generator is seeded from its key, so the
data don't depend on partitioning or process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.functions.images import IMAGE, to_row
from prismlake.runtime import ship
from prismlake.sources.samples import MODALITIES

SENSORS = ["optical_rgb", "multispectral", "sar"]


def _keys(spark: SparkSession, classes: int, per_class: int, modalities: list[str]) -> DataFrame:
    ship(spark)
    names = F.explode(F.array(*[F.lit(m) for m in modalities]))
    rows = spark.range(classes * per_class).select((F.col("id") % classes).cast("int").alias("label"), F.col("id").alias("place"), names.alias("modality"))
    index = F.col("place") * len(modalities) + F.array_position(F.array(*[F.lit(m) for m in modalities]), F.col("modality")) - 1
    return rows.select(index.cast("long").alias("gallery_index"), F.concat_ws("-", "modality", "place").alias("id"), "modality", "label", F.col("place").cast("string").alias("location_id"))


def _layout(label: int, place: int, size: int, seed: int, bases: int, jitter: float) -> np.ndarray:
    """(bases, size, size): soft shapes that the class fixes and the place moves a little."""
    of_class, of_place = np.random.default_rng([seed, 1, label]), np.random.default_rng([seed, 2, label, place])
    yy, xx = np.mgrid[:size, :size] / max(size - 1, 1)
    out = []
    for _ in range(bases):
        cy, cx, ry, rx, f = of_class.uniform([0.1, 0.1, 0.1, 0.1, 1], [0.9, 0.9, 0.4, 0.4, 6])
        dy, dx = of_place.normal(0, jitter * 0.2, 2)
        bump = np.exp(-(((yy - cy - dy) / ry) ** 2) - ((xx - cx - dx) / rx) ** 2)
        out.append(bump * (1 + 0.3 * np.sin(2 * np.pi * f * (xx + yy))))
    return np.array(out)


def render(modality: str, label: int, place: int, size: int, seed: int, bases: int = 9, jitter: float = 0.25) -> np.ndarray:
    """One sensor's view of a place: its own mixture of the shared layout, and its own noise."""
    channels = MODALITIES[modality] or 8
    kind = list(MODALITIES).index(modality)
    mixture = np.random.default_rng([seed, 3, kind]).uniform(0, 1, (channels, bases))
    noise = np.random.default_rng([seed, 4, kind, label, place])
    x = np.tensordot(mixture / bases, _layout(label, place, size, seed, bases, jitter), 1)
    if modality == "sar":
        return (10 * np.log10(np.maximum(x * noise.gamma(4, 0.25, x.shape), 1e-4)) - 5).astype(np.float32)
    return np.clip(x + noise.normal(0, 0.02, x.shape), 0, 1).astype(np.float32)


def images(spark: SparkSession, classes: int = 10, per_class: int = 20, modalities: list[str] | None = None, size: int = 64, seed: int = 0, bases: int = 9, jitter: float = 0.25) -> DataFrame:
    keys = _keys(spark, classes, per_class, modalities or SENSORS)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            made = [to_row(render(r["modality"], r["label"], int(r["location_id"]), size, seed, bases, jitter)) for r in rows]
            kind = pa.struct([("c", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.list_(pa.float32()))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], [*batch.schema.names, "image"])

    return keys.mapInArrow(run, f"gallery_index long, id string, modality string, label int, location_id string, image {IMAGE}")


def embeddings(spark: SparkSession, classes: int = 10, per_class: int = 20, modalities: list[str] | None = None, dim: int = 256, seed: int = 0, separation: float = 4.0, shift: float = 0.5, noise: float = 1.0) -> DataFrame:
    """Class prototype + modality offset + noise, at unit length."""
    keys = _keys(spark, classes, per_class, modalities or SENSORS)

    def unit(v):
        return v / np.linalg.norm(v)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                kind = list(MODALITIES).index(r["modality"])
                proto = unit(np.random.default_rng([seed, 1, r["label"]]).standard_normal(dim))
                offset = unit(np.random.default_rng([seed, 2, kind]).standard_normal(dim))
                own = np.random.default_rng([seed, 3, kind, r["gallery_index"]]).standard_normal(dim)
                out.append(unit(separation * proto + shift * np.sqrt(dim) * offset + noise * own).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "embedding"])

    return keys.mapInArrow(run, "gallery_index long, id string, modality string, label int, location_id string, embedding array<double>")
