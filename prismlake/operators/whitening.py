"""Removing the gap between modalities: centring and whitening.

The covariance needs one pass: every partition adds up (n, sum x, sum x x') of each modality and
only these d x d sums leave it. They are merged and decomposed on the driver; the model is a few
matrices, broadcast by the closure that applies it.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions.vectors import l2_normalize


def centre_by_modality(df: DataFrame, normalize: bool = True) -> DataFrame:
    """``embedding`` minus the mean of its modality."""
    long = df.select("modality", F.posexplode("embedding").alias("pos", "x"))
    means = long.groupBy("modality", "pos").agg(F.avg("x").alias("m"))
    vectors = means.groupBy("modality").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("_mean"))
    out = df.join(F.broadcast(vectors), "modality").withColumn("embedding", F.zip_with("embedding", "_mean", lambda x, m: x - m)).drop("_mean")
    return out.withColumn("embedding", l2_normalize("embedding")) if normalize else out


MERGERS = 16


class Whitener:
    """mean and matrix of each modality; a modality that was not seen is centred only."""

    def __init__(self, mean: dict[str, np.ndarray], matrix: dict[str, np.ndarray], global_mean: np.ndarray, by_modality: bool = True):
        self.mean, self.matrix, self.global_mean, self.by_modality = mean, matrix, global_mean, by_modality

    def apply(self, x: np.ndarray, modality: str) -> np.ndarray:
        key = modality if self.by_modality else ""
        y = (x - self.mean[key]) @ self.matrix[key].T if key in self.matrix else x - self.global_mean
        return y / np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-12)

    def to_json(self) -> str:
        return json.dumps({"mean": {k: v.tolist() for k, v in self.mean.items()}, "matrix": {k: v.tolist() for k, v in self.matrix.items()}, "global_mean": self.global_mean.tolist(), "by_modality": self.by_modality})

    @staticmethod
    def from_json(text: str) -> "Whitener":
        d = json.loads(text)
        return Whitener({k: np.array(v) for k, v in d["mean"].items()}, {k: np.array(v) for k, v in d["matrix"].items()}, np.array(d["global_mean"]), d["by_modality"])


def moments(df: DataFrame, by_modality: bool = True) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """(n, sum, sum of outer products) of each modality, centred on nothing."""

    def add(batches):
        sums: dict[str, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            names = np.array(batch.column(0).to_pylist(), object)
            for m in set(names.tolist()):
                part = x[names == m]
                s = sums.setdefault(m, [0, np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)])
                s[0] += len(part)
                s[1] += part.sum(0)
                s[2] += part.T @ part
        yield from rows_of(sums)

    def merge(batches):
        sums: dict[str, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                s = sums.setdefault(r["modality"], [0, 0.0, 0.0])
                s[0], s[1], s[2] = s[0] + r["n"], s[1] + np.array(r["s1"]), s[2] + np.array(r["s2"])
        yield from rows_of(sums)

    def rows_of(sums):
        for m, (n, s1, s2) in sums.items():
            yield pa.RecordBatch.from_pydict({"modality": [m], "n": pa.array([n], pa.int64()), "s1": [s1.tolist()], "s2": [s2.ravel().tolist()]})

    schema = "modality string, n long, s1 array<double>, s2 array<double>"
    rows = df.where("embedding is not null").select(F.coalesce("modality", F.lit("")) if by_modality else F.lit(""), F.col("embedding").cast("array<double>"))
    # merged on executors first: what is collected is one row per modality and merging task
    parts = rows.mapInArrow(add, schema).repartition(MERGERS).mapInArrow(merge, schema)
    out: dict[str, tuple[int, np.ndarray, np.ndarray]] = {}
    for r in parts.toLocalIterator():
        n, s1, s2 = out.get(r["modality"], (0, 0.0, 0.0))
        out[r["modality"]] = (n + r["n"], s1 + np.array(r["s1"]), s2 + np.array(r["s2"]).reshape(len(r["s1"]), -1))
    return out


def whitening_matrix(n: int, s1: np.ndarray, s2: np.ndarray, n_components: int | None = None, remove_top: int = 0, shrinkage: float = 0.0, eps: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Mean and matrix of one cloud.

    The symmetric form keeps all modalities in one frame; dropping leading or trailing
    components gives the rectangular form in a frame of the modality's own. Directions that
    fewer points than dimensions leave undetermined map to zero.
    """
    d = len(s1)
    mean = s1 / max(n, 1)
    if n < 2:
        return mean, np.eye(d)
    value, vector = np.linalg.eigh((s2 - n * np.outer(mean, mean)) / (n - 1))
    value, vector = np.maximum(value[::-1], 0.0), vector[:, ::-1].T
    if n <= d:  # the rank is n - 1 at most
        value[n - 1 :], vector[min(n, d) :] = 0.0, 0.0
    if shrinkage > 0:
        a = min(shrinkage, 1.0)
        value = (1 - a) * value + a * value.mean()
    if remove_top >= d:
        raise ValueError(f"remove_top={remove_top} leaves nothing of {d} components")
    first = max(0, remove_top)
    last = d if n_components is None else min(d, first + n_components)
    scale = 1 / np.sqrt(value[first:last] + eps)
    kept = vector[first:last]
    return mean, (kept.T * scale) @ kept if (first, last) == (0, d) else kept * scale[:, None]


def fit(df: DataFrame, by_modality: bool = True, **options) -> Whitener:
    """A whitener of ``df(modality, embedding)``; options are those of ``whitening_matrix``."""
    found = moments(df, by_modality)
    if not found:
        raise ValueError("no vectors to fit on")
    fitted = {m: whitening_matrix(*s, **options) for m, s in found.items()}
    total = sum(s[0] for s in found.values())
    return Whitener({m: f[0] for m, f in fitted.items()}, {m: f[1] for m, f in fitted.items()}, sum(s[1] for s in found.values()) / total, by_modality)


def transform(df: DataFrame, model: Whitener) -> DataFrame:
    """``df`` with its embeddings whitened and of unit length; null embeddings stay null."""
    names = df.columns
    at, mod = names.index("embedding"), names.index("modality")

    def run(batches):
        for batch in batches:
            kinds = batch.column(mod).to_pylist()
            out: list = [None] * batch.num_rows
            rows = batch.column(at)
            valid = np.flatnonzero(rows.is_valid().to_numpy(zero_copy_only=False))
            if len(valid):
                x = rows.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(valid), -1)
                for m in {kinds[i] for i in valid}:
                    on = [k for k, i in enumerate(valid) if kinds[i] == m]
                    for k, y in zip(on, model.apply(x[on], m or "").tolist()):
                        out[valid[k]] = y
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'embedding' else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, schema)


def fit_transform(df: DataFrame, **options) -> DataFrame:
    return transform(df, fit(df, **options))
