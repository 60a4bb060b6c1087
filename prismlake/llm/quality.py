"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

An indicator says whether an n-gram occurs in the text, not how often. Each is scaled by the
log ratio of its smoothed counts in the two classes, the vector is brought to length one, and
a linear hinge-loss model is fitted by dual coordinate descent. N-grams are those of the bytes
(3 and 5) and those of signs that say whether a word repeats the word before it.

The fit takes at most ``sample`` labelled texts, those with the least hash of doc_id (a
documented bound: one task holds their n-grams). Only the model goes through the driver, two
arrays of ``2**bits`` floats. Scoring covers every row and every whole text.

Nulls: a null text is the empty text, which has no n-grams and so the score of the intercept;
labels that are null are not learned from; a null doc_id is never held out. Repeated rows each
get a score; a repeated label counts once, and of rows that share a doc_id one is learned from. With labels of one class only, every score is that class's share (0 or 1); with
none at all, 0.5. Columns besides doc_id and text are never read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake import runtime

BYTE_GRAMS = (3, 5)
SIGN_GRAMS = (2, 3, 8)
SAMPLE = 4000
BITS = 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall


def _hashed(grams: np.ndarray, family: int, bits: int) -> np.ndarray:
    x = (grams + np.uint64(family)) * _MULTIPLIER
    x ^= x >> np.uint64(29)
    return ((x * _MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64)


def indicators(text: str | None, bits: int = BITS, seen: np.ndarray | None = None) -> np.ndarray:
    """Places of the n-grams that occur, ascending. ``seen``: a cleared array of 2**bits flags."""
    raw = (text or "").encode()
    flags = np.zeros(1 << bits, bool) if seen is None else seen
    data = np.frombuffer(raw, np.uint8).astype(np.uint64)
    words = np.array(_WORDS(raw), object)
    same = (words[1:] == words[:-1]).astype(np.uint64) if len(words) > 1 else np.zeros(0, np.uint64)
    for family, (stream, n, width) in enumerate([*((data, n, 8) for n in BYTE_GRAMS), *((same, n, 1) for n in SIGN_GRAMS)]):
        if len(stream) < n:
            continue
        grams = np.zeros(len(stream) - n + 1, np.uint64)
        for k in range(n):
            grams |= stream[k : len(grams) + k] << np.uint64(width * k)
        flags[_hashed(grams, family + 1, bits)] = True
    found = np.flatnonzero(flags)
    if seen is not None:
        seen[found] = False
    return found


class Model:
    """weights: log-count ratio and fitted weight in one; ratio: for the length of a vector."""

    def __init__(self, weight: np.ndarray, ratio: np.ndarray, intercept: float, slope: float, shift: float):
        self.weight, self.square = weight.astype(np.float32), (ratio**2).astype(np.float32)
        self.intercept, self.slope, self.shift = intercept, slope, shift

    @staticmethod
    def stored(weight: bytes, square: bytes, intercept: float, slope: float, shift: float) -> "Model":
        """The model whose arrays have these bytes."""
        m = Model(np.frombuffer(weight, np.float32), np.zeros(0), intercept, slope, shift)
        m.square = np.frombuffer(square, np.float32)
        return m

    def margin(self, places: np.ndarray) -> float:
        length = float(np.sqrt(self.square[places].sum(dtype=np.float64)))
        return self.intercept + (float(self.weight[places].sum(dtype=np.float64)) / length if length else 0.0)

    def score(self, places: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(places) + self.shift, -500, 500))))


def log_count_ratio(rows: list[np.ndarray], good: np.ndarray, size: int) -> np.ndarray:
    up, down = np.ones(size), np.ones(size)
    for places, g in zip(rows, good):
        (up if g else down)[places] += 1
    return np.log(up / up.sum()) - np.log(down / down.sum())


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, length: np.ndarray, sign: np.ndarray, cost: float = 1.0, passes: int = 10, seed: int = 0) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss; one dual variable in [0, cost] a row.

    Row i has the values ``scale[rows[i]] / length[i]``, so length one, and a constant feature of
    one for the intercept: the curvature of each is two.
    """
    w, intercept, dual = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            values = scale[rows[i]] / length[i]
            gradient = sign[i] * (w[rows[i]] @ values + intercept) - 1
            new = min(max(dual[i] - gradient / 2, 0.0), cost)
            step = (new - dual[i]) * sign[i]
            if step:
                w[rows[i]] += step * values
                intercept += step
                dual[i] = new
    return w, intercept


def _calibrate(margin: np.ndarray, good: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-back margins, by Newton steps with
    targets drawn in from 0 and 1 by the class counts."""
    n1, n0 = good.sum(), len(good) - good.sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    beta, x = np.array([1.0, 0.0]), np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p) - 1e-3 * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(rows: list[np.ndarray], labels: list[int], bits: int = BITS) -> Model:
    """Fit on four fifths, calibrate on the fifth held back, then fit on all."""
    size, good = 1 << bits, np.array(labels, int) > 0
    if len(rows) < 10 or good.all() or not good.any():
        share = float(good.mean()) if len(rows) else 0.5
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.clip(np.log(max(share, 1e-300)) - np.log(max(1 - share, 1e-300)), -500, 500)))

    def train(index: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        ratio = log_count_ratio([rows[i] for i in index], good[index], size)
        length = np.array([np.linalg.norm(ratio[rows[i]]) or 1.0 for i in index])
        w, intercept = dual_coordinate_descent([rows[i] for i in index], ratio, length, np.where(good[index], 1.0, -1.0))
        return w * ratio, ratio, intercept

    back = np.arange(len(rows)) % 5 == 0
    if good[back].any() and not good[back].all() and good[~back].any() and not good[~back].all():
        weight, ratio, intercept = train(np.flatnonzero(~back))
        part = Model(weight, ratio, intercept, 1.0, 0.0)
        slope, shift = _calibrate(np.array([part.margin(rows[i]) for i in np.flatnonzero(back)]), good[back])
    else:
        slope, shift = 4.0, 0.0
    weight, ratio, intercept = train(np.arange(len(rows)))
    return Model(weight, ratio, intercept, slope, shift)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of doc_ids that labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, bits: int = BITS) -> Model:
    """A model from at most ``sample`` labelled rows outside the held-out fold."""
    runtime.bounded_arrow_batches(docs.sparkSession)
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    # the least hashes: an even sample that no order of the rows changes
    some = known.select("doc_id", F.col(target).cast("int").alias("y")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)

    def features(batches):
        for batch in batches:
            rows = [indicators(t, bits).astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "y": batch.column(1), "places": pa.array(rows, pa.list_(pa.int32()))})

    # ``sample`` rows of two numbers: broadcast. One text for each, however many rows have the id
    met = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = met.selectExpr("cast(doc_id as long) doc_id", "y", "text")

    def fitted(batches):
        rows, good = [], []
        for batch in batches:
            places = batch.column(2)
            ends = np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False))
            rows += np.split(places.flatten().to_numpy(), ends[:-1]) if len(places) else []
            good += batch.column(1).to_pylist()
        m = fit(rows, good, bits)
        yield pa.RecordBatch.from_pydict({"weight": [m.weight.tobytes()], "square": [m.square.tobytes()], "intercept": [m.intercept], "slope": [m.slope], "shift": [m.shift]})

    # one task fits: the rows, bounded in number, never reach the driver, only the model does
    rows = texts.mapInArrow(features, "doc_id long, y int, places array<int>").repartition(1).sortWithinPartitions("doc_id", "y")
    got = rows.mapInArrow(fitted, "weight binary, square binary, intercept double, slope double, shift double").collect()
    return Model.stored(**got[0].asDict()) if got else fit([], [], bits)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        bits = len(m.weight).bit_length() - 1
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            values = np.array([m.score(indicators(t, bits, seen)) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(2), "score": pa.array(values, pa.float64()), "predicted": pa.array((values >= threshold).astype(np.int32))})

    runtime.bounded_arrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, sample=sample), threshold)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, all columns as they were."""
    runtime.bounded_arrow_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        m = shared.value
        bits = len(m.weight).bit_length() - 1
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            yield batch.filter(pa.array([m.score(indicators(t, bits, seen)) >= threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return runtime.map_in_arrow(docs, run, docs.schema)
