"""Losses over batches of embeddings, as joins and aggregates, and as numpy functions.

Rows with a column ``batch`` are many batches at once, and the result has one loss for each
(``batch``, ``loss``); without it they are one batch and the result is one row (``loss``). A
batch is small (hundreds of rows) and its pairs are the point, so one of more than
``MAX_BATCH`` rows is an error. Pairs meet by batch; batches never meet each other.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.functions.vectors import cosine, let

MAX_BATCH = 4096


def _batched(df: DataFrame) -> DataFrame:
    return df if "batch" in df.columns else df.withColumn("batch", F.lit(0))


def _bounded(*sides: DataFrame) -> None:
    for side in sides:
        if side.groupBy("batch").count().where(F.col("count") > MAX_BATCH).limit(1).count():
            raise ValueError(f"a batch has {MAX_BATCH} rows at most")


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of rows of one batch with their cosine ``s``."""
    _bounded(a, b)
    named = lambda side, df: df.select("batch", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != "batch"])
    return named("a", a).join(named("b", b), "batch").withColumn("s", cosine("a_embedding", "b_embedding"))


def _log_sum_exp(values: Column) -> Column:
    """Of an array; the greatest is taken out, so that nothing overflows."""
    return let(values, lambda z: let(F.array_max(z), lambda m: m + F.log(F.aggregate(z, F.lit(0.0), lambda e, x: e + F.exp(x - m)))))


def _mean(rows: DataFrame, loss: Column, of: DataFrame) -> DataFrame:
    """The mean for each batch, 0 for a batch without a row in it."""
    out = rows.groupBy("batch").agg(F.avg(loss).alias("loss"))
    if "batch" not in of.columns:
        return out.agg(F.coalesce(F.max("loss"), F.lit(0.0)).alias("loss"))
    return of.select("batch").distinct().join(out, "batch", "left").select("batch", F.coalesce("loss", F.lit(0.0)).alias("loss"))


def _cross_entropy(z: DataFrame, key: str) -> DataFrame:
    """For each ``key``: log-sum-exp of its row of ``z`` less the entry of its own partner."""
    own = F.sum(F.when(F.col("a_row") == F.col("b_row"), F.col("z")))
    return z.groupBy("batch", key).agg(_log_sum_exp(F.collect_list("z")).alias("e"), own.alias("p")).select("batch", (F.col("e") - F.col("p")).alias("loss"))


def symmetric_infonce(a: DataFrame, b: DataFrame, temperature: float = 0.07) -> DataFrame:
    """Row i of ``a`` belongs to row i of ``b`` (column ``row``): mean of both cross entropies."""
    z = _pairs(*(_batched(x).select("batch", "row", "embedding") for x in (a, b))).withColumn("z", F.col("s") / temperature)
    sides = [_cross_entropy(z, key).groupBy("batch").agg(F.avg("loss").alias(key)) for key in ("a_row", "b_row")]
    return _mean(sides[0].join(sides[1], "batch"), (F.col("a_row") + F.col("b_row")) / 2, a)


def info_nce(a: DataFrame, b: DataFrame, negatives: DataFrame | None = None, temperature: float = 0.07) -> DataFrame:
    """One direction; negatives are the other rows of ``b`` or a bank of the batch."""
    left = _batched(a).select("batch", "row", "embedding")
    z = _pairs(left, _batched(b).select("batch", "row", "embedding")).withColumn("z", F.col("s") / temperature)
    if negatives is None:
        return _mean(_cross_entropy(z, "a_row"), F.col("loss"), a)
    own = z.where("a_row = b_row").select("batch", "a_row", F.col("z").alias("p"))
    bank = _pairs(left, _batched(negatives).select("batch", "embedding")).groupBy("batch", "a_row").agg(F.collect_list(F.col("s") / temperature).alias("others"))
    rows = own.join(bank, ["batch", "a_row"]).withColumn("e", _log_sum_exp(F.array_append("others", F.col("p"))))
    return _mean(rows, F.col("e") - F.col("p"), a)


def batch_hard_triplet(batch: DataFrame, margin: float = 0.1, cross_modal: bool = True) -> DataFrame:
    """Farthest positive and nearest negative of each anchor, of another modality if there are any."""
    rows = _batched(batch).select("batch", "row", "embedding", "label", "modality")
    d = _pairs(rows, rows).withColumn("d", 1 - F.col("s"))
    pos, neg = (F.col("a_label") == F.col("b_label")) & (F.col("a_row") != F.col("b_row")), F.col("a_label") != F.col("b_label")
    far = (F.col("a_modality") != F.col("b_modality")) if cross_modal else F.lit(False)
    anchors = d.groupBy("batch", "a_row").agg(
        F.coalesce(F.max(F.when(pos & far, F.col("d"))), F.max(F.when(pos, F.col("d")))).alias("p"),
        F.coalesce(F.min(F.when(neg & far, F.col("d"))), F.min(F.when(neg, F.col("d")))).alias("n"),
    )
    return _mean(anchors.where("p is not null and n is not null"), F.greatest(F.col("p") - F.col("n") + margin, F.lit(0.0)), batch)


def multi_similarity(batch: DataFrame, alpha: float = 2.0, beta: float = 50.0, base: float = 0.5, slack: float = 0.1) -> DataFrame:
    """Pairs that are hard against the other kind's extreme, weighted by log-sum-exp."""
    rows = _batched(batch).select("batch", "row", "embedding", "label")
    s = _pairs(rows, rows).where("a_row != b_row")
    same = F.col("a_label") == F.col("b_label")
    edge = s.groupBy("batch", "a_row").agg(F.max(F.when(~same, F.col("s"))).alias("hi_neg"), F.min(F.when(same, F.col("s"))).alias("lo_pos")).where("hi_neg is not null and lo_pos is not null")
    hard = s.join(edge, ["batch", "a_row"])
    pos = F.collect_list(F.when(same & (F.col("s") - slack < F.col("hi_neg")), -alpha * (F.col("s") - base)))
    neg = F.collect_list(F.when(~same & (F.col("s") + slack > F.col("lo_pos")), beta * (F.col("s") - base)))
    anchors = hard.groupBy("batch", "a_row").agg(pos.alias("pos"), neg.alias("neg")).where(F.size("pos") * F.size("neg") > 0)
    one = lambda name: _log_sum_exp(F.array_append(name, F.lit(0.0)))
    return _mean(anchors, one("pos") / alpha + one("neg") / beta, batch)


def sub_center_arcface(batch: DataFrame, prototypes: DataFrame, scale: float = 64.0, margin: float = 0.5) -> DataFrame:
    """Cross entropy over classes of the cosine to the nearest of a class's ``prototypes(label,
    embedding)``, with an angular margin on the row's own class.

    Where the margin would turn the cosine round, a linear penalty stands in. Prototypes are a
    model and as bounded as a batch.
    """
    rows = _batched(batch).select("batch", "row", "embedding", "label")
    _bounded(rows, prototypes.withColumn("batch", F.lit(0)))
    shared = F.broadcast(prototypes.select(F.col("label").alias("c"), F.col("embedding").alias("w")))
    cos = rows.join(shared).groupBy("batch", "row", "label", "c").agg(F.max(cosine("embedding", "w")).alias("cos"))
    cos = cos.withColumn("cos", F.greatest(F.least("cos", F.lit(1.0)), F.lit(-1.0)))
    turned = F.when(F.col("cos") > math.cos(math.pi - margin), F.cos(F.acos("cos") + margin)).otherwise(F.col("cos") - math.sin(math.pi - margin) * margin)
    logits = cos.select("batch", "row", (F.col("label") == F.col("c")).alias("own"), F.when(F.col("label") == F.col("c"), turned).otherwise(F.col("cos")).alias("z")).withColumn("z", scale * F.col("z"))
    of = logits.groupBy("batch", "row").agg(_log_sum_exp(F.collect_list("z")).alias("e"), F.max(F.when(F.col("own"), F.col("z"))).alias("p"))
    return _mean(of.where("p is not null"), F.col("e") - F.col("p"), batch)


def smooth_average_precision(batch: DataFrame, temperature: float = 0.01) -> DataFrame:
    """1 - mean average precision, ranks made smooth by a sigmoid; as ``smooth_ap``."""
    rows = _batched(batch).select("batch", "row", "embedding", "label")
    s = _pairs(rows, rows)
    seen = s.groupBy("batch", "a_row").agg(F.collect_list(F.struct("s", ((F.col("a_label") == F.col("b_label")) & (F.col("a_row") != F.col("b_row"))).alias("pos"))).alias("all"))
    ahead = lambda i, j: 1 / (1 + F.exp(-(j["s"] - i["s"]) / temperature))

    def share(all_: Column, i: Column) -> Column:
        # the row itself stands for the one that a rank begins with, but counts half a place as its own sigmoid
        start = F.struct(F.lit(0.5).alias("pos"), F.lit(0.5).alias("all"))
        ranks = F.aggregate(all_, start, lambda r, j: F.struct((r["pos"] + F.when(j["pos"], ahead(i, j)).otherwise(0.0)).alias("pos"), (r["all"] + ahead(i, j)).alias("all")))
        return let(ranks, lambda r: r["pos"] / r["all"])

    positive = F.filter("all", lambda x: x["pos"])
    ap = F.aggregate(F.transform(positive, lambda i: share(F.col("all"), i)), F.lit(0.0), lambda a, x: a + x) / F.size(positive)
    return _mean(seen.where(F.exists("all", lambda x: x["pos"])).withColumn("ap", ap), 1 - F.col("ap"), batch)


# numpy forms, for training and for tests ----------------------------------------------------


def np_unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def arcface(z: np.ndarray, labels: np.ndarray, prototypes: np.ndarray, scale: float = 64.0, margin: float = 0.5) -> float:
    """Additive angular margin over the nearest of several prototypes (classes, k, d) per class.

    Beyond the angle where the margin would turn the cosine round, a linear penalty stands in.
    """
    cos = np.clip((np_unit(z) @ np_unit(prototypes.reshape(-1, z.shape[1])).T).reshape(len(z), prototypes.shape[0], -1).max(2), -1, 1)
    own = cos[np.arange(len(z)), labels]
    turned = np.where(own > np.cos(np.pi - margin), np.cos(np.arccos(own) + margin), own - np.sin(np.pi - margin) * margin)
    logits = cos.copy()
    logits[np.arange(len(z)), labels] = turned
    return float(-log_softmax(scale * logits)[np.arange(len(z)), labels].mean())


def smooth_ap(z: np.ndarray, labels: np.ndarray, temperature: float = 0.01) -> float:
    """1 - mean average precision with ranks made smooth by a sigmoid.

    The anchor itself counts among the rows that a positive's rank may stand behind. A square
    matrix is one of similarities; any other holds embeddings.
    """
    s = z if z.shape[0] == z.shape[1] else np_unit(z) @ np_unit(z).T
    out = []
    for i in range(len(s)):
        pos = (labels == labels[i]) & (np.arange(len(s)) != i)
        if not pos.any():
            continue
        # ahead[j, k]: how far k stands before j for anchor i
        ahead = 1 / (1 + np.exp(np.clip(-(s[i][None, :] - s[i][:, None]) / temperature, -500, 500)))
        np.fill_diagonal(ahead, 0)
        rank_all = 1 + ahead.sum(1)
        rank_pos = 1 + ahead[:, pos].sum(1)
        out.append((rank_pos / rank_all)[pos].mean())
    return float(1 - np.mean(out)) if out else 0.0


def np_infonce(a: np.ndarray, b: np.ndarray, temperature: float = 0.07) -> float:
    z = np_unit(a) @ np_unit(b).T / temperature
    return float(-(np.diag(log_softmax(z)).mean() + np.diag(log_softmax(z.T)).mean()) / 2)


def combined(infonce: float | None, triplet: float, ap: float, weights: tuple[float, float, float] = (1.5, 1.0, 0.5)) -> float:
    """Weighted sum; the contrastive part is left out where a batch has no pairs."""
    return (0.0 if infonce is None else weights[0] * infonce) + weights[1] * triplet + weights[2] * ap
