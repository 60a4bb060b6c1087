"""Retrieval metrics over ranked hits, as one aggregation for every cut-off at once.

Input ``judged``: one row per hit with query_id, rank (from 1) and relevant (boolean), and
``queries``: one row per query with query_id and total_relevant. Queries without hits count
as zeros. Precision divides by k even where a list is shorter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.functions.vectors import log2

MODES = ("raw", "capped")
#: A bound on cut-offs, so that the ideal gain is a short sequence.
MAX_K = 10_000


def check_k(k: int) -> int:
    if k <= 0:
        raise ValueError(f"k must be positive, not {k}")
    if k > MAX_K:
        raise ValueError(f"k is limited to {MAX_K}")
    return k


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode is raw or capped, not {mode!r}")
    return mode


def judge(hits: DataFrame, query_labels: DataFrame | None = None, relevant: str | None = None) -> DataFrame:
    """Hits with ``relevant``: either labels are equal (of a label >= 0) or a column says so."""
    if (query_labels is None) == (relevant is None):
        raise ValueError("give query labels or a relevance column, and not both")
    if relevant is not None:
        return hits.withColumn("relevant", F.coalesce(F.col(relevant).cast("boolean"), F.lit(False)))
    labels = query_labels.select("query_id", F.col("label").alias("query_label"))
    same = (F.col("label") == F.col("query_label")) & (F.col("query_label") >= 0)
    return hits.join(labels, "query_id").withColumn("relevant", F.coalesce(same, F.lit(False)))


def _ideal(k: Column | int, total: Column) -> Column:
    """DCG of ``min(k, total)`` relevant items at the top."""
    n = F.least(F.lit(k), total.cast("int"))
    gains = F.transform(F.sequence(F.lit(1), n), lambda i: 1 / log2(i.cast("double") + 1))
    return F.when(n <= 0, 0.0).otherwise(F.aggregate(gains, F.lit(0.0), lambda a, x: a + x))


def per_query(judged: DataFrame, queries: DataFrame, ks: list[int], mode: str = "raw", keys: list[str] | None = None, ap_k: int | None = None) -> DataFrame:
    """Metrics of each query: p_at, recall_at, f1_at, ndcg_at for each k, ap and rr.

    ``keys``: query_id and what else makes up a ranked list. ap and rr look at the first
    ``ap_k`` hits (all, if None), and ap divides by all relevant items.
    """
    for k in ks:
        check_k(k)
    check_mode(mode)
    keys = keys or ["query_id"]
    rel = F.col("relevant").cast("double")
    seen = F.sum(rel).over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = judged.withColumn("_hit", rel).withColumn("_at", F.when(F.col("relevant"), seen / F.col("rank")).otherwise(0.0))
    inside = F.lit(True) if ap_k is None else F.col("rank") <= check_k(ap_k)
    aggs = [F.sum(F.when(F.col("rank") <= k, F.col("_hit")).otherwise(0.0)).alias(f"_r{k}") for k in ks]
    aggs += [F.sum(F.when(F.col("rank") <= k, F.col("_hit") / log2(F.col("rank").cast("double") + 1)).otherwise(0.0)).alias(f"_d{k}") for k in ks]
    aggs += [F.sum(F.when(inside, F.col("_at")).otherwise(0.0)).alias("_ap"), F.min(F.when(F.col("relevant") & inside, F.col("rank"))).alias("_first"), F.sum("_hit").alias("_all")]
    zero = [f"_r{k}" for k in ks] + [f"_d{k}" for k in ks] + ["_ap", "_all"]
    out = queries.join(rows.groupBy(*keys).agg(*aggs), keys, "left").na.fill(0.0, zero)
    total = F.coalesce(F.col("total_relevant").cast("double"), F.lit(0.0))
    columns = [F.col(c) for c in queries.columns]
    for k in ks:
        r = F.col(f"_r{k}")
        reach = F.least(F.lit(float(k)), total) if mode == "capped" else total
        ideal = _ideal(k, F.when(total > 0, total).otherwise(F.col("_all")))
        columns += [
            (r / k).alias(f"p_at_{k}"),
            F.when(reach == 0, 0.0).otherwise(r / reach).alias(f"recall_at_{k}"),
            F.when((reach == 0) | (r == 0), 0.0).otherwise(2 * r / (k + reach)).alias(f"f1_at_{k}"),
            F.when(ideal == 0, 0.0).otherwise(F.col(f"_d{k}") / ideal).alias(f"ndcg_at_{k}"),
        ]
    columns += [F.when(total == 0, 0.0).otherwise(F.col("_ap") / total).alias("ap"), F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("rr")]
    return out.select(*columns)


def graded_ndcg(gains: DataFrame, k: int) -> DataFrame:
    """nDCG of graded gains (query_id, rank from 1, gain); the ideal sorts the list's own gains."""
    check_k(k)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "rank"))
    rows = gains.withColumn("_best", best)
    dcg = F.sum(F.when(F.col("rank") <= k, F.col("gain") / log2(F.col("rank").cast("double") + 1)).otherwise(0.0))
    ideal = F.sum(F.when(F.col("_best") <= k, F.col("gain") / log2(F.col("_best").cast("double") + 1)).otherwise(0.0))
    return rows.groupBy("query_id").agg(dcg.alias("_d"), ideal.alias("_i")).select("query_id", F.when(F.col("_i") == 0, 0.0).otherwise(F.col("_d") / F.col("_i")).alias(f"ndcg_at_{k}"))


def means(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro means of every metric column; no rows: zeros and n_queries 0 (if ungrouped)."""
    names = [c for c in metrics.columns if c.startswith(("p_at_", "recall_at_", "f1_at_", "ndcg_at_")) or c in ("ap", "rr")]
    aggs = [F.count("*").alias("n_queries"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in names]]
    return (metrics.groupBy(*by) if by else metrics.groupBy()).agg(*aggs)
