"""Re-ranking of candidate lists and query expansion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions.vectors import DIGITS, dot, l2_normalize
from prismlake.operators.search import ranked, search

METHODS = ("none", "exact", "kreciprocal")


def exact_refine(queries: DataFrame, gallery: DataFrame, candidates: DataFrame, k: int, by_modality: bool = False) -> DataFrame:
    """The best k of ``candidates(query_id, gallery_index)`` by exact cosine; ``by_modality`` of
    each ``g_modality`` of the candidates."""
    by = ["query_id", "g_modality"] if by_modality else ["query_id"]
    pool = candidates.select(*by, "gallery_index").where("gallery_index >= 0").distinct()
    unit = l2_normalize("embedding")  # once per row, not per pair
    pairs = pool.join(queries.select("query_id", unit.alias("_q")), "query_id").join(gallery.select("gallery_index", unit.alias("_g")), "gallery_index")
    return ranked(pairs.select(*by, "gallery_index", F.round(dot("_q", "_g"), DIGITS).alias("score")), k, by).select("query_id", "gallery_index", "score", "rank", *by[1:])


def alpha_expansion(queries: DataFrame, gallery: DataFrame, hits: DataFrame, alpha: float = 3.0, top: int = 5) -> DataFrame:
    """query_id, embedding: the query plus its top hits, each weighted by its similarity to alpha.

    Similarities are cut to [0, 1]. A query without hits, or whose sum is zero, stays as it was.
    """
    unit = l2_normalize("embedding")
    q = queries.select("query_id", unit.alias("_q"))
    near = hits.where(F.col("rank") < top).join(gallery.select("gallery_index", unit.alias("_g")), "gallery_index").join(q, "query_id")
    weight = F.pow(F.least(F.greatest(dot("_q", "_g"), F.lit(0.0)), F.lit(1.0)), F.lit(float(alpha)))
    long = near.withColumn("_w", weight).select("query_id", "_w", F.posexplode("_g").alias("pos", "x")).groupBy("query_id", "pos").agg(F.sum(F.col("_w") * F.col("x")).alias("x"))
    added = long.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("_add"))
    both = q.join(added, "query_id", "left")
    total = F.zip_with("_q", "_add", lambda a, b: a + b)
    empty = F.col("_add").isNull() | ~F.exists(F.coalesce(total, F.col("_q")), lambda x: F.abs(x) > 1e-12)
    return both.select("query_id", F.when(empty, F.col("_q")).otherwise(l2_normalize(total)).alias("embedding"))


def average_expansion(queries: DataFrame, gallery: DataFrame, hits: DataFrame, top: int = 5) -> DataFrame:
    """Plain sum of the query and its top hits."""
    return alpha_expansion(queries, gallery, hits, 0.0, top)


def reciprocal_order(query: np.ndarray, pool: np.ndarray, k1: int = 20, k2: int = 6, weight: float = 0.3) -> np.ndarray:
    """Order of the pool by k-reciprocal distance to the query.

    Distance 1 - cosine among query and pool; neighbours are reciprocal if each is in the
    other's first k + 1. A set grows by the reciprocal sets (at half k1) of its members that
    overlap it by more than two thirds. Members get weights exp(-distance), averaged over the
    first k2 neighbours; the Jaccard distance of weights is mixed with the plain distance.
    """
    m = len(pool)
    if m < 2:
        return np.arange(m)
    x = np.concatenate([query[None, :], pool])
    far = 1.0 - np.clip(np.round(x @ x.T, DIGITS), -1.0, 1.0)
    near = np.argsort(far, axis=1, kind="stable")
    place = np.argsort(near, axis=1, kind="stable")  # place[i, j]: rank of j for i
    k1, k2 = min(k1, m), max(1, min(k2, m + 1))
    half = int(round(k1 / 2)) + 1

    def mutual(k: int) -> np.ndarray:
        inside = place <= k
        return inside & inside.T

    wide, tight = mutual(k1), mutual(half)
    size = tight.sum(1)
    member = wide.copy()
    for i in range(m + 1):
        own = np.flatnonzero(wide[i])
        overlap = (tight[own] & wide[i]).sum(1)
        for j in own[overlap * 3 > size[own] * 2]:
            member[i] |= tight[j]
    v = np.where(member, np.exp(-far), 0.0)
    v /= np.maximum(v.sum(1, keepdims=True), 1e-12)
    if k2 > 1:
        v = v[near[:, :k2]].mean(1)
    low = np.minimum(v[0], v[1:]).sum(1)
    high = np.maximum(v[0], v[1:]).sum(1)
    jaccard = 1.0 - low / np.maximum(high, 1e-12)
    return np.argsort(np.round((1 - weight) * jaccard + weight * far[0, 1:], 9), kind="stable")


def k_reciprocal(queries: DataFrame, gallery: DataFrame, candidates: DataFrame, k: int, k1: int = 20, k2: int = 6, weight: float = 0.3) -> DataFrame:
    """The first k of each candidate list in k-reciprocal order, with their exact cosines.

    A list is a pool of a few hundred rows, so one query is one group.
    """
    pool = candidates.select("query_id", "gallery_index", "rank").where("gallery_index >= 0").dropDuplicates(["query_id", "gallery_index"])
    unit = l2_normalize("embedding")
    rows = pool.join(queries.select("query_id", unit.alias("q")), "query_id").join(gallery.select("gallery_index", unit.alias("g")), "gallery_index")

    def order(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rank", "ascending"), ("gallery_index", "ascending")])
        g = np.array(table.column("g").to_pylist())
        q = np.array(table.column("q")[0].as_py())
        best = reciprocal_order(q, g, k1, k2, weight)[:k]
        return pa.table(
            {
                "query_id": table.column("query_id").take(pa.array(best)),
                "gallery_index": table.column("gallery_index").take(pa.array(best)),
                "score": pa.array(np.round(g[best] @ q, DIGITS)),
                "rank": pa.array(np.arange(len(best)), pa.int64()),
            }
        )

    return rows.groupBy("query_id").applyInArrow(order, "query_id long, gallery_index long, score double, rank long")


def search_with_rerank(queries: DataFrame, gallery: DataFrame, k: int, pool: int = 200, method: str = "none", **filters) -> DataFrame:
    """Search a pool of max(pool, k), then re-rank it."""
    if method not in METHODS:
        raise ValueError(f"{method!r} is none of {', '.join(METHODS)}")
    found = search(queries, gallery, max(pool, k) if method != "none" else k, **filters)
    if method == "none":
        return found
    return exact_refine(queries, gallery, found, k) if method == "exact" else k_reciprocal(queries, gallery, found, k)


def fuse(lists: list[DataFrame], constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of several hit lists (rank from 0): an extension."""
    votes = lists[0].select("query_id", "gallery_index", "rank")
    for other in lists[1:]:
        votes = votes.unionByName(other.select("query_id", "gallery_index", "rank"))
    return votes.groupBy("query_id", "gallery_index").agg(F.sum(1 / (F.col("rank") + constant)).alias("fused"))
