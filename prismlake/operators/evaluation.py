"""The evaluation matrix: every query modality against every gallery modality in one job."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.operators import metrics
from prismlake.operators.search import search

MODALITIES = 1000  # kinds of sensor; the driver lists them
SPARE = 8  # hits fetched beyond the deepest cut-off


def relevance_table(gallery: DataFrame) -> DataFrame:
    """How many gallery rows each (g_modality, label) has; unlabelled rows don't count."""
    return gallery.where("label >= 0").groupBy(F.col("modality").alias("g_modality"), "label").agg(F.count("*").alias("n"))


def relevant_counts(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """query_id, g_modality, total_relevant: R_q for each query and gallery modality.

    One less where the gallery modality holds the query itself, by id or else by location,
    since such a row is excluded from the hits; never below zero.
    """
    names = sorted(r[0] for r in gallery.select("modality").where("modality is not null").distinct().limit(MODALITIES + 1).collect())
    if len(names) > MODALITIES:
        raise ValueError(f"a gallery has {MODALITIES} modalities at most")
    cells = F.explode(F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>"))
    q = queries.select("query_id", "id", "location_id", "label", cells.alias("g_modality"))
    by_id = gallery.select("id", F.col("modality").alias("g_modality")).distinct().withColumn("_own", F.lit(1))
    by_place = gallery.where("location_id is not null").select("location_id", F.col("modality").alias("g_modality")).distinct().withColumn("_near", F.lit(1))
    rows = q.join(relevance_table(gallery), ["g_modality", "label"], "left").join(by_id, ["id", "g_modality"], "left").join(by_place, ["location_id", "g_modality"], "left")
    member = F.coalesce("_own", "_near", F.lit(0))
    return rows.select("query_id", "g_modality", F.greatest(F.coalesce("n", F.lit(0)) - member, F.lit(0)).alias("total_relevant"))


def modality_index(gallery: DataFrame) -> DataFrame:
    """Rows, distinct ids and distinct locations of each modality."""
    return gallery.groupBy("modality").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.countDistinct("location_id").alias("n_locations"))


def query_metrics(queries: DataFrame, gallery: DataFrame, ks: list[int], mode: str = "raw", same_location: bool = True) -> DataFrame:
    """Metrics of every (query, gallery modality), with the query's modality."""
    deepest = max(ks)
    hits = search(queries, gallery, deepest + SPARE, by_modality=True, leave_one_out=True, same_location=same_location)
    labelled = hits.withColumn("rank", F.col("rank") + 1).join(gallery.select("gallery_index", "label"), "gallery_index")
    judged = metrics.judge(labelled, queries)
    totals = relevant_counts(queries.where("label >= 0"), gallery).join(queries.select("query_id", F.col("modality").alias("q_modality")), "query_id")
    return metrics.per_query(judged, totals, ks, mode, ["query_id", "g_modality"], ap_k=deepest)


def matrix(per_query: DataFrame) -> DataFrame:
    """One row per (q_modality, g_modality)."""
    return metrics.means(per_query, ["q_modality", "g_modality"])


def headline(cells: DataFrame) -> DataFrame:
    """Means over cells, not over queries: same-modal and cross-modal."""
    names = [c for c in cells.columns if c.startswith("mean_")]
    kind = F.when(F.col("q_modality") == F.col("g_modality"), "same").otherwise("cross").alias("kind")
    return cells.where("n_queries > 0").groupBy(kind).agg(F.count("*").alias("n_cells"), *[F.avg(c).alias(c) for c in names])


def evaluate(queries: DataFrame, gallery: DataFrame, ks: list[int] | None = None, mode: str = "raw") -> dict[str, DataFrame]:
    cells = matrix(query_metrics(queries, gallery, ks or [5, 10], mode))
    return {"cells": cells, "headline": headline(cells)}


def chance_level(gallery: DataFrame) -> DataFrame:
    """F1 expected of a guess: one over the number of labels."""
    return gallery.where("label >= 0").agg((1 / F.countDistinct("label")).alias("chance"))


def passes(cross_f1: float, chance: float, unwhitened_f1: float) -> bool:
    """The smoke test's verdict."""
    return cross_f1 > max(3 * chance, 0.10) and cross_f1 >= unwhitened_f1


def latency(run, warmup: int = 2, runs: int = 10) -> dict[str, float]:
    """Milliseconds of ``run()``: mean, p50, p95 (linear interpolation), min, max."""
    import numpy as np

    for _ in range(warmup):
        run()
    ms = []
    for _ in range(runs):
        began = time.perf_counter()
        run()
        ms.append((time.perf_counter() - began) * 1000)
    return {"mean": float(np.mean(ms)), "p50": float(np.percentile(ms, 50)), "p95": float(np.percentile(ms, 95)), "min": min(ms), "max": max(ms), "runs": runs}


def report(cells: DataFrame, top: DataFrame, ks: list[int]) -> str:
    """A Markdown report of an evaluation; both tables are a few rows."""
    names = [f"mean_{m}_at_{k}" for k in ks for m in ("p", "recall", "f1")] + ["mean_ap"]
    line = lambda values: "| " + " | ".join(values) + " |"
    out = [line(["query", "gallery", "queries", *names]), line(["-"] * (3 + len(names)))]
    for r in cells.orderBy("q_modality", "g_modality").collect():
        out.append(line([r["q_modality"], r["g_modality"], str(r["n_queries"]), *[f"{r[n]:.4f}" for n in names]]))
    out += ["", line(["kind", "cells", *names]), line(["-"] * (2 + len(names)))]
    for r in top.orderBy(F.desc("kind")).collect():
        out.append(line([r["kind"], str(r["n_cells"]), *[f"{r[n]:.4f}" for n in names]]))
    return "\n".join(out)
