"""Exact top-k vector search with modality filters and exclusions.

Filters and exclusions apply before the top k are chosen. Ties go to the smaller
gallery_index; scores are rounded to six digits first, so that a tie is one on any engine.

Physical plan: the gallery stays where it is. If the queries are small (their size is
checked), they are broadcast; each gallery partition scores them by blocks with BLAS and
keeps k rows per query and group, which alone are shuffled to be ranked. Beyond that size both
sides are dealt to a grid of blocks, each block pair scored in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.functions.vectors import DIGITS
from prismlake.runtime import spread

HITS = "query_id long, grp string, gallery_index long, score double"
BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 4096
QUERY_ROWS = 512


def _matrix(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return x.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12) if len(x) else x


def _codes(column: pa.Array, known: dict) -> np.ndarray:
    """Small integers for strings; -1 for null."""
    return np.array([-1 if s is None else known.setdefault(s, len(known)) for s in column.to_pylist()], np.int64)


class _Side:
    """Columns of queries or gallery as arrays; strings as codes of a shared dictionary."""

    def __init__(self, batch, key: str, words: dict):
        self.key = batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64)
        self.x = _unit(_matrix(batch.column("embedding")))
        self.id, self.location, self.modality = (_codes(batch.column(c), words) for c in ("id", "location_id", "modality"))

    def take(self, order: np.ndarray) -> "_Side":
        out = object.__new__(_Side)
        for name, value in self.__dict__.items():
            setattr(out, name, value[order])
        return out


class _Best:
    """Best k so far of each query in each group."""

    def __init__(self, queries: _Side, k: int, by_group: bool, loo: bool, same_location: bool, excluded: dict | None):
        self.q, self.k, self.by_group, self.loo, self.same_location, self.excluded = queries, k, by_group, loo, same_location, excluded
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, g: _Side) -> None:
        g = g.take(np.argsort(g.key, kind="stable"))
        score = np.round(self.q.x @ g.x.T, DIGITS) + 0.0
        if self.loo:
            score[(self.q.id[:, None] == g.id[None, :]) & (g.id >= 0)[None, :]] = -np.inf
        if self.same_location:
            score[(self.q.location[:, None] == g.location[None, :]) & (g.location >= 0)[None, :]] = -np.inf
        for i, q in enumerate(self.q.key.tolist()) if self.excluded else ():
            if q in self.excluded:
                score[i, np.isin(g.key, self.excluded[q])] = -np.inf
        for group in np.unique(g.modality).tolist() if self.by_group else (-2,):
            on = np.flatnonzero(g.modality == group) if self.by_group else np.arange(len(g.key))
            s, key = score[:, on], np.broadcast_to(g.key[on], (len(score), len(on)))
            if group in self.rows:
                s, key = np.concatenate([self.rows[group][0], s], 1), np.concatenate([self.rows[group][1], key], 1)
            order = np.lexsort((key, -s), axis=1)[:, : self.k]
            self.rows[group] = np.take_along_axis(s, order, 1), np.take_along_axis(key, order, 1)

    def batches(self, words: dict):
        names = {v: k for k, v in words.items()}
        for group, (score, key) in self.rows.items():
            query = np.broadcast_to(self.q.key[:, None], score.shape)
            on = np.isfinite(score)
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": pa.array(query[on]),
                    "grp": pa.array([names.get(group, "")] * int(on.sum()), pa.string()),
                    "gallery_index": pa.array(key[on]),
                    "score": pa.array(score[on]),
                }
            )


def _blocks(queries: pa.Table, words: dict, *options) -> list[_Best]:
    """Queries in blocks, so that the scores of one block and one batch are what memory holds."""
    side = _Side(queries.combine_chunks().to_batches()[0], "query_id", words)
    return [_Best(side.take(np.arange(i, min(i + QUERY_ROWS, len(side.key)))), *options) for i in range(0, len(side.key), QUERY_ROWS)]


def columns_of(df: DataFrame, key: str, *more: str) -> DataFrame:
    """What scoring reads of a side, and ``more`` columns."""
    have = set(df.columns)
    null = F.lit(None).cast("string")
    text = [F.col(c).cast("string").alias(c) if c in have else null.alias(c) for c in ("id", "modality", "location_id")]
    return df.where(F.col("embedding").isNotNull()).select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding"), *text, *more)


def block_pair(k: int, by_modality: bool, leave_one_out: bool, same_location: bool, excluded: bool = False, decode=None):
    """The function that scores a block of queries against one of the gallery, as Arrow tables.

    ``excluded``: rows of the first table with a value in ``not`` are pairs to leave out.
    ``decode``: makes the embeddings of a batch of the gallery.
    """

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        words: dict = {}
        lists: dict[int, list[int]] = {}
        if excluded:
            pairs = a.filter(a["not"].is_valid())
            for query, row in zip(pairs["query_id"].to_pylist(), pairs["not"].to_pylist()):
                lists.setdefault(query, []).append(row)
            a = a.filter(a["not"].is_null())
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "grp": pa.array([], pa.string()), "gallery_index": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        best = _blocks(a, words, k, by_modality, leave_one_out, same_location, lists)
        for batch in b.to_batches(max_chunksize=BLOCK_ROWS):
            side = _Side(decode(batch) if decode else batch, "gallery_index", words)
            for part in best:
                part.add(side)
        return pa.Table.from_batches([batch for part in best for batch in part.batches(words)])

    return pair


def candidates(queries: DataFrame, gallery: DataFrame, k: int, by_modality: bool = False, leave_one_out: bool = False, same_location: bool = False, excluded: DataFrame | None = None) -> DataFrame:
    """Up to k rows of each query, group and task; ``search`` ranks them."""
    spark = queries.sparkSession
    q, g = columns_of(queries, "query_id"), columns_of(gallery, "gallery_index")
    size = q.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    n, d = size["n"], size["d"] or 0
    # rows of the exclusion list go with the queries, so they count against the same bound
    pairs = 0 if excluded is None else excluded.count()
    if n * (8 * d + 64) + 16 * pairs <= BROADCAST_BYTES:
        lists: dict[int, list[int]] = {}
        for r in excluded.toLocalIterator() if excluded is not None else ():
            lists.setdefault(r["query_id"], []).append(r["gallery_index"])
        shared = spark.sparkContext.broadcast((q.toArrow(), lists))

        def score(batches):
            table, lists = shared.value
            words: dict = {}
            best = None
            for batch in batches:
                if batch.num_rows and table.num_rows:
                    best = best or _blocks(table, words, k, by_modality, leave_one_out, same_location, lists)
                    side = _Side(batch, "gallery_index", words)
                    for b in best:
                        b.add(side)
            for b in best or ():
                yield from b.batches(words)

        return spread(g).mapInArrow(score, HITS)
    blocks = max(1, -(-n // BLOCK_ROWS))
    strips = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("gb", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    if excluded is not None:  # an excluded pair is a row of the one block pair it belongs to
        where = excluded.select(F.col("query_id").cast("long").alias("query_id"), F.col("gallery_index").cast("long").alias("not")).where("query_id is not null and `not` is not null")
        where = where.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("gb", F.pmod(F.xxhash64("not"), F.lit(strips)).cast("int"))
        left = left.unionByName(where, allowMissingColumns=True)
    right = g.withColumn("gb", F.pmod(F.xxhash64("gallery_index"), F.lit(strips)).cast("int")).withColumn("qb", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))

    pair = block_pair(k, by_modality, leave_one_out, same_location, excluded is not None)
    return left.groupBy("qb", "gb").cogroup(right.groupBy("qb", "gb")).applyInArrow(pair, HITS)


def ranked(found: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The best k of each ``by``, with rank from 0."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "gallery_index")
    return found.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).where(F.col("rank") < k)


def search(queries: DataFrame, gallery: DataFrame, k: int, gallery_modality: str | None = None, by_modality: bool = False, leave_one_out: bool = False, same_location: bool = False, excluded: DataFrame | None = None) -> DataFrame:
    """query_id, gallery_index, score, rank (from 0) and, ``by_modality``, g_modality.

    ``queries(query_id, embedding, ...)``, ``gallery(gallery_index, embedding, ...)``.
    ``excluded(query_id, gallery_index)`` lists rows that a query must not get;
    ``leave_one_out`` excludes its own id, ``same_location`` its own location.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if gallery_modality is not None:
        gallery = gallery.where(F.col("modality") == gallery_modality)
    return best_hits(candidates(queries, gallery, k, by_modality, leave_one_out, same_location, excluded), k, by_modality)


def best_hits(found: DataFrame, k: int, by_modality: bool) -> DataFrame:
    """The ranked hits among what tasks ``found``."""
    out = ranked(found, k, ["query_id", "grp"] if by_modality else ["query_id"])
    columns = ["query_id", "gallery_index", "score", "rank"]
    return out.select(*columns, F.col("grp").alias("g_modality")) if by_modality else out.select(*columns)


def with_hit_columns(hits: DataFrame, gallery: DataFrame) -> DataFrame:
    """Hits with id, label and modality of the gallery row."""
    return hits.join(gallery.select("gallery_index", F.col("id").alias("hit_id"), "label", "modality"), "gallery_index")


def choose_strategy(n: int, dim: int, kind: str = "auto") -> dict:
    """How to search a gallery of ``n`` vectors: exact up to 200 000, by cells beyond.

    ``auto`` follows the size; ``flat`` is exact always; ``ivf`` searches cells always. ``code``
    names the code to keep beside each cell: product quantization of at most so many bytes.
    """
    kind = (kind or "auto").lower()
    if kind in ("flat", "bruteforce", "brute_force"):
        return {"method": "exact", "cells": 0, "code": None}
    width = 128 if dim >= 128 else 64 if dim >= 64 else 32
    if kind == "auto" and n <= 25_000:
        return {"method": "exact", "cells": 0, "code": None}
    if kind == "auto" and n <= 200_000:
        return {"method": "exact_block", "cells": 0, "code": None}
    return {"method": "ivf", "cells": 16_384 if n <= 750_000 else 65_536, "code": f"pq{width}"}
