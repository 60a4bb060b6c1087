"""Approximate search by cells: k-means centroids partition the gallery, queries probe some.

A cell is scored where it lies: the queries that probe it come to it, in tasks of bounded
parts of a cell and of its queries, and only k rows of each query and task are shuffled.

Cells may carry codes (product quantization): what a centroid leaves of a vector is rotated and
cut into parts, and each part is one byte, the number of its nearest of 256 centroids. Then codes
travel instead of vectors, and whole vectors judge the best of each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.operators import rerank
from prismlake.operators import search as exact_search
from prismlake.runtime import stage_table

#: Numbers that a block of distances to centroids may hold, and bytes of a sample on the driver.
BLOCK_NUMBERS, SAMPLE_BYTES = 1 << 23, 256 << 20
PART_ROWS, PART_QUERIES = 65_536, 4_096


class CellIndex:
    """The gallery with the cell of each row; ``coded``, if there, holds codes instead of vectors."""

    def __init__(self, gallery: DataFrame, centroids: np.ndarray, coded: DataFrame | None = None, codebook: "Codebook | None" = None):
        self.gallery, self.centroids, self.coded, self.codebook = gallery, centroids, coded, codebook


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return x.reshape(len(column), -1) if len(column) else x.reshape(0, 1)


def nearest_centroids(x: np.ndarray, c: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest centroids of each row, in blocks of bounded size; 0 if there are none."""
    if not len(c):
        return np.zeros((len(x), 1), np.int32)
    out, square = np.empty((len(x), min(probes, len(c))), np.int32), (c * c).sum(1)
    step = max(1, BLOCK_NUMBERS // len(c))
    for at in range(0, len(x), step):
        far = square - 2 * x[at : at + step] @ c.T
        out[at : at + step] = far.argmin(1)[:, None] if probes == 1 else np.argsort(far, axis=1, kind="stable")[:, :probes]
    return out


def _nearest(df: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """``df`` once for each of its ``probes`` nearest cells."""
    names = df.columns
    at = names.index("embedding")
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                best = nearest_centroids(_matrix(batch.column(at)), shared.value, probes)
                out = batch.take(pa.array(np.repeat(np.arange(len(best)), best.shape[1])))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(best.ravel())], [*names, "cell_id"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.where("embedding is not null").mapInArrow(run, schema + ", cell_id int")


def _sample(gallery: DataFrame, rows: int, seed: int, *more: str) -> tuple[pa.Table, int]:
    """At most ``rows`` rows (the least hashes) and at most ``SAMPLE_BYTES`` of them, and the dimension."""
    whole = gallery.where("embedding is not null")
    d = whole.select(F.max(F.size("embedding"))).first()[0] or 1
    some = whole.orderBy(F.xxhash64(F.lit(seed), "gallery_index"), "gallery_index").limit(max(1, min(rows, SAMPLE_BYTES // (8 * d))))
    return some.select(F.col("embedding").cast("array<double>"), *more).toArrow(), d


def _moved(c: np.ndarray, x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Centroids at the mean of the rows that are nearest to them; those without rows stay."""
    order = np.argsort(near, kind="stable")
    count = np.bincount(near, minlength=len(c))
    on = np.flatnonzero(count)
    out = c.copy()
    out[on] = np.add.reduceat(x[order], (np.cumsum(count) - count)[on]) / count[on, None]
    return out


def build(gallery: DataFrame, cells: int = 1024, sample: int = 262_144, iterations: int = 10, seed: int = 0) -> CellIndex:
    """Centroids fitted on at most ``sample`` rows; every row gets a cell, in a stored table."""
    some, d = _sample(gallery, sample, seed)
    x = _matrix(some.column(0))
    cells = max(1, min(cells, len(x)))
    c = x[np.random.default_rng(seed).permutation(len(x))[:cells]] if len(x) else np.zeros((0, d))
    for _ in range(iterations if len(x) else 0):
        c = _moved(c, x, nearest_centroids(x, c, 1)[:, 0])
    return CellIndex(stage_table(_nearest(gallery, c, 1), "cells"), c)


class Codebook:
    """A rotation, and up to 256 centroids of each part of a rotated vector: (parts, 256, d / parts)."""

    def __init__(self, rotation: np.ndarray, centroids: np.ndarray):
        self.rotation, self.centroids = rotation, centroids

    def pieces(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x @ self.rotation, len(self.centroids), axis=1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([nearest_centroids(piece, c, 1)[:, 0] for piece, c in zip(self.pieces(x), self.centroids)], 1).astype(np.uint8)

    def rotated(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[code] for c, code in zip(self.centroids, codes.T)], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.rotated(codes) @ self.rotation.T


def fit_codebook(x: np.ndarray, parts: int, iterations: int = 10, seed: int = 0) -> Codebook:
    """Centroids and rotation in turn: each the best for the other, in least squares."""
    start = x[np.random.default_rng(seed).permutation(len(x))[:256]]
    book = Codebook(np.eye(x.shape[1]), np.stack(np.split(start, parts, axis=1)))
    for _ in range(iterations):
        codes = book.encode(x)
        book.centroids = np.stack([_moved(c, piece, code) for c, piece, code in zip(book.centroids, book.pieces(x), codes.T)])
        u, _, v = np.linalg.svd(x.T @ book.rotated(codes))
        book.rotation = u @ v
    return book


def with_codes(index: CellIndex, parts: int = 16, sample: int = 65_536, iterations: int = 10, seed: int = 0) -> CellIndex:
    """``index`` with a code of each row, in a stored table.

    ``parts`` is the most bytes of a code; the number of parts is the largest that divides the
    dimension. The codebook is fitted on at most ``sample`` rows. An empty index gets no codes.
    """
    some, d = _sample(index.gallery, sample, seed, "cell_id")
    if not some.num_rows:
        return index
    parts = max(p for p in range(1, min(parts, d) + 1) if d % p == 0)
    book = fit_codebook(_matrix(some.column(0)) - index.centroids[some.column(1).to_numpy()], parts, iterations, seed)
    shared = index.gallery.sparkSession.sparkContext.broadcast((book, index.centroids))
    names = ["gallery_index", "id", "modality", "location_id", "cell_id", "code"]

    def encode(batches):
        book, c = shared.value
        for batch in batches:
            if batch.num_rows:
                codes = book.encode(_matrix(batch.column("embedding")) - c[batch.column("cell_id").to_numpy()])
                ends = np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)
                code = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(codes))])
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-1]), code], names)

    rows = exact_search.columns_of(index.gallery, "gallery_index", "cell_id")
    coded = rows.mapInArrow(encode, "gallery_index long, id string, modality string, location_id string, cell_id int, code binary")
    return CellIndex(index.gallery, index.centroids, stage_table(coded, "cell-codes"), book)


def search(queries: DataFrame, index: CellIndex, k: int, probes: int = 8, gallery_modality: str | None = None, by_modality: bool = False, leave_one_out: bool = False, same_location: bool = False, pool: int | None = None) -> DataFrame:
    """As the exact search with the same filters, over the rows of the probed cells.

    With a ``pool`` rows are scored by their codes, and the best ``pool`` of each query (and
    modality) are judged by whole vectors.
    """
    gallery, decode = index.gallery, None
    if pool is not None and index.coded is not None:
        gallery, decode = index.coded, _decoder(index)
    if gallery_modality is not None:
        gallery = gallery.where(F.col("modality") == gallery_modality)
    q = exact_search.columns_of(_nearest(queries, index.centroids, probes), "query_id", "cell_id")
    g = exact_search.columns_of(gallery, "gallery_index", "cell_id") if decode is None else gallery
    # one row per cell, and there are as many cells as centroids
    parts = lambda df, rows, name: df.groupBy("cell_id").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    shape = F.broadcast(parts(g, PART_ROWS, "parts").join(parts(q, PART_QUERIES, "turns"), "cell_id"))
    salt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(shape, "cell_id").withColumn("part", each("parts")).withColumn("turn", salt("query_id", "turns")).drop("parts", "turns")
    right = g.join(shape, "cell_id").withColumn("part", salt("gallery_index", "parts")).withColumn("turn", each("turns")).drop("parts", "turns")
    key = ["cell_id", "part", "turn"]
    kept = k if decode is None else max(k, pool)
    pair = exact_search.block_pair(kept, by_modality, leave_one_out, same_location, decode=decode)
    found = exact_search.best_hits(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(pair, exact_search.HITS), kept, by_modality)
    return found if decode is None else rerank.exact_refine(queries, index.gallery, found, k, by_modality)


def _decoder(index: CellIndex):
    """A function that puts vectors in the place of codes, for the rows of a batch."""
    shared = index.gallery.sparkSession.sparkContext.broadcast((index.codebook, index.centroids))

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        book, c = shared.value
        codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        x = c[batch.column("cell_id").to_numpy()] + book.decode(codes)
        return batch.append_column("embedding", pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]))

    return decode


def enough_pool(queries: DataFrame, index: CellIndex, k: int, probes: int, wanted: float = 0.95, sample: int = 256) -> int:
    """Fewest doublings of k rows, judged by whole vectors, that find ``wanted`` of what the same
    cells give without codes; measured for at most ``sample`` queries (the least hashes)."""
    some = stage_table(queries.where("embedding is not null").orderBy(F.xxhash64("query_id"), "query_id").limit(sample), "pool-queries")
    exact = stage_table(search(some, index, k, probes), "pool-hits")
    rows, pool = index.gallery.count(), 2 * k
    while pool < rows and (recall(search(some, index, k, probes, pool=pool), exact).first()[0] or 0) < wanted:
        pool *= 2
    return pool


def enough_probes(queries: DataFrame, index: CellIndex, k: int, least: int = 8, wanted: float = 0.95, sample: int = 256) -> int:
    """Fewest probes, ``least`` or more, that find ``wanted`` of the exact hits of some queries.

    Measured by an exact search for at most ``sample`` queries (the least hashes). Vectors
    without structure need nearly every cell.
    """
    some = queries.where("embedding is not null").orderBy(F.xxhash64("query_id"), "query_id").limit(sample).select("query_id", "embedding")
    hits = exact_search.search(some, index.gallery, k).join(index.gallery.select("gallery_index", "cell_id"), "gallery_index").groupBy("query_id").agg(F.collect_list("cell_id").alias("cells"))
    c = index.centroids
    places = [np.zeros(0, np.int64)]
    for r in some.join(hits, "query_id").select("embedding", "cells").collect():
        place = np.empty(len(c), np.int64)
        place[np.argsort((c * c).sum(1) - 2 * c @ np.array(r["embedding"], float), kind="stable")] = np.arange(len(c))
        places.append(place[r["cells"]])
    met = np.bincount(np.concatenate(places), minlength=len(c)).cumsum()
    if not met[-1]:
        return len(c)
    return min(max(least, int(np.argmax(met >= wanted * met[-1])) + 1), len(c))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that were found."""
    hit = found.select("query_id", "gallery_index").withColumn("_f", F.lit(1.0))
    return exact.join(hit, ["query_id", "gallery_index"], "left").agg(F.avg(F.coalesce("_f", F.lit(0.0))).alias("recall"))
