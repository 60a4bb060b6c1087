"""Binary codes: learned (ITQ) or signs, exact Hamming search and multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.functions.vectors import hamming
from prismlake.operators import search
from prismlake.operators.whitening import moments
from prismlake.runtime import spread


class Itq:
    """mean (d), projection (d, b), rotation (b, b)."""

    def __init__(self, mean: np.ndarray, projection: np.ndarray, rotation: np.ndarray):
        self.mean, self.projection, self.rotation = mean, projection, rotation

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.projection @ self.rotation


def itq_fit(df: DataFrame, n_bits: int = 64, iterations: int = 50, seed: int = 0, sample: int = 50_000) -> Itq:
    """Iterative quantization: principal directions of all rows, a rotation fitted on a sample.

    The covariance takes every row in one pass. The rotation alternates codes and an orthogonal
    fit on at most ``sample`` rows, those with the least hash.
    """
    n, s1, s2 = moments(df, by_modality=False)[""]
    d = len(s1)
    if not 0 < n_bits <= d:
        raise ValueError(f"n_bits must be 1 to {d}")
    mean = s1 / n
    _, vectors = np.linalg.eigh(s2 / n - np.outer(mean, mean))
    projection = vectors[:, ::-1][:, :n_bits]
    some = df.where("embedding is not null").orderBy(F.xxhash64(F.lit(seed), "gallery_index"), "gallery_index").limit(sample).select(F.col("embedding").cast("array<double>"))
    v = some.toArrow().column(0).combine_chunks().flatten().to_numpy().reshape(-1, d)
    v = (v - mean) @ projection
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_bits, n_bits)))[0]
    for _ in range(iterations):
        code = np.where(v @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(code.T @ v)
        rotation = (left @ right).T
    return Itq(mean, projection, rotation)


def itq_transform(df: DataFrame, model: Itq) -> DataFrame:
    """``df`` with ``code``, packed into 64-bit integers, the first bit highest."""
    names = df.columns
    at = names.index("embedding")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            bits = model.project(x) >= 0
            pad = -bits.shape[1] % 64
            packed = np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1)
            words = packed.view(">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words.tolist(), pa.list_(pa.int64()))], [*names, "code"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.where("embedding is not null").mapInArrow(run, schema + ", code array<bigint>")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "gallery_index")
    out = pairs.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).where(F.col("rank") < k)
    return out.select("query_id", "gallery_index", "distance", "rank")


class _Nearest:
    """The k nearest codes so far of each of some queries."""

    def __init__(self, key: np.ndarray, code: np.ndarray, k: int):
        self.key, self.code, self.k = key, code, k
        self.far = self.at = np.zeros((len(key), 0), np.int64)

    def add(self, key: np.ndarray, code: np.ndarray) -> None:
        far = np.zeros((len(self.key), len(key)), np.int64)
        for word in range(code.shape[1]):
            far += np.bitwise_count(self.code[:, None, word] ^ code[None, :, word])
        far = np.concatenate([self.far, far], 1)
        at = np.concatenate([self.at, np.broadcast_to(key, (len(self.key), len(key)))], 1)
        order = np.lexsort((at, far), axis=1)[:, : self.k]
        self.far, self.at = np.take_along_axis(far, order, 1), np.take_along_axis(at, order, 1)

    def batch(self) -> pa.RecordBatch:
        query = np.broadcast_to(self.key[:, None], self.at.shape)
        return pa.RecordBatch.from_pydict({"query_id": pa.array(query.ravel()), "gallery_index": pa.array(self.at.ravel()), "distance": pa.array(self.far.ravel())})


NEAR = "query_id long, gallery_index long, distance long"


def _keyed(table, key: str) -> tuple[np.ndarray, np.ndarray]:
    code = table.column("code")
    code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
    return np.asarray(table.column(key).to_numpy(), np.int64), code.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(len(code), -1)


def _in_blocks(key: np.ndarray, code: np.ndarray, k: int) -> list[_Nearest]:
    return [_Nearest(key[i : i + search.QUERY_ROWS], code[i : i + search.QUERY_ROWS], k) for i in range(0, len(key), search.QUERY_ROWS)]


def hamming_topk(queries: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    """Exact: every query against every code, in blocks; each task keeps k codes of a query.

    Queries are broadcast if their counted size is below ``search.BROADCAST_BYTES``; else both
    sides are dealt to a grid of blocks.
    """
    spark = queries.sparkSession
    q, g = (df.where("code is not null").select(F.col(key).cast("long").alias(key), "code") for df, key in ((queries, "query_id"), (gallery, "gallery_index")))
    size = q.agg(F.count("*").alias("n"), F.max(F.size("code")).alias("w")).first()
    n = size["n"]
    if n * (8 * (size["w"] or 0) + 16) <= search.BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast(q.toArrow())

        def near(batches):
            best = _in_blocks(*_keyed(shared.value, "query_id"), k) if shared.value.num_rows else []
            for batch in batches:
                for at in range(0, batch.num_rows if best else 0, search.BLOCK_ROWS):
                    side = _keyed(batch.slice(at, search.BLOCK_ROWS), "gallery_index")
                    for b in best:
                        b.add(*side)
            yield from (b.batch() for b in best)

        return _best(spread(g).mapInArrow(near, NEAR), k)
    blocks = max(1, -(-n // search.BLOCK_ROWS))
    strips = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("gb", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    right = g.withColumn("gb", F.pmod(F.xxhash64("gallery_index"), F.lit(strips)).cast("int")).withColumn("qb", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        best = _in_blocks(*_keyed(a, "query_id"), k) if a.num_rows and b.num_rows else []
        for at in range(0, b.num_rows if best else 0, search.BLOCK_ROWS):
            side = _keyed(b.slice(at, search.BLOCK_ROWS), "gallery_index")
            for some in best:
                some.add(*side)
        none = pa.RecordBatch.from_pydict({c: pa.array([], pa.int64()) for c in ("query_id", "gallery_index", "distance")})
        return pa.Table.from_batches([none, *(some.batch() for some in best)])

    return _best(left.groupBy("qb", "gb").cogroup(right.groupBy("qb", "gb")).applyInArrow(pair, NEAR), k)


def _pieces(df: DataFrame, tables: int, bits: int) -> DataFrame:
    """(piece, value): each code once for every table."""
    width, per = bits // tables, 64 * tables // bits
    values = [F.shiftrightunsigned(F.col("code")[t // per], 64 - width * (t % per + 1)).bitwiseAND(F.lit((1 << width) - 1)) for t in range(tables)]
    return df.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(t).alias("piece"), v.alias("value")) for t, v in enumerate(values)]))).select(*df.columns, "_p.*")


def hamming_within(queries: DataFrame, gallery: DataFrame, radius: int, tables: int = 4, bits: int = 64) -> DataFrame:
    """Exact: all pairs within ``radius``, by an equi-join on pieces of the code.

    Of ``tables`` pieces one differs in radius div tables bits at most, so the queries probe the
    values around each of their pieces; pairs that meet are verified on whole codes.
    """
    if bits % tables or 64 % (bits // tables):
        raise ValueError("the tables must cut each 64-bit word evenly")
    width, flips = bits // tables, radius // tables
    masks = [0]
    for _ in range(flips):
        masks = sorted({m ^ (1 << b) for m in masks for b in range(width)} | set(masks))
    probes = _pieces(queries.select("query_id", F.col("code")), tables, bits)
    probes = probes.withColumn("_m", F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))).select("query_id", F.col("code").alias("qc"), "piece", F.col("value").bitwiseXOR(F.col("_m")).alias("value"))
    met = probes.join(_pieces(gallery.select("gallery_index", "code"), tables, bits), ["piece", "value"]).select("query_id", "gallery_index", hamming("qc", "code").cast("long").alias("distance"))
    return met.where(F.col("distance") <= radius).distinct()


def binary_search(queries: DataFrame, gallery: DataFrame, k: int, radius: int = 7, tables: int = 4, bits: int = 64) -> DataFrame:
    """Top k by probing; queries that find fewer than k rows in the radius get an exact scan.

    A query with k rows within the radius has its exact answer among them.
    """
    near = hamming_within(queries, gallery, radius, tables, bits)
    short = queries.join(near.groupBy("query_id").agg(F.count("*").alias("_n")), "query_id", "left").where(F.coalesce("_n", F.lit(0)) < k).select(*queries.columns)
    probed = _best(near.join(short.select("query_id"), "query_id", "left_anti"), k)
    return probed.unionByName(hamming_topk(short, gallery, k))
