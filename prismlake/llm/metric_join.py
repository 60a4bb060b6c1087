"""Embedding near-duplicates: an exact metric range join of a table of vectors with itself.

Cosine >= ``least`` is angle <= arccos(``least``), and the angle is a metric. Vectors that are
equal form one class. Pivots partition the classes: a class is at home in the cell of its
nearest pivot. If y, at home in cell j, is within the range t of x, at home in cell i, then by
the triangle inequality

    angle(x, p_j) <= angle(x, p_i) + 2 t   and   inner_j - t <= angle(x, p_j) <= outer_j + t

where inner_j and outer_j are the least and greatest angle to p_j in cell j. Only then x is
replicated to cell j, and only if j is the cell that answers for the pair (i, j). Cells join independently:
those with many vectors at home are cut into parts, and in a part the visitors stream past the
vectors at home, block by block. A task emits link counts and a spanning forest, never pairs.

Where vectors have no structure, the range exceeds what pivots can tell apart and most are
replicated to half of the cells; the join is then all pairs, in blocks.

Nulls: vectors that are null, empty, zero or hold null or non-finite components link with
nothing and are their own component. Vectors of different length never link. A null vec_id
takes part but can't name a component; a component of such rows only has a null id. Vectors of
doubles are compared as doubles. Repeated rows of one vec_id count as vectors of their
own in n_links. An empty table gives an empty result. Further columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake import runtime
from prismlake.llm.components import components, forest

DEALT = "cell int, part int, side int, rep long, m long, v array<{}>"


def _unit(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors of length one, in doubles whatever the type of the column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    x /= np.abs(x).max(axis=1, keepdims=True)  # against overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def spread_pivots(sample: np.ndarray, number: int) -> np.ndarray:
    """Farthest-first pivots among ``sample``."""
    chosen, near = [0], _angles(sample, sample[:1])[:, 0]
    while len(chosen) < min(number, len(sample)) and near.max() > 1e-6:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _angles(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def answers(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether cell j, not i, joins the pairs between the two: half of the cells answer to each."""
    return ((i + j) % 2 == 1) == (j > i)


def _deal(classes: DataFrame, size: int, pivots: np.ndarray, reach: float, part_size: int) -> DataFrame:
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                angle = _angles(_unit(batch.column("v"), size), shared.value)
                home = angle.argmin(axis=1)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(home, pa.int32()), "angle": pa.array(angle[np.arange(len(home)), home])})

    # one row per cell, and there are as many cells as pivots
    cells = {r["cell"]: r for r in classes.select("v").mapInArrow(assign, "cell int, angle double").groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("inner"), F.max("angle").alias("outer")).collect()}
    k = len(pivots)
    parts = np.array([max(1, math.ceil(cells[c]["n"] / part_size)) if c in cells else 0 for c in range(k)])
    inner = np.array([cells[c]["inner"] if c in cells else np.inf for c in range(k)])
    outer = np.array([cells[c]["outer"] if c in cells else -np.inf for c in range(k)])
    slack = 1e-7  # of arccos near one

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            angle = _angles(_unit(batch.column("v"), size), shared.value)
            n, cell = len(angle), np.arange(k)
            home = angle.argmin(axis=1)
            own = angle[np.arange(n), home][:, None]
            visit = (angle <= own + 2 * reach + slack) & (angle <= outer + reach + slack) & (angle >= inner - reach - slack) & answers(home[:, None], cell[None, :]) & (cell[None, :] != home[:, None])
            rep = batch.column("rep").to_numpy()
            part = ((rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts[home]
            x, c = np.nonzero(visit)
            times = parts[c]
            x, c = np.repeat(x, times), np.repeat(c, times)
            p = np.arange(len(c)) - np.repeat(np.cumsum(times) - times, times)
            behind = parts[home] - 1 - part  # later parts of the own cell
            hx = np.repeat(np.arange(n), behind)
            hp = part[hx] + 1 + np.arange(len(hx)) - np.repeat(np.cumsum(behind) - behind, behind)
            row = np.concatenate([np.arange(n), hx, x])
            out = batch.take(pa.array(row)) if len(row) else batch
            yield pa.RecordBatch.from_pydict(
                {
                    "cell": pa.array(np.concatenate([home, home[hx], c]), pa.int32()),
                    "part": pa.array(np.concatenate([part, hp, p]), pa.int32()),
                    "side": pa.array(np.concatenate([np.zeros(n), np.ones(len(hx) + len(x))]).astype(np.int32)),
                    "rep": out.column("rep"),
                    "m": out.column("m"),
                    "v": out.column("v"),
                }
            )

    kind = classes.schema["v"].dataType.elementType.simpleString()
    return classes.select("rep", "m", "v").mapInArrow(deal, DEALT.format(kind))


def _links(dealt: DataFrame, size: int, least: float) -> DataFrame:
    """Rows (kind, a, b): kind 0, class a has b links more; kind 1, classes a and b hang together."""

    def run(batches):
        key, state = None, None
        for batch in batches:
            cell, part, side = (batch.column(c).to_numpy() for c in ("cell", "part", "side"))
            code = cell.astype(np.int64) << 32 | part
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(code) != 0) | (np.diff(side) != 0)) + 1, [len(code)]])
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                if code[low] != key:
                    if state:
                        yield from state.close()
                    key, state = code[low], _Part(least)
                some = batch.slice(low, high - low)
                x, rep, m = _unit(some.column("v"), size), some.column("rep").to_numpy(), some.column("m").to_numpy()
                if side[low] == 0:
                    state.add(x, rep, m)
                else:
                    yield from state.visit(x, rep, m)
        if state:
            yield from state.close()

    ordered = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "side")
    return ordered.mapInArrow(run, "kind int, a long, b long")


class _Part:
    """The vectors at home in one part of a cell, and what links they have found."""

    BLOCK = 1024

    def __init__(self, least: float):
        self.least, self.homes, self.ready = least, [], False

    def add(self, x: np.ndarray, rep: np.ndarray, m: np.ndarray) -> None:
        self.homes.append((x, rep, m))

    def _prepare(self) -> None:
        self.ready = True
        self.x, self.rep, self.m = (np.concatenate([h[k] for h in self.homes]) for k in range(3)) if self.homes else (np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros(0, np.int64))
        n = len(self.rep)
        self.count, self.label = np.zeros(n, np.int64), np.arange(n)
        for at in range(0, n, self.BLOCK):
            u, v = np.nonzero(self.x[at : at + self.BLOCK] @ self.x[at:].T >= self.least)
            u, v = (u + at)[u < v], (v + at)[u < v]
            np.add.at(self.count, u, self.m[v])
            np.add.at(self.count, v, self.m[u])
            self._join(u, v)

    def _join(self, u: np.ndarray, v: np.ndarray) -> None:
        if len(u):
            every = np.arange(len(self.label))
            self.label = forest(np.concatenate([u, every]), np.concatenate([v, self.label]), len(every))

    def visit(self, x: np.ndarray, rep: np.ndarray, m: np.ndarray):
        if not self.ready:
            self._prepare()
        for at in range(0, len(rep), self.BLOCK):
            u, v = np.nonzero(x[at : at + self.BLOCK] @ self.x.T >= self.least) if len(self.rep) else (np.zeros(0, int), np.zeros(0, int))
            if not len(u):
                continue
            u = u + at
            np.add.at(self.count, v, m[u])
            first = np.concatenate([[True], u[1:] != u[:-1]])
            guest = u[first]
            got = np.add.reduceat(self.m[v], np.flatnonzero(first))
            yield _batch(np.zeros(len(guest)), rep[guest], got)
            yield _batch(np.ones(len(guest)), rep[guest], self.rep[v[first]])
            # all that one guest links hang together
            self._join(np.repeat(v[first], np.diff(np.append(np.flatnonzero(first), len(u)))), v)

    def close(self):
        if not self.ready:
            self._prepare()
        on = self.count > 0
        yield _batch(np.zeros(on.sum()), self.rep[on], self.count[on])
        on = self.label != np.arange(len(self.label))
        yield _batch(np.ones(on.sum()), self.rep[on], self.rep[self.label[on]])


def _batch(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array(kind.astype(np.int32)), "a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64))})


def near_vectors(vectors: DataFrame, least: float = 0.9, pivots: int = 32, sample: int = 1024, part_size: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding)``.

    ``pivots`` and ``sample`` bound what goes through the driver; ``part_size`` bounds the
    vectors at home in one part of a cell.
    """
    spark = vectors.sparkSession
    runtime.bounded_arrow_batches(spark, 4096)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    v = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    whole = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))) & F.exists(v, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(whole, v).alias("v"))
    sizes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    # numbers that are fixed once the table is stored; a class whose ids are all null needs one, too
    classes = runtime.stage_table(sizes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    found = []
    # one join for each length of vector that occurs; a table of embeddings has one
    for size in sorted(r["n"] for r in classes.select(F.size("v").alias("n")).distinct().collect()):
        of_size = classes.where(F.size("v") == size)
        some = of_size.orderBy(F.xxhash64("v"), "least").limit(sample).select("v").toArrow().column("v")
        chosen = spread_pivots(_unit(some, size), pivots)
        found.append(_links(_deal(of_size, size, chosen, math.acos(least), part_size), size, least))
    if not found:
        return rows.selectExpr("vec_id", "0L n_links", "vec_id component_id", "vec_id is not null kept")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    links = runtime.stage_table(links, "vector-links")
    counts = links.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    groups = components(links.where("kind = 1").select("a", "b"), "vector-groups")
    known = classes.join(counts, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left").select("v", "least", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(names, "component").select("v", "n_links", "component_id", F.lit(True).alias("linked"))
    out = rows.join(known, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: DuckDB SQL for ``near_vectors`` over ``embeddings``, from the definition.
ORACLE = """
with recursive vectors as (
  select vec_id, case when embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0 then embedding::double[] end as v
  from embeddings),
links as (
  select a.vec_id as a, b.vec_id as b from vectors a join vectors b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.9),
reach(vec_id, other) as (
  select vec_id, vec_id from vectors union select r.vec_id, l.b from reach r join links l on r.other = l.a),
ends as (select vec_id, min(other) as component_id from reach group by vec_id),
degrees as (select a as vec_id, count(*) as n from links group by a)
select e.vec_id, coalesce(d.n, 0)::bigint as n_links, e.component_id, e.vec_id = e.component_id as kept
from ends e left join degrees d on d.vec_id = e.vec_id"""
