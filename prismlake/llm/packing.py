"""Best-fit packing of token pieces into sequences of fixed capacity.

Exact-complement hashing on the histogram of piece lengths: single, pair and triple sums of
available lengths are indexed by what they fill; from the longest length down, combinations
that fill a gap exactly are consumed as often as the counts allow; what is left is placed
best fit, longest first. A plan works on counts, so its size is bounded by the capacity (at
most ``capacity`` lengths, and every step of the plan exhausts a length or a class of open
gaps), whatever the number of documents. Documents then take the slots of their length by
rank, found with counts per (length, salt), so one common length is never sorted in one task;
a piece's salt is its turn in the task that cut it, so that not even equal rows share one.

Nulls: a null text is the empty text (one end id); a null doc_id is kept. Rows that are
alike in every column are each packed. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake import runtime
from prismlake.llm.chunks import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, turn int"
SALTS = 512


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, style: str = "dropped_space") -> DataFrame:
    """Whole texts as pieces of at most ``capacity`` ids; only longer documents are cut.

    ``turn`` counts the pieces of a task, modulo ``SALTS``.
    """
    runtime.bounded_arrow_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        made = 0
        for batch in batches:
            enc = encoder(tokenizer, style)
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "turn")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = enc.encode(text) + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for k, v in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), made % SALTS)):
                        out[k].append(v)
                    made += 1
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k in ("piece", "turn") else pa.int64()) for k, v in out.items()})

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(cut, PIECES)


class Plan:
    """Slots by length: ranks [first, first + times) of ``length`` go to sequences
    ``sequence, sequence + 1, ...`` at ``offset``."""

    def __init__(self) -> None:
        self.slots: list[tuple[int, int, int, int, int]] = []  # length, first rank, times, sequence, offset
        self.sequences = 0
        self.used: dict[int, int] = {}

    def place(self, lengths: tuple[int, ...], sequence: int, times: int) -> None:
        offset = 0
        for n in lengths:
            first = self.used.get(n, 0)
            self.slots.append((n, first, times, sequence, offset))
            self.used[n] = first + times
            offset += n

    def add(self, lengths: tuple[int, ...], times: int) -> None:
        self.place(lengths, self.sequences, times)
        self.sequences += times


def _exact(gap: int, count: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths whose sum is ``gap``, the longest first."""
    if count[gap]:
        return (gap,)
    lengths = np.flatnonzero(count[: gap + 1])
    # pairs: the index of single lengths answers which complements exist
    first = lengths[lengths * 2 >= gap]
    rest = gap - first
    ok = (rest > 0) & (count[rest] > 0) & ((first != rest) | (count[first] > 1))
    if ok.any():
        a = int(first[ok][-1])
        return (a, gap - a)
    return None


def _exact_triple(gap: int, count: np.ndarray, pair_sums: np.ndarray) -> tuple[int, ...] | None:
    """``pair_sums`` marks the sums of two available lengths (it may be out of date)."""
    lengths = np.flatnonzero(count[:gap])
    for a in lengths[pair_sums[gap - lengths]][::-1].tolist():
        count[a] -= 1
        pair = _exact(gap - a, count)
        count[a] += 1
        if pair and len(pair) == 2:
            return (a, *pair)
    return None


def _sums_of_pairs(count: np.ndarray) -> np.ndarray:
    lengths = np.flatnonzero(count)
    out = np.zeros(len(count), bool)
    for a in lengths.tolist():
        b = a + lengths
        out[b[b < len(count)]] = True
    return out


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """A plan for ``counts`` pieces of each length; the number of sequences is kept small."""
    plan, count = Plan(), np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        if not 0 < n <= capacity:
            raise ValueError(f"a piece of {n} ids doesn't fit in {capacity}")
        count[n] = c
    left = np.zeros(capacity + 1, np.int64)  # for best fit
    pair_sums, stale = _sums_of_pairs(count), 0
    for n in range(capacity, 0, -1):
        while count[n]:
            if n == capacity:
                lengths: tuple[int, ...] | None = ()
            else:
                count[n] -= 1
                gap = capacity - n
                lengths = _exact(gap, count)
                if lengths is None:
                    lengths = _exact_triple(gap, count, pair_sums)
                count[n] += 1
            if lengths is None:
                left[n] += count[n]
                count[n] = 0
                break
            whole = (n, *lengths)
            need = {k: whole.count(k) for k in whole}
            times = int(min(count[k] // v for k, v in need.items()))
            plan.add(whole, times)
            for k, v in need.items():
                count[k] -= v * times
            stale += 1
            if stale % 512 == 0:
                pair_sums = _sums_of_pairs(count)
    _best_fit(plan, left, capacity)
    return plan


def _best_fit(plan: Plan, count: np.ndarray, capacity: int) -> None:
    """Best fit, longest first, on classes of equally filled sequences."""
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]  # by gap: (lengths, times) classes
    has = np.zeros(capacity + 1, bool)

    def put(gap: int, lengths: tuple[int, ...], times: int) -> None:
        open_[gap].append((lengths, times))
        has[gap] = True

    for n in np.flatnonzero(count)[::-1].tolist():
        todo = int(count[n])
        while todo and has[n:].any():
            gap = n + int(has[n:].argmax())  # the tightest
            lengths, times = open_[gap].pop()
            has[gap] = bool(open_[gap])
            use = min(times, todo)
            todo -= use
            if use < times:
                put(gap, lengths, times - use)
            put(gap - n, (*lengths, n), use)
        while todo:  # new sequences, filled with as many of this length as fit
            per = capacity // n
            full, part = divmod(todo, per)
            if full:
                put(capacity - per * n, (n,) * per, full)
            if part:
                put(capacity - part * n, (n,) * part, 1)
            todo = 0
    for classes in open_:
        for lengths, times in classes:
            plan.add(lengths, times)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32, turn) with sequence_id and offset, without turn.

    ``pieces`` is read three times and must be a stored table. Collected to the driver: one
    count per length, ``capacity`` at most.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(counts, capacity)
    order = np.array(plan.slots or np.zeros((0, 5)), np.int64)
    order = order[np.lexsort((order[:, 1], order[:, 0]))]
    base = int(order[:, 1].max(initial=0) + order[:, 2].max(initial=0) + 1)  # above every rank
    slots = spark.sparkContext.broadcast((order[:, 0] * base + order[:, 1], order))

    per = pieces.groupBy("length", "turn").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("length", "turn", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    local = Window.partitionBy("length", "turn").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("place", F.row_number().over(local) - 1).join(first, ["length", "turn"])
    keep = [c for c in pieces.columns if c != "turn"]
    ranked = ranked.select(*keep, (F.col("first") + F.col("place")).alias("rank"))

    def assign(batches):
        low, rows = slots.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(low, length * base + rank, "right") - 1
            found = rows[at]
            out = {k: batch.column(k) for k in keep}
            out["sequence_id"], out["offset"] = pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "turn")
    return ranked.mapInArrow(assign, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, style: str = "dropped_space") -> DataFrame:
    """Tokenize, cut and pack ``docs(doc_id, text)``; one row per piece."""
    pieces = runtime.stage_table(token_pieces(docs, tokenizer, end_id, capacity, style), "pieces")
    return pack(pieces, capacity)
