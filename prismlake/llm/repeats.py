"""Repeated passages by a depth-limited radix sort of suffixes.

Only the order of suffixes through the first ``threshold`` bytes matters: two suffixes that
agree so far belong to one group, and the groups are exactly the repeated windows. The sort
goes most significant digit first, and a suffix that is alone in its bucket leaves it:

1. First pass, two digits. The first is the block (a third of the window) inside the window with the
   least fingerprint (the leftmost, if alike). It depends on the window's bytes alone, so equal
   windows have equal first digits at equal places. Neighbouring windows mostly share it; such a
   run of suffixes is one row, until a later digit tells its members apart. The second digit is
   all bytes that the suffixes of a run cover: runs that agree repeat as a whole, and one of
   them goes on.
2. Second pass, in buckets that hold several kinds of run: runs are cut into blocks of
   ``PLACES`` suffixes. First the bytes that every window of a block holds, then all its bytes.
3. Third pass, in buckets of the second that hold several kinds of block: each suffix by
   itself, with all ``threshold`` bytes.

The digits that deal suffixes to buckets are 64-bit fingerprints of their bytes, made by
doubling (the fingerprint of 2n bytes mixes those of its halves). They only narrow the search:
a collision puts strangers in one bucket. The digit that decides what is equal is a 128-bit
BLAKE2 digest of all the bytes themselves, together with their place before the anchor, so that
a group holds equal windows whatever the fingerprints do (a test uses fingerprints of three
bits). Buckets are counted with map-side combining and joined by sort-merge join, whose skewed
partitions Spark splits; no bucket is ever collected in one task.

Texts are UTF-8 bytes; null and short texts have no window and come back whole. Repeated rows
repeat each other. Very long texts are handled in slices that overlap by a window. An empty
table gives an empty result. ``remove_repeats`` reads no columns besides doc_id and text;
``without_repeats`` carries all others, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake import runtime

PLACES = 16
SLICE = 1 << 20
HELD_ROWS = 1 << 17

KEY = ["k1", "k2"]
RUNS = "k1 long, k2 long, at int, size int, anchor long, place int, high long, low long"
BLOCKS = "k1 long, k2 long, at int, size int, anchor long, block int, shared long, place int, high long, low long, n long"
WINDOWS = "k1 long, k2 long, at int, anchor long, place int, high long, low long, n long"
#: What tells the members of a bucket apart: the place before the anchor and the digest.
KIND = ["place", "high", "low"]

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_S = np.uint64(32)


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _A
    x += right * _B
    x ^= x >> _S
    x *= _C
    x ^= x >> _S
    return x


def doubled(data: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Fingerprints of all substrings of the given lengths (powers of two) by start."""
    table = (np.arange(1, 257, dtype=np.uint64) * _B) ^ _C
    table = _mix(table, table[::-1].copy())
    x, n, out = table[data], 1, {}
    while n < max(sizes):
        if len(x) <= n:
            x = x[:0]
        else:
            x = _mix(x[:-n], x[n:])
        n *= 2
        if n in sizes:
            out[n] = x
    return out


def _leftmost_minimum(key: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the smallest of ``width`` neighbours, the leftmost if alike."""
    bits = np.uint64(21)  # a slice has fewer than 2**21 places
    x = (key >> bits << bits) | np.arange(len(key), dtype=np.uint64)
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    if n < width:
        x = np.minimum(x[: len(x) - (width - n)], x[width - n :])
    return (x & np.uint64((1 << 21) - 1)).astype(np.int64)


def sizes(threshold: int) -> tuple[int, int]:
    """Bytes of the first digit, and of the blocks that longer digits are made of: the largest
    powers of two up to a third of the window, and up to what all windows of a block share."""
    shared = threshold - PLACES + 1
    if shared < 32:
        raise ValueError(f"the threshold is {31 + PLACES} bytes at least")
    return 1 << ((threshold // 3).bit_length() - 1), 1 << (shared.bit_length() - 1)


class Prints:
    """Fingerprints of substrings of one slice."""

    def __init__(self, data: np.ndarray, threshold: int):
        size, self.step = sizes(threshold)
        h = doubled(data, (size, self.step))
        self.data, self.anchor, self.block, self.threshold = data, h[size], h[self.step], threshold
        self.owner = _leftmost_minimum(self.anchor, threshold - size + 1)

    def span(self, at: np.ndarray, length: int) -> np.ndarray:
        """Fingerprints of ``length`` (a block at least) bytes from ``at``: blocks that cover every byte."""
        block, step = self.block, self.step
        out = _mix(block[at], np.full(len(at), length, np.uint64))
        for k in range(step, length, step):
            out = _mix(out, block[at + min(k, length - step)])
        return out

    def digests(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two longs that stand for the ``length`` bytes from ``at``."""
        view = memoryview(self.data)
        raw = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(at.tolist(), (at + length).tolist())])
        x = np.frombuffer(raw, np.int64).reshape(-1, 2)
        return x[:, 0], x[:, 1]

    def runs(self) -> tuple[np.ndarray, ...]:
        """(first start, number of starts, first digit, place, digest) of all runs."""
        first = np.concatenate([[0], np.flatnonzero(np.diff(self.owner)) + 1])
        size = np.diff(np.append(first, len(self.owner)))
        place = self.owner[first] - first
        return first, size, self.anchor[self.owner[first]], place, *self.digests(first, self.threshold - 1 + size)

    def blocks(self, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first start, number of starts, first digit, block, shared bytes, place, digest, run) of
        runs cut at multiples of ``PLACES`` places before the anchor. Every window of a block holds
        its shared bytes; all its windows together cover the bytes of the digest."""
        anchor = self.owner[first]
        high, low = anchor - first, anchor - first - size + 1  # places of the first and last start
        per = high // PLACES - low // PLACES + 1
        run = np.repeat(np.arange(len(first)), per)
        block = high[run] // PLACES - (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
        top, bottom = np.minimum(high[run], block * PLACES + PLACES - 1), np.maximum(low[run], block * PLACES)
        at, count = anchor[run] - top, top - bottom + 1
        shared = self.span(anchor[run] - block * PLACES, self.threshold - PLACES + 1)
        return at, count, self.anchor[anchor[run]], block, shared, top, *self.digests(at, self.threshold - 1 + count), run

    def windows(self, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, first digit, place of the anchor, digest, run) of every suffix."""
        run = np.repeat(np.arange(len(first)), size)
        at = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        owner = self.owner[at]
        return at, self.anchor[owner], owner - at, *self.digests(at, np.full(len(at), self.threshold)), run


def _slices(size: int, threshold: int):
    """Slices that hold each window once."""
    for at in range(0, max(1, size - threshold + 1), SLICE):
        yield at, min(size, at + SLICE + threshold - 1)


def _column(parts: list[np.ndarray], kind) -> pa.Array:
    """One Arrow column; fingerprints become signed 64-bit integers."""
    x = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, kind)


def _lists(column: pa.Array, fields: tuple[str, ...]) -> list[tuple[np.ndarray, ...] | None]:
    """Each row's list of structs as arrays of the fields; None for null. Without Python objects
    for the elements, of which a row may have very many."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    flat = column.flatten()
    values = [flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [tuple(v[e - n : e] for v in values) if ok else None for n, e, ok in zip(sizes.tolist(), ends.tolist(), valid.tolist())]


def with_key(docs: DataFrame) -> DataFrame:
    """``docs`` as (doc_id, k1, k2, text).

    The key is the doc_id and a hash of the text. Rows that share it have equal texts, so
    they repeat each other and have the same spans: they need not be told apart.
    """
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k1"), F.xxhash64("text").alias("k2"), "text")


def _rows(keyed: DataFrame, schema: str, threshold: int, make, runs: DataFrame | None = None) -> DataFrame:
    """Suffix rows of ``schema`` (key, at, ...) that ``make(prints, runs of the slice)`` gives.

    ``runs`` (key, at, size, n) restricts the texts to some of their suffixes.
    """
    fields = [f.strip().split() for f in schema.split(",")]
    kinds = [{"long": pa.int64(), "int": pa.int32()}[kind] for _, kind in fields]

    def rows(out):
        return pa.RecordBatch.from_arrays([_column(x, k) for x, k in zip(out, kinds)], [name for name, _ in fields])

    def each(batches):
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            held = 0
            given = _lists(batch.column(3), ("at", "size", "n")) if batch.num_columns > 3 else [None] * batch.num_rows
            for k1, k2, text, where in zip(*(batch.column(i).to_pylist() for i in range(3)), given):
                data = np.frombuffer((text or "").encode(), np.uint8)
                if held > HELD_ROWS:
                    yield rows(out)
                    out, held = [[] for _ in fields], 0
                for low, high in _slices(len(data), threshold):
                    if high - low < threshold:
                        continue
                    if where is None:
                        columns = make(Prints(data[low:high], threshold), None, None, None)
                    else:
                        here = (where[0] >= low) & (where[0] < low + SLICE)
                        if not here.any():
                            continue
                        columns = make(Prints(data[low:high], threshold), where[0][here] - low, where[1][here], where[2][here])
                    m = len(columns[0])
                    held += m
                    for into, x in zip(out, (np.full(m, k1), np.full(m, k2), columns[0] + low, *columns[1:])):
                        into.append(x)
            yield rows(out)

    source = keyed.select(*KEY, "text")
    if runs is not None:
        lists = runs.groupBy(*KEY).agg(F.collect_list(F.struct("at", "size", "n")).alias("runs"))
        source = source.join(lists, KEY).select(*KEY, "text", "runs")
    return source.mapInArrow(each, schema)


def _sift(rows: DataFrame, bucket: list[str], name: str) -> DataFrame:
    """One pass: of ``rows``, those whose bucket has others, stored with ``total`` (members of
    their kind) and ``open`` (the bucket has several kinds, one of them alone)."""
    whole = list(dict.fromkeys([*bucket, *KIND]))
    kinds = rows.groupBy(*whole).agg(F.sum("n").alias("total"))
    live = kinds.groupBy(*bucket).agg(F.count("*").alias("kinds"), F.sum("total").alias("members"), F.min("total").alias("least")).where("members > 1")
    marks = kinds.join(live, bucket).select(*whole, "total", F.expr("kinds > 1 and least = 1").alias("open")).where("total > 1 or open")
    return runtime.stage_table(rows.join(marks, whole), name, files=runtime.few_files(rows.sparkSession, rows.count()))


def _open(sifted: DataFrame, bucket: list[str]) -> DataFrame:
    """One row of each kind in open buckets, with the number that it stands for."""
    one = F.min(F.struct(*KEY, "at", "size")).alias("one")
    return sifted.where("open").groupBy(*bucket, *KIND).agg(one, F.max("total").alias("n")).select("one.*", "n")


def _whole(sifted: DataFrame) -> DataFrame:
    """Rows that repeat as a whole; those standing for several were found so before."""
    return sifted.where("n = 1 and total > 1").select(*KEY, "at", "size")


def repeated_spans(keyed: DataFrame, threshold: int) -> DataFrame:
    """Runs of starts whose windows all repeat: the key and ``spans``, an array of (at, size)."""
    sizes(threshold)
    runtime.bounded_arrow_batches(keyed.sparkSession)

    def all_runs(prints, *_):
        return prints.runs()

    def cut_runs(prints, at, size, n):
        *columns, run = prints.blocks(at, size)
        return *columns, n[run]

    def suffixes(prints, at, size, n):
        *columns, run = prints.windows(at, size)
        return *columns, n[run]

    files = runtime.text_files(keyed)
    runs = runtime.stage_table(_rows(keyed, RUNS, threshold, all_runs), "suffix-runs", files=files)
    deal = ["anchor"]
    first = _sift(runs.withColumn("n", F.lit(1)), deal, "suffix-pass-1")
    runtime.drop_staged(runs)
    blocks = runtime.stage_table(_rows(keyed, BLOCKS, threshold, cut_runs, _open(first, deal)), "suffix-blocks", files=files)
    deal = ["anchor", "block", "shared"]
    second = _sift(blocks, deal, "suffix-pass-2")
    runtime.drop_staged(blocks)
    windows = runtime.stage_table(_rows(keyed, WINDOWS, threshold, suffixes, _open(second, deal)), "suffix-windows", files=files)
    third = _sift(windows.withColumn("size", F.lit(1)), ["anchor", "place"], "suffix-pass-3")
    runtime.drop_staged(windows)
    # rows that share a key have the same spans: each span once, however many rows there are
    found = _whole(first).unionByName(_whole(second)).unionByName(_whole(third)).distinct()
    return found.groupBy(*KEY).agg(F.collect_list(F.struct("at", "size")).alias("spans"))


def covered(spans: tuple[np.ndarray, np.ndarray] | None, threshold: int) -> list[tuple[int, int]]:
    """Maximal runs [begin, end) of bytes that the windows of ``spans`` (at, size) cover."""
    if spans is None or not len(spans[0]):
        return []
    begin = spans[0]
    end = begin + spans[1] + threshold - 1
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)
    return list(zip(begin[new].tolist(), end[last].tolist()))


def _cut(data: bytes, gone: list[tuple[int, int]]) -> list[bytes]:
    """What is left of ``data`` outside of the runs ``gone``."""
    at, kept = 0, []
    for begin, end in gone:
        kept.append(data[at:begin])
        at = end
    kept.append(data[at:])
    return kept


def _text(kept: list[bytes]) -> str:
    """The pieces as one text, without the characters that were cut inside."""
    return "".join([k.decode(errors="ignore") for k in kept])


def remove_repeats(docs: DataFrame, threshold: int = 400) -> DataFrame:
    """Remove every byte that a repeated ``threshold``-byte string covers.

    Result: doc_id, n_bytes (of the input), n_removed, n_spans, kept_sha256 (of the bytes that are
    left) and text, what is left to read: those bytes without characters that were cut inside.
    """
    keyed = with_key(docs)
    spans = repeated_spans(keyed, threshold)

    def cut(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(batch.column(1).to_pylist(), _lists(batch.column(2), ("at", "size"))):
                data = (text or "").encode()
                gone = covered(found, threshold)
                kept = _cut(data, gone)
                rest = b"".join(kept)
                for into, x in zip(out, (len(data), len(data) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), _text(kept) if gone else text or "")):
                    into.append(x)
            cols = [pa.array(x, pa.int64()) for x in out[:3]] + [pa.array(x, pa.string()) for x in out[3:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    joined = keyed.join(spans, KEY, "left").coalesce(runtime.text_files(docs)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def without_repeats(docs: DataFrame, threshold: int) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; ``n_chars``, if there, is counted anew.

    A character that is cut inside goes as a whole. Rows keep their other columns, and stay even
    if nothing is left of their text.
    """
    k1, k2, spans_ = runtime.free_names(docs, "k1", "k2", "spans")
    keyed = docs.withColumns({k1: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), k2: F.xxhash64("text")})
    spans = repeated_spans(keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), "text"), threshold).withColumnsRenamed({"k1": k1, "k2": k2, "spans": spans_})
    joined = keyed.join(spans, [k1, k2], "left").select(*runtime.columns(docs), spans_).coalesce(runtime.text_files(docs))
    names = docs.columns
    at, last = names.index("text"), len(names)

    def cut(batches):
        for batch in batches:
            found = _lists(batch.column(last), ("at", "size"))
            texts = [text if spans is None else _text(_cut(text.encode(), covered(spans, threshold))) for text, spans in zip(batch.column(at).to_pylist(), found)]
            columns = list(batch.columns[:last])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:last])

    out = runtime.map_in_arrow(joined, cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
