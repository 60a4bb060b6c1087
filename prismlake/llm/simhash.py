"""SimHash fingerprints and near-duplicate groups by a binary trie self-join.

Fingerprints that are equal form one class. Classes are dealt by exact bands of the
fingerprint: with ``budget`` differing bits and ``budget + 1`` bands one band agrees, so that
each link meets in some bucket. A bucket is a sorted array, that is a binary trie with its
paths compressed. The self-join walks pairs of its nodes together: bits that differ in both
nodes' prefixes add up, a pair beyond the budget is pruned, and the larger node is split.
Buckets of more than ``bucket`` classes are cut into parts, each pair of parts a bucket of its
own, so that no task holds more than two parts. Tasks emit a spanning forest of the links
found, never all pairs.

Nulls: a null text is the empty text, whose fingerprint is zero; a null doc_id keeps its
fingerprint and links with others, but can't name a component (a group of such rows only has a
null component). Repeated rows come out as often
as they went in. An empty table gives an empty result. Further columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake import runtime
from prismlake.llm.components import components, forest

SEED = 42
LEAF = 32


def _shingles(text: str | None, words: int) -> list[bytes]:
    """Shingles of ASCII-lower-cased words between ASCII white space; fewer words: all of them."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(parts) - words + 1)
    return [joined[a:b] for a, b in zip(starts[:n].tolist(), (ends[min(words, len(parts)) - 1 :] - 1).tolist())]


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits: each set if more than half of the shingles' hashes have it, repeats included."""
    shingles = _shingles(text, words)
    if not shingles:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), ">u8", len(shingles))
    rows = h.view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 14):
        bits = np.unpackbits(rows[at : at + (1 << 14)], axis=1)
        for part in range(0, len(bits), 255):  # sums of up to 255 bits fit in a byte
            counts += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(rows)).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, f0): the fingerprint as a signed 64-bit integer."""
    runtime.bounded_arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "f0"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, f0 long")


def _common_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading bits that agree (64 if all)."""
    x = a ^ b
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 - np.frexp(high)[1], np.where(low > 0, 64 - np.frexp(low)[1], 64))


def _split(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First place in each sorted range whose ``bit`` (counted from the top) is one."""
    lo, hi = lo.copy(), hi.copy()
    shift = (63 - bit).astype(np.uint64)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        on = lo < hi
        one = np.zeros(len(lo), bool)
        one[on] = (x[mid[on]] >> shift[on] & np.uint64(1)).astype(bool)
        hi = np.where(on & one, mid, hi)
        lo = np.where(on & ~one, mid + 1, lo)
    return lo


def trie_join(x: np.ndarray, pairs: tuple[np.ndarray, ...], budget: int, frontier: int = 1 << 20):
    """Links within ``budget`` bits between sorted ranges of ``x``; yields arrays (i, j).

    ``pairs`` holds (a low, a high, b low, b high) of starting node pairs. A node paired with
    itself yields each link once.
    """
    stack = [np.stack([p.astype(np.int64) for p in pairs])]
    while stack:
        nodes = stack.pop()
        if nodes.shape[1] > frontier:
            half = nodes.shape[1] // 2
            stack += [nodes[:, :half], nodes[:, half:]]
            continue
        al, ah, bl, bh = nodes
        own = (al == bl) & (ah == bh)
        on = (ah > al) & (bh > bl) & ~(own & (ah - al < 2))
        al, ah, bl, bh, own = al[on], ah[on], bl[on], bh[on], own[on]
        if not len(al):
            continue
        ca, cb = _common_bits(x[al], x[ah - 1]), _common_bits(x[bl], x[bh - 1])
        shared = np.minimum(ca, cb)
        apart = np.bitwise_count((x[al] ^ x[bl]) >> np.minimum(64 - shared, 63).astype(np.uint64))
        apart[shared == 0] = 0
        on = apart <= budget
        al, ah, bl, bh, own, ca, cb = (v[on] for v in (al, ah, bl, bh, own, ca, cb))
        leaf = ((ah - al) * (bh - bl) <= LEAF) | ((ca == 64) & (cb == 64))
        if leaf.any():
            l_al, l_ah, l_bl, l_bh, l_own = (v[leaf] for v in (al, ah, bl, bh, own))
            width = l_bh - l_bl
            size = (l_ah - l_al) * width
            for some in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // frontier)) + 1):
                at = np.repeat(some, size[some])
                k = np.arange(len(at)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
                i, j = l_al[at] + k // width[at], l_bl[at] + k % width[at]
                near = (np.bitwise_count(x[i] ^ x[j]) <= budget) & (~l_own[at] | (i < j))
                yield i[near], j[near]
        al, ah, bl, bh, own, ca, cb = (v[~leaf] for v in (al, ah, bl, bh, own, ca, cb))
        if len(al):
            first = ca <= cb  # the node whose members part earlier is split
            lo, hi = np.where(first, al, bl), np.where(first, ah, bh)
            mid = _split(x, lo, hi, np.minimum(ca, cb))
            only = ~own
            a_side, b_side = only & first, only & ~first
            stack.append(
                np.concatenate(
                    [
                        np.stack([al[own], mid[own], al[own], mid[own]]),
                        np.stack([mid[own], ah[own], mid[own], ah[own]]),
                        np.stack([al[own], mid[own], mid[own], ah[own]]),
                        np.stack([al[a_side], mid[a_side], bl[a_side], bh[a_side]]),
                        np.stack([mid[a_side], ah[a_side], bl[a_side], bh[a_side]]),
                        np.stack([al[b_side], ah[b_side], bl[b_side], mid[b_side]]),
                        np.stack([al[b_side], ah[b_side], mid[b_side], bh[b_side]]),
                    ],
                    axis=1,
                )
            )


def bands(bits: int, number: int) -> list[tuple[int, int]]:
    """(shift, width) of ``number`` bands that together are all bits, from the top."""
    edges = [bits * k // number for k in range(number + 1)]
    return [(bits - b, b - a) for a, b in zip(edges, edges[1:])]


def dealt(classes: DataFrame, keys: list, bucket: int) -> DataFrame:
    """Deal ``classes`` to the buckets of each of ``keys`` (columns): band, value, i, j, side, ...

    Buckets with one member are left out. One of more than ``bucket`` members is cut into
    parts, and a member goes to every pair of parts that has its own.
    """
    rows = classes.withColumn("_b", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), v.alias("value")) for k, v in enumerate(keys)]))).select(*classes.columns, "_b.band", "_b.value")
    sizes = rows.groupBy("band", "value").agg(F.count("*").alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / bucket).cast("int")
    own = F.when(parts > 1, F.pmod(F.xxhash64("rep", "band"), parts).cast("int")).otherwise(0)
    rows = rows.join(sizes, ["band", "value"]).withColumn("_p", own).withColumn("_q", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.select(*classes.columns, "band", "value", F.least("_p", "_q").alias("i"), F.greatest("_p", "_q").alias("j"), (F.col("_p") > F.col("_q")).cast("int").alias("side"))


def bucket_links(rows: DataFrame, order: list[str], links, at_once: int = 1 << 16) -> DataFrame:
    """Spanning forests (a, b) of the links that ``links(columns, ranges)`` finds in buckets.

    Rows of a bucket meet in one task, sorted by ``order``; buckets, small by construction, are
    handled many at a time.
    """
    key = ["band", "value", "i", "j"]
    names = rows.columns
    sorted_rows = rows.repartition(*key).sortWithinPartitions(*key, "side", *order)

    def run(batches):
        held = None
        for batch in _chunks(batches, at_once):
            cols = {n: batch.column(n).to_numpy() for n in names}
            if held is not None:
                cols = {n: np.concatenate([held[n], cols[n]]) for n in names}
            change = np.zeros(len(cols["band"]), bool)
            change[1:] = np.any([cols[k][1:] != cols[k][:-1] for k in key], axis=0)
            last = int(np.flatnonzero(change)[-1]) if change.any() else 0
            held = {n: v[last:] for n, v in cols.items()}
            if last:
                yield from found({n: v[:last] for n, v in cols.items()})
        if held is not None:
            yield from found(held)

    def found(cols):
        n = len(cols["band"])
        change = np.ones(n, bool)
        change[1:] = np.any([cols[k][1:] != cols[k][:-1] for k in key], axis=0)
        low = np.flatnonzero(change)
        high = np.append(low[1:], n)
        ones = np.concatenate([[0], np.cumsum(cols["side"])])
        mid = high - (ones[high] - ones[low])  # side 1 comes behind side 0
        two = cols["i"][low] != cols["j"][low]
        ranges = (low, np.where(two, mid, high), np.where(two, mid, low), high)
        u, v = [], []
        reps, place = np.unique(cols["rep"], return_inverse=True)
        label = np.arange(len(reps))
        for a, b in links(cols, ranges):
            u.append(place[a])
            v.append(place[b])
            if sum(map(len, u)) > 1 << 21:
                label = forest(np.concatenate([*u, np.arange(len(reps))]), np.concatenate([*v, label]), len(reps))
                u, v = [], []
        label = forest(np.concatenate([*u, np.arange(len(reps))]), np.concatenate([*v, label]), len(reps))
        on = label != np.arange(len(reps))
        yield pa.RecordBatch.from_pydict({"a": pa.array(reps[on]), "b": pa.array(reps[label[on]])})

    return sorted_rows.mapInArrow(run, "a long, b long")


def _chunks(batches, rows: int):
    """Batches joined until they have ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def simhash_groups(docs: DataFrame, words: int = 3, budget: int = 2, bucket: int = 2048) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id that links reach.

    ``budget``: most differing bits of a link. ``bucket``: most classes in a part of a bucket.
    """
    files = runtime.text_files(docs)
    prints = runtime.stage_table(fingerprints(docs, words), "fingerprints", files=files)
    classes = runtime.stage_table(prints.groupBy("f0").agg(F.min("doc_id").alias("least")).withColumn("rep", F.col("f0")), "fingerprint-classes", files=files)
    keys = [F.shiftrightunsigned("f0", shift).bitwiseAND(F.lit((1 << width) - 1)) for shift, width in bands(64, budget + 1)]

    def links(cols, ranges):
        return trie_join(cols["f0"].view(np.uint64), ranges, budget)

    met = dealt(classes.select("f0", "rep").withColumn("_o", _unsigned("f0")), keys, bucket)
    edges = runtime.stage_table(bucket_links(met, ["_o"], links), "fingerprint-links", files=files)
    named = named_groups(classes, components(edges, "fingerprint-groups"), ["f0"])
    return prints.join(named, "f0", "left").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def named_groups(classes: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """``key`` of all ``classes(rep, least, ...)`` with ``component_id``, the least of all ``least``
    in the component of ``rep``; null if all are."""
    of = classes.join(groups, classes["rep"] == groups["node"], "left").select(*key, "least", F.coalesce("component", "rep").alias("component"))
    names = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return of.join(names, "component").select(*key, "component_id")


def _unsigned(name: str):
    """Sorts as the unsigned value does: the sign bit is turned."""
    return F.col(name).bitwiseXOR(F.lit(-(1 << 63)))


#: Of ``similar_groups``: longs of a wide fingerprint, how many of them a bucket compares, and the
#: most shingles by which small sets meet.
WIDE, COMPARED, PREFIX = 8, 4, 5
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, WIDE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, set(_shingles(text, words))), np.uint64)
    h.sort()
    return h


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash of a set: ``WIDE`` longs, each bit set if more than half of the members have it."""
    counts = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(h), 1 << 12):
        x = h[at : at + (1 << 12), None] * _MIX[0]
        x ^= x >> np.uint64(32)
        x *= _MIX[1]
        x ^= x >> np.uint64(29)
        bits = np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1)
        for part in range(0, len(bits), 255):  # sums of up to 255 bits fit in a byte
            counts += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h)).view(np.int64)


def prefix(n: int, similarity: float) -> int:
    """Of the least shingles of a set of ``n``, how many it takes to share one with the least of
    every set that has the similarity; 0 if more than ``PREFIX``."""
    need = n - math.ceil(similarity * n - 1e-9) + 1
    return need if need <= PREFIX else 0


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, c0, c1, n, f0, ..., s0, ...): 128 bits that name the set of shingles, its size, its
    fingerprint, and the least hashes (0 if there are fewer)."""
    runtime.bounded_arrow_batches(docs.sparkSession)
    names = ["c0", "c1", "n", *[f"f{k}" for k in range(WIDE)], *[f"s{k}" for k in range(PREFIX)]]

    def run(batches):
        for batch in batches:
            values = np.empty((batch.num_rows, len(names)), np.int64)
            for row, text in zip(values, batch.column(1).to_pylist()):
                h = shingle_set(text, words)
                row[:2], row[2], row[3 : 3 + WIDE] = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64), len(h), wide_fingerprint(h)
                row[3 + WIDE :] = np.pad(h[:PREFIX], (0, max(0, PREFIX - len(h)))).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(v)) for v in values.T]], ["doc_id", *names])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def table_shape(rows: int, share: float = 0.16, miss: float = 0.003) -> tuple[int, int]:
    """(tables, bits a table) for ``rows`` classes.

    A table holds some 1024 strangers in a bucket at most, so bits grow with log2 of the rows, 14
    at least. There are as many tables as it takes for a pair that differs in ``share`` of its
    bits (that is Jaccard 0.8) to agree in no table with a probability of ``miss``.
    """
    width = max(14, math.ceil(math.log2(max(rows, 1) / 1024)))
    return math.ceil(math.log(miss) / math.log(1 - (1 - share) ** width)), width


def most_differing(n: np.ndarray, m: np.ndarray, similarity: float, bits: int) -> np.ndarray:
    """Differing bits that sets of these sizes and this Jaccard similarity stay within.

    A bit differs with the angle between the sets over pi; four deviations are allowed, and 0.04
    of the bits more for small sets, where majorities aren't normally distributed.
    """
    both = np.minimum(similarity / (1 + similarity) * (n + m), np.minimum(n, m))
    share = np.arccos(np.clip(both / np.sqrt(n * m), 0, 1)) / math.pi + np.where(np.minimum(n, m) <= 16, 0.04, 0.005)
    return bits * share + 4 * np.sqrt(bits * share * (1 - share))


def tabled(classes: DataFrame, tables: int, width: int, similarity: float) -> DataFrame:
    """``classes(rep, n, f0, ..., s0, ...)`` once for each table: rep, n, f0 to f3, band, value.

    The last table is for small sets, of whose fingerprints too much is chance: they go to
    their least shingles, so that no pair is missed.
    """
    places = np.stack([np.random.default_rng([SEED, t]).permutation(64 * WIDE)[:width] for t in range(tables)])
    power = 1 << np.arange(width, dtype=np.int64)
    kept = ["rep", "n", *[f"f{k}" for k in range(COMPARED)]]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            f = np.stack([batch.column(f"f{k}").to_numpy() for k in range(WIDE)], 1)
            bits = np.unpackbits(f.view(np.uint8).reshape(len(f), -1), axis=1)
            value = np.stack([bits[:, p] @ power for p in places])
            least = np.stack([batch.column(f"s{k}").to_numpy() for k in range(PREFIX)], 1)
            own, k = np.nonzero(np.arange(PREFIX) < np.array([prefix(n, similarity) for n in batch.column("n").to_pylist()])[:, None])
            row = np.concatenate([np.tile(np.arange(len(f)), tables), own])
            out = {name: pa.array(batch.column(name).to_numpy()[row]) for name in kept}
            out["band"] = pa.array(np.concatenate([np.repeat(np.arange(tables), len(f)), np.full(len(own), tables)]).astype(np.int32))
            out["value"] = pa.array(np.concatenate([value.ravel(), least[own, k]]))
            yield pa.RecordBatch.from_pydict(out)

    return classes.select("rep", "n", *[f"f{k}" for k in range(WIDE)], *[f"s{k}" for k in range(PREFIX)]).mapInArrow(run, ", ".join(f"{k} long" for k in kept) + ", band int, value long")


def maybe_similar(classes: DataFrame, similarity: float, bucket: int) -> DataFrame:
    """Spanning forests (a, b) of the pairs that a table brings together and bits don't tell apart."""
    rows = tabled(classes, *table_shape(classes.count()), similarity)
    hot = runtime.stage_table(rows.groupBy("band", "value").agg(F.count("*").alias("size")).where(F.col("size") > bucket), "hot-buckets")
    first_bits = math.ceil(most_differing(np.array([5]), np.array([4]), similarity, 64)[0])

    def links(cols, ranges):
        f = [cols[f"f{k}"].view(np.uint64) for k in range(COMPARED)]
        for a, b in trie_join(f[0], ranges, first_bits):
            n, m = cols["n"][a], cols["n"][b]
            on = np.minimum(n, m) >= similarity * np.maximum(n, m)
            a, b, n, m = a[on], b[on], n[on], m[on]
            near = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in f) <= most_differing(n, m, similarity, 64 * COMPARED)
            yield a[near], b[near]

    # a hot bucket is cut into parts as in ``dealt``; the others, nearly all, need no look-up by shuffle
    parts = F.coalesce(F.ceil(F.col("size") / bucket), F.lit(1)).cast("int")
    own = F.when(parts > 1, F.pmod(F.xxhash64("rep", "band"), parts).cast("int")).otherwise(0)
    rows = rows.join(hot, ["band", "value"], "left").withColumn("p", own).withColumn("q", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = rows.select("rep", "n", *[f"f{k}" for k in range(COMPARED)], "band", "value", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), (F.col("p") > F.col("q")).cast("int").alias("side"))
    return bucket_links(met.withColumn("_o", _unsigned("f0")), ["_o"], links)


def alike(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, similarity: float):
    """Yield spanning links (a, b) of the ``sets`` of hashes with the Jaccard similarity, exactly:
    a is of ``first`` and b of ``second`` (places in ``sets``). Pairs that hang together already
    are not compared."""
    size = np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(size) - size
    there = np.concatenate([ids[start[b] : start[b] + size[b]] for b in second])
    begin = np.cumsum(size[second]) - size[second]
    marked, label = np.zeros(len(ids) + 1, bool), np.arange(len(sets))
    for a in first.tolist():
        big, small = np.maximum(size[a], size[second]), np.minimum(size[a], size[second])
        on = (label[second] != label[a]) & (small >= similarity * big)
        if not on.any():
            continue
        own = ids[start[a] : start[a] + size[a]]
        marked[own] = True
        both = np.add.reduceat(marked[there], begin, dtype=np.int64)
        marked[own] = False
        for b in second[on & (both >= similarity * (size[a] + size[second] - both))].tolist():
            if label[a] != label[b]:
                label[label == label[b]] = label[a]
                yield a, b


def exact_links(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Spanning links (a, b) inside each ``grp, i, j`` of ``rows(grp, i, j, side, rep, text)``: all
    members with each other if i is j, else side 0 with side 1."""
    key = ["grp", "i", "j"]

    def run(batches):
        at, reps, sides, sets = None, [], [], []

        def links():
            side = np.array(sides)
            every = np.arange(len(sets))
            first, second = (every, every) if at[1] == at[2] else (every[side == 0], every[side == 1])
            if len(first) and len(second) and len(sets) > 1:
                for a, b in alike(sets, first, second, similarity):
                    yield reps[a], reps[b]

        for batch in batches:
            out = []
            for *here, side, rep, text in zip(*(batch.column(c).to_pylist() for c in (*key, "side", "rep", "text"))):
                if here != at:
                    out += links() if sets else ()
                    at, reps, sides, sets = here, [], [], []
                reps.append(rep)
                sides.append(side)
                sets.append(shingle_set(text, words))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})
        out = list(links()) if sets else []
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return rows.repartition(*key).sortWithinPartitions(*key, "side", "rep").mapInArrow(run, "a long, b long")


#: Of groups in ``similar_groups``: members of each part, and how many shingles they have.
PART_SHINGLES = 1 << 20
LEADERS = 32


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, bucket: int = 1024) -> DataFrame:
    """doc_id, component_id for sets of word shingles with a Jaccard similarity of ``similarity``.

    Equal sets form one class. Candidates come from wide fingerprints (512 bits): tables of some
    bits each bring classes together, in a bucket the binary trie of the first 64 bits is
    joined with itself, and pairs that 256 bits don't tell apart hang together (``table_shape`` and
    ``most_differing`` say with which loss); small sets meet by their least shingles instead, all
    that are similar. Groups that hang together are then judged by their
    sets of shingles alone, taken from the texts again, so that no pair below the similarity
    is linked. Tasks emit spanning links, never all pairs.

    A group of more than ``bucket`` members is cut into parts. First each part is judged by
    itself, with some members of the group (the least hashes) in every part; then members are
    dealt anew by what hangs together, and only parts that aren't of one component meet.
    """
    docs = docs.where("doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "text")
    prints = runtime.stage_table(sketches(docs, words), "sketches", files=runtime.text_files(docs))
    longs = [*[f"f{k}" for k in range(WIDE)], *[f"s{k}" for k in range(PREFIX)]]
    classes = runtime.stage_table(prints.groupBy("c0", "c1", "n", *longs).agg(F.min("doc_id").alias("rep")), "sketch-classes")
    maybe = runtime.stage_table(maybe_similar(classes.where("n > 0"), similarity, bucket), "maybe-similar")
    wide = components(maybe, "wide-groups")

    members = classes.select("rep", "n").join(wide.selectExpr("node rep", "component grp"), "rep")
    shares = members.groupBy("grp").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("size") / bucket), F.ceil(F.col("shingles") / PART_SHINGLES)).cast("int").alias("parts")
    members = runtime.stage_table(members.join(shares.select("grp", "size", parts), "grp").groupBy("grp", "rep", "size", "parts").agg(F.sum("n").alias("n")), "group-members")
    texts = docs.withColumnRenamed("doc_id", "rep").join(members.select("rep"), "rep", "left_semi").distinct()

    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    leads = (F.col("parts") > 1) & (F.pmod(F.xxhash64("rep", F.lit(SEED)), F.lit(1 << 32)) * F.col("size") < LEADERS << 32)
    dealt_ = members.withColumn("i", F.explode(F.when(leads, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))))
    inside = dealt_.select("rep", "grp", F.col("i").cast("string").alias("i"), F.col("i").cast("string").alias("j"), F.lit(0).alias("side"))
    edges = runtime.stage_table(exact_links(inside.join(texts, "rep"), words, similarity), "links-in-parts")

    cut = members.where("parts > 1")
    if cut.limit(1).count():
        known = components(edges, "groups-in-parts").selectExpr("node rep", "component label")
        cut = cut.join(known, "rep", "left").select("grp", "rep", "n", F.coalesce("label", "rep").alias("label"))
        of = cut.groupBy("grp", "label").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
        of = of.withColumn("large", (F.col("size") * 2 > bucket) | (F.col("shingles") * 2 > PART_SHINGLES))
        kinds = of.withColumn("kind", F.when(F.col("large"), F.col("label").cast("string")).otherwise("")).groupBy("grp", "kind").agg(F.sum("size").alias("size"), F.sum("shingles").alias("shingles"))
        kinds = kinds.select("grp", "kind", parts)
        # one row per part: a name that says the component, or nothing if there are several
        named = kinds.groupBy("grp").agg(F.flatten(F.collect_list(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct("kind", k.alias("k"))))).alias("others"))
        cut = cut.join(of.select("grp", "label", "large"), ["grp", "label"]).withColumn("kind", F.when(F.col("large"), F.col("label").cast("string")).otherwise(""))
        cut = cut.join(kinds, ["grp", "kind"]).select("grp", "rep", "kind", own.alias("k")).join(named, "grp").withColumn("o", F.explode("others"))
        cut = cut.where("kind != o.kind or kind = ''").select("grp", "rep", F.concat_ws("/", "kind", "k").alias("p"), F.concat_ws("/", "o.kind", "o.k").alias("q"))
        across = cut.select("rep", "grp", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), (F.col("p") > F.col("q")).cast("int").alias("side"))
        edges = edges.union(runtime.stage_table(exact_links(across.join(texts, "rep"), words, similarity), "links-across-parts"))

    groups = components(edges, "similar-groups")
    found = classes.join(groups, classes["rep"] == groups["node"], "left").select("c0", "c1", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(found, ["c0", "c1"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group: the one with the least doc_id.

    Rows that share a doc_id are one document and stay or go together; rows without one stay.
    """
    gone = similar_groups(docs, words, similarity).where("doc_id != component_id").select("doc_id").distinct()
    gone = runtime.stage_table(gone, "near-copies")
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
