"""Near-duplicates and repeated passages against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prismlake.llm import components, metric_join, repeats, simhash

SCHEMA = "doc_id long, text string"


def least(edges, nodes):
    label = {n: n for n in nodes}

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(5, 5), (160, 100)]
    df = spark.createDataFrame([*edges, (None, 3), edges[0]], "a long, b long")
    got = {x["node"]: x["component"] for x in components.components(df).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == least([e for e in edges if e[0] != e[1]], nodes)
    assert components.components(df.limit(0)).count() == 0
    assert components.forest(np.array([0, 1, 4]), np.array([1, 2, 3]), 6).tolist() == [0, 0, 0, 3, 3, 5]


def clustered(n, clusters, flips, seed):
    r = np.random.default_rng(seed)
    x = (r.integers(0, 1 << 63, clusters, dtype=np.uint64) * np.uint64(2))[r.integers(0, clusters, n)]
    for _ in range(flips):
        on = r.random(n) < 0.6
        x[on] ^= np.uint64(1) << r.integers(0, 64, int(on.sum())).astype(np.uint64)
    return np.unique(x)


@pytest.mark.parametrize("n,clusters,flips,budget", [(900, 9, 3, 2), (600, 300, 2, 3), (700, 1, 2, 2), (200, 200, 1, 6), (1, 1, 0, 2)])
def test_trie_join_finds_every_link_once(n, clusters, flips, budget):
    x = clustered(n, clusters, flips, n)
    near = np.bitwise_count(x[:, None] ^ x[None]) <= budget
    whole = (np.array([0]), np.array([len(x)])) * 2
    got = [(int(a), int(b)) for i, j in simhash.trie_join(x, whole, budget, frontier=500) for a, b in zip(i, j)]
    assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == {(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b}
    m = len(x) // 2
    two = (np.array([0]), np.array([m]), np.array([m]), np.array([len(x)]))
    cross = {(int(a), int(b)) for i, j in simhash.trie_join(x, two, budget) for a, b in zip(i, j)}
    assert cross == {(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < m <= b}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def varied(seed, n=160):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choices(words, k=r.choice([1, 2, 30, 200]))) for _ in range(n // 4)]
    out = []
    for i in range(n):
        text = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            text[r.randrange(len(text))] = r.choice(words)
        out.append((i, " ".join(text)))
    return [*out, (n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "ÄÖ é"), (n + 3, "ÄÖ é"), (None, out[0][1])]


@pytest.mark.parametrize("bucket", [2048, 3])
def test_simhash_groups(spark, bucket):
    rows = varied(1)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rep", F.lit("clash")).repartition(5)
    got = simhash.simhash_groups(df, bucket=bucket).collect()
    assert len(got) == len(rows)
    prints = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    ids = sorted(prints)
    edges = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = least(edges, ids)
    assert bucket == 3 or any(prints[a] != prints[b] for a, b in edges)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [want[0]]
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_simhash_null_ids_link(spark):
    """A row without an id, near two others that aren't near each other, joins them."""
    texts = [" ".join(f"w{i}" for i in range(300))]
    r = random.Random(2)
    while len(texts) < 400:
        t = r.choice(texts).split()
        t[r.randrange(len(t))] = f"x{r.randrange(1000)}"
        texts.append(" ".join(t))
    prints = [plain_fingerprint(t) for t in texts]
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2
    chain = next((a, m, b) for m in range(400) for a in range(400) for b in range(a) if near(a, m) and near(m, b) and not near(a, b) and len({prints[a], prints[m], prints[b]}) == 3)
    a, m, b = (texts[i] for i in chain)
    rows = [(7, a), (None, m), (9, b), (None, "quite another text that nobody is near to")]
    got = {(x["doc_id"], x["component_id"]) for x in simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(7, 7), (None, 7), (9, 7), (None, None)}


def test_similar_groups_keep_one(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows, family = [], {}
    for f in range(30):
        base = r.choices(words, k=r.choice([3, 120, 400]))
        for c in range(r.choice([1, 2, 5])):
            text = list(base)
            if c and len(base) > 5:
                text[r.randrange(len(text))] = "changed"
            family[len(rows)] = f
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit(1))
    kept = simhash.keep_one(df.repartition(3))
    assert kept.columns == df.columns
    first = {}
    for i, f in family.items():
        first.setdefault(f, i)
    assert {r["doc_id"] for r in kept.collect()} == set(first.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (None, "a"), (3, "b"), (3, "b")], SCHEMA)
    assert sorted((r["doc_id"] or 0) for r in simhash.keep_one(odd).collect()) == [0, 0, 1, 3, 3]
    assert simhash.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [1024, 3])
def test_similar_groups_are_those_of_exact_jaccard(spark, bucket):
    r = random.Random(8)
    rows, sets = [], []
    for n in [8, 9, 10, 11, 13, 14, 24, 44, 104, 204] * 8:
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        for more in (0, (n - 4) // 4, (n - 4) // 4 + 1):  # at the limit or above it, and below it
            rows.append((len(rows), " ".join(base + [f"w{r.randrange(10**6)}" for _ in range(more)])))
        rows.append((len(rows), " ".join(base[: n // 2] + ["changed"] + base[n // 2 :])))
    for _, text in rows:
        w = text.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    edges = [(a, b) for b in range(len(rows)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert 80 <= len(edges) < 3 * 80
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert {g["doc_id"]: g["component_id"] for g in simhash.similar_groups(df, bucket=bucket).collect()} == least(edges, range(len(rows)))


def brute_repeats(texts, threshold):
    from collections import Counter

    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + threshold] for b in raw for i in range(len(b) - threshold + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - threshold + 1):
            if seen[b[i : i + threshold]] > 1:
                gone[i : i + threshold] = b"\1" * threshold
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed, alphabet="abcdé \n"):
    r = random.Random(seed)
    text = lambda n: "".join(r.choices(alphabet, k=n))
    shared = [text(n) for n in (90, 200, 500, 900)]
    rows = [text(r.randrange(30, 200)) + r.choice(shared) + text(r.randrange(0, 300)) + r.choice(shared)[r.randrange(0, 50) :] for _ in range(25)]
    return rows + [rows[0], rows[3][7:], None, "", "x", "ab" * 600, "a" * 1500, "a" * 700, text(2000)]


@pytest.mark.parametrize("threshold", [60, 100, 256, 400])
def test_repeats(spark, threshold):
    texts = passages(threshold) if threshold != 100 else passages(1, "ab")
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumns({c: F.lit("clash") for c in ("k1", "spans", "anchor")}).repartition(4)
    got = sorted(repeats.remove_repeats(df, threshold).collect())
    assert [tuple(r)[1:5] for r in got] == brute_repeats(texts, threshold)
    for r, text in zip(got, texts):
        assert r["text"] == (text or "") if not r["n_removed"] else len(r["text"].encode()) <= r["n_bytes"] - r["n_removed"]


@pytest.mark.parametrize("threshold", [60, 256])
def test_repeats_are_exact_whatever_the_fingerprints(spark, monkeypatch, threshold):
    whole = repeats.Prints.__init__

    def weak(self, *args):
        """Fingerprints of three bits, so that strangers share every bucket."""
        whole(self, *args)
        self.anchor, self.block = self.anchor & np.uint64(7), self.block & np.uint64(7)

    span = repeats.Prints.span
    monkeypatch.setattr(repeats.Prints, "__init__", weak)
    monkeypatch.setattr(repeats.Prints, "span", lambda self, *args: span(self, *args) & np.uint64(7))
    texts = passages(threshold + 1)[:14] + passages(threshold + 1)[25:32]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    # in this process: what Python workers would run with the patched class
    found = _spans_here(df, threshold)
    assert [found[i] for i in range(len(texts))] == [x[1:3] for x in brute_repeats(texts, threshold)]


def _spans_here(df, threshold):
    """(bytes removed, runs) by doc_id, with the passes' rows made in this process."""
    import pyarrow as pa

    spark, rows_of = df.sparkSession, repeats._rows

    def rows(keyed, schema, threshold, make, runs=None):
        kept = {}

        class Caught:
            def join(self, *_):
                return self

            def select(self, *_):
                return self

            def mapInArrow(self, each, schema):
                kept["each"] = each

        rows_of(Caught(), schema, threshold, make, None)
        source = keyed.select("k1", "k2", "text")
        if runs is not None:
            lists = runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "size", "n")).alias("runs"))
            source = source.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "runs")
        made = pa.Table.from_batches(kept["each"](source.toArrow().to_batches()))
        return spark.createDataFrame(made) if made.num_rows else spark.createDataFrame([], schema)

    patch = pytest.MonkeyPatch()
    patch.setattr(repeats, "_rows", rows)
    try:
        keyed = repeats.with_key(df)
        spans = {(r["k1"], r["k2"]): r["spans"] for r in repeats.repeated_spans(keyed, threshold).collect()}
    finally:
        patch.undo()
    out = {}
    for r in keyed.collect():
        found = spans.get((r["k1"], r["k2"]))
        gone = repeats.covered(found and tuple(np.array([x[c] for x in found]) for c in ("at", "size")), threshold)
        out[r["doc_id"]] = (sum(b - a for a, b in gone), len(gone))
    return out


def test_repeats_in_slices_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 64)
    texts = passages(9)
    data = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
    for low, high in repeats._slices(len(data[0]), 100):
        assert high - low <= 64 + 99
    assert [w for low, high in repeats._slices(300, 100) for w in range(low, high - 99)] == list(range(201))
    rows = [(1, "z" * 500), (1, "z" * 500), (None, "y" * 450), (None, "y" * 450), (2, "q" * 399)]
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 450), (0, 450), (1, 500), (1, 500), (2, 0)]
    assert repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeats.sizes(20)


def test_without_repeats(spark):
    shared = "é" * 300
    rows = [(1, "A" + shared + "B", 0), (2, "C" + shared + "D", 0), (3, None, 0), (4, "short", 5)]
    clash = ("spans", "_spans", "K1", "_k1", "k2", "__k2", "a.b", "a`b")
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({c: F.lit("clash") for c in clash})
    assert repeats.without_repeats(df, 256).columns == df.columns
    got = {r["doc_id"]: r for r in repeats.without_repeats(df, 256).collect()}
    assert (got[1]["text"], got[2]["text"], got[3]["text"], got[4]["text"]) == ("AB", "CD", None, "short")
    assert got[1]["n_chars"] == 2 and all(got[i][c] == "clash" for i in got for c in clash)


def test_vectors(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal((12, 8))
    x = base[r.integers(0, 12, 150)] + 0.12 * r.standard_normal((150, 8))
    x[10:14] = x[9]
    x[20] = 3 * x[21]
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [1.0, None] + [0.0] * 6), (904, [float("inf")] + [1.0] * 7), (905, [1.0, 0.0]), (906, [2.0, 0.1]), (907, []), (903, [1.0] * 8)]
    rows += [(None, (base[0] + 0.01).astype(np.float32).tolist()), (None, [3.0, 3.0, 1.0]), (None, [3.0, 3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("label", "m", "v", "rep", "cell")})
    con = duckdb.connect()
    import pyarrow as pa

    con.register("embeddings", pa.table({"vec_id": [i for i, _ in rows], "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32())), "label": [1] * len(rows)}))
    want = {}
    v = [(i, np.array(e, float)) if e and None not in e and np.isfinite(e).all() and any(e) else (i, None) for i, e in rows]
    edges = [(p, q) for p in range(len(v)) for q in range(p) if v[p][1] is not None and v[q][1] is not None and len(v[p][1]) == len(v[q][1]) and v[p][1] @ v[q][1] / np.linalg.norm(v[p][1]) / np.linalg.norm(v[q][1]) >= 0.9]
    degree = np.bincount(np.array(edges).ravel(), minlength=len(v))
    root = least(edges, range(len(v)))
    groups = {}
    for p in range(len(v)):
        groups.setdefault(root[p], []).append(v[p][0])
    name = lambda p: v[p][0] if v[p][1] is None else min((i for i in groups[root[p]] if i is not None), default=None)
    want = sorted(((v[p][0], int(degree[p]), name(p)) for p in range(len(v))), key=repr)
    for pivots, part in ((1, 1000), (6, 1000), (6, 7)):
        got = metric_join.near_vectors(df.repartition(3), pivots=pivots, part_size=part).collect()
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == want
        assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert metric_join.near_vectors(df.limit(0)).count() == 0
    assert metric_join.near_vectors(df.where("vec_id between 900 and 904")).count() == 6


def test_vectors_of_doubles_and_null_ids(spark):
    edge = [0.9, 0.43588989435406735]
    rows = [(1, [1e300, 0.0]), (2, [1.0, 0.0]), (3, edge), (4, [1e-300, 1e-300]), (5, [1.0, 1.0])]
    got = metric_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    cosine = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    unit = {i: np.array(e) / max(e) for i, e in rows}
    links = {i: sum(j != i and cosine(unit[i], unit[j]) >= 0.9 for j in unit) for i in unit}
    assert {r["vec_id"]: r["n_links"] for r in got} == links and links[1] >= 1 and links[4] >= 1
    rows = [(1, [1.0, 0.0]), (None, [0.95, 0.31]), (2, [0.81, 0.59])]
    got = metric_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got} == {(1, 1, 1, True), (None, 2, 1, False), (2, 1, 1, False)}
