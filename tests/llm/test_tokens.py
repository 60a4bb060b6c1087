"""Chunked encoding, records, byte-level BPE, packing."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from prismlake.llm import byte_bpe, packing, token_records  # noqa: E402
from prismlake.llm.chunks import ChunkEncoder  # noqa: E402
from prismlake.llm.crc32c import crc32c, masked  # noqa: E402

ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n a", "x\n\n y's  'll 12 34", "\x1c a\x1cb \x1d", "é é ́x", "a\xa0b c", "İSTANBUL ΣΑΣ Σ DON'S It'S", "<|endoftext|> <|startoftext|>x",
    "日本 語 テスト", "a\tb \t c", "don't can'T I'LL", "　x 　y", " " * 50 + "a", "🏽👍🏽 👍", "​ a", "a \x85b", "ﬁ ① ½ ²", "THE!! DIE!! a,b;c: d.e", "word." * 300, "z" * 5000, "\x00\x01",
]
SCHEMA = "doc_id long, text string"


def library(name):
    """A tokenizer of the library that nothing here has touched."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def texts(spark):
    return [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


@pytest.mark.parametrize("name,style", [("byte_bpe_50k.json", "leading_space"), ("word_bpe_49k.json", "dropped_space")])
def test_chunks_give_the_ids_of_whole_texts(spark, name, style):
    fresh = library(name)
    for limit in (1_000_000, 7):
        e = ChunkEncoder(P.path(name), style, limit)
        for t in ODD + texts(spark)[: 60 if limit > 7 else 3]:
            assert np.frombuffer(e.encode(t), "<u4").tolist() == fresh.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name,style,end", [("byte_bpe_50k.json", "leading_space", 50256), ("word_bpe_49k.json", "dropped_space", 49407)])
def test_added_tokens_are_those_of_the_library(name, style, end):
    r, fresh, e = random.Random(3), library(name), ChunkEncoder(P.path(name), style)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "  ", "\n", "word", " Word's", "é", "12", "<|endof", "text|>", "."]
    met = 0
    for _ in range(2000):
        t = "".join(r.choices(parts, k=r.randrange(1, 9)))
        ids = np.frombuffer(e.encode(t), "<u4").tolist()
        assert ids == fresh.encode(t, add_special_tokens=False).ids
        met += end in ids
    assert met > 500


def slow_crc32c(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums():
    assert crc32c(np.frombuffer(b"123456789", np.uint8), [0], [9])[0] == 0xE3069283
    r = np.random.default_rng(0)
    data = r.integers(0, 256, 3000, dtype=np.uint8)
    s, n = r.integers(0, 2000, 30), r.integers(0, 1000, 30)
    assert crc32c(data, s, n).tolist() == [slow_crc32c(data[a : a + b].tolist()) for a, b in zip(s, n)]
    assert len(crc32c(data, [], [])) == 0 and crc32c(data, [3], [0])[0] == 0
    assert masked(np.array([0], np.uint32))[0] == 0xA282EAD8


def test_frames_in_any_order_and_corruption():
    payloads = [b"", b"x", bytes(range(256)) * 5, b"yz" * 300]
    data, offsets = token_records.frame(payloads)
    index = np.zeros(4, token_records.ENTRY)
    index["offset"], index["length"] = offsets, [len(p) for p in payloads]
    assert token_records.unframe(data, index) == payloads
    assert token_records.unframe(data, index[::-1]) == payloads[::-1]
    assert token_records.unframe(b"", index[:0]) == []
    for at in (3, 9, len(data) - 1, int(offsets[2]) + 20):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(bytes(bad), index)
    with pytest.raises(ValueError):
        token_records.unframe(data[:-9], index)


def test_records(spark):
    rows = [(5, "b b"), (1, None), (3, ""), (2, "日本"), (9, "x " * 3000), (5, "b b"), (None, "n"), (4, "end <|endoftext|> next")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("start", "n_tokens", "part")})
    got = token_records.token_records(df.repartition(3), P.path("byte_bpe_50k.json")).collect()
    fresh = library("byte_bpe_50k.json")
    start = 0
    for (doc_id, text), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), sorted(got, key=lambda r: r["start"])):
        ids = fresh.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_records.token_records(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_perfect_hash():
    for n in (0, 1, 2, 5, 3000):
        keys = [f"key{i}".encode() for i in range(n)]
        h = byte_bpe.MinimalPerfectHash(keys)
        assert h.find(keys).tolist() == list(range(n)) and (h.find([b"other", b""]) == -1).all()
        assert sorted(h.value.tolist()) == list(range(n))


def test_byte_bpe_is_that_of_the_library(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    bpe = byte_bpe.codec(path, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.rank, special_tokens={})
    for t in ODD + texts(spark)[:60] + ["".join(random.Random(i).choices("abcé日 \n'1", k=400)) for i in range(20)]:
        ids = np.frombuffer(bpe.encode(t), "<u4")
        assert ids.tolist() == enc.encode_ordinary(t or "") and bpe.decode(ids) == (t or "").encode()
    small = byte_bpe.RankBpe(path, P.PATTERN, memo_entries=8)
    assert small.encode("a b c d e f g h i j k " * 5) == bpe.encode("a b c d e f g h i j k " * 5)


def test_byte_bpe_query(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(0, None), (None, "x")], SCHEMA).withColumns({c: F.lit("clash") for c in ("decoded", "n_tokens", "ids")})
    got = byte_bpe.byte_bpe(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, texts=True).collect()
    assert len(got) == len(ODD) + 2
    assert all(r["decoded"] == (ODD[r["doc_id"]] or "") for r in got if r["doc_id"] is not None)
    assert byte_bpe.byte_bpe(df.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_plans_are_whole_and_tight(seed):
    r = random.Random(seed)
    cap = r.choice([8, 64, 512])
    lengths = [r.randint(1, cap) for _ in range(r.choice([0, 1, 40, 4000]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.plan_packing(counts, cap)
    fill, seen = np.zeros(plan.sequences, int), {}
    for n, first, times, sequence, offset in plan.slots:
        assert first == seen.get(n, 0)
        seen[n] = first + times
        fill[sequence : sequence + times] += n
    assert seen == counts and (fill <= cap).all()
    assert plan.sequences <= -(-sum(lengths) // cap) * 1.25 + 2


def test_exact_fills_are_found():
    assert packing.plan_packing({5: 1, 3: 1, 2: 2, 4: 1, 1: 4}, 10).sequences == 2
    assert packing.plan_packing({7: 2, 1: 4, 2: 1}, 10).sequences == 2
    assert packing.plan_packing({10: 3}, 10).sequences == 3
    with pytest.raises(ValueError):
        packing.plan_packing({11: 1}, 10)


def test_packing(spark):
    rows = [(i, "word " * n) for i, n in enumerate([0, 1, 5, 9, 40, 200, 3])] + [(1, "word "), (1, "word "), (7, None), (None, "a b"), (8, "a <|endoftext|>b")] + [(None, "same")] * 40
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("length", "piece", "_salt", "_rank", "turn")})
    got = packing.pack_documents(df.repartition(4), P.path("word_bpe_49k.json"), capacity=16).collect()
    fresh = library("word_bpe_49k.json")
    ids_of = lambda t: fresh.encode(t or "", add_special_tokens=False).ids + [1]
    assert sum(r["length"] for r in got) == sum(len(ids_of(t)) for _, t in rows)
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in got if r["piece"] == 0) == sorted((i or -1, zlib.crc32(np.array(ids_of(t)[:16], "<u4").tobytes())) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["start"] == 16 * r["piece"]
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 16
    ids = ids_of("word " * 200)
    long = sorted((r for r in got if r["doc_id"] == 5), key=lambda r: r["piece"])
    assert [r["ids_crc32"] for r in long] == [zlib.crc32(np.array(ids[k : k + 16], "<u4").tobytes()) for k in range(0, len(ids), 16)]
    assert packing.pack_documents(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


def fewest(lengths, capacity):
    """Fewest sequences, by trying every way to fill the one that holds the longest piece."""
    import functools
    from itertools import combinations

    @functools.lru_cache(maxsize=None)
    def best(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        options = {tuple(some) for n in range(len(rest) + 1) for some in combinations(rest, n) if first + sum(some) <= capacity}
        out = len(left)
        for some in options:
            others = list(rest)
            for x in some:
                others.remove(x)
            out = min(out, 1 + best(tuple(others)))
        return out

    return best(tuple(sorted(lengths, reverse=True)))


def test_plans_against_the_optimum():
    r, more = random.Random(5), 0
    for _ in range(60):
        cap = r.choice([10, 16])
        lengths = [r.randint(1, cap) for _ in range(r.randrange(1, 9))]
        got = packing.plan_packing({n: lengths.count(n) for n in set(lengths)}, cap).sequences
        want = fewest(lengths, cap)
        assert want <= got <= want + 1
        more += got - want
    assert more <= 3
