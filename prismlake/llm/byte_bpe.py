"""Byte-level BPE from a rank file, encoding by a two-tier lookup, and decoding.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is itself a
vocabulary entry, without any merge. Tier two: what misses is merged with a heap of
candidate pairs over a linked list of its bytes, lowest rank first, leftmost first.

The minimal perfect hash is built by hash-and-displace: entries fall into buckets by one part
of their 64-bit hash; the largest bucket first, each searches for a displacement that sends
its entries to free slots. A lookup is two array reads and one comparison of the stored key,
so it is exact: a string outside the vocabulary compares unequal.

Nulls and empty texts give no ids. Texts of any length are taken whole, one pre-token at a
time; a memo of pre-tokens, bounded by ``memo_entries``, spares repeats. Lone surrogates can't
occur in a Spark string. Repeated rows each get a row; further columns aren't read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from prismlake import runtime

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NO_RANK = 1 << 62


class MinimalPerfectHash:
    """Slots 0..n-1 for n distinct byte strings; -1 for any other string."""

    def __init__(self, keys: list[bytes], load: int = 4):
        self.n = len(keys)
        self.buckets = max(1, -(-self.n // load))
        self.shift = np.zeros(self.buckets, np.int64)
        self.keys: list[bytes] = [b""] * self.n
        self.value = np.zeros(self.n, np.int64)
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault((h >> 32) % self.buckets, []).append((h & 0xFFFFFFFF, i))
        taken = np.zeros(self.n, bool)
        for bucket, entries in sorted(groups.items(), key=lambda g: -len(g[1])):
            low = np.array([e[0] for e in entries], np.int64)
            for start in range(0, 1 << 26, 1024):
                slots = self._slot(low[None, :], np.arange(start, start + 1024)[:, None])
                free = ~taken[slots].any(1)
                if len(low) > 1:
                    free &= (np.diff(np.sort(slots, 1), axis=1) != 0).all(1)
                if free.any():
                    d = int(np.argmax(free))
                    break
            else:
                raise ValueError("no displacement found; are the keys distinct?")
            self.shift[bucket] = start + d
            taken[slots[d]] = True
            for slot, (_, i) in zip(slots[d].tolist(), entries):
                self.keys[slot], self.value[slot] = keys[i], i

    def _slot(self, low, d):
        """A hash of the lower half and the displacement; both fit in 58 bits when multiplied."""
        x = (low ^ (d * 0x9E3779B1 & 0xFFFFFFFF)) * 0x2C1B3C6D & 0x3FFFFFFFFFFFFFF
        x = (x ^ (x >> 29)) & 0xFFFFFFFF
        x = x * 0x297A2D39 & 0x3FFFFFFFFFFFFFF
        return ((x >> 13) & 0xFFFFFFFF) % max(1, self.n)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The value of each key, -1 where it isn't one of the set; the hash work is vectorised."""
        if not self.n or not keys:
            return np.full(len(keys), -1, np.int64)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        high, low = (h >> np.uint64(32)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
        slots = self._slot(low, self.shift[high % self.buckets])
        mine = self.keys
        same = np.fromiter((mine[s] == k for s, k in zip(slots.tolist(), keys)), bool, len(keys))
        return np.where(same, self.value[slots], -1)


class RankBpe:
    """Encoder and decoder for a rank file (``base64 rank`` lines)."""

    def __init__(self, path: str, pattern: str, memo_entries: int = 500_000):
        import regex

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        tokens = [base64.b64decode(a) for a, _ in pairs]
        self.ids = np.array([int(b) for _, b in pairs], np.int64)
        self.rank = dict(zip(tokens, self.ids.tolist()))
        self.whole = MinimalPerfectHash(tokens)
        self.token = dict(zip(self.ids.tolist(), tokens))
        self.find_pieces = regex.compile(pattern).findall
        self.limit, self.memo = memo_entries, {}

    def merge(self, piece: bytes) -> list[int]:
        """Tier two: a heap of (rank, place) over doubly linked symbols."""
        n = len(piece)
        symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank.get
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = symbol[i]
            j = after[i]
            if left is None or j >= n or len(left) + len(symbol[j]) != size:
                continue  # one of the two has been merged since
            left = symbol[i] = left + symbol[j]
            symbol[j] = None
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (r := rank(left + symbol[j])) is not None:
                    heapq.heappush(heap, (r, i, len(left) + len(symbol[j])))
            h = before[i]
            if h >= 0 and (r := rank(symbol[h] + left)) is not None:
                heapq.heappush(heap, (r, h, len(symbol[h]) + len(left)))
        return [self.rank[s] for s in symbol if s is not None]

    def _learn(self, pieces: list[str]) -> None:
        if len(self.memo) + len(pieces) > self.limit:
            self.memo.clear()
        raw = [p.encode() for p in pieces]
        for piece, data, at in zip(pieces, raw, self.whole.find(raw).tolist()):
            ids = [int(self.ids[at])] if at >= 0 else self.merge(data)
            self.memo[piece] = (np.array(ids, "<u4").tobytes(), b"".join([self.token[i] for i in ids]))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.find_pieces(text or "")
        known = list(map(self.memo.get, pieces))
        if None in known:
            missing = list({p for p, k in zip(pieces, known) if k is None})
            if len(missing) > self.limit // 2:
                return self._encode_slowly(pieces)
            self._learn(missing)
            known = list(map(self.memo.get, pieces))
            if None in known:  # the memo started anew
                return self._encode_slowly(pieces)
        return b"".join([ids for ids, _ in known])

    def _encode_slowly(self, pieces: list[str]) -> bytes:
        out = []
        for i in range(0, len(pieces), self.limit // 4):
            some = pieces[i : i + self.limit // 4]
            self.memo.clear()
            self._learn(list(set(some)))
            out += [self.memo[p][0] for p in some]
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for; an id outside the vocabulary is an error."""
        return b"".join(map(self.token.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> RankBpe:
    """One per Python worker."""
    return RankBpe(path, pattern)


def byte_bpe(docs: DataFrame, path: str, pattern: str, texts: bool = False) -> DataFrame:
    """Encode and decode whole texts: doc_id, n_tokens, digests of the ids and decoded bytes.

    ``texts`` adds the ids (array) and the decoded text itself.
    """
    runtime.bounded_arrow_batches(docs.sparkSession)

    def encode(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            out = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if texts else ()))}
            for text in batch.column(1).to_pylist():
                data = bpe.encode(text)
                ids = np.frombuffer(data, "<u4")
                back = bpe.decode(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(data).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                if texts:
                    out["ids"].append(ids.astype(np.int32).tolist())
                    out["decoded"].append(back.decode())
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(encode, RESULT + ", ids array<int>, decoded string" * texts)
