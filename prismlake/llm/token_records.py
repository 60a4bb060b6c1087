"""Token ids as length-delimited binary records with an offset index.

File format, all integers little-endian. A record is framed as
``length u64 | masked crc32c of length u32 | payload | masked crc32c of payload u32``.
The payload is ``version u8 | width u8 | has_id u8 | 0 u8 | doc_id i64 | ids``, each id in
``width`` bytes (2 where the vocabulary allows it, else 4). Beside each shard
``*.rec`` lies ``*.idx``: one entry ``frame offset u64 | payload length u64`` per record, by
which a reader can fetch records in any order.

Documents are range-partitioned by doc_id and sorted, so the shards in order of their
partition number hold them in ascending order. A shard's name is new in every task attempt
and only the manifest rows that Spark commits name it: a task that is run again, after the
loss of an executor, leaves at worst a file that nothing points to.

Nulls: a null text is the empty text; a null doc_id sorts first and is kept as null. Repeated
rows are written as often as they come. An empty table gives no shard. Columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake import runtime
from prismlake.llm.chunks import encoder
from prismlake.llm.crc32c import crc32c, masked

HEAD = "<BBBxq"
ENTRY = np.dtype([("offset", "<u8"), ("length", "<u8")])
MANIFEST = "part int, shard string, records long, tokens long"
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long"
WRITE_BUFFER = 8 << 20
MEMO_ENTRIES = 2_000_000  # of some 200 bytes, in each worker


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The framed payloads and the offset of each frame."""
    lengths = np.array([len(p) for p in payloads], np.int64)
    heads = lengths.astype("<u8")
    head_crc = masked(crc32c(heads.view(np.uint8), np.arange(len(heads)) * 8, np.full(len(heads), 8)))
    body = np.frombuffer(b"".join(payloads), np.uint8)
    body_crc = masked(crc32c(body, np.cumsum(lengths) - lengths, lengths))
    out = bytearray()
    for p, n, a, b in zip(payloads, heads.tolist(), head_crc.tolist(), body_crc.tolist()):
        out += struct.pack("<QI", n, a) + p + struct.pack("<I", b)
    return bytes(out), np.cumsum(lengths + 16) - (lengths + 16)


def unframe(data: bytes, index: np.ndarray) -> list[bytes]:
    """Payloads of the frames that ``index`` names, every checksum verified."""
    raw = np.frombuffer(data, np.uint8)
    at, size = index["offset"].astype(np.int64), index["length"].astype(np.int64)
    if len(at) and (at + size + 16).max() > len(raw):
        raise ValueError("a record file is shorter than its index says")

    def u32(where: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(raw[where[:, None] + np.arange(4)]).view("<u4").ravel() if len(where) else np.zeros(0, "<u4")

    lengths = np.ascontiguousarray(raw[at[:, None] + np.arange(8)]).view("<u8").ravel() if len(at) else np.zeros(0, "<u8")
    good = (lengths == size) & (u32(at + 8) == masked(crc32c(raw, at, np.full(len(at), 8)))) & (u32(at + 12 + size) == masked(crc32c(raw, at + 12, size)))
    if not good.all():
        raise ValueError(f"corrupt record {int(np.argmin(good))}")
    return [data[a + 12 : a + 12 + n] for a, n in zip(at.tolist(), size.tolist())]


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, style: str = "leading_space") -> DataFrame:
    """Encode ``docs(doc_id, text)``, write shards under ``folder``, return the manifest."""
    runtime.bounded_arrow_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        fs, path = runtime.open_store(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        enc, out, entries, pos, tokens = encoder(tokenizer, style, MEMO_ENTRIES), None, [], 0, 0
        width = 2 if max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            payloads = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(enc.encode(text) + end, "<u4")
                tokens += len(ids)
                payloads.append(struct.pack(HEAD, 1, width, doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes())
            if not payloads:
                continue
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}.rec", buffer_size=WRITE_BUFFER)
            data, offsets = frame(payloads)
            out.write(data)
            entry = np.zeros(len(payloads), ENTRY)
            entry["offset"], entry["length"] = offsets + pos, [len(p) for p in payloads]
            entries.append(entry)
            pos += len(data)
        if out is not None:
            out.close()
            index = np.concatenate(entries)
            with fs.open_output_stream(f"{path}/{name}.idx") as f:
                f.write(index.tobytes())
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": [f"{folder}/{name}"], "records": [len(index)], "tokens": [tokens]})

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    return runtime.stage_table(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """``manifest`` with ``start``: the ids of all shards before. One row per shard goes into it."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_records(manifest: DataFrame, batch: int = 512) -> DataFrame:
    """One row per record, read from the files: doc_id, start, n_tokens and the ids' CRC-32.

    A shard is read in file order, so each start is that of its shard plus what has been read.
    """

    def read(batches):
        for rows in batches:
            for row in rows.to_pylist():
                fs, path = runtime.open_store(row["shard"])
                with fs.open_input_stream(f"{path}.idx") as f:
                    index = np.frombuffer(f.read(), ENTRY)
                start = row["start"]
                with fs.open_input_file(f"{path}.rec") as f:
                    for i in range(0, len(index), batch):
                        some = index[i : i + batch].copy()
                        begin, last = int(some["offset"][0]), some[-1]
                        data = f.read_at(int(last["offset"]) + int(last["length"]) + 16 - begin, begin)
                        some["offset"] -= np.uint64(begin)
                        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32")}
                        for payload in unframe(data, some):
                            _, width, has_id, doc_id = struct.unpack_from(HEAD, payload)
                            ids = np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(HEAD)).astype("<u4")
                            for name, value in zip(out, (doc_id if has_id else None, start, len(ids), zlib.crc32(ids.tobytes()))):
                                out[name].append(value)
                            start += len(ids)
                        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    # one shard each: a shard holds what one task wrote, so tasks stay even
    shards = with_starts(manifest).repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return shards.mapInArrow(read, RECORDS)


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 0, style: str = "leading_space", folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token records and read them back: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all records before this one in file order.
    """
    folder = folder or runtime.staging_path(docs.sparkSession, "token-records")
    return read_records(write_records(docs, folder, tokenizer, end_id, style))
