"""Operator 8. Token ids in compressed, checksummed binary blocks.

Documents are range-partitioned and sorted by doc_id; each partition becomes one shard, a
run of blocks. A block holds whole documents (about ``BLOCK_TOKENS`` tokens, more only where
one document is longer) and starts its range coder anew, so it can be read, checked and
retried alone. Shards are written by Spark's Parquet committer, one row per block: a task
that is lost or runs twice leaves no partial file, and any store that Spark knows will do.

Block row: shard, block (number within the shard), before (tokens before it in its shard),
n_docs, n_tokens, payload. Payload: length of the index, zlib-compressed index (doc_id and
token count of each document and whether it has an id, 8 bytes each), CRC-32 of the index,
range-coded ids.

Null text counts as empty: such a document is its end id alone. Rows with equal doc_id stay
side by side, ordered by text; those with null doc_id come first. A long text is a block of its
own. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import prefix_offsets, text_slices, tidy
from veritable.llm.range_coder import decode_block, encode_block
from veritable.llm.tokens import piece_tokenizer, tokenizer_path

TOKENIZER, END = "byte_bpe_50k.json", 0
BLOCK_TOKENS = 1 << 20


def seal(doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> bytes:
    known = doc_ids.is_valid().to_numpy(zero_copy_only=False)
    index = zlib.compress(np.stack([doc_ids.fill_null(0).to_numpy(), known, counts]).astype("<i8").tobytes(), 1)
    return struct.pack("<II", len(index), zlib.crc32(index)) + index + encode_block(ids)


def unseal(payload: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_ids, token counts and ids of a block; raises ValueError if it is damaged."""
    size, crc = struct.unpack_from("<II", payload)
    index = payload[8 : 8 + size]
    if zlib.crc32(index) != crc:
        raise ValueError("damaged block: index checksum differs")
    doc_ids, known, counts = np.frombuffer(zlib.decompress(index), "<i8").reshape(3, -1)
    ids = decode_block(payload[8 + size :])
    if counts.sum() != len(ids):
        raise ValueError("damaged block: index and ids disagree")
    return pa.array(doc_ids, mask=known == 0), counts, ids


def write(docs: DataFrame, path: str, tokenizer: str | None = None, cut: str = "byte", end: int = END, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the shards under ``path``."""
    tokenizer = tokenizer or tokenizer_path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = piece_tokenizer(tokenizer, cut), TaskContext.get().partitionId()
        block = before = held = 0
        parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, before, held
            doc_ids, (counts, ids) = pa.concat_arrays([p[0] for p in parts]), (np.concatenate(x) for x in list(zip(*parts))[1:])
            row = [[shard], [block], [before], [len(doc_ids)], [len(ids)], [seal(doc_ids, counts, ids)]]
            block, before, held = block + 1, before + len(ids), 0
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["shard", "block", "before", "n_docs", "n_tokens", "payload"])

        try:
            for batch in batches:
                for rows in text_slices(batch, most=4 * block_tokens):
                    ids, counts = encoder.encode(rows.column("text"), end)
                    parts.append((rows.column("doc_id"), counts, ids))
                    held += len(ids)
                    if held >= block_tokens:
                        yield flush()
            if parts:
                yield flush()
        finally:
            encoder.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # rows that share an id, or have none, are dealt by their text, so none needs one task
    tag = F.xxhash64("text")
    ordered = rows.withColumn("tag", tag).repartitionByRange("doc_id", "tag").sortWithinPartitions("doc_id", "tag", "text").drop("tag")
    ordered.mapInArrow(tidy(run), "shard int, block int, before long, n_docs long, n_tokens long, payload binary").write.parquet(path)


def read(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document from the blocks of all shards: doc_id, start (tokens of all
    documents before it), n_tokens, ids_crc32, and with ``with_ids`` its ids."""
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # one row per shard, so the broadcast is bounded by the number of files
    placed = blocks.join(F.broadcast(prefix_offsets(totals, "shard", "total", "base")), "shard").select((F.col("base") + F.col("before")).alias("start"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, counts, ids = unseal(payload.as_py())
                edges = np.concatenate([[0], np.cumsum(counts)])
                raw = memoryview(ids.astype("<u4").tobytes())
                spans = [raw[4 * a : 4 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                out = [doc_ids, pa.array(start + edges[:-1]), pa.array(counts), pa.array([zlib.crc32(s) for s in spans], pa.int64())]
                if with_ids:
                    out.append(pa.array([s.tobytes() for s in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return placed.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
