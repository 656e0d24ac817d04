"""Operator 5. Packing: concatenate and cut.

All documents' ids, each followed by an end id, form one line of tokens. A first pass
tokenizes every document, in the order in which its task reads it, and notes the tokens
before it within its partition; the prefix sum of the partitions' totals (one row per
partition) then gives every document its place in the line. A second pass cuts the line at
multiples of the sequence length: a document becomes one piece per sequence it touches, and
each piece records where it lies. Only the last sequence has padding.

Null text counts as empty: such a document is its end id alone. Rows with a null or repeated
doc_id are packed like any other, as often as they occur. A long text is a slice of its own,
cut into as many pieces as it needs. An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import materialize, prefix_offsets, text_slices, tidy
from veritable.llm.tokens import piece_tokenizer, tokenizer_path

TOKENIZER, LENGTH, END = "word_bpe_49k.json", 2048, 1
#: Text tokenized at once: a slice takes some 50 times its bytes while it is encoded.
_SLICE = 1 << 20


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value for each run of ``counts`` elements."""
    edges = np.concatenate([[0], np.cumsum(counts * values.itemsize)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def tokenize(docs: DataFrame, path: str, cut: str = "word", end: int = END, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, part, before (tokens before it in its partition), n, ids (little-endian,
    2 bytes each if all ids fit, else 4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, before = piece_tokenizer(path, cut), TaskContext.get().partitionId(), 0
        kind = np.dtype("<u2" if max(end + 1, tokenizer.library.get_vocab_size()) <= 1 << 16 else "<u4")
        try:
            for batch in batches:
                for rows in text_slices(batch, most=_SLICE):
                    ids, counts = tokenizer.encode(rows.column("text"), end)
                    places = before + np.cumsum(counts) - counts
                    before += len(ids)
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)), pa.array(places), pa.array(counts), _binary(ids.astype(kind), counts)], ["doc_id", "part", "before", "n", "ids"])
        finally:
            tokenizer.forget()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id long, part int, before long, n long, ids binary")


def cut_pieces(tokens: DataFrame, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Second pass, over the written result of ``tokenize``."""
    totals = tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    # one row per input partition, so the broadcast is bounded by the number of tasks
    placed = tokens.join(F.broadcast(prefix_offsets(totals, "part", "total", "base")), "part").select("doc_id", (F.col("base") + F.col("before")).alias("place"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_of, n = batch.column(3), batch.column(2).to_numpy()
            place = batch.column(1).to_numpy()
            first, last = place // length, (place + n - 1) // length
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            sequence = np.repeat(first - (np.cumsum(pieces) - pieces), pieces) + np.arange(len(row))
            start = np.maximum(sequence * length, place[row]) - place[row]
            size = np.minimum((sequence + 1) * length, place[row] + n[row]) - place[row] - start
            offset = place[row] + start - sequence * length
            crc, kept = np.zeros(len(row), np.int64), []
            for i, (r, a, s) in enumerate(zip(row.tolist(), start.tolist(), size.tolist())):
                raw = ids_of[r].as_buffer()
                ids = np.frombuffer(raw, "<u2" if raw.size == 2 * n[r] else "<u4")[a : a + s].astype("<u4").tobytes()
                crc[i] = zlib.crc32(ids)
                if with_ids:
                    kept.append(ids)
            out = [batch.column(0).take(pa.array(row)), *map(pa.array, (start, size, crc, n[row], sequence, offset))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                out, names = [*out, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    return placed.mapInArrow(tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str | None = None, cut: str = "word", length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; ``with_ids`` adds each piece's ids (4 bytes each)."""
    tokens = materialize(tokenize(docs, tokenizer or tokenizer_path(TOKENIZER), cut, end), "tokens")
    return cut_pieces(tokens, length, with_ids)


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """sequence_id, ids (``length`` ids, 4 bytes each), n_real. A sequence has at most
    ``length`` pieces, so a group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_real"))
    line = F.aggregate("parts", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    padding = F.unhex(F.expr(f"repeat('{pad.to_bytes(4, 'little').hex()}', cast({length} - n_real as int))"))
    return rows.select("sequence_id", F.concat(line, padding).alias("ids"), "n_real")
