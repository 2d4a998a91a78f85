"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs a linear and a quadratic share (attention within the
piece). Documents in descending order go to the sequence of lowest cost that
still has room; where its room ends, the document is cut and its rest goes to
the next one. The sequences of a block hold exactly the block's tokens: full
ones, and for the rest below a full one those of the rest's powers of two, which
need no padding either; these are filled last, with the shortest documents.

Packing is a pass over the documents without a shuffle: a block of neighbouring
documents (``block_bytes`` of text) is tokenised and packed where it lies, so
work and memory of a task depend neither on the corpus nor on any key. A
document may be longer than a block; then it is a block of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm import tokens
from churnscope.llm.common import lean

#: Pieces that leave a task in one batch.
BATCH = 2048
SCHEMA = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class PackParams:
    """``linear``: length at which a piece's quadratic cost equals its linear cost; ``end_id`` closes each document."""

    capacity: int = 4096
    end_id: int = 2
    linear: int = 6144
    block_bytes: int = 32 << 20


def rooms(total: int, capacity: int) -> list[int]:
    """Sizes of the sequences that hold ``total`` tokens: full ones, then powers of two."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], p: PackParams) -> list[tuple[int, int, int, int, int]]:
    """Pieces (sequence, offset, document, start, length), sorted, that cover documents of ``lengths`` tokens."""
    size = rooms(sum(lengths), p.capacity)
    # Short sequences wait until the full-sized ones are filled.
    open_ = [(n < p.capacity, 0, s) for s, n in enumerate(size)]
    heapq.heapify(open_)
    used, pieces = [0] * len(size), []
    for doc in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start = 0
        while start < lengths[doc]:
            short, cost, s = open_[0]
            n = min(lengths[doc] - start, size[s] - used[s])
            pieces.append((s, used[s], doc, start, n))
            used[s] += n
            start += n
            if used[s] < size[s]:
                heapq.heapreplace(open_, (short, cost + n * (p.linear + n), s))
            else:
                heapq.heappop(open_)
    return sorted(pieces)


def _document_ids(parts: tokens.Parts, coded: tokens.Encoded, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' ids one after the other, each with ``end_id`` at its end; and their counts."""
    counts = parts.total(coded.counts)
    flat = np.full(int(counts.sum()) + len(counts), end_id, "<u4")
    ends = np.cumsum(counts + 1) - 1
    inner = np.ones(len(flat), bool)
    inner[ends] = False
    flat[inner] = coded.ids[tokens.spread(coded.starts[parts.index], coded.counts[parts.index])]
    return flat, counts + 1


def _packer(spec, p: PackParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.WordBpe(spec.value)
        sequence = TaskContext.get().partitionId() << 40
        for ids, texts in tokens.blocks(batches, p.block_bytes):
            ids, _, parts = words.split(ids, texts)
            flat, counts = _document_ids(parts, words.encode(parts.values), p.end_id)
            pieces = np.array(assign(counts.tolist(), p), np.int64)
            first = np.cumsum(counts) - counts
            for lo in range(0, len(pieces), BATCH):
                s, offset, doc, start, n = pieces[lo : lo + BATCH].T
                at = first[doc] + start
                cut = [flat[a:b].tobytes() for a, b in zip(at.tolist(), (at + n).tolist())]
                columns = [ids.take(pa.array(doc)), start, n, pa.array(cut, pa.binary()), counts[doc], sequence + s, offset]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                    names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            sequence += int(pieces[-1, 0]) + 1

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", params: PackParams = PackParams()) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a ``tokenizers`` JSON file. A document's ids are
    those of its text followed by ``end_id``; a null or empty text has that id
    alone. ``ids`` holds a piece's ids as little-endian unsigned 32-bit numbers.
    Every id lies in exactly one piece; the pieces of a sequence follow each
    other without gaps from offset 0, and each sequence is ``capacity`` or a power of
    two long. Sequence numbers are distinct, not gapless, and the same whenever the
    input's files are split alike.

    Repeated rows and rows without an id are packed like any others, an empty
    table gives no rows. Other columns of ``docs`` are not read, whatever their names.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokens.read_file(tokenizer))
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(lean(_packer(spec, params)), SCHEMA).withColumnRenamed("id", id_col)
