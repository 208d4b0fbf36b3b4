"""Operator 9: cost-balanced packing of documents into training sequences.

A piece of ``n`` tokens costs ``LINEAR * n + QUADRATIC * n**2`` (attention stays
inside a piece).  A task tokenizes its documents and packs them in blocks of
about ``BLOCK_TOKENS`` tokens: the block's total is cut into sequences of
``length`` tokens, its rest into sequences whose lengths are powers of two, which
need no padding.  Then documents in descending order of cost go to the sequence
of lowest cost that has room left; a document that doesn't fit fills the room,
and what is left of it goes on as a document of its own.  So every sequence is
full, and costs are as even as the longest pieces allow.

No shuffle is made and no task holds more than a block (or one longer document).
A sequence's id is its partition and its number there, the same in every retry.

Defined cases: a null text is empty, so its document is the end id alone; rows of
equal doc_id are packed each for itself; a null doc_id stays null; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from barloom.llm.shared import columns, in_batches
from barloom.llm.tokenize import default_path, encoder

LENGTH = 1024
BLOCK_TOKENS = 1 << 22
LINEAR, QUADRATIC = 1.0, 1.0 / 512
"""Cost of a token, and of a pair of tokens in one piece, relative to it."""


def cost(n: float, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * n + quadratic * n * n


def capacities(total: int, length: int) -> list[int]:
    """Lengths of the sequences that hold ``total`` tokens without padding (``length``: a power of two)."""
    rest = total % length
    return [length] * (total // length) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def balance(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, tokens, sequence, offset) of documents of the given sizes."""
    room = capacities(sum(sizes), length)
    used = [0] * len(room)
    open_sequences = [(0.0, k) for k in range(len(room))]
    documents = [(-n, k, 0) for k, n in enumerate(sizes) if n]
    heapq.heapify(documents)
    out = []
    while documents:
        left, doc, start = documents[0]
        spent, k = heapq.heappop(open_sequences)
        n = min(-left, room[k] - used[k])
        out.append((doc, start, n, k, used[k]))
        used[k] += n
        if used[k] < room[k]:
            heapq.heappush(open_sequences, (spent + cost(n), k))
        if n < -left:
            heapq.heapreplace(documents, (left + n, doc, start + n))
        else:
            heapq.heappop(documents)
    return out


def documents(batches, path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    encode = encoder(path).ids
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            yield doc_id, encode(text.as_py() or "")


def blocks(docs: Iterator[tuple[int | None, np.ndarray]], tokens: int) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    held, size = [], 0
    for d in docs:
        held.append(d)
        size += len(d[1])
        if size >= tokens:
            yield held
            held, size = [], 0
    if held:
        yield held


def _run(path: str, length: int, block_tokens: int):
    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for block in blocks(documents(batches, path), block_tokens):
            pieces = balance([len(ids) for _, ids in block], length)
            doc, start, n, sequence, offset = (np.array(v, np.int64) for v in zip(*pieces, strict=True))
            crc = [zlib.crc32(block[d][1][a : a + m].astype("<u4", copy=False).tobytes()) for d, a, m, _, _ in pieces]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block[d][0] for d in doc.tolist()], pa.int64()), pa.array(start), pa.array(n), pa.array(crc, pa.int64()),
                    pa.array([len(block[d][1]) for d in doc.tolist()], pa.int64()), pa.array(sequence + number), pa.array(offset),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            number += int(sequence.max()) + 1

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return columns(docs, doc_id="long", text="string").transform(in_batches, _run(path or default_path(), length, block_tokens), schema)
