"""Operator 10: packed token matrices in binary files, by best-fit-decreasing packing.

A task packs its documents in blocks of about ``BLOCK_TOKENS`` tokens.  Documents
longer than a sequence are split losslessly into whole sequences and a rest; then
all rests in descending length go each to the open sequence with the least room
that still holds it, found in a segment tree over the room left.  A block is
written to the output folder as three files: the id matrix (rows of ``length``
little-endian unsigned 32-bit ids, zero-padded), and the cumulative lengths of its
segments and the places where positions start again at 0 (both unsigned 32-bit,
with row offsets in the manifest).  Files bear a task attempt's own name, which the
manifest gives, so an attempt that is lost or late never touches another's files.

The manifest names every file; :func:`read_packed` reads the matrices back.

Defined cases: a null text is empty, so its document is the end id alone; rows of
equal doc_id are packed each for itself; a null doc_id stays null; an empty table
gives an empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.packing import blocks, documents
from barloom.llm.shared import attempt, columns, file_system, in_batches, keep, partitions, scratch
from barloom.llm.tokenize import default_path

LENGTH = 1024
BLOCK_TOKENS = 1 << 21
_MANIFEST = "folder string, block string, sequences long, width long, segments array<struct<doc_id:long,start:long,length:long,sequence:long,offset:long>>"


class RoomTree:
    """How many open sequences have each amount of room; finds the least room that holds a piece."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, sequence: int, room: int) -> None:
        if room:
            self.open[room].append(sequence)
            self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """A sequence with the least room of at least ``size``, and its room."""
        k = size + self.leaves
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.leaves
        self._add(room, -1)
        return self.open[room].pop(), room


def best_fit(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, tokens, sequence, offset) of documents of the given sizes."""
    out, rests, sequence = [], [], 0
    for doc, n in enumerate(sizes):
        start = 0
        while n - start >= length:
            out.append((doc, start, length, sequence, 0))
            sequence += 1
            start += length
        if n > start:
            rests.append((n - start, doc, start))
    tree = RoomTree(length)
    for n, doc, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        found = tree.take(n)
        if found is None:
            k, room = sequence, length
            sequence += 1
        else:
            k, room = found
        out.append((doc, start, n, k, length - room))
        tree.put(k, room - n)
    return sorted(out, key=lambda p: (p[3], p[4]))


def _write(folder: str, path: str, length: int, block_tokens: int):
    def run(batches):
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        for k, block in enumerate(blocks(documents(batches, path), block_tokens)):
            pieces = best_fit([len(ids) for _, ids in block], length)
            sequences = pieces[-1][3] + 1
            matrix = np.zeros((sequences, length), "<u4")
            cumulative, resets, last = [], [], -1
            for doc, start, n, row, offset in pieces:
                matrix[row, offset : offset + n] = block[doc][1][start : start + n]
                if row != last:
                    cumulative.append(0)
                cumulative.append(offset + n)
                resets.append(offset)
                last = row
            name = f"part-{context.partitionId():06d}-{k:05d}-{attempt()}"
            for kind, data in (("ids", matrix), ("lengths", np.array(cumulative, "<u4")), ("resets", np.array(resets, "<u4"))):
                with fs.open_output_stream(f"{root}/{name}.{kind}") as f:
                    f.write(memoryview(np.ascontiguousarray(data)).cast("B"))
            segments = [{"doc_id": block[d][0], "start": a, "length": n, "sequence": r, "offset": o} for d, a, n, r, o in pieces]
            yield pa.RecordBatch.from_pylist(
                [{"folder": folder, "block": name, "sequences": sequences, "width": length, "segments": segments}], schema=_ARROW
            )

    return run


_SEGMENT = pa.struct([(k, pa.int64()) for k in ("doc_id", "start", "length", "sequence", "offset")])
_ARROW = pa.schema([("folder", pa.string()), ("block", pa.string()), ("sequences", pa.int64()), ("width", pa.int64()), ("segments", pa.list_(_SEGMENT))])


def write_packed(docs: DataFrame, folder: str, path: str | None = None, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into files in ``folder`` (a shared one) and return the manifest, one row for each block."""
    docs = columns(docs, doc_id="long", text="string")
    return keep(docs.transform(in_batches, _write(folder, path or default_path(), length, block_tokens), _MANIFEST), "manifest")


def _read(batches):
    for b in batches:
        for row in b.to_pylist():
            fs, root = file_system(row["folder"])
            load = lambda kind: np.frombuffer(fs.open_input_stream(f"{root}/{row['block']}.{kind}").read(), "<u4")  # noqa: B023, E731
            matrix, cumulative, resets = load("ids").reshape(row["sequences"], row["width"]), load("lengths"), load("resets")
            # A row's cumulative lengths begin with 0: differences without the falls are the segments' lengths.
            step = np.diff(cumulative.astype(np.int64))
            n, sequence = step[step > 0], (np.cumsum(cumulative[:-1] == 0) - 1)[step > 0]
            seg = row["segments"]
            crc = [zlib.crc32(matrix[s, o : o + m].tobytes()) for s, o, m in zip(sequence.tolist(), resets.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s["doc_id"] for s in seg], pa.int64()), pa.array([s["start"] for s in seg], pa.int64()), pa.array(n), pa.array(crc, pa.int64()),
                    pa.array([row["block"]] * len(seg), pa.string()), pa.array(sequence), pa.array(resets.astype(np.int64)),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "block", "sequence", "offset"],
            )


def read_packed(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, block, sequence, offset), one for each segment, read from the files."""
    schema = "doc_id long, start long, length long, ids_crc32 long, block string, sequence long, offset long"
    return manifest.repartition(partitions(manifest.sparkSession), F.xxhash64("block")).transform(in_batches, _read, schema)


def packed_digest(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Write ``docs`` to the shared folder and read the segments back."""
    return read_packed(write_packed(docs, scratch(docs.sparkSession, "packed"), path, length))
