"""Operator 1: MinHash fingerprints of documents, and near duplicates by banding.

Each text's ``width``-word shingles go through ``K`` universal hash functions
``a * x + b mod 2**64`` (a odd) in numpy; a component is 16 mixed bits of the
least value.  :func:`near_duplicates` joins the bands of the signatures in Spark
and verifies every group by exact Jaccard.  :func:`edited_fingerprints` (which can name
these groups too) sets each document beside its successor by doc_id: the ids are cut into ranges, each range
is lent the first document of the next one, and a task streams its ranges, so
that one shuffle of the texts is all it takes and no task sees the whole order.

Defined cases: a null text is empty; texts without words share one fingerprint;
a null doc_id sorts before every other; rows of equal doc_id follow each other by
text, so each has a successor; in a table of one row it is its own successor;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import textops
from barloom.llm.ngram_join import PERCENT, WIDTH, linked_classes, linked_groups, set_digest, sets
from barloom.llm.shared import columns, discard, in_batches, keep, partitions

K = 128
BANDS = 32
BROADCAST_ROWS = 1 << 18
"""Sets with near duplicates (16 bytes each) up to which they are broadcast; more are joined by a shuffle."""
_CHUNK = 1 << 19
_rng = np.random.Generator(np.random.PCG64(97))
_A = _rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, K, dtype=np.uint64)
_LEAST_ID = -(1 << 63)


def signatures(col: pa.Array, width: int = WIDTH) -> np.ndarray:
    """A row of ``K`` 16-bit components for each text."""
    data, off = textops.buffers(col)
    out = np.full((len(off) - 1, K), 0xFFFF, np.uint16)
    for i, j in textops.slices(off, _CHUNK):
        _, _, h, row = textops.words(data[off[i] : off[j]], off[i : j + 1] - off[i], textops.SPACE_WORDS)
        sh, at = textops.shingles(h, row, j - i, width)
        full = np.flatnonzero(np.diff(at))
        if not len(full):
            continue
        least, scratch = np.empty((K, len(full)), np.uint64), np.empty(len(sh), np.uint64)
        for k in range(K):
            np.multiply(sh, _A[k], out=scratch)
            np.add(scratch, _B[k], out=scratch)
            np.minimum.reduceat(scratch, at[full], out=least[k])
        out[i + full] = (textops.mix(least) & np.uint64(0xFFFF)).astype(np.uint16).T
    return out


def _raw(sig: np.ndarray) -> pa.Array:
    """The signatures as bytes."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * sig.shape[1]), len(sig), [None, pa.py_buffer(sig.astype(">u2").tobytes())]).cast(pa.binary())


def _signature(col: pa.Array) -> np.ndarray:
    """Signatures from their bytes."""
    return np.frombuffer(b"".join(col.to_pylist()), ">u2").reshape(len(col), K)


def _hexed(column: str) -> Column:
    return F.lower(F.hex(column)).alias(column)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal components: an estimate of the Jaccard similarity."""
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, fingerprint), one for each row of ``docs`` (doc_id, text); no shuffle."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _raw(signatures(b.column("text"), width))], names=["doc_id", "fingerprint"])

    return columns(docs, doc_id="long", text="string").transform(in_batches, run, "doc_id long, fingerprint binary").select("doc_id", _hexed("fingerprint"))


def _bands(sig: np.ndarray, bands: int) -> np.ndarray:
    """A hash of each band of each signature."""
    rows = K // bands
    key = np.ascontiguousarray(sig[:, : bands * rows]).reshape(len(sig), bands, rows).astype(np.uint64)
    token = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        token = textops.mix(token + key[:, :, r] + np.uint64(1))
    return textops.mix(token + np.arange(bands, dtype=np.uint64))


def _banded(bands: int):
    """(token, salt, sig): the bands of the signatures (fingerprint), keyed by the text's set, once in a batch."""

    def run(batches):
        for b in batches:
            digest = b.column("sig").to_numpy()
            _, once = np.unique(digest, return_index=True)
            once = once[digest[once] != 0]
            sig = _signature(b.column("fingerprint").take(pa.array(once)))
            token = _bands(sig, bands)
            yield pa.RecordBatch.from_arrays([pa.array(token.ravel().view(np.int64)), pa.array(np.zeros(token.size, np.int32)), pa.array(np.repeat(digest[once], bands))], names=["token", "salt", "sig"])

    return run


def _profiled(width: int):
    """(doc_id, n, sig, fingerprint) of each text: the size and the digest of its shingle set, and its signature."""

    def run(batches):
        for b in batches:
            every = [(len(s), set_digest(s)) for s in sets(b.column("text"), width)]
            n, digest = (np.array([v[k] for v in every], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(digest), _raw(signatures(b.column("text"), width))], names=["doc_id", "n", "sig", "fingerprint"])

    return run


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) over pairs that share a band and reach the similarity.

    Candidates are those of the bands (at 0.8 a pair is missed with a chance below
    1e-7 at 32 bands of 4); their groups are verified exactly, and within a group
    every pair is searched.
    """
    docs = columns(docs, doc_id="long", text="string")
    profile = keep(docs.transform(in_batches, _profiled(width), "doc_id long, n long, sig long, fingerprint binary"), "profiles")
    entries = profile.select("sig", "fingerprint").transform(in_batches, _banded(bands), "token long, salt int, sig long")
    return linked_groups(docs, profile.select("doc_id", "n", "sig"), entries, width, percent)


def near_classes(docs: DataFrame, profile: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """Rows (sig, component_id) of the shingle sets that have more than one document in their component.

    ``profile`` has (doc_id, n, sig, fingerprint) of each of ``docs``.
    """
    entries = profile.select("sig", "fingerprint").transform(in_batches, _banded(bands), "token long, salt int, sig long")
    classes, linked = linked_classes(docs, profile.select("doc_id", "n", "sig"), entries, width, percent)
    several = classes.join(linked, "sig", "left").where("least is not null or copies > 1")
    return keep(several.select("sig", F.coalesce("least", "rep").alias("component_id")), "near-classes")


def _ranges(docs: DataFrame, pieces: int) -> np.ndarray:
    """The first id of each range; ranges follow the quantiles of the ids."""
    at = [k / pieces for k in range(1, pieces)] or [0.5]
    ids = docs.select(F.coalesce("doc_id", F.lit(_LEAST_ID)).alias("id"))
    row = ids.agg(F.percentile_approx("id", [float(x) for x in at], 20 * pieces).alias("cut"), F.min("id").alias("least")).first()
    if row["least"] is None:
        return np.zeros(0, np.int64)
    cuts = np.unique(np.array([row["least"], *row["cut"]], np.int64))

    def firsts(batches):
        least = np.full(len(cuts), np.iinfo(np.int64).max)
        for b in batches:
            v = b.column("id").to_numpy()
            np.minimum.at(least, np.searchsorted(cuts, v, "right") - 1, v)
        k = np.flatnonzero(least < np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(least[k])], names=["k", "id"])

    found = ids.transform(in_batches, firsts, "k long, id long").groupBy("k").agg(F.min("id").alias("id")).toArrow()
    return np.sort(found["id"].to_numpy().astype(np.int64))


def _lent(first: np.ndarray):
    """Deal rows to ranges; the first rows of a range go to the range before it too."""

    def run(batches):
        for b in batches:
            key = b.column("doc_id").fill_null(_LEAST_ID)
            v = key.to_numpy()
            k = np.searchsorted(first, v, "right") - 1
            own = pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.zeros(len(k), bool)), key, b.column("doc_id"), b.column("text")], names=["k", "lent", "key", "doc_id", "text"])
            yield own
            at = np.flatnonzero(first[k] == v)
            if len(at):
                copy = own.take(pa.array(at))
                before = (k[at] - 1) % len(first)
                yield pa.RecordBatch.from_arrays([pa.array(before), pa.array(np.ones(len(at), bool)), *copy.columns[2:]], names=own.schema.names)

    return run


def _edited(width: int, near: bool):
    def run(batches):
        held = None  # the row that waits for its successor: range, lent, id, text
        for b in batches:
            _, off = textops.buffers(b.column("text"))
            for i, j in textops.slices(off, 4 * _CHUNK):
                part = b.slice(i, j - i)
                rows = [] if held is None else [held]
                rows += zip(part.column("k").to_pylist(), part.column("lent").to_pylist(), part.column("doc_id").to_pylist(), (t or "" for t in part.column("text").to_pylist()), strict=True)
                held = rows[-1]
                yield _compare(rows, width, near)

    return run


def _compare(rows: list[tuple], width: int, near: bool) -> pa.RecordBatch:
    """Each row but the last against the row after it, within a range; lent rows only serve as successors."""
    texts = [r[3] for r in rows]
    pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
    edited = []
    for i in pairs:
        t = texts[i]
        half = len(t) // 2
        edited.append(t[: len(t) - half] + texts[i + 1][:half])
    own, new = signatures(pa.array(texts, pa.large_string()), width), signatures(pa.array(edited, pa.large_string()), width)
    at = np.array(pairs, np.int64)
    digests = [(len(s), set_digest(s)) for s in sets(pa.array([texts[i] for i in pairs], pa.large_string()), width)] if near else [(0, 0)] * len(pairs)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][2] for i in pairs], pa.int64()),
            pa.array([len(texts[i]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            _raw(own[at]),
            _raw(new),
            pa.array(likeness(own[at], new)),
            pa.array(likeness(own[at], own[at + 1])),
            pa.array([v[0] for v in digests], pa.int64()),
            pa.array([v[1] for v in digests], pa.int64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n", "sig"],
    )


def edited_fingerprints(docs: DataFrame, width: int = WIDTH, near: bool = False) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likenesses.

    The edited text has the last floor(n / 2) code points replaced by the first as
    many (or all) of the next document by doc_id; the first follows the last.  With
    ``near``, the signatures' bands are joined and verified too, and ``component_id``
    is the smallest doc_id that a document reaches over near duplicates, its own without any.
    """
    docs = columns(docs, doc_id="long", text="string")
    spark = docs.sparkSession
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, n long, sig long"
    parts, groups = partitions(spark), None
    if near:  # first, so that its tables are gone when the texts are shuffled
        profile = keep(docs.transform(in_batches, _profiled(width), "doc_id long, n long, sig long, fingerprint binary"), "profiles")
        groups = near_classes(docs, profile, width)
        discard(spark, profile)
    first = _ranges(docs, min(8 * parts, 4096))
    if len(first):
        dealt = docs.transform(in_batches, _lent(first), "k long, lent boolean, key long, doc_id long, text string")
        dealt = dealt.repartition(parts, "k").sortWithinPartitions("k", "lent", "key", "text")
        found = dealt.transform(in_batches, _edited(width, near), schema)
    else:
        found = spark.createDataFrame([], schema)
    out = ["doc_id", "n_chars", "edited_sha256", _hexed("fingerprint"), _hexed("edited_fingerprint"), "near_edited", "near_next"]
    if near:
        small = groups.count() <= BROADCAST_ROWS
        found = found.join(F.broadcast(groups) if small else groups, "sig", "left")
        out.append(F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.select(*out)
