"""Operator 6: benchmark decontamination by an FM-index per training shard.

Words are maximal runs of digits, letters a-z (A-Z lower-cased) and all
non-ASCII.  A phrase is a window of ``WINDOW`` consecutive words of a benchmark
item, or the whole of a shorter one.  A task cuts its documents into shards of
about ``SHARD_BYTES`` and, for each shard, takes the word sequence with every run of
words that no phrase has folded into one separator (no phrase spans it), drops
stretches shorter than the shortest phrase, sorts the suffixes, and keeps the
Burrows-Wheeler transform in a wavelet matrix with every ``SAMPLE``-th suffix
position.  All phrases are searched backward at once; the rows found are walked
to the nearest sampled position; and the words of all occurrences, merged, are
the removal spans.

No shuffle of documents is made.  Phrases come in blocks of about ``BLOCK_BYTES`` of item
text: one block is sent to the tasks; more are encoded once, by a job of their own, and
read from the shared folder, one at a time and once for ``HOLD_BYTES`` of a task's
documents, so a benchmark of any size fits.

Defined cases: null texts have no words; items without words have no phrase;
items with a null item_id mark words but are not listed; equal phrases of several
items count for each of them; repeated rows of either table change nothing but
their own row; an empty table of documents gives no rows, one of items no hits;
extra columns are ignored (:func:`clean` keeps them).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import textops
from barloom.llm.shared import attempt, columns, file_system, in_batches, keep, partitions, scratch

WINDOW = 13
SHARD_BYTES = 1 << 21
SAMPLE = 8
BLOCK_BYTES = 4 << 20
HOLD_BYTES = 8 << 20
"""Bytes of texts that a task holds to search them for all blocks, if there are several."""
SHARE = 20
"""A document is contaminated if one word in ``SHARE`` or more is hit."""
_END, _GAP, _FIRST = 0, 1, 2


class Phrases:
    """The distinct windows of a block of items, over the block's own vocabulary."""

    def __init__(self, ids: list, texts: list, window: int) -> None:
        data, off = textops.buffers(pa.array(texts, pa.large_string()))
        _, _, h, row = textops.words(data, off, textops.ALNUM_WORDS)
        self.vocab, code = np.unique(h, return_inverse=True)
        code = (code + _FIRST).astype(np.int32)
        self.likely = np.zeros(1 << 20, bool)
        self.likely[(self.vocab >> np.uint64(44)).astype(np.int64)] = True
        count = np.bincount(row, minlength=len(ids)) if len(row) else np.zeros(len(ids), np.int64)
        first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        # Windows are right-aligned, to be read backward from the last column; short items are one window each.
        whole = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :]) if len(row) >= window else np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < window))
        words = np.zeros((len(whole) + len(short), window), np.int32)
        for k in range(window):
            words[: len(whole), k] = code[whole + k]
        for at, item in enumerate(short.tolist(), len(whole)):
            words[at, window - count[item] :] = code[first[item] : first[item] + count[item]]
        owner = np.concatenate([row[whole], short]).astype(np.int64)
        self.words, phrase = np.unique(words, axis=0, return_inverse=True) if len(words) else (words, owner)
        self.size = (self.words > 0).sum(axis=1).astype(np.int64)
        named = np.array([i is not None for i in ids], bool)
        pairs = np.unique(np.stack([phrase.reshape(-1), owner], 1)[named[owner]], axis=0) if len(words) else np.zeros((0, 2), np.int64)
        self.item_of = pairs[:, 1]
        self.item_at = np.searchsorted(pairs[:, 0], np.arange(len(self.words) + 1))
        self.ids = ids
        self.symbols = len(self.vocab) + _FIRST

    def items(self, phrase: int) -> list[str]:
        return [self.ids[k] for k in self.item_of[self.item_at[phrase] : self.item_at[phrase + 1]].tolist()]

    def encode(self, h: np.ndarray) -> np.ndarray:
        """The symbol of each word, ``_GAP`` for words of no phrase."""
        out = np.full(len(h), _GAP, np.int64)
        maybe = np.flatnonzero(self.likely[(h >> np.uint64(44)).astype(np.int64)])
        if len(maybe):
            at = np.searchsorted(self.vocab, h[maybe])
            at[at == len(self.vocab)] = 0
            same = self.vocab[at] == h[maybe]
            out[maybe[same]] = at[same] + _FIRST
        return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``s`` in order; ``s`` ends with its only, least symbol."""
    n = len(s)
    pad = np.concatenate([s, [0, 0]]).astype(np.int64)
    if pad.max() < 1 << 20:
        key, k = pad[:n] << 42 | pad[1 : n + 1] << 21 | pad[2 : n + 2], 3
    else:
        key, k = pad[:n], 1
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    head = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[sa] = head[np.cumsum(new) - 1]  # a group's rank is the place of its first row
    open_rows = np.flatnonzero(np.repeat(np.diff(np.append(head, n)), np.diff(np.append(head, n))) > 1)
    while len(open_rows):
        pos = sa[open_rows]
        after = pos + k
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[pos]
        by = np.argsort(first * np.int64(n + 2) + second, kind="stable")
        pos, first, second = pos[by], first[by], second[by]
        sa[open_rows] = pos
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        head = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank[pos] = open_rows[head[group]]
        size = np.diff(np.append(head, len(pos)))
        open_rows = open_rows[size[group] > 1]
        k *= 2
    return sa


class FMIndex:
    """Backward search over a symbol sequence that ends with its only ``_END``."""

    def __init__(self, s: np.ndarray, symbols: int) -> None:
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.n, self.levels = len(s), max(1, int(symbols - 1).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))])
        # Wavelet matrix: at each level, zeros before each row, and how many there are.
        self.zeros, self.total = [], []
        v = bwt
        for level in reversed(range(self.levels)):
            zero = v >> level & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]).astype(np.int32))
            self.total.append(int(self.zeros[-1][-1]))
            v = np.concatenate([v[zero], v[~zero]])
        self.bwt = bwt
        sampled = sa % SAMPLE == 0
        self.mark = np.concatenate([[0], np.cumsum(sampled)])
        self.sample = sa[sampled]

    def rank(self, c: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each ``c`` stands in the transform before each ``row``."""
        a, b = np.zeros(len(c), np.int64), row.astype(np.int64)
        for k, level in enumerate(reversed(range(self.levels))):
            one = c >> level & 1 == 1
            za, zb = self.zeros[k][a], self.zeros[k][b]
            a = np.where(one, self.total[k] + a - za, za)
            b = np.where(one, self.total[k] + b - zb, zb)
        return b - a

    def search(self, words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, and their rows [low, high)."""
        which = np.arange(len(size))
        low, high = np.zeros(len(size), np.int64), np.full(len(size), self.n)
        for k in range(words.shape[1]):
            go = np.flatnonzero(size[which] > k)
            if not len(go):
                break
            c = words[which[go], words.shape[1] - 1 - k].astype(np.int64)
            low[go] = self.before[c] + self.rank(c, low[go])
            high[go] = self.before[c] + self.rank(c, high[go])
            left = high > low
            which, low, high = which[left], low[left], high[left]
        return which, low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled suffix."""
        out, steps, todo = np.full(len(row), -1), 0, np.arange(len(row))
        row = row.copy()
        while len(todo):
            at = self.mark[row[todo]]
            hit = self.mark[row[todo] + 1] > at
            out[todo[hit]] = self.sample[at[hit]] + steps
            todo = todo[~hit]
            c = self.bwt[row[todo]]
            row[todo] = self.before[c] + self.rank(c, row[todo])
            steps += 1
        return out


def _occurrences(code: np.ndarray, row: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Phrase and first word of every occurrence in a shard's words."""
    none = np.zeros(0, np.int64)
    known = code >= _FIRST
    if not known.any() or not len(p.size):
        return none, none
    first = known.copy()
    first[1:] &= ~known[:-1] | (row[1:] != row[:-1])
    start = np.flatnonzero(first)
    stretch = np.cumsum(first) - 1
    long = np.bincount(stretch[known], minlength=len(start)) >= p.size.min()
    at = np.flatnonzero(known & long[stretch])
    if not len(at):
        return none, none
    gap = np.concatenate([[True], stretch[at[1:]] != stretch[at[:-1]]])
    place = np.arange(len(at)) + np.cumsum(gap)
    s = np.full(len(at) + int(gap.sum()) + 1, _GAP, np.int64)
    s[place], s[-1] = code[at], _END
    word = np.full(len(s), -1)
    word[place] = at
    index = FMIndex(s, p.symbols)
    which, low, high = index.search(p.words, p.size)
    count = high - low
    if not len(count):
        return none, none
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    return np.repeat(which, count), word[index.locate(rows)]


class _Shard:
    """The words of some texts, and what was found in them."""

    def __init__(self, part: np.ndarray, at: np.ndarray) -> None:
        self.part, self.at, self.rows = part, at, len(at) - 1
        self.start, self.end, self.h, self.row = textops.words(part, at, textops.ALNUM_WORDS)
        self.change = np.zeros(len(self.h) + 1, np.int64)
        self.items: list[set] = [set() for _ in range(self.rows)]

    def search(self, p: Phrases) -> None:
        which, first = _occurrences(p.encode(self.h), self.row, p)
        np.add.at(self.change, first, 1)
        np.add.at(self.change, first + p.size[which], -1)
        for r, w in np.unique(np.stack([self.row[first], which], 1), axis=0).tolist() if len(first) else ():
            self.items[r].update(p.items(w))

    def result(self) -> tuple[np.ndarray, np.ndarray, list[set], list[list]]:
        """Words and hits of each text, their items and removal spans."""
        hit, row = np.cumsum(self.change[:-1]) > 0, self.row
        spans: list[list] = [[] for _ in range(self.rows)]
        if hit.any():
            chars = np.concatenate([[0], np.cumsum(self.part & 0xC0 != 0x80)])
            k = np.flatnonzero(hit)
            new = np.concatenate([[True], (k[1:] != k[:-1] + 1) | (row[k[1:]] != row[k[:-1]])])
            heads = np.flatnonzero(new)
            for a, b in zip(k[heads], k[np.append(heads[1:], len(k)) - 1], strict=True):
                base = chars[self.at[row[a]]]
                spans[row[a]].append([int(chars[self.start[a]] - base), int(chars[self.end[b]] - base)])
        n = np.bincount(row, minlength=self.rows) if len(row) else np.zeros(self.rows, np.int64)
        return n, np.bincount(row[hit], minlength=self.rows) if len(row) else n, self.items, spans


def _search(batches: Iterator[pa.RecordBatch], blocks: Callable[[], Iterator[Phrases]], hold: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[set], list[list]]]:
    """Each batch with the words, hits, items and spans of its texts; the blocks are gone through once for ``hold`` bytes of texts."""
    held: list[tuple[pa.RecordBatch, list[_Shard]]] = []
    size = 0

    def done():
        for p in blocks():
            for _, shards in held:
                for shard in shards:
                    shard.search(p)
        for b, shards in held:
            found = [s.result() for s in shards]
            n, n_hit = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            yield b, n, n_hit, [x for f in found for x in f[2]], [x for f in found for x in f[3]]

    for b in batches:
        data, off = textops.buffers(b.column("text"))
        held.append((b, [_Shard(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in textops.slices(off, SHARD_BYTES)]))
        size += len(data)
        if size >= hold:
            yield from done()
            held, size = [], 0
    yield from done()


def _encoded(folder: str, window: int):
    """Write the phrases of blocks of items to the shared folder, ready to search; one row (name) each."""

    def run(batches):
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        ids, texts, size, names = [], [], 0, []

        def write():
            names.append(f"phrases-{attempt()}")
            with fs.open_output_stream(f"{root}/{names[-1]}", compression=None) as f:
                f.write(pickle.dumps(Phrases(ids, texts, window), protocol=5))

        for b in batches:
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(item)
                texts.append(text)
                size += len(text)
                if size >= BLOCK_BYTES:
                    write()
                    ids, texts, size = [], [], 0
        if ids:
            write()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return run


def _blocks(benchmark: DataFrame, window: int) -> tuple[Callable[[], Iterator[Phrases]], int]:
    """A function for the tasks that gives the phrases block by block, and the bytes of texts to hold for each round of it."""
    items = columns(benchmark, item_id="string", text="string").where("text is not null")
    spark = benchmark.sparkSession
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= BLOCK_BYTES:
        rows = items.toArrow()
        if not rows.num_rows:
            return lambda: iter(()), SHARD_BYTES
        sent = spark.sparkContext.broadcast(Phrases(rows["item_id"].to_pylist(), rows["text"].to_pylist(), window))
        return lambda: iter((sent.value,)), SHARD_BYTES
    folder = scratch(spark, "phrases")
    dealt = items.repartition(max(1, min(partitions(spark), size // BLOCK_BYTES)))
    names = [r["name"] for r in keep(dealt.transform(in_batches, _encoded(folder, window), "name string"), "phrase-blocks").collect()]  # one for BLOCK_BYTES of items

    def read() -> Iterator[Phrases]:
        fs, root = file_system(folder)
        for name in names:
            with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                yield pickle.loads(f.read())  # written by _encoded, in this session's own folder

    return read, HOLD_BYTES


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, items, spans), one for each row of ``docs`` (doc_id, text).

    ``items`` are the item_ids (as strings, sorted) with an occurring window,
    ``spans`` the merged removal spans in code points, end exclusive.
    """
    blocks, hold = _blocks(benchmark, window)

    def run(batches):
        for b, n, n_hit, items, spans in _search(batches, blocks, hold):
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return columns(docs, doc_id="long", text="string").transform(in_batches, run, "doc_id long, n_words long, n_hit long, items array<string>, spans array<array<bigint>>")


def contamination(found: DataFrame) -> DataFrame:
    """The contract's digest columns of :func:`find_benchmark`."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    blocks, hold = _blocks(benchmark, window)

    def run(batches):
        for b, n, n_hit, _, _ in _search(batches, blocks, hold):
            yield b.filter(pa.array(~((n_hit > 0) & (SHARE * n_hit >= n))))

    return docs.transform(in_batches, run, docs.schema)
