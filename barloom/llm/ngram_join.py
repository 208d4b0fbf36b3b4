"""Operator 2: exact Jaccard join of documents on word shingles (T-occurrence search).

A document's set is its distinct ``width``-word shingles.  Documents link when
``100 * |A & B| >= percent * |A | B|``; the result names, for each document, the
smallest doc_id it reaches over such links.

1. One scan gives each text its set size and a 64-bit digest of its set.  Equal
   sets are one *class*; all later steps work on classes.
2. The ``n - ceil(percent * n) + 1 + n // SLACK`` smallest shingle hashes of a class
   are dealt by shingle into inverted lists; the most repeated shingles (at most
   ``HOT_TOKENS`` of them) are salted.  A class linked with any other shares at
   least ``least_shared(n)`` of these with it, so a class that shares fewer with
   all others together is done.
3. Of the shared ones, the rarest ``u - least_shared(n) + 1`` are a class's short
   lists: linked classes have one of them in common.  They give star edges; the
   components of those edges are *blocks* that hold every link.
4. Each block is searched exactly: DivideSkip heap-merges a query's short
   inverted lists, binary-probes the long ones, and keeps classes that reach the
   overlap.  Blocks over ``BLOCK_SHINGLES`` shingles are cut into parts, and
   every pair of parts is one search, so a task's memory is bounded and no link
   is lost.  A search emits a spanning forest of its links, not all pairs.
5. Components over the links, then one row for each document.

Defined cases: null, empty or blank texts have an empty set and link with
nothing; rows of a repeated doc_id each get a row; a null doc_id forms links as
any other row, and counts as larger than every id when the smallest is sought
(a group of null ids alone has a null component_id); extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import textops
from barloom.llm.shared import columns, components, discard, in_batches, keep, partitions

WIDTH = 5
PERCENT = 80
HOT_TOKENS = 1 << 16
"""Most shingles in the table of frequent ones (8 bytes each in every task)."""
HOT_LEAST = 8
SALTS = 32
SLACK = 10
"""A class's lists are longer than the least by this part of its size, so that chance overlaps show."""
_FREQUENT = 1 << 40
"""Parts into which the list of a frequent shingle is dealt."""
BLOCK_SHINGLES = 1 << 19
"""Shingles that one search holds of each side (8 bytes each)."""

FILTER_BITS = 1 << 26
"""Most bits of the filter that tells which texts may be in a block (8 MB in every task)."""

_MARK = np.uint64(0xC0FFEE1234567891)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_digest(s: np.ndarray) -> int:
    """64-bit digest of a sorted set of shingle hashes."""
    if not len(s):
        return 0
    total = np.add.reduce(textops.mix(s ^ _MARK)) ^ textops.mix(np.array([len(s)], np.uint64))[0]
    return int(signed(textops.mix(np.array([total], np.uint64)))[0])


def sets(col: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, off = textops.buffers(col)
    for i, j in textops.slices(off):
        _, _, h, row = textops.words(data[off[i] : off[j]], off[i : j + 1] - off[i], textops.SPACE_WORDS)
        sh, at = textops.shingles(h, row, j - i, width)
        for k in range(j - i):
            yield np.unique(sh[at[k] : at[k + 1]])


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - (percent * n + 99) // 100 + 1 + n // SLACK)


def least_shared(n: np.ndarray) -> np.ndarray:
    """A lower bound of the prefix hashes that a class of ``n`` shingles shares with a linked one.

    Let the class with the smaller prefix bound be x and its partner y.  All of
    x's prefix that lies in y lies in y's prefix, and x has at most
    ``n_x - ceil(percent * max(n_x, n_y))`` shingles that y lacks; so x shares
    ``1 + n_x // SLACK`` or more.  Seen from y, rounding costs 2 at most.
    """
    return np.maximum(1, n // SLACK - 1)


class _Repeats:
    """Shingles met in two classes or more of a bounded run of texts, or often in a task's runs, with their counts.

    Shingles that come once a run are told by a table of counters over the whole task, one for
    each value of their first 24 bits: from ``OFTEN`` on a counter's shingles are given too.
    """

    OFTEN = 32

    def __init__(self, most: int = 1 << 19) -> None:
        self.most, self.size, self.parts = most, 0, []
        self.met = np.zeros(1 << 24, np.uint8)

    def add(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.parts.append(s)
        self.size += len(s)
        return self.flush() if self.size >= self.most else None

    def flush(self) -> tuple[np.ndarray, np.ndarray] | None:
        if not self.parts:
            return None
        token, count = np.unique(np.concatenate(self.parts), return_counts=True)
        self.parts, self.size = [], 0
        at = (token >> np.uint64(40)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        sums = np.add.reduceat(count, first)
        self.met[at[first]] = np.minimum(self.met[at[first]] + sums, 255)
        more = (count > 1) | (self.met[at] >= self.OFTEN)
        return token[more], count[more]


def _profile(width: int):
    """(doc_id, n, sig) of each text, and (token, count) of shingles repeated in a run."""

    def run(batches):
        repeats, seen = _Repeats(), set()

        def rows(found):
            token, count = found
            z = pa.nulls(len(token), pa.int64())
            return pa.RecordBatch.from_arrays([z, z, z, pa.array(signed(token)), pa.array(count.astype(np.int64))], names=["doc_id", "n", "sig", "token", "uses"])

        for b in batches:
            n, sig = np.empty(b.num_rows, np.int64), np.empty(b.num_rows, np.int64)
            for k, s in enumerate(sets(b.column("text"), width)):
                n[k], sig[k] = len(s), set_digest(s)
                if len(s) and sig[k] not in seen:
                    if len(seen) < 1 << 20:
                        seen.add(sig[k])
                    if (found := repeats.add(s)) is not None and len(found[0]):
                        yield rows(found)
            z = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(sig), z, z], names=["doc_id", "n", "sig", "token", "uses"])
        if (found := repeats.flush()) is not None and len(found[0]):
            yield rows(found)

    return run


def _prefixes(width: int, percent: int, hot: np.ndarray):
    """(token, salt, sig, n): the smallest shingle hashes of each class, once in a task.

    Lists are keyed by 48 bits of the hash: two that meet by chance only add candidates.
    """

    def run(batches):
        seen: set[int] = set()
        held, size = [], 0

        def out():
            token, sig, n = (np.concatenate([np.full(len(h[0]), h[k]) if k else h[0] for h in held]) for k in range(3))
            salt = np.zeros(len(token), np.int32)
            if len(hot):
                at = np.searchsorted(hot, token)
                at[at == len(hot)] = 0
                salt = np.where(hot[at] == token, 1 + sig % SALTS, 0).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(signed(token >> np.uint64(16))), pa.array(salt), pa.array(sig), pa.array(n.astype(np.int32))], names=["token", "salt", "sig", "n"])

        for b in batches:
            for s in sets(b.column("text"), width):
                if not len(s) or (sig := set_digest(s)) in seen:
                    continue
                if len(seen) < 1 << 20:  # only saves work: repeats are dropped after the shuffle too
                    seen.add(sig)
                held.append((s[: prefix_length(len(s), percent)], sig, len(s)))
                size += len(held[-1][0])
                if size >= 1 << 17:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def _runs(batches, keys: tuple[str, ...]):
    """Arrow tables of whole runs of equal ``keys`` (sorted), with each row's run length and place in it."""
    held: list[pa.RecordBatch] = []

    def whole(parts, last):
        t = pa.Table.from_batches(parts).combine_chunks()
        v = [t.column(k).to_numpy() for k in keys]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in v])
        first = np.flatnonzero(new)
        upto = t.num_rows if last else int(first[-1])
        length = np.diff(np.append(first, t.num_rows))
        rank = np.arange(t.num_rows) - np.repeat(first, length)
        return t.slice(0, upto), np.repeat(length, length)[:upto], rank[:upto], t.slice(upto)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if len(held) > 1 and all(b.column(k)[b.num_rows - 1] == held[0].column(k)[0] for k in keys):
            continue  # one run goes on over whole batches
        table, length, rank, rest = whole(held, False)
        held = rest.to_batches()
        yield table, length, rank
    if held:
        yield whole(held, True)[:3]


def _shared_only(batches):
    """(sig, n, token, size) of the entries whose list has two classes or more."""

    def distinct():
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            token, salt, sig = (b.column(k).to_numpy() for k in ("token", "salt", "sig"))
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (sig[1:] != sig[:-1])
            new[0] = (token[0], salt[0], sig[0]) != last
            last = token[-1], salt[-1], sig[-1]
            yield b.filter(pa.array(new))

    for t, length, _ in _runs(distinct(), ("token", "salt")):
        size = np.where(t.column("salt").to_numpy() > 0, _FREQUENT, length)
        at = pa.array(size > 1)
        yield from pa.table([t.column("sig"), t.column("n"), t.column("token"), pa.array(size)], names=["sig", "n", "token", "size"]).filter(at).to_batches()


def _rarest(batches):
    """(token, salt, sig): of a class's shared entries, sorted by list size, as many as it needs."""
    for t, length, rank in _runs(batches, ("sig",)):
        least = least_shared(t.column("n").to_numpy().astype(np.int64))
        sig, often = t.column("sig").to_numpy(), t.column("size").to_numpy() == _FREQUENT
        salt = np.where(often, 1 + sig % SALTS, 0).astype(np.int32)
        at = pa.array(rank < length - least + 1)
        yield from pa.table([t.column("token"), pa.array(salt), t.column("sig")], names=["token", "salt", "sig"]).filter(at).to_batches()


def _stars(batches):
    """Star edges (a, b) within runs of equal (token, salt); salted runs also give (centre, null, token)."""
    last = None  # token, salt, centre
    for b in batches:
        if not b.num_rows:
            continue
        token, salt, sig = (b.column(k).to_numpy() for k in ("token", "salt", "sig"))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        centre = sig[new]
        if last is not None and token[0] == last[0] and salt[0] == last[1]:
            centre[0] = last[2]
        centre = centre[np.cumsum(new) - 1]
        last = token[-1], salt[-1], centre[-1]
        at = centre != sig
        pairs = np.unique(np.stack([centre[at], sig[at]], 1), axis=0)
        top = new & (salt > 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([pairs[:, 0], centre[top]])),
                pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(int(top.sum()), pa.int64())]),
                pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(token[top])]),
            ],
            names=["a", "b", "token"],
        )


class Search:
    """T-occurrence search over the sets of a block, by DivideSkip.

    ``links`` yields index pairs of sets that reach the similarity, without pairs that are
    connected already: a set is compared with the components met last first, and then
    searched for in lists without the members of its own.
    """

    MU = 0.0085
    """DivideSkip's weight of a probe against a merge step, as published."""
    RECENT = 2

    def __init__(self, members: list[np.ndarray], percent: int = PERCENT) -> None:
        self.percent = percent
        self.order = np.argsort([len(m) for m in members], kind="stable")
        self.members = [members[k] for k in self.order]
        self.size = np.array([len(m) for m in self.members], np.int64)
        flat = np.concatenate(self.members) if members else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(self.members)), self.size)
        by = np.argsort(flat, kind="stable")
        token, self.lists = flat[by], owner[by]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        self.begin = np.append(first, len(token))
        ids = np.empty(len(flat), np.int64)
        ids[by] = np.repeat(np.arange(len(first)), np.diff(self.begin))
        self.tokens = np.split(ids, np.cumsum(self.size)[:-1]) if members else []
        self.component = np.arange(len(self.members))

    def _needed(self, x: int, y) -> np.ndarray:
        """Overlap that sets ``x`` and ``y`` must reach."""
        return -(-self.percent * (self.size[x] + self.size[y]) // (100 + self.percent))

    def _join(self, x: int, y: int) -> tuple[int, int]:
        a, b = self.component[x], self.component[y]
        self.component[self.component == max(a, b)] = min(a, b)
        return int(self.order[x]), int(self.order[y])

    def links(self) -> Iterator[tuple[int, int]]:
        p = self.percent
        recent: list[int] = []
        for x in range(len(self.members)):
            n = int(self.size[x])
            if not n:
                continue
            least = -(-p * n // 100)
            low = int(np.searchsorted(self.size, least))
            if low < x:
                for y in recent:
                    if y >= low and self.component[y] != self.component[x] and len(np.intersect1d(self.tokens[x], self.tokens[y], assume_unique=True)) >= self._needed(x, y):
                        yield self._join(x, y)
                yield from self._search(x, n, low, -(-p * (n + least) // (100 + p)))
            home = self.component[x]
            recent = [x, *(y for y in recent if self.component[y] != home)][: self.RECENT]

    def _search(self, x: int, n: int, low: int, need: int) -> Iterator[tuple[int, int]]:
        # Inverted lists, cut to sets that are no larger than the query's, large enough, and not connected with it.
        lists = [self.lists[self.begin[t] : self.begin[t + 1]] for t in self.tokens[x]]
        lists = [v[np.searchsorted(v, low) : np.searchsorted(v, x)] for v in lists if len(v) > 1]
        home = self.component[x]
        lists = sorted((w for v in lists if len(v) and len(w := v[self.component[v] != home])), key=len)
        if len(lists) < need:
            return
        longest = len(lists[-1])
        aside = min(need - 1, int(need / (self.MU * np.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        least, found, counts, last, count = need - aside, [], [], -1, 0
        merged = heapq.merge(*(v.tolist() for v in short)) if len(short) > 1 else short[0].tolist()
        for y in merged:
            if y == last:
                count += 1
                continue
            if count >= least:
                found.append(last)
                counts.append(count)
            last, count = y, 1
        if count >= least:
            found.append(last)
            counts.append(count)
        if not found:
            return
        ids, got = np.array(found), np.array(counts)
        need = self._needed(x, ids)
        for k, v in enumerate(long):
            at = np.searchsorted(v, ids)
            at[at == len(v)] = 0
            got += v[at] == ids
            if not k % 16:
                alive = got + (len(long) - k - 1) >= need
                if not alive.all():
                    ids, got, need = ids[alive], got[alive], need[alive]
                    if not len(ids):
                        return
        for y in ids[got >= need].tolist():
            if self.component[x] != self.component[y]:
                yield self._join(x, y)


def _block_links(percent: int, most: int):
    """Search runs of rows of equal ``tile``; small tiles share a search."""

    def run(batches):
        group: list[tuple[int, bytes]] = []
        weight, tile = 0, None

        def search():
            seen, sig, members = set(), [], []
            for s, raw in group:
                if s not in seen:
                    seen.add(s)
                    sig.append(s)
                    members.append(np.frombuffer(raw, np.uint64))
            pairs = [(sig[x], sig[y]) for x, y in Search(members, percent).links()]
            a, b = (np.array(v, np.int64) for v in (zip(*pairs) if pairs else ((), ())))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            for t, s, raw in zip(b.column("tile").to_pylist(), b.column("sig").to_pylist(), b.column("shingles").to_pylist(), strict=True):
                if t != tile and weight >= most:
                    yield search()
                    group, weight = [], 0
                tile = t
                group.append((s, raw))
                weight += len(raw) // 8
        if group:
            yield search()

    return run


def _member_filter(members: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter (one hash) of the members' ids: a bit for each id's hash, at most ``FILTER_BITS``."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * members.count()).bit_length()))
    h = members.select(F.pmod(F.xxhash64("rep"), F.lit(bits)).alias("h"))
    words = h.groupBy(F.shiftright("h", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy().astype(np.int64)] = words["bits"].to_numpy()
    return out.view(np.uint64), bits


def _shingled(width: int, likely: np.ndarray):
    """The digest and set of each text whose id may be a member's."""

    def run(batches):
        for b in batches:
            h = b.column("h").to_numpy()
            at = np.flatnonzero(likely[h >> 6] >> (h & 63).astype(np.uint64) & np.uint64(1))
            b = b.take(pa.array(at))
            every = list(sets(b.column("text"), width))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([set_digest(s) for s in every], pa.int64()), pa.array([s.tobytes() for s in every], pa.binary())], names=["doc_id", "sig", "shingles"]
            )

    return run


def ngram_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``docs`` (doc_id, text)."""
    docs = columns(docs, doc_id="long", text="string")
    kept = keep(docs.transform(in_batches, _profile(width), "doc_id long, n long, sig long, token long, uses long"), "profiles")
    profile = kept.where("n is not null").select("doc_id", "n", "sig")
    top = (
        kept.where("token is not null").groupBy("token").agg(F.sum("uses").alias("uses")).where(F.col("uses") >= HOT_LEAST)
        .orderBy(F.desc("uses"), "token").limit(HOT_TOKENS).toArrow()
    )
    hot = np.sort(top["token"].to_numpy().astype(np.int64).view(np.uint64))
    parts = partitions(docs.sparkSession)
    entries = docs.select("text").transform(in_batches, _prefixes(width, percent, hot), "token long, salt int, sig long, n int")
    listed = entries.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", "sig")
    shared = keep(listed.transform(in_batches, _shared_only, "sig long, n int, token long, size long"), "shared")  # the shuffle of all lists ends here
    entries = shared.repartition(parts, "sig").sortWithinPartitions("sig", "size", "token").transform(in_batches, _rarest, "token long, salt int, sig long")
    groups = linked_groups(docs, profile, entries, width, percent, block_shingles)
    discard(docs.sparkSession, shared)
    return groups


def linked_groups(docs: DataFrame, profile: DataFrame, entries: DataFrame, width: int, percent: int, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Search the blocks that ``entries`` (token, salt, sig) give, and name each document's component."""
    classes, linked = linked_classes(docs, profile, entries, width, percent, block_shingles)
    per_class = keep(classes.join(linked, "sig", "left").select("sig", F.coalesce("least", "rep").alias("component_id")), "classes")
    return (
        profile.join(per_class, "sig", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def linked_classes(docs: DataFrame, profile: DataFrame, entries: DataFrame, width: int, percent: int, block_shingles: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """Classes (sig, rep, n, copies), and (sig, least) of those that have a link: the smallest doc_id of their component."""
    parts = partitions(docs.sparkSession)
    edges = _candidates(entries, parts)
    classes = profile.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    blocks = components(edges).withColumnsRenamed({"id": "sig", "component": "block"})
    members = keep(blocks.join(classes, "sig"), "members")
    sizes = members.groupBy("block").agg(F.ceil(F.sum("n") / F.lit(block_shingles)).cast("int").alias("parts"))
    members = keep(members.join(sizes, "block").select("block", "parts", "sig", "rep"), "sized")
    likely, bits = _member_filter(members)
    hashed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("h"))
    found = hashed.transform(in_batches, _shingled(width, likely), "doc_id long, sig long, shingles binary").withColumnRenamed("sig", "digest")
    shingled = found.join(members, found["doc_id"].eqNullSafe(members["rep"]) & (found["digest"] == members["sig"])).select("block", "parts", "sig", "shingles")
    own = F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")
    tiled = shingled.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiled = tiled.select(F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "sig", "shingles")
    links = tiled.repartition(parts, "tile").sortWithinPartitions("tile", "sig").transform(in_batches, _block_links(percent, block_shingles), "a long, b long")
    linked = keep(components(links).withColumnsRenamed({"id": "sig"}).join(classes, "sig").select("sig", "component", "rep"), "linked")
    smallest = linked.groupBy("component").agg(F.min("rep").alias("least"))
    return classes, linked.join(smallest, "component").select("sig", "least")


def _candidates(entries: DataFrame, parts: int) -> DataFrame:
    """Distinct star edges of the short lists; the salted parts of a list are joined by their centres."""
    dealt = entries.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", "sig")
    stars = keep(dealt.transform(in_batches, _stars, "a long, b long, token long"), "stars")
    discard(entries.sparkSession)
    tops = stars.where("token is not null").select("token", "a").distinct()
    first = tops.groupBy("token").agg(F.min("a").alias("b"))
    across = tops.join(first, "token").where("a != b").select("a", "b")
    return stars.where("token is null").select("a", "b").unionByName(across).distinct()


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their group; all columns."""
    groups = ngram_join(docs, width, percent)
    rest = groups.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(rest, "doc_id", "left_anti")
