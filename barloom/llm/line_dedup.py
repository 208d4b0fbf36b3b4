"""Operator 7 [native]: near-duplicate lines by a segment-partition edit join.

Lines are the texts cut at newlines.  Two lines are alike when they are equal, or
when both have ``MIN_CHARS`` code points or more and their edit distance is at
most ``threshold``; alike lines, taken transitively, are a class.  Of each class
the first occurrence (by doc_id, then place) stays and every other goes.  Lines
of white space alone are never alike.

Only DataFrame and SQL functions are used:

1. Lines become 64-bit hashes (equal lines are one), and each carries the hashes of
   its ``threshold + 1`` even segments (index) and of the substrings, of
   lines up to ``threshold`` shorter, that may equal such a segment (probe): the
   multi-match-aware windows of a segment-partition join.  A key holds the
   indexed line's length and the segment's number.  They are aggregated by line
   before the shuffle, so a line that fills the corpus is sent once a task.
2. One shuffle by key leaves the keys that two lines share.  The texts of their lines
   are fetched behind a broadcast bit table of the hashes wanted, of at most
   ``FILTER_BITS`` bits, so that few lines are shuffled, and a semi join leaves the lines
   that have a partner of which the counts of twelve letters allow the
   distance (an edit changes two counts by one at most).
3. The lines of a key are compared with one pivot of the key, and then those that
   aren't known to be connected with each other, by a banded bit-parallel edit
   distance: the band of ``2 * threshold + 1`` rows is one word, moved along the diagonal.
4. Components of the verified pairs are the classes.  A bit mask of each
   document's surviving lines goes back to it; documents that lose no line are
   told by another such table and stay where they are.

Defined cases: a null text stays null and has no lines; an empty text is one
blank line; rows of equal doc_id and text are the same document, so they lose the
same lines; a null doc_id sorts after all others; extra columns are kept by
:func:`drop_repeated_lines` and can't clash.  Two different lines of equal 64-bit
hash would be taken for one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.shared import columns, components, discard, keep

THRESHOLD = 2
MIN_CHARS = 20
FILTER_BITS = 1 << 24
"""Most bits of a broadcast table (a row of 16 bytes for each 64)."""
# Fixed value: the most frequent letters of English text, whose counts tell lines apart.
LETTERS = "etaoinshrdlu"
INDEXED = 1 << 60
"""Bit of a row's mark, above the letter counts, that says that its key is an index key."""
SAMPLE, HOT_LINES, HOT_KEYS, SALTS = 64, 1 << 13, 1 << 14, 64
"""Keys of ``HOT_LINES`` lines or so, judged by one line in ``SAMPLE``, are dealt by ``SALTS``; ``HOT_KEYS`` of them at most. Results don't depend on it."""
SMALL_MEMBERS, SMALL_BYTES = 1 << 14, 32 << 20
"""Rows of keys, and bytes of their lines, up to which lines are compared in one task without shuffles."""
PIVOT_ROUNDS, PAIRS_A_ROW = 4, 8
"""Rounds of comparisons with pivots, made only while lines of a key that are apart make more pairs than ``PAIRS_A_ROW`` a row."""


def _shift(value: Column, by: Column) -> Column:
    """Arithmetic shift to the right by a column."""
    return F.call_function("shiftright", value, by)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, t, pos, line): t is the hash of the text."""
    return docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def _segment(n: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment ``i`` (from 0) of a line of ``n`` code points; the later ones take the odd code points."""
    base, odd = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    late = F.lit(i) - (F.lit(parts) - odd)
    return (F.lit(1) + base * i + F.greatest(late, F.lit(0))), base + F.when(late >= 0, 1).otherwise(0)


def _key(line: Column, indexed: Column, i: int, start: Column, size: Column) -> Column:
    return F.xxhash64(indexed, F.lit(i), F.substring(line, start, size))


def segment_keys(line: Column, n: Column, threshold: int) -> tuple[list[Column], list[Column]]:
    """The index keys of a line of ``n`` code points, which also find lines of its own length, and the other probe keys."""
    parts = threshold + 1
    index = [_key(line, n, i, *_segment(n, i, parts)) for i in range(parts)]
    probe = []
    for shorter in range(threshold + 1):
        other = n - shorter
        for i in range(parts):
            start, size = _segment(other, i, parts)
            # A segment with i before it moves by i at most, seen from the left, and by what is left of the threshold, seen from the right.
            low, high = max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i))
            probe += [_key(line, other, i, start + move, size) for move in range(low, high + 1) if shorter or move]
    return index, probe


def letter_counts(line: Column, n: Column) -> Column:
    """The counts of :data:`LETTERS` and above them the length, four bits each."""
    size = F.octet_length(line)
    packed = [F.shiftleft((size - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(15)).cast("long"), 4 * k) for k, c in enumerate(LETTERS)]
    packed.append(F.shiftleft(n.bitwiseAND(F.lit(15)).cast("long"), 4 * len(LETTERS)))
    return reduce(lambda a, b: a.bitwiseOR(b), packed)


def counts_within(a: Column, b: Column, threshold: int) -> Column:
    """Whether packed counts differ by no more than ``threshold`` edits can make them (counts are modulo 16)."""
    nibble = lambda v, k: F.shiftright(v, 4 * k).bitwiseAND(F.lit(15)) if k else v.bitwiseAND(F.lit(15))
    apart = [(nibble(a, k) - nibble(b, k)).bitwiseAND(F.lit(15)) for k in range(len(LETTERS))]
    return reduce(lambda p, q: p + q, [F.least(d, 16 - d) for d in apart]) <= 2 * threshold


def _bit_table(hashes: DataFrame, h: str = "h") -> tuple[DataFrame, int]:
    """(word, bits): a bit for each hash, modulo the number of bits."""
    size = min(FILTER_BITS, max(1 << 16, 1 << (16 * hashes.count()).bit_length()))
    at = F.pmod(F.col(h), F.lit(size))
    words = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    return keep(words, "bit-table"), size


def _marked(df: DataFrame, table: DataFrame, size: int, h: str, how: str = "inner") -> DataFrame:
    """Rows whose hash may be in the table (or, with ``left``, all rows and a column ``likely``)."""
    at = F.pmod(F.col(h), F.lit(size))
    found = df.withColumn("_at", at).join(F.broadcast(table), F.shiftright("_at", 6) == F.col("word"), how)
    likely = F.coalesce(_shift(F.col("bits"), F.col("_at").bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    found = found.withColumn("likely", likely).drop("_at", "word", "bits")
    return found if how == "left" else found.where("likely").drop("likely")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for the row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _trimmed(a: Column, b: Column) -> Column:
    """The two strings without the prefix and then the suffix that they share, found by doubling steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(27))])

    def common(t: Column, most: Column, piece) -> Column:
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= most) & (piece("a", "m", n, step) == piece("b", "n", n, step)), n + step).otherwise(n))

    def suffix(t: Column) -> Column:
        return common(t, F.least(t["m"], t["n"]) - t["p"], lambda c, n, done, step: F.substring(t[c], t[n] - done - step + 1, step))

    def prefix(t: Column) -> Column:
        return common(t, F.least(t["m"], t["n"]), lambda c, n, done, step: F.substring(t[c], done + 1, step))

    whole = F.struct(a.alias("a"), b.alias("b"), F.char_length(a).alias("m"), F.char_length(b).alias("n"))
    headless = lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["m"].alias("m"), t["n"].alias("n"), prefix(t).alias("p"))
    both = lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["m"].alias("m"), t["n"].alias("n"), t["p"].alias("p"), suffix(t).alias("q"))
    cut = lambda t, c, n: F.substring(t[c], t["p"] + 1, t[n] - t["p"] - t["q"])
    return _let(_let(_let(whole, headless), both), lambda t: F.struct(cut(t, "a", "m").alias("a"), cut(t, "b", "n").alias("b")))


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of two strings is at most ``threshold`` (31 at most).

    What the strings share at either end is cut off first.  Then bit-parallel in
    a band: bit r of the state stands for row ``j - threshold + r`` at column j, so the
    word moves down the diagonal by one row a column.  The score follows the
    band's last row to the end, and then goes up the last column.
    """
    letters = lambda t: F.struct(F.split(t["a"], "").alias("x"), F.split(t["b"], "").alias("y"), F.char_length(t["a"]).alias("m"), F.char_length(t["b"]).alias("n"))
    close = lambda t: F.abs(t["m"] - t["n"]) <= threshold
    sizes = F.abs(F.char_length(a) - F.char_length(b)) <= threshold
    return sizes & _let(_let(_trimmed(a, b), letters), lambda t: close(t) & _banded(t, threshold))


def _banded(t: Column, threshold: int) -> Column:
    """The banded distance of the letters ``x`` (m of them) and ``y`` (n)."""
    width = 2 * threshold + 1
    full = (1 << width) - 1
    m, n = t["m"], t["n"]
    let = _let

    def column(state: Column, j: Column) -> Column:
        """One column (j from 1): equality bits beside the vertical differences."""

        def bits(v: Column) -> Column:
            c = v["c"]
            out = []
            for k in range(width):
                at = j - 1 - threshold + k
                same = F.coalesce(F.get(t["x"], at) == c, F.lit(False))  # null outside the string
                out.append(F.when(same, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
            return F.struct(state["vp"].alias("vp"), state["vn"].alias("vn"), reduce(lambda p, q: p.bitwiseOR(q), out).alias("eq"), state["score"].alias("score"))

        return let(F.struct(F.get(t["y"], j - 1).alias("c")), bits)

    def diagonal(s: Column) -> Column:
        vp, vn, eq = s["vp"], s["vn"], s["eq"]
        return (((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(eq).bitwiseOR(vn)).bitwiseAND(F.lit(full))

    def moved(s: Column) -> Column:
        d0 = s["d0"]
        hp = s["vn"].bitwiseOR(F.bitwise_not(d0.bitwiseOR(s["vp"]))).bitwiseAND(F.lit(full))
        hn = d0.bitwiseAND(s["vp"])
        down = F.shiftright(d0, 1)
        vp = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(F.lit(full))
        vn = down.bitwiseAND(hp)
        miss = F.when(d0.bitwiseAND(F.lit(1 << (width - 1))) == 0, 1).otherwise(0)
        return F.struct(vp.alias("vp"), vn.alias("vn"), (s["score"] + miss).alias("score"))

    def step(state: Column, j: Column) -> Column:
        def with_diagonal(s: Column) -> Column:
            return let(F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["score"].alias("score"), diagonal(s).alias("d0")), moved)

        go = let(column(state, j), with_diagonal)
        # The score is that of the band's last row: it never falls, and at most 2 * threshold steps up remain at the end.
        return F.when(state["score"] > 3 * threshold, state).otherwise(go)

    # Rows above the text's first (r < threshold) have no vertical steps; the band's last row starts at ``threshold``.
    first = F.struct(F.lit(full ^ ((1 << threshold) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(threshold).alias("score"))
    last = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), first, step)).otherwise(first)

    def finish(s: Column) -> Column:
        # The word stands one row further down already: row m + 1 is bit m - n + threshold, the band's last row is bit width - 2.
        place = m - n + threshold
        rows = F.sequence(F.lit(width - 2), F.lit(0), F.lit(-1))
        up = F.aggregate(
            rows, s["score"],
            lambda score, r: F.when(r >= place, score - _shift(s["vp"], r).bitwiseAND(F.lit(1)).cast("int") + _shift(s["vn"], r).bitwiseAND(F.lit(1)).cast("int")).otherwise(score),
        )
        return up <= threshold

    return let(last, finish)


def _keys(per_line: DataFrame, index: int, probe: int) -> DataFrame:
    """Rows (key, h, indexed): the keys of each line."""
    pairs = [F.struct(F.col(f"i{k}").alias("key"), F.lit(True).alias("indexed")) for k in range(index)]
    pairs += [F.struct(F.col(f"p{k}").alias("key"), F.lit(False).alias("indexed")) for k in range(probe)]
    return per_line.select("h", F.inline(F.array(*pairs)))


def _shared_keys(per_line: DataFrame, index: int, probe: int) -> DataFrame:
    """The rows of :func:`_keys` whose key two lines have, one of them as index key.

    The rows of a key meet in one window.  Keys that a sample of the lines shows to be
    frequent are dealt over ``SALTS`` windows, and all their rows are kept.
    """
    some = _keys(per_line.where(F.pmod("h", F.lit(SAMPLE)) == 0), index, probe).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = keep(some.where(F.col("n") >= HOT_LINES // SAMPLE).orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key", F.lit(True).alias("hot")), "hot-keys")
    rows = _keys(per_line, index, probe)
    by = ["key"]
    if hot.limit(1).count():
        rows = rows.join(F.broadcast(hot), "key", "left")  # HOT_KEYS rows at most
        rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("h"), F.lit(SALTS)) + 1).otherwise(F.lit(0).cast("long")))
        by = ["key", "salt"]
    same = Window.partitionBy(*by)
    told = rows.withColumns({"least": F.min("h").over(same), "most": F.max("h").over(same), "found": F.max("indexed").over(same)})
    shared = (F.col("least") < F.col("most")) & F.col("found")
    return told.where(shared | (F.col("salt") > 0) if len(by) > 1 else shared).select("key", "h", "indexed")


def _meet(a: Column, b: Column, threshold: int) -> Column:
    """Whether two rows of a key may be alike: one is indexed, and their letters allow it."""
    return (a.bitwiseOR(b).bitwiseAND(F.lit(INDEXED)) != 0) & counts_within(a, b, threshold)


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc_id, t, pos, h; h null for blank lines), and (h, class) of the lines alike to another line."""
    docs = columns(docs, doc_id="long", text="string")
    spark = docs.sparkSession
    solid = F.col("line").rlike("[^ \t\r\f\x0b]")
    occurrences = keep(_lines(docs).select("doc_id", "t", "pos", F.when(solid, F.xxhash64("line")).alias("h")), "lines")
    index, probe = segment_keys(F.col("line"), F.col("n"), threshold)
    long = _lines(docs).where(solid).select("line", F.char_length("line").alias("n")).where(F.col("n") >= max(min_chars, 2 * threshold + 1))
    # One long for each key: equal lines then meet in a hash aggregate (their keys are equal, so the maximum is any of them).
    named = {f"i{k}": c for k, c in enumerate(index)} | {f"p{k}": c for k, c in enumerate(probe)}
    keyed = long.select(F.xxhash64("line").alias("h"), *[c.alias(k) for k, c in named.items()])
    per_line = keep(keyed.groupBy("h").agg(*[F.max(k).alias(k) for k in named]), "segments")
    discard(spark)
    shared = keep(_shared_keys(per_line, len(index), len(probe)), "shared-keys")
    discard(spark, per_line)
    texts = _texts(docs, shared)
    letters = texts.select("h", letter_counts(F.col("line"), F.char_length("line")).alias("letters"))
    marked = shared.join(letters, "h").select("key", "h", F.when(F.col("indexed"), F.col("letters").bitwiseOR(F.lit(INDEXED))).otherwise(F.col("letters")).alias("mark"))
    marked = keep(marked.groupBy("key", "h").agg(F.max("mark").alias("mark")), "marked")
    # A line that no other may be alike to is out; the semi join gives no pairs.
    other = marked.select(F.col("key").alias("key_b"), F.col("h").alias("b"), F.col("mark").alias("mark_b"))
    near = (F.col("key") == F.col("key_b")) & (F.col("h") != F.col("b")) & _meet(F.col("mark"), F.col("mark_b"), threshold)
    members = keep(marked.join(other, near, "left_semi"), "members")
    discard(spark, shared, marked)
    if members.count() <= SMALL_MEMBERS:
        own = keep(texts.join(members.select("h").distinct(), "h", "left_semi").coalesce(1), "few-texts")
        if (own.agg(F.sum(F.octet_length("line"))).first()[0] or 0) <= SMALL_BYTES:
            members, texts = keep(members.coalesce(1), "few-members"), own
    links = _links(members, texts, threshold)
    return occurrences, components(links).select(F.col("id").alias("h"), F.col("component").alias("class"))


def _links(members: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Alike lines (a, b) that connect every class of the ``members`` (key, h, mark) of keys.

    Each line of a key is compared with one pivot of the key, for some rounds while
    many lines of a key are apart; then those lines of a key that aren't known to be
    connected are compared with each other.  So a group of near copies takes
    as many comparisons as it has lines, not their square, and no connection is missed.
    """
    n = members.count()
    links, parts, tested = None, members.withColumn("part", F.col("h")), None
    for k in range(PIVOT_ROUNDS):
        apart = parts.groupBy("key", "part").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("key").agg((F.pow(F.sum("n"), 2) - F.sum(F.col("n") * F.col("n"))).alias("pairs"))
        if (apart.agg(F.sum("pairs")).first()[0] or 0) <= PAIRS_A_ROW * n:
            break
        turn = F.xxhash64("h", F.lit(k)) if k else F.col("h")
        pivots = parts.where(F.col("mark").bitwiseAND(F.lit(INDEXED)) != 0).groupBy("key").agg(F.min(F.struct(turn.alias("turn"), "h", "mark", "part")).alias("pivot"))
        stars = parts.join(pivots, "key").where((F.col("part") != F.col("pivot.part")) & _meet(F.col("mark"), F.col("pivot.mark"), threshold))
        stars = stars.select(F.least("h", "pivot.h").alias("a"), F.greatest("h", "pivot.h").alias("b")).distinct()
        stars = keep(stars if tested is None else stars.join(tested, ["a", "b"], "left_anti"), "stars")
        found = keep(_alike(stars, texts, threshold), "links")
        tested = stars if tested is None else tested.unionByName(stars)
        links = found if links is None else links.unionByName(found)
        parts = keep(members.join(_near(links), "h", "left").select("key", "h", "mark", F.coalesce("part", "h").alias("part")), "parts")
    left = parts.where(F.col("mark").bitwiseAND(F.lit(INDEXED)) != 0).select(F.col("key").alias("key_a"), F.col("h").alias("a"), F.col("mark").alias("mark_a"), F.col("part").alias("part_a"))
    both = F.col("mark").bitwiseAND(F.lit(INDEXED)) != 0  # such a pair meets from both sides
    once = ~both | (F.col("a") < F.col("h"))
    pairs = left.join(parts, (F.col("key_a") == F.col("key")) & (F.col("part_a") != F.col("part")) & once & counts_within(F.col("mark_a"), F.col("mark"), threshold))
    pairs = pairs.select(F.least("a", "h").alias("a"), F.greatest("a", "h").alias("b")).distinct()
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    rest = _alike(keep(pairs, "pairs"), texts, threshold)
    return rest if links is None else links.unionByName(rest)


def _near(links: DataFrame) -> DataFrame:
    """(h, part): the smallest line within two links or so; lines of one part are connected, though connected lines may differ in it."""
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    one = both.groupBy("x").agg(F.min("y").alias("p")).select("x", F.least("x", "p").alias("p"))
    two = both.join(one.select(F.col("x").alias("y"), F.col("p").alias("q")), "y").groupBy("x").agg(F.min("q").alias("q"))
    return one.join(two, "x").select(F.col("x").alias("h"), F.least("p", "q").alias("part"))


def _alike(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The ``pairs`` (a, b) of hashes whose lines are within the threshold."""
    with_a = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("line_a")), "a")
    both = with_a.join(texts.select(F.col("h").alias("b"), F.col("line").alias("line_b")), "b")
    return both.where(within(F.col("line_a"), F.col("line_b"), threshold)).select("a", "b")


def _texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(h, line) of the lines in ``members``, once each."""
    wanted = keep(members.select("h").distinct(), "wanted")
    lines = _marked(_lines(docs).select(F.xxhash64("line").alias("h"), "line"), *_bit_table(wanted), "h")
    # Equal lines are one before the join, so a line that fills the corpus is sent once a task.
    return keep(lines.groupBy("h").agg(F.first("line").alias("line")).join(wanted, "h", "left_semi"), "texts")


def surviving(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, t, n_lines, n_kept, mask): of each document, the surviving lines as words of 64 bits."""
    occurrences, classes = line_classes(docs, threshold, min_chars)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t", "pos")
    per_line = occurrences.where("h is not null").groupBy("h").agg(F.min(order).alias("first"))  # before the join, so no line is frequent there
    first = per_line.join(classes, "h", "left").groupBy(F.coalesce("class", "h").alias("class")).agg(F.min("first").alias("first"))
    first = first.select(F.col("first.doc_id").alias("doc_id"), F.col("first.t").alias("t"), F.col("first.pos").alias("pos"), F.lit(True).alias("stays"))
    blank = occurrences.where("h is null").select("doc_id", "t", "pos", F.lit(True).alias("stays")).distinct()
    every = occurrences.select("doc_id", "t", "pos", F.lit(False).alias("stays")).distinct()
    flags = first.unionByName(blank).unionByName(every).groupBy("doc_id", "t", "pos").agg(F.max("stays").alias("stays"))
    bit = F.when(F.col("stays"), F.expr("shiftleft(1L, pos & 63)")).otherwise(F.lit(0).cast("long"))
    words = flags.groupBy("doc_id", "t", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n"), F.count_if("stays").alias("kept")
    )
    return words.groupBy("doc_id", "t").agg(
        F.sum("n").alias("n_lines"), F.sum("kept").alias("n_kept"), F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("mask")
    )


def _cut(text: Column, mask: Column) -> Column:
    stays = lambda i: _shift(F.get(mask, F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: stays(i)), "\n")


def _applied(docs: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """``docs`` with the surviving lines as ``text``, and how many lines there were and are (``\u0001n``, ``\u0001kept``).

    Only documents that may lose a line meet their marks; the others stay as they are.
    """
    n, kept, mask, key = "\u0001n", "\u0001kept", "\u0001mask", "\u0001key"
    marks = surviving(columns(docs, doc_id="long", text="string"), threshold, min_chars).where("n_kept < n_lines")
    marks = marks.select(F.xxhash64("doc_id", "t").alias(key), F.col("doc_id").alias("\u0001id"), F.col("t").alias("\u0001t"), F.col("n_lines").alias(n), F.col("n_kept").alias(kept), F.col("mask").alias(mask))
    marks = keep(marks, "marks")
    table, size = _bit_table(marks, key)
    keyed = docs.withColumn("\u0001text", F.xxhash64(docs["text"].cast("string"))).withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("\u0001text")))
    told = _marked(keyed, table, size, key, "left")
    names = [F.col(f"`{c}`") for c in docs.columns]
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    same = told.where("not likely or text is null").select(*names, count.alias(n), count.alias(kept))
    maybe = told.where("likely and text is not null").drop("likely").withColumnRenamed(key, "\u0001own")
    hit = maybe.join(marks, (F.col("\u0001own") == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col("\u0001id")) & (F.col("\u0001text") == F.col("\u0001t")), "left")
    cut = F.when(F.col(mask).isNull(), F.col("text")).otherwise(_cut(F.col("text"), F.col(mask)))
    changed = hit.select(*[cut.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.coalesce(n, count).cast("long").alias(n), F.coalesce(kept, count).cast("long").alias(kept))
    return same.unionByName(changed)


def dedup_report(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (doc_id, n_lines, n_kept, text_sha256), one for each row of ``docs``: of the text that is left."""
    out = _applied(columns(docs, doc_id="long", text="string"), threshold, min_chars)
    return out.select("doc_id", F.col("\u0001n").alias("n_lines"), F.col("\u0001kept").alias("n_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def drop_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``; documents that are left without any line but blank ones go."""
    out = _applied(docs, threshold, min_chars)
    gone = (F.col("\u0001kept") < F.col("\u0001n")) & ~F.col("text").rlike("[^ \n\t\r\f\x0b]")
    return out.where(~F.coalesce(gone, F.lit(False))).drop("\u0001n", "\u0001kept")
