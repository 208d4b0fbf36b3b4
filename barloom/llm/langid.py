"""Operator 3: language identification by rank-order profiles.

Texts are lower-cased, runs of anything but letters are one blank, and 1- to
3-grams of letters and blanks are counted over the whole text.  A language's
profile is its ``PROFILE`` most frequent n-grams in rank order; a document's is
made alike.  Their distance sums, over the document's n-grams, how far each is
out of place (``PROFILE`` where the language lacks it); the nearest language
wins, ties going to the smaller name.  The score is one minus the distance over
its largest possible value.

The profiles are fitted on at most ``PER_LANGUAGE`` labelled documents of each
language, taken in the order of a hash of doc_id (of a frequent language, among the twice
``PER_LANGUAGE`` or so that its size lets come first) from those whose crc32(doc_id)
mod 4 is not 2; their whole texts are used.

Defined cases: a null text, or one without letters, is ``und`` with score 0, and
so is every text if nothing could be learned; rows with a null doc_id are neither
held out nor learned from; labels that are null or empty are not learned; rows of
equal doc_id are predicted each by its own text; extra columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.shared import columns, in_batches, keep

PROFILE = 300
PER_LANGUAGE = 400
"""Labelled documents that a language's profile is fitted on, at most."""
BROADCAST_ROWS = 1 << 18
"""Chosen rows up to which they are broadcast to the texts; more (of very many languages) are joined by a shuffle."""
REJECT_SHARE = 0.5
"""Scores below this share of the median score of a language's learned texts are taken for no language by :func:`keep_known`."""
UNKNOWN = "und"
_B1, _B2 = np.int64(1 << 21), np.int64(1 << 42)
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text (as code points in base 2**21), ascending, and their counts."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cp = np.where(_is_letter()[cp], cp, 0)
    solid = cp > 0
    if not solid.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    use = solid.copy()
    use[1:] |= solid[:-1]  # the first blank after a letter
    c = np.concatenate([[0], cp[use], [0]])
    two = c[:-1] * _B1 + c[1:]
    three = c[:-2] * _B2 + two[1:]
    bounds = (c[:-1] > 0) | (c[1:] > 0)
    inner = (c[1:-1] > 0)
    return np.unique(np.concatenate([c[c > 0], two[bounds], three[inner]]), return_counts=True)


def top(gram: np.ndarray, count: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in rank order; ties by code points."""
    return gram[np.argsort(-count, kind="stable")[:most]]


def _learned_texts(docs: DataFrame, per_language: int) -> DataFrame:
    """Rows (lang, text) that the profiles are fitted on."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    labelled = docs.where(F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull() & (remainder != 2))
    # Most rows of a frequent language are out by their hash already, so no task ranks a language's rows in full.
    sizes = keep(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "languages")
    small = sizes.count() <= BROADCAST_ROWS
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    near = labelled.select("doc_id", "lang").join(F.broadcast(sizes) if small else sizes, "lang").where(place.cast("double") * F.col("size") <= 2.0 * per_language * (1 << 40))
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    chosen = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language)
    chosen = keep(chosen.select("doc_id", "lang").distinct(), "learned-from")
    small = chosen.count() <= BROADCAST_ROWS  # it has per_language rows for each language at most
    return labelled.join(F.broadcast(chosen) if small else chosen, ["doc_id", "lang"]).select("lang", "text")


def _profiles(texts: DataFrame) -> dict[str, np.ndarray]:
    def count(batches):
        sums: dict[str, dict[int, int]] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                into = sums.setdefault(lang, {})
                g, n = grams(text)
                for x, y in zip(g.tolist(), n.tolist(), strict=True):
                    into[x] = into.get(x, 0) + y
        for lang, into in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(into)), pa.array(list(into), pa.int64()), pa.array(list(into.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = texts.transform(in_batches, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counted.withColumn("k", F.row_number().over(best)).where(F.col("k") <= PROFILE).toPandas()
    return {lang: part.sort_values("k")["gram"].to_numpy(np.int64) for lang, part in sorted(ranked.groupby("lang"))}


def distances(profile: np.ndarray, languages: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """Out-of-place distance of a ranked profile to each language (sorted n-grams, their ranks)."""
    place = np.arange(len(profile))
    out = []
    for known, rank in languages:
        at = np.searchsorted(known, profile)
        at[at == len(known)] = 0
        out.append(int(np.where(known[at] == profile, np.abs(rank[at] - place), PROFILE).sum()))
    return out


def _predict(profiles: dict[str, np.ndarray]):
    names = sorted(profiles)
    known = []
    for name in names:
        by = np.argsort(profiles[name])
        known.append((profiles[name][by], by))

    def run(batches):
        for b in batches:
            lang, score = [], []
            for text in b.column("text"):
                g, n = grams(text.as_py() or "")
                if not len(g) or not names:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                profile = top(g, n)
                far = distances(profile, known)
                k = int(np.argmin(far))
                lang.append(names[k])
                score.append(1 - far[k] / (PROFILE * len(profile)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each row of ``docs`` (doc_id, text, lang)."""
    docs = columns(docs, doc_id="long", text="string", lang="string")
    profiles = _profiles(_learned_texts(docs, per_language))
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    found = docs.select("doc_id", "text").transform(in_batches, _predict(profiles), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def _floors(texts: DataFrame, profiles: dict[str, np.ndarray], share: float) -> dict[str, float]:
    """The score below which a text is taken for no language: ``share`` of the median score of those learned texts that are of the language."""
    found = texts.select(F.lit(None).cast("long").alias("doc_id"), "text").transform(in_batches, _predict(profiles), "doc_id long, lang_pred string, score double")
    rows = found.where(F.col("lang_pred") != UNKNOWN).groupBy("lang_pred").agg(F.percentile("score", F.lit(0.5)).alias("median")).collect()
    return {r.lang_pred: share * r.median for r in rows}


def keep_known(docs: DataFrame, reject_share: float = REJECT_SHARE, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a known language.

    Rejected are texts that are ``und`` and those that score below ``reject_share`` of
    what the learned texts of their language score (its median), so far from every
    learned profile.  A language of which no learned text was predicted rejects none.
    """
    texts = keep(_learned_texts(columns(docs, doc_id="long", text="string", lang="string"), per_language), "learned-texts")
    profiles = _profiles(texts)
    floors = _floors(texts, profiles, reject_share)
    predict = _predict(profiles)

    def run(batches):
        for b in batches:
            rows = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column("text")], names=["doc_id", "text"])
            out = next(iter(predict([rows])))
            ok = [x != UNKNOWN and y >= floors.get(x, 0.0) for x, y in zip(out.column("lang_pred").to_pylist(), out.column("score").to_pylist(), strict=True)]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.transform(in_batches, run, docs.schema)
