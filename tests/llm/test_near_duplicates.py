"""Operators 1 and 2 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from barloom.llm import minhash, ngram_join
from barloom.llm.shared import components


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= 5:
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def groups(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d is None, d or 0, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["Éa", "ça", "ÀB", "日本"]
    texts = []
    for k in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts[-40:]).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 6, 30, 90, 160]))))
    texts[5], texts[6], texts[7] = "", None, " \t\n "
    texts[8] = texts[9].upper().replace("ç", "ç")
    return list(enumerate(texts))


SCHEMA = "doc_id long, text string, sig string, n long, block string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 7, "y") for d, t in rows], SCHEMA)


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in df.collect())


def test_join_equals_brute_force(spark):
    rows = corpus()
    assert got(ngram_join.ngram_join(frame(spark, rows))) == groups(rows)


def test_blocks_cut_into_parts_lose_no_link(spark):
    rows = corpus(seed=9)
    assert got(ngram_join.ngram_join(frame(spark, rows), block_shingles=200)) == groups(rows)


def test_join_of_repeated_and_null_ids(spark):
    text = " ".join(f"a{k}" for k in range(40))
    rows = [(4, text), (4, text), (4, "other words are here now indeed"), (None, text), (None, None), (2, "short one"), (9, "Short  one")]
    assert got(ngram_join.ngram_join(frame(spark, rows))) == sorted(
        [(False, 4, 36, 4), (False, 4, 36, 4), (False, 4, 2, 4), (True, 0, 36, 4), (True, 0, 0, None), (False, 2, 1, 2), (False, 9, 1, 2)]
    )


def test_join_of_an_empty_table(spark):
    assert ngram_join.ngram_join(frame(spark, []).limit(0)).collect() == []


def test_minhash_groups_equal_brute_force(spark):
    rows = corpus(seed=5)
    assert got(minhash.near_duplicates(frame(spark, rows))) == groups(rows)


def test_keep_one(spark):
    rows = corpus(seed=4)
    kept = {r.doc_id for r in ngram_join.keep_one(frame(spark, rows)).collect()}
    assert kept == {d for _, d, _, c in groups(rows) if d == c}


def brute_edited(rows):
    rows = sorted(((d, t or "") for d, t in rows))
    out = {}
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        out[d] = (t, t[: len(t) - half] + after[:half], after)
    return out


@pytest.mark.parametrize("rows", [corpus(seed=6), [(3, "only one")], [(1, None), (8, "é" * 9), (-5, "x y z")]])
def test_edited_fingerprints(spark, rows):
    want = brute_edited(rows)
    out = minhash.edited_fingerprints(frame(spark, rows).repartition(5)).collect()
    assert sorted(r.doc_id for r in out) == sorted(want)
    alike = {}
    for r in out:
        text, edited, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert alike.setdefault(text, r.fingerprint) == r.fingerprint
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = shingle_set(text), shingle_set(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - true) < 0.25


def test_edited_of_an_empty_table(spark):
    assert minhash.edited_fingerprints(frame(spark, []).limit(0)).collect() == []


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    rows = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(rows) == len(want) and {r.id: r.component for r in rows} == want
