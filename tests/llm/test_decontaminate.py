"""Operator 6 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from barloom.llm import decontaminate as D

SCHEMA = "doc_id long, text string, item_id string, n_words long"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def brute(docs, items, window=13):
    phrases = {}
    for item, text in items:
        w = [x[0] for x in words(text)]
        for s in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[s : s + window]), set()).add(item)
    sizes = {len(p) for p in phrases}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for i in range(len(w)):
            for n in sizes:
                p = tuple(x[0] for x in w[i : i + n])
                if len(p) == n and p in phrases:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in phrases[p] if x is not None}
        spans = []
        for k in sorted(hit):
            if spans and k - 1 in hit:
                spans[-1][1] = w[k][2]
            else:
                spans.append([w[k][1], w[k][2]])
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w), spans))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)] + ["Éa", "ça", "日本", "x9"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", ".", "-", "\n"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 5, 12, 13, 14, 30]) + (30 if k % 3 else 0))) for k in range(30)]
    items += [(30, None), (31, ""), (32, " - "), (None, items[4][1]), (33, items[4][1]), (33, items[4][1])]
    items = [x for x in items if x[1] is None or len(words(x[1])) != 1 or x[0] == 0]
    docs = []
    for k in range(80):
        t = text(rng.choice([0, 1, 5, 40, 200]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w = (rng.choice(items)[1] or "").split(" ")
            a = rng.randrange(len(w))
            t += " " + " ".join(w[a : a + rng.choice([5, 13, 20, 99])]).upper() + " " + text(rng.choice([0, 1, 50]))
        docs.append((k, t))
    return docs + [(100, None), (101, ""), (102, "..."), (None, items[5][1]), (3, docs[3][1]), (103, ("ab ab " * 50) + (items[6][1] + " ") * 9)], items


@pytest.mark.parametrize(("seed", "shard", "block"), [(1, 1 << 22, 4 << 20), (2, 700, 4 << 20), (3, 3000, 500)])
def test_against_brute_force(spark, monkeypatch, seed, shard, block):
    docs, items = corpus(seed)
    monkeypatch.setattr(D, "SHARD_BYTES", shard)
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    found = D.find_benchmark(table, bench)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(brute(docs, items), key=key)
    got = [tuple(r) for r in D.contamination(found).collect()]
    assert sorted(got, key=key) == [w[:6] for w in want]
    assert sorted((r.doc_id or 0, r.spans) for r in found.collect()) == sorted((w[0] or 0, w[6]) for w in want)
    clean = sorted((r.doc_id or -1, r.text or "") for r in D.clean(table, bench).collect())
    assert clean == sorted((d or -1, t or "") for (d, t), w in zip(docs, brute(docs, items), strict=True) if not w[5])


def test_empty_tables(spark):
    docs, items = corpus(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    assert D.find_benchmark(table.limit(0), bench).collect() == []
    assert all(r.n_hit == 0 and r.n_words >= 0 for r in D.find_benchmark(table, bench.limit(0)).collect())


def test_suffix_array_and_index():
    rng = np.random.default_rng(7)
    for n in (1, 5, 60, 400):
        s = np.concatenate([rng.integers(1, 4, n), np.tile([2, 3, 2], 20), [0]])
        want = sorted(range(len(s)), key=lambda k: s[k:].tolist())
        assert D.suffix_array(s).tolist() == want
        index = D.FMIndex(s, 4)
        assert index.locate(np.arange(len(s))).tolist() == want
        pattern = np.array([[2, 3, 2], [9, 1, 2]]) % 4
        which, low, high = index.search(pattern, np.array([3, 2]))
        for w, a, b in zip(which, low, high, strict=True):
            p = pattern[w].tolist()[0 if w == 0 else 1 :]
            assert sorted(want[a:b]) == [k for k in range(len(s)) if s[k : k + len(p)].tolist() == p]
