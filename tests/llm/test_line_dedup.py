"""Operator 7 against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from barloom.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, line, k):
    line = list(line)
    for _ in range(k):
        at = rng.randrange(len(line) + 1)
        kind = rng.choice("ids")
        if kind == "i":
            line.insert(at, rng.choice("abcé日"))
        elif line and at < len(line):
            if kind == "d":
                del line[at]
            else:
                line[at] = rng.choice("abcé日")
    return "".join(line)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng = random.Random(threshold)
    pairs = [("", ""), ("", "a"), ("abc", ""), ("a", "b"), ("ab", "ba")]
    for _ in range(300):
        a = "".join(rng.choice("abcé日") for _ in range(rng.choice([1, 2, 3, 8, 30])))
        pairs.append((a, edited(rng, a, rng.randrange(6))))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", L.within(F.col("a"), F.col("b"), threshold).alias("ok")).collect()
    for r in got:
        assert r.ok == (distance(r.a, r.b) <= threshold), (r.a, r.b, distance(r.a, r.b))


def brute(rows, threshold=2, least=20):
    where, lines = {}, []
    for d, t in rows:
        if t is not None:
            for p, line in enumerate(t.split("\n")):
                if line.strip(" \t\r\f\x0b"):
                    where.setdefault(line, []).append((d is None, d or 0, p))
    lines = sorted(where)
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold:
                root[find(a)] = find(b)
    first = {}
    for x in lines:
        first[find(x)] = min([*where[x], first.get(find(x), (True, 1 << 60, 0))])
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, 0, 0, None))
            continue
        kept = [line for p, line in enumerate(t.split("\n")) if not line.strip(" \t\r\f\x0b") or first[find(line)] == (d is None, d or 0, p)]
        out.append((d, len(t.split("\n")), len(kept), "\n".join(kept)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefgh é日") for _ in range(rng.choice([3, 19, 20, 21, 40, 90]))) for _ in range(40)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(rng.choice([1, 3, 9, 80])):
            line = rng.choice(pool)
            lines.append(edited(rng, line, rng.choice([0, 0, 1, 2, 5])) if rng.random() < 0.7 else rng.choice(["", "  ", "\t", line]))
        rows.append((k, "\n".join(lines)))
    return [*rows, (70, None), (71, ""), (72, "\n\n"), (None, rows[3][1]), (3, rows[3][1])]


SCHEMA = "doc_id long, text string, n_lines string, mask string"
key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))


def test_against_brute_force(spark):
    rows = corpus(1)
    table = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(4)
    want = brute(rows)
    sha = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    got = sorted((tuple(r) for r in L.dedup_report(table).collect()), key=key)
    assert got == sorted(((d, n, k, sha(t)) for d, n, k, t in want), key=key)
    left = sorted(((r.doc_id, r.text, r.n_lines, r.mask) for r in L.drop_repeated_lines(table).collect()), key=key)
    stay = [(d, t, "x", "y") for d, n, k, t in want if k == n or t.strip()]
    assert left == sorted(stay, key=key)


def test_empty_table(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert L.dedup_report(table).collect() == []
    assert L.drop_repeated_lines(table).collect() == []
