"""Operators 9 and 10: ids, exact round trips, full sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from barloom.llm import packing, token_output
from barloom.llm.tokenize import default_path, encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, length string, start long"


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(default_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def rows():
    rng = random.Random(2)
    out = [(k, " ".join(rng.choice(["alpha", "Übung", "日本語", "x1", "don't", "  ", "\n\n", "<|endoftext|>", "😀"]) for _ in range(rng.choice([0, 1, 20, 700, 3000])))) for k in range(60)]
    return [*out, (60, None), (61, ""), (None, "no id"), (5, out[5][1]), (62, "a" * 5000), (63, " " * 3000)]


def test_ids_equal_the_library(spark, reference):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [t for _, t in rows()]
    for t in texts:
        assert encoder(default_path()).ids(t or "").tolist() == reference(t)


def _check_pieces(got, docs, reference, sequence):
    """Every id of each row lies in exactly one piece."""
    want = defaultdict(list)
    for d, t in docs:
        want[d].append(reference(t))
    seen = defaultdict(list)
    for r in got:
        seen[r.doc_id].append((r.start, r.length, r.ids_crc32))
    assert set(seen) == set(want)
    for d, pieces in seen.items():
        assert sum(n for _, n, _ in pieces) == sum(map(len, want[d]))
        crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
        for s, n, c in pieces:
            assert any(crc(ids[s : s + n]) == c for ids in want[d])
    by = defaultdict(list)
    for r in got:
        by[sequence(r)].append((r.offset, r.length))
    fills = []
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at and n > 0
            at += n
        assert at <= 1024
        fills.append(at)
    return fills


def test_cost_balanced(spark, reference):
    docs = rows()
    got = packing.pack(spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(3)).collect()
    fills = _check_pieces(got, docs, reference, lambda r: r.sequence_id)
    assert all(n & (n - 1) == 0 for n in fills)
    total = {(r.doc_id, r.doc_tokens) for r in got}
    assert total == {(d, len(reference(t))) for d, t in docs}


def test_best_fit_files(spark, reference):
    docs = rows()
    got = token_output.packed_digest(spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(3)).collect()
    fills = _check_pieces(got, docs, reference, lambda r: (r.block, r.sequence))
    assert len(fills) <= 1.1 * sum(fills) / 1024 + 3


def test_balance_is_even():
    rng = random.Random(1)
    sizes = [rng.choice([1, 30, 200, 700, 1500]) for _ in range(500)]
    pieces = packing.balance(sizes, 1024)
    spent = defaultdict(float)
    for _, _, n, k, _ in pieces:
        spent[k] += packing.cost(n)
    whole = [spent[k] for k in spent if sum(p[2] for p in pieces if p[3] == k) == 1024]
    worst = packing.cost(1024)
    assert max(whole) <= worst and sorted(whole)[len(whole) // 2] < 0.8 * worst
    assert packing.capacities(1024 * 2 + 700, 1024) == [1024, 1024, 512, 128, 32, 16, 8, 4]


def test_best_fit_equals_a_plain_search():
    rng = random.Random(5)
    sizes = [rng.randrange(1, 2500) for _ in range(400)]
    pieces = token_output.best_fit(sizes)
    room: dict[int, int] = {}
    rests = sorted(((n % 1024, d) for d, n in enumerate(sizes) if n % 1024), key=lambda r: (-r[0], r[1]))
    bins: list[int] = []
    for n, _ in rests:
        fit = [k for k, left in enumerate(bins) if left >= n]
        if fit:
            bins[min(fit, key=lambda k: bins[k])] -= n
        else:
            bins.append(1024 - n)
    for _, _, n, k, _ in pieces:
        room[k] = room.get(k, 1024) - n
    assert sorted(v for v in room.values() if v) == sorted(v for v in bins if v)
    assert len(room) == len(bins) + sum(n // 1024 for n in sizes)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack(empty).collect() == []
    assert token_output.packed_digest(empty).collect() == []
