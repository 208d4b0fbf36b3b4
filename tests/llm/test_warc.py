"""Operator 4: exact round trip against the rules of the contract."""

import hashlib

from barloom.llm import warc as W
from barloom.llm.shared import scratch

SCHEMA = "page_id long, url string, html string, digest string, n long"


def rows():
    big, big2 = "é<p>" * 300, "x" * 1000
    out = [(k, f"http://h{k % 3}.example.com/a/{k % 5}?q={k}#f", big if k % 4 == 0 else f"<p>{k}" * (k * 9)) for k in range(60)]
    out += [(k, "https://user@One.example.org:8443/same", big2) for k in range(100, 130)]
    out += [(200, None, None), (201, "not a url", ""), (202, "http://[bad", "x" * 999), (203, "http://b.example.com", "x" * 999), (None, "http://n.example.com/", big2), (None, None, "tiny"), (5, *out[5][1:])]
    out += [(300, "http://t.example.com/a\tb\nc", "tab")]
    return out


def want(pages):
    size = lambda h: len((h or "").encode())
    largest = {}
    for p, _, h in pages:
        if p is not None and size(h) >= 1000:
            largest[h] = max(p, largest.get(h, p))
    out = []
    for p, _, h in pages:
        refers = largest.get(h) if p is not None and size(h) >= 1000 and largest[h] != p else None
        out.append((p, size(h), hashlib.sha1((h or "").encode()).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def frame(spark, pages):
    return spark.createDataFrame([(*p, "x", 1) for p in pages], SCHEMA).repartition(5)


def test_round_trip(spark):
    got = sorted((tuple(r) for r in W.round_trip(frame(spark, rows())).collect()), key=str)
    assert got == want(rows())


def test_index_of_small_blocks(spark):
    pages = rows()
    folder = scratch(spark, "warc-test")
    index = W.build_index(W.write_archives(frame(spark, pages), folder), folder, lines=2)
    got = sorted((tuple(r) for r in W.lookup(frame(spark, pages), index, folder).drop("url").collect()), key=str)
    assert got == want(pages)
    none = spark.createDataFrame([("http://h1.example.com/zzz", 4), ("http://aaa.com/", 1), ("http://zzz.zz/", None)], "url string, page_id long")
    assert W.lookup(none, index, folder).collect() == []


def test_archives_are_whole(spark, tmp_path):
    W.write_archives(frame(spark, rows()), str(tmp_path))
    records = [r for f in sorted(tmp_path.glob("*.warc.gz")) for r in W.members(f.read_bytes())]
    assert len(records) == len(rows()) and all(r.startswith(b"WARC/1.0\r\nWARC-Type: re") and r.endswith(b"\r\n\r\n") for r in records)


def test_empty_table(spark):
    assert W.round_trip(frame(spark, rows()).limit(0)).collect() == []


def test_keys():
    assert W.url_key("HTTP://www.Example.com:80/a?b#c") == "com,example,www)/a?b"
    assert W.url_key("http://x.y:8080") == "y,x:8080)/"
