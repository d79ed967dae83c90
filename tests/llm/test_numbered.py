"""Numbered queries against brute force over the smallest tables."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import pytest
import xxhash

from sparloom.llm import queries as q
from sparloom.llm import secrets

SF = "/root/testdata/sf0.001"


def table(name, cols, sf=SF):
    return duckdb.connect().sql(f"select {cols} from read_parquet('{sf}/{name}.parquet')").fetchall()


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def brute_groups(texts):
    """{doc: (fingerprint, smallest doc reachable)} by comparing all pairs."""
    prints = {}
    for doc, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (f"{p:016x}", find(d)) for d, p in prints.items()}


def test_simhash_matches_all_pairs(spark):
    want = brute_groups(dict(table("documents", "doc_id, text")))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in q.op5_simhash(spark, SF).collect()}
    assert got == want
    assert len({c for _, c in got.values()}) < len(got)


def brute_hits(text, windows):
    """Words, and words inside an occurrence of a window."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    hit = set()
    for size in {len(x) for x in windows}:
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
    return len(w), len(hit)


def brute_spans(text):
    """(start, end) of the three patterns, and of runs with a random window, by a count of each window's characters."""
    assign = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    base = [m.span() for m in re.finditer(assign, text, re.I | re.A) if len(m[1]) >= 8]
    base += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    found = list(base)
    for run, needs, bits in (("[A-Za-z0-9+/_-]{20,}", ("[0-9]", "[A-Z]", "[a-z]"), 3.8), ("[0-9A-Fa-f]{20,}", ("[0-9]", "[A-Fa-f]"), 3.0)):
        for m in re.finditer(run, text):
            known = any(a < m.end() and m.start() < b for a, b in base) or any(x in m[0].lower() for x in secrets.ALLOW)
            if known or not all(re.search(x, m[0]) for x in needs):
                continue
            sums = [sum(c * math.log2(c) for c in Counter(m[0][i : i + 20]).values()) for i in range(len(m[0]) - 19)]
            if math.log2(20) - min(sums) / 20 >= bits - 1e-6:
                found.append(m.span())
    return sorted(found)


def test_packing_keeps_every_token_once(spark):
    rows = q.op1_best_fit_packing(spark, SF).collect()
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        bins.setdefault(r.bin_id, []).append(r)
    for doc, text in table("documents", "doc_id, text"):
        at = 0
        for start, length in sorted(pieces[doc]):
            assert start == at
            at += length
        assert at == len((text or "").encode()) + 1
    sizes = (1024, 2048, 4096, 8192)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.bin_start):
            assert r.bin_start == at
            at += r.length
        assert {r.bin_used for r in rows} == {at} and {r.bin_size for r in rows} == {next(s for s in sizes if s >= at)}
    assert sum(r.length for b in bins.values() for r in b) > 0.95 * sum(b[0].bin_size for b in bins.values())


def test_sharding_laws(spark):
    import zlib

    texts = dict(table("documents", "doc_id, coalesce(text, '')"))
    rows = q.op10_rendezvous(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("name", ["op2_decontaminate", "op3_chat_format", "op9_secret_scan"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = q.queries()[name](spark, SF)
    want = con.sql(q.oracle_sql()[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(*cols).collect())) == sorted(map(key, want.select(*cols).fetchall()))
    assert hashlib  # the digests come from both engines
