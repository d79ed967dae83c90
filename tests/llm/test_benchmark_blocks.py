"""A benchmark of any size: more words than characters exist, several blocks, items longer than a block."""

import random
import resource

from pyspark.sql import functions as F

from sparloom.llm import decontam
from sparloom.llm.common import read_table

SF = "/root/testdata/sf0.001"


def test_more_words_than_characters():
    n = 1_200_000
    scanner = decontam.Scanner([("1", b" ".join(b"w%d" % i for i in range(n)))], 2)
    assert scanner.scan(b"w5 w6 w5 other w1199998 w1199999 w1112063 w1112064") == (8, [(0, 2), (4, 8)], {"1"})
    assert scanner.scan(b"w55296 w57343 w57344 w0") == (4, [(1, 3)], {"1"})
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 4 << 20


def plain(text, windows):
    """Words, words hit and items by looking at every window of every size."""
    w = decontam.words((text or "").encode())
    hit, items = set(), set()
    for size in {len(x) for x in windows}:
        for i in range(len(w) - size + 1):
            if found := windows.get(tuple(w[i : i + size])):
                hit.update(range(i, i + size))
                items.update(found)
    return len(w), len(hit), sorted(items)


def test_blocks_pieces_and_long_items(spark):
    rng = random.Random(11)
    words = [f"t{i}" for i in range(400)]
    long = " ".join(rng.choices(words, k=3_000))
    items = [("long", long), ("long", long), (None, " ".join(rng.choices(words, k=40))), ("short", "T1 t2, t3"), ("empty", " .. "), ("none", None)]
    items += [(f"i{k}", " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for k in range(30)]
    cut = long.split()
    docs = [(k, " ".join(rng.choices(words, k=50)) + " " + " ".join(cut[at : at + 30]) + " Ü t1 t2 t3") for k, at in enumerate(range(0, 2_900, 97))]
    docs += [(None, docs[3][1]), (3, docs[3][1]), (3, "another"), (900, None), (901, "")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    windows = decontam.windows([(i or "", t.encode()) for i, t in items if t is not None])
    want = sorted([(d, *plain(t, windows)) for d, t in docs], key=str)
    for how in ({}, {"block_bytes": 6_000}, {"block_bytes": 3_000, "piece": 100}):
        found = decontam.find_benchmark_text(table, benchmark, **how)
        rows = found.select("doc_id", "text", "n_words", decontam.n_hit().alias("n"), "items", "hit_words", "hit_spans").collect()
        assert sorted([(r.doc_id, r.n_words, r.n, r["items"]) for r in rows], key=str) == want, how
        for r in rows:
            w = decontam.words((r.text or "").encode())
            assert [decontam.words(r.text[s.start : s.end].encode()) for s in r.hit_spans] == [w[x.start : x.end] for x in r.hit_words]
            assert all(a.end < b.start for a, b in zip(r.hit_words, r.hit_words[1:]))
    keep = decontam.find_benchmark_text(table, benchmark, keep=["doc_id"], block_bytes=3_000)
    assert keep.columns == ["doc_id", "n_words", "hit_words", "hit_spans", "items"] and keep.count() == len(docs)
    assert decontam.find_benchmark_text(table.limit(0), benchmark, block_bytes=3_000).count() == 0


def test_table_by_blocks_is_table_at_once(spark):
    docs, benchmark = read_table(spark, SF, "documents"), read_table(spark, SF, "benchmark")
    key = lambda df: sorted(map(str, df.select("doc_id", "n_words", "hit_words", "hit_spans", F.array_join("items", ",")).collect()))
    once = key(decontam.find_benchmark_text(docs, benchmark, keep=["doc_id"]))
    assert once == key(decontam.find_benchmark_text(docs, benchmark, keep=["doc_id"], block_bytes=12_000))
