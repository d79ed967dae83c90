"""Columns named like an operator's own keep their values, whatever the sizes."""

import pytest
from pyspark.sql import functions as F

from sparloom.llm import decontam, nearcopies, secrets, sharding

WORDS = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{WORDS} password=abcdefgh{i}" if i % 2 else f"other text {i}") for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def with_columns(docs, names):
    return docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})


def same(found, given, names):
    assert [c for c in found.columns if c in names] == names
    assert found.count() == given.count()
    assert all(r[n] == f"{n}{r['doc_id']}" for r in found.select("doc_id", *names).collect() for n in names)


def test_secrets(docs):
    names = ["_base", "_free", "_Assign", *[f"_{k}" for k in secrets.KINDS if k != "assign"]]
    given = with_columns(docs, names)
    for parts in (False, True):
        found = secrets.find_secrets(given, parts=parts)
        same(found, given, names)
        assert found.columns == [*given.columns, "secrets"] and found.where(F.size("secrets") > 0).count() == 15


def test_benchmark_by_one_block_and_several(spark, docs):
    given = with_columns(docs, ["_row_number", "parts"])
    benchmark = spark.createDataFrame([("a", WORDS), ("b", "other text 4"), ("c", " ".join(f"z{i}" for i in range(80)))], "item_id string, text string")
    seen = []
    for size in (1 << 20, 200):
        found = decontam.find_benchmark_text(given, benchmark, block_bytes=size)
        same(found, given, ["_row_number", "parts"])
        seen.append((found.columns, sorted(map(str, found.collect()))))
    assert seen[0] == seen[1]


def test_slots(docs):
    names = ["_row", "_bucket", "_first", "_inside", "_rows"]
    given = with_columns(docs, names)
    found = sharding.number_slots(sharding.assign_shards(given, "doc_id", [1.0, 2.0]), "shard", "doc_id", ["doc_id", "_first"], 2, 5)
    same(found, given, names)
    for s in (0, 1):
        slots = sorted(r["slot"] for r in found.where(F.col("shard") == s).collect())
        assert slots == list(range(len(slots)))
    again = sharding.number_slots(found, "shard", "doc_id", ["doc_id"], 2)
    assert again.columns == found.columns


def test_near_copies(docs):
    names = ["_num", "_key", "_row", "_id", "_text", "_n", "_bands"]
    found = nearcopies.drop_near_copies(with_columns(docs, names))
    assert [c for c in found.columns if c in names] == names and found.count() == 16
    assert all(r["_key"] == f"_key{r['doc_id']}" for r in found.collect())
