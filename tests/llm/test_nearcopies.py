"""Near copies of the pipeline's stage against the Jaccard similarity of all pairs."""

import random

import pytest

import corpus_pipeline
from sparloom.llm import nearcopies


def words_of(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def kept_of(rows):
    """Places of the rows that stay: the first of each group by (id is null, id)."""
    sets = [words_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append((doc is None, doc, i))
    return sorted((x[:2] for x in (min(g, key=lambda x: (x[0], x[1] or 0)) for g in groups.values())), key=str)


def changed(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"changed{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("bucket", [nearcopies.BUCKET, 2_000])
def test_all_pairs(spark, bucket):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        text = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 120, 400])))
        rows.append((i, text))
        rows += [(1000 + 10 * i + k, changed(rng, text, rng.randrange(0, 1 + len(text.split()) // 20))) for k in range(rng.randrange(4))]
    big = " ".join(f"b{k}" for k in range(150))
    rows += [(2000 + k, changed(rng, big, 2)) for k in range(60)]
    rows += [(None, big), (None, "no id twice"), (None, "no  id twice"), (3000, None), (3001, ""), (3002, "short text"), (3002, "short text"), (3002, "other text under the id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id) for r in nearcopies.drop_near_copies(frame, bucket=bucket).collect()), key=str)
    assert got == kept_of(rows)


def test_stage_finds_near_copies_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = sorted(((False, r.doc_id) for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()), key=str)
    assert got == kept_of(rows)
