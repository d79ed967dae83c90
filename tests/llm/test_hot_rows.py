"""Equal rows, rows of one id and rows without ids spread; samples stay bounded whatever the ids; packing against a plain one."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparloom.llm import htmltext, langid, packing, sharding, toxicity
from sparloom.llm.common import sample_texts

LANGUAGES = {"en": "the and that with from this have been were they", "de": "der und nicht eine werden auch schon über für", "fr": "le les des être avec cette pour où très"}


def sentence(rng, lang, n=60):
    return " ".join(rng.choice(LANGUAGES[lang].split()) + rng.choice(["", "s", "e", "n"]) for _ in range(n))


@pytest.mark.parametrize("doc", ["7", "CAST(NULL AS BIGINT)"])
def test_equal_rows_spread(spark, doc):
    rows = spark.range(30_000).selectExpr(f"{doc} AS doc_id", "'the same text' AS text")
    packed = packing.pack_documents(rows, rows_per_shard=5_000)
    sizes = [r["n"] for r in packed.groupBy(F.shiftright("bin_id", 32).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 30_000 and len(sizes) == 6 and max(sizes) < 6_000
    placed = sharding.number_slots(sharding.assign_shards(rows, "doc_id", [1.0] * 4), "shard", "doc_id", ["doc_id", "text"], 4, 5_000)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan
    found = placed.agg(F.countDistinct("slot").alias("n"), F.max("slot").alias("last"), F.min("slot").alias("first")).first()
    assert tuple(found) == (30_000, 29_999, 0)


def brute_pack(lengths, sizes, overhead):
    """Bins by best fit in plain loops: for each largest size to open, the longest first into the open bin with the least room;
    (cost, sizes of bins) of the cheapest."""
    best = None
    for most in sorted(sizes, reverse=True):
        bins, rest = [], sum(lengths)
        for n in lengths:
            open_ = [b for b in bins if b[0] - b[1] >= n]
            if open_:
                b = min(open_, key=lambda b: b[0] - b[1])
            else:
                least = min(s for s in sizes if s >= n)
                size = min((s for s in sizes if least <= s <= max(most, least)), key=lambda s: ((s + overhead) / min(s, rest), s))
                b = [size, 0]
                bins.append(b)
            b[1] += n
            rest -= n
        final = [min(s for s in sizes if s >= b[1]) for b in bins]
        cost = sum(s + overhead for s in final)
        if best is None or cost < best[0]:
            best = (cost, sorted(final))
    return best


def test_one_shard_against_plain_loops(spark):
    rng = random.Random(8)
    texts = [(i, "x" * rng.choice([3, 40, 300, 900, 1500, 4000, 9000, 20_000])) for i in range(150)]
    rows = packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    lengths = sorted((r.length for r in rows), reverse=True)
    bins = {r.bin_id: r.bin_size for r in rows}
    cost, sizes = brute_pack(lengths, packing.SIZES, packing.OVERHEAD)
    assert sum(s + packing.OVERHEAD for s in bins.values()) == cost and sorted(bins.values()) == sizes


def test_samples_are_bounded_and_whole(spark):
    rng = random.Random(9)
    distinct = [(sentence(rng, lang), lang) for lang in LANGUAGES for _ in range(60)]
    rows = spark.createDataFrame(distinct + distinct[:1] * 5_000 + [(None, "en")], "text string, lang string")
    got = sample_texts(rows, 40, ["lang"]).collect()
    assert {lang: sum(r.lang == lang for r in got) for lang in LANGUAGES} == dict.fromkeys(LANGUAGES, 40)
    assert len({r.text for r in got}) == 120
    assert sample_texts(rows.select("text"), 100).count() == 100 and sample_texts(rows.select("text"), 1000).count() == 180
    assert sample_texts(rows.limit(0), 10, ["lang"]).count() == 0
    with pytest.raises(ValueError, match="languages"):
        langid.train(rows, languages=2)


@pytest.mark.parametrize("doc", ["CAST(NULL AS BIGINT)", "5L"])
def test_all_ids_alike(spark, doc, tmp_path):
    rng = random.Random(10)
    docs = spark.createDataFrame([(sentence(rng, lang), lang) for lang in LANGUAGES for _ in range(80)], "text string, lang string").selectExpr(f"{doc} AS doc_id", "*")
    network = langid.train(docs)
    assert network.languages == sorted(LANGUAGES)
    rows = langid.identify(docs, network).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert corpus_pipeline.language_id(spark, docs, str(tmp_path)).count() == 240
    pages = docs.selectExpr("doc_id AS page_id", "concat('<html><body><nav><a href=/>Home</a></nav><article><p>', text, '</p></article></body></html>') AS html")
    assert htmltext.train(pages, sample=30) is not None
    # A text over many rows is learnt once; without ids no label says anything.
    bad = spark.createDataFrame([("grumblor snarkwit " + sentence(rng, "en", 20),) for _ in range(60)], "text string").selectExpr("5L AS doc_id", "*")
    told = spark.createDataFrame([(5, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs.select("doc_id", "text").unionByName(bad), told)
    scores = toxicity.score(docs, model)
    assert scores.count() == 240
    long = spark.createDataFrame([(1, "grumblor " * 200_000), (2, None)], "doc_id long, text string")
    assert [r.predicted in (0, 1) for r in toxicity.score(long, model).collect()] == [True, True]


def test_components_with_hubs(spark, monkeypatch):
    """Stars, chains and a grid of links, whatever counts as a hub."""
    from sparloom.llm import simhash

    links = [(i, 0) for i in range(1, 400)] + [(1000 + i, 500) for i in range(300)] + [(2000 + i, 1999 + i) for i in range(40)] + [(2040, 1000), (3001, 3000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = sorted((x, find(x)) for x in list(root))
    frame = spark.createDataFrame(links, "a long, b long")
    for hub in (5, 10**6):
        monkeypatch.setattr(simhash, "HOT_ROWS", hub)
        monkeypatch.setattr(simhash, "HOT", 10**9 if hub > 5 else 10**3)
        assert sorted(tuple(r) for r in simhash.components(frame).collect()) == want
    assert simhash.components(frame.where("a < 0")).count() == 0


def test_long_turns_make_chunks_of_their_own(spark):
    from sparloom.llm import chat

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", ("x" if t % 3 else "<|im_end|>y") * (40 * (t % 5) + 1)) for c in (1, None, 2) for t in range(90)]
    rows += [(3, t, "assistant", "z" * 5_000) for t in range(4)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    seen = None
    for turns, limit in ((32, 1 << 20), (7, 1 << 20), (32, 300), (1, 1)):
        found = chat.format_chats(frame, turns=turns, limit=limit)
        chunks = found.collect()
        by = {}
        for r in chunks:
            by.setdefault(r["conv_id"], []).append(r)
            assert r["n_turns"] <= turns and (r["n_turns"] == 1 or sum(len(t.encode()) for _, t in chat.read_turns(r["formatted"])) <= limit)
        assert all([r["chunk"] for r in rs] == list(range(len(rs))) for rs in by.values())
        whole = {c: "".join(r["formatted"] for r in rs) for c, rs in by.items()}
        digests = sorted(map(str, chat.digests(found).collect()))
        assert seen in (None, (whole, digests))
        seen = (whole, digests)
