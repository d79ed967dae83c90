"""The language stage: other scripts and random letters go, clean documents stay."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparloom.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def network(spark):
    return langid.train(spark.read.parquet(f"{SF}/documents.parquet").where(~langid.held_out("doc_id", 4, 2)))


def foreign():
    rng = random.Random(4)
    make = {
        "random": lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz      ", k=n)),
        "cyrillic": lambda n: "".join(rng.choices("абвгдежзийклмнопрстуфхцчшщъыьэюя     ", k=n)),
        "chinese": lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n)),
        "arabic": lambda n: "".join(rng.choices([chr(c) for c in range(0x627, 0x64B)] + [" "] * 6, k=n)),
    }
    return [(kind, f(rng.randrange(40, 900))) for kind, f in make.items() for _ in range(100)]


def test_what_no_language_claims_goes(spark, network):
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(foreign())], "kind string, text string, _known int")
    stay = langid.known_language(rows, network)
    assert stay.columns == ["kind", "text", "_known"]
    assert {r["kind"]: r["count"] for r in stay.groupBy("kind").count().collect()}.get("random", 0) <= 3
    assert stay.where("kind <> 'random'").count() == 0
    one_pass = langid.identify(rows, network, keep=["kind", "text"], judge=True)
    assert sorted(map(tuple, one_pass.where("known").select("kind", "text").collect())) == sorted(map(tuple, stay.select("kind", "text").collect()))


def test_clean_documents_stay(spark, network):
    held = spark.read.parquet(f"{SF}/documents.parquet").where(langid.held_out("doc_id", 4, 2) & F.col("text").rlike(r"\p{L}"))
    assert langid.known_language(held, network).count() >= 0.995 * held.count()


def test_stage_on_both(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # Ids that aren't learnt from: foreign texts without a language.
    ids = [r[0] for r in spark.range(10_000, 30_000).where(langid.held_out("id", 4, 2)).limit(400).collect()]
    more = spark.createDataFrame([(i, t, None, kind, len(t)) for i, (kind, t) in zip(ids, foreign())], docs.schema)
    kept = corpus_pipeline.language_id(spark, docs.unionByName(more), SF)
    assert kept.columns == docs.columns
    assert kept.where("doc_id >= 10000").count() <= 0.05 * 400
    lettered = docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert kept.where("doc_id < 10000").count() >= 0.995 * lettered


def test_texts_of_every_kind(spark, network):
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "123 456"), (3, "a"), (4, "the"), (5, "ф" * 3000 + " the")], "id int, text string")
    assert sorted(r["id"] for r in langid.known_language(rows, network).collect()) in ([3, 4], [3])
    assert langid.known_language(rows.where("id < 0"), network).count() == 0


def test_one_language_and_none(spark):
    words = "some plain words of a small table are written down here in any order".split()
    rng = random.Random(6)
    one = spark.createDataFrame([(i, " ".join(rng.choices(words, k=12)), "xx", "s", 1) for i in range(800)], "doc_id long, text string, lang string, source string, n_chars long")
    other = one.limit(3).select((F.col("doc_id") + 1000).alias("doc_id"), F.lit("мнеянебудуиграть" * 20).alias("text"), F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    kept = corpus_pipeline.language_id(spark, one.unionByName(other), SF)
    assert kept.count() == 800 and kept.where("doc_id >= 1000").count() == 0
    unlabelled = one.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, unlabelled, SF).count() == 800
    # Too few texts to tell what is odd: all with letters stay.
    few = one.limit(40).unionByName(other)
    assert corpus_pipeline.language_id(spark, few, SF).count() == 43
