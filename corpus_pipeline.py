"""Corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, secret scans, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return docs' own columns. Every stage takes empty
tables, null, empty and very long texts, null and repeated ids and repeated rows; what it does with them stands in its own text.
Columns of docs named like those that an operator adds keep their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.llm import decontam, langid, nearcopies, packing, secrets
from sparloom.llm.common import aside, written_at
from sparloom.shared import discard

#: A text goes whose likeliest language has less than this times the share of a blind guess, or less than SURE where that is more.
LEAST_SHARE, SURE = 1.2, 0.9


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. Those without letters (null and empty texts among them) go, and those whose letters no learnt language
    puts together so: other scripts and random letters (see langid.Letters; a few letters are too few to tell, and stay).

    Where no language could be learnt, none can be told from the others: every text with letters stays. Ids play no part beyond
    the choice of what is learnt from, so rows without ids and repeated rows are judged by their texts.
    """
    network = langid.train(docs.where(~langid.held_out("doc_id", 4, 2)))
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    least = min(LEAST_SHARE / len(network.languages), SURE)
    moved, back = aside(docs, ["lang_pred", "score", "known"])
    found = langid.identify(moved, network, judge=True)
    return back(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least) & F.col("known")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with a Jaccard similarity of 0.8 or more, which is checked for
    candidates by SimHash fingerprints and BK-trees and, as these don't reach all of them, by keys of minimum hashes.

    Texts without words, null ones among them, are one group. Rows that share an id are told apart by their texts; of equal rows,
    with or without an id, one stays.
    """
    return nearcopies.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in passages of the benchmark.

    Null and empty texts have no passage and stay; each row is judged by itself, whatever its id. An empty benchmark drops nothing.
    """
    moved, back = aside(docs, [f.name for f in decontam.FIELDS])
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return back(decontam.find_benchmark_text(moved, benchmark).where(~decontam.is_contaminated()))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars follows. Null texts stay null; each row is scanned by itself."""
    moved, back = aside(docs, ["secrets", "_base", "_free", *[f"_{k}" for k in secrets.KINDS]])
    found = secrets.find_secrets(moved, parts=True)
    masked = F.when(F.size("secrets") > 0, secrets.mask(F.col("text"), F.col("secrets"))).otherwise(F.col("text"))
    found = found.withColumn("text", masked)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return back(found)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in their bins; a null or empty text is its end mark, repeated rows are packed one by one."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", secret_scan),
    ("best_fit_packing", pack),
]

#: SQL can't express the fitted network and the groups.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage returns is written as Parquet to the shared folder, read again for the next one, and
    deleted when that one is written (the last stage keeps what it needs in a checkpoint)."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = written_at(stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        before = path
    packed = STAGES[-1][1](spark, docs, sf_dir)
    discard(spark, before)
    return packed
