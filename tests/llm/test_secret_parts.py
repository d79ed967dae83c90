"""Secrets beside patterns and allow-listed strings in one run are masked in the pipeline."""

import random
import string

import corpus_pipeline
from sparloom.llm import secrets

CHARS = string.ascii_letters + string.digits


def token(rng, n):
    return "".join(rng.sample(CHARS, n - 3)) + "aZ7"


def test_pipeline_masks_what_patterns_and_allowed_strings_leave(spark):
    rng = random.Random(2)
    key, path, tail, far = (token(rng, 40) for _ in range(4))
    rows = [
        (1, f"é AKIA{'B2' * 8}/{key} end", "é [secret][secret] end"),
        (2, f"in path/sample/{path} end", f"in path/sample[secret] end"),
        (3, f"Example{tail}dummy end", "Example[secret]dummy end"),
        (4, f"{far}/{'0a' * 16}-{tail}", None),
        (5, "path/sample/of/an/example/without/a/secret", "path/sample/of/an/example/without/a/secret"),
        (6, "example of prose", "example of prose"),
        (7, None, None),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.secret_scan(spark, docs, "").collect()}
    for doc, _, want in rows:
        if want:
            assert got[doc] == want
    assert far not in got[4] and tail not in got[4] and got[7] is None


def test_very_many_matches_in_one_text(spark):
    rng = random.Random(3)
    text = " é ".join(f"AKIA{rng.randrange(10**16):016d}" for _ in range(3_000))
    found = secrets.find_secrets(spark.createDataFrame([(text,), ("",)], "text string")).select("secrets").collect()
    spans = max((r.secrets for r in found), key=len)
    assert [(s.start, s.end) for s in spans] == [(23 * i, 23 * i + 20) for i in range(3_000)]
