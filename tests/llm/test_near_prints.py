"""The near-copy stage links texts by their SimHash fingerprints, whose groups are checked by exact similarity."""

from pyspark.sql import types as T

from sparloom.llm import nearcopies, simhash

LINE = "the same line is said again and again in this text "


def test_links_come_from_fingerprints(spark):
    words = [f"w{i}" for i in range(3000)]
    near = words.copy()
    near[500] = near[1500] = near[2500] = "changed"
    texts = [" ".join(words), " ".join(near), LINE * 80 + " ".join(words[:60]), LINE * 80 + " ".join(words[900:960]), " ".join(words[:1500]), LINE, LINE.upper() + "\n"]
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    apart = lambda a, b: (prints[a] ^ prints[b]).bit_count()
    sets = [nearcopies.shingles(t.encode()) for t in texts]
    # 0 and 1 are near copies; 2 and 3 have near fingerprints by the line that is in both, but little else; 5 and 6 have one fingerprint.
    assert 0 < apart(0, 1) <= nearcopies.RADIUS and apart(2, 3) <= nearcopies.RADIUS and not nearcopies.alike(sets[2], sets[3]) and apart(5, 6) == 0
    schema = T.StructType([T.StructField("_num", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_bands", T.ArrayType(T.LongType())), T.StructField("_fp", T.LongType())])
    # No keys of minimum hashes: what is found comes from fingerprints.
    sketches = spark.createDataFrame([(i, len(s), [], simhash.signed(p)) for i, (s, p) in enumerate(zip(sets, prints))], schema)
    found = nearcopies.link(spark.createDataFrame(list(enumerate(texts)), "_num long, _text string"), sketches)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0), (6, 5)]
