"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; documents drawn from all others and the positives alike are the unlabelled
text. A linear model over the presence of character n-grams, and of those that many of the text's words have, is fitted in numpy on the risk of Kiryo et al. (2017): the prior
times the positives' loss, plus what the unlabelled text loses as negatives less the prior's share of positives in it, which may
not fall below zero. N-grams lie inside words, whose ends they know, so a stem is seen under any ending. Those are used that are
at least LIFT times as frequent among the positives as in the unlabelled text, and of these the VOCABULARY surest. (N-grams of
lesser lift tell a text's length rather than its tone.)

Fitting takes at most POSITIVES and UNLABELLED distinct texts, chosen by a hash of the text; n-grams are counted by Spark, and
only VOCABULARY of them and the samples' places of these reach the driver. An automaton of the n-grams then scans whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, checkpoint, map_arrow, sample_texts, slices

#: Tasks that count the samples' n-grams.
SPREAD = 48
POSITIVES = 3_000
UNLABELLED = 9_000
VOCABULARY = 768
GRAMS = (3, 4, 5, 6)
LIFT = 3.0
#: A n-gram is dense in a text where it occurs twice or more, and once or more for so many words. Words that clean texts hold by
#: chance are so told from a tone that runs through the text, whatever its length.
DENSE = 200
#: Ends the name of a dense n-gram; no normal text has it.
MARK = "*"
#: Least difference of a n-gram's two frequencies, in standard errors.
SURE = 4.0
STEPS = 1_500
RATE = 0.1

_NORMAL = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal(texts: pa.Array) -> list[str]:
    """Each text as its lower-cased words (ASCII letters and digits, non-ASCII characters), each with a space before and
    after; one space for a text without words."""
    lowered = binary(pc.utf8_lower(texts)).to_pylist()
    return [b" ".join([b"", *(t or b"").translate(_NORMAL).split(), b""]).decode("utf-8", "replace") for t in lowered]


def grams(text: str) -> set[str]:
    """The n-grams inside the words of a normal text, a word's ends being spaces; those that are dense with MARK too."""
    counts: Counter = Counter()
    words = Counter(text.split())
    for word, times in words.items():
        w = f" {word} "
        for n in GRAMS:
            for i in range(len(w) - n + 1):
                counts[w[i : i + n]] += times
    n_words = words.total()
    return counts.keys() | {g + MARK for g, times in counts.items() if dense(times, n_words)}


def dense(times: int, words: int) -> bool:
    return times > 1 and DENSE * times >= words


@dataclass
class Model:
    vocabulary: list[str]
    weights: np.ndarray
    bias: float
    automaton: object = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def present(self, text: str) -> set[int]:
        """Places in the vocabulary of the n-grams that a normal text has."""
        if not self.vocabulary:
            return set()
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
            places = {g: i for i, g in enumerate(self.vocabulary)}
            for g in {g.rstrip(MARK) for g in places}:
                self.automaton.add_word(g, (places.get(g), places.get(g + MARK)))
            self.automaton.make_automaton()
        words = text.count(" ") - 1
        found: set[int] = set()
        for (plain, marked), times in Counter([p for _, p in self.automaton.iter(text)]).items():
            if plain is not None:
                found.add(plain)
            if marked is not None and dense(times, words):
                found.add(marked)
        return found

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.array([self.weights[sorted(self.present(t))].sum() for t in texts], float) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative risk's minimum under the sigmoid loss, which bounds what a wrong label costs.

    Rows are 0/1 presences of n-grams; every Adam step uses all of them, equal ones at once. Weights stay at 0 or above: each
    n-gram was chosen because it is the more frequent among the positives.
    """
    packed, place = np.unique(np.packbits(np.concatenate([positive, unlabelled]), axis=1), axis=0, return_inverse=True)
    x = np.unpackbits(packed, axis=1, count=unlabelled.shape[1]).astype(np.float32)
    # Each distinct row's share of the positives and of the unlabelled.
    p, u = (np.bincount(rows, minlength=len(x)) / max(len(rows), 1) for rows in np.split(place.ravel(), [len(positive)]))
    theta = np.zeros(x.shape[1] + 1, np.float32)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        s = 1 / (1 + np.exp(-np.clip(x @ theta[:-1] + theta[-1], -60, 60)))
        # The loss is sigmoid(-z) of a positive, sigmoid(z) of a negative.
        slope = s * (1 - s)
        if u @ s >= prior * (p @ s):
            g_z = slope * (u - 2 * prior * p)
        else:  # step back until the risk of the negatives is one again
            g_z = slope * (prior * p - u)
        g = np.r_[x.T @ g_z.astype(np.float32), g_z.sum()].astype(np.float32)
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        theta -= RATE * (1 - (step - 1) / STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        np.maximum(theta[:-1], 0, out=theta[:-1])
    return theta[:-1].astype(float), float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """The model of the labelled documents among docs.

    prior: share of toxic documents; that of the labels when None. Without positives (or documents) every score is the prior.
    Labels without an id or of other ids, and null labels, say nothing; repeated rows count once.
    """
    told = docs.select(F.col(id_col).alias("id")).join(labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("label is not null").distinct(), "id")
    count = told.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("label") == 1).cast("int")), F.lit(0)).alias("toxic")).first()
    if prior is None:
        prior = count["toxic"] / count["n"] if count["n"] else 0.0
    prior = min(max(prior, 1e-3), 0.999)
    flat = Model([], np.zeros(0), float(np.log(prior / (1 - prior))))
    if not count["toxic"]:
        return flat
    every = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The ids are bounded, so that only the texts of confirmed documents move.
    chosen = F.broadcast(told.where("label = 1").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(2 * positives))
    sampled = sample_texts(every.join(chosen, "id", "left_semi").select("text"), positives).withColumn("p", F.lit(1))
    sampled = sampled.unionByName(sample_texts(every.select("text"), unlabelled).withColumn("p", F.lit(0))).select("p", "text")
    sampled = checkpoint(sampled.repartition(SPREAD))  # a limit leaves one partition
    n_p, n_u = (sampled.where(F.col("p") == x).count() for x in (1, 0))
    if not n_p or not n_u:
        return flat

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found: tuple[Counter, Counter] = (Counter(), Counter())
                for p, text in zip(part.column("p").to_pylist(), normal(part.column("text"))):
                    found[p].update(grams(text))
                seen = list(found[0].keys() | found[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([found[1][g] for g in seen], pa.int64()), pa.array([found[0][g] for g in seen], pa.int64())], names=["g", "a", "b"])

    counts = sampled.mapInArrow(count_grams, "g string, a bigint, b bigint").groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = (F.col("a") + 0.5) / (n_p + 1), (F.col("b") + 0.5) / (n_u + 1)
    sure = F.abs(a - b) / F.sqrt(a * (1 - a) / n_p + b * (1 - b) / n_u)
    top = counts.where(a >= LIFT * b).select("g", sure.alias("z")).where(F.col("z") >= SURE).orderBy(F.desc("z"), "g").limit(VOCABULARY).collect()
    model = Model(sorted(r["g"] for r in top), np.zeros(len(top)), flat.bias)
    if not top:
        return flat
    add = lambda batch: {"has": pa.array([sorted(model.present(t)) for t in normal(batch.column("text"))], pa.list_(pa.int32()))}
    rows = map_arrow(sampled, add, [T.StructField("has", T.ArrayType(T.IntegerType()))], "text", ["p"]).select("p", "has").toArrow()
    x = np.zeros((rows.num_rows, len(top)), np.uint8)
    for i, has in enumerate(rows["has"].to_pylist()):
        x[i, has] = 1
    is_p = rows["p"].to_numpy() == 1
    order = np.lexsort(x.T[::-1])  # rows come in any order; the fit must not depend on it
    x, is_p = x[order], is_p[order]
    weights, bias = fit(x[is_p], x[~is_p], prior)
    return Model(model.vocabulary, weights, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (all when None) with score double, 0 to 1, and predicted int, 1 where score is 0.5 or more.

    Whole texts are read; a null or empty text has the score of a text without known n-grams. Repeated rows have equal scores;
    an empty table gives no rows. Columns of docs named like
    a new one are replaced. No shuffle.
    """

    def add(batch: pa.RecordBatch) -> dict:
        s = model.scores(normal(batch.column(text_col)))
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32), pa.int32())}

    return map_arrow(docs, add, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], text_col, keep)
