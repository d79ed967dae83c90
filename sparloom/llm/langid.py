"""Language identification by a byte convolutional network in numpy.

The network reads windows of WINDOW bytes of lower-cased text: byte vectors, filters of several widths, the maximum of
each filter over the window, and a softmax. A text's windows cover it from first to last byte; the mean of their
predictions, weighted by bytes, gives language and score. Fitting takes pieces of at most SAMPLE distinct texts of each
language, chosen by a hash of the text, so ids may be null or repeated. That sample, at most SAMPLE * PIECES * WINDOW characters a
language for at most LANGUAGES languages, is all that reaches the driver; more languages are an error, never left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, map_arrow, sample_texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
CODE = 8
#: Documents of each language and pieces of each document that the network is fitted on.
SAMPLE = 800
PIECES = 4
#: Most languages that may be learnt.
LANGUAGES = 256
EPOCHS = 6
RATE = 0.01
UNKNOWN = "und"
#: Windows that are multiplied at a time.
BLOCK = 128
#: Windows that are cut at a time.
CUT = 1024


#: Of every so many pieces one isn't counted for the pairs of letters, but measured by them.
MEASURED = 4
#: Measured pieces from which a bound is told; with fewer, no text is judged by its letters.
ENOUGH = 100
#: The share of measured pieces that are less likely than the bound, and how many standard errors a short text may lie below it.
RARE, ERRORS = 0.001, 4.0


@dataclass
class Letters:
    """How likely pairs of letters' bytes are in the learnt languages, and how likely a text must be at least.

    A softmax only tells learnt languages from each other: whatever it reads, its shares add up to one. This tells text in any of them
    from other scripts and from random letters.
    """

    likely: np.ndarray  # (256, 256) natural logarithms
    bound: float
    spread: float

    def means(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean over each text's pairs of neighbouring letters, and their number. Letters are a to z, lower-cased, and bytes from 128 on."""
        data = pc.utf8_lower(texts).cast(pa.large_binary())
        ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
        body = np.frombuffer(data.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        letter = ((body >= 97) & (body <= 122)) | (body >= 128)
        pair = letter[:-1] & letter[1:]
        inner = ends[1:-1] - ends[0]
        pair[inner[(inner > 0) & (inner < len(body))] - 1] = False  # not from one text to the next
        at = np.flatnonzero(pair)
        sums = np.r_[0.0, np.cumsum(self.likely[body[at], body[at + 1]], dtype=np.float64)]
        edge = np.searchsorted(at, ends - ends[0], "left")
        n = np.diff(edge)
        return np.diff(sums[edge]) / np.maximum(n, 1), n

    def known(self, texts: pa.Array) -> np.ndarray:
        """Whether each text is likely enough. A text with few pairs, or none, gets the benefit of the doubt."""
        mean, n = self.means(texts)
        return (n == 0) | (mean + ERRORS * self.spread / np.sqrt(np.maximum(n, 1)) >= self.bound)


def fit_letters(texts: list[str]) -> Letters:
    """Counts of pairs over most pieces, each pair once more; the bound is what all but RARE of the others reach, less a tenth of the way from
    their mean to it. With under ENOUGH measured pieces there is no bound."""
    counts = np.ones((256, 256))
    for i, text in enumerate(texts):
        if i % MEASURED:
            body = np.frombuffer(text.lower().encode(), np.uint8)
            np.add.at(counts, (body[:-1], body[1:]), 1)
    letters = np.r_[97:123, 128:256]
    inside = np.zeros((256, 256))
    inside[np.ix_(letters, letters)] = counts[np.ix_(letters, letters)]
    with np.errstate(divide="ignore"):
        likely = np.log(inside / inside.sum())
    likely[inside == 0] = 0
    found = Letters(likely, 0.0, 0.0)
    measured = texts[::MEASURED]
    mean, n = found.means(pa.array(measured, pa.string()))
    full = mean[n >= np.median(n)] if len(n) else np.zeros(1)
    low = float(np.quantile(full, RARE))
    weight = inside / inside.sum()
    found.spread = float(np.sqrt((weight * likely**2).sum() - (weight * likely).sum() ** 2))
    found.bound = low - 0.1 * (float(full.mean()) - low) if len(measured) >= ENOUGH else -np.inf
    return found


@dataclass
class Network:
    languages: list[str]
    codes: np.ndarray  # (256, CODE); byte 0, the padding, has zeros
    filters: np.ndarray  # (widest * CODE, filters); rows beyond a filter's width are zero
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    letters: Letters | None = None

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows, places, widest * CODE) of bytes (windows, WINDOW)."""
        x = self.codes[windows]
        x = np.concatenate([x, np.zeros((len(x), max(WIDTHS) - 1, CODE), np.float32)], axis=1)
        return np.concatenate([x[:, j : j + windows.shape[1]] for j in range(max(WIDTHS))], axis=2)

    def pooled(self, patches: np.ndarray) -> np.ndarray:
        n, places, k = patches.shape
        return (patches.reshape(-1, k) @ self.filters).reshape(n, places, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(windows), BLOCK):
            top = self.pooled(self.patches(windows[i : i + BLOCK])).max(axis=1)
            parts.append(softmax(np.maximum(top + self.bias, 0) @ self.out + self.out_bias))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut_windows(texts: pa.Array, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (n, size) of all texts, the text of each, and the bytes for which each counts.

    Windows follow each other; a text's last one is moved back to end with the text, or filled with zeros.
    """
    data = pc.utf8_lower(texts).cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    body = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None else np.zeros(0, np.uint8)
    length = np.diff(offsets)
    count = -(-length // size)
    owner = np.repeat(np.arange(len(length)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    weight = np.minimum(size, length[owner] - place * size)
    start = np.maximum(np.minimum(place * size, length[owner] - size), 0)
    windows = np.zeros((len(owner), size), np.uint8)
    for i in range(0, len(owner), CUT):  # places take eight times the bytes
        part = owner[i : i + CUT]
        at = start[i : i + CUT, None] + np.arange(size)
        inside = at < length[part][:, None]
        windows[i : i + CUT] = np.where(inside, body[np.minimum(at + offsets[part][:, None], len(body) - 1)], 0)
    return windows, owner, weight


def fit(texts: list[str], labels: list[str], seed: int = 1) -> Network:
    """Network fitted on the texts' windows by Adam on the cross-entropy; each language weighs the same."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    widest = max(WIDTHS)
    codes = rng.normal(0, 1, (256, CODE)).astype(np.float32)
    codes[0] = 0
    shape = np.concatenate([np.repeat([[1.0 if j < w else 0.0] for j in range(widest)], CODE, axis=0) * np.ones((1, FILTERS)) for w in WIDTHS], axis=1).astype(np.float32)
    filters = (rng.normal(0, 1, shape.shape) / np.sqrt(shape.sum(axis=0))).astype(np.float32) * shape
    n_filters = filters.shape[1]
    net = Network(languages, codes, filters, np.zeros(n_filters, np.float32), rng.normal(0, 0.1, (n_filters, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    windows, owner, _ = cut_windows(pa.array(texts, pa.string()))
    if not len(windows):
        return net
    index = {x: i for i, x in enumerate(languages)}
    target = np.array([index[x] for x in labels])[owner]
    balance = 1 / np.maximum(np.bincount(target, minlength=len(languages)), 1)
    weight = (balance / balance[target].mean())[target].astype(np.float32)
    parameters = [net.codes, net.filters, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), 64):
            rows = order[i : i + 64]
            patches = net.patches(windows[rows])
            z = net.pooled(patches)
            best = z.argmax(axis=1)
            top = np.take_along_axis(z, best[:, None], axis=1)[:, 0] + net.bias
            hidden = np.maximum(top, 0)
            d = softmax(hidden @ net.out + net.out_bias)
            d[np.arange(len(rows)), target[rows]] -= 1
            d *= weight[rows][:, None] / len(rows)
            d_top = (d @ net.out.T) * (top > 0)
            chosen = patches[np.arange(len(rows))[:, None], best]
            d_filters = np.einsum("nf,nfk->kf", d_top, chosen) * shape
            d_patch = (d_top[:, :, None] * net.filters.T[None]).reshape(len(rows), -1, widest, CODE)
            padded = np.concatenate([windows[rows], np.zeros((len(rows), widest - 1), np.uint8)], axis=1)
            hit = padded[np.arange(len(rows))[:, None, None], best[:, :, None] + np.arange(widest)]
            d_codes = np.zeros_like(net.codes)
            np.add.at(d_codes, hit.ravel(), d_patch.reshape(-1, CODE))
            d_codes[0] = 0
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, (m, v) in zip(parameters, (d_codes, d_filters, d_top.sum(axis=0), hidden.T @ d, d.sum(axis=0)), moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, text_col: str, lang_col: str, per_language: int, pieces: int, languages: int = LANGUAGES) -> list:
    """Rows (text, lang): pieces spread over at most per_language distinct texts of each language."""
    labelled = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")
    found = labelled.select("lang").distinct().limit(languages + 1).count()
    if found > languages:
        raise ValueError(f"there are over {languages} languages: pass a larger bound")
    span = F.greatest(F.length("text") - WINDOW, F.lit(0))
    cuts = [F.substring(F.col("text"), (F.floor(span * (i / max(pieces - 1, 1))) + 1).cast("int"), F.lit(WINDOW)) for i in range(pieces)]
    rows = sample_texts(labelled, per_language, ["lang"])
    return rows.select(F.explode(F.array_distinct(F.array(*cuts))).alias("text"), "lang").sort("lang", "text").collect()


def held_out(id_col: str, parts: int, left: int) -> Column:
    """Whether the CRC-32 of the id as text, divided by `parts`, leaves `left`; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == left


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE, pieces: int = PIECES, languages: int = LANGUAGES) -> Network | None:
    """The network of the labelled documents; None where there are none (an empty table, or null texts or languages alone).

    Repeated rows count once. Raises ValueError where there are more than `languages` languages.
    """
    rows = sample(docs, text_col, lang_col, per_language, pieces, languages)
    if not rows:
        return None
    network = fit([r["text"] for r in rows], [r["lang"] for r in rows])
    network.letters = fit_letters([r["text"] for r in rows])
    return network


def identify(docs: DataFrame, network: Network | None, text_col: str = "text", keep: list[str] | None = None, judge: bool = False) -> DataFrame:
    """Columns `keep` of docs (all when None) with lang_pred string and score double (0 to 1); judge: and `known` boolean, whether the text's letters
    are likely in a learnt language at all (see Letters), as known_language() tells, in the same pass.

    A null text or one without letters is `und` with score 0, and so is every text where nothing could be learnt. Repeated
    rows are predicted alike; an empty table gives no rows.
    Whole texts of any length are read, where they are; columns of docs named like a new one are replaced.
    """

    def add(batch: pa.RecordBatch) -> dict:
        texts = pc.fill_null(batch.column(text_col), "")
        n = len(texts)
        lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        if network is None:
            return {"lang_pred": pa.array([UNKNOWN] * n), "score": pa.array(np.zeros(n))} | ({"known": pa.array(np.zeros(n, bool))} if judge else {})
        windows, owner, weight = cut_windows(texts)
        total = np.zeros((n, len(network.languages)))
        for i in range(0, len(windows), 4096):
            np.add.at(total, owner[i : i + 4096], network.probabilities(windows[i : i + 4096]) * weight[i : i + 4096, None])
        total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
        best = total.argmax(axis=1)
        score = np.where(lettered, total[np.arange(n), best], 0.0)
        told = {"lang_pred": pa.array([network.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]), "score": pa.array(np.clip(score, 0, 1))}
        return told | ({"known": pa.array(lettered & network.letters.known(texts))} if judge else {})

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + ([T.StructField("known", T.BooleanType())] if judge else [])
    return map_arrow(docs, add, fields, text_col, keep)


def known_language(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """docs without the texts in no learnt language: other scripts, random letters, and texts without a letter, null ones among
    them, which are `und`. Whole texts are read; a text with a few letters only stays in doubt. Columns of any name are kept."""
    moved, back = aside(docs, ["_known"])

    def add(batch: pa.RecordBatch) -> dict:
        texts = pc.fill_null(batch.column(text_col), "")
        return {"_known": pa.array(network.letters.known(texts) & pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False))}

    return back(map_arrow(moved, add, [T.StructField("_known", T.BooleanType())], text_col).where("_known"))
