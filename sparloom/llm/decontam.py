"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all test items.

Words are lower-cased (A-Z only) runs of digits, letters and non-ASCII characters. A window is `size` consecutive words
of an item; a shorter item with words is one window. The automaton's alphabet is the word, so a text is scanned once,
word by word, and a match ends on a word whose place in the original text is known.

A null or empty text has no words and no hits; an item without words has no window; repeated items or windows count
once for each item id. Texts and items may be of any length. Repeated documents, and documents without an id, stay rows of
their own. An empty table of documents gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, binary, map_arrow, written

WINDOW = 13
#: Bytes of benchmark text in one automaton, which takes some 150 times as much memory in each Python worker. A larger benchmark is
#: scanned in as many blocks as that takes, one after the other.
BLOCK_BYTES = 2 << 20
#: Most children of a node of the automaton.
BASE = 512
#: Windows of an item that stay together; those of a longer item may lie in several blocks.
PIECE = 50_000

#: ASCII bytes that separate words become a space, A-Z become a-z; bytes of non-ASCII characters stay.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", _SPAN),
    T.StructField("hit_spans", _SPAN),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows(items: list[tuple[str, bytes]], size: int = WINDOW) -> dict[tuple[bytes, ...], list[str]]:
    """Each window with the ids of the items that have it."""
    found: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
    for item, text in items:
        w = words(text)
        for window in {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else ():
            found[window].append(item)
    return found


class Scanner:
    """The automaton, built once in each Python worker.

    A word is coded as `width` characters, its number's digits to the base BASE, each place with characters of its own: so a match
    begins and ends with a word, any number of words can be told apart, and no node has more than BASE children.
    """

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.items, self.size, self.automaton = items, size, None

    def __getstate__(self):
        return {"items": self.items, "size": self.size, "automaton": None}

    def build(self) -> None:
        import ahocorasick

        found = windows(self.items, self.size)
        numbers: dict[bytes, int] = {}
        for window in found:
            for w in window:
                numbers.setdefault(w, len(numbers))
        self.width = next(k for k in range(1, 9) if len(numbers) <= BASE**k)
        self.codes = {w: "".join([chr(1 + BASE * k + n // BASE**k % BASE) for k in range(self.width)]) for w, n in numbers.items()}
        self.unknown = "\0" * self.width
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for window, ids in found.items():
            self.automaton.add_word("".join([self.codes[w] for w in window]), (len(window), tuple(dict.fromkeys(ids))))
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit words as sorted disjoint half-open ranges, ids of items hit."""
        if self.automaton is None:
            self.build()
        w = words(text)
        if not len(self.automaton) or not w:
            return len(w), [], set()
        code, unknown, width = self.codes.get, self.unknown, self.width
        ranges: list[tuple[int, int]] = []
        ids: set[str] = set()
        seen = set()
        for at, (n, items) in self.automaton.iter("".join([code(x, unknown) for x in w])):
            end = at // width
            first = end + 1 - n
            while ranges and ranges[-1][1] >= first:
                first = min(first, ranges.pop()[0])
            ranges.append((first, end + 1))
            if items not in seen:
                seen.add(items)
                ids.update(items)
        return len(w), ranges, ids


def merge(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Ranges of words with their offsets, (start, end, start, end), those that overlap or touch made one."""
    out: list[tuple[int, int, int, int]] = []
    for s, e, a, b in sorted(found):
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(e, out[-1][1]), out[-1][2], max(b, out[-1][3]))
        else:
            out.append((s, e, a, b))
    return out


def spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point offsets into the original text."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(_NORMAL))]
    out, byte, point = [], 0, 0
    for s, e in ranges:
        a, b = at[s][0], at[e - 1][1]
        start = point + len(text[byte:a].decode("utf-8", "replace"))
        end = start + len(text[a:b].decode("utf-8", "replace"))
        byte, point = b, end
        out.append((start, end))
    return out


def pieces(benchmark: DataFrame, item_col: str, text_cols: list[str], size: int, piece: int = PIECE) -> DataFrame:
    """Distinct (item string, text string): each text column's words, cut so that a piece has `piece` windows at most and every
    window lies in one."""
    texts = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.explode(F.array(*text_cols)).alias("text")).where("text is not null")

    def cut(batches):
        for batch in batches:
            items, made = [], []
            for item, text in zip(batch.column("item").to_pylist(), binary(batch.column("text")).to_pylist()):
                w = words(text)
                for i in range(0, max(1, len(w) - size + 1), piece):
                    items.append(item)
                    made.append(b" ".join(w[i : i + piece + size - 1]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(made, pa.string())], names=["item", "text"])

    return texts.mapInArrow(cut, "item string, text string").where("text <> ''").distinct()


def _scanned(docs: DataFrame, items: list, text_col: str, keep: list[str] | None, size: int) -> tuple[DataFrame, Broadcast]:
    shared = docs.sparkSession.sparkContext.broadcast(Scanner([(r.item, r.text.encode()) for r in items], size))

    def add(batch: pa.RecordBatch) -> dict:
        made: dict[str, list] = {f.name: [] for f in FIELDS}
        for text in binary(batch.column(text_col)).to_pylist():
            n, ranges, ids = shared.value.scan(text or b"")
            pair = lambda xs: [{"start": s, "end": e} for s, e in xs]
            for name, value in zip(made, (n, pair(ranges), pair(spans(text or b"", ranges)), sorted(ids))):
                made[name].append(value)
        return made

    return map_arrow(docs, add, FIELDS, text_col, keep), shared


def find_benchmark_text(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_cols: list[str] | None = None, keep: list[str] | None = None, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, piece: int = PIECE) -> DataFrame:
    """Columns `keep` of docs (all when None) with n_words, hit_words and hit_spans (half-open ranges of words, and of
    code points in the original text) and items (sorted ids of items with an occurring window).

    The automaton goes to the tasks, and texts are scanned where they are read, without a shuffle. A benchmark over block_bytes
    is dealt over blocks by a hash; docs are then written once with row numbers, each block in turn is collected, scanned for and
    let go, its hits are written, and hits of a row are merged. So driver and tasks hold one block at a time. Columns of
    docs named like a new one are replaced; any other name is kept, whatever the benchmark's size.
    """
    cut = written(pieces(benchmark, item_col, bench_cols or ["text"], size, piece))
    n = -(-(cut.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    if n <= 1:
        return _scanned(docs, cut.sort("item", "text").collect(), text_col, keep, size)[0]
    new = {f.name for f in FIELDS}
    rest = [c for c in (docs.columns if keep is None else keep) if c not in new]
    docs, _ = aside(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*rest, text_col])]), ["_row_number"])
    names = dict(zip(dict.fromkeys([*rest, text_col]), docs.columns))
    given, rest, text_col = rest, [names[c] for c in rest], names[text_col]
    rows = written(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*rest, text_col])]).withColumn("_row_number", F.monotonically_increasing_id()))
    hits = None
    for b in range(n):
        block = cut.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).sort("item", "text").collect()
        found, shared = _scanned(rows, block, text_col, ["_row_number"], size)
        found = written(found if b == 0 else found.where(F.size("items") > 0))
        shared.destroy()
        hits = found if hits is None else hits.unionByName(found)

    def merged(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [pa.int64(), *[to_arrow_type(f.dataType) for f in FIELDS]]
        for batch in batches:
            made = []
            for row, n_words, parts in zip(*[batch.column(c).to_pylist() for c in ("_row_number", "n_words", "parts")]):
                found = merge([(w["start"], w["end"], s["start"], s["end"]) for p in parts for w, s in zip(p["hit_words"], p["hit_spans"])])
                pair = lambda i: [{"start": x[i], "end": x[i + 1]} for x in found]
                made.append((row, n_words, pair(0), pair(2), sorted({i for p in parts for i in p["items"]})))
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=["_row_number", *[f.name for f in FIELDS]])

    schema = T.StructType([T.StructField("_row_number", T.LongType()), *FIELDS])
    joined = hits.groupBy("_row_number").agg(F.first("n_words").alias("n_words"), F.collect_list(F.struct("hit_words", "hit_spans", "items")).alias("parts")).mapInArrow(merged, schema)
    found = rows.select("_row_number", *[F.col(f"`{c}`") for c in rest]).join(joined, "_row_number")
    return found.select(*[F.col(f"`{c}`").alias(name) for c, name in zip(rest, given)], *[f.name for f in FIELDS])


def n_hit() -> F.Column:
    """Words hit, of the columns that find_benchmark_text() adds."""
    return F.aggregate("hit_words", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def is_contaminated(share: int = 20) -> F.Column:
    """One word in `share` or more lies in windows of the benchmark."""
    return (n_hit() > 0) & (share * n_hit() >= F.col("n_words"))
