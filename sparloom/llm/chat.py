"""Chat formatting by columnar byte assembly.

A conversation becomes `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Inside texts and roles a control string can't
appear: `<`, any backslashes and `|` get one more backslash, which reading takes off again; in roles, backslashes
and line breaks are escaped before that.

Rows are hash-partitioned by conversation and sorted by turn inside the partition, then streamed: at most TURNS turns, and BYTES
bytes of their texts unless one alone has more, make one output row (conv_id, chunk), so a conversation of any length is never held
whole. For each run of rows the lengths
of all segments give cumulative offsets and scatter indices, and headers and contents are copied at once into one buffer
that becomes the Arrow column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "\n"
TURNS = 32
BYTES = 2 << 20
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def escape_role(roles: pa.Array) -> pa.Array:
    roles = pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n")
    return escape(roles)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, and its rows' offsets into them."""
    data = column.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    body = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if data.buffers()[2] is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def assemble(roles: pa.Array, texts: pa.Array, groups: np.ndarray) -> tuple[pa.LargeStringArray, list[list[dict]]]:
    """Formatted text of each group of consecutive rows (groups: each row's number, from 0 without gaps), and the code
    point spans of assistant texts in it."""
    n = len(texts)
    learn = pc.equal(roles, "assistant").to_numpy(zero_copy_only=False)
    fixed = np.frombuffer((START + BREAK + END).encode(), np.uint8)
    role_bytes, role_at = _parts(escape_role(roles))
    text_bytes, text_at = _parts(escape(texts))
    pool = np.concatenate([fixed, role_bytes, text_bytes])
    # Each turn has five segments: start mark, role, line break, text, end mark.
    sizes, sources = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    for k, (source, size) in enumerate([(0, len(START)), (len(fixed) + role_at[:-1], np.diff(role_at)), (len(START), 1), (len(fixed) + len(role_bytes) + text_at[:-1], np.diff(text_at)), (len(START) + 1, len(END))]):
        sizes[:, k], sources[:, k] = size, source
    ends = np.cumsum(sizes.ravel())
    starts = (ends - sizes.ravel()).reshape(n, 5)
    scatter = np.repeat((sources - starts).ravel(), sizes.ravel()) + np.arange(ends[-1] if n else 0)
    out = pool[scatter]
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if n else np.zeros(0, np.int64)
    bounds = np.r_[starts[first, 0], ends[-1] if n else 0].astype(np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(out)])
    points = np.r_[0, np.cumsum((out & 0xC0) != 0x80)]
    spans: list[list[dict]] = [[] for _ in first]
    base = points[bounds[:-1]]
    for row in np.flatnonzero(learn):
        g, s = groups[row], starts[row, 3]
        spans[g].append({"start": int(points[s] - base[g]), "end": int(points[s + sizes[row, 3]] - base[g])})
    return formatted, spans


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", turns: int = TURNS, limit: int = BYTES) -> DataFrame:
    """conv_col, chunk int, n_turns int, formatted string, loss_spans array<struct<start, end>> (code points of
    `formatted` under the loss mask: the assistant's texts).

    A conversation's chunks, in order, are its formatted text; they lie in one partition, in order. Null texts and
    roles count as empty; rows of a null conversation make one conversation; equal turns are ordered by role and text;
    other columns are left out. An empty table gives no rows. One shuffle, by conversation.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    ordered = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    ordered = ordered.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    schema = T.StructType([T.StructField(conv_col, ordered.schema["conv"].dataType), T.StructField("chunk", T.IntegerType()), T.StructField("n_turns", T.IntegerType()), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", _SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        def emit(part: pa.RecordBatch, group: np.ndarray, chunk: np.ndarray) -> pa.RecordBatch:
            formatted, spans = assemble(part.column("role"), part.column("text"), group)
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            count = np.diff(np.r_[first, len(group)])
            return pa.RecordBatch.from_arrays(
                [part.column("conv").take(pa.array(first)), pa.array(chunk[first], pa.int32()), pa.array(count, pa.int32()), formatted.cast(pa.string()), pa.array(spans, to_arrow_type(_SPANS))],
                names=schema.names,
            )

        carry, last, number = None, None, 0  # rows of the chunk that may go on, its conversation and its number
        for batch in batches:
            for part in slices(batch, "text"):
                if carry is not None:
                    part = pa.Table.from_batches([carry, part]).combine_chunks().to_batches()[0]
                conv, sizes = part.column("conv").to_pylist(), pc.binary_length(part.column("text")).to_pylist()
                chunk, count, held = np.empty(len(conv), np.int64), 0, 0
                new = np.zeros(len(conv), bool)
                for i, (c, size) in enumerate(zip(conv, sizes)):
                    if i == 0:
                        number = number if last == (c,) else 0
                    elif c != conv[i - 1]:
                        number, count, held, new[i] = 0, 0, 0, True
                    elif count >= turns or held + size > limit:
                        number, count, held, new[i] = number + 1, 0, 0, True
                    chunk[i] = number
                    count, held = count + 1, held + size
                group = np.cumsum(new)
                cut = int(np.searchsorted(group, group[-1]))
                if cut:
                    yield emit(part.slice(0, cut), group[:cut], chunk[:cut])
                carry, last, number = part.slice(cut), (conv[cut],), int(chunk[cut])
        if carry is not None:
            n = carry.num_rows
            yield emit(carry, np.zeros(n, np.int64), np.full(n, number))

    return ordered.mapInArrow(run, schema)


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; raises where the text isn't made of whole turns."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def digests(chunks: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from format_chats' rows: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Streams the chunks in the order in which format_chats leaves them; no shuffle."""
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.LongType()]
    schema = T.StructType([chunks.schema[conv_col], *[T.StructField(n, k) for n, k in zip(names, kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in schema.fields]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names=schema.names)
        now: list | None = None
        for batch in batches:
            out = []
            for conv, chunk, text, spans in zip(*[batch.column(c).to_pylist() for c in (conv_col, "chunk", "formatted", "loss_spans")]):
                if chunk == 0:
                    if now:
                        out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = read_turns(text)
                now[1] += len(turns)
                now[2].update("".join(f"{role}\n{said}\n" for role, said in turns).encode())
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                now[3] += len(learnt)
                now[4].update(learnt.encode())
                now[5] += len(text)
            yield pack(out)
        if now:
            yield pack([(now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])])

    return chunks.mapInArrow(run, schema)
