"""Merkle manifest of a dataset, by superblocks.

The leaves of a source, in order, form a tree of some fanout; the sources' roots, in order, form another above them. Levels are
not built one at a time: nodes are bucketed by their place divided by fanout ** LEVELS, and each bucket is collapsed by
that many levels at once in one group of bounded size; the buckets' roots are reduced in the same way, until a tree is one
node. On the way back each bucket is given the proof of its root and gives each of its nodes its own: what it has in the
bucket, then what the root has.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.operators.prefix import places

from .common import checkpoint

FANOUT = 3
#: Levels that a bucket collapses; it has FANOUT ** LEVELS nodes at most.
LEVELS = 7


def field(column: Column) -> Column:
    """A value as UTF-8 byte count, colon and value; `-` for null."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    """SHA-256 of the fields, in lowercase hex."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def fold(node: Column, lefts: Column, rights: Column) -> Column:
    """The root that a node's proof leads to: at each level its siblings to the left, the node, and those to the right."""
    steps = F.zip_with(lefts, rights, lambda l, r: F.struct(l.alias("l"), r.alias("r")))
    return F.aggregate(steps, node, lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256))


def proof_digest(lefts: Column, rights: Column) -> Column:
    """SHA-256 of all siblings of a proof, from the leaf's level to the root, left to right."""
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda l, r: F.concat(l, r)), ""), 256)


def _levels(n: int, fanout: int, most: int) -> tuple[int, int]:
    """Levels that n nodes of a tree still have, `most` at most, and how many nodes are left above them."""
    done = 0
    while n > 1 and done < most:
        n, done = -(-n // fanout), done + 1
    return done, n


def _collapse(nodes: list[str], fanout: int, levels: int, proofs: bool) -> tuple[str, list[list[str]], list[list[str]]]:
    """The root of a bucket's nodes after so many levels; for each node the siblings to its left and right by level."""
    above = list(range(len(nodes)))  # by node: its place on the level
    lefts, rights = [[] for _ in nodes], [[] for _ in nodes]
    for _ in range(levels):
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        if proofs:
            beside = [("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))]
            for i, at in enumerate(above):
                left, right = beside[at]
                lefts[i].append(left)
                rights[i].append(right)
            above = [at // fanout for at in above]
        nodes = [hashlib.sha256("".join(run).encode()).hexdigest() for run in runs]
    return nodes[0], lefts, rights


_NODES = "tree string, place long, n long, node string"
_PROOFS = "tree string, place long, lefts array<string>, rights array<string>, subroot string, root string"


def _up(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Nodes (tree, place, n, node) to the roots of their buckets, in the same form."""
    width = fanout**levels

    def collapse(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        pdf = pdf.sort_values("place")
        steps, left = _levels(n, fanout, levels)
        root, _, _ = _collapse(pdf["node"].tolist(), fanout, steps, False)
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "place": [int(pdf["place"].iloc[0]) // width], "n": [left], "node": [root]})

    return nodes.groupBy("tree", F.expr(f"place div {width}").alias("_bucket")).applyInPandas(collapse, _NODES)


def _down(nodes: DataFrame, above: DataFrame, fanout: int, levels: int, keep: str = "", columns: tuple[str, ...] = ()) -> DataFrame:
    """Proofs of the nodes: those in their buckets, followed by those `above`, which are of the buckets' roots by (tree, place)."""
    width = fanout**levels

    def prove(pdf: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        steps, _ = _levels(int(pdf["n"].iloc[0]), fanout, levels)
        _, lefts, rights = _collapse(pdf["node"].tolist(), fanout, steps, True)
        more = up.iloc[0]
        after_left, after_right = list(more["lefts"]), list(more["rights"])
        out = {c: pdf[c] for c in ("tree", "place", *columns)}
        out |= {"lefts": [x + after_left for x in lefts], "rights": [x + after_right for x in rights]}
        return pd.DataFrame(out | {"subroot": more["subroot"], "root": more["root"]})

    grouped = nodes.groupBy("tree", F.expr(f"place div {width}").alias("_bucket"))
    return grouped.cogroup(above.groupBy("tree", F.col("place").alias("_bucket"))).applyInPandas(prove, _PROOFS + keep)


def _climb(nodes: DataFrame, fanout: int, levels: int, most: int) -> list[DataFrame]:
    """The nodes, the roots of their buckets, theirs, and so on to one node a tree; `most`: nodes of the largest tree."""
    found = [nodes]
    while most > 1:
        found.append(checkpoint(_up(found[-1], fanout, levels)))
        most = _levels(most, fanout, levels)[1]
    return found


def manifest(leaves: DataFrame, source_col: str = "source", order_col: str = "doc_id", leaf_col: str = "leaf", keep: list[str] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Columns `keep` of leaves (all when None), and `place` long, `lefts`, `rights` array<string>, `subroot`, `root`: a leaf's
    place in its source, its proof, and the roots of its source and of all.

    leaves: digests in lowercase hex in leaf_col. Those of a source ascend by order_col, null first; rows that are equal in it, by their
    digests, so that repeated rows have a place each. Sources ascend by the bytes of their names, null first. While there is more
    than one node, every `fanout` consecutive ones, the last ones maybe fewer, become the SHA-256 of their digests' text. lefts and rights
    have an element a level: the siblings' digests on that side, joined. A lone leaf is its source's root, a lone source's root
    the root. An empty table gives an empty table. Columns that are named like new ones are replaced where they are kept.

    Only digests and kept columns are shuffled; keep no texts. A bucket has fanout ** levels nodes, so a source of any share of the
    rows is many groups. Every stage but the last is written in the shared folder.
    """
    new = ("place", "lefts", "rights", "subroot", "root")
    kept = [c for c in (leaves.columns if keep is None else keep) if c not in new]
    named = {c: f"_k{i}" for i, c in enumerate(kept)}
    # '' for null, else a mark and the name: the same order, and no nulls.
    tree = F.when(F.col(f"`{source_col}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")))
    rows = checkpoint(leaves.select(tree.alias("tree"), F.col(f"`{order_col}`").alias("_order"), F.col(f"`{leaf_col}`").alias("node"), *[F.col(f"`{c}`").alias(x) for c, x in named.items()]))
    numbered = places(rows, ["tree"], ["_order", "node"], "place", "n").drop("_order")
    low = _climb(numbered.select("tree", "place", "n", "node"), fanout, levels, numbered.agg(F.max("n")).first()[0] or 0)
    subroots = low[-1] if len(low) > 1 else numbered
    ordered = places(subroots.select(F.col("tree").alias("source"), "node"), [], ["source"], "place", "n")
    top_nodes = checkpoint(ordered.select(F.lit("").alias("tree"), "place", "n", "node", "source"))
    high = _climb(top_nodes.select("tree", "place", "n", "node"), fanout, levels, top_nodes.count())
    none = F.array().cast("array<string>")
    proofs = high[-1].select("tree", F.lit(0).cast("long").alias("place"), none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    for nodes in reversed(high[1:-1]):
        proofs = _down(nodes, proofs, fanout, levels)
    if len(high) > 1:
        proofs = _down(top_nodes, proofs, fanout, levels, ", source string, node string", ("source", "node"))
    else:
        proofs = proofs.join(top_nodes.select("tree", "source", "node"), "tree")
    proofs = checkpoint(proofs.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("place"), "lefts", "rights", F.col("node").alias("subroot"), "root"))
    for nodes in reversed(low[1:-1]):
        proofs = _down(nodes, proofs, fanout, levels)
    kinds = dict(rows.dtypes)
    if len(low) > 1:
        out = _down(numbered, proofs, fanout, levels, "".join(f", {x} {kinds[x]}" for x in named.values()), tuple(named.values()))
    else:
        out = numbered.join(proofs.drop("place"), "tree")
    return out.select(*[F.col(x).alias(c) for c, x in named.items()], *new)
