"""Merkle dataset manifest in van Emde Boas layout.

Rows are leaves: the digest of their fields.  Each group (language) is a tree in which every
``FANOUT`` consecutive digests become one, until one is left; the groups' subroots, in order, are the leaves of one more
such tree, whose root stands for the dataset.

A tree is cut into blocks, aligned subtrees of ``BLOCK_LEVELS`` levels above ``FANOUT ** BLOCK_LEVELS`` nodes.  A block is one
row: its digests lie in van Emde Boas order (a tree of L levels is its upper L // 2 levels followed by the
subtrees below them, each laid out the same way), so a node's place is arithmetic on (levels, depth, position), and a
path from bottom to top stays within few neighbouring stretches whatever the size of a cache line.  The blocks' roots are
the leaves of the next level of blocks, and so on.

1. Rows are numbered in the order (group, id, digest) by a range sort, so a group of any size is split.
2. Upwards, every block is built by one task from at most ``FANOUT ** BLOCK_LEVELS`` digests; blocks are stored.
3. Downwards, each block hands the siblings of its bottom nodes and of its own root to the blocks below; a leaf's
   proof is the siblings in its block, then its block's.  A row of a path is a few kilobytes.

Defined results: a null field is ``-``; rows with one id are leaves of their own, ordered by digest; a null id is first and is
never tampered with; a null group is a group of its own, first in order; a single leaf is its own subroot, a single subroot the root; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import SEQ, sequence_rows
from ..session import attach
from .common import store

FANOUT = 8
BLOCK_LEVELS = 4
DIGEST_BYTES = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BLOCK = "_group long, _block long, _total long, _count long, _above int, _layout binary, _root string"
_PATH = "array<struct<left:string,right:string>>"


def field_text(col: str | Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(*fields: str | Column) -> Column:
    return F.sha2(F.concat(*[field_text(f) for f in fields]), 256)


def tree_size(levels: int, fanout: int = FANOUT) -> int:
    """Nodes of a complete tree of so many levels."""
    return (fanout ** levels - 1) // (fanout - 1)


def address(levels: int, depth: int, position, fanout: int = FANOUT) -> np.ndarray:
    """Place of the nodes at ``depth`` and ``position`` (an array) in the layout of a complete tree of ``levels`` levels."""
    position = np.asarray(position, dtype=np.int64)
    base = np.zeros_like(position)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        depth -= top
        tree, position = np.divmod(position, fanout ** depth)
        base = base + tree_size(top, fanout) + tree * tree_size(levels - top, fanout)
        levels -= top
    return base


def _levels_above(count: int, fanout: int) -> int:
    """Levels above ``count`` nodes until one is left."""
    levels, width = 0, 1
    while width < count:
        levels, width = levels + 1, width * fanout
    return levels


def build_layout(digests: list[str], above: int, fanout: int = FANOUT) -> tuple[bytes, str]:
    """The layout of the tree over the digests, ``above`` levels up, and its root; unused places at its end are left out."""
    out = np.zeros((tree_size(above + 1, fanout), DIGEST_BYTES), np.uint8)
    level, last = digests, 0
    for depth in range(above, -1, -1):
        at = address(above + 1, depth, np.arange(len(level)), fanout)
        out[at] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, DIGEST_BYTES)
        last = max(last, int(at.max()))
        if depth:
            level = [sha256("".join(level[i:i + fanout]).encode()).hexdigest() for i in range(0, len(level), fanout)]
    return out[:last + 1].tobytes(), level[0]


def sibling_strings(layout: bytes, count: int, above: int, fanout: int = FANOUT) -> list[list[tuple[str, str]]]:
    """Per level from the bottom: of every node, the digests to its left and to its right in its run, as text."""
    out = []
    for depth in range(above, 0, -1):
        width = -(-count // fanout ** (above - depth))
        at = address(above + 1, depth, np.arange(width), fanout) * DIGEST_BYTES
        names = [layout[a:a + DIGEST_BYTES].hex() for a in at.tolist()]
        out.append([("".join(names[i - i % fanout:i]), "".join(names[i + 1:i - i % fanout + fanout])) for i in range(width)])
    return out


def proof_of(siblings: list[list[tuple[str, str]]], at: int, fanout: int = FANOUT) -> list[tuple[str, str]]:
    """Left and right siblings on the way from the bottom node ``at`` to the top."""
    path = []
    for level in siblings:
        path.append(level[at])
        at //= fanout
    return path


def fold(digest: str, path: Sequence[tuple[str, str]]) -> str:
    """The top digest that a node and its siblings give."""
    for left, right in path:
        digest = sha256((left + digest + right).encode()).hexdigest()
    return digest


def _build(block_levels: int, fanout: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        digests = pdf.sort_values("_at", kind="stable")["_digest"].tolist()
        first = pdf.iloc[0]
        total = int(first["_total"])
        above = block_levels if total > fanout ** block_levels else _levels_above(total, fanout)
        layout, root = build_layout(digests, above, fanout)
        return pd.DataFrame({"_group": [first["_group"]], "_block": [first["_block"]], "_total": [total],
                             "_count": [len(digests)], "_above": [above], "_layout": [layout], "_root": [root]})
    return build


def build_blocks(nodes: DataFrame, largest: int, name: str, block_levels: int = BLOCK_LEVELS,
                 fanout: int = FANOUT) -> list[DataFrame]:
    """Stored tables of blocks, lowest first, of the trees over ``_group, _at, _total, _digest``.

    ``_at`` counts from 0 in each group, ``_total`` is the group's number of nodes and ``largest`` the greatest of these.
    """
    width, tables = fanout ** block_levels, []
    while True:
        blocks = nodes.withColumn("_block", F.expr(f"_at div {width}")).groupBy("_group", "_block").applyInPandas(
            _build(block_levels, fanout), _BLOCK)
        tables.append(store(blocks, f"{name}-{len(tables)}"))
        if largest <= width:
            return tables
        largest = -(-largest // width)
        nodes = tables[-1].filter(F.col("_total") > width).select(
            "_group", F.col("_block").alias("_at"), F.expr(f"({width - 1} + _total) div {width}").alias("_total"),
            F.col("_root").alias("_digest"))


def group_roots(tables: list[DataFrame], block_levels: int = BLOCK_LEVELS, fanout: int = FANOUT) -> DataFrame:
    """``_group, _root``: the root of every group's tree, from the level at which it has one block."""
    done = [t.filter(F.col("_total") <= fanout ** block_levels).select("_group", "_root") for t in tables]
    return reduce(DataFrame.unionByName, done)


def _hand_down(width: int, fanout: int):
    def hand_down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                siblings = sibling_strings(r["_layout"], r["_count"], r["_above"], fanout)
                own = [(p["left"], p["right"]) for p in r["_path"]]
                paths = [[{"left": a, "right": b} for a, b in proof_of(siblings, i, fanout) + own] for i in range(r["_count"])]
                yield pd.DataFrame({"_group": r["_group"], "_at": r["_block"] * width + np.arange(r["_count"]), "_path": paths})
    return hand_down


def handed_down(blocks: DataFrame, block_levels: int = BLOCK_LEVELS, fanout: int = FANOUT) -> DataFrame:
    """``_group, _at, _path`` of the bottom nodes of blocks that have a ``_path``."""
    return blocks.select("_group", "_block", "_count", "_above", "_layout", "_path").mapInPandas(
        _hand_down(fanout ** block_levels, fanout), f"_group long, _at long, _path {_PATH}")


def paths_below(tables: list[DataFrame], top: DataFrame, block_levels: int = BLOCK_LEVELS,
                fanout: int = FANOUT) -> DataFrame:
    """The lowest table's blocks with ``_path``, the siblings from each block's root upwards.

    ``top`` gives ``_group, _path``, the siblings above each group's root.
    """
    rows = None
    for table in reversed(tables):
        single = F.col("_total") <= fanout ** block_levels
        found = table.filter(single).join(top, "_group")
        if rows is not None:
            below = handed_down(rows, block_levels, fanout).withColumnRenamed("_at", "_block")
            found = found.unionByName(table.filter(~single).join(below, ["_group", "_block"]))
        rows = store(found, "merkle-paths")
    return rows


def _prove(fanout: int):
    def prove(leaves: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = {c: [] for c in ("proof_sha256", "folded_root")}
        b = block.to_dict("records")[0]
        siblings = sibling_strings(b["_layout"], b["_count"], b["_above"], fanout)
        above = [(p["left"], p["right"]) for p in b["_path"]]
        rest = "".join(x + y for x, y in above)
        for at, digest in zip(leaves["_place"].tolist(), leaves["_changed"].tolist()):
            inside = proof_of(siblings, at, fanout)
            out["proof_sha256"].append(sha256(("".join(x + y for x, y in inside) + rest).encode()).hexdigest())
            out["folded_root"].append(fold(fold(digest, inside), above))
        return pd.DataFrame({"_id": leaves["_id"], "leaf": leaves["_digest"], "subroot": b["_subroot"], **out})
    return prove


def number_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (``_key, _id, _digest``, ...) with ``_group, _at, _total``, stored, and ``_group, _total`` of the groups, stored.

    A range sort on (key, id, digest) numbers the rows, so a group of any size is split over tasks.
    """
    rows, _ = sequence_rows(leaves, ["_id", "_digest"], by=["_key"])
    groups = rows.groupBy("_key").agg(F.min(SEQ).alias("_start"), F.count(F.lit(1)).alias("_total"))
    groups, _ = sequence_rows(groups, ["_key"])
    groups = store(groups.withColumnRenamed(SEQ, "_group"), "merkle-groups")
    numbered = attach(rows, groups, "_key").withColumn("_at", F.col(SEQ) - F.col("_start")).drop(SEQ, "_start", "_key")
    return store(numbered, "merkle-leaves"), groups.select("_group", "_total")


def prove_all(leaves: DataFrame, block_levels: int = BLOCK_LEVELS, fanout: int = FANOUT) -> DataFrame:
    """``_id, leaf, subroot, root, proof_sha256, folded_root`` of every leaf.

    ``leaves`` has ``_key`` (the group, a string that is not null), ``_id``, ``_digest`` and ``_changed``, the digest to fold.
    """
    numbered, groups = number_leaves(leaves)
    count, largest = groups.agg(F.count(F.lit(1)), F.max("_total")).first()
    if not count:
        return numbered.select("_id", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")])
    tables = build_blocks(numbered, largest, "merkle-blocks", block_levels, fanout)
    subroots = store(group_roots(tables, block_levels, fanout), "merkle-subroots")
    whole = build_blocks(subroots.select(F.lit(0).cast("long").alias("_group"), F.col("_group").alias("_at"),
                                         F.lit(count).cast("long").alias("_total"), F.col("_root").alias("_digest")),
                         count, "merkle-top", block_levels, fanout)
    root = whole[-1].first()["_root"]  # one row
    nothing = numbered.sparkSession.range(1).select(F.col("id").alias("_group"), F.expr(f"cast(array() as {_PATH})").alias("_path"))
    top = handed_down(paths_below(whole, nothing, block_levels, fanout), block_levels, fanout) \
        .select(F.col("_at").alias("_group"), "_path")
    blocks = paths_below(tables, store(top, "merkle-top-paths"), block_levels, fanout).join(
        subroots.withColumnRenamed("_root", "_subroot"), "_group").select(
        "_group", "_block", "_count", "_above", "_layout", "_path", "_subroot")
    width = fanout ** block_levels
    placed = numbered.select("_group", F.expr(f"_at div {width}").alias("_block"), F.expr(f"_at % {width}").alias("_place"),
                             F.col("_id").cast("string").alias("_id"), "_digest",  # as text: a null would make it a float
                             F.coalesce("_changed", "_digest").alias("_changed"))
    kind = leaves.schema["_id"].dataType.simpleString()
    proved = placed.groupBy("_group", "_block").cogroup(blocks.groupBy("_group", "_block")).applyInPandas(
        _prove(fanout), "_id string, leaf string, subroot string, proof_sha256 string, folded_root string")
    return proved.withColumns({"_id": F.col("_id").cast(kind), "root": F.lit(root)})


def tampered(id_col: str) -> Column:
    """Rows whose text is tampered with: 3 divides the unsigned crc32 of the id as text."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 0, F.lit(False))


def document_leaves(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text",
                    fields: Sequence[str] = FIELDS) -> DataFrame:
    """``_key, _id, _digest, _changed``: every row's digest, and that of the row as tampering leaves it."""
    changed = [F.translate(F.col(f), UPPER, LOWER) if f == text_col else F.col(f) for f in fields]
    digest = leaf_digest(*fields)
    return docs.select(
        F.when(F.col(group_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(group_col))).alias("_key"),
        F.col(id_col).alias("_id"), digest.alias("_digest"),
        F.when(tampered(id_col), leaf_digest(*changed)).alias("_changed"))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text",
             fields: Sequence[str] = FIELDS, block_levels: int = BLOCK_LEVELS, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row."""
    leaves = document_leaves(docs, id_col, group_col, text_col, fields)
    proved = prove_all(leaves, block_levels, fanout)
    return proved.select(F.col("_id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))
