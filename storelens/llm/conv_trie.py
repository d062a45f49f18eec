"""Prefix trie of conversations, with subtree totals by centroid decomposition.

Every distinct sequence of first turns is a node.  A turn is hashed once; a prefix is the position-dependent sum of its
turns' hashes (four running sums of 32-bit pieces of two 64-bit hashes), so a prefix's key and its parent's come from
running sums, which are taken in two levels (runs of rows, then the runs' totals): a conversation of any length is split.

The nodes with one smallest member are a chain, as a node has it in common with one child at most.  The chains, with the
edge from a chain's top to its parent's chain, are a forest of one row per chain.  Their subtree totals are rolled up by centroid decomposition:

1. A component's weight is its number of conversations, known from the nodes.  Its centroid is the deepest chain that
   still has half of it.
2. The components below the centroid are totalled, and the sum, with the centroid's own value, is added to the centroid and to all
   chains on the way from it to the component's top.
3. The component falls into those below the centroid and what is above; each has at most half of the weight (or, above, less than half).
   So the rounds are logarithmic in the number of conversations, however deep the trie is.

Components heavier than ``COMPONENT`` are split in rounds of joins; lighter ones are decomposed
within a task, some thousands of chains at a time.  A node's totals are then those of the nodes below on its own chain
and of the chains that hang from these: running sums along the chain.

Defined results: rows without a ``conv_id`` belong to no conversation; null role or text is empty; turns with one number
follow each other by role and text; repeated rows are turns of their own; a conversation left without turns is a member of the root only; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequence import SEQ, sequence_rows
from .common import store, text_or_empty

FAMILY = 100       # conversations that share the heads of one
HEADS = 6          # a head has less than so many turns
RUN = 4096         # rows of one run of a running sum, and ids in one piece of a member list
COMPONENT = 4096   # conversations of a component that one task decomposes

_KEY = ["_k1", "_k2"]


def running_sums(df: DataFrame, key: str, order: str, sums: dict[str, Column], run: int = RUN,
                 falling: bool = False) -> DataFrame:
    """``df`` with sums over the rows of the same ``key`` up to and including this one, by ``order`` (a long).

    Sums within runs of ``run`` order values, plus the totals of the runs before: no task holds a key's rows, one of
    every ``run`` of them at most.
    """
    rows = df.withColumn("_run", F.expr(f"{order} div {run}"))
    by = F.col(order).desc() if falling else F.col(order)
    inside = Window.partitionBy(key, "_run").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    by = F.col("_run").desc() if falling else F.col("_run")
    before = Window.partitionBy(key).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "_run").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    carry = totals.select(key, "_run", *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_carry_{n}") for n in sums])
    local = rows.withColumns({f"_local_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    out = local.join(carry, [key, "_run"])
    return out.withColumns({n: F.col(f"_local_{n}") + F.col(f"_carry_{n}") for n in sums}).drop(
        "_run", *[f"_local_{n}" for n in sums], *[f"_carry_{n}" for n in sums])


def head_turns(conv: Column) -> Column:
    """Turns that a conversation takes over from the first of its family: unsigned crc32 of its id as text, modulo ``HEADS``."""
    return F.crc32(F.encode(conv.cast("string"), "UTF-8")) % HEADS


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``_c, _d, _len, _chars, _h1, _h2`` of every turn of the rebuilt conversations, and ``_c, _len`` of all of them (stored)."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("_c"), F.col("turn").alias("_turn"), text_or_empty("role").alias("_role"),
        text_or_empty("text").alias("_text"))
    ordered, _ = sequence_rows(rows, ["_turn", "_role", "_text"], by=["_c"])
    turns = ordered.select("_c", SEQ, F.length("_text").cast("long").alias("_chars"),
                           F.xxhash64("_role", "_text").alias("_h1"), F.xxhash64(F.lit(SEQ), "_text", "_role").alias("_h2"))
    turns = store(running_sums(turns, "_c", SEQ, {"_pos": F.lit(1)}).drop(SEQ), "trie-turns")
    sizes = turns.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"))
    convs = sizes.select("_c", "_n", head_turns(F.col("_c")).alias("_h"), (F.col("_c") - F.col("_c") % FAMILY).alias("_base"))
    first = sizes.select(F.col("_c").alias("_base"), F.col("_n").alias("_n_base"))
    convs = convs.join(first, "_base", "left").withColumn("_k", F.least("_h", F.coalesce("_n_base", F.lit(0)))).select(
        "_c", "_base", "_h", "_k", (F.col("_k") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0))).alias("_len"))
    convs = store(convs, "trie-conversations")
    what = ["_c", "_d", "_len", "_chars", "_h1", "_h2"]
    own = turns.join(convs, "_c").filter(F.col("_pos") > F.col("_h")) \
        .withColumn("_d", F.col("_pos") - F.col("_h") + F.col("_k")).select(*what)
    heads = turns.filter(F.col("_pos") < HEADS).withColumnRenamed("_c", "_base").join(convs, "_base") \
        .filter(F.col("_pos") <= F.col("_h")).withColumnRenamed("_pos", "_d").select(*what)
    return heads.unionByName(own), convs.select("_c", "_len")


def _keys(depth: Column, sums: list[Column], names: list[str]) -> list[Column]:
    return [F.xxhash64(depth, *sums).alias(names[0]), F.xxhash64(F.lit(1), *reversed(sums), depth).alias(names[1])]


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``_c, _d, _len, _chars, _k1, _k2, _p1, _p2``: every prefix of every conversation, the empty one too, with the key of its parent."""
    a, b = F.xxhash64("_d", "_h1", "_h2"), F.xxhash64(F.lit(1), "_h2", "_d", "_h1")
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    pieces = {"_w1": low(a), "_w2": F.shiftrightunsigned(a, 32), "_w3": low(b), "_w4": F.shiftrightunsigned(b, 32)}
    rows = turns.withColumn("_d", F.col("_d").cast("long")).withColumns(pieces).drop("_h1", "_h2")
    sums = running_sums(rows, "_c", "_d", {f"_s{i}": F.col(f"_w{i}") for i in (1, 2, 3, 4)})
    here, above = [F.col(f"_s{i}") for i in (1, 2, 3, 4)], [F.col(f"_s{i}") - F.col(f"_w{i}") for i in (1, 2, 3, 4)]
    zero = F.lit(0).cast("long")
    some = sums.select("_c", "_d", "_len", "_chars", *_keys(F.col("_d"), here, _KEY),
                       *_keys(F.col("_d") - 1, above, ["_p1", "_p2"]))
    empty = convs.select("_c", zero.alias("_d"), "_len", zero.alias("_chars"), *_keys(zero, [zero] * 4, _KEY),
                         F.lit(None).cast("long").alias("_p1"), F.lit(None).cast("long").alias("_p2"))
    return some.unionByName(empty)


def trie_nodes(rows: DataFrame) -> DataFrame:
    """One stored row per node: ``_k1, _k2, _c`` (smallest member), ``_d, _parent, _n, _kids, _chars``."""
    nodes = store(rows.groupBy(*_KEY).agg(F.min("_c").alias("_c"), F.min("_d").alias("_d"), F.min("_p1").alias("_p1"),
                                          F.min("_p2").alias("_p2"), F.max("_chars").alias("_chars"),
                                          F.count(F.lit(1)).alias("_n")), "trie-nodes")
    kids = nodes.filter(F.col("_p1").isNotNull()).groupBy("_p1", "_p2").agg(F.count(F.lit(1)).alias("_kids")) \
        .withColumnsRenamed({"_p1": "_k1", "_p2": "_k2"})
    # Both sides are stored: adaptive execution can split the children of a node that has very many.
    parents = nodes.select(F.col("_k1").alias("_p1"), F.col("_k2").alias("_p2"), F.col("_c").alias("_parent"))
    return store(nodes.join(parents, ["_p1", "_p2"], "left").join(kids, _KEY, "left").select(
        *_KEY, "_c", "_d", "_parent", "_n", F.coalesce("_kids", F.lit(0)).alias("_kids"), "_chars"), "trie-nodes")


def trie_chains(nodes: DataFrame) -> DataFrame:
    """One stored row per chain: ``_m`` (its conversation), ``_p`` (parent chain), ``_top`` (depth), ``_w`` (members) and its own totals."""
    top = lambda c: F.min_by(c, "_d")
    return store(nodes.groupBy("_c").agg(
        top("_parent").alias("_p"), F.min("_d").alias("_top"), top("_n").alias("_w"),
        F.sum((F.col("_kids") == 0).cast("long")).alias("_leaves"),
        F.sum((F.col("_n") - 1) * F.col("_chars")).alias("_saved")).withColumnRenamed("_c", "_m"), "trie-chains")


def chain_ancestors(rows: DataFrame, nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """``_m, _anc, _below``: every chain above ``_m``, and the chain next below it on the way to ``_m`` (``_m`` itself if there is none)."""
    above = rows.select("_c", "_d", *_KEY).join(chains.select(F.col("_m").alias("_c"), "_top"), "_c") \
        .filter(F.col("_d") < F.col("_top")).select(F.col("_c").alias("_m"), *_KEY)
    on = store(above, "trie-above").join(nodes.select(*_KEY, F.col("_c").alias("_below")), _KEY) \
        .select("_m", "_below").distinct().unionByName(chains.select("_m", F.col("_m").alias("_below")))
    parent = chains.filter(F.col("_p").isNotNull()).select(F.col("_m").alias("_below"), F.col("_p").alias("_anc"))
    return store(store(on, "trie-on-path").join(parent, "_below"), "trie-ancestors")


def centroid_totals(parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of the rows of ``values`` in a forest, by centroid decomposition.

    ``parent`` is the number of each node's parent, which comes before it, or -1.
    """
    n = len(parent)
    total, up = np.zeros_like(values), parent.tolist()
    comp = [0] * n
    for i, p in enumerate(up):
        comp[i] = i if p < 0 else comp[p]
    members: dict[int, list[int]] = {}
    for i, c in enumerate(comp):
        members.setdefault(c, []).append(i)
    todo, size = list(members.values()), [0] * n
    while todo:
        nodes = todo.pop()
        top, label = nodes[0], comp[nodes[0]]
        for i in nodes:
            size[i] = 1
        for i in reversed(nodes[1:]):
            size[up[i]] += size[i]
        half = [i for i in nodes if 2 * size[i] >= len(nodes)]
        centroid = min(half, key=lambda i: (size[i], -i))
        below: dict[int, list[int]] = {}
        above = []
        for i in nodes:  # parents come first
            if i == centroid:
                continue
            if up[i] == centroid and i != top:
                comp[i] = n + i
            elif i != top and comp[up[i]] != label:
                comp[i] = comp[up[i]]
            else:
                above.append(i)
                continue
            below.setdefault(comp[i], []).append(i)
        amount = values[centroid] + sum((values[part].sum(axis=0) for part in below.values()), np.zeros(values.shape[1], values.dtype))
        i = centroid
        while True:
            total[i] += amount
            if i == top:
                break
            i = up[i]
        comp[centroid] = -1 - centroid
        todo += [part for part in (above, *below.values()) if part]
    return total


def _decompose(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["_top", "_m"], ignore_index=True)
    number = {key: i for i, key in enumerate(zip(pdf["_m"].tolist(), pdf["_comp"].tolist()))}
    own = pdf["_m"].tolist()
    parent = np.array([number.get((p, c), -1) if p != m else -1
                       for m, p, c in zip(own, pdf["_p"].tolist(), pdf["_comp"].tolist())])
    total = centroid_totals(parent, pdf[["_leaves", "_saved"]].to_numpy(dtype=np.int64))
    return pd.DataFrame({"_m": pdf["_m"], "_leaves": total[:, 0], "_saved": total[:, 1]})


def _split_round(state: DataFrame, ancestors: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Every component over ``limit`` falls apart at its centroid: the new state, and what that adds to which chain."""
    heavy = state.filter((F.col("_m") == F.col("_comp")) & (F.col("_w") > limit)).select("_comp", F.col("_w").alias("_all"))
    centroids = state.join(heavy, "_comp").filter(2 * F.col("_w") >= F.col("_all")).groupBy("_comp").agg(
        F.min(F.struct("_w", -F.col("_top"), "_m")).alias("_x")).select(
        "_comp", F.col("_x._m").alias("_centroid"), F.col("_x._w").alias("_cut"))
    centroids = store(centroids, "trie-centroids")
    # Below the centroids: each of their children begins a component.
    below = ancestors.join(centroids.select(F.col("_centroid").alias("_anc"), "_comp"), "_anc").select(
        "_m", "_comp", F.col("_below").alias("_new"))
    moved = state.join(below, ["_m", "_comp"], "left").join(centroids, "_comp", "left")
    moved = store(moved.withColumn("_is", F.col("_m") == F.col("_centroid")), "trie-moved")
    parts = moved.filter(F.col("_new").isNotNull() | F.col("_is"))
    amounts = parts.groupBy("_comp", "_centroid", "_cut", "_new").agg(F.sum("_leaves").alias("_l"), F.sum("_saved").alias("_s")) \
        .groupBy("_comp", "_centroid", "_cut").agg(F.sum("_l").alias("_amount_l"), F.sum("_s").alias("_amount_s"))
    amounts = store(amounts, "trie-amounts")
    # The way up from each centroid, within its component.
    way = ancestors.join(amounts, F.col("_m") == F.col("_centroid")).select(
        F.col("_anc").alias("_m"), "_comp", "_cut", "_amount_l", "_amount_s")
    way = store(state.select("_m", "_comp").join(way, ["_m", "_comp"]), "trie-ways")
    added = way.select("_m", F.col("_amount_l").alias("_leaves"), F.col("_amount_s").alias("_saved")).unionByName(
        amounts.select(F.col("_centroid").alias("_m"), F.col("_amount_l").alias("_leaves"), F.col("_amount_s").alias("_saved")))
    left = moved.filter(~F.coalesce("_is", F.lit(False))).select(
        "_m", "_comp", "_p", "_top", "_w", "_leaves", "_saved", "_new").join(
        way.select("_m", "_comp", F.col("_cut").alias("_less")), ["_m", "_comp"], "left")
    state = left.select("_m", F.coalesce("_new", "_comp").alias("_comp"), "_p", "_top",
                        (F.col("_w") - F.coalesce("_less", F.lit(0))).alias("_w"), "_leaves", "_saved")
    return store(state, "trie-state"), added


def subtree_totals(chains: DataFrame, ancestors: DataFrame, limit: int = COMPONENT) -> DataFrame:
    """``_m, _leaves, _saved`` summed over every chain's subtree of the forest."""
    root = chains.filter(F.col("_p").isNull()).first()  # one row, none in an empty table
    state, added = store(chains.withColumn("_comp", F.lit(root["_m"] if root else 0).cast("long")), "trie-state"), []
    while True:
        heaviest, n = state.filter(F.col("_m") == F.col("_comp")).agg(F.max("_w"), F.sum("_w")).first()
        if heaviest is None or heaviest <= limit:
            break
        state, more = _split_round(state, ancestors, limit)
        added.append(more)
    groups = 1 + (n or 0) // limit
    # The top chain stands for its own parent: a long column without nulls stays one in the workers.
    light = state.withColumn("_p", F.coalesce("_p", "_m")).withColumn("_group", F.pmod(F.xxhash64("_comp"), F.lit(groups))).groupBy("_group").applyInPandas(
        _decompose, "_m long, _leaves long, _saved long")
    return reduce(DataFrame.unionByName, added, light).groupBy("_m").agg(
        F.sum("_leaves").alias("_leaves"), F.sum("_saved").alias("_saved"))


def _hash_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, state = None, None
    for pdf in batches:
        done = []
        for k1, k2, text in zip(pdf["_k1"].tolist(), pdf["_k2"].tolist(), pdf["_ids"].tolist()):
            if (k1, k2) == key:
                state.update(b"," + text.encode())
                continue
            if key is not None:
                done.append((*key, state.hexdigest()))
            key, state = (k1, k2), sha256(text.encode())
        yield pd.DataFrame(done, columns=["_k1", "_k2", "_sha"]).astype({"_k1": "int64", "_k2": "int64", "_sha": "object"})
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["_k1", "_k2", "_sha"])


def end_lists(rows: DataFrame) -> DataFrame:
    """``_k1, _k2, _sha`` of the nodes at which conversations end: sha256 of their ids, ascending, comma-joined.

    Ids are joined in pieces of ``RUN`` numbers; a node's pieces are hashed one after another, none kept.
    """
    ends, _ = sequence_rows(rows.filter(F.col("_d") == F.col("_len")).select(*_KEY, "_c"), ["_c"], by=_KEY)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("_c")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy(*_KEY, F.expr(f"{SEQ} div {RUN}").alias("_piece")).agg(ids.alias("_ids"))
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "_piece").mapInPandas(
        _hash_lists, "_k1 long, _k2 long, _sha string")


def conversation_trie(conversations: DataFrame, limit: int = COMPONENT) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns, convs = rebuilt_turns(conversations)
    rows = store(prefixes(turns, convs), "trie-prefixes")
    nodes = trie_nodes(rows)
    chains = trie_chains(nodes)
    totals = store(subtree_totals(chains, chain_ancestors(rows, nodes, chains), limit), "trie-totals")
    # What hangs from a node: the chains whose top is its child.
    hung = chains.filter(F.col("_p").isNotNull()).select("_m", F.col("_p").alias("_c"), (F.col("_top") - 1).alias("_d")) \
        .join(totals, "_m").groupBy("_c", "_d").agg(F.sum("_leaves").alias("_hung_l"), F.sum("_saved").alias("_hung_s"))
    values = nodes.join(hung, ["_c", "_d"], "left").withColumns({
        "_l": (F.col("_kids") == 0).cast("long") + F.coalesce("_hung_l", F.lit(0)),
        "_s": (F.col("_n") - 1) * F.col("_chars") + F.coalesce("_hung_s", F.lit(0))})
    summed = running_sums(values.select(*_KEY, "_c", "_d", "_parent", "_n", "_kids", "_l", "_s"), "_c", "_d",
                          {"_leaves": F.col("_l"), "_saved": F.col("_s")}, falling=True)
    nobody = sha256(b"").hexdigest()
    return summed.join(end_lists(rows), _KEY, "left").select(
        F.col("_c").alias("conv_id"), F.col("_d").alias("depth"), F.col("_parent").alias("parent_conv_id"),
        F.col("_n").alias("n_convs"), F.col("_kids").alias("n_children"), F.col("_leaves").alias("n_leaves"),
        F.col("_saved").alias("saved_tokens"), F.coalesce("_sha", F.lit(nobody)).alias("ends_sha256"))
