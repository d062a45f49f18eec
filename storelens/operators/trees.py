"""Regression trees without a depth limit, and regularised second-order boosting.

Features are cut into at most ``max_bins`` bins (every distinct value has its own where there are no more), so a
split is "bin <= b".  Both learners are Spark ML estimators over an assembled vector.

``DeepForest`` stores the rows once, in packed blocks; how often a row counts in a tree is worked out from its key where
it is needed.  While a node has more than ``finish_rows`` rows, tasks let the rows fall down what there is of the tree and
sum weight and target per (node, feature, bin); the sums of a node meet in one task and the driver sees its split: a level
per pass, some n / ``finish_rows`` splits a tree.  Then the rows of a few trees at a time are dealt out to the smaller
nodes, each of which is grown to its end in one task.  So no more than some ``DEALT_ROWS`` copies of rows (or one tree's)
are on disk at once.  The grown nodes are a stored table, a packed row per finished node; no task carries the model.

``SecondOrderBoosting`` grows one tree a round: each task sums gradients of its rows per (feature, node, bin), the
sums of a feature meet in one task, and the driver sees one split per (feature, node): rounds x 2^depth nodes in all.
"""

from __future__ import annotations

import json
import sys

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext, cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, release

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need the libraries, not this package

MAX_BINS = 256
FINISH_ROWS = 524_288  # rows of a task that grows a node to its end: some 300 bytes each at 57 features
BLOCK_ROWS = 8_192  # of a stored block, at most
DEAL_ROWS = 262_144  # rows of a task that deals out rows or sums them up, about
DEALT_ROWS = 16_777_216  # rows that are dealt out to trees at a time, at some 25 bytes each: bounds the disk of a fit
LEAST_TASKS = 8  # that deal rows out, if there are as many blocks
MOST_TASKS = 4_096  # that grow nodes to their end
TASK_ROWS = 65_536  # rows of a boosting task; the many small steps cost more to start than to run
TREE_LEVEL = 9  # of compression of grown trees
CHUNK_ROWS = 500_000  # rows that go through one copy of a stored subtree, on average
# Cumulative probabilities of the Poisson distribution with mean 1, for the number of copies of a row.
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975]


# ---------------------------------------------------------------- bins

def cut_points(df: DataFrame, vec: str, max_bins: int = MAX_BINS) -> list[list[float]]:
    """Per feature the least values of its bins but the first, ascending.

    A feature of at most ``max_bins`` distinct values has a bin for each; others are cut at approximate quantiles.
    The driver sees at most 2 x ``max_bins`` numbers per feature.  A task sketches some ``TASK_ROWS`` rows: the sketch
    of few rows is as large as their values.
    """
    df = df.coalesce(max(LEAST_TASKS, 1 + df.count() // TASK_ROWS))
    width = len(df.select(vector_to_array(vec).alias("x")).first()["x"])
    values = df.select(F.posexplode(vector_to_array(vec)).alias("feature", "v"))
    share = [i / max_bins for i in range(1, max_bins)]
    found = (values.groupBy("feature")
             .agg(F.approx_count_distinct("v", 0.02).alias("distinct"), F.min("v").alias("least")).collect())
    few = [r["feature"] for r in found if r["distinct"] <= 2 * max_bins]
    exact = {r["feature"]: r["v"] for r in values.filter(F.col("feature").isin(few)).groupBy("feature")
             .agg(F.sort_array(F.collect_set("v")).alias("v")).collect()}
    exact = {f: own for f, own in exact.items() if len(own) <= max_bins}
    # Only of the others: the sketch of a feature with two values is as large as any.
    others = [r["feature"] for r in found if r["feature"] not in exact]
    sketched = {r["feature"]: r["cuts"] for r in values.filter(F.col("feature").isin(others)).groupBy("feature")
                .agg(F.percentile_approx("v", share, 20 * max_bins).alias("cuts")).collect()}
    cuts: list[list[float]] = [[] for _ in range(width)]
    for r in found:
        own = exact.get(r["feature"])
        own = own[1:] if own else [c for c in sorted(set(sketched[r["feature"]])) if c > r["least"]]
        cuts[r["feature"]] = [float(c) for c in own]
    return cuts


def bins_of(vec: str, cuts: list[list[float]]) -> Column:
    """The bins of a vector as ``array<smallint>``: the number of cuts up to the value (binary search in Arrow batches)."""
    points = [np.asarray(c) for c in cuts]

    @F.pandas_udf("array<smallint>")
    def search(x):
        m = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(points)))
        out = np.stack([np.searchsorted(c, m[:, j], side="right") for j, c in enumerate(points)], axis=1)
        return type(x)(list(out.astype(np.int16)))

    return search(vector_to_array(vec))


def _matrix(table: pa.Table, name: str = "bins") -> np.ndarray:
    held = table.column(name).combine_chunks()
    flat = (held.chunk(0) if isinstance(held, pa.ChunkedArray) else held).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


# ---------------------------------------------------------------- one node's subtree, in a task

def _best_of_few(k, node, w, wy, total_w, total_s, min_leaf):
    """Gain of the split of a feature with two bins for each of ``k`` nodes (-inf: none).  The arguments ``node``, ``w``
    and ``wy`` are of the rows in its second bin."""
    rw = np.bincount(node, w, k)
    lw = total_w - rw
    at = np.flatnonzero((lw >= min_leaf) & (rw >= min_leaf) & (lw > 0.5) & (rw > 0.5))
    gain = np.full(k, -np.inf)
    if len(at):
        rs = np.bincount(node, wy, k)[at]
        gain[at] = (total_s[at] - rs) ** 2 / lw[at] + rs ** 2 / rw[at]
    return gain


def _best_of_many(bins, inner, node, sums, total_w, total_s, before, min_leaf):
    """Nodes with a split by one feature, the best gain of each and its bin.

    All rows come in the order of (node, bin); ``inner`` is false for the last row of each node.  ``sums`` are running
    sums over the rows, ``before`` those ahead of each node: weights, and targets as the imaginary part.
    """
    last = np.flatnonzero((bins[1:] != bins[:-1]) & inner)  # last row of each bin but the node's last bin
    n = node[last]
    upto = sums[last] - before[n]
    lw, ls = upto.real, upto.imag
    rw = total_w[n] - lw
    if min_leaf > 1:
        ok = np.flatnonzero((lw >= min_leaf) & (rw >= min_leaf))
        last, n, lw, ls, rw = last[ok], n[ok], lw[ok], ls[ok], rw[ok]
    if not len(n):
        return n, ls, n
    rs = total_s[n] - ls
    g = ls * ls / lw + rs * rs / rw
    start = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
    top = np.maximum.reduceat(g, start)
    hit = np.flatnonzero(g == np.repeat(top, np.diff(np.r_[start, len(n)])))
    first = hit[np.flatnonzero(np.r_[True, n[hit][1:] != n[hit][:-1]])]
    return n[first], g[first], bins[last[first]]


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where rows that go left and right come to stand, each in order, if nodes 2i and 2i + 1 have ``sizes`` rows."""
    at = sizes.cumsum() - sizes
    out = []
    for half, start in ((sizes[0::2], at[0::2]), (sizes[1::2], at[1::2])):
        out.append(np.arange(int(half.sum())) + np.repeat(start - (half.cumsum() - half), half))
    return out[0], out[1]


def grow_whole(x: np.ndarray, y: np.ndarray, w: np.ndarray, widths: list[int], min_split: float = 2,
               min_leaf: float = 1) -> dict[str, np.ndarray]:
    """A tree over whole rows, a level at a time, until nodes are pure or cannot be split.

    Ties go to the lower feature and bin.  Returns arrays ``feature`` (-1: leaf), ``bin`` (rows up to it go left),
    ``left``, ``right``, ``value`` and ``weight``; node 0 is the root.  The rows of a feature of more than two bins are
    sorted once; each level deals them out to the nodes below in place, which keeps them in the order of (node, bin).
    """
    y, w = y.astype(float), w.astype(float)
    shift = float(np.average(y, weights=w))  # sums of small numbers: less rounding in the gains
    wy = w * (y - shift)
    both = w + 1j * wy
    feature, cut, left, right, value, weight = [], [], [], [], [], []
    columns = {j: np.ascontiguousarray(x[:, j]) for j, width in enumerate(widths) if width > 1}
    rows, sizes, first = np.arange(len(y), dtype=np.int32), np.array([len(y)]), 0  # the open nodes' rows, node by node
    node_of = np.zeros(len(y), dtype=np.int32)
    orders = {j: np.argsort(c, kind="stable").astype(np.int32) for j, c in columns.items() if widths[j] > 2}
    second = {j: np.flatnonzero(c).astype(np.int32) for j, c in columns.items() if widths[j] == 2}  # rows in the second bin
    node = np.zeros(len(y), dtype=np.int32)
    while len(sizes):
        k = len(sizes)
        tw, ts = np.bincount(node, w[rows], k), np.bincount(node, wy[rows], k)
        value.append(np.bincount(node, w[rows] * y[rows], k) / tw), weight.append(tw)
        yy, start = y[rows], sizes.cumsum() - sizes
        open_ = (np.maximum.reduceat(yy, start) > np.minimum.reduceat(yy, start)) & (tw >= min_split)
        # Rows of leaves go, the others are dealt to their nodes.
        live = open_[node]
        side = np.full(len(y), 2, np.int8)
        side[rows[live]] = node[live] & 1
        if first:
            to_l, to_r = _places(np.where(open_, sizes, 0))

            def dealt(order):
                s, out = side[order], np.empty(len(to_l) + len(to_r), np.int32)
                out[to_l], out[to_r] = order[s == 0], order[s == 1]
                return out
        else:
            def dealt(order):
                return order if live.all() else order[:0]

        rows, node = rows[live], node[live]
        orders = {j: dealt(o) for j, o in orders.items()}
        second = {j: o[side[o] < 2] for j, o in second.items()}
        f_at, b_at, best = np.full(k, -1), np.full(k, -1), np.full(k, -1.0)  # gains are sums of squares
        if len(rows):
            inner = node[1:] == node[:-1]
            ends = np.flatnonzero(np.r_[~inner, True])
            before = np.zeros(k, complex)
            for j, column in columns.items():
                if j in second:
                    if not len(second[j]):
                        continue
                    o = second[j]
                    gain = _best_of_few(k, node_of[o], w[o], wy[o], tw, ts, min_leaf)
                    ids = np.flatnonzero(gain > -np.inf)
                    g, b = gain[ids], np.zeros(len(ids), np.int64)
                else:
                    o = orders[j]
                    sums = both[o].cumsum()
                    before[node[ends[1:]]] = sums[ends[:-1]]
                    ids, g, b = _best_of_many(column[o], inner, node, sums, tw, ts, before, min_leaf)
                better = g > best[ids] + 1e-9 * np.abs(best[ids])
                ids = ids[better]
                best[ids], f_at[ids], b_at[ids] = g[better], j, b[better]
        split = f_at >= 0
        number = np.cumsum(split) - 1
        child = first + k + 2 * number
        feature.append(f_at), cut.append(b_at)
        left.append(np.where(split, child, -1)), right.append(np.where(split, child + 1, -1))
        stay = split[node]
        rows, node = rows[stay], node[stay]
        node = (2 * number[node] + (x[rows, f_at[node]] > b_at[node])).astype(np.int32)
        sizes = np.bincount(node, minlength=2 * int(split.sum()))
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        node_of[rows] = node
        first += k
    out = {"feature": feature, "bin": cut, "left": left, "right": right, "value": value, "weight": weight}
    return {name: np.concatenate(parts) for name, parts in out.items()}


def ends(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf in which each row of bins ends."""
    at = np.zeros(len(x), dtype=np.int64)
    go = np.arange(len(x))
    while True:
        f = tree["feature"][at[go]]
        inside = f >= 0
        go, f = go[inside], f[inside]
        if not len(go):
            return at
        a = at[go]
        at[go] = np.where(x[go, f] <= tree["bin"][a], tree["left"][a], tree["right"][a])


def walk(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf value of each row of bins."""
    return tree["value"][ends(tree, x)]


# ---------------------------------------------------------------- models that can be stored

class _TableWriter(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path):
        DefaultParamsWriter.saveMetadata(self.model, path, self.sc, extraMetadata={"fitted": json.dumps(self.model.plain())})
        for name, table in self.model.tables().items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        meta = DefaultParamsReader.loadMetadata(path, self.sc)
        return self.cls.restore(json.loads(meta["fitted"]), lambda name: self.sparkSession.read.parquet(f"{path}/{name}"))


class _TableModel(Model, MLWritable, MLReadable):
    """A fitted ensemble: a few numbers (``plain``) and tables (``tables``)."""

    def write(self):
        return _TableWriter(self)

    def save(self, path):
        self.write().save(path)

    @classmethod
    def read(cls):
        return _TableReader(cls)

    @classmethod
    def load(cls, path):
        return cls.read().load(path)

    def copy(self, extra=None):
        return self  # has no parameters that a copy could change

    def tables(self) -> dict[str, DataFrame]:
        return {}


# ---------------------------------------------------------------- forest

# A finished node: the arrays of ``grow_whole``, packed.  Whether a node splits is a bit; the children of the splits follow
# each other, so they need no numbers; the value and weight of a split follow from those of its leaves.
PACKED_SCHEMA = "tree int, node string, size int, split binary, feature binary, bin binary, value binary, weight binary"
NODE_SCHEMA = ("node string, feature array<int>, bin array<int>, left array<int>, right array<int>, "
               "value array<double>, weight array<double>")
NODE_TYPES = {"feature": np.int32, "bin": np.int32, "left": np.int32, "right": np.int32, "value": float, "weight": float}


def _kind(widths: list[int]) -> type:
    """The number type of bins in a block."""
    return np.uint8 if max(widths, default=0) <= 256 else np.int16


def _squeezed(values: np.ndarray, kind: type, codec: str = "zstd") -> bytes:
    return pa.compress(np.ascontiguousarray(values, kind).tobytes(), codec=codec, asbytes=True)


def _swollen(data: bytes, kind: type, n: int, lines: int = 1, codec: str = "zstd") -> np.ndarray:
    """``_squeezed`` values, in lines of ``n``."""
    return np.frombuffer(pa.decompress(data, lines * n * np.dtype(kind).itemsize, codec=codec), kind).reshape(lines, n)


def _coded(values: np.ndarray) -> bytes:
    """Values as a list of the distinct ones and places in it, unless most are distinct."""
    listed, place = np.unique(values, return_inverse=True)
    if len(listed) > len(values) // 8:
        listed, place = values, values[:0]
    kind = np.min_scalar_type(len(listed))
    plain = listed.astype(float).tobytes() + place.astype(kind).tobytes()
    return len(listed).to_bytes(8, "little") + bytes([kind.itemsize]) + pa.Codec("zstd", TREE_LEVEL).compress(plain, asbytes=True)


def _decoded(data: bytes, n: int) -> np.ndarray:
    k, size = int.from_bytes(data[:8], "little"), data[8]
    plain = pa.decompress(data[9:], 8 * k + (0 if k == n else size * n), codec="zstd")
    listed = np.frombuffer(plain, float, k)
    return listed if k == n else listed[np.frombuffer(plain, f"u{size}", n, 8 * k)]


def _pack_tree(t: dict[str, np.ndarray]) -> tuple:
    split = t["feature"] >= 0
    return (len(split), _squeezed(np.packbits(split), np.uint8), *[_coded(t[c][split]) for c in ("feature", "bin")],
            *[_coded(t[c][~split]) for c in ("value", "weight")])


def _unpack_tree(row, whole: bool = False) -> dict[str, np.ndarray]:
    """The arrays of a finished node; value and weight of the splits only if ``whole``."""
    size, split, feature, cut, value, weight = row
    on = np.unpackbits(_swollen(split, np.uint8, (size + 7) // 8)[0], count=size).astype(bool)
    inner = int(on.sum())
    t = {c: np.full(size, -1, np.int32) for c in ("feature", "bin", "left", "right")}
    t["feature"][on], t["bin"][on] = _decoded(feature, inner), _decoded(cut, inner)
    t["left"][on] = 1 + 2 * np.arange(inner)
    t["right"][on] = 2 + 2 * np.arange(inner)
    t["value"], t["weight"] = np.zeros(size), np.zeros(size)
    t["value"][~on] = _decoded(value, size - inner)
    if not whole:
        return t
    t["weight"][~on] = _decoded(weight, size - inner)
    levels, at, k = [], 0, 1
    while k:  # nodes are in the order of their levels
        levels.append(at + np.flatnonzero(on[at:at + k]))
        at, k = at + k, 2 * len(levels[-1])
    for up in reversed(levels):
        a, b = t["left"][up], t["right"][up]
        t["weight"][up] = t["weight"][a] + t["weight"][b]
        t["value"][up] = (t["weight"][a] * t["value"][a] + t["weight"][b] * t["value"][b]) / t["weight"][up]
    return t


ROWS_SCHEMA = "n int, key binary, y binary, bins binary"  # a block of rows, the bins feature by feature


def _packer(kind: type):
    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = pa.Table.from_batches([batch.slice(at, BLOCK_ROWS)])
                held = [_squeezed(part.column("key").to_numpy(), np.int64), _squeezed(part.column("y").to_numpy(), float),
                        _squeezed(_matrix(part).T, kind)]
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), *[pa.array([v], pa.binary()) for v in held]],
                                                 names=["n", "key", "y", "bins"])
    return pack


def _chunks(rows, kind: type, width: int):
    """Key, target and bins (a line per feature) of blocks, about ``DEAL_ROWS`` rows at a time."""
    held, size = [], 0

    def joined():
        return [np.concatenate([h[i] for h in held], axis=1) for i in range(3)]

    for row in rows:
        n = row["n"]
        held.append((_swollen(row["key"], np.uint64, n), _swollen(row["y"], float, n),
                     _swollen(row["bins"], kind, n, lines=width)))
        size += n
        if size >= DEAL_ROWS:
            key, y, x = joined()
            held, size = [], 0
            yield key[0], y[0], x
    if held:
        key, y, x = joined()
        yield key[0], y[0], x


# The constants of 64-bit xxHash.
XX = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def _copies(key: np.ndarray, tree: int) -> np.ndarray:
    """How often rows count in a tree: a Poisson draw by ``xxhash64`` of (what ``key`` is the ``xxhash64`` of, the tree)."""
    p1, p2, p3, p5 = XX
    h = (key + np.uint64(p5 + 4)) ^ np.uint64(tree * p1 % (1 << 64))
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * np.uint64(p2) + np.uint64(p3)
    h ^= h >> np.uint64(33)
    h *= np.uint64(p2)
    h ^= h >> np.uint64(29)
    h *= np.uint64(p3)
    h ^= h >> np.uint64(32)
    return np.searchsorted(np.asarray(POISSON), (h & np.uint64(0xFFFFFFFF)) / float(1 << 32), side="right").astype(np.uint8)


class _Top:
    """The upper part of a tree, as far as its nodes are too large for a task."""

    def __init__(self, tree: int):
        self.names, self.lists = [str(tree)], {"feature": [-1], "bin": [-1], "left": [-1], "right": [-1]}

    def split(self, at: int, feature: int, cut: int) -> tuple[int, int]:
        """Splits a leaf; the numbers of the leaves below."""
        below = len(self.names), len(self.names) + 1
        for c, v in zip(("feature", "bin", "left", "right"), (feature, cut, *below)):
            self.lists[c][at] = v
            self.lists[c] += [-1, -1]
        self.names += [self.names[at] + "L", self.names[at] + "R"]
        return below

    def splits(self) -> list[tuple]:
        """(node, feature, bin) of each split, parents first."""
        return [(n, f, b) for n, f, b in zip(self.names, self.lists["feature"], self.lists["bin"]) if f >= 0]

    def arrays(self) -> dict[str, np.ndarray]:
        return {c: np.asarray(v, np.int32) for c, v in self.lists.items()}

    def leaves(self) -> list[int]:
        return [i for i, f in enumerate(self.lists["feature"]) if f < 0]

    @classmethod
    def of(cls, tree: int, splits: list) -> "_Top":
        top = cls(tree)
        number = {top.names[0]: 0}
        for node, feature, cut in splits:
            for i in top.split(number[node], feature, cut):
                number[top.names[i]] = i
        return top


class DeepForest(Estimator):
    """Bagged regression trees, all features at each split, no depth limit.

    A row counts in a tree as often as a Poisson draw by (``keyCols``, tree, seed) says, so the forest depends on
    neither partitions nor session.  ``min_split`` and ``min_leaf`` count such copies.
    """

    def __init__(self, featuresCol: str, labelCol: str, predictionCol: str, key_cols, trees: int = 100, seed: int = 42,
                 min_split: int = 2, min_leaf: int = 1, max_bins: int = MAX_BINS, finish_rows: int = FINISH_ROWS,
                 dealt_rows: int = DEALT_ROWS):
        super().__init__()
        self.args = dict(vec=featuresCol, label=labelCol, out=predictionCol)
        self.key_cols, self.trees, self.seed = list(key_cols), trees, seed
        self.min_split, self.min_leaf, self.max_bins = min_split, min_leaf, max_bins
        self.finish_rows, self.dealt_rows = finish_rows, dealt_rows

    def copy(self, extra=None):
        return self

    def _fit(self, df: DataFrame) -> "DeepForestModel":
        vec, spark = self.args["vec"], df.sparkSession
        df = df.filter(F.col(self.args["label"]).isNotNull())
        cuts = cut_points(df, vec, self.max_bins)
        widths = [len(c) + 1 for c in cuts]
        rows = df.select(F.xxhash64(F.xxhash64(*self.key_cols, F.lit(self.seed))).alias("key"),
                         F.col(self.args["label"]).cast("double").alias("y"), bins_of(vec, cuts).alias("bins"))
        base = materialize(rows.mapInArrow(_packer(_kind(widths)), ROWS_SCHEMA))
        n = base.agg(F.sum("n")).first()[0]
        blocks = base.coalesce(max(LEAST_TASKS, 1 + n // DEAL_ROWS)).rdd
        at_once = max(1, min(self.trees, self.dealt_rows // n))
        parts, tops, levels = [], [], 0
        for first in range(0, self.trees, at_once):
            top = {t: _Top(t) for t in range(first, min(first + at_once, self.trees))}
            small, flat, passes = self._top_levels(blocks, top, n, widths)
            trees = self._finish(blocks, top, small, widths)
            grown = spark.createDataFrame(trees, PACKED_SCHEMA)
            if flat:
                grown = grown.unionByName(spark.createDataFrame(flat, PACKED_SCHEMA))
            parts.append((min(top), max(top), materialize(grown)))
            tops += [s for t in top.values() for s in t.splits()]
            levels = max(levels, passes)
            _drop_shuffles(trees)
        return DeepForestModel({**self.args, "trees": self.trees, "levels": levels, "cuts": cuts, "top": tops}, parts)

    def _top_levels(self, blocks: RDD, top: dict[int, _Top], n: int, widths: list[int]) -> tuple[list, list, int]:
        """Splits what has more than ``finish_rows`` rows, a level per pass.

        Returns (rows, tree, leaf) of the leaves to be grown on, the stored rows of those that cannot be split, and
        the number of levels.
        """
        small, flat, levels = [], [], 0
        large = {(t, 0): n for t in top}  # a root has at most so many rows
        if n <= self.finish_rows:
            return [(rows, *at) for at, rows in large.items()], flat, levels
        while large:
            below, split = {}, False
            for (t, at), (rows, w, s, feature, cut, left) in self._splits(blocks, top, sorted(large), widths):
                if rows <= self.finish_rows:
                    small.append((rows, t, at))
                elif feature < 0:  # equal rows or equal targets: one leaf
                    leaf = {c: np.array([-1]) for c in ("feature", "bin", "left", "right")}
                    flat.append((t, top[t].names[at], *_pack_tree({**leaf, "value": np.array([s / w]), "weight": np.array([w])})))
                else:
                    split = True
                    for i, size in zip(top[t].split(at, feature, cut), (left, rows - left)):
                        if size > self.finish_rows:
                            below[t, i] = size
                        else:
                            small.append((size, t, i))
            large, levels = below, levels + split
        return small, flat, levels

    def _splits(self, blocks: RDD, top: dict[int, _Top], nodes: list[tuple[int, int]], widths: list[int]) -> list:
        """((tree, leaf), (rows, weight, sum, feature, bin, rows on the left)) of leaves: their best splits, feature -1
        where there is none.  Ties go to the lower feature and bin."""
        kind, first, least, min_split = _kind(widths), np.cumsum([0, *widths]), max(self.min_leaf, 1), self.min_split
        arrays, wanted = {}, {}
        for t, at in nodes:
            if t not in arrays:
                arrays[t], wanted[t] = top[t].arrays(), np.full(len(top[t].names), -1)
            wanted[t][at] = at

        def part(rows):
            """Rows, weight and weighted target of each node per (feature, bin), added up in the task."""
            held = {}
            for key, y, x in _chunks(rows, kind, len(widths)):
                for t, tree in arrays.items():
                    copies = _copies(key, t)
                    on = np.flatnonzero(copies)
                    ids = wanted[t][ends(tree, x.T[on])] if len(tree["feature"]) > 1 else np.zeros(len(on), np.int64)
                    open_, which = np.unique(ids, return_inverse=True)
                    skip = int(len(open_) > 0 and open_[0] < 0)  # rows that ended in nodes that are not asked for
                    if skip:
                        stay = which > 0
                        on, open_, which = on[stay], open_[1:], which[stay] - 1
                    k = len(open_)
                    if not k:
                        continue
                    w = copies[on].astype(float)
                    wy, sums = w * y[on], np.empty((k, 3, first[-1]))
                    for j, width in enumerate(widths):
                        cell = which * width + x[j, on]
                        for i, v in enumerate((None, w, wy)):
                            sums[:, i, first[j]:first[j + 1]] = np.bincount(cell, v, k * width).reshape(k, width)
                    for at, v in zip(open_.tolist(), sums):
                        if (t, at) in held:
                            held[t, at] += v
                        else:
                            held[t, at] = v
            return list(held.items())

        def choose(item):
            (rows, w, s), best = item[1], (0.0, -1, -1, 0)
            for j, width in enumerate(widths):
                here = slice(first[j], first[j + 1])
                lw, ls = w[here].cumsum(), s[here].cumsum()
                tw, ts = lw[-1], ls[-1]
                lw, ls = lw[:-1], ls[:-1]
                rw, rs = tw - lw, ts - ls
                ok = np.flatnonzero((lw >= least) & (rw >= least)) if tw >= min_split else np.zeros(0, int)
                if len(ok):
                    gain = ls[ok] * ls[ok] / lw[ok] + rs[ok] * rs[ok] / rw[ok] - ts * ts / tw
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), j, int(ok[i]), int(rows[here][:ok[i] + 1].sum()))
            root = slice(0, first[1])
            return item[0], (int(rows[root].sum()), float(w[root].sum()), float(s[root].sum()), *best[1:])

        found = blocks.mapPartitions(part).reduceByKey(np.add, min(len(nodes), blocks.getNumPartitions())).map(choose)
        out = sorted(found.collect())
        _drop_shuffles(found)
        return out

    def _finish(self, blocks: RDD, top: dict[int, _Top], small: list, widths: list[int]) -> RDD:
        """Subtrees of leaves with at most ``finish_rows`` rows, a leaf in a task; the largest start first."""
        kind, width, min_split, min_leaf = _kind(widths), len(widths), self.min_split, max(self.min_leaf, 1)
        order = sorted(small, key=lambda s: (-s[0], *s[1:]))
        arrays = {t: tree.arrays() for t, tree in top.items()}
        slots = {t: np.full(len(tree.names), -1) for t, tree in top.items()}
        for i, (_, t, at) in enumerate(order):
            slots[t][at] = i
        names = [(t, top[t].names[at]) for _, t, at in order]

        def deal(rows):
            for key, y, x in _chunks(rows, kind, width):
                for t, tree in arrays.items():
                    copies = _copies(key, t)
                    on = np.flatnonzero(copies)
                    slot = slots[t][ends(tree, x.T[on])] if len(tree["feature"]) > 1 else np.full(len(on), slots[t][0])
                    for i in np.unique(slot[slot >= 0]).tolist():
                        at = on[slot == i]
                        yield i, (len(at), _squeezed(y[at], float), _squeezed(copies[at], np.uint8), _squeezed(x[:, at], kind))

        def grow(items):
            held: dict[int, list] = {}
            for i, piece in items:
                held.setdefault(i, []).append(piece)
            for i in list(held):
                pieces = held.pop(i)
                y, w, x = [np.concatenate([_swollen(p[c], k, p[0], lines=lines) for p in pieces], axis=1)
                           for c, k, lines in ((1, float, 1), (2, np.uint8, 1), (3, kind, width))]
                del pieces
                yield (*names[i], *_pack_tree(grow_whole(x.T, y[0], w[0], widths, min_split, min_leaf)))

        # As many tasks as nodes: a task that gets several takes longer than the others.
        return blocks.mapPartitions(deal).partitionBy(max(1, min(len(names), MOST_TASKS)), _itself).mapPartitions(grow)


def _itself(key: int) -> int:
    return key


def _drop_shuffles(rdd: RDD) -> None:
    """Deletes the shuffle files behind rows that are stored by now."""
    rdd._jrdd.rdd().cleanShuffleDependencies(True)


class DeepForestModel(_TableModel):
    """Mean over the trees of the leaf a row falls into; the rows meet each stored subtree in tasks.

    ``parts`` are (first tree, last tree, packed rows) of trees that were stored together.
    """

    def __init__(self, plain: dict, parts: list[tuple[int, int, DataFrame]]):
        super().__init__()
        self._plain, self.parts = plain, parts

    @property
    def packed(self) -> DataFrame:
        out = self.parts[0][2]
        for _, _, more in self.parts[1:]:
            out = out.unionByName(more)
        return out

    @property
    def nodes(self) -> DataFrame:
        """A row per finished node: the arrays of ``grow_whole``."""
        def unpack(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    t = _unpack_tree([row[c] for c in _PACKED], whole=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["node"]]), *[pa.ListArray.from_arrays(pa.array([0, len(t[c])], pa.int32()), pa.array(t[c].astype(k)))
                                                    for c, k in NODE_TYPES.items()]], names=["node", *NODE_TYPES])

        return self.packed.mapInArrow(unpack, NODE_SCHEMA)

    def plain(self):
        return self._plain

    def tables(self):
        return {"nodes": self.packed}

    @classmethod
    def restore(cls, plain, table):
        return cls(plain, [(0, plain["trees"] - 1, table("nodes"))])

    def _transform(self, df: DataFrame) -> DataFrame:
        p, spark = self._plain, df.sparkSession
        kind = _kind([len(c) + 1 for c in p["cuts"]])
        schema = T.StructType([*df.schema.fields, T.StructField(p["out"], T.DoubleType())])
        held = materialize(df.withColumn("_bins", bins_of(p["vec"], p["cuts"])).mapInArrow(
            _holder(kind), "id long, n int, bins binary, rows binary"))
        n = held.agg(F.sum("n")).first()[0]
        if not n:
            return df.withColumn(p["out"], F.lit(None).cast("double"))
        blocks = held.select("id", "n", "bins").coalesce(max(LEAST_TASKS, 1 + n // DEAL_ROWS)).rdd
        splits: dict[int, list] = {}
        for node, feature, cut in p["top"]:
            splits.setdefault(int(node.rstrip("LR")), []).append((node, feature, cut))
        at_once = max(1, DEALT_ROWS // n)
        total, seen = None, 0
        for begin, end, part in self.parts:
            for first in range(begin, end + 1, at_once):
                last = min(first + at_once - 1, end)
                trees = part.filter(F.col("tree").between(first, last))
                seen += trees.select("tree").distinct().count()  # a tree without rows has no nodes
                tops = {t: _Top.of(t, splits.get(t, [])) for t in range(first, last + 1)}
                sums = self._sums(blocks, trees, tops, n, kind, total)
                total = materialize(spark.createDataFrame(sums, "id long, n int, p binary"))
                _drop_shuffles(sums)

        def attached(batches):
            for batch in batches:
                for rows, sums in zip(batch.column("rows"), batch.column("p")):
                    table = pa.ipc.open_stream(rows.as_buffer()).read_all()
                    mean = np.frombuffer(pa.decompress(sums.as_buffer(), 8 * len(table), codec="zstd")) / seen
                    yield from table.append_column(p["out"], pa.array(mean)).to_batches()

        return held.select("id", "rows").join(total, "id").select("rows", "p").mapInArrow(attached, schema)

    def _sums(self, blocks: RDD, trees: DataFrame, tops: dict[int, _Top], n: int, kind: type, total: DataFrame | None) -> RDD:
        """(block, sums over trees of the leaves its rows fall into), with ``total`` added."""
        width, chunks = len(self._plain["cuts"]), 1 + n // CHUNK_ROWS
        arrays, slots, number = {}, {}, {}
        for t, top in tops.items():
            arrays[t], slots[t] = top.arrays(), np.full(len(top.names), -1)
            for at in top.leaves():
                slots[t][at] = number[top.names[at]] = len(number)

        def rows_of(rows):
            for row in rows:
                chunk = hash((row["id"], chunks)) % chunks
                x = None
                for t, tree in arrays.items():
                    if len(tree["feature"]) == 1:  # all rows meet the root
                        yield int(slots[t][0]) * chunks + chunk, (row["id"], row["n"], row["n"], None, row["bins"])
                        continue
                    if x is None:
                        x = _swollen(row["bins"], kind, row["n"], lines=width)
                    slot = slots[t][ends(tree, x.T)]
                    for i in np.unique(slot).tolist():
                        at = np.flatnonzero(slot == i)
                        yield i * chunks + chunk, (row["id"], row["n"], len(at), at.astype(np.int16).tobytes(), _squeezed(x[:, at], kind))

        def nodes_of(rows):
            for row in rows:
                for chunk in range(chunks):
                    yield number[row["node"]] * chunks + chunk, tuple(row[c] for c in _PACKED)

        def fall(items):
            held: dict[int, list] = {}
            for i, piece in items:
                held.setdefault(i, [None, []])
                if len(piece) == len(_PACKED):
                    held[i][0] = piece
                else:
                    held[i][1].append(piece)
            for i in list(held):
                stored, pieces = held.pop(i)
                if stored is None:
                    continue
                tree = _unpack_tree(stored)
                for block, size, count, at, bins in pieces:
                    yield block, (size, at, _squeezed(walk(tree, _swollen(bins, kind, count, lines=width).T), float))

        def add(items):
            sums: dict[int, np.ndarray] = {}
            for block, (size, at, values) in items:
                if block not in sums:
                    sums[block] = np.zeros(size)
                if at is None:
                    sums[block] += _swollen(values, float, size)[0]
                else:
                    on = np.frombuffer(at, np.int16)
                    sums[block][on] += _swollen(values, float, len(on))[0]
            for block, v in sums.items():
                yield block, len(v), _squeezed(v, float)

        tasks = max(1, min(len(number) * chunks, MOST_TASKS))
        met = blocks.mapPartitions(rows_of).union(trees.rdd.mapPartitions(nodes_of)).partitionBy(tasks, _itself)
        out = met.mapPartitions(fall)
        if total is not None:
            out = out.union(total.rdd.map(lambda r: (r["id"], (r["n"], None, r["p"]))))
        return out.partitionBy(max(1, blocks.getNumPartitions())).mapPartitions(add)


_PACKED = ["size", "split", "feature", "bin", "value", "weight"]


def _holder(kind: type):
    """Rows with bins to blocks: a number, the bins feature by feature, and the other columns as an Arrow stream."""
    def hold(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = pa.Table.from_batches([batch.slice(at, BLOCK_ROWS)])
                rest, sink = part.drop_columns(["_bins"]).combine_chunks(), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(rest)
                held = [_squeezed(_matrix(part, "_bins").T, kind), sink.getvalue().to_pybytes()]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(part)], pa.int32()),
                                                  *[pa.array([v], pa.binary()) for v in held]], names=["id", "n", "bins", "rows"])
                number += 1
    return hold


# ---------------------------------------------------------------- second-order boosting

def _heap_leaf(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Heap positions (root 1, children 2n and 2n + 1) in which rows end; ``feature`` is -1 where a node has no split."""
    at = np.ones(len(x), dtype=np.int64)
    while True:
        inside = np.flatnonzero(at < len(feature))
        go = inside[feature[at[inside]] >= 0]
        if not len(go):
            return at
        a = at[go]
        at[go] = 2 * a + (x[go, feature[a]] > cut[a])


class SecondOrderBoosting(Estimator):
    """Boosting on first and second derivatives of the squared error.

    A split's gain is half of GL²/(HL+lam) + GR²/(HR+lam) - G²/(H+lam), less ``gamma``; splits without a positive
    gain or with a side below ``min_child`` are not made.  A leaf adds -rate * G/(H+lam).  ``base_score`` None is
    the mean target.  Ties go to the lower feature and bin.
    """

    def __init__(self, featuresCol: str, labelCol: str, predictionCol: str, rounds: int = 100, depth: int = 6,
                 rate: float = 0.3, lam: float = 1.0, gamma: float = 0.0, min_child: float = 1.0,
                 base_score: float | None = None, max_bins: int = MAX_BINS, store_every: int = 10):
        super().__init__()
        self.args = dict(vec=featuresCol, label=labelCol, out=predictionCol)
        self.rounds, self.depth, self.rate, self.lam, self.gamma = rounds, depth, rate, lam, gamma
        self.min_child, self.base_score, self.max_bins, self.store_every = min_child, base_score, max_bins, store_every

    def copy(self, extra=None):
        return self

    def _fit(self, df: DataFrame) -> "BoostedModel":
        y = F.col(self.args["label"]).cast("double")
        df = df.filter(y.isNotNull())
        cuts = cut_points(df, self.args["vec"], self.max_bins)
        widths = [len(c) + 1 for c in cuts]
        seen = df.agg(F.avg(y).alias("mean"), F.count(F.lit(1)).alias("n")).first()
        base = float(seen["mean"]) if self.base_score is None else float(self.base_score)
        parts = 1 + seen["n"] // TASK_ROWS
        rows = df.select(y.alias("y"), bins_of(self.args["vec"], cuts).alias("bins"), F.lit(base).alias("p"))
        kind = _kind(widths)
        state = materialize(rows.coalesce(parts).mapInArrow(_blocks_of(kind), BLOCK_SCHEMA)).coalesce(parts)
        trees, recent = [], []
        for _ in range(self.rounds):
            if len(recent) == self.store_every:
                state, recent = materialize(_boosted(state, recent, kind, len(widths))).coalesce(parts), []
                release(df.sparkSession)
            tree = self._tree(state.rdd, recent, widths)
            trees.append(tree)
            recent.append(tree)
        plain = {**self.args, "base": base, "cuts": cuts,
                 "trees": [{c: v.tolist() for c, v in t.items()} for t in trees]}
        return BoostedModel(plain)

    def _tree(self, state: RDD, recent: list, widths: list[int]) -> dict[str, np.ndarray]:
        size = 2 ** (self.depth + 1)
        tree = {"feature": np.full(size, -1), "bin": np.full(size, -1), "value": np.zeros(size), "gain": np.zeros(size)}
        lam, rate = self.lam, self.rate
        for level in range(self.depth):
            if level and not (tree["feature"][2 ** (level - 1):2 ** level] >= 0).any():
                break
            best: dict[int, tuple] = {}
            for r in sorted(self._sums(state, recent, tree, level, widths), key=lambda r: r["feature"]):
                if r["node"] not in best or r["gain"] > best[r["node"]]["gain"]:
                    best[r["node"]] = r
            for n, r in best.items():
                if level == 0:
                    tree["value"][1] = -rate * (r["gl"] + r["gr"]) / (r["hl"] + r["hr"] + lam)
                if r["gain"] - self.gamma > 0:
                    tree["feature"][n], tree["bin"][n], tree["gain"][n] = r["feature"], r["bin"], r["gain"] - self.gamma
                    tree["value"][2 * n] = -rate * r["gl"] / (r["hl"] + lam)
                    tree["value"][2 * n + 1] = -rate * r["gr"] / (r["hr"] + lam)
        return tree

    def _sums(self, state: RDD, recent: list, tree: dict, level: int, widths: list[int]) -> list:
        """One row per (feature, node of the level): its best split and the sums on either side."""
        lam, min_child, first, k, kind = self.lam, self.min_child, 2 ** level, 2 ** level, _kind(widths)
        now = {c: tree[c].copy() for c in ("feature", "bin")}

        def part(rows):
            g_sum = [np.zeros(k * w) for w in widths]
            h_sum = [np.zeros(k * w) for w in widths]
            for row in rows:
                x, y, p = _unpacked(row, recent, kind, len(widths))
                at = _heap_leaf(x, now["feature"], now["bin"]) - first
                here = at >= 0  # rows that ended above stay there
                x, at, g = x[here], at[here], (p - y)[here]
                for j, w in enumerate(widths):
                    if w > 1:
                        key = at * w + x[:, j]
                        g_sum[j] += np.bincount(key, g, k * w)
                        h_sum[j] += np.bincount(key, minlength=k * w)
            return [(j, np.stack([g_sum[j], h_sum[j]])) for j, w in enumerate(widths) if w > 1]

        def choose(item):
            feature, (g, h) = item[0], item[1].reshape(2, k, -1)
            gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
            gt, ht = g.sum(1)[:, None], h.sum(1)[:, None]
            gr, hr = gt - gl, ht - hl
            ok = (hl >= min_child) & (hr >= min_child)
            gain = np.where(ok, 0.5 * (gl * gl / (hl + lam) + gr * gr / (hr + lam) - gt * gt / (ht + lam)), -np.inf)
            for n, b in enumerate(gain.argmax(1)):
                if gain[n, b] > -np.inf:
                    yield {"feature": feature, "node": n + first, "bin": int(b), "gain": float(gain[n, b]),
                           "gl": float(gl[n, b]), "hl": float(hl[n, b]), "gr": float(gr[n, b]), "hr": float(hr[n, b])}

        # Hundreds of small steps in a row: without planning, a step takes half as long as over frames.
        tasks = min(len(widths), state.getNumPartitions())
        return state.mapPartitions(part).reduceByKey(np.add, tasks).flatMap(choose).collect()


BLOCK_SCHEMA = "n int, bins binary, y binary, p binary"  # one row holds an Arrow batch of rows


def _block(n: int, bins: bytes, y: bytes, p: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array([v], pa.binary()) for v in (bins, y, np.ascontiguousarray(p, float).tobytes())]
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *cols], names=["n", "bins", "y", "p"])


def _blocks_of(kind: type):
    def packed(batches):
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                yield _block(len(table), _squeezed(_matrix(table).T, kind, "lz4"),
                             _squeezed(table.column("y").to_numpy(), float, "lz4"), table.column("p").to_numpy())
    return packed


def _unpacked(row, trees: list, kind: type, width: int):
    """Bins, targets and predictions of a block, the predictions with ``trees`` added."""
    n, p = row["n"], np.frombuffer(row["p"]).copy()
    x, y = _swollen(row["bins"], kind, n, width, "lz4").T, _swollen(row["y"], float, n, 1, "lz4")[0]
    for t in trees:
        p += t["value"][_heap_leaf(x, t["feature"], t["bin"])]
    return x, y, p


def _boosted(state: DataFrame, trees: list, kind: type, width: int) -> DataFrame:
    """``state`` with the trees added to the prediction ``p``."""
    def add(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _block(row["n"], row["bins"], row["y"], _unpacked(row, trees, kind, width)[2])

    return state.mapInArrow(add, BLOCK_SCHEMA)


class BoostedModel(_TableModel):
    """Base score plus the leaf values of the trees (at most rounds x 2^(depth + 1) numbers each)."""

    def __init__(self, plain: dict):
        super().__init__()
        self._plain = plain

    def plain(self):
        return self._plain

    @classmethod
    def restore(cls, plain, table):
        return cls(plain)

    def splits(self, names: list[str]) -> list[tuple]:
        """(round, node, feature, cut, gain, left value, right value) of every split; values from the cut up go right."""
        out = []
        for i, t in enumerate(self._plain["trees"]):
            for n, f in enumerate(t["feature"]):
                if f >= 0:
                    out.append((i, n, names[f], self._plain["cuts"][f][t["bin"][n]], t["gain"][n], t["value"][2 * n],
                                t["value"][2 * n + 1]))
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        p = self._plain
        trees = [{c: np.asarray(v) for c, v in t.items()} for t in p["trees"]]
        base = p["base"]

        @F.pandas_udf("double")
        def predict(bins):
            x = np.stack(bins.to_numpy()) if len(bins) else np.zeros((0, len(p["cuts"])), dtype=np.int16)
            out = np.full(len(x), base)
            for t in trees:
                out += t["value"][_heap_leaf(x, t["feature"], t["bin"])]
            return type(bins)(out)

        return df.withColumn(p["out"], predict(bins_of(p["vec"], p["cuts"])))
