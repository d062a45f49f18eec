"""MinHash near-dedup of word-shingle multisets with BagMinHash signatures.

Signatures.  A shingle with count c stands for the interval [0, c) of weights.
[0, 1), [1, 2), [2, 4), [4, 8), ... each carry a Poisson process of their own,
seeded by the shingle and the interval; every point has a time, a place inside
the interval and a register.  A document takes the points that lie below its
count, and a register holds the earliest point it gets; two documents agree in a
register with probability equal to their weighted Jaccard similarity.
Processes are drawn in order of time and end as soon as their next point is
later than every register's, so a document costs about m log m points and not
m per shingle.

Search.  Documents with the same words are one class.  Classes that agree in all
registers of a band meet in a bucket, and each is verified against the least of
the bucket (a star, so a bucket of any size is linear) by the exact overlap of
the shingle multisets.  A class that is not linked to the largest component of its
connected buckets may still be similar to another member: these stragglers are
compared with all members of those buckets, block by block, through an inverted
index of the rarest shingles, by exact overlaps and without a row per pair.  So
no link between texts that share a bucket is lost, and nothing is capped.

Defined results: null or empty text has no words; texts without words are one
class; a text of fewer than five words has one shingle, all its words; repeated
rows are copies of one another; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_on, store, text_or_empty
from .components import components
from .shingles import WORDS, counted, mix, shingle_hashes, slices

SIMILARITY = 0.8
BANDS = 32
ROWS = 4              # registers of a band: 0.8 ** 4, 32 times: a pair at 0.8 is missed once in 20 million
SLICE_BYTES = 1 << 18  # text that a worker takes at a time
BLOCK_CHARS = 1 << 20  # text of one block of the straggler search


def signatures(shingles: np.ndarray, owner: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """One row of ``registers`` float32 bit patterns per text (all equal for a text without shingles)."""
    element, doc, count = counted(shingles, owner)
    times = np.full((texts, registers), np.inf)
    flat = times.reshape(-1)
    # Weight intervals [0, 1), [1, 2), [2, 4), ... up to the count.
    levels = 1 + np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    at = np.repeat(np.arange(len(element)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    seed = mix(element[at] + np.uint64(0x9E3779B97F4A7C15) * (level + 1).astype(np.uint64))
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    size = np.maximum(low, 1)
    d, c, t = doc[at], count[at], np.zeros(len(at))
    step = 0
    while len(seed):
        x = mix(seed + np.uint64(step * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        t = t - np.log1p(-(x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53) / size
        live = t < times.max(axis=1)[d]
        seed, d, c, t, low, size, x = (v[live] for v in (seed, d, c, t, low, size, x))
        y = mix(x ^ np.uint64(0xA0761D6478BD642F))
        place = low + ((y & np.uint64(0xFFFFFFFF)).astype(np.int64) % size)
        ok = place < c
        register = ((y[ok] >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(flat, d[ok] * registers + register, t[ok])
        step += 1
    return times.astype(np.float32).view(np.uint32)


def _bands(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands))
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows][:, :bands].astype(np.uint64))
    return keys.view(np.int64)


def _sign(words: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                texts = [t.encode() for t in part.column(2).to_pylist()]
                shingles, owner, n, whole = shingle_hashes(texts, words)
                keys = _bands(signatures(shingles, owner, len(texts), bands * rows), bands, rows)
                offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(whole[0].view(np.int64)), pa.array(whole[1].view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[n > 0].reshape(-1)))],
                    names=["_id", "_tag", "_w1", "_w2", "_bands"])
    return sign


class _Overlap:
    """Shingle multisets of some texts, for exact overlaps."""

    def __init__(self, texts: list[str], words: int):
        parts, start = [], 0
        while start < len(texts):  # a few megabytes of text at a time
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= 2 << 20):
                size += len(texts[stop])
                stop += 1
            s, o, _, _ = shingle_hashes([t.encode() for t in texts[start:stop]], words)
            e, d, c = counted(s, o)
            parts.append((e, d + start, c))
            start = stop
        self.element, self.doc, self.count = (
            np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.uint64, int, int)))
        self.weight = np.bincount(self.doc, weights=self.count, minlength=len(texts))
        self.limits = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def pair(self, a: int, b: int) -> float:
        """Weighted Jaccard similarity of two of the texts."""
        ea, eb = (self.element[self.limits[i]:self.limits[i + 1]] for i in (a, b))
        ca, cb = (self.count[self.limits[i]:self.limits[i + 1]] for i in (a, b))
        if not len(ea) or not len(eb):
            return float(len(ea) == len(eb))
        at = np.minimum(np.searchsorted(eb, ea), len(eb) - 1)
        both = np.minimum(ca, cb[at])[eb[at] == ea].sum()
        return float(both / (self.weight[a] + self.weight[b] - both))


def _verify(words: int, similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                u, v = part.column(0).to_pylist(), part.column(1).to_pylist()
                texts: dict[int, str] = {}
                for rows, col in ((u, 2), (v, 3)):
                    texts.update(zip(rows, part.column(col).to_pylist()))
                place = {row: i for i, row in enumerate(texts)}
                sets = _Overlap(list(texts.values()), words)
                ok = [sets.pair(place[a], place[b]) >= similarity for a, b in zip(u, v)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, k in zip(u, ok) if k], pa.int64()),
                     pa.array([b for b, k in zip(v, ok) if k], pa.int64())], names=["u", "v"])
    return verify


class _Ranked:
    """Multisets with their shingles as ranks, rarest first, and the prefix of each that any similar set must share.

    If two sets are at least ``similarity`` alike, their overlap is at least
    that share of either's weight; so they have a shingle in common before the point
    where less than that share of the weight is left, in both.
    """

    def __init__(self, sets: _Overlap, rank: np.ndarray, similarity: float):
        order = np.lexsort((rank, sets.doc))
        self.rank, self.doc, self.count = rank[order], sets.doc[order], sets.count[order]
        self.weight, self.limits = sets.weight, sets.limits
        run = np.concatenate(([0], np.cumsum(self.count)))
        before = run[:-1] - run[self.limits[self.doc]]
        self.prefix = np.flatnonzero(self.weight[self.doc] - before >= similarity * self.weight[self.doc] - 1e-9)


def _expand(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within runs of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _chunks(costs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of items whose costs stay below ``most`` together (one item at least)."""
    ends, start = np.cumsum(costs), 0
    while start < len(costs):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


def _similar_pairs(m: _Overlap, p: _Overlap, mcomp: np.ndarray, pcomp: np.ndarray, similarity: float,
                   entries: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """All (probe, member) pairs of different components that are at least ``similarity`` alike."""
    distinct, number = np.unique(np.concatenate((m.element, p.element)), return_inverse=True)
    if not len(distinct) or not len(m.element) or not len(p.element):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rarest = np.lexsort((np.arange(len(distinct)), np.bincount(number)))
    rank = np.empty(len(distinct), np.int64)
    rank[rarest] = np.arange(len(distinct))
    members = _Ranked(m, rank[number[:len(m.element)]], similarity)
    probes = _Ranked(p, rank[number[len(m.element):]], similarity)
    n = len(m.weight)

    def postings(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the members at ``at`` by rank, and where each rank's begin."""
        by = at[np.argsort(members.rank[at], kind="stable")]
        return by, np.searchsorted(members.rank[by], np.arange(len(distinct) + 1))

    # 1. Candidates: pairs that share a shingle of both prefixes and whose sizes allow it.
    some, first = postings(members.prefix)
    at = probes.prefix
    size = first[probes.rank[at] + 1] - first[probes.rank[at]]
    pairs = []
    for a, b in _chunks(size, entries):
        k = size[a:b]
        j = members.doc[some[np.repeat(first[probes.rank[at[a:b]]], k) + _expand(k)]]
        i = np.repeat(probes.doc[at[a:b]], k)
        ok = (pcomp[i] != mcomp[j]) & (np.minimum(p.weight[i], m.weight[j]) >= similarity * np.maximum(p.weight[i], m.weight[j]) - 1e-9)
        pairs.append(np.unique(i[ok] * n + j[ok]))
    pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    if not len(pairs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    # 2. Exact overlaps: by look-up for a probe with few candidates, else through the whole index.
    every, first = postings(np.arange(len(members.rank)))
    full = first[probes.rank + 1] - first[probes.rank]
    index_cost = np.bincount(probes.doc, weights=full, minlength=len(p.weight))
    elements = np.diff(probes.limits)
    by_index = index_cost < 8 * np.bincount(pairs // n, minlength=len(p.weight)) * elements
    found_i, found_j = [], []

    def keep(i, j, both):
        close = both >= similarity * (p.weight[i] + m.weight[j] - both) - 1e-9
        found_i.append(i[close])
        found_j.append(j[close])

    keys = members.doc * len(distinct) + members.rank
    looked = pairs[~by_index[pairs // n]]
    for a, b in _chunks(elements[looked // n], entries):
        i, j = looked[a:b] // n, looked[a:b] % n
        k = elements[i]
        own = np.repeat(probes.limits[i], k) + _expand(k)
        want = np.repeat(j, k) * len(distinct) + probes.rank[own]
        where = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        both = np.where(keys[where] == want, np.minimum(members.count[where], probes.count[own]), 0)
        keep(i, j, np.bincount(np.repeat(np.arange(len(i)), k), weights=both, minlength=len(i)))
    indexed = pairs[by_index[pairs // n]]
    some = np.unique(indexed // n)
    for a, b in _chunks(index_cost[some] + n, entries):
        docs = some[a:b]
        k = elements[docs]
        own = np.repeat(probes.limits[docs], k) + _expand(k)
        row = np.repeat(np.arange(len(docs)), k)
        size = full[own]
        entry = every[np.repeat(first[probes.rank[own]], size) + _expand(size)]
        both = np.bincount(np.repeat(row, size) * n + members.doc[entry],
                           weights=np.minimum(np.repeat(probes.count[own], size), members.count[entry]), minlength=len(docs) * n)
        mine = indexed[(indexed // n >= docs[0]) & (indexed // n <= docs[-1])]
        i, j = mine // n, mine % n
        keep(i, j, both[np.searchsorted(docs, i) * n + j])
    return np.concatenate(found_i), np.concatenate(found_j)


def _search(words: int, similarity: float):
    """Links between probes and members of one block: (probe, least linked member) per component of the members."""
    import pandas as pd

    def search(members: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(probes):
            return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
        rows, comps = members["_row"].to_numpy(), members["_comp"].to_numpy()
        prow, pcomp = probes["_row"].to_numpy(), probes["_comp"].to_numpy()
        i, j = _similar_pairs(_Overlap(members["_text"].tolist(), words), _Overlap(probes["_text"].tolist(), words),
                              comps, pcomp, similarity)
        links = pd.DataFrame({"u": prow[i], "c": comps[j], "v": rows[j]})
        return links.groupby(["u", "c"], sort=False, as_index=False)["v"].min()[["u", "v"]].astype("int64")
    return search


def _classes(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS,
                 block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _tag, _best, _size, _kept`` of every row; ``_tag`` is the hash of its text."""
    # 1. Signatures, and one representative per word sequence.
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_tag"),
                       text_or_empty(text_col).alias("_text"))
    id_type = base.schema["_id"].dataType.simpleString()
    signed = store(base.mapInArrow(_sign(words, bands, rows),
                                   f"_id {id_type}, _tag long, _w1 long, _w2 long, _bands array<long>")
                   .withColumn("_row", F.monotonically_increasing_id()), "signatures")
    same = store(signed.groupBy("_w1", "_w2").agg(F.min("_row").alias("_rep")), "same-words")
    reps = signed.join(same.select(F.col("_rep").alias("_row")), "_row", "left_semi")

    # 2. Buckets of two or more, and the star of each.
    banded = reps.select("_row", "_id", "_tag", F.explode("_bands").alias("_key"))
    shared = store(banded.groupBy("_key").agg(F.min("_row").alias("_center"), F.count(F.lit(1)).alias("_n"))
                   .filter("_n > 1").select("_key", "_center"), "buckets")
    active = store(banded.join(shared, "_key").select("_row", "_center", "_id", "_tag").distinct(), "bucket-members")
    stars = active.filter("_row != _center").select(F.col("_row").alias("u"), F.col("_center").alias("v"))

    # 3. Texts of the classes in buckets, fetched once; stars verified by the exact overlap.
    wanted = store(active.select("_row", "_id", "_tag").distinct(), "wanted")
    # Always a merge join: the wanted keys grow with the data.
    texts = store(join_on(base, wanted.hint("merge"), ["_id", "_tag"]).select("_row", "_text"), "texts")
    if texts.count() > wanted.count():  # rows that repeat an id and its text
        texts = store(texts.dropDuplicates(["_row"]), "texts")
    pairs = stars.join(texts.withColumnsRenamed({"_row": "u", "_text": "_tu"}), "u") \
        .join(texts.withColumnsRenamed({"_row": "v", "_text": "_tv"}), "v").select("u", "v", "_tu", "_tv")
    links = store(pairs.mapInArrow(_verify(words, similarity), "u long, v long"), "links")

    # 4. Stragglers: members of connected buckets outside the largest component there.
    family = components(stars).withColumnsRenamed({"node": "_row", "root": "_family"})
    comp = components(links).withColumnsRenamed({"node": "_row", "root": "_comp"})
    placed = store(family.join(comp, "_row", "left").withColumn("_comp", F.coalesce("_comp", "_row")), "families")
    sizes = placed.groupBy("_family", "_comp").agg(F.count(F.lit(1)).alias("_n"))
    main = store(sizes.groupBy("_family").agg(F.max_by("_comp", F.struct("_n", "_comp")).alias("_main"),
                                              F.count(F.lit(1)).alias("_comps")).filter("_comps > 1")
                 .select("_family", "_main"), "main-components")
    mixed = store(placed.join(main, "_family").join(texts, "_row"), "mixed-families")
    more = _straggler_links(mixed, words, similarity, block_chars)

    # 5. Components of all links, and the least id of each.
    joined = store(links.unionByName(more), "all-links")
    root = components(joined).withColumnsRenamed({"node": "_rep", "root": "_root"})
    member = signed.join(same, ["_w1", "_w2"]).select("_id", "_tag", "_row", "_rep")
    classed = store(member.join(root, "_rep", "left").select("_id", "_tag", "_row", F.coalesce("_root", "_rep").alias("_root")),
                    "classes")
    best = store(classed.groupBy("_root").agg(
        F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("_b"),
        F.count(F.lit(1)).alias("_size")).select("_root", F.col("_b.id").alias("_best"), F.col("_b.row").alias("_best_row"),
                                                 "_size"), "class-heads")
    return classed.join(best, "_root").select(
        "_id", "_tag", "_best", "_size", (F.col("_row") == F.col("_best_row")).alias("_kept"))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
                 **options) -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, kept``.

    Documents linked by a chain of pairs of at least ``similarity`` are one
    class; ``class_id`` is its least id (null last), and that document (one row
    of it) stays.
    """
    return _classes(docs, similarity, id_col=id_col, text_col=text_col, **options).select(
        F.col("_id").alias(id_col), F.col("_best").alias("class_id"), F.col("_size").alias("class_size"),
        F.col("_kept").alias("kept"))


def _straggler_links(mixed: DataFrame, words: int, similarity: float, block_chars: int) -> DataFrame:
    """Links of stragglers to other components of their family, by blocks of about ``block_chars`` of text.

    Large families are cut into blocks of members and blocks of stragglers, every
    combination a group of its own; small families share blocks.
    """
    chars = F.length("_text")
    straggler = F.col("_comp") != F.col("_main")
    per = mixed.groupBy("_family", "_main").agg(F.sum(chars).alias("_m"), F.sum(F.when(straggler, chars)).alias("_p"))
    total = per.filter(F.col("_m") <= block_chars).agg(F.sum("_m")).first()[0] or 0
    bins = max(1, -(-total // block_chars))
    cut = lambda c: F.ceil(F.col(c) / block_chars).cast("long")
    big = F.col("_m") > block_chars
    per = store(per.select(
        "_family", F.when(big, F.col("_family")).otherwise(-1 - F.pmod(F.xxhash64("_family"), F.lit(bins))).alias("_group"),
        F.when(big, cut("_m")).otherwise(F.lit(1)).alias("_mb"), F.when(big, cut("_p")).otherwise(F.lit(1)).alias("_pb")),
        "family-blocks")
    rows = mixed.join(per, "_family")
    own = lambda n: F.pmod(F.xxhash64("_row"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = rows.select("_group", own("_mb").alias("_a"), every("_pb").alias("_b"), "_row", "_comp", "_text")
    probes = rows.filter(straggler).select("_group", every("_mb").alias("_a"), own("_pb").alias("_b"), "_row", "_comp", "_text")
    probes = probes.toDF("_group_p", "_a_p", "_b_p", "_row", "_comp", "_text")  # columns of its own, both sides being one table
    return members.groupBy("_group", "_a", "_b").cogroup(probes.groupBy("_group_p", "_a_p", "_b_p")).applyInPandas(
        _search(words, similarity), "u long, v long")


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
                     **options) -> DataFrame:
    """``docs`` with one document of each class, columns unchanged."""
    names = docs.columns
    stay = store(_classes(docs, similarity, id_col=id_col, text_col=text_col, **options).filter("_kept")
                 .select(F.col("_id").alias("_near_dedup_id"), F.col("_tag").alias("_near_dedup_tag")), "stay")
    keys = ["_near_dedup_id", "_near_dedup_tag"]  # beside the input's columns
    tagged = docs.withColumns(dict(zip(keys, (F.col(id_col), F.xxhash64(text_or_empty(text_col))))))
    kept = join_on(tagged, stay, keys)
    repeated = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return (kept if repeated.isEmpty() else kept.dropDuplicates(keys)).select(*names)
