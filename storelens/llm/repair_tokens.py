"""Token-id output with Re-Pair grammar compression per shard.

Documents are encoded in ascending id order and gathered into shards of about a
million ids.  In each shard, frequent pairs of neighbouring ids are replaced by
nonterminals again and again; a round counts all pairs of the shard and
replaces its most frequent ones together.  A file row holds one shard: the
rules, the length of every nonterminal's expansion, the remaining symbols and
the documents' lengths.  The expansion lengths give the place of any id without
expanding what comes before it (``decode_range``).  Pairs never start with the
end id, so no symbol reaches into a second document.

Defined results: null text is the empty text, whose only id is the end id; rows
with one id are in the order of their texts; null ids come first; an empty table
gives files without rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty
from .shingles import slices
from .tokens import encoder

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SHARD_IDS = 1 << 20
ROUNDS = 8
PAIRS_PER_ROUND = 1024
MIN_COUNT = 16
CACHE_CHUNKS = 600_000   # of the tokenizer; no other state of a size is kept beside it

FILE_SCHEMA = ("part long, shard long, first_symbol long, rule_left array<int>, rule_right array<int>, "
               "expansion array<int>, symbol_bytes int, symbols binary, documents binary, lengths binary, n_tokens long")


def compress(ids: np.ndarray, first: int, end_id: int = END_ID, rounds: int = ROUNDS,
             pairs_per_round: int = PAIRS_PER_ROUND, min_count: int = MIN_COUNT):
    """Symbols, left and right of every rule, and the length of every rule's expansion; rule r is the symbol first + r."""
    s = ids.astype(np.uint32)
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    length = np.zeros(0, np.int64)
    closed = np.zeros(first, bool)   # symbols whose expansion ends with the end id
    if end_id < first:
        closed[end_id] = True
    top = first
    for _ in range(rounds):
        if len(s) < 2:
            break
        wide = np.uint32 if top <= 1 << 16 else np.uint64  # a pair as one number
        shift = wide(16 if top <= 1 << 16 else 32)
        ordered = s[:-1].astype(wide)
        ordered <<= shift
        ordered |= s[1:]
        ordered.sort()
        # Only pairs that are there ``min_count`` times: equal to the one as many places on.
        starts = np.flatnonzero(ordered[min_count - 1:] == ordered[:len(ordered) - min_count + 1]) if len(ordered) >= min_count \
            else np.zeros(0, np.int64)
        pairs, counts = np.unique(ordered[starts], return_counts=True)
        often = np.flatnonzero(~closed[pairs >> shift])  # no pair starts with the end of a document
        if len(often) > pairs_per_round:
            often = often[np.argpartition(-counts[often], pairs_per_round)[:pairs_per_round]]
        if not len(often):
            break
        chosen = pairs[often]
        left, right = (chosen >> shift).astype(np.int64), (chosen & ((wide(1) << shift) - wide(1))).astype(np.int64)
        # A small table of (left, right) finds the pairs of the round in two look-ups per position.
        dl, row = np.unique(left, return_inverse=True)
        dr, col = np.unique(right, return_inverse=True)
        at_l, at_r = np.zeros(top, np.int32), np.zeros(top, np.int32)
        at_l[dl], at_r[dr] = np.arange(1, len(dl) + 1), np.arange(1, len(dr) + 1)
        table = np.full((len(dl) + 1, len(dr) + 1), -1, np.int32)
        table[row + 1, col + 1] = np.arange(len(chosen))
        at = np.flatnonzero((at_l > 0)[s[:-1]])
        rule = table[at_l[s[at]], at_r[s[at + 1]]]
        hit = rule >= 0
        at, rule = at[hit], rule[hit]
        # Of pairs that overlap in a row, the first, third, ... are replaced.
        fresh = np.concatenate(([True], np.diff(at) != 1))
        place = np.arange(len(at))
        odd = (place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0
        at, rule = at[odd], rule[odd]
        times = np.bincount(rule, minlength=len(chosen))
        used = np.flatnonzero(times)
        number = (np.cumsum(times > 0) - 1)[rule]
        s[at] = (top + number).astype(np.uint32)
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        before, s = len(s), s[keep]
        left, right = left[used], right[used]
        span = np.concatenate((np.ones(first, np.int64), length))
        length = np.concatenate((length, span[left] + span[right]))
        closed = np.concatenate((closed, closed[right]))
        lefts.append(left)
        rights.append(right)
        top += len(used)
        if len(s) > 0.99 * before:
            break
    return s.astype(np.int64), np.concatenate(lefts), np.concatenate(rights), length


def expand(symbols: np.ndarray, first: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ids of ``symbols``, all nonterminals replaced level by level."""
    s = symbols.astype(np.uint32)
    left, right = left.astype(np.uint32), right.astype(np.uint32)
    while True:
        at = np.flatnonzero(s >= first)
        if not len(at):
            return s
        rule = s[at] - np.uint32(first)
        # Each nonterminal becomes its left symbol, and its right one goes in after it.
        out = np.empty(len(s) + len(at), np.uint32)
        after = at + np.arange(1, len(at) + 1)
        plain = np.ones(len(out), bool)
        plain[after] = False
        s[at] = left[rule]
        out[plain] = s
        out[after] = right[rule]
        s = out


def decode_range(symbols: np.ndarray, first: int, left: np.ndarray, right: np.ndarray, expansion: np.ndarray,
                 start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a shard; only the symbols that cover them are expanded."""
    span = np.ones(len(symbols), np.int64)
    inner = symbols >= first
    span[inner] = expansion[symbols[inner] - first]
    ends = np.cumsum(span)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skip = start - (int(ends[a - 1]) if a else 0)
    return expand(symbols[a:b], first, left, right)[skip:skip + stop - start]


def _encode(name: str, end_id: int, shard_ids: int, rounds: int, pairs_per_round: int, min_count: int,
            plain_specials: bool):
    end = np.array([end_id], dtype="<u4").tobytes()

    def shard_row(part: int, shard: int, docs: list, raws: list[bytes], first: int) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(raws), dtype="<u4")
        symbols, left, right, span = compress(ids, first, end_id, rounds, pairs_per_round, min_count)
        width = 2 if first + len(left) < 1 << 16 else 4
        known = np.array([d is not None for d in docs], dtype="u1")
        numbers = np.array([0 if d is None else d for d in docs], dtype="<i8")
        values = (part, shard, first, left.astype("i4"), right.astype("i4"), span.astype("i4"), width,
                  symbols.astype(f"<u{width}").tobytes(), known.tobytes() + numbers.tobytes(),
                  np.array([len(r) // 4 for r in raws], dtype="<u4").tobytes(), len(ids))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()),
                 pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        names = [f.split()[0] for f in FILE_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, CACHE_CHUNKS, plain_specials)
        first = max(enc.vocab_size, end_id + 1)
        part, shard, docs, raws, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in (part for whole in batches for part in slices(whole)):
            for doc, raw in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                docs.append(doc)
                raws.append(raw + end)
                size += len(raw) // 4 + 1
                if size >= shard_ids:
                    yield shard_row(part, shard, docs, raws, first)
                    shard, docs, raws, size = shard + 1, [], [], 0
        if docs:
            yield shard_row(part, shard, docs, raws, first)
    return encode


def write_token_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                    shard_ids: int = SHARD_IDS, rounds: int = ROUNDS, pairs_per_round: int = PAIRS_PER_ROUND,
                    min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text",
                    plain_specials: bool = True) -> None:
    """Write the ids of ``docs`` in ascending id order as Parquet files with one compressed shard per row (``FILE_SCHEMA``).

    ``plain_specials``: strings of special tokens in a text are ordinary text (the tokenizer's own default is false).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    # Rows of one id are split too: by their text's hash, and copies by their place.
    keys = ["_id", "_hash", "_row"]
    rows = rows.withColumns({"_hash": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_id", "_text")
    ordered.mapInArrow(_encode(tokenizer, end_id, shard_ids, rounds, pairs_per_round, min_count, plain_specials),
                       FILE_SCHEMA) \
        .write.parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            col = {n: batch.column(n)[i] for n in batch.schema.names}
            symbols = np.frombuffer(col["symbols"].as_buffer(), dtype=f"<u{col['symbol_bytes'].as_py()}")
            ids = expand(symbols, col["first_symbol"].as_py(), col["rule_left"].values.to_numpy(),
                         col["rule_right"].values.to_numpy()).astype("<u4")
            raw = col["documents"].as_py()
            lengths = np.frombuffer(col["lengths"].as_buffer(), dtype="<u4").astype(np.int64)
            n = len(lengths)
            numbers = np.frombuffer(raw, dtype="<i8", offset=n)
            known = np.frombuffer(raw, dtype="u1", count=n).astype(bool)
            starts = np.cumsum(lengths) - lengths
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(starts.tolist(), (starts + lengths).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([col["part"].as_py()] * n, pa.int64()), pa.array([col["shard"].as_py()] * n, pa.int64()),
                 pa.array(numbers, pa.int64(), mask=~known), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                names=["part", "shard", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files under ``path``.

    ``start`` is the number of ids before the document in all files: a running
    sum over the shards of a part and one over the parts (one row per part).
    """
    files = spark.read.parquet(path)
    docs = files.mapInArrow(_decode, "part long, shard long, doc_id long, start long, n_tokens long, ids_crc32 long")
    sizes = files.select("part", "shard", "n_tokens")
    in_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    shards = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0)).alias("_inside")) \
        .join(parts, "part").select("part", "shard", (F.col("_before") + F.col("_inside")).alias("_base"))
    return docs.join(shards, ["part", "shard"]).select(
        "doc_id", (F.col("_base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
