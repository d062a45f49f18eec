"""Best-fit packing of documents into sequences: bounded-space online best-fit.

Every task packs its own pieces, in a seeded order, into a fixed number of open
bins.  Open bins are kept by free space: one bit of an integer per free space
that some open bin has, and a stack of bins behind each bit.  The best fit for a
piece is the lowest set bit at or above its length; when no open bin fits, a new one
is opened, and if there are as many open bins as allowed, the fullest (the
lowest set bit of all) closes first.

Only piece rows without text are shuffled (a few dozen bytes each), spread by
a hash of the piece, so no source or document can make a task large.

Defined results: null text is the empty text, whose only id is the end id;
repeated rows are packed each on their own; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .shingles import slices
from .tokens import encoder

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE_TOKENS = 2048
END_ID = 0
OPEN_BINS = 1024
PIECES_PER_TASK = 100_000
SEED = 7


class OpenBins:
    """Bounded-space best-fit over bins of one capacity."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.stacks, self.open, self.made = 0, {}, 0, 0

    def _pop(self, free: int) -> int:
        stack = self.stacks[free]
        bin_ = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece of 1 to ``capacity`` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._pop(free)
        else:
            bin_, free = self.made, self.capacity
            self.made += 1
        if free > length:
            if self.open >= self.limit:
                self._pop((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            self.stacks.setdefault(free - length, []).append(bin_)
            self.bits |= 1 << (free - length)
            self.open += 1
        return bin_, self.capacity - free


def _pieces(name: str, size: int, end_id: int, with_ids: bool, plain_specials: bool):
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, plain_specials=plain_specials)
        for batch in (part for whole in batches for part in slices(whole)):
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            cols: dict[str, list] = {"_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            if with_ids:
                cols["ids"] = []
            for doc, raw in zip(ids, enc.encode(texts)):
                raw += end
                n, start, k = len(raw) // 4, 0, 0
                while start < n:
                    stop = start + (n % size or size) if start == 0 else start + size
                    part = raw[4 * start:4 * stop]
                    for name_, v in zip(cols, (doc, k, start, stop - start, zlib.crc32(part), part)):
                        cols[name_].append(v)
                    start, k = stop, k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(cols.values(), (batch.schema.field(0).type, pa.int32(), pa.int64(),
                                                                pa.int64(), pa.int64(), pa.binary()))], names=list(cols))
    return pieces


def _placed(size: int, open_bins: int):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(size, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"])
    return placed


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, sequence_tokens: int = SEQUENCE_TOKENS,
                   end_id: int = END_ID, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK,
                   with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
                   plain_specials: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``with_ids`` adds ``ids``, the piece's ids as little-endian unsigned 32-bit
    integers (then they move through the shuffle).  A document is the ids of its
    text and the end id; longer ones are cut so that only the first piece can be
    shorter than a sequence.  ``plain_specials``: strings of special tokens in a text are
    ordinary text (the tokenizer's own default is false).
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    pieces = rows.mapInArrow(_pieces(tokenizer, sequence_tokens, end_id, with_ids, plain_specials), schema)
    # A token has at least one byte, so the bytes bound the pieces of a text.
    most = rows.agg(F.sum(F.ceil((F.octet_length("_text") + 1) / sequence_tokens))).first()[0] or 0
    tasks = max(1, math.ceil(most / pieces_per_task))
    spread = (pieces.repartition(tasks, "_id", "piece", "ids_crc32")
              .sortWithinPartitions(F.xxhash64(F.lit(SEED), "_id", "piece", "ids_crc32"), "_id", "piece"))
    return spread.mapInArrow(_placed(sequence_tokens, open_bins), schema + ", sequence_id long, offset long") \
        .withColumnRenamed("_id", id_col)


def assemble(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, documents``: the sequences of ``pack_documents(..., with_ids=True)``.

    ``ids`` is the whole sequence (bounded by its length), ``documents`` its
    pieces in place: (offset, doc, piece, length).
    """
    doc = packed.columns[0]
    return packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", doc, "piece", "length", "ids"))).alias("_p")).select(
        "sequence_id", F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("_p", lambda x: F.struct(x["offset"], x[doc], x["piece"], x["length"])).alias("documents"))
