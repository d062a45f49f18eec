"""Token counts by separator scan over flat, unindexed token files.

``write_token_files`` writes the ids of documents one after another as flat
little-endian integers, each document followed by the end-of-document id, with
Spark's text writer: a row holds the raw bytes of one document and the line
separator is the end id.  There is no index; a second file per shard, written in
the same pass, lists only which document comes when.

``scan_token_files`` finds the documents again: every file is read in blocks, a
vectorised search gives the positions of the end id in a block, and a running
sum and a running maximum over the (file, block) summaries give each block the
number of documents before it and the start of the document that reaches into
it.  One row per block is shuffled, by file.

Defined results: null text is the empty text (no tokens); ids after the last
separator of a file are one more document with ``ended`` false; an empty table
gives no files and no rows; repeated rows are documents of their own; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty
from .shingles import slices
from .tokens import encoder

TOKENIZER = "byte_bpe_50k.json"
END_ID = 50256            # <|endoftext|>; no text encodes to it
ID_BYTES = 2              # unsigned 16-bit ids
SHARD_BYTES = 32 << 20    # a file closes after that many bytes
BLOCK_IDS = 1 << 20


def _end_bytes(end_id: int, id_bytes: int) -> bytes:
    return int(end_id).to_bytes(id_bytes, "little")


def _shards(name: str, end_id: int, id_bytes: int, shard_bytes: int):
    dtype = f"<u{id_bytes}"

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, plain_specials=True)  # their strings too: the end id separates documents
        task, shard, size, at = TaskContext.get().partitionId(), 0, 0, 0
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                ids = np.frombuffer(raw, dtype="<u4")
                if len(ids) and (int(ids.max()) >> 8 * id_bytes or (ids == end_id).any()):
                    raise ValueError(f"an id of document {doc} is the end id or needs more than {id_bytes} bytes")
                if size and size + len(ids) * id_bytes > shard_bytes:
                    shard, size, at = shard + 1, 0, 0
                label = f"{task:06d}-{shard:06d}"
                rows.append(("ids", label, at, ids.astype(dtype).tobytes()))
                rows.append(("documents", label, at, b"" if doc is None else str(doc).encode()))
                size, at = size + (len(ids) + 1) * id_bytes, at + 1
            for kind in ("ids", "documents"):
                some = [r for r in rows if r[0] == kind]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*some) if some else ((),) * 4,
                                                    (pa.string(), pa.string(), pa.int64(), pa.binary()))],
                    names=["kind", "shard", "at", "value"])
    return shards


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                      id_bytes: int = ID_BYTES, shard_bytes: int = SHARD_BYTES,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``path/ids/shard=*/`` (flat token files) and ``path/documents/shard=*/`` (ids of the documents in file order).

    No shuffle: each task writes the documents it reads, in files of about ``shard_bytes``.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    parts = rows.mapInArrow(_shards(tokenizer, end_id, id_bytes, shard_bytes),
                            "kind string, shard string, at long, value binary")
    # One pass over the texts for both kinds of file; sorted within the task, as the writer of partitioned files needs.
    # Latin-1 gives the separator its bytes; document ids are digits, so both kinds can have the same separator.
    (parts.sortWithinPartitions("kind", "shard", "at")
     .select(F.col("value").cast("string").alias("value"), "kind", "shard")
     .write.partitionBy("kind", "shard").option("encoding", "ISO-8859-1")
     .option("lineSep", _end_bytes(end_id, id_bytes).decode("latin-1")).text(path))


def _ends(end_id: int, id_bytes: int, block_ids: int):
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard"), batch.column("content")):
                ids = np.frombuffer(content.as_buffer(), dtype=f"<u{id_bytes}")
                for block, start in enumerate(range(0, max(len(ids), 1), block_ids)):
                    found = np.flatnonzero(ids[start:start + block_ids] == end_id) + start
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard.as_py()]), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()),
                         pa.array([found], pa.list_(pa.int64()))], names=["shard", "block", "n_ids", "ends"])
    return ends


def scan_token_files(spark: SparkSession, path: str, end_id: int = END_ID, id_bytes: int = ID_BYTES,
                     block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row per document of the flat files under ``path``: ``shard, number, start, n_tokens, ended``.

    ``shard`` is the file's folder (``shard=...``) or its path; ``number`` counts
    from 0 in file order, ``start`` is the position of the first id in the file.
    A file is one row of Spark's binary source, so at most 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    label = F.regexp_extract("path", r"shard=([^/]*)/[^/]*$", 1)
    files = files.select(F.when(label == "", F.col("path")).otherwise(label).alias("shard"), "content")
    blocks = files.mapInArrow(_ends(end_id, id_bytes, block_ids), "shard string, block long, n_ids long, ends array<long>")
    order = Window.partitionBy("shard").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    stitched = blocks.withColumns({
        "_first": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)),
        "_open": F.coalesce(F.max(last).over(before), F.lit(-1)) + 1,
        "_final": F.lead("block").over(order).isNull()})
    # Starts and ends of the documents that end in the block, and what is left after the last separator of the file.
    rest = F.coalesce(last + 1, F.col("_open"))
    starts = F.concat(F.array("_open"), F.transform("ends", lambda e: e + 1))
    docs = F.zip_with(F.slice(starts, F.lit(1), F.size("ends")), "ends", lambda a, b: F.struct(
        a.alias("start"), b.alias("stop"), F.lit(True).alias("ended")))
    tail = F.when(F.col("_final") & (rest < F.col("n_ids")), F.array(F.struct(
        rest.alias("start"), F.col("n_ids").alias("stop"), F.lit(False).alias("ended")))).otherwise(
        F.array().cast("array<struct<start:bigint,stop:bigint,ended:boolean>>"))
    return stitched.select("shard", "_first", F.posexplode(F.concat(docs, tail)).alias("pos", "d")).select(
        "shard", (F.col("_first") + F.col("pos")).alias("number"), F.col("d.start").alias("start"),
        (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), F.col("d.ended").alias("ended"))


def listed_documents(spark: SparkSession, path: str, end_id: int = END_ID, id_bytes: int = ID_BYTES) -> DataFrame:
    """``shard, number, doc_id``: which document comes when, from the lists that ``write_token_files`` wrote."""
    sep = _end_bytes(end_id, id_bytes)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard"), batch.column("content")):
                ids = content.as_py().split(sep)[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.as_py()] * len(ids)), pa.array(range(len(ids)), pa.int64()),
                     pa.array([int(x) if x else None for x in ids], pa.int64())], names=["shard", "number", "doc_id"])
    return files.select(F.regexp_extract("path", r"shard=([^/]*)/[^/]*$", 1).alias("shard"), "content") \
        .mapInArrow(names, "shard string, number long, doc_id long")


def count_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``docs`` under ``path`` and count from them: ``doc_id, shard, number, start, n_tokens``."""
    spark = docs.sparkSession
    if docs.isEmpty():  # then no file is written
        return docs.limit(0).select(F.col(id_col).cast("long"), F.lit("").alias("shard"), *[
            F.lit(0).cast("long").alias(c) for c in ("number", "start", "n_tokens")])
    write_token_files(docs, path, tokenizer, end_id, id_col=id_col, text_col=text_col)
    counts = scan_token_files(spark, f"{path}/kind=ids", end_id)
    names = listed_documents(spark, f"{path}/kind=documents", end_id)
    return counts.join(names, ["shard", "number"]).select(
        F.col("doc_id").alias(id_col), "shard", "number", "start", "n_tokens")
