"""Spark session and checkpoint-directory helpers.

The library never creates its own session inside an operator: every public
function takes DataFrames (or a session) from the caller.  ``local_session``
exists for tests, the bench and the command line.
"""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import SparkSession

# Defaults that matter at any scale: AQE re-plans joins and coalesces small
# shuffle partitions at run time, and skewed join partitions are split.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Checkpoints cut lineage for ordered operators; remove their files once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  app_name: str = "storelens", conf: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and benchmarks (UI off, no server)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**SCALE_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting it only when unset.

    On a cluster the shared folder must come from ``spark.checkpoint.dir``;
    a machine-local folder is accepted only for a local master (tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - conf lookup raises when absent
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; ordered operators cut lineage "
            "with reliable checkpoints and need a shared folder")
    path = tempfile.mkdtemp(prefix="storelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return f"{v}L"
    if isinstance(v, float):
        if v != v or v in (float("inf"), float("-inf")):
            return f"CAST('{v}' AS DOUBLE)"
        return f"{v!r}D"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_frame(spark: SparkSession, rows, schema) -> "DataFrame":
    """A small frame from Python values as one inline ``VALUES`` table (JVM only, no Python RDD).

    For bounded tables built from aggregates (partition offsets, statistics);
    ``schema`` is a ``StructType`` of atomic types.  One SQL statement, so the
    cost stays flat even for tens of thousands of rows (one per partition).
    """
    from pyspark.sql import functions as F

    fields = list(schema.fields)
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    body = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
    cols = ", ".join(f"CAST(col{i + 1} AS {f.dataType.simpleString()}) AS `{f.name}`" for i, f in enumerate(fields))
    return spark.sql(f"SELECT {cols} FROM VALUES {body}")


BROADCAST_ROWS = 100_000  # one-row-per-key tables up to this many rows are broadcast
SALTS = 16


def attach(df: "DataFrame", table: "DataFrame", key: str, max_rows: int = BROADCAST_ROWS) -> "DataFrame":
    """``df`` left-joined with a one-row-per-key ``table`` on ``key``, without dealing the rows of ``df`` out by a hot key.

    The table is written once and counted.  Up to ``max_rows`` rows it is
    broadcast; beyond that both sides are spread over ``SALTS`` salts of the key, so one
    key's rows go to that many tasks.
    """
    from pyspark.sql import functions as F

    table = materialize(table)
    if table.count() <= max_rows:
        return df.join(F.broadcast(table), key, "left")
    salted = table.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c != key]), F.lit(SALTS)).cast("int"))
    return spread.join(salted, [key, "_salt"], "left").drop("_salt")


def materialize(df: "DataFrame") -> "DataFrame":
    """Write ``df`` once as a reliable checkpoint and return the frame reading it back.

    Used where a frame is read several times (multi-pass statistics, model
    fits).  Unlike ``cache()``, the checkpoint is computed with AQE (so small
    results get coalesced partitions), cuts lineage and survives executor loss.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_packed(df: "DataFrame") -> "DataFrame":
    """``materialize`` for wide rows: a checkpoint of compressed Arrow batches, unpacked at every read.

    Partitions and the order of rows stay.  A read unpacks whole rows, in Python, whatever columns it needs.
    The shuffle files behind the rows are given up (``release``).
    """
    import pyarrow as pa

    def pack(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            if batch.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                    out.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])

    def unpack(batches):
        for batch in batches:
            for rows in batch.column("rows"):
                yield from pa.ipc.open_stream(rows.as_buffer())

    packed = materialize(df.mapInArrow(pack, "rows binary"))
    release(df.sparkSession)
    return packed.mapInArrow(unpack, df.schema)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle and checkpoint files of frames that nothing refers to any more.

    It does so when the driver's collector finds them gone, which on a large heap can be long after they are.  The
    scheduler holds the frame of its last job until it has another: a job of one row comes first.
    """
    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()
