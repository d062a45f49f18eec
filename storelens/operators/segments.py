"""Product segmentation by weekly sales pattern.

Products stay rows.  The week axis is a small array (one slot per observed ISO
week, at most 53), built from a two-level aggregate: (product, week) partial
sums first, then one bounded ``map_from_entries`` per product.  No product x
week cross join is ever formed.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import money_sum
from ..session import attach, materialize

MICRO = 1_000_000   # vectors are compared in millionths
MAX_ITER = 30       # steps of k-means

# Cluster id -> descriptive name.
CLUSTER_NAMES = {0: "High Demand Products", 1: "Seasonal Products", 2: "Low Demand Products"}


def product_week_vectors(df: DataFrame, weeks: Sequence[int] | None = None, key: str = "product_name",
                         week: str = "iso_week", value: str = "total_sales") -> tuple[DataFrame, list[int]]:
    """D25 as arrays: per product, the sales of each observed week in week order, 0 where none.

    The weeks (at most 53) come from the (product, week) sums and from sales without
    a product, so the rows are read once.
    """
    per = materialize(df.filter(F.col(week).isNotNull()).groupBy(key, week).agg(money_sum(value).alias("_s")))
    weeks = list(weeks) if weeks is not None else sorted(r[0] for r in per.select(week).distinct().collect())
    per = per.filter(F.col(key).isNotNull())
    slots = F.array(*[F.lit(w) for w in weeks])
    vec = (per.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(week, "_s"))).alias("_m"))
           .select(key, F.transform(slots, lambda w: F.coalesce(F.try_element_at("_m", w), F.lit(0.0))).alias("weekly")))
    return vec, weeks


def product_week_matrix(df: DataFrame, weeks: Sequence[int] | None = None, key: str = "product_name") -> DataFrame:
    """D25 long form: (product, week, sales) for every product x observed week, zero-filled."""
    vec, weeks = product_week_vectors(df, weeks, key)
    return vec.select(key, F.posexplode("weekly").alias("_i", "total_sales")).select(
        key, F.element_at(F.array(*[F.lit(w) for w in weeks]), F.col("_i") + 1).alias("iso_week"), "total_sales")


def standardise_weekly(vectors: DataFrame, key: str = "product_name") -> DataFrame:
    """Each product's vector minus its own mean over its own population std (std 0 -> 1)."""
    n = F.size("weekly").cast("double")
    mean = F.aggregate("weekly", F.lit(0.0), lambda acc, x: acc + x) / n
    with_mean = vectors.withColumn("_mean", mean)
    var = F.aggregate("weekly", F.lit(0.0), lambda acc, x: acc + (x - F.col("_mean")) * (x - F.col("_mean"))) / n
    std = F.sqrt(var)
    scale = F.when(std == 0, F.lit(1.0)).otherwise(std)
    return with_mean.withColumn("_scale", scale).select(
        key, F.transform("weekly", lambda x: (x - F.col("_mean")) / F.col("_scale")).alias("scaled"))


def standardised_long(scaled: DataFrame, weeks: Sequence[int], key: str = "product_name") -> DataFrame:
    return scaled.select(key, F.posexplode("scaled").alias("_i", "z")).select(
        key, F.element_at(F.array(*[F.lit(w) for w in weeks]), F.col("_i") + 1).alias("iso_week"), "z")


def _whole_numbers(scaled: DataFrame, key: str) -> DataFrame:
    """``_key, _z``: the vectors in millionths, as whole numbers, so that sums and distances are exact in any order."""
    return scaled.select(F.col(key).alias("_key"), F.transform("scaled", lambda x: F.rint(x * MICRO).cast("long")).alias("_z"))


def _distance(z: Column, centre: Column) -> Column:
    return F.aggregate(F.zip_with(z, centre, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda x, y: x + y)


def _literal(centres: list[list[list[int]]]) -> Column:
    """Restarts x clusters x weeks numbers as one constant."""
    return F.from_json(F.lit(json.dumps(centres)), "array<array<array<bigint>>>")


def _distances(centres: list[list[list[int]]]) -> Column:
    """Per restart, the squared distances of ``_z`` to the centres."""
    return F.transform(_literal(centres), lambda cs: F.transform(cs, lambda c: _distance(F.col("_z"), c)))


def _draw(seed: int, restart: Column, step: int) -> Column:
    """The exponential of a number between 0 and 1 drawn from md5 for each (seed, restart, step, product).

    The product with the least of these divided by a weight is a draw in proportion to the weights.
    """
    text = F.concat_ws("|", F.lit(str(seed)), restart.cast("string"), F.lit(str(step)), F.col("_key").cast("string"))
    u = (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return -F.log(u)


def first_centres(data: DataFrame, k: int, restarts: int, seed: int) -> list[list[list[int]]]:
    """Of every restart, ``k`` products drawn with weights: the first evenly, each next by the squared distance to
    the nearest before it.  One aggregate per step for all restarts; the driver sees one product per restart."""
    centres: list[list[list[int]]] = [[] for _ in range(restarts)]
    for step in range(k):
        weights = F.transform(_distances(centres), lambda d: F.array_min(d)) if step else \
            F.array(*[F.lit(1).cast("long")] * restarts)
        rows = data.select("_key", "_z", F.posexplode(weights).alias("_r", "_w")).filter(F.col("_w") > 0)
        race = F.struct((_draw(seed, F.col("_r"), step) / F.col("_w")).alias("race"), F.col("_key"))
        for r in rows.groupBy("_r").agg(F.min_by("_z", race).alias("z")).collect():
            centres[r["_r"]].append(list(r["z"]))
    return centres


def lloyd_step(data: DataFrame, centres: list[list[list[int]]]) -> list[list[list[int]]]:
    """The rounded means of the products that are nearest to each centre (the lower number wins ties); a centre without any stays.

    One aggregate for all restarts: restarts x clusters x weeks sums reach the driver.
    """
    nearest = F.transform(_distances(centres), lambda d: F.array_position(d, F.array_min(d)).cast("int") - 1)
    rows = data.select("_z", F.posexplode(nearest).alias("_r", "_c")).select("_r", "_c", F.posexplode("_z").alias("_i", "_v"))
    out = [[list(c) for c in cs] for cs in centres]
    for r in rows.groupBy("_r", "_c", "_i").agg(F.sum(F.col("_v").cast("decimal(19,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect():
        out[r["_r"]][r["_c"]][r["_i"]] = (2 * int(r["s"]) + r["n"]) // (2 * r["n"])
    return out


def segment_products(scaled: DataFrame, k: int = 3, restarts: int = 10, seed: int = 0,
                     key: str = "product_name", max_iter: int = MAX_ITER) -> tuple[DataFrame, float]:
    """K-means with ``restarts`` seeded starts; the one with the lowest within-cluster cost wins.

    Returns (product, cluster) and the winning cost.  The starts are drawn by squared distance from hashes of the
    product names, and vectors, means and distances are whole numbers (millionths), so neither the order of rows nor
    partitions nor the engine change the answer: SQL gives the same clusters.  All restarts take a step in one aggregate over the products;
    steps end when no centre moves, or after ``max_iter``.  Products without a name take no part; with fewer than ``k``
    different products there are fewer clusters.
    """
    data = materialize(_whole_numbers(scaled.filter(F.col(key).isNotNull()), key))
    centres = first_centres(data, k, restarts, seed)
    if not any(centres):
        return data.select(F.col("_key").alias(key), F.lit(None).cast("int").alias("cluster")), 0.0
    for _ in range(max_iter):
        moved = lloyd_step(data, centres)
        if moved == centres:
            break
        centres = moved
    costs = data.select(F.posexplode(F.transform(_distances(centres), lambda d: F.array_min(d))).alias("_r", "_d")) \
        .groupBy("_r").agg(F.sum(F.col("_d").cast("decimal(19,0)")).alias("cost")).collect()  # one row per restart
    cost, best = min((int(r["cost"]), r["_r"]) for r in costs)
    d = F.element_at(_distances([centres[best]]), 1)
    out = data.select(F.col("_key").alias(key), (F.array_position(d, F.array_min(d)) - 1).cast("int").alias("cluster"))
    return materialize(out), cost / MICRO ** 2


def nearest_is_own(scaled: DataFrame, clusters: DataFrame, key: str = "product_name") -> DataFrame:
    """What a finished k-means must show: (product, ``nearest_is_own``), true when no other cluster's mean is nearer."""
    data = scaled.join(clusters.select(key, "cluster"), key)
    means: dict[int, dict[int, float]] = {}
    for r in (data.select("cluster", F.posexplode("scaled").alias("i", "z")).groupBy("cluster", "i")
              .agg(F.avg("z").alias("m")).collect()):  # clusters x weeks
        means.setdefault(r["cluster"], {})[r["i"]] = r["m"]

    def gap(mean: dict[int, float]) -> Column:
        centre = F.array(*[F.lit(mean[i]) for i in sorted(mean)])
        return F.aggregate(F.zip_with("scaled", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)

    gaps = {c: gap(m) for c, m in means.items()}
    own = F.coalesce(*[F.when(F.col("cluster") == c, g) for c, g in gaps.items()], F.lit(None).cast("double"))
    return data.select(key, (own <= F.array_min(F.array(*gaps.values())) + 1e-9).alias("nearest_is_own"))


def _cluster_name(number: Column) -> Column:
    """The descriptive name of a cluster number; numbers without one are called by it."""
    names = F.create_map(*[x for i, n in CLUSTER_NAMES.items() for x in (F.lit(i), F.lit(n))])
    return F.coalesce(F.try_element_at(names, number.cast("int")), F.concat(F.lit("Cluster "), number.cast("string")))


def label_clusters(clusters: DataFrame, by: str = "id", vectors: DataFrame | None = None,
                   key: str = "product_name") -> DataFrame:
    """Cluster id -> name.  ``by='id'`` keeps the reference's arbitrary mapping (Q12);
    ``by='demand'`` names clusters by descending mean weekly sales."""
    if by == "id":
        return clusters.withColumn("cluster_name", _cluster_name(F.col("cluster")))
    if vectors is None:
        raise ValueError("by='demand' needs the weekly vectors")
    total = F.aggregate("weekly", F.lit(0.0), lambda a, x: a + x) / F.size("weekly")
    demand = (clusters.join(vectors.select(key, total.alias("_avg")), key)
              .groupBy("cluster").agg(F.avg("_avg").alias("_d")))
    ranked = demand.select("cluster", (F.row_number().over(Window.orderBy(F.col("_d").desc(), "cluster")) - 1)
                           .alias("_rank"))
    return clusters.join(F.broadcast(ranked), "cluster").withColumn(  # one row per cluster
        "cluster_name", _cluster_name(F.col("_rank"))).drop("_rank")


def clustered_products(labelled: DataFrame, key: str = "product_name",
                       names: Sequence[str] | None = None) -> DataFrame:
    """I8: one column per cluster name, products listed side by side in name order, NULL padded."""
    from .sequence import SEQ, sequence_rows

    if names is None:  # the fixed names first, then any others that occur (at most one per cluster)
        found = [r[0] for r in labelled.select("cluster_name").distinct().orderBy("cluster_name").collect()]
        names = [*CLUSTER_NAMES.values(), *[n for n in found if n not in CLUSTER_NAMES.values()]]
    # Position inside the cluster from the global (cluster, product) sequence, so a
    # cluster holding most products is still split over many tasks.
    seqd, _ = sequence_rows(labelled.select("cluster_name", key), [key], by=["cluster_name"])
    starts = seqd.groupBy("cluster_name").agg(F.min(SEQ).alias("_start"))
    pos = seqd.join(starts, "cluster_name").withColumn("row", F.col(SEQ) - F.col("_start") + 1)
    return (pos.groupBy("row")
            .agg(*[F.max(F.when(F.col("cluster_name") == n, F.col(key))).alias(n) for n in names])
            .orderBy("row"))


def with_clusters(df: DataFrame, clusters: DataFrame, key: str = "product_name") -> DataFrame:
    """The cluster of each sale's product (left join with a counted one-row-per-product table)."""
    return attach(df, clusters.select(key, "cluster"), key)
