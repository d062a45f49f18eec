"""Market-basket analysis.

* Baskets are a set per transaction (``collect_set``: a partial aggregate whose
  size is bounded by the number of distinct products), never a dense
  transaction x product matrix.
* Frequent itemsets come from Spark ML's parallel FP-growth, which partitions
  the conditional trees by item.  Support is then re-checked exactly as
  ``freq / n >= min_support`` (the same float comparison the reference makes).
* Rules enumerate every non-empty proper split of each itemset with a bitmask
  (``sequence`` + ``filter`` with the element index) and look both sides' support
  up with equi-joins on the sorted item arrays.  FP-growth's own rule output is
  not used: it only emits single-item consequents.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import half_even
from ..functions.text import join_items

ITEMSET_SCHEMA = T.StructType([
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("freq", T.LongType()),
    T.StructField("support", T.DoubleType()),
    T.StructField("length", T.IntegerType()),
])


def baskets(df: DataFrame, txn: str = "transaction_id", item: str = "product_name") -> DataFrame:
    """One sorted, de-duplicated item array per transaction."""
    return (df.filter(F.col(txn).isNotNull() & F.col(item).isNotNull())
            .groupBy(txn).agg(F.array_sort(F.collect_set(item)).alias("items")))


def frequent_itemsets(basket_df: DataFrame, min_support: float = 0.005,
                      num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """Every itemset with support >= ``min_support``, all sizes.  Returns (itemsets, n baskets)."""
    from ..session import literal_frame, materialize

    spark = basket_df.sparkSession
    # Counted, then read by FP-growth: written once (with AQE-sized partitions).
    held = materialize(basket_df.select("items"))
    n = held.count()
    if n == 0:
        return literal_frame(spark, [], ITEMSET_SCHEMA), 0
    fp = FPGrowth(itemsCol="items", minSupport=min_support * (1 - 1e-9), minConfidence=1.0)
    if num_partitions:
        fp = fp.setNumPartitions(num_partitions)
    model = fp.fit(held)
    support = F.col("freq").cast("double") / F.lit(float(n))
    # The model's itemset frame is lazy over the baskets; materialise it once (its size is
    # bounded by the support threshold) so the rule joins do not re-run FP-growth.
    sets = (model.freqItemsets
            .select(F.array_sort("items").alias("items"), F.col("freq").cast("long").alias("freq"))
            .withColumn("support", support)
            .filter(F.col("support") >= F.lit(min_support))
            .withColumn("length", F.size("items").cast("int"))
            .checkpoint(eager=True))
    return sets, n


def association_rules(itemsets: DataFrame, min_lift: float = 1.0) -> DataFrame:
    """All rules A -> C with A, C non-empty, disjoint, A u C a frequent itemset; lift >= ``min_lift``.

    Columns: antecedent, consequent (sorted arrays), antecedent_support,
    consequent_support, support, confidence, lift, leverage, conviction
    (NULL where the reference would divide by zero).
    """
    multi = itemsets.filter(F.col("length") >= 2)
    masks = multi.select(
        "items", "support",
        F.explode(F.expr("sequence(1L, (1L << length) - 2)")).alias("_mask"))
    # Element i goes to the antecedent when bit i of the mask is set.
    splits = masks.select(F.expr("filter(items, (x, i) -> ((_mask >> i) & 1) = 1)").alias("antecedent"),
                          F.expr("filter(items, (x, i) -> ((_mask >> i) & 1) = 0)").alias("consequent"),
                          "support")
    side = itemsets.select("items", F.col("support").alias("_s"))
    ante = side.withColumnRenamed("items", "antecedent").withColumnRenamed("_s", "antecedent_support")
    cons = side.withColumnRenamed("items", "consequent").withColumnRenamed("_s", "consequent_support")
    rules = splits.join(ante, "antecedent").join(cons, "consequent")
    conf = F.col("support") / F.col("antecedent_support")
    rules = rules.select(
        "antecedent", "consequent", "antecedent_support", "consequent_support", "support",
        conf.alias("confidence"),
        (conf / F.col("consequent_support")).alias("lift"),
        (F.col("support") - F.col("antecedent_support") * F.col("consequent_support")).alias("leverage"),
        F.try_divide(F.lit(1.0) - F.col("consequent_support"), F.lit(1.0) - conf).alias("conviction"),
    )
    return rules.filter(F.col("lift") >= F.lit(min_lift))


def bought_together(rules: DataFrame, n: int = 10) -> DataFrame:
    """I4: rules with more than one item on a side, as text, the ``n`` with the largest lift.

    Ties on lift (A -> C and C -> A always tie) are broken by the item texts.
    """
    multi = rules.filter((F.size("antecedent") > 1) | (F.size("consequent") > 1))
    shown = multi.select(
        join_items("antecedent").alias("items_purchased_together"),
        join_items("consequent").alias("suggested_products"),
        half_even(F.col("support") * F.lit(100.0), 2).alias("purchase_frequency_pct"),
        half_even(F.col("confidence") * F.lit(100.0), 2).alias("likelihood_pct"),
        F.col("lift").alias("association_strength"),
    )
    order = [F.col("association_strength").desc(), F.col("items_purchased_together"), F.col("suggested_products")]
    top = shown.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))
