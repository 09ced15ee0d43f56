"""Market baskets: supports of items and pairs, association rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_support(baskets: DataFrame) -> DataFrame:
    """item, support over distinct (basket, item)."""
    return baskets.distinct().groupBy("item").agg(F.count(F.lit(1)).alias("support"))


def frequent_pairs(baskets: DataFrame, support: int = 100) -> DataFrame:
    """a < b, support: item pairs in `support` baskets or more. Items below it go before pairs are made."""
    rows = baskets.distinct()
    often = item_support(baskets).filter(F.col("support") >= support).select("item")
    kept = rows.join(often, "item", "left_semi")
    a, b = kept.select("basket", F.col("item").alias("a")), kept.select("basket", F.col("item").alias("b"))
    return a.join(b, "basket").filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= support)


def association_rules(baskets: DataFrame, support: int = 100, confidence: float = 0.5) -> DataFrame:
    """lhs, rhs, confidence, support for both directions of every frequent pair."""
    pairs = frequent_pairs(baskets, support)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("lhs"), F.col("b").alias("rhs")), F.struct(F.col("b").alias("lhs"), F.col("a").alias("rhs")))).alias("r"), "support").select("r.*", "support")
    single = item_support(baskets).select(F.col("item").alias("lhs"), F.col("support").alias("n"))
    return both.join(single, "lhs").select("lhs", "rhs", (F.col("support") / F.col("n")).alias("confidence"), "support").filter(F.col("confidence") >= confidence)


def top_rules(rules: DataFrame, k: int = 10) -> DataFrame:
    """The k best: confidence, then support, both descending, then names."""
    return rules.orderBy(F.desc("confidence"), F.desc("support"), "lhs", "rhs").limit(k)
