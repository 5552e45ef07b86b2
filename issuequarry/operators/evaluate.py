"""Duplicate-detection metrics over retrieved neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_scores(
    neighbors: DataFrame, truth: DataFrame, k: int, strict_reference: bool = False
) -> DataFrame:
    """Per labelled row: hit, precision and ndcg of its top ``k``.

    ``neighbors``: issue_id, neighbor_id, rank, similarity. ``truth``: id,
    duplicate_of. Rows without a duplicate are skipped, or count as misses with
    ``strict_reference``. Equal scores share their discounts. A row has at most
    ``k`` neighbours, so the collected lists are short.
    """
    labelled = truth if strict_reference else truth.filter("duplicate_of is not null")
    top = neighbors.filter(F.col("rank") <= k).groupBy("issue_id").agg(
        F.collect_list(F.struct("rank", "neighbor_id", "similarity")).alias("top")
    )
    joined = labelled.select("id", "duplicate_of").join(top, F.col("id") == F.col("issue_id"), "left")
    hit = F.try_element_at(F.filter("top", lambda x: x["neighbor_id"] == F.col("duplicate_of")), F.lit(1))
    scored = joined.withColumn("_hit", hit)
    tied = F.filter("top", lambda x: x["similarity"] == F.col("_hit.similarity"))
    gains = F.transform(tied, lambda x: F.lit(1.0) / F.log2(x["rank"].cast("double") + 1))
    mean_gain = F.aggregate(gains, F.lit(0.0), lambda a, x: a + x) / F.size(gains)
    found = F.col("_hit").isNotNull()
    return scored.select(
        "id", found.cast("int").alias("hit"), (found.cast("int") / F.lit(k)).alias("precision"),
        F.when(found, mean_gain).otherwise(F.lit(0.0)).alias("ndcg"),
    )


def duplicate_metrics(neighbors: DataFrame, truth: DataFrame, k: int = 5, strict_reference: bool = False) -> DataFrame:
    """One row: labelled rows, hit rate, precision at k, ndcg."""
    scores = duplicate_scores(neighbors, truth, k, strict_reference)
    return scores.agg(
        F.count("*").alias("count"), F.avg("hit").alias("hit_rate"),
        F.avg("precision").alias("p_at_k"), F.avg("ndcg").alias("ndcg"),
    )
