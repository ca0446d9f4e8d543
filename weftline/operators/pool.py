"""Decisions over a fixed pool, as relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import FEATURES, ClusterConfig
from weftline.operators import features as X
from weftline.sources.models import LinearModel


def best_cluster(scored: DataFrame, doc: str = "doc") -> DataFrame:
    """Each document's best cluster: the highest rank, of equal ones (to nine digits) the lowest id."""
    top = F.max_by(F.struct("cid", "rank", *FEATURES, *(c for c in ("gold", "lang") if c in scored.columns)), F.struct(F.round("rank", 9), -F.col("cid")))
    return scored.groupBy(doc).agg(top.alias("b")).select(doc, "b.*")


def accepted(best: DataFrame, merge: LinearModel, threshold: float = 0.0) -> DataFrame:
    return best.withColumn("merge_score", X.linear_score(merge)).withColumn("accepted", F.col("merge_score") > threshold)


def scored_pairs(pool: DataFrame, model: LinearModel, cfg: ClusterConfig = ClusterConfig(), densities: bool = False, triangular: bool = False) -> DataFrame:
    """Each cluster of the pool against each other one (``triangular``: later ones only); the pool is bounded by the settings."""
    if (size := pool.count()) > cfg.pool_size:
        raise ValueError(f"{size} clusters; the active pool holds {cfg.pool_size}")
    n = X.with_norms(pool)
    apart = F.col("s_cid") < F.col("t_cid") if triangular else F.col("s_cid") != F.col("t_cid")
    both = X.prefixed(n, "s_").join(F.broadcast(X.prefixed(n, "t_")), apart)
    return both.select("*", *X.pair_features(cfg, densities=densities)).withColumn("score", X.linear_score(model))


def nearest(pool: DataFrame, source, model: LinearModel, cfg: ClusterConfig = ClusterConfig(), k: int | None = None) -> DataFrame:
    """Clusters by their score to the source cluster; an unknown source raises."""
    if pool.where(F.col("cid") == source).isEmpty():
        raise KeyError(source)
    n = X.with_norms(pool)
    both = X.prefixed(n.where(F.col("cid") == source), "s_").join(X.prefixed(n, "t_"), F.col("s_cid") != F.col("t_cid"))
    out = both.select("s_cid", "t_cid", *X.pair_features(cfg)).withColumn("score", X.linear_score(model)).orderBy(F.desc("score"), "t_cid")
    return out.limit(k) if k else out


def joined(pool: DataFrame, key) -> DataFrame:
    """Clusters of the pool re-keyed and joined: sums, extremes and languages of each target."""
    from weftline.functions import vectors as V
    from weftline.functions.scalars import relevance_stamp

    keyed = pool.withColumn("target", key)
    agg = keyed.groupBy("target").agg(*(F.sum(c).alias(c) for c in ("n", "sum_h", "sq_h")), *(F.max(c).alias(c) for c in ("newest_h", "newest")), *(F.min(c).alias(c) for c in ("oldest_h", "oldest")), F.sort_array(F.array_distinct(F.flatten(F.collect_list("languages")))).alias("languages"))
    sums = V.vector_sum(keyed, ["target"], ["main", "par", "tp"])
    return agg.withColumn("stamp_h", relevance_stamp(F.col("n"), F.col("sum_h"), F.col("sq_h"))).join(sums, "target")
