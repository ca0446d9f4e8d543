"""Feature builders and scorers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import FEATURES, ClusterConfig
from weftline.functions import scalars as S
from weftline.functions import vectors as V
from weftline.sources.models import LinearModel, PolynomialModel

VECTORS = ("main", "par", "tp")


def with_norms(df: DataFrame, prefix: str = "") -> DataFrame:
    """Squared norms beside the vectors, so that each is worked out once per row and not once per pair."""
    for v in VECTORS:
        df = df.withColumn(f"{prefix}{v}_n", V.squared_norm(F.col(f"{prefix}{v}")))
    return df


def _cos(a: str, b: str) -> Column:
    return V.shifted_cosine(F.col(a), F.col(b), F.col(f"{a}_n"), F.col(f"{b}_n"))


def document_features(cfg: ClusterConfig = ClusterConfig(), d: str = "d_", c: str = "c_") -> list[Column]:
    """The twelve features of a document (columns ``d_``) against a cluster (columns ``c_``)."""
    zero, std = F.lit(0.0), cfg.gaussian_std_days
    day = lambda other: S.gaussian((F.col(f"{d}h") - F.col(f"{c}{other}")) / 24, std) if cfg.use_timestamps else zero
    par, tp = cfg.use_paragraph, cfg.use_title_paragraph
    made = [
        _cos(f"{c}main", f"{d}main"), day("newest_h"), day("oldest_h"), day("stamp_h"), zero,
        _cos(f"{c}par", f"{d}par") if par else zero, _cos(f"{c}tp", f"{d}tp") if tp else zero,
        _cos(f"{c}main", f"{d}par") if par else zero, _cos(f"{c}main", f"{d}tp") if tp else zero,
        S.size_bin(F.col(f"{c}n")) if cfg.use_density else zero, F.lit(1.0) + F.col(f"{c}mean_sim") if cfg.use_mean_similarity else zero, zero,
    ]
    return [x.alias(n) for x, n in zip(made, FEATURES)]


def pair_features(cfg: ClusterConfig = ClusterConfig(), s: str = "s_", t: str = "t_", densities: bool = False) -> list[Column]:
    """The twelve features of a source cluster against a target cluster; not symmetric."""
    zero, std = F.lit(0.0), cfg.gaussian_std_days
    day = lambda x: S.gaussian((F.col(f"{s}{x}") - F.col(f"{t}{x}")) / 24, std) if cfg.use_timestamps else zero
    par, tp = cfg.use_paragraph, cfg.use_title_paragraph
    made = [
        _cos(f"{s}main", f"{t}main"), day("newest_h"), day("oldest_h"), day("stamp_h"), zero,
        _cos(f"{s}par", f"{t}par") if par else zero, _cos(f"{s}tp", f"{t}tp") if tp else zero,
        _cos(f"{s}main", f"{t}par") if par else zero, _cos(f"{s}main", f"{t}tp") if tp else zero,
        S.size_bin(F.col(f"{s}n")) if densities or cfg.use_density else zero, F.lit(1.0) + F.col(f"{s}mean_sim") if cfg.use_mean_similarity else zero,
        S.size_bin(F.col(f"{t}n")) if densities else zero,
    ]
    return [x.alias(n) for x, n in zip(made, FEATURES)]


def linear_score(model: LinearModel) -> Column:
    """Weights times feature columns plus bias; slots of weight 0 are left out of the expression."""
    out = F.lit(float(model.bias))
    for name, w in zip(FEATURES, model.weights):
        if w:
            out = out + F.lit(float(w)) * F.col(name)
    return out


def polynomial_score(model: PolynomialModel) -> Column:
    """Sum over support vectors of coef * (gamma * sv.x + coef0) ** degree, less rho."""
    out = F.lit(-float(model.rho))
    for coef, sv in model.vectors:
        inner = sum((F.lit(float(v)) * F.col(n) for n, v in zip(FEATURES, sv) if v), F.lit(0.0))
        out = out + F.lit(float(coef)) * F.pow(F.lit(float(model.gamma)) * inner + F.lit(float(model.coef0)), F.lit(float(model.degree)))
    return out


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns))


def score_pool(docs: DataFrame, pool: DataFrame, model: LinearModel, cfg: ClusterConfig = ClusterConfig()) -> DataFrame:
    """Every document against every cluster of the pool, with features and ``rank``.

    The pool is what one machine keeps active, ``cfg.pool_size`` clusters at most; a larger one is refused, not broadcast."""
    if (size := pool.count()) > cfg.pool_size:
        raise ValueError(f"{size} clusters; the active pool holds {cfg.pool_size}")
    both = prefixed(with_norms(docs), "d_").crossJoin(F.broadcast(prefixed(with_norms(pool), "c_")))
    return both.select("*", *document_features(cfg)).withColumn("rank", linear_score(model))
