"""How the weight files beside this module came about: ``python -m weftline.plans.fit_models DIRECTORY``.

Documents of the tables in DIRECTORY with the hashing encoder's vectors, and the labelled vectors, are both streams with gold
clusters (equal texts; the label).  Beginning with models of similarity alone, the training queries give lines for ranking,
merging and joining; the three models are fitted on those (:mod:`weftline.operators.fitting`) and written.
"""

from __future__ import annotations

import sys
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import JOIN_MASK, MODELS, RANK_MASK, ClusterConfig
from weftline.operators import evaluate as E
from weftline.operators import features as X
from weftline.operators import fitting as FT
from weftline.operators import pool as P
from weftline.operators import training as TR
from weftline.sources import encode
from weftline.sources import fixtures as FX
from weftline.sources.models import LinearModel
from weftline.sources.scratch import written

#: similarity of the main vectors alone: where the fitting starts
START = LinearModel((1.0, *[0.0] * 11))


def document_stream(spark: SparkSession, d: str) -> DataFrame:
    """The document stream in the columns of the vector stream; equal texts are one gold cluster."""
    v = encode.with_vectors(FX.duplicate_labels(FX.doc_stream(spark, d).where("body <> ''")))
    number = v.groupBy("label").agg(F.min("id").alias("gold")).withColumnRenamed("label", "__l")
    return v.join(number, F.col("label") == F.col("__l")).select(F.col("id").alias("vec_id"), "gold", "lang", "ts", "h", "main", "par", "tp")


def lines(stream: DataFrame, cfg: ClusterConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rank, merge, join) lines of one stream."""
    stream = written(stream, "stream")
    pool = FX.label_pool(stream).drop("newest", "oldest", "languages")
    made = X.score_pool(stream.withColumnRenamed("vec_id", "doc").drop("ts"), pool, START, cfg)
    names = [f for f in made.columns if not f.startswith(("d_", "c_"))]
    scored = written(made.select(F.col("d_doc").alias("doc"), F.col("c_cid").alias("cid"), F.col("d_gold").alias("gold"), F.col("d_lang").alias("lang"), *names), "scored")
    # each gold cluster in two halves, which are better as one
    halves = stream.withColumn("half", F.col("gold") * 2 + F.pmod("vec_id", F.lit(2)))
    pairs = P.scored_pairs(FX.label_pool(halves, "half").drop("newest", "oldest", "languages"), START, cfg, densities=True).withColumn("merge_score", F.col("score"))
    gain = E.join_gain(halves.select("gold", F.col("half").alias("pred")))
    return TR.rank_lines(scored).select("line"), TR.merge_lines(scored, negatives=True).select("line"), TR.join_supervision(pairs, gain).select("line")


def main(d: str) -> None:
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    cfg = replace(ClusterConfig())
    streams = [lines(s, cfg) for s in (document_stream(spark, d), FX.vec_stream(spark, d))]
    rank, merge, join = ([s[k] for s in streams] for k in range(3))
    w, wrong = FT.fit_ranking(rank[0].union(rank[1]), RANK_MASK)
    print("rank", np.round(w, 3), "wrong", round(wrong, 4))
    FT.write_model(str(MODELS / "rank.cls"), w)
    for name, found, mask in (("merge", merge, RANK_MASK), ("join", join, JOIN_MASK)):
        w, bias, f1 = FT.fit_classifier(found[0].union(found[1]), mask)
        print(name, np.round(w, 3), round(bias, 3), "f1", round(f1, 4))
        FT.write_model(str(MODELS / f"{name}.cls"), w, bias)


if __name__ == "__main__":
    main(sys.argv[1])
