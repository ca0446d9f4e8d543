"""The document stream, the vector stream and the labelled pool over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.functions import vectors as V
from weftline.functions.texts import first_sentence


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, body, title (first sentence), lang, source, group_id, ts, h.  The time of a document is that of the event of its number;
    those without one have no place in the stream and are not in it."""
    d, e = read(spark, sf_dir, "documents"), read(spark, sf_dir, "events").select("event_id", "ts")
    both = d.join(e, d.doc_id == e.event_id)
    return both.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("body"), first_sentence(F.coalesce("text", F.lit(""))).alias("title"), "lang", "source", F.concat(F.lit("clusters_"), "lang").alias("group_id"), "ts", S.hours(F.col("ts")).alias("h"))


def with_seq(docs: DataFrame, partition: str | None = None) -> DataFrame:
    """The place in the stream, from 1, by (ts, id); with ``partition`` in each value of that column, which one task counts."""
    if partition is None:
        from weftline.operators.evaluate import running

        return running(docs, ["ts", "id"], {"seq": F.lit(1)})
    return docs.withColumn("seq", F.row_number().over(Window.partitionBy(partition).orderBy("ts", "id")).cast("long"))


def vec_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, gold, lang, ts, h, main, par, tp, of vectors that have a document and an event of their number.  par and tp are the vectors
    of the next two ids, going round."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    n = e.count()
    shifted = lambda k, name: e.select(((F.col("vec_id") + (n - k)) % n).alias("vec_id"), F.col("v").alias(name))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    times = read(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), "ts")
    joined = e.join(docs, "vec_id").join(times, "vec_id").join(shifted(1, "par"), "vec_id").join(shifted(2, "tp"), "vec_id")
    return joined.select("vec_id", F.col("label").cast("long").alias("gold"), "lang", "ts", S.hours(F.col("ts")).alias("h"), F.col("v").alias("main"), "par", "tp")


def cluster_stats(docs: DataFrame, key: str) -> DataFrame:
    """Counts, time sums and stamps by ``key`` from columns ts and h."""
    agg = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("sum_h"), F.sum(F.col("h") * F.col("h")).alias("sq_h"), F.max("h").alias("newest_h"), F.min("h").alias("oldest_h"), F.max("ts").alias("newest"), F.min("ts").alias("oldest"), F.sort_array(F.collect_set("lang")).alias("languages"))
    return agg.withColumn("stamp_h", S.relevance_stamp(F.col("n"), F.col("sum_h"), F.col("sq_h"))).withColumn("mean_sim", F.lit(0.0))


def label_pool(stream: DataFrame, key: str = "gold") -> DataFrame:
    """The fixed pool: one cluster for each gold label, with statistics and vector sums."""
    return cluster_stats(stream, key).join(V.vector_sum(stream, [key], ["main", "par", "tp"]), key).withColumnRenamed(key, "cid")


def duplicate_labels(docs: DataFrame) -> DataFrame:
    """``docs`` with ``label``: texts that are equal share one."""
    return docs.withColumn("label", F.md5(F.col("body").cast("binary")))
