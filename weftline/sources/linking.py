"""Linked corpora: bags of articles per language, links between bags, and gold pairs made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ARTICLE = "id string, body string, title string, eventUri string, isDuplicate boolean, lang string, date string, time string, source struct<title:string>"
BAG = f"map<string, struct<info: struct<lang: string, eventUri: string>, articles: struct<results: array<struct<{_ARTICLE.replace(' string', ': string').replace(' boolean', ': boolean').replace(' struct', ': struct')}>>>>>"


def read_corpus(spark: SparkSession, path: str, languages: list[str] | None = None, documents: DataFrame | None = None, limited: bool = False, pattern: str = "*.json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bags, articles, links) of a directory tree of JSON files; a file whose path has "positive" in it links its bags so.

    ``documents`` (column id) and ``languages`` restrict the articles; ``limited`` keeps files of two bags in two languages; ``pattern`` is that of the files' names."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", BAG).alias("bags"))
    bags = raw.where(F.col("bags").isNotNull()).select("file", F.explode("bags").alias("bag_id", "bag")).where((F.col("bag_id") != "meta") & F.col("bag.info").isNotNull())
    bags = bags.select("file", F.when(F.col("file").contains("positive"), "positive").otherwise("negative").alias("linked_as"), "bag_id", F.col("bag.info.lang").alias("lang"), F.col("bag.info.eventUri").alias("event_id"), F.col("bag.articles.results").alias("results"))
    if languages:
        bags = bags.where(F.col("lang").isin(*languages))
    if limited:
        two = bags.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs")).where("n = 2 AND langs = 2").select("file")
        bags = bags.join(two, "file", "left_semi")
    articles = bags.select("bag_id", F.explode("results").alias("a")).select("bag_id", "a.id", F.col("a.body").alias("text"), "a.title", "a.lang", F.col("a.eventUri").alias("event_id"), F.col("a.isDuplicate").alias("duplicate"), F.to_timestamp(F.concat_ws(" ", "a.date", "a.time"), "yyyy-MM-dd HH:mm:ss").alias("date"), F.col("a.source.title").alias("source_feed_name"))
    if documents is not None:
        articles = articles.join(documents.select("id").distinct(), "id", "left_semi")
    articles = articles.dropDuplicates(["bag_id", "id"])
    b = bags.select("file", F.col("bag_id").alias("bag_b"))
    links = bags.select("file", "bag_id", "linked_as").join(b, "file").where(F.col("bag_id") != F.col("bag_b")).select(F.col("bag_id").alias("bag_a"), "bag_b", "linked_as").dropDuplicates(["bag_a", "bag_b"])
    return bags.select("bag_id", "lang", "event_id", "linked_as", F.transform("results", lambda x: x.id).alias("articles")), articles, links


def read_cross_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_a, doc_b, positive) of a tab-separated file without header; a later line on a pair replaces an earlier one."""
    lines = spark.read.csv(path, sep="\t", schema="doc_a string, doc_b string, verdict string").withColumn("at", F.monotonically_increasing_id())
    return lines.groupBy("doc_a", "doc_b").agg((F.max_by("verdict", "at") == "positive").alias("positive"))


def gold_pairs(links: DataFrame, articles: DataFrame) -> DataFrame:
    """(doc_a, doc_b, verdict) for each pair of articles of linked bags."""
    a = articles.select(F.col("bag_id").alias("bag_a"), F.col("id").alias("doc_a"))
    b = articles.select(F.col("bag_id").alias("bag_b"), F.col("id").alias("doc_b"))
    return links.join(a, "bag_a").join(b, "bag_b").where(F.col("doc_a") != F.col("doc_b")).select("doc_a", "doc_b", F.col("linked_as").alias("verdict")).distinct()


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select("doc_a", "doc_b", "verdict").write.mode("append").csv(path, sep="\t")


def turn_links(bags: DataFrame, turns: DataFrame) -> DataFrame:
    """Gold pairs over conversations: a conversation is a bag, its turns are the articles, and it is linked with itself, as
    positive if it has more than four turns."""
    links = bags.select(F.col("conv_id").alias("bag_a"), F.col("conv_id").alias("bag_b"), F.when(F.col("turns") > 4, "positive").otherwise("negative").alias("linked_as"))
    articles = turns.select(F.col("conv_id").alias("bag_id"), F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"))
    return gold_pairs(links, articles)


def group_pairs(docs: DataFrame, group: str = "label", key: str = "id", bound: int = 1000) -> DataFrame:
    """Ordered pairs of different documents of one gold group, as positive.  Groups above ``bound`` are refused: their pairs
    grow with the square of their size, and evaluation does not need them (it counts from the contingency table)."""
    sizes = docs.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    if not sizes.where(F.col("n") > bound).isEmpty():
        raise ValueError(f"a group has more than {bound} documents")
    a, b = docs.select(group, F.col(key).alias("doc_a")), docs.select(group, F.col(key).alias("doc_b"))
    return a.join(b, group).where(F.col("doc_a") != F.col("doc_b")).select("doc_a", "doc_b", F.lit("positive").alias("verdict"))
