"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and gives what it keeps, in the same columns; the
last gives the packed pieces.  All rows of ``docs`` are judged and nothing else is read but ``benchmark``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontamination, lines, packing, quality, shingles
from weftline.llm.common import drop_written, table, written


def _parted(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` as one, out of the way of the names that operators use, and the text."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.judge(_parted(docs), ["__doc"]).where("kept").select("__doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier line go (earlier by doc_id), and ``n_chars`` follows; documents of which no line is left go too.

    Equal documents, and near copies that have lines of their own, are left to the near-dedup: they keep the lines that they have from
    the document of which they are copies (:func:`weftline.llm.lines.dedup`)."""
    kept = lines.dedup(docs, floor=1, counts=("__lines", "__gone"), copies=True)
    kept = kept.where(~((F.col("__gone") > 0) & (F.trim("text") == ""))).drop("__lines", "__gone")
    return (kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept).select(*(f"`{c}`" for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (:func:`weftline.llm.shingles.groups`) the document of the smallest id stays, of equal
    ids the first row.

    Documents without an id stay only in groups without any; texts without words form one group."""
    rows = written(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.monotonically_increasing_id().alias("__row")), "near")
    grouped = rows.select("__row", F.col("__doc.doc_id").alias("__id")).join(shingles.groups(rows.select("__row", "__doc.text"), "__row"), F.col("__row") == F.col("row"))
    best = grouped.groupBy("group").agg(F.min(F.struct(F.col("__id").isNull().alias("n"), "__id", "__row")).alias("b")).select(F.col("b.__row").alias("__keep"))
    return rows.join(best, F.col("__row") == F.col("__keep"), "left_semi").select("__doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a window of a benchmark item: thirteen words or more of one, or, of shorter items, so many that a
    twentieth of the document's words are hit."""
    measured = decontamination.measure(_parted(docs), table(spark, sf_dir, "benchmark"), prefix="__")
    return measured.where(~(F.col("__contaminated") | (F.col("__n_hit") >= decontamination.WINDOW))).select("__doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: where it lies in which sequence, with its ids (little-endian, 32 bits each)."""
    import public_tokenizers

    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"], with_ids=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate), ("best_fit_packing", pack)]

#: label models, similarity joins and tokenizers are beyond SQL; tests/llm hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.  Null and empty texts fail the quality rules; of rows
    with equal ids and texts the near-dedup keeps the first; an empty table gives no rows."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = written(stage(spark, docs, sf_dir), name), docs
        if name != STAGES[0][0]:
            drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
