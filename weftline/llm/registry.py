"""The corpus operators as registered queries: thin forms with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.llm import chat, decontamination, langid, lines, oracles, packing, prefixes, quality, repair, repeats, sharding, simhash, toxicity, wrappers
from weftline.llm.common import table, training_row, written


def op1_line_dedup(spark, sf_dir):
    """Lines of every document, and those like an earlier line (by doc_id, nulls first) that go; see :func:`weftline.llm.lines.dedup`."""
    kept = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), floor=1)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_html_extraction(spark, sf_dir):
    """Main text of every page: null and empty pages give the empty text; see :func:`weftline.llm.wrappers.main_text`."""
    return wrappers.main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op3_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of every document: null texts and those without words have fingerprint zero and are one component; repeated rows
    come back as often; null ids count for nothing in the smallest id."""
    prints = written(simhash.fingerprints(table(spark, sf_dir, "documents"), ["doc_id"]), "prints")
    return simhash.cluster(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language_id(spark, sf_dir):
    """Predicted language of every document, learned from the training rows: null texts and those without a letter are und; repeated rows are
    predicted alike."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, training_row())
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", (~training_row()).alias("held_out"), "lang_pred", "score", "shares")


def op5_sharding(spark, sf_dir):
    """Shard of every document by its id alone: equal ids share one, null ids count as the empty text."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


def op6_suffix_array_dedup(spark, sf_dir):
    """A row for each document; ``text`` is what stays, parts of cut characters replaced."""
    kept = repeats.strip(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op7_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from the training rows: null and empty texts are scored like any other, by the model's prior; repeated
    rows are scored alike."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), training_row())
    return toxicity.predict(docs, model, ["doc_id"]).select("doc_id", (~training_row()).alias("held_out"), "score", "predicted")


def op8_best_fit_packing(spark, sf_dir):
    """Pieces of every document in sequences: null and empty texts are one piece, the end mark; repeated rows are packed as often as they come."""
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_quality_rules(spark, sf_dir):
    """Statistics and verdict of every document: null and empty texts have no words and are not kept; repeated rows are judged alike."""
    judged = quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", *quality.STATS, "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op10_decontamination(spark, sf_dir):
    """Benchmark words in every document: null and empty texts have none and are clean; repeated rows are measured alike."""
    measured = decontamination.measure(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return measured.select("doc_id", F.col("__n").alias("n_words"), "n_hit", "n_items", "items_sha256", "contaminated")


def op11_chat_formatting(spark, sf_dir):
    """Every conversation, and conversation -7 (which joins one of that id that the table may have), written and read back: rows go by turn
    (nulls first), then by role and text; null roles and texts are empty; rows without a conv_id are one conversation; repeated rows are
    written as often as they come."""
    said = F.lit("\\### Assistant: </turn> ok")
    made = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(made)
    records = rows.select(F.struct("conv_id", "turn").alias("key"), F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    turns = chat.canonical(records).select(F.col("key.conv_id").alias("conversation"), F.col("key.turn").alias("turn"), "place", "role", "text")
    return chat.read_back(chat.formatted(turns, ["turn", "place"])).withColumnRenamed("conversation", "conv_id")


def op12_conversation_repair(spark, sf_dir):
    """Every conversation, damaged and repaired: rows without a conv_id are one conversation, nulls are one space, rows of equal turns go by role
    and a digest of role and text; conversations whose rows are all dropped have zeros; see :mod:`weftline.llm.repair`."""
    rows = repair.damaged(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation"), "turn", "role", "text"))
    return repair.digests(repair.repaired(rows, F.col("gone"))).withColumnRenamed("conversation", "conv_id")


def op13_prefix_trie(spark, sf_dir):
    """The nodes of the trie of all rebuilt conversations: turns go by turn (nulls first), then by role and text (nulls last); null roles and texts are
    empty; rows without a conv_id are left out; an empty table has no nodes; see :mod:`weftline.llm.prefixes`."""
    nodes = prefixes.trie(prefixes.rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), by_text=True))
    return nodes.withColumnsRenamed({"conversation": "conv_id", "parent": "parent_conv_id"})


def queries():
    import corpus_pipeline

    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return {**found, "pipeline": corpus_pipeline.run}


_OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, dw.n, i, item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
n_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN items USING (r)
"""


def oracle_sql():
    return {"op10_decontamination": _OP10_SQL, "op11_chat_formatting": oracles.OP11, "op12_conversation_repair": oracles.OP12, "op13_prefix_trie": oracles.OP13}
