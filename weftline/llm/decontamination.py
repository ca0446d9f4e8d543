"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every ``WINDOW - GRAM + 1`` successive word ``GRAM``-grams, the one with the smallest hash is kept.  A span of ``WINDOW``
words that a document shares with a benchmark item holds such a run of grams, and both sides keep the same one, so each
shared span shows up as an equal hash.  A hit is extended to the windows around it: those that begin up to ``WINDOW - GRAM`` words before the
shared gram, each held against the windows of all items by a digest of 128 bits.  That takes a row for each word of a document with hits, however
often a gram comes back in it or in an item.

Items shorter than a window are one window by themselves; winnowing promises nothing for them, so the documents' grams of just their lengths
(twelve at most) are compared, unthinned, in the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import drop_written, written

WINDOW = 13
GRAM = 7
#: fixed value: ASCII characters that part words; letters A-Z are lower-cased
_BETWEEN = "".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _BETWEEN
_TO = "abcdefghijklmnopqrstuvwxyz" + " " * len(_BETWEEN)
#: rows of (long) that may be broadcast: 16 MB at most
BROADCAST_ROWS = 1_000_000


def normal(text: Column) -> Column:
    """The words of ``text`` with one space between them, null as the empty text."""
    return F.array_join(F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _FROM, _TO), " "), ""), " ")


def words(norm: Column) -> Column:
    return F.array_remove(F.split(norm, " "), "")


def let(value: Column, of) -> Column:
    """``of(value)`` with ``value`` worked out once: inside a lambda an expression would be worked out for each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def grams(hashes: Column, n: int, kind: int = 0) -> Column:
    """The hash of each run of ``n`` words, from the words' hashes; empty if there are fewer.  Hashes of another ``kind`` are others."""
    none = F.array().cast("array<bigint>")
    return let(hashes, lambda h: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(F.lit(kind), *(F.get(h, i + k) for k in range(n))))).otherwise(none))


def chosen(hashes: Column, span: int) -> Column:
    """The smallest gram of each ``span`` successive ones (of all, if there are fewer), each value once."""
    if span == 1:
        return F.array_distinct(hashes)
    lows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - span), lambda i: F.least(*(F.get(h, i + k) for k in range(span))))
    return let(hashes, lambda h: F.array_distinct(F.when(F.size(h) > span, lows(h)).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(h)))


def word_hashes(of: Column, kind: int = 0) -> Column:
    return F.transform(of, lambda w: F.xxhash64(w, F.lit(kind)))


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is known to be small; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def named(text: Column) -> Column:
    """What stands for a text in joins: all that is measured hangs on the text alone, so copies are measured once."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _digested(n: int, places: Column) -> Column:
    """(n, start, a, b) of the windows at ``places``, from the words' hashes."""
    told = lambda g: F.transform(places, lambda i: F.struct(F.lit(n).alias("n"), i.cast("int").alias("start"), F.get(g["a"], i).alias("a"), F.get(g["b"], i).alias("b")))
    return let(F.struct(grams(F.col("__h"), n, n).alias("a"), grams(F.col("__i"), n, n).alias("b")), told)


def _windows(df: DataFrame, lengths: list[int], where: dict[int, Column], keep: list[str]) -> DataFrame:
    """(``keep``, n, start, a, b): the windows of ``n`` words that begin at the places ``where[n]`` (an array), with their digests (a, b)."""
    hashed = df.withColumn("__h", word_hashes(F.col("__words"))).withColumn("__i", word_hashes(F.col("__words"), 1))
    parts = [_digested(n, where[n]) for n in lengths]
    return hashed.select(*keep, F.inline(F.concat(*parts)))


def _places(size: Column, n: int) -> Column:
    """All places at which a window of ``n`` words can begin."""
    return F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(F.array().cast("array<int>"))


def hits(docs: DataFrame, bench: DataFrame, key: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """From documents (text): (__row, start, stop) of words inside benchmark windows (spans may overlap), (__row, __norm of the item) once for each
    pair, and the tables that both are read from; __row is the text's name (:func:`named`)."""
    base = docs.select(named(F.col("text")).alias("__row"), normal(F.col("text")).alias("__norm"))
    items = bench.select(normal(F.col(text)).alias("i_norm")).where("i_norm <> ''").distinct()
    items = written(items.withColumn("__words", words(F.col("i_norm"))).withColumn("__n", F.least(F.size("__words"), F.lit(WINDOW))), "items")
    lengths = sorted(r["__n"] for r in items.select("__n").distinct().collect())  # thirteen at most
    if not lengths:
        none = base.sparkSession.createDataFrame([], "__row string, i_norm string, start int, stop int")
        drop_written(items)
        return none.drop("i_norm"), none.select("__row", "i_norm"), []
    span = WINDOW - GRAM + 1
    marks = lambda h: F.concat(*(chosen(grams(h, GRAM), span) if n == WINDOW else F.array_distinct(grams(h, n, n)) for n in lengths))
    own = {n: chosen(grams(F.col("__h"), GRAM), span) if n == WINDOW else grams(F.col("__h"), n, n) for n in lengths}
    kinds = written(items.withColumn("__h", word_hashes(F.col("__words"))).select("__n", F.explode(_of_length(own)).alias("h")).distinct(), "kinds")
    few = _small(kinds)
    # every text is hashed once, and looked up for all lengths at once
    found = base.select("__row", word_hashes(words(F.col("__norm"))).alias("__h")).select("__row", F.explode(marks(F.col("__h"))).alias("h")).join(few, "h")
    found = written(found.groupBy("__row").agg(F.collect_set("__n").alias("ns")), "found")
    near = base.join(_small(found.select("__row")), "__row", "left_semi").dropDuplicates(["__row"])
    near = written(near.select("__row", words(F.col("__norm")).alias("__words")).join(_small(found.withColumnRenamed("__row", "__f")), F.col("__row") == F.col("__f")).drop("__f"), "near")
    parts = []
    if WINDOW in lengths:
        places = near.where(F.array_contains("ns", WINDOW)).select("__row", F.posexplode(grams(word_hashes(F.col("__words")), GRAM)).alias("at", "h")).join(_small(kinds.where(F.col("__n") == WINDOW).select("h")), "h", "left_semi")
        places = places.groupBy(F.col("__row").alias("__p")).agg(F.collect_list("at").alias("at"))
        last = F.size("__words") - WINDOW
        reach = lambda at: F.when(last >= 0, F.filter(F.sequence(at - (span - 1), at), lambda i: (i >= 0) & (i <= last))).otherwise(F.array().cast("array<int>"))
        around = near.join(places, F.col("__row") == F.col("__p"))
        parts.append(_windows(around, [WINDOW], {WINDOW: F.array_distinct(F.flatten(F.transform("at", reach)))}, ["__row"]))
    short = [n for n in lengths if n < WINDOW]
    if short:
        none = F.array().cast("array<int>")
        parts.append(_windows(near.where(F.exists("ns", lambda n: n < WINDOW)), short, {n: F.when(F.array_contains("ns", n), _places(F.size("__words"), n)).otherwise(none) for n in short}, ["__row"]))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    whole = written(_windows(items, lengths, {n: F.when(F.col("__n") == n, _places(F.size("__words"), n)).otherwise(F.array().cast("array<int>")) for n in lengths}, ["i_norm"]).select("i_norm", "n", "a", "b").distinct(), "windows")
    hit = written(every.join(_small(whole.select("n", "a", "b").distinct()), ["n", "a", "b"], "left_semi"), "spans")
    pairs = hit.select("__row", "n", "a", "b").distinct().join(_small(whole), ["n", "a", "b"]).select("__row", "i_norm").distinct()
    for done in (items, kinds, found, near):
        drop_written(done)
    return hit.select("__row", "start", (F.col("start") + F.col("n")).alias("stop")).distinct(), pairs, [hit, whole]


def _of_length(own: dict[int, Column]) -> Column:
    """The array of ``own`` for the length in ``__n``."""
    (n, first), *rest = own.items()
    out = F.when(F.col("__n") == n, first)
    for n, value in rest:
        out = out.when(F.col("__n") == n, value)
    return out


def measure(docs: DataFrame, bench: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``__n`` (words), n_hit, n_items, items_sha256 and contaminated, names that ``prefix`` goes before.

    A word is hit if it is inside any occurrence of a window of any item.  Null and empty texts have no words and are clean;
    items without words are passed over; an item listed twice counts twice if its ids differ; null ids are not listed.
    Repeated documents are measured alike.  Columns of ``docs`` with the names of the results are replaced."""
    made = [f"{prefix}{k}" for k in ("__n", "n_hit", "n_items", "items_sha256", "contaminated")]
    kept = [c for c in docs.columns if c not in made]
    spans, pairs, tables = hits(docs.select(F.col(text).alias("text")), bench, item_key, item_text)
    n_hit = spans.select("__row", F.explode(F.sequence("start", F.col("stop") - 1)).alias("w")).distinct().groupBy("__row").agg(F.count(F.lit(1)).alias("n_hit"))
    ids = bench.where(F.col(item_key).isNotNull()).select(F.col(item_key).cast("string").alias("id"), normal(F.col(item_text)).alias("n2")).distinct()
    listed = pairs.join(ids, F.col("i_norm") == F.col("n2")).groupBy("__row").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    listed = listed.select("__row", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    both = written(n_hit.join(listed, "__row", "left"), "hits")
    for t in tables:
        drop_written(t)
    rows = docs.select(F.struct(F.lit(0).alias("__0"), *(F.col(f"`{c}`") for c in kept)).alias("__doc"), named(F.col(text)).alias("__name"), F.size(words(normal(F.col(text)))).cast("long").alias("__words"))
    out = rows.join(_small(both), F.col("__name") == F.col("__row"), "left")
    hit = F.coalesce("n_hit", F.lit(0))
    values = (F.col("__words"), hit, F.coalesce("n_items", F.lit(0)).cast("long"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)), (hit > 0) & (20 * hit >= F.col("__words")))
    return out.select(*(F.col(f"__doc.`{c}`").alias(c) for c in kept), *(v.alias(k) for v, k in zip(values, made)))
