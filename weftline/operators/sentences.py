"""Sentence bounds learned from the texts themselves.

A period ends a sentence, an abbreviation, or both.  Counts over all texts tell which, by log-likelihood ratios as in the published unsupervised method
of Kiss and Strunk: a word that hardly ever stands without its period, and is short, is an abbreviation; a word that stands after periods more often
than by chance begins sentences; two words around a period that belong together are no bound.  Counting is one pass of grouped sums; what
is kept of it is bounded by parameters and does not grow with the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.texts import MAX_CHARS, MAX_WORDS
from weftline.sources.scratch import written

#: fixed values: least scores of an abbreviation, a collocation and a sentence starter
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: entries that are kept of each kind, those of the best scores
ENTRIES = 20_000
#: fixed value: what may stand around a word
_OPENING, _CLOSING = "\"'([{«“‘", "\"')]}»”’,;:"
_LEAD, _TRAIL = (f"[{re.escape(c)}]+" for c in (_OPENING, _CLOSING))
#: bytes of paragraphs whose words are counted at once
CHUNK_BYTES = 1 << 24
#: line breaks that are no white space to Java, whose ``$`` stands before one at the end, too
_BREAKS = ("\x85", "\u2028", "\u2029")
_END = "(?=[\\x85\\u2028\\u2029]?\\Z)"


@dataclass(frozen=True)
class Bounds:
    abbreviations: frozenset[str] = frozenset()
    starters: frozenset[str] = frozenset()
    pairs: frozenset[tuple[str, str]] = frozenset()
    #: words that stand with a small first letter, and with a large one only where a sentence may begin
    small: frozenset[str] = frozenset()


def _types(raw: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Different words without what stands around them, of each of ``raw`` which it is, and of each word whether it ends in a period and whether in any of .!?"""
    bare = pc.utf8_rtrim(pc.utf8_ltrim(raw, characters=_OPENING), characters=_CLOSING)
    odd = np.logical_or.reduce([pc.ends_with(raw, b).to_numpy(zero_copy_only=False) for b in _BREAKS])
    if odd.any():
        by_hand = [re.sub(_TRAIL + _END, "", re.sub(f"^{_LEAD}", "", x)) for x in raw.filter(pa.array(odd)).to_pylist()]
        bare = pc.replace_with_mask(bare, pa.array(odd), pa.array(by_hand, bare.type))
    coded = bare.dictionary_encode()
    words = coded.dictionary
    shorn = words
    if odd.any():
        shorn = pc.if_else(pc.match_substring_regex(words, f"[{''.join(_BREAKS)}]$"), pc.utf8_slice_codeunits(words, 0, -1), words)
    dot = pc.ends_with(shorn, ".").to_numpy(zero_copy_only=False)
    ends = dot | pc.ends_with(shorn, "!").to_numpy(zero_copy_only=False) | pc.ends_with(shorn, "?").to_numpy(zero_copy_only=False)
    return words, coded.indices.to_numpy(), dot, ends


def _tallied(paragraphs: pa.Array) -> pa.RecordBatch:
    """(x, next, dot, mid, n): how often a word stands before the next one, which counts only after a period, and behind a word that ends no sentence."""
    lists = pc.ascii_split_whitespace(paragraphs)
    coded = pc.list_flatten(lists).dictionary_encode()
    words, which, dot, ends = _types(coded.dictionary)
    x, of = which[coded.indices.to_numpy()].astype(np.int64), pc.list_parent_indices(lists).to_numpy()
    full = (pc.binary_length(words).to_numpy() > 0)[x]
    x, of = x[full], of[full]
    beside = of[1:] == of[:-1]
    follows, mid = np.full(len(x), -1, np.int64), np.zeros(len(x), bool)
    follows[:-1] = np.where(beside & dot[x[:-1]], x[1:], -1)
    mid[1:] = beside & ~ends[x[:-1]]
    key, n = np.unique(((x * (len(words) + 1)) + follows + 1) * 2 + mid, return_counts=True)
    mid, key = (key & 1).astype(bool), key >> 1
    x, follows = key // (len(words) + 1), key % (len(words) + 1) - 1
    return pa.RecordBatch.from_arrays([words.take(pa.array(x)), words.take(pa.array(follows, mask=follows < 0)), pa.array(dot[x]), pa.array(mid), pa.array(n)], names=["x", "next", "dot", "mid", "n"])


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 256):
            held.append(b.column(0).slice(at, 256))
            size += held[-1].nbytes
            if size >= CHUNK_BYTES:
                yield _tallied(pa.concat_arrays(held))
                held, size = [], 0
    if held:
        yield _tallied(pa.concat_arrays(held))


def _log(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(1e-12)))


def _binomial(k: Column, n: Column, p: Column) -> Column:
    return k * _log(p) + (n - k) * _log(1 - p)


def _together(both: Column, a: Column, b: Column, n: Column) -> Column:
    """The log-likelihood ratio of a and b coming together ``both`` times in ``n``."""
    p, p1, p2 = b / n, both / a, (b - both) / F.greatest(n - a, F.lit(1))
    return -2 * (_binomial(both, a, p) + _binomial(b - both, n - a, p) - _binomial(both, a, p1) - _binomial(b - both, n - a, p2))


def counts(paragraphs: DataFrame) -> DataFrame:
    """(word, dot, follower, large, small, inside, n): how often a word (in small letters, without its period) stands with a period or not, before which word
    if it has one and whether that begins with a large letter, with a small first letter or not, and with a large one inside of a sentence; from
    (p) paragraphs."""
    each = paragraphs.select("p").mapInArrow(_tallies, "x string, next string, dot boolean, mid boolean, n long")
    large = lambda c: F.col(c).rlike(r"^\p{Lu}")
    word = lambda c: F.lower(F.regexp_replace(c, r"[.!?]+$", ""))
    rows = each.select(word("x").alias("word"), "dot", word("next").alias("follower"), large("next").alias("large"), F.col("x").rlike(r"^\p{Ll}").alias("small"), (large("x") & F.col("mid")).alias("inside"), "n")
    return rows.groupBy("word", "dot", "follower", "large", "small", "inside").agg(F.sum("n").alias("n"))


def learn(paragraphs: DataFrame, entries: int = ENTRIES) -> Bounds:
    """The bounds of (p) paragraphs.  Without periods nothing is learned; null and empty paragraphs have no words."""
    table = written(counts(paragraphs.where(F.col("p").isNotNull())), "words")
    n, dots = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("dot"), F.col("n"))), F.lit(0))).first()
    if not dots:
        return Bounds()
    total, share = F.lit(float(n)), F.lit(dots / n)
    sum_of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("double")
    words = written(table.groupBy("word").agg(F.sum("n").cast("double").alias("n"), sum_of(F.col("dot")).alias("with"), sum_of(F.col("inside")).alias("inside"), sum_of(F.col("small")).alias("small")), "types")
    length = F.length(F.replace("word", F.lit("."))).cast("double")
    ratio = -2 * (_binomial(F.col("with"), F.col("n"), share) - _binomial(F.col("with"), F.col("n"), F.lit(0.99)))
    score = ratio * F.exp(-length) * (F.length("word") - length + 1) * F.pow(length, -(F.col("n") - F.col("with")))
    able = F.col("word").rlike(r"\p{L}") & (F.col("with") > 0)
    best = lambda df, of, least: [r.word for r in df.withColumn("s", of).where(F.col("s") >= least).orderBy(F.desc("s"), "word").limit(entries).collect()]
    abbreviations = best(words.where(able), score, ABBREVIATION)
    known = words.sparkSession.createDataFrame([(a,) for a in abbreviations], "a string")
    free = table.where("dot AND follower IS NOT NULL").join(F.broadcast(known), F.col("word") == F.col("a"), "left_anti")  # periods that are no abbreviation's
    ends = float(free.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    begun = free.groupBy(F.col("follower").alias("f")).agg(F.sum("n").cast("double").alias("begun"))
    starters = words.join(begun, F.col("word") == F.col("f")).where(F.col("word").rlike(r"^\p{L}") & (F.col("begun") / F.col("n") > F.lit(ends) / total)) if ends else words.withColumn("begun", F.lit(0.0)).limit(0)
    starters = best(starters, _together(F.col("begun"), F.lit(max(ends, 1.0)), F.col("n"), total), STARTER)
    pairs = table.where("dot AND follower IS NOT NULL").groupBy("word", "follower").agg(F.sum("n").cast("double").alias("both")).where("both > 1")
    sizes = words.select(F.col("word").alias("w"), F.col("n").alias("a"))
    pairs = pairs.join(sizes, F.col("word") == F.col("w")).drop("w").join(sizes.select(F.col("w").alias("v"), F.col("a").alias("b")), F.col("follower") == F.col("v"))
    pairs = pairs.where((F.col("both") / F.col("a") > F.col("b") / total) & F.col("word").rlike(r"\p{L}|^\d+$")).withColumn("s", _together(F.col("both"), F.col("a"), F.col("b"), total)).where(F.col("s") >= COLLOCATION)
    pairs = [(r.word, r.follower) for r in pairs.orderBy(F.desc("s"), "word", "follower").limit(entries).collect()]
    named = table.where("dot AND large").join(F.broadcast(known), F.col("word") == F.col("a"), "left_semi").select(F.col("follower").alias("f")).distinct()  # as names are, behind abbreviations
    after_dot = table.where("dot AND follower IS NOT NULL").select("follower").distinct()
    small = words.where("small > 0 AND inside = 0").join(after_dot, F.col("word") == F.col("follower"), "left_semi").join(named, F.col("word") == F.col("f"), "left_anti")
    small = [r.word for r in small.orderBy(F.desc("small"), "word").limit(entries).select("word").collect()]
    return Bounds(frozenset(abbreviations), frozenset(starters), frozenset(pairs), frozenset(small))


_WORD = re.compile(r"\S+")


def _stripped(word: str) -> str:
    return word.rstrip(_CLOSING).lstrip(_OPENING)


def cut(text: str, known: Bounds) -> list[str]:
    """The sentences of a text, without the white space around them.

    A word that ends in ! or ?, or in a period, ends a sentence, but for: an abbreviation, an initial or a number before a word with a small letter or a
    word that does not begin sentences; any period before a small letter; a pair of words that belongs together."""
    out, begin, words = [], 0, list(_WORD.finditer(text))
    for i, w in enumerate(words):
        b = w[0].rstrip(_CLOSING)
        if not b.endswith((".", "!", "?")):
            continue
        b, after = b.lstrip(_OPENING), _stripped(words[i + 1][0]) if i + 1 < len(words) else ""
        if b.endswith(".") and after:
            word, follower = b.rstrip(".!?").lower(), after.rstrip(".!?").lower()
            if after[:1].islower() or (word, follower) in known.pairs and follower not in known.starters:
                continue
            short = word in known.abbreviations or len(word) == 1 and word.isalpha() or word.isdigit()
            if short and follower not in known.starters and not (word in known.abbreviations and follower in known.small and after[:1].isupper()):
                continue
        out.append(text[begin : w.end()].strip())
        begin = w.end()
    return [s for s in [*out, text[begin:].strip()] if s]


def sentences(rows: DataFrame, known: Bounds, paragraph: str = "p") -> DataFrame:
    """``rows`` with ``sentences``: the whole paragraph if it is short enough for an encoder, else those of its first 4096 characters."""
    sent = rows.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("array<string>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda p: [] if p is None else [p] if len(p.split()) <= MAX_WORDS else cut(p[:MAX_CHARS], sent.value))

    return rows.withColumn("sentences", made(F.col(paragraph)))
