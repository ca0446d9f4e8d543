"""Quality rules under weak supervision.

Each rule looks at a document's statistics and votes good (1), bad (0) or abstains (-1).  Nobody says which rules to trust:
expectation-maximisation over the table of vote patterns estimates how often each rule votes how for good and for bad
documents, and a document is kept by its posterior probability of being good, not by passing every rule.

One pass reads the texts and writes the statistics and votes to the shared folder.  Vote patterns are counted from there (at
most ``3 ** len(RULES)`` rows reach the driver, whatever the corpus), and each row is scored by itself: only the counts of
patterns move through a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import released, written

#: fixed value: the characters that count as symbols
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_ENDS = (".", "!", "?", "…", '"', "”", ":", ";")
MIN_WORDS = 50

STATS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}
_EXTRA = ("n_lines", "n_upper", "n_ascii_letters", "n_shouts", "n_ended", "n_distinct", "n_bytes", "n_letter_bytes", "n_plain", "n_top")
#: a word of letters with one mark after it at most
_PLAIN = re.compile(rb"(?<![^\x20\x09-\x0D])[A-Za-z\x80-\xFF'-]+[.,;:?!]?(?![^\x20\x09-\x0D])")
_WORDLIKE = _LETTERS + bytes(range(128, 256))


def _count(raw: bytes, of: bytes) -> int:
    return len(raw) - len(raw.translate(None, of))


def text_stats(text: str | None) -> tuple[int, ...]:
    """The five base statistics, then those that only rules use.  None counts as a text without words."""
    if not text:
        return (0,) * (len(STATS) + len(_EXTRA))
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() parts at 0x20 and 0x09 to 0x0D only
    spaces = _count(raw, b" \t\n\x0b\x0c\r")
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    n, repeated = len(words), 0
    if n > 3:
        triples = list(zip(words, words[1:], words[2:]))
        if len(set(triples)) < len(triples):
            seen, end = Counter(triples), 0  # first word not counted yet
            for i, t in enumerate(triples):
                if seen[t] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return (
        n, len(text) - spaces, _count(raw, SYMBOLS), len(lines) - len(set(lines)), repeated,
        len(lines), _count(raw, _UPPER), _count(raw, _LETTERS), _count(raw, b"!"), sum(x.rstrip().endswith(_END_BYTES) for x in lines), len(once := Counter(words)),
        len(raw) - spaces, _count(raw, _WORDLIKE), len(_PLAIN.findall(raw)), max(once.values(), default=0),
    )


_END_BYTES = tuple(x.encode() for x in _ENDS)


@dataclass(frozen=True)
class Rule:
    """Good when ``ratio`` is in [good_from, good_to], bad when outside [bad_below, bad_above], else no vote."""

    name: str
    good: tuple[float, float]
    bad: tuple[float, float]


INF = float("inf")
RULES = (
    Rule("symbols", (-INF, 0.02), (-INF, 0.1)),
    Rule("letters", (0.93, INF), (0.8, INF)),
    Rule("plain_words", (0.9, INF), (0.7, INF)),
    Rule("word_length", (3.2, 9.0), (2.5, 12.0)),
    Rule("upper_case", (-INF, 0.2), (-INF, 0.4)),
    Rule("shouting", (-INF, 0.03), (-INF, 0.15)),
    Rule("repetition", (-INF, 0.1), (-INF, 0.3)),
    Rule("duplicate_lines", (-INF, 0.05), (-INF, 0.3)),
    Rule("variety", (0.3, INF), (0.12, INF)),
    Rule("top_word", (-INF, 0.15), (-INF, 0.25)),
    Rule("ended_lines", (0.6, INF), (0.2, INF)),
)


def ratios(stats: np.ndarray) -> np.ndarray:
    """(documents, rules); nan where a rule has nothing to judge."""
    n, chars, sym, dup, rep, lines, upper, letters, shouts, ended, distinct, size, wordlike, plain, top = stats.T.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = [
            sym / n, wordlike / size, plain / n, chars / n, np.where(letters >= 20, upper / letters, np.nan), shouts / n,
            rep / n, np.where(lines >= 3, dup / lines, np.nan), np.where(n >= 20, distinct / np.sqrt(n * 100.0), np.nan),
            np.where(n >= 20, top / n, np.nan), np.where(lines >= 2, ended / lines, np.nan),
        ]
    return np.stack([np.where(n > 0, x, np.nan) for x in out], axis=1)


def votes(stats: np.ndarray) -> np.ndarray:
    """(documents, rules) of 1, 0 and -1."""
    r = ratios(stats)
    good = np.stack([(r[:, i] >= k.good[0]) & (r[:, i] <= k.good[1]) for i, k in enumerate(RULES)], axis=1)
    bad = np.stack([(r[:, i] < k.bad[0]) | (r[:, i] > k.bad[1]) for i, k in enumerate(RULES)], axis=1)
    return np.where(good, 1, np.where(bad, 0, -1)).astype(np.int8)


def base_failed(stats: np.ndarray) -> np.ndarray:
    n, rep = stats[:, 0], stats[:, 4]
    return (n < MIN_WORDS) | (100 * rep > 50 * n)


@dataclass(frozen=True)
class LabelModel:
    prior: float
    #: log P(vote | good) - log P(vote | bad), (rules, 3), column ``vote + 1``
    weight: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        z = np.log(self.prior / (1 - self.prior)) + self.weight[np.arange(v.shape[1]), v + 1].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns.

    The prior belief about a rule, worth a tenth of all documents: a good document seldom gets its bad vote, a bad one gets
    it in two of five cases (a rule sees some kinds of bad documents only).  A rule is never taken to be worse than chance
    (its good votes do not count against a document), which keeps the two classes from changing places.  No patterns: the
    model is the prior belief."""
    k, weight = len(RULES), counts.astype(float)
    belief = np.tile(np.array([[0.1, 0.4, 0.5], [0.13, 0.02, 0.85]])[:, None, :], (1, k, 1))  # (class, rule, vote + 1)
    prior, like = 0.9, belief

    def ratio():
        w = np.log(like[1]) - np.log(like[0])
        w[:, 2], w[:, 1] = np.maximum(w[:, 2], 0), np.minimum(w[:, 1], 0)
        w[:, 0] = 0  # an abstention says nothing
        return w

    if not len(patterns):
        return LabelModel(prior, ratio())
    onehot = patterns[:, :, None] + 1 == np.arange(3)
    for _ in range(rounds):
        good = LabelModel(prior, ratio()).posterior(patterns)
        mass = np.stack([(1 - good) * weight, good * weight])
        like = np.einsum("cp,prv->crv", mass, onehot) + belief * (1 + 0.1 * weight.sum())
        like /= like.sum(axis=2, keepdims=True)
        new = float(np.clip(mass[1].sum() / weight.sum(), 0.02, 0.98))
        if abs(new - prior) < 1e-9:
            break
        prior = new
    return LabelModel(prior, ratio())


def _stats_of(column: pa.Array) -> np.ndarray:
    return np.array([text_stats(t) for t in column.to_pylist()], dtype=np.int64).reshape(-1, len(STATS) + len(_EXTRA))


def judge(docs: DataFrame, keep_columns: list[str] | None = None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``keep_columns`` (all, if not given) with the statistics, ``base_failed``, ``quality`` (posterior) and ``kept``.

    Null and empty texts have no words: they fail the base limits and are not kept.  Documents that fail the base limits take
    no part in the fit.  Repeated rows are judged each by itself, alike.  Columns of the same names as the results are
    replaced.  An empty table gives no rows."""
    made = [*STATS, "base_failed", "quality", "kept"]
    order = [f for f in docs.schema if f.name in (keep_columns or docs.columns) and f.name not in [*made, "__votes"]]
    names = [f.name for f in order]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in order), *(f"{k} {v}" for k, v in STATS.items()), "base_failed boolean, __votes binary"])

    def measure(batches):
        for b in batches:
            s = _stats_of(b.column(len(names)))
            ballots = pa.array([bytes(x) for x in (votes(s) + 1).astype(np.uint8)], pa.binary())
            columns = [b.column(i) for i in range(len(names))] + [pa.array(s[:, i]) for i in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(base_failed(s)), ballots], names=[*names, *STATS, "base_failed", "__votes"])

    measured = written(docs.select(*names, F.col(text).alias("__text")).mapInArrow(released(measure), schema), "quality")
    rows = measured.where(~F.col("base_failed")).groupBy("__votes").agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = np.array([list(r["__votes"]) for r in sorted(rows)], dtype=np.int8).reshape(-1, len(RULES)) - 1
    model = fit(patterns, np.array([r.n for r in sorted(rows)], dtype=float))
    vote = [F.conv(F.hex(F.substring("__votes", i + 1, 1)), 16, 10).cast("int") for i in range(len(RULES))]
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for v, w in zip(vote, model.weight):
        odds = odds + F.when(v == 2, float(w[2])).when(v == 1, float(w[1])).otherwise(float(w[0]))
    posterior = 1 / (1 + F.exp(-odds))
    return measured.withColumn("quality", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).select(*names, *made)
