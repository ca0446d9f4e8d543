"""Language identification by mixture inference.

A document is a mixture of languages.  Each language is a distribution over hashed byte trigrams, learned from labelled
documents; expectation-maximisation finds the proportions of the mixture for one document, and the set of languages that
take part is chosen by penalised likelihood: a language is added only while the gain in log-likelihood is above the price
of one more parameter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS = 1 << 16
#: labelled documents per language that are read to fit the distributions
FIT_ROWS = 1500


def trigrams(text: str) -> np.ndarray:
    """Bucket of each byte trigram of the lower-cased text, runs of other than letters being one space."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)
    letter = (raw >= 128) | ((raw >= 97) & (raw <= 122))
    keep = letter | np.concatenate([[True], letter[:-1]])
    raw = np.where(letter, raw, 32)[keep].astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.uint32)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    #: (languages, buckets) probabilities
    like: np.ndarray


def mixture(like: np.ndarray, weight: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood for one document; like: (languages, distinct trigrams)."""
    k = like.shape[0]
    if k == 1:
        return np.ones(1), float(weight @ np.log(like[0]))
    share = np.full(k, 1 / k)
    for _ in range(rounds):
        joint = share[:, None] * like
        new = (joint / joint.sum(axis=0)) @ weight
        new /= new.sum()
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(weight @ np.log(share @ like))


def infer(model: Model, text: str | None, price: float = 1.0) -> tuple[str, float, list[float]]:
    """(language, score, proportions).  ``und``, 0 and no proportions for None, for a text without any letter, and where no
    language was learned.  Ties go to the language that comes first in the alphabet."""
    if not text or not model.langs or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, []
    grams = trigrams(text)
    if not len(grams):
        return UNKNOWN, 0.0, []
    counts = np.bincount(grams, minlength=BUCKETS) if len(grams) > 4000 else None
    if counts is not None:
        seen = np.flatnonzero(counts)
        weight = counts[seen].astype(float)
    else:
        seen, weight = np.unique(grams, return_counts=True)
        weight = weight.astype(float)
    like = model.like[:, seen].astype(float)
    single = np.log(like) @ weight
    chosen = [int(np.argmax(single))]
    share, best = np.ones(1), float(single[chosen[0]])
    cost = price * 0.5 * np.log(weight.sum() + 1) + 4.0
    while len(chosen) < len(model.langs):
        rest = [i for i in range(len(model.langs)) if i not in chosen]
        # the gain of a small share of each further language bounds which one to try
        now = share @ like[chosen]
        gain = [float(weight @ np.log(0.85 * now + 0.15 * like[i])) for i in rest]
        i = rest[int(np.argmax(gain))]
        if max(gain) < best - 0.2 * weight.sum():
            break
        new, fit = mixture(like[[*chosen, i]], weight)
        if fit - best <= cost:
            break
        chosen, share, best = [*chosen, i], new, fit
    full = np.zeros(len(model.langs))
    full[chosen] = share
    top = int(np.argmax(full))
    return model.langs[top], float(min(1.0, full[top])), full.tolist()


def fit(docs: DataFrame, train, text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> Model:
    """Learn from the rows where ``train`` holds and ``lang`` is not null.

    About ``rows`` different texts of each language are read (all, where there are fewer): those whose hash is in the lowest
    part of the hash range, the part being ``rows`` over the language's number of different texts.  Copies count once.
    Rows without text teach nothing."""
    name, spread = F.col(lang).cast("string"), F.xxhash64(F.col(text))
    able = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r.l: r.n for r in able.select(name.alias("l"), spread.alias("h")).distinct().groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model((), np.zeros((0, BUCKETS), np.float32))
    langs = tuple(sorted(counts))
    inside = F.lit(False)
    for k in langs:
        inside = inside | ((name == k) & (F.shiftrightunsigned(spread, 11) <= int(min(1.0, rows / counts[k]) * (1 << 53))))

    def count(batches):
        total = np.zeros((len(langs), BUCKETS), np.int64)
        place = {k: i for i, k in enumerate(langs)}
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = trigrams(t)
                total[place[k]] += np.bincount(g, minlength=BUCKETS)
        row, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(row.astype(np.int32)), "b": pa.array(bucket.astype(np.int32)), "n": pa.array(total[row, bucket])})

    one = able.where(inside).groupBy(name.alias("l"), spread.alias("h")).agg(F.first(text).alias("t"))
    cells = one.select("l", "t").mapInArrow(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(langs), BUCKETS))
    total[cells.column("k").to_numpy(), cells.column("b").to_numpy()] = cells.column("n").to_numpy()
    # what a language never showed gets a little of what all showed, and of every bucket
    shared = total.sum(axis=0) + 0.5
    shared /= shared.sum()
    total += 0.02 * total.sum(axis=1, keepdims=True) * shared + 1e-6
    return Model(langs, (total / total.sum(axis=1, keepdims=True)).astype(np.float32))


def predict(docs: DataFrame, model: Model, keep_columns: list[str], text: str = "text") -> DataFrame:
    """``keep_columns`` with ``lang_pred``, ``score`` (share of that language) and ``shares`` (of all learned languages).

    A row is judged by its own text alone; nothing moves through a shuffle.  The model is of fixed size."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(model)
    order = [f for f in docs.schema if f.name in keep_columns and f.name not in ("lang_pred", "score", "shares")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in order), "lang_pred string, score double, shares array<double>"])
    names = [f.name for f in order]

    def score(batches):
        m = sent.value
        for b in batches:
            found = [infer(m, t) for t in b.column(len(names)).to_pylist()]
            columns = [b.column(i) for i in range(len(names))]
            columns += [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score", "shares"])

    return docs.select(*names, F.col(text).alias("__text")).mapInArrow(score, schema)
