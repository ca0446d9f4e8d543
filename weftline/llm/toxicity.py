"""Toxicity by weak supervision.

Voters are mined from a bounded sample of labelled rows: words and word beginnings that go with the label (a lexicon), and
patterns (no entry, several entries, dense entries, shouting).  A generative label model estimates each voter's accuracy by
expectation-maximisation, the given label being one more, fallible voter, and discounts voters by how much they agree with
each other within a class.  Its posterior labels train a linear classifier, which scores every document from its text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import drop_written, written

#: labelled rows that are read, about
FIT_ROWS = 9000
#: lexicon entries of the classifier, lexicon voters of the label model
ENTRIES, VOTERS = 600, 60
MIN_SUPPORT = 4
_STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
#: how often the given label is taken to be right at first
LABEL_ACCURACY = 0.95


def features(word: str) -> list[str]:
    """The word itself and its beginnings, marked apart."""
    return [f"={word}", *(f"^{word[:k]}" for k in _STEMS if len(word) >= k)]


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


@dataclass
class Model:
    lexicon: tuple[str, ...]
    #: of the entries' presence, then of ``summary``, then the constant
    weight: np.ndarray

    def __post_init__(self):
        self.place = {e: i for i, e in enumerate(self.lexicon)}
        self.known: dict[str, tuple[int, ...]] = {}

    def hits(self, counts: Counter) -> tuple[dict[int, int], int]:
        """Entry -> occurrences, and the number of words hit.  What is remembered of words is bounded."""
        if len(self.known) > 500_000:
            self.known.clear()
        out: dict[int, int] = {}
        hit = 0
        for w, n in counts.items():
            e = self.known.get(w)
            if e is None:
                e = self.known[w] = tuple(i for f in features(w) if (i := self.place.get(f)) is not None)
            if e:
                hit += n
                for i in e:
                    out[i] = out.get(i, 0) + n
        return out, hit

    def vector(self, text: str | None) -> tuple[list[int], list[float]]:
        """(entries present, summary): distinct and total words hit, their share, shouting and exclamation marks."""
        counts = words_of(text)
        found, hit = self.hits(counts)
        n = max(1, sum(counts.values()))
        letters = sum(len(w) * c for w, c in counts.items()) if hit else 0
        upper = sum(map(str.isupper, text)) if text and hit else 0
        return sorted(found), [float(bool(hit)), float(np.log1p(hit)), float(np.log1p(100.0 * hit / n)), float(np.log1p(len(found))), upper / max(1, letters)]

    def score(self, text: str | None) -> float:
        present, summary = self.vector(text)
        k = len(self.lexicon)
        z = self.weight[present].sum() + float(np.dot(self.weight[k:-1], summary)) + self.weight[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of label 1, accuracy by voter, weight of each voter against correlation).

    votes: (rows, voters) of 1, 0, -1 (abstains); given: 0 or 1."""
    n, m = votes.shape
    p = np.where(given == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY)
    alone = np.ones(m)
    onehot = np.stack([votes == v for v in (-1, 0, 1)]).astype(float)  # (vote, rows, voters)
    for _ in range(rounds):
        like = np.stack([(np.einsum("r,vrm->vm", w, onehot) + 0.5) / (w.sum() + 1.5) for w in (1 - p, p)])  # (class, vote, voter)
        right = np.stack([((1 - p) @ (given == 0) + 2) / ((1 - p).sum() + 2.1), (p @ (given == 1) + 2) / (p.sum() + 2.1)])
        cast = (votes >= 0).astype(float)
        # what a vote says beyond what its class makes likely; voters that go together in that are partly one voter
        beyond = onehot[2] - onehot[1] - np.stack([like[0, 2] - like[0, 1], like[1, 2] - like[1, 1]])[(p > 0.5).astype(int)]
        spread = np.sqrt((beyond**2).mean(axis=0))
        corr = np.abs(beyond.T @ beyond / n) / np.maximum(np.outer(spread, spread), 1e-6)
        np.fill_diagonal(corr, 0)
        alone = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(axis=1))
        prior = np.clip(p.mean(), 1e-4, 1 - 1e-4)
        step = np.log(like[1]) - np.log(like[0])  # (vote, voter)
        z = np.log(prior / (1 - prior)) + np.einsum("vrm,vm,m->r", onehot, step, alone)
        z += np.where(given == 1, np.log(right[1] / (1 - right[0])), np.log((1 - right[1]) / right[0]))
        new = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        if np.abs(new - p).max() < 1e-4:
            break
        p = new
    accuracy = (onehot[2] * p[:, None] + onehot[1] * (1 - p)[:, None]).sum(axis=0) / np.maximum(1, cast.sum(axis=0))
    return p, accuracy, alone


def train_linear(x: list[list[int]], dense: np.ndarray, y: np.ndarray, k: int, ridge: float = 1.0, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels: k presence weights, dense weights, constant.  Accelerated gradient steps."""
    n = len(y)
    at = np.repeat(np.arange(n), [len(r) for r in x])
    col = np.fromiter((i for r in x for i in r), np.int64, len(at))
    d = np.hstack([dense, np.ones((n, 1))])
    w = np.zeros(k + d.shape[1])
    w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    penalty = np.concatenate([np.full(k, ridge * 4), np.full(dense.shape[1], ridge * 0.05), [0.0]])
    v, scale = w.copy(), 0.25 * ((np.bincount(at, minlength=n) + (d**2).sum(axis=1)).mean()) * n / 4 + penalty.max()
    for t in range(rounds):
        z = np.bincount(at, weights=v[col], minlength=n) + d @ v[k:]
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.concatenate([np.bincount(col, weights=g[at], minlength=k), d.T @ g]) + penalty * v
        new = v - grad / scale
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def fit(docs: DataFrame, labels: DataFrame, train, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Learn from ``rows`` different labelled texts at most, for which ``train`` holds, those of the least hashes.

    Labels other than 0 and 1 are left out; a key, or a text, with several labels counts as its largest; copies of a text count once, however many rows
    a key has.  Without labelled rows, or with one label only, the model has no entries and scores all alike."""
    labels = labels.where(train & F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max(label).cast("int").alias("__y"))
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("__id"), F.col(text).alias("t"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("__t"))
    told = texts.select("__id", "__t").distinct().join(labels, F.col("__id") == F.col("__k")).groupBy("__t").agg(F.max("__y").alias("y"))
    few = told.orderBy(F.xxhash64("__t"), "__t").limit(rows).withColumnRenamed("__t", "__f")  # a digest and a number each
    sample = written(texts.join(F.broadcast(few), F.col("__t") == F.col("__f")).groupBy("__f").agg(F.min("t").alias("t"), F.max("y").alias("y")).select("t", "y"), "toxicity")

    def count(batches):
        n, k = Counter(), Counter()

        def flush():
            names = list(n)
            return pa.RecordBatch.from_pydict({"f": pa.array(names, pa.string()), "n": pa.array([n[i] for i in names], pa.int64()), "k": pa.array([k[i] for i in names], pa.int64())})

        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen = {f for w in words_of(t) for f in features(w)}
                n.update(seen)
                if y:
                    k.update(seen)
                if len(n) > 300_000:
                    yield flush()
                    n, k = Counter(), Counter()
        yield flush()

    total, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    base = (toxic + 1e-9) / max(1, total)
    if toxic == 0 or toxic == total:
        drop_written(sample)
        return Model((), np.array([0.0] * 5 + [float(np.log((toxic + 0.5) / (total - toxic + 0.5)))]))
    tally = sample.mapInArrow(count, "f string, n long, k long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    z = (F.col("k") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base) + 1)
    best = tally.where((F.col("n") >= MIN_SUPPORT) & ((F.col("k") + 2 * base) / (F.col("n") + 2) >= 0.6)).withColumn("z", z).where("z > 3").orderBy(F.desc("z"), "f").limit(ENTRIES).collect()
    found = Model(tuple(r.f for r in best), np.zeros(len(best) + 6))

    def vectors(batches):
        for b in batches:
            made = [found.vector(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array([m[0] for m in made], pa.list_(pa.int32())), "d": pa.array([m[1] for m in made], pa.list_(pa.float64())), "y": b.column(1)})

    got = sample.mapInArrow(vectors, "x array<int>, d array<double>, y int").toArrow().to_pydict()
    drop_written(sample)
    x, dense, y = got["x"], np.array(got["d"]).reshape(-1, 5), np.array(got["y"])
    weight = train_linear(x, dense, label_model(_ballots(found.lexicon, x, dense), y)[0], len(found.lexicon))
    return Model(found.lexicon, weight)


def _ballots(lexicon: tuple[str, ...], x: list[list[int]], dense: np.ndarray) -> np.ndarray:
    """Votes of the strongest entries that do not begin one another, and of the patterns."""
    chosen: list[int] = []
    for i, e in enumerate(lexicon):
        if len(chosen) < VOTERS and not any(e[1:].startswith(lexicon[c][1:]) or lexicon[c][1:].startswith(e[1:]) for c in chosen):
            chosen.append(i)
    votes = np.full((len(x), len(chosen) + 5), -1, np.int8)
    slot = {e: c for c, e in enumerate(chosen)}
    for r, row in enumerate(x):
        for e in row:
            if e in slot:
                votes[r, slot[e]] = 1
    hit, total, share, kinds, upper = dense.T
    at = len(chosen)
    votes[:, at] = np.where(hit == 0, 0, -1)
    votes[:, at + 1] = np.where(total >= np.log1p(2), 1, -1)
    votes[:, at + 2] = np.where(share >= np.log1p(1.0), 1, np.where(share < np.log1p(0.05), 0, -1))
    votes[:, at + 3] = np.where(kinds >= np.log1p(4), 1, -1)
    votes[:, at + 4] = np.where(upper > 0.6, 1, -1)
    return votes


def predict(docs: DataFrame, model: Model, keep_columns: list[str], text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``keep_columns`` with ``score`` and ``predicted``.  Null and empty texts get the score of a text without words.

    A row is judged by its own text alone; the model is of bounded size."""
    sent = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.weight))
    order = [f for f in docs.schema if f.name in keep_columns and f.name not in ("score", "predicted")]
    names = [f.name for f in order]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in order), "score double, predicted int"])

    def run(batches):
        m = Model(*sent.value)
        for b in batches:
            s = [m.score(t) for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())], names=[*names, "score", "predicted"])

    return docs.select(*names, F.col(text).alias("__text")).mapInArrow(run, schema)
