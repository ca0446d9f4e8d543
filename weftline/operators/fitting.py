"""Linear models from training lines: pairwise ranking and binary classification, with the penalty chosen on held-out queries."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import FEATURES

#: penalties that are tried, the heaviest first: of equals it stays
GRID = (1e3, 1e2, 10.0, 1.0, 0.1)
ROUNDS = 200


def parsed(lines: DataFrame, mask: tuple[int, ...]) -> DataFrame:
    """(qid, label, x): a line's query (its own number where it names none), label and feature slots."""
    used = [i for i, m in enumerate(mask) if m]

    def run(batches):
        for b in batches:
            qid, label, rows = [], [], []
            for line in b.column(0).to_pylist():
                head, *rest = line.split(" ")
                own = [c.split(":") for c in rest]
                x = [0.0] * len(FEATURES)
                for k, v in own:
                    if k != "qid":
                        x[used[int(k) - 1]] = float(v)
                qid.append(next((v for k, v in own if k == "qid"), None))
                label.append(int(head))
                rows.append(x)
            yield pa.RecordBatch.from_pydict({"qid": pa.array(qid, pa.string()), "label": pa.array(label, pa.int32()), "x": pa.array(rows, pa.list_(pa.float64()))})

    return lines.select("line").mapInArrow(run, "qid string, label int, x array<double>")


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, bias: bool) -> np.ndarray:
    """Newton's method on the penalised log-likelihood; classes weigh alike; the bias (last) is not penalised."""
    if bias:
        x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    weigh = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    ridge = np.full(x.shape[1], penalty * 1e-3)
    ridge[-1] = 1e-9 if bias else ridge[-1]
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (weigh * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-12), x.T @ (weigh * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _sample(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, label, whether held out) of ``most`` lines at most, picked by their hash, whole queries on one side."""
    n = rows.count()
    side = F.crc32(F.coalesce("qid", F.concat_ws(",", "x")).cast("binary")) % 5 == 0
    kept = rows.where(F.xxhash64("qid", "x") % 1_000_000 < int(1_000_000 * min(1.0, most / max(1, n)))).select("label", "x", "qid", side.alias("held")).orderBy("qid", "label", "x").limit(2 * most).toPandas()
    return np.array(kept["x"].tolist()).reshape(-1, len(FEATURES)), kept["label"].to_numpy(), kept["held"].to_numpy(bool)


def fit_classifier(lines: DataFrame, mask: tuple[int, ...], most: int = 200_000) -> tuple[np.ndarray, float, float]:
    """(weights, bias, held-out f1) of the penalty with the best f1 on a held-out fifth; fitted on ``most`` lines at most."""
    x, y, held = _sample(parsed(lines, mask), most)
    best = None
    for c in GRID:
        w = _logistic(x[~held], y[~held], c, True)
        said = x[held] @ w[:-1] + w[-1] > 0
        hit = (said & (y[held] == 1)).sum()
        f1 = 2 * hit / max(1, said.sum() + (y[held] == 1).sum())
        if best is None or f1 > best[2]:
            best = (w[:-1], float(w[-1]), float(f1))
    return best


def fit_ranking(lines: DataFrame, mask: tuple[int, ...], most: int = 200_000) -> tuple[np.ndarray, float]:
    """(weights, held-out error) from pairs of a query's positive line and one of its negatives: the weights of the penalty that puts the
    fewest held-out pairs in the wrong order."""
    rows = parsed(lines, mask)
    good = rows.where("label = 1").select("qid", F.col("x").alias("g"))
    pairs = rows.where("label = 0").join(good, "qid").select("qid", F.lit(1).alias("label"), F.zip_with("g", "x", lambda a, b: a - b).alias("x"))
    x, _, held = _sample(pairs, most)
    best = None
    for c in GRID:
        both = np.vstack([x[~held], -x[~held]])
        w = _logistic(both, np.repeat([1, 0], (~held).sum()), c, False)
        wrong = float((x[held] @ w <= 0).mean()) if held.any() else 0.0
        if best is None or wrong < best[1]:
            best = (w, wrong)
    return best


def write_model(path: str, weights: np.ndarray, bias: float | None = None) -> None:
    """A weight file: the bias in the first line where there is one, then name, tab, weight of the slots that are used."""
    lines = ([f"{bias:.4g}"] if bias is not None else []) + [f"{n}\t{w:.4g}" for n, w in zip(FEATURES, weights) if abs(w) > 1e-9]
    Path(path).write_text("\n".join(lines) + "\n")
