"""The best clusters of documents, exactly, without scoring the whole pool.

The active pool, which the settings bound, is cut to blocks of clusters that point the same way.  For a document and a block, the angles to the block's
centre and its radius bound the cosines, its range of times bounds the decays, and so the rank of any cluster in it.  Blocks are visited from the best
bound on, until no bound reaches the k-th rank found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weftline.config import ClusterConfig
from weftline.sources.models import LinearModel
from weftline.streaming.kernel import size_bin

#: clusters of a block; what rounding may add to a bound
BLOCK, SLACK = 32, 1e-7
#: slot of a cosine feature -> the cluster's vector and the document's
COSINES = {0: ("main", "main"), 5: ("par", "par"), 6: ("tp", "tp"), 7: ("main", "par"), 8: ("main", "tp")}
TIMES = {1: "newest_h", 2: "oldest_h", 3: "stamp_h"}


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors by their lengths (those without stay zero), and which have one."""
    size = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0), size[..., 0] > 0


@dataclass
class Blocks:
    """The pool by blocks: ``rows`` are the clusters of each, the other arrays have a row for each block."""

    cid: list
    unit: dict[str, np.ndarray]
    time: dict[str, np.ndarray]
    bins: np.ndarray
    mean_sim: np.ndarray
    rows: list[np.ndarray]
    centre: dict[str, np.ndarray]
    radius: dict[str, np.ndarray]
    hole: dict[str, np.ndarray]
    span: dict[str, tuple[np.ndarray, np.ndarray]]


def _cut(unit: np.ndarray, times: np.ndarray, weight: tuple[float, float], days: float) -> Iterator[np.ndarray]:
    """Blocks of rows that a rank hardly tells apart: a part is cut where it is wider, by direction (nearer to one of two far ones or to the other) or by time
    (in the middle), as much as either counts in a rank, until it is narrow or has an eighth of a block."""
    waiting = [np.arange(len(unit))] if len(unit) else []
    while waiting:
        part = waiting.pop()
        mean, _ = _unit(unit[part].sum(axis=0))
        turn = weight[0] * (1 - (unit[part] @ mean).min())
        time = weight[1] * (1 - np.exp(-((np.ptp(times[part]) / 24) ** 2) / (2 * days**2)))
        if len(part) <= BLOCK // 8 or len(part) <= BLOCK and max(turn, time) < 0.05 * sum(weight):
            yield part
            continue
        if time > turn:
            order, at = np.argsort(times[part], kind="stable"), len(part) // 2
        else:
            a = part[np.argmin(unit[part] @ mean)]
            b = part[np.argmin(unit[part] @ unit[a])]
            lean = unit[part] @ (unit[a] - unit[b])
            order, at = np.argsort(lean, kind="stable"), int((lean <= 0).sum())
            at = at if 0 < at < len(part) else len(part) // 2
        waiting += [part[order[:at]], part[order[at:]]]


def blocks(pool: pd.DataFrame, model: LinearModel, cfg: ClusterConfig) -> Blocks:
    unit, there = {}, {}
    for v in ("main", "par", "tp"):
        unit[v], there[v] = _unit(np.array(pool[v].tolist(), dtype=float).reshape(len(pool), -1))
    time = {c: pool[c].to_numpy(float) for c in TIMES.values()}
    size = np.abs(model.weights)
    weight = (float(size[list(COSINES)].sum()), float(size[list(TIMES)].sum()) if cfg.use_timestamps else 0.0)
    rows = list(_cut(unit["main"], time["newest_h"], weight, cfg.gaussian_std_days))
    bins, sims = np.array([size_bin(n) for n in pool["n"]], dtype=float), pool["mean_sim"].to_numpy(float)
    centre, radius, hole = {}, {}, {}
    for v in unit:
        mean, _ = _unit(np.array([unit[v][r].sum(axis=0) for r in rows]).reshape(len(rows), -1))
        centre[v] = mean
        radius[v] = np.array([np.arccos(np.clip((unit[v][r] @ m)[there[v][r]].min(initial=1.0), -1, 1)) for r, m in zip(rows, mean)])
        hole[v] = np.array([not there[v][r].all() for r in rows], dtype=bool)
    low_high = lambda x: (np.array([x[r].min() for r in rows]), np.array([x[r].max() for r in rows]))
    span = {**{c: low_high(t) for c, t in time.items()}, "bins": low_high(bins), "mean_sim": low_high(sims)}
    return Blocks(pool["cid"].tolist(), unit, time, bins, sims, rows, centre, radius, hole, span)


class Searcher:
    def __init__(self, found: Blocks, model: LinearModel, cfg: ClusterConfig, k: int):
        self.b, self.w, self.bias, self.cfg, self.k = found, np.array(model.weights), model.bias, cfg, k
        used = {0, *((5, 7) if cfg.use_paragraph else ()), *((6, 8) if cfg.use_title_paragraph else ())}
        self.cosines = {s: v for s, v in COSINES.items() if s in used and self.w[s]}
        self.times = {s: c for s, c in TIMES.items() if cfg.use_timestamps and self.w[s]}

    def _decay(self, hours):
        return np.exp(-((hours / 24) ** 2) / (2 * self.cfg.gaussian_std_days**2))

    def bounds(self, doc: dict[str, np.ndarray], hours: float) -> np.ndarray:
        """The highest rank that a cluster of each block can have."""
        b, out = self.b, np.full(len(self.b.rows), self.bias)
        for slot, (theirs, mine) in self.cosines.items():
            if doc[mine].any():
                angle = np.arccos(np.clip(b.centre[theirs] @ doc[mine], -1, 1))
                high, low = np.cos(np.maximum(0, angle - b.radius[theirs])), np.cos(np.minimum(np.pi, angle + b.radius[theirs]))
                none = ~b.centre[theirs].any(axis=1)  # opposite vectors: no centre
                high, low = np.where(none, 1.0, high), np.where(none, -1.0, low)
                high, low = np.where(b.hole[theirs], np.maximum(high, 0), high), np.where(b.hole[theirs], np.minimum(low, 0), low)
            else:
                high = low = np.zeros(len(out))
            out += np.maximum(self.w[slot] * (1 + high), self.w[slot] * (1 + low))
        for slot, c in self.times.items():
            first, last = b.span[c]
            near, far = np.maximum(0, np.maximum(first - hours, hours - last)), np.maximum(np.abs(hours - first), np.abs(hours - last))
            out += np.maximum(self.w[slot] * self._decay(near), self.w[slot] * self._decay(far))
        if self.cfg.use_density:
            out += np.maximum(*(self.w[9] * x for x in b.span["bins"]))
        if self.cfg.use_mean_similarity:
            out += np.maximum(*(self.w[10] * (1 + x) for x in b.span["mean_sim"]))
        return out + SLACK

    def ranks(self, doc: dict[str, np.ndarray], hours: float, rows: np.ndarray) -> np.ndarray:
        b, out = self.b, np.full(len(rows), self.bias)
        for slot, (theirs, mine) in self.cosines.items():
            out += self.w[slot] * (1 + b.unit[theirs][rows] @ doc[mine])
        for slot, c in self.times.items():
            out += self.w[slot] * self._decay(hours - b.time[c][rows])
        if self.cfg.use_density:
            out += self.w[9] * b.bins[rows]
        if self.cfg.use_mean_similarity:
            out += self.w[10] * (1 + b.mean_sim[rows])
        return out

    def best(self, doc: dict[str, np.ndarray], hours: float) -> tuple[list[tuple[float, object]], int]:
        """((rank, cid) of the k best, how many clusters were scored); of equal ranks, to nine digits, the lowest cid first."""
        bounds, found, scored = self.bounds(doc, hours), [], 0
        for at in np.argsort(-bounds, kind="stable"):
            if len(found) == self.k and bounds[at] < found[-1][0]:
                break
            rows = self.b.rows[at]
            scored += len(rows)
            found = sorted([*found, *((float(s), self.b.cid[r]) for s, r in zip(self.ranks(doc, hours, rows), rows))], key=lambda x: (-round(x[0], 9), x[1]))[: self.k]
        return found, scored


def top_clusters(docs: DataFrame, pool: DataFrame, model: LinearModel, k: int, cfg: ClusterConfig = ClusterConfig()) -> DataFrame:
    """(doc, place, cid, rank, scored): the ``k`` best clusters of each document (doc, h, main, par, tp), from place 1, and how many clusters of the pool
    were scored to find them.  Null or empty vectors are zero; documents are judged on their own, so that any number of tasks takes part.

    The pool (cid, n, newest_h, oldest_h, stamp_h, mean_sim, main, par, tp) is what one machine keeps active, ``cfg.pool_size`` clusters at most; a larger
    one is refused, not broadcast."""
    if (size := pool.count()) > cfg.pool_size:
        raise ValueError(f"{size} clusters; the active pool holds {cfg.pool_size}")
    held = pool.select("cid", "n", *TIMES.values(), "mean_sim", "main", "par", "tp").toPandas()
    kinds = {f.name: f.dataType for f in (docs.schema["doc"], pool.schema["cid"])}
    schema = StructType([StructField("doc", kinds["doc"]), StructField("place", LongType()), StructField("cid", kinds["cid"]), *StructType.fromDDL("rank double, scored long")])
    if not size:
        return docs.sparkSession.createDataFrame([], schema)
    sent = docs.sparkSession.sparkContext.broadcast(blocks(held, model, cfg))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Searcher(sent.value, model, cfg, k)
        dim = {v: m.shape[1] for v, m in sent.value.unit.items()}
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                vec = {v: _unit(np.asarray(x, dtype=float))[0] if (x := getattr(r, v)) is not None and len(x) else np.zeros(dim[v]) for v in dim}
                found, scored = search.best(vec, r.h)
                out += [(r.doc, n, cid, rank, scored) for n, (rank, cid) in enumerate(found, 1)]
            yield pd.DataFrame(out, columns=["doc", "place", "cid", "rank", "scored"])

    return docs.select("doc", "h", "main", "par", "tp").mapInPandas(run, schema)
