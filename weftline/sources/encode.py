"""Text to vectors: a hashing encoder that needs no network, and the place to plug in another one."""

from __future__ import annotations

import hashlib
import re
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 512
_TOKEN = re.compile(r"[^\W\d_]+")

Encoder = Callable[[list[str]], np.ndarray]


def _bucket(gram: str) -> int:
    """The place of a gram, and beyond ``DIM`` that of one with a negative sign."""
    digest = hashlib.md5(gram.encode()).digest()
    return (digest[0] << 8 | digest[1]) % DIM + (DIM if digest[2] > 127 else 0)


def hash_encode(texts: list[str]) -> np.ndarray:
    """Signed counts of hashed word trigrams, 512 wide; texts of fewer than three words give a zero vector."""
    out = np.zeros((len(texts), DIM))
    known: dict[str, int] = {}
    for row, text in enumerate(texts):
        t = _TOKEN.findall((text or "").lower())
        places = []
        for gram in map(" ".join, zip(t, t[1:], t[2:])):
            place = known.get(gram)
            if place is None:
                place = known[gram] = _bucket(gram)
            places.append(place)
        if places:
            counts = np.bincount(places, minlength=2 * DIM)
            out[row] = counts[:DIM] - counts[DIM:]
    return out


class ServiceEncoder:
    """An encoder behind a service: ``post`` takes texts and gives their vectors.

    Where the service does not answer (a timeout, a lost connection) the call waits and is made again, without end unless ``attempts`` is
    given; any other failure is the caller's."""

    def __init__(self, post: Callable[[list[str]], list[list[float]]], wait_seconds: float = 600.0, attempts: int | None = None, sleep: Callable[[float], None] = time.sleep):
        self.post, self.wait, self.attempts, self.sleep = post, wait_seconds, attempts, sleep

    def __call__(self, texts: list[str]) -> np.ndarray:
        tried = 0
        while True:
            try:
                return np.asarray(self.post(texts), dtype=float)
            except (TimeoutError, ConnectionError):
                tried += 1
                if self.attempts is not None and tried >= self.attempts:
                    raise
                self.sleep(self.wait)


def in_order(calls: Iterable[Callable], width: int) -> Iterator:
    """What the ``calls`` give, in their order, with up to ``width`` of them under way at once.

    No call is begun that is more than ``width`` ahead of what has been taken, so a slow taker holds the service back, and what is in memory is bounded.  The first
    failure is raised in its place; those under way are waited for, none is begun after it."""
    if width <= 1:
        yield from (call() for call in calls)
        return
    with ThreadPoolExecutor(width) as pool:
        waiting: deque = deque()
        try:
            for call in calls:
                waiting.append(pool.submit(call))
                if len(waiting) >= width:
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()
        finally:
            for w in waiting:
                w.cancel()


def flattened(encoder: Encoder, groups: list[list[str]], size: int = 32, in_flight: int = 1) -> list[np.ndarray]:
    """The vectors of each group's texts.  The texts of all groups go to the encoder together, ``size`` at a time and ``in_flight`` requests at once, and come
    back to the groups by a cursor.  An encoder that is asked at once from several threads, and retries, does so for each request alone."""
    texts = [t for g in groups for t in g]
    parts = list(in_order((partial(encoder, texts[at : at + size]) for at in range(0, len(texts), size)), in_flight))
    whole = np.vstack(parts) if parts else np.zeros((0, DIM))
    ends = np.cumsum([len(g) for g in groups])
    return np.split(whole, ends[:-1]) if len(groups) else []


def summed(encoder: Encoder, groups: list[list[str]], heads: int, size: int = 32, in_flight: int = 1) -> list[tuple[list[np.ndarray], np.ndarray | None]]:
    """Of each group the vectors of its first ``heads`` texts, and the sum of those of its further texts (None without any).  Texts go to the encoder as in
    :func:`flattened`; what is held of a group does not grow with its texts."""
    out: list = [([], None) for _ in groups]
    places = ((g, k) for g, texts in enumerate(groups) for k in range(len(texts)))
    asked = lambda part: (part, encoder([groups[g][k] for g, k in part]))
    for part, vectors in in_order((partial(asked, part) for part in iter(lambda: list(islice(places, size)), [])), in_flight):
        at = 0
        while at < len(part):
            g, k = part[at]
            end = min(len(part), at + len(groups[g]) - k)
            heads_end = min(end, at + max(0, heads - k))
            first, rest = out[g]
            first.extend(vectors[at:heads_end])
            if heads_end < end:
                more = np.sum(vectors[heads_end:end], axis=0)
                out[g] = first, more if rest is None else rest + more
            at = end
    return out


def sentence_mean(encoder: Encoder, sentences: list[str]) -> np.ndarray:
    """A text's vector by its sentences: the mean of theirs."""
    return np.mean(encoder(sentences), axis=0)


def with_vectors(docs: DataFrame, encoder: Encoder = hash_encode, batch: int = 256, title: bool = False, in_flight: int = 1) -> DataFrame:
    """``docs`` (body, title) with main, par and tp vectors, and with ``title`` one of the title alone (title_repr), by Arrow batches.

    tp is of the title and the first paragraph, par of the first paragraph; main is the mean of tp and the further paragraphs, however many there are.
    The texts of a batch of documents are encoded together; ``in_flight`` requests of a task may be under way at once, which keeps it busy while a
    service thinks."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    made = ["main", "par", "tp", *(["title_repr"] if title else [])]
    schema = StructType([*docs.schema.fields, *(StructField(n, ArrayType(DoubleType())) for n in made)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), batch):
                f = whole.iloc[at : at + batch].copy()
                groups, main, par, tp, own = [], [], [], [], []
                for body, name in zip(f["body"], f["title"]):
                    parts = [p for p in (body or "").split("\n") if p.strip()]
                    groups.append([*([name or ""] if title else []), f"{name or ''} \n {parts[0]}" if parts else name or "", *parts])
                for g, (v, rest) in zip(groups, summed(encoder, groups, 3 if title else 2, 32 if encoder is not hash_encode else 4096, in_flight)):
                    if title:
                        own.append(v.pop(0))
                    tp.append(v[0])
                    par.append(v[1] if len(v) > 1 else np.zeros(len(v[0])))
                    main.append(v[0] if rest is None else (v[0] + rest) / (len(g) - (2 if title else 1)))
                f["main"], f["par"], f["tp"] = main, par, tp
                if title:
                    f["title_repr"] = own
                yield f

    return docs.mapInPandas(run, schema)


#: documents of a task that turns texts into rows
DEALT = 2048


def dealt(docs: DataFrame, key: str, count: int) -> DataFrame:
    """``docs`` (``count`` at most) by ``key``, so many to a task: cells whose keys hold ``key`` are added up where they arise, and what a task holds of them does
    not grow with the input.  Texts are moved, which are smaller than their cells."""
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-count // DEALT)), key)


def hashed_cells(docs: DataFrame, key: str | list[str], text: Column) -> DataFrame:
    """The same vectors in rows: (key, bucket, weight), weights of 0 left out."""
    keys = [key] if isinstance(key, str) else key
    tokens = docs.select(*keys, F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)).alias("t"))
    at = F.explode(F.expr("sequence(0, size(t) - 3)")).alias("i__")
    grams = tokens.where(F.size("t") >= 3).select(*keys, "t", at).select(*keys, F.concat_ws(" ", F.get("t", F.col("i__")), F.get("t", F.col("i__") + 1), F.get("t", F.col("i__") + 2)).alias("g"))
    digest = F.md5(F.col("g").cast("binary"))
    bucket = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % DIM
    sign = F.when(F.conv(F.substring(digest, 5, 1), 16, 10).cast("int") < 8, 1).otherwise(-1)
    return grams.select(*keys, bucket.alias("bucket"), sign.alias("s")).groupBy(*keys, "bucket").agg(F.sum("s").alias("weight")).where("weight <> 0")
