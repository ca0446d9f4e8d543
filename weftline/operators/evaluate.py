"""Evaluation of clusterings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from weftline.functions.scalars import pairs
from weftline.sources.scratch import written

#: fixed values: upper bounds of the cluster size histogram
DENSITY_BOUNDS = (1, 2, 5, 10, 25, 50, 100, 200, 500)
RECALL_AT = (1, 5, 10, 20, 50, 100)


def cooccurrence(labelled: DataFrame, keys: list[str] = [], gold: str = "gold", pred: str = "pred") -> DataFrame:
    return labelled.groupBy(*keys, gold, pred).agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def scores(counts: DataFrame) -> DataFrame:
    """``counts`` (tp, fp, fn, tn) with accuracy, precision, recall and f1, 0 where nothing was counted."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts.withColumn("acc", _ratio(tp + tn, tp + fp + fn + tn)).withColumn("p", _ratio(tp, tp + fp)).withColumn("r", _ratio(tp, tp + fn))
    return out.withColumn("f1", _ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))


def pair_scores(labelled: DataFrame, keys: list[str] = [], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Pairwise scores from the contingency table; long arithmetic, no pair is made."""
    cells = cooccurrence(labelled, keys, gold, pred)
    side = lambda c, name: cells.groupBy(*keys, c).agg(F.sum("n").alias("m")).groupBy(*keys).agg(F.sum(pairs(F.col("m"))).alias(name), F.count(F.lit(1)).alias(f"{name}_groups"))
    whole = cells.groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("tp"), pairs(F.sum("n")).alias("all"))
    rows, cols = side(gold, "by_gold"), side(pred, "by_pred")
    both = whole.join(rows, keys).join(cols, keys) if keys else whole.crossJoin(rows).crossJoin(cols)
    counts = both.select(*keys, "tp", (F.col("by_pred") - F.col("tp")).alias("fp"), (F.col("by_gold") - F.col("tp")).alias("fn"), (F.col("all") - F.col("by_pred") - F.col("by_gold") + F.col("tp")).alias("tn"), F.col("by_pred_groups").alias("n_clu"))
    return scores(counts)


def cross_pairs_scores(assigned: DataFrame, links: DataFrame, all_connections: bool = True) -> DataFrame:
    """Pair scores against a list of links (doc_a, doc_b, positive), both ways round.  ``assigned``: (doc_id, cluster_id).

    Only documents with links are sources.  A target in the source's cluster is right if linked positively, wrong if linked
    negatively or (``all_connections``) not linked; a linked target elsewhere is missed or rightly apart.  Counts are halved.
    The pairs inside clusters are counted by cluster, not made: those not listed are all less those listed."""
    place = assigned.select(F.col("doc_id").alias("d"), F.col("cluster_id").alias("c"))
    listed = links.join(place.withColumnRenamed("c", "ca"), F.col("doc_a") == F.col("d")).drop("d").join(place.withColumnRenamed("c", "cb"), F.col("doc_b") == F.col("d")).where(F.col("doc_a") != F.col("doc_b"))
    same, good = F.col("ca") == F.col("cb"), F.col("positive")
    told = listed.agg(*(F.count_if(x).alias(n) for x, n in ((same & good, "tp"), (same & ~good, "fp_l"), (~same & good, "fn"), (~same & ~good, "tn"), (same, "listed"))))
    sizes = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("m"))
    sources = links.select(F.col("doc_a").alias("doc_id")).distinct().join(assigned, "doc_id").join(sizes, "cluster_id").agg(F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("inside"), F.lit(0).alias("z"))
    n_clu = sizes.agg(F.count(F.lit(1)).alias("n_clu"))
    fp = F.col("fp_l") + (F.col("inside") - F.col("listed") if all_connections else F.lit(0))
    half = lambda c: F.floor(c / 2).cast("long")
    return scores(told.crossJoin(sources).crossJoin(n_clu).select(half(F.col("tp")).alias("tp"), half(fp).alias("fp"), half(F.col("fn")).alias("fn"), half(F.col("tn")).alias("tn"), "n_clu"))


def recall_at(positions: DataFrame, position: str = "position") -> DataFrame:
    """(k, recall): the share of documents whose gold cluster is among the first k, for each cut and for the highest place that there
    is (its k is that place + 1); a null position is a miss."""
    cuts = positions.agg(F.count(F.lit(1)).alias("all"), *(F.count_if(F.col(position) < k).alias(f"k{k}") for k in RECALL_AT), F.max(position).alias("highest"), F.count(position).alias("found"))
    rows = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), (F.col(f"k{k}") / F.col("all")).alias("recall")) for k in RECALL_AT), F.struct((F.col("highest") + 1).cast("long").alias("k"), (F.col("found") / F.col("all")).alias("recall")))
    return cuts.select(F.inline(rows)).where(F.col("k").isNotNull()).distinct()


def density_histogram(sizes: DataFrame, n: str = "n") -> DataFrame:
    """(bin, clusters) of cluster sizes, bins without clusters included; bin i ends at the i-th bound, the last has no end."""
    at = F.lit(len(DENSITY_BOUNDS))
    for i, b in reversed(list(enumerate(DENSITY_BOUNDS))):
        at = F.when(F.col(n) <= b, F.lit(i)).otherwise(at)
    bins = sizes.sparkSession.range(len(DENSITY_BOUNDS) + 1).withColumnRenamed("id", "bin")
    return bins.join(sizes.groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("m")), "bin", "left").select("bin", F.coalesce("m", F.lit(0)).cast("long").alias("clusters"))


def running(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums in the order of ``order``, the own row included.

    Rows are dealt to ranges of the order, summed by range, and each range starts from the total of those before it: one row a range
    meets in one task, not the rows themselves."""
    dealt = rows.select("*", *(c.alias(f"__{n}") for n, c in sums.items())).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    dealt = written(dealt, "ranges")  # they are looked at twice and must be the same ones
    totals = dealt.groupBy("__part").agg(*(F.sum(f"__{n}").alias(f"__t_{n}") for n in sums))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("__part").alias("__p"), *(F.col(f"__t_{n}") for n in sums)).select("__p", *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in sums))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(starts), F.col("__part") == F.col("__p"))  # a row for each range
    return out.select(*rows.columns, *((F.col(f"__s_{n}") + F.sum(f"__{n}").over(inside)).cast("long").alias(n) for n in sums))


def running_vectors(rows: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """``rows`` with ``column``, vectors of equal length, as the sum of it over the rows of the same ``key`` up to the own one in ``order``, and ``n``, how many
    these are.  Null vectors count as zero.

    Rows are dealt to ranges of (key, order).  A range sums up what it has of each key; a key that goes on over ranges starts each from the sum of those
    before, so that a key of any size is summed by many tasks: one row a range and key meets another."""
    dealt = written(rows.repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id()), "vectors")
    kind = dealt.schema[key].dataType.simpleString()
    names = [*rows.columns, "n"]

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for f in frames:
            for (part, k), g in f.groupby(["__part", key], sort=False, dropna=False):
                vectors = [v for v in g[column] if v is not None]
                n, total = held.get((part, k), (0, 0.0))
                held[part, k] = n + len(g), total + np.sum(vectors, axis=0) if vectors else total
        yield pd.DataFrame([(part, None if pd.isna(k) else k, n, np.atleast_1d(v)) for (part, k), (n, v) in held.items()], columns=["part", "k", "n", "v"])

    def before(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("part")
        n, total, out = 0, 0.0, []
        for r in f.itertuples():
            if n:
                out.append((r.part, r.k, n, np.atleast_1d(total)))
            n, total = n + r.n, total + r.v
        return pd.DataFrame(out, columns=["part", "k", "n", "v"])

    shape = f"part int, k {kind}, n long, v array<double>"
    found = dealt.select("__part", key, column).mapInPandas(sums, shape)
    # a range that a task has seen in pieces is put together first: few rows a range and key
    starts = found.groupBy("k").applyInPandas(_whole_then(before), shape).select(F.col("part").alias("__p"), F.col("k").alias("__k"), F.col("n").alias("__n"), F.col("v").alias("__v"))
    both = dealt.join(starts, (F.col("__part") == F.col("__p")) & F.col(key).eqNullSafe(F.col("__k")), "left").drop("__p", "__k")

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n, total = None, 0, 0.0
        for f in frames:
            out_n, out_v = [], []
            for part, k, v, start, first in zip(f["__part"], f[key], f[column], f["__v"], f["__n"]):
                name = part, None if pd.isna(k) else k
                if name != at:
                    at, n, total = name, 0 if pd.isna(first) else int(first), 0.0 if start is None else np.array(start, dtype=float)
                n, total = n + 1, total if v is None else total + v
                out_n.append(n)
                out_v.append(np.array(np.atleast_1d(total)))
            f = f.assign(n=out_n)
            f[column] = out_v
            yield f[names]

    schema = StructType([*(StructField(f.name, ArrayType(DoubleType())) if f.name == column else f for f in rows.schema.fields), StructField("n", LongType())])
    return both.repartition("__part").sortWithinPartitions("__part", key, *order).mapInPandas(add, schema)


def _whole_then(of):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        k = f["k"].iloc[0]
        rows = [(part, k, int(g["n"].sum()), sum(g["v"])) for part, g in f.groupby("part")]
        return of(pd.DataFrame(rows, columns=["part", "k", "n", "v"]))

    return run


def clusters_over_time(docs: DataFrame, order: str = "seq", cluster: str = "cid") -> DataFrame:
    """(seq, clusters): clusters begun so far."""
    first = docs.groupBy(cluster).agg(F.min(order).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("m"))
    marked = docs.select(F.col(order).alias("seq")).join(first, F.col("seq") == F.col("f"), "left").select("seq", "m")
    return running(marked, ["seq"], {"clusters": F.coalesce("m", F.lit(0))}).drop("m")


def toppling(events: DataFrame, order: str = "seq", sign: str = "sign") -> DataFrame:
    """(seq, ups, downs): running counts of +1 and -1 events."""
    rows = events.select(F.col(order).alias("seq"), F.col(sign).alias("sign"))
    return running(rows, ["seq"], {"ups": F.when(F.col("sign") > 0, 1).otherwise(0), "downs": F.when(F.col("sign") < 0, 1).otherwise(0)}).drop("sign")


def pair_scores_over_time(log: DataFrame, step: int = 1000) -> DataFrame:
    """Pairwise scores after every ``step`` documents and at the end, from a log (seq, doc_no, gold, pred, sign: 1 for an addition, -1
    for a removal; doc_no: the number of the document, from 1, at which the row was written).

    No state is rebuilt: a row changes the pairs of its cell, row and column of the contingency table by what stands there before
    it, so each count is a running sum over those changes."""
    point = (F.ceil(F.col("doc_no") / step) * step).cast("long")
    rows = log.select("seq", F.least(point, F.lit(2**62)).alias("at"), "gold", "pred", "sign")
    out = []
    for name, keys in (("tp", ["gold", "pred"]), ("by_gold", ["gold"]), ("by_pred", ["pred"])):
        so_far = F.coalesce(F.sum("sign").over(Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        step_of = rows.withColumn("had", so_far).withColumn("d", F.when(F.col("sign") > 0, F.col("had")).otherwise(1 - F.col("had")))
        groups = F.when((F.col("sign") > 0) & (F.col("had") == 0), 1).when((F.col("sign") < 0) & (F.col("had") == 1), -1).otherwise(0)
        out.append(step_of.groupBy("at").agg(F.sum("d").alias(name), F.sum(groups).alias(f"{name}_groups")))
    points = rows.groupBy("at").agg(F.sum("sign").alias("n"))
    for part in out:
        points = points.join(part, "at")
    over = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # a row for each step
    sums = points.select("at", *(F.sum(c).over(over).alias(c) for c in ("n", "tp", "by_gold", "by_pred", "by_pred_groups")))
    last = log.agg(F.max("doc_no").alias("last"))
    counts = sums.crossJoin(F.broadcast(last)).select(F.least("at", "last").alias("documents"), "tp", (F.col("by_pred") - F.col("tp")).alias("fp"), (F.col("by_gold") - F.col("tp")).alias("fn"), (pairs(F.col("n")) - F.col("by_pred") - F.col("by_gold") + F.col("tp")).alias("tn"), F.col("by_pred_groups").alias("n_clu"))
    return scores(counts)


def join_gain(labelled: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(s, t, separate_f1, joined_f1) for all ordered pairs of clusters that share a label: the local pair scores of the two apart and as
    one (:func:`local_f1`).  Pairs that share none gain nothing by joining and are left out.

    Worked out from sums of each cluster and one product for each pair; no list of documents is made."""
    cells = labelled.groupBy(F.col(pred).alias("c"), F.col(gold).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    every = cells.groupBy(F.col("l").alias("l2")).agg(F.sum("n").alias("every"))
    own = cells.join(every, F.col("l") == F.col("l2")).groupBy("c").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("square"), F.sum(F.col("n") * F.col("every")).alias("reach"))
    a, b = cells.select(F.col("c").alias("s"), "l", "n"), cells.select(F.col("c").alias("t"), F.col("l").alias("m"), F.col("n").alias("k"))
    both = a.join(b, (F.col("l") == F.col("m")) & (F.col("s") != F.col("t"))).groupBy("s", "t").agg(F.sum(F.col("n") * F.col("k")).alias("shared"))
    for k in "st":
        both = both.join(own.select(F.col("c").alias(f"c_{k}"), *(F.col(x).alias(f"{x}_{k}") for x in ("size", "square", "reach"))), F.col(k) == F.col(f"c_{k}"))
    size, square, reach = ([F.col(f"{x}_s"), F.col(f"{x}_t")] for x in ("size", "square", "reach"))

    def f1(tp, fp, fn):
        p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
        return _ratio(2 * p * r, p + r)

    apart = f1(square[0] + square[1] - size[0] - size[1], size[0] * size[0] + size[1] * size[1] - square[0] - square[1], reach[0] + reach[1] - square[0] - square[1])
    one, whole = square[0] + square[1] + 2 * F.col("shared"), size[0] + size[1]
    return both.select("s", "t", apart.alias("separate_f1"), f1(one - whole, whole * whole - one, reach[0] + reach[1] - one).alias("joined_f1"))


def local_f1(labelled: DataFrame, candidates: list, joined: bool = False, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Local pair scores of the candidate clusters against all clusters that share labels with them; ``joined``: as if the
    candidates were one cluster."""
    inside = F.col(pred).isin(candidates)
    key = F.when(inside, F.lit("candidates")).otherwise(F.col(pred).cast("string")) if joined else F.col(pred).cast("string")
    cells = labelled.groupBy(key.alias("c"), F.col(gold).alias("l")).agg(F.count(F.lit(1)).alias("n"), F.max(inside).alias("mine"))
    total = cells.groupBy("c").agg(F.sum("n").alias("size"))
    label = cells.groupBy("l").agg(F.sum("n").alias("everywhere"))
    mine = cells.where("mine").join(total, "c").join(label, "l")
    n, size, out = F.col("n"), F.col("size"), F.col("everywhere") - F.col("n")
    sums = mine.agg(F.sum(n * (n - 1)).alias("tp"), F.sum(n * (size - n)).alias("fp"), F.sum(n * out).alias("fn"))
    counts = sums.select(*(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    return counts.withColumn("p", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", _ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("f1", _ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
