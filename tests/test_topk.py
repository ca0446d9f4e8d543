"""Pruned search for the best clusters against scoring all of them."""

import numpy as np
import pytest

from weftline.config import ClusterConfig
from weftline.operators import features as X
from weftline.operators.topk import top_clusters
from weftline.sources.models import load_merge, load_rank

CFG = ClusterConfig()


def rows(rng, n, dim, centers, spread):
    out = []
    for i in range(n):
        c = centers[rng.integers(len(centers))]
        vec = [(c + rng.normal(scale=spread, size=dim)).tolist() if rng.random() > 0.03 else [0.0] * dim for _ in range(3)]
        out.append((i, float(rng.uniform(0, 900)), *vec))
    return out


@pytest.mark.parametrize("cfg", [CFG, ClusterConfig(use_density=True, use_mean_similarity=True, use_timestamps=False), ClusterConfig(use_paragraph=False)])
def test_same_as_all(spark, cfg):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(15, 16))
    pool = [(100 + i, int(rng.integers(1, 60)), h, h - float(rng.uniform(0, 90)), h - 10.0, float(rng.uniform(0, 1)), *v) for i, h, *v in rows(rng, 600, 16, centers, 0.15)]
    pool += [(900 + k, *pool[k][1:]) for k in range(5)]  # ties
    docs = spark.createDataFrame(rows(rng, 40, 16, centers, 0.2), "doc long, h double, main array<double>, par array<double>, tp array<double>")
    pool = spark.createDataFrame(pool, "cid long, n long, newest_h double, oldest_h double, stamp_h double, mean_sim double, main array<double>, par array<double>, tp array<double>")
    for model in (load_rank(CFG.rank_model), load_merge(CFG.merge_model)):
        got = top_clusters(docs, pool, model, 7, cfg).collect()
        every = X.score_pool(docs, pool, model, cfg).select("d_doc", "c_cid", "rank").collect()
        for d in range(40):
            want = sorted(((-round(r["rank"], 9), r.c_cid) for r in every if r.d_doc == d))[:7]
            mine = sorted((r for r in got if r.doc == d), key=lambda r: r.place)
            assert [r.cid for r in mine] == [c for _, c in want] and [-r["rank"] for r in mine] == pytest.approx([s for s, _ in want], abs=1e-8)
        if cfg is CFG:
            print("share", np.mean([r.scored for r in got]) / 605)
            assert np.mean([r.scored for r in got]) < 0.5 * 605, model


def test_small_and_empty_pools(spark):
    docs = spark.createDataFrame([(1, 0.0, [1.0], None, [])], "doc long, h double, main array<double>, par array<double>, tp array<double>")
    schema = "cid string, n long, newest_h double, oldest_h double, stamp_h double, mean_sim double, main array<double>, par array<double>, tp array<double>"
    one = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0, 0.0, [1.0], [1.0], [1.0])], schema)
    got = top_clusters(docs, one, load_rank(CFG.rank_model), 5).collect()
    assert [(r.doc, r.place, r.cid, r.scored) for r in got] == [(1, 1, "a", 1)]
    assert top_clusters(docs, one.limit(0), load_rank(CFG.rank_model), 5).count() == 0
    with pytest.raises(ValueError):
        top_clusters(docs, one, load_rank(CFG.rank_model), 5, ClusterConfig(pool_size=0))
