import random

import corpus_pipeline
from helpers import prose
from weftline.llm import decontamination, registry


def test_stages(spark, sf, tmp_path):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.select("doc_id").distinct().count())
        assert k == 4 or docs.columns == columns
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] >= sizes[4] == sizes[5] > 0.4 * sizes[0]
    kept = spark.read.parquet(str(tmp_path / "benchmark_decontamination"))
    assert decontamination.measure(kept, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").isEmpty()
    assert kept.select("doc_id").distinct().count() == kept.count()
    assert kept.where("n_chars <> length(text)").isEmpty()


def test_odd_rows(spark, sf, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd_docs.drop("length"), sf).columns == odd_docs.drop("length").columns, name
        assert stage(spark, no_docs, sf).count() == 0, name
    near = [r.doc_id for r in corpus_pipeline.near_dedup(spark, odd_docs, sf).collect()]
    assert sorted(near, key=str) == [1, 4, 6, 7, None]


def test_registry_has_each_operator_once():
    names = [k for k in registry.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14)) and "pipeline" in registry.queries()


def test_copies_reach_the_near_dedup_whole(spark, make, tmp_path):
    rng = random.Random(21)
    common, rows = prose(rng, 12), []
    for d in range(12):  # originals with a line that all have
        ls = [prose(rng, 20) for _ in range(9)]
        rows.append((d, "\n".join([*ls[:4], common, *ls[4:]])))
        other = [*ls[:4], common, *ls[4:8], prose(rng, 10) + " " + " ".join(ls[8].split()[10:])]  # half of one line differs
        rows += [(100 + d, "\n".join(other)), (200 + d, rows[-1][1])]
        rows.append((300 + d, "\n".join([ls[0], common, ls[1], *(prose(rng, 20) for _ in range(6))])))  # shares lines, is no copy
    cut = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.lines.dedup(make(rows), floor=1).collect()}
    assert all(len(cut[100 + d]) == 1 for d in range(12))  # lines alone leave a stub of a near copy
    corpus_pipeline.line_dedup(spark, make(rows), "").write.parquet(str(tmp_path / "lines"))
    docs = spark.read.parquet(str(tmp_path / "lines"))
    left = {r.doc_id: r.text.split("\n") for r in docs.collect()}
    assert all(left[k] == cut[k] for k in left if k < 100 or k >= 300) and len(left) == len(rows)
    assert all(left[200 + d] == left[d] and len(left[100 + d]) == 9 + (d == 0) for d in range(12))
    stay = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert stay == [*range(12), *range(300, 312)]


def test_near_dedup_has_an_effect_after_line_dedup(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    corpus_pipeline.line_dedup(spark, docs, sf).write.parquet(str(tmp_path / "lines"))
    docs = spark.read.parquet(str(tmp_path / "lines"))
    assert corpus_pipeline.near_dedup(spark, docs, sf).count() < docs.count()
