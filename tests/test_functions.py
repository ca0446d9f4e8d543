import math

import pytest
from pyspark.sql import functions as F

from weftline.config import FEATURES
from weftline.functions import scalars as S
from weftline.functions import texts as T
from weftline.functions import vectors as V
from weftline.operators import evaluate as E
from weftline.sources import encode, models
from weftline.streaming import store


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def vec(*x):
    return F.array(*(F.lit(float(v)) for v in x))


def test_vectors(spark):
    r = one(spark, V.cosine(vec(1, 2), vec(3, 4)), V.shifted_cosine(vec(0, 0), vec(3, 4)), V.add(vec(1, 2), vec(3, 4)), V.subtract(vec(1, 2), vec(3, 4)), V.dot(vec(1, 2), vec(3, 4)), V.squared_norm(vec(3, 4)), V.mean(F.array(vec(1, 2), vec(3, 6))))
    assert r[0] == pytest.approx(0.9838699101) and r[1] == 1.0
    assert list(r)[2:] == [[4, 6], [-2, -2], 11, 25, [2, 4]]


def test_scalars(spark):
    n = [S.size_bin(F.lit(k)) for k in (3, 4, 10, 50, 51)]
    r = one(spark, *n, S.gaussian(F.lit(0.0)), S.gaussian(F.lit(3.0)), S.relevance_score(F.lit(4), F.lit(9.0)), S.relevance_score(F.lit(5), F.lit(2.5)), S.relevance_stamp(F.lit(2), F.lit(2.0), F.lit(4.0)), S.pairs(F.lit(7)), S.short_number(F.lit(1.25)), S.short_number(F.lit(-0.0000001)), S.short_number(F.lit(10.0)))
    assert list(r)[:5] == [0.1428, 0.2856, 0.2856, 0.8568, 1.0]
    assert r[5] == 1 and r[6] == pytest.approx(math.exp(-0.5)) and list(r)[7:9] == [4, 7.5] and r[9] == pytest.approx(2.282)
    assert list(r)[10:] == [21, "1.25", "0", "10"]


def test_texts(spark):
    body = F.lit("\nOne.\n  \nTwo. Three")
    r = one(spark, T.paragraphs(body), T.title_first_paragraph(F.lit("t"), T.paragraphs(body)), T.title_first_paragraph(F.lit("t"), F.array().cast("array<string>")), T.html_paragraphs(F.lit("<head>x</head><p>a <b>b</b><br>c<script>d</script></p>")))
    assert list(r) == [["One.", "Two. Three"], ["t \n One.", "One.", "Two. Three"], ["t"], ["a b", "c"]]
    assert T.paragraphs_by_ends("ab cd  ef", {"p": [2], "b": [5]}) == ["ab", "cd ef"]


def test_hash_encoder_forms_agree(spark):
    texts = ["the quick brown fox jumps over the quick brown fox", "", "a b", "ä ö ü ß é"]
    cells = encode.hashed_cells(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", F.col("t")).collect()
    dense = encode.hash_encode(texts)
    assert {(r.id, r.bucket): r.weight for r in cells} == {(i, j): dense[i, j] for i in range(len(texts)) for j in range(encode.DIM) if dense[i, j]}


def test_weight_files(tmp_path):
    (tmp_path / "r").write_text("embedding_all\t2\nother\t3\nNEWEST_TS\t0.5\n")
    (tmp_path / "m").write_text("-1.5\ntarget_density\t4\n")
    (tmp_path / "p").write_text("svm_type c_svc\nkernel_type polynomial\ndegree 2\ngamma 0.5\ncoef0 1\nnr_class 2\ntotal_sv 1\nrho 0.25\nSV\n0.5 1:1 5:9 9:2\n")
    assert models.load_rank(str(tmp_path / "r")).weights[:2] == (2, 0.5)
    merge = models.load_merge(str(tmp_path / "m"))
    assert merge.bias == -1.5 and merge.weights[FEATURES.index("target_density")] == 4
    poly = models.load_polynomial(str(tmp_path / "p"))
    assert (poly.degree, poly.gamma, poly.coef0, poly.rho) == (2, 0.5, 1, 0.25) and poly.vectors == ((0.5, (1, 0, 0, 0, 0, 0, 0, 0, 2, 0, 0, 0)),)


def test_pair_scores(spark):
    cells = [("a", 0)] * 2 + [("a", 1)] + [("b", 1)] * 3
    r = E.pair_scores(spark.createDataFrame(cells, "gold string, pred long")).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.n_clu) == (4, 3, 2, 6, 2)


def test_change_log(spark):
    log = [("x", 1, "Add"), ("x", 2, "Update"), ("y", 1, "Add"), ("y", 2, "Remove"), ("z", 1, "Update"), ("z", 2, "Remove"), ("z", 3, "Update")]
    got = {r.k: r.state for r in store.compact(spark.createDataFrame(log, "k string, o long, op string"), "k", "o").collect()}
    assert got == {"x": "Add", "z": "Remove"}


def test_store(spark, tmp_path):
    first = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long")
    store.save(first, str(tmp_path / "p"))
    changes = spark.createDataFrame([("a", 5, "Update"), ("b", 0, "Remove"), ("c", 3, "Add")], "id string, n long, state string")
    store.save(store.upsert(store.load(spark, str(tmp_path / "p")), changes, "id"), str(tmp_path / "p"))
    assert sorted(map(tuple, store.load(spark, str(tmp_path / "p")).collect())) == [("a", 5), ("c", 3)]
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path / "q"))
