import json
import random
import threading
import time

import numpy as np
import pytest

from weftline.functions import texts as T
from weftline.operators import evaluate as E
from weftline.operators import fitting, training
from weftline.config import JOIN_MASK, RANK_MASK
from weftline.sources import encode, gold
from weftline.streaming import store


def test_gold_file_keeps_its_order(spark, tmp_path):
    rows = [{"id": f"d{i}", "text": "x" * i, "title": None, "lang": "eng", "date": f"2020-01-0{i + 1}T00:00:00", "cluster": str(i % 2)} for i in range(7)]
    (tmp_path / "gold.json").write_text(json.dumps(rows))
    got = gold.to_stream(gold.read_gold(spark, str(tmp_path / "gold.json"))).orderBy("seq").collect()
    assert [(r.seq, r.id, r.body, r.title, r.label) for r in got] == [(i, f"d{i}", "x" * i, "", str(i % 2)) for i in range(7)]


def test_binary_vectors(spark, tmp_path):
    cells = np.random.default_rng(1).normal(size=(5, 3, 8))
    (tmp_path / "v.bin").write_bytes(cells.astype("<f8").tobytes())
    got = gold.read_binary_vectors(spark, str(tmp_path / "v.bin"), 8).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(5)) and np.allclose([[r.main, r.par, r.tp] for r in got], cells)
    docs = spark.createDataFrame([(9,)], "seq long")
    with pytest.raises(Exception, match="no stored vectors at place 9"):
        gold.with_stored_vectors(docs, gold.read_binary_vectors(spark, str(tmp_path / "v.bin"), 8)).collect()


def test_service_waits_and_asks_again():
    waits, answers = [], [TimeoutError(), ConnectionError(), [[1.0], [2.0]]]

    def post(texts):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert encode.ServiceEncoder(post, sleep=waits.append)(["a", "b"]).tolist() == [[1.0], [2.0]] and waits == [600.0, 600.0]
    answers[:] = [ValueError()]
    with pytest.raises(ValueError):
        encode.ServiceEncoder(post)(["a"])


def test_texts_of_all_documents_go_together():
    sizes = []

    def encoder(texts):
        sizes.append(len(texts))
        return np.array([[len(t)] for t in texts], dtype=float)

    groups = [["a", "bb"], [], ["ccc"] * 40]
    assert [g.ravel().tolist() for g in encode.flattened(encoder, groups)] == [[1, 2], [], [3] * 40] and sizes == [32, 10]
    assert encode.sentence_mean(encoder, ["a", "bbb"]).tolist() == [2.0]


def slow_paragraphs(text, ends):
    stops = {}
    for tag, places in ends.items():
        for p in places:
            stops[p] = stops.get(p, False) or tag in T.NEWLINE_TAGS
    out, now, skip = [], "", False
    for i, c in enumerate(text):
        if stops.get(i):
            out, now = [*out, now.strip()], ""
        elif i in stops and c != " ":
            now += " "
        if c == "\n":
            skip = True
        elif c not in " \t" or not skip:
            skip, now = c in " \t", now + c
    return [p for p in [*out, now.strip()] if p]


def test_paragraphs_by_block_ends():
    assert T.paragraphs_by_ends("one two", {"ul": [3]}) == ["one", "two"]
    assert T.paragraphs_by_ends("ab\n  cd", {}) == ["abcd"]
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("ab \t\n") for _ in range(rng.randint(0, 25)))
        ends = {t: [rng.randint(0, 26) for _ in range(rng.randint(0, 3))] for t in ("p", "b", "ul", "br")}
        assert T.paragraphs_by_ends(text, ends) == slow_paragraphs(text, ends)
    assert T.block_ends("<p>a &lt; b</p><i>c</i>") == ("a < bc", {"p": [5], "i": [6]})




def test_scores_over_time_with_removals(spark):
    rng, rows, at = random.Random(3), [], {}
    gold_of = {d: rng.randrange(4) for d in range(60)}
    states = []
    for d in range(60):
        c = rng.randrange(5)
        rows.append((len(rows), d + 1, gold_of[d], c, 1))
        at[d] = c
        if rng.random() < 0.4:  # a document moves
            m = rng.choice(list(at))
            rows.append((len(rows), d + 1, gold_of[m], at[m], -1))
            at[m] = rng.randrange(5)
            rows.append((len(rows), d + 1, gold_of[m], at[m], 1))
        if (d + 1) % 10 == 0 or d == 59:
            ds = sorted(at)
            pairs = [(a, b) for i, a in enumerate(ds) for b in ds[i + 1 :]]
            same = [(gold_of[a] == gold_of[b], at[a] == at[b]) for a, b in pairs]
            states.append((d + 1, sum(g and p for g, p in same), sum(p and not g for g, p in same), sum(g and not p for g, p in same), len(set(at.values()))))
    got = E.pair_scores_over_time(spark.createDataFrame(rows, "seq long, doc_no long, gold long, pred long, sign int"), 10).orderBy("documents").collect()
    assert [(r.documents, r.tp, r.fp, r.fn, r.n_clu) for r in got] == states


def test_gain_of_joining_equals_local_scores(spark):
    rng = random.Random(5)
    labelled = spark.createDataFrame([(rng.randrange(4), rng.randrange(5)) for _ in range(80)], "gold long, pred long")
    got = {(r.s, r.t): (r.separate_f1, r.joined_f1) for r in E.join_gain(labelled).collect()}
    for s, t in [(0, 1), (2, 4), (3, 1)]:
        want = tuple(E.local_f1(labelled, [s, t], joined).collect()[0].f1 for joined in (False, True))
        assert got[s, t] == pytest.approx(want)


def test_fitting_finds_the_line(spark):
    rng = np.random.default_rng(1)

    def cells(x):
        return " ".join(f"{i}:{v:.4f}" for i, v in enumerate(x, 1))

    rows, lines = rng.normal(size=(600, sum(RANK_MASK))), []
    for q in range(60):
        part = rows[q * 10 : q * 10 + 10]
        best = int(np.argmax(part[:, 0] - 0.5 * part[:, 1]))
        lines += [(f"{int(i == best)} qid:{q} {cells(x)}",) for i, x in enumerate(part)]
    w, wrong = fitting.fit_ranking(spark.createDataFrame(lines, "line string"), RANK_MASK)
    assert w[0] > 0 > w[1] and wrong < 0.15
    rows = rng.normal(size=(800, sum(JOIN_MASK)))
    lines = [(f"{int(x[0] + x[2] > 0.3)} {cells(x)}",) for x in rows]
    w, bias, score = fitting.fit_classifier(spark.createDataFrame(lines, "line string"), JOIN_MASK)
    assert score > 0.95 and w[0] > 0 and w[2] > 0 > bias


def test_written_lines_and_logs(spark, tmp_path):
    lines = spark.createDataFrame([("1 1:2", "a"), ("0 1:3", "b")], "line string, part string")
    training.write_lines(lines, str(tmp_path / "lines"), "part")
    assert {(r.value, r.part) for r in spark.read.text(str(tmp_path / "lines")).collect()} == {("1 1:2", "a"), ("0 1:3", "b")}
    updates = spark.createDataFrame([("add", "d1", "c1", 1.5, ["en"]), ("remove", "d2", "c1", 0.0, ["en"])], "op string, document_id string, cluster_id string, similarity double, available_languages array<string>")
    for _ in range(2):
        store.dump(updates, str(tmp_path / "log"))
    assert [json.loads(x.value) for x in spark.read.text(str(tmp_path / "log")).collect()] == [{"documentId": "d1", "clusterId": "c1", "similarity": "1.5", "availableLanguages": ["en"]}] * 2


def test_progress_is_told(spark, tmp_path):
    from weftline.streaming.progress import Progress

    for i in range(2):
        spark.range(i * 5, i * 5 + 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = Progress(10, lambda _: None)
    spark.streams.addListener(seen)
    try:
        q = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(seen)
    assert seen.rows == 10 and seen.told[-1][2] == 100.0


@pytest.mark.parametrize("parts", [1, 7])
def test_running_vectors(spark, parts):
    """A key over many ranges, null keys and null vectors, against a cumulative sum."""
    rng = np.random.default_rng(parts)
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 5}", None if i % 13 == 0 else rng.normal(size=4).tolist()) for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.i: r for r in E.running_vectors(spark.createDataFrame(rows, "i long, key string, v array<double>"), "key", ["i"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 400
    for key in {k for _, k, _ in rows}:
        total, n = np.zeros(4), 0
        for i, k, v in rows:
            if k == key:
                total, n = total + (v or 0.0), n + 1
                assert got[i].n == n and np.allclose(got[i].v if len(got[i].v) == 4 else np.zeros(4), total)


def test_requests_in_flight():
    """Results in order, bounded looking ahead, the first failure in its place, and a slow service that no longer keeps the caller waiting."""
    begun, lock = [], threading.Lock()

    def call(i):
        def run():
            with lock:
                begun.append(i)
            time.sleep(0.03)
            if i == 17:
                raise KeyError(i)
            return i

        return run

    taken = encode.in_order((call(i) for i in range(100)), 4)
    assert next(taken) == 0
    time.sleep(0.2)
    assert len(begun) <= 5  # the taker is slow, so nothing more was begun
    assert [next(taken) for _ in range(16)] == list(range(1, 17))
    with pytest.raises(KeyError):
        next(taken)
    assert len(begun) < 30
    at = time.time()
    assert list(encode.in_order((call(i) for i in range(20, 80)), 12)) == list(range(20, 80))
    assert time.time() - at < 60 * 0.03 / 4


def test_service_in_flight_equals_one_at_a_time(spark):
    def post(texts):
        time.sleep(0.01)
        if threading.current_thread() is not threading.main_thread() and hash(texts[0]) % 3 == 0 and texts[0] not in tried:
            tried.add(texts[0])
            raise TimeoutError
        return [[float(len(t)), float(sum(map(ord, t)))] for t in texts]

    tried: set = set()
    service = encode.ServiceEncoder(post, wait_seconds=0.0, sleep=lambda _: None)
    groups = [[f"text {i} {k}" for k in range(i % 4)] for i in range(60)]
    one, many = encode.flattened(service, groups, 5), encode.flattened(service, groups, 5, in_flight=6)
    assert tried and all(np.array_equal(a, b) for a, b in zip(one, many))


def test_cells_are_added_up_where_texts_were_dealt(spark, sf):
    import contextlib
    import io

    from weftline.plans import catalogue

    for name in ("enc_hash_vectors", "enc_main_repr", "enc_sentence_mean"):
        told = io.StringIO()
        with contextlib.redirect_stdout(told):
            catalogue.queries()[name](spark, sf).explain()
        plan = told.getvalue().split("+- == Initial Plan ==")[-1]
        above = plan[: plan.index("REPARTITION_BY_NUM")]
        assert above.count("Exchange") == 1, plan  # the one that deals the texts
