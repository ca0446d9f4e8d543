"""Learned sentence bounds: counts against a plain form, and false bounds on held-out text against the regular expression."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.operators import sentences as S

ABBREVIATIONS = ["Dr", "Mr", "Prof", "e.g", "i.e", "Inc", "vs", "approx", "St", "U.S"]


def prose(seed, n):
    """Sentences of invented words with abbreviations, initials and numbers: (text, its sentences)."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(400)] if seed < 0 else WORDS
    names = [w.capitalize() for w in words[:60]]
    starters = ["The", "But", "In", "He", "They"]
    out = []
    for _ in range(n):
        s = [rng.choice(starters) if rng.random() < 0.7 else rng.choice(words[60:]).capitalize()]
        for _ in range(rng.randint(3, 12)):
            kind = rng.random()
            if kind < 0.08:
                s += [rng.choice(("Dr.", "Mr.", "Prof.", "St.")), rng.choice(names)]
            elif kind < 0.13:
                s += [rng.choice(("e.g.", "i.e.", "vs.", "approx.", "Inc.", "U.S.")), rng.choice(words)]
            elif kind < 0.16:
                s += [rng.choice("ABCJKM") + ".", rng.choice(names)]
            else:
                s.append(rng.choice(words))
        out.append(" ".join(s) + rng.choice(("." * 1, ".", ".", "!", "?")))
    return " ".join(out), out


WORDS: list = []
WORDS += ["".join(random.Random(i).choice("bdfgklmnprst") + random.Random(i + 1000).choice("aeiou") for _ in range(1)) + "".join(random.Random(i * 7 + k).choice("lmnrstk") + random.Random(i * 11 + k).choice("aeiou") for k in range(1 + i % 3)) for i in range(400)]


def paragraphs(spark, seed, n, each=6):
    return spark.createDataFrame([(prose(seed * 10_000 + i, each)[0],) for i in range(n)] + [(None,), ("",)], "p string")


def bounds_of(text, sentences):
    ends, at = set(), 0
    for s in sentences:
        at = text.index(s, at) + len(s)
        ends.add(at)
    return ends


def test_fewer_false_bounds_on_held_out_text(spark):
    known = S.learn(paragraphs(spark, 1, 400))
    assert {a.lower() for a in ABBREVIATIONS} - known.abbreviations <= {"approx"} and len(known.abbreviations) < 25
    wrong = {"learned": 0, "regular expression": 0}
    missed = {"learned": 0, "regular expression": 0}
    true = 0
    for i in range(200):
        text, want = prose(777_000 + i, 6)
        right = bounds_of(text, want)
        true += len(right)
        for name, got in (("learned", S.cut(text, known)), ("regular expression", [x for x in (s.strip() for s in re.findall(r"[^.!?]+[.!?]*", text)) if x])):
            found = bounds_of(text, got)
            wrong[name] += len(found - right)
            missed[name] += len(right - found)
    print(true, wrong, missed)
    assert wrong["learned"] < 0.05 * wrong["regular expression"] and missed["learned"] < 0.05 * true


def test_counts_and_scores_against_a_plain_form(spark):
    df = paragraphs(spark, 3, 60)
    bare = lambda t: re.sub(S._TRAIL + "$", "", re.sub("^" + S._LEAD, "", t))
    tokens = [[x for x in map(bare, r.p.split()) if x] for r in df.collect() if r.p]
    every, dots = Counter(), Counter()
    for t in tokens:
        for x in t:
            every[re.sub(r"[.!?]+$", "", x).lower()] += 1
            dots[re.sub(r"[.!?]+$", "", x).lower()] += x.endswith(".")
    n, d = sum(every.values()), sum(dots.values())
    table = S.counts(df.where("p IS NOT NULL"))
    assert {r.word: r.n for r in table.groupBy("word").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {k: v for k, v in every.items()}

    def score(w):
        k, m, size = dots[w], every[w], len(w.replace(".", ""))
        like = lambda p: k * math.log(p) + (m - k) * math.log(1 - p)
        return -2 * (like(d / n) - like(0.99)) * math.exp(-size) * (len(w) - size + 1) * size ** -(m - k)

    want = {w for w in every if dots[w] and re.search("[a-z]", w) and score(w) >= 0.3}
    assert S.learn(df).abbreviations == want


@pytest.mark.parametrize("rows", [[], [("",), (None,)], [("no period at all",)], [("Only. Dots. . ...",)]])
def test_little_to_learn_from(spark, rows):
    known = S.learn(spark.createDataFrame(rows, "p string"))
    assert S.cut("One two. Three four! five", known) == ["One two.", "Three four!", "five"]


def test_bound(spark):
    assert len(S.learn(paragraphs(spark, 1, 60), entries=2).abbreviations) <= 2


ODD = ["(\"Dr. Who\" said e.g.) this: \u201cNo!\u201d Then \u00abEr ging.\u00bb", " \t ", "\")]", "", None, "a.\u2028 B. c", "End.)\x85 Next", "x\u00a0y. Z \x0b q.\x0cR", ",\" \"( \u201d\u2019 a.b. \u00c9t\u00e9. \u00e9t\u00e9 \u00c9t\u00e9", "One two?! Three.\r\nFour ... Five", "\u0130stanbul. \u1e9e \u03a3\u039f\u03a3."]


def by_expressions(paragraphs):
    """The counts word by word, in expressions."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, f"^{S._LEAD}", ""), f"{S._TRAIL}$", "")
    t = paragraphs.where("p IS NOT NULL").select(F.filter(F.transform(F.split("p", r"\s+"), bare), lambda x: x != "").alias("t"))
    each = t.select(F.explode(F.transform("t", lambda x, i: F.struct(x.alias("x"), F.when(i > 0, F.get("t", i - 1)).alias("before"), F.get("t", i + 1).alias("next")))).alias("e")).select("e.*")
    dot, large, word = F.col("x").rlike(r"\.$"), lambda c: F.col(c).rlike(r"^\p{Lu}"), lambda c: F.lower(F.regexp_replace(c, r"[.!?]+$", ""))
    inside = F.coalesce(large("x") & ~F.col("before").rlike(r"[.!?]$"), F.lit(False))
    return Counter(tuple(r) for r in each.select(word("x"), dot, F.when(dot, word("next")), F.when(dot, large("next")), F.col("x").rlike(r"^\p{Ll}"), inside).collect())


@pytest.mark.parametrize("rows", [ODD, ODD * 3 + [prose(i, 5)[0] for i in range(300)]])
def test_counts_of_odd_words(spark, monkeypatch, rows):
    df = spark.createDataFrame([(p,) for p in rows], "p string")
    want = by_expressions(df)
    assert Counter({tuple(r)[:-1]: r.n for r in S.counts(df.where("p IS NOT NULL")).collect()}) == want
    monkeypatch.setattr(S, "CHUNK_BYTES", 100)  # counted in many pieces, here
    pieces = list(S._tallies(iter([pa.record_batch({"p": pa.array(rows[i : i + 300], pa.string())}) for i in range(0, len(rows), 300)])))
    assert sum(sum(b.column("n").to_pylist()) for b in pieces) == sum(want.values()) and (len(rows) < 300 or len(pieces) > 1)


def test_words_are_counted_before_they_are_rows(spark):
    table = S.counts(spark.createDataFrame([("So it was. " * 2000,)] * 20, "p string"))
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    assert sum(b.num_rows for b in S._tallies(iter([pa.record_batch({"p": ["So it was. " * 2000] * 20})]))) < 10


def test_cut_against_regular_expressions():
    known = S.Bounds(frozenset(["dr", "e.g"]), frozenset(["then"]), frozenset([("no", "seven")]), frozenset(["who"]))
    strip = lambda w: re.sub(f"^{S._LEAD}|{S._TRAIL}$", "", w)
    for p in (x for x in ODD if x):
        assert [S._stripped(w) for w in re.findall(r"\S+", p)] == [strip(w) for w in re.findall(r"\S+", p)]
    assert S.cut("(\"Dr. Who\" said no.) Then \u201cNo!\u201d No. Seven: 7. 8 \")] (e.g. Who).", known) == ["(\"Dr.", "Who\" said no.)", "Then \u201cNo!\u201d", "No. Seven: 7. 8 \")] (e.g. Who)."]
