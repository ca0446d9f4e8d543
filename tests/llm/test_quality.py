import random
import re

import numpy as np
import pytest
from helpers import prose
from weftline.llm import quality


def slow_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {k for i, t in enumerate(windows) if windows.count(t) > 1 for k in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


@pytest.mark.parametrize("text", [None, "", "a", "a b c", "a b c a b c", "a a a a", "x y z\nx y z\n\n \nq", "a\x0bb\x1cc d é", "# * $ % & | < > <b>", "a b c d a b c e a b c"])
def test_base_statistics(text):
    assert quality.text_stats(text)[:5] == slow_stats(text)


def test_base_statistics_of_random_texts():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 60)))
        assert quality.text_stats(text)[:5] == slow_stats(text), text


def junk(rng, kind):
    t = prose(rng, 90).split()
    return " ".join({0: [w + "***" for w in t], 1: [w.upper() + "!!" for w in t], 2: [w + " |" for w in t]}[kind])


def test_label_model_tells_junk_without_labels(make):
    rng = random.Random(2)
    letters = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    good = [(i, ".\n".join(" ".join(rng.choice(letters) for _ in range(20)) for _ in range(6)) + ".") for i in range(120)]
    bad = [(1000 + i, re.sub(r"\d", "", junk(rng, i % 3))) for i in range(21)]
    got = {r.doc_id: r.kept for r in quality.judge(make(good + bad), ["doc_id"]).collect()}
    assert all(got[d] for d, _ in good) and not any(got[d] for d, _ in bad)


def slow_fit(patterns, counts):
    """The same model in loops over documents' votes."""
    k = len(quality.RULES)
    belief = {0: (0.1, 0.4, 0.5), 1: (0.13, 0.02, 0.85)}
    like, prior, total = {(y, r): belief[y] for y in (0, 1) for r in range(k)}, 0.9, float(sum(counts))

    def odds(v):
        z = np.log(prior / (1 - prior))
        for r, x in enumerate(v):
            step = np.log(like[1, r][x + 1]) - np.log(like[0, r][x + 1])
            z += 0 if x < 0 else max(step, 0) if x else min(step, 0)
        return 1 / (1 + np.exp(-z))

    for _ in range(200):
        p = [odds(v) for v in patterns]
        for y in (0, 1):
            mass = [c * (q if y else 1 - q) for c, q in zip(counts, p)]
            for r in range(k):
                cells = [sum(m for m, v in zip(mass, patterns) if v[r] + 1 == x) + belief[y][x] * (1 + 0.1 * total) for x in range(3)]
                like[y, r] = tuple(c / sum(cells) for c in cells)
        new = min(0.98, max(0.02, sum(c * q for c, q in zip(counts, p)) / total))
        if abs(new - prior) < 1e-9:
            break
        prior = new
    return [odds(v) for v in patterns]


def test_fit_against_loops():
    rng = np.random.default_rng(3)
    patterns = np.unique(rng.choice([-1, 0, 1], p=[0.2, 0.2, 0.6], size=(40, len(quality.RULES))), axis=0).astype(np.int8)
    counts = rng.integers(1, 60, len(patterns))
    assert quality.fit(patterns, counts).posterior(patterns) == pytest.approx(slow_fit(patterns.tolist(), counts.tolist()))


def test_odd_rows(odd_docs, no_docs):
    got = quality.judge(odd_docs).collect()
    assert len(got) == odd_docs.count() and got[0].score == 1
    assert all(r.base_failed and not r.kept for r in got)
    assert quality.judge(no_docs).count() == 0
