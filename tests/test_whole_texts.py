"""Vectors are made of whole texts, and what is held of a text does not grow with its paragraphs."""

import numpy as np

from weftline.sources import encode


def words(i):
    return f"alpha{chr(97 + i % 26)} beta{chr(97 + i // 26)} gamma delta"


def test_every_paragraph_counts(spark):
    parts = [words(i) for i in range(100)]
    rows = [(1, "\n".join(parts), "A title of words"), (2, "\n \n".join(parts[:41]), "t"), (3, parts[0], None), (4, None, "only a title here"), (5, "", "")]
    docs = spark.createDataFrame(rows, "id long, body string, title string")
    for title in (False, True):
        got = {r.id: r for r in encode.with_vectors(docs, batch=2, title=title).collect()}
        for i, body, name in rows:
            lines = [p for p in (body or "").split("\n") if p.strip()]
            tp = f"{name or ''} \n {lines[0]}" if lines else name or ""
            assert np.array_equal(got[i].tp, encode.hash_encode([tp])[0])
            assert np.array_equal(got[i].par, encode.hash_encode([lines[0] if lines else ""])[0])
            assert np.allclose(got[i].main, np.mean(encode.hash_encode([tp, *lines[1:]]), axis=0), rtol=0, atol=1e-12)
            assert not title or np.array_equal(got[i].title_repr, encode.hash_encode([name or ""])[0])


def test_sums_of_parts():
    sizes = []

    def encoder(texts):
        sizes.append(len(texts))
        return np.array([[float(len(t)), 1.0] for t in texts])

    got = encode.summed(encoder, [["a", "bb"], [], ["ccc"] * 40, ["d"]], 2)
    assert [([v.tolist() for v in first], rest if rest is None else rest.tolist()) for first, rest in got] == [
        ([[1, 1], [2, 1]], None), ([], None), ([[3, 1]] * 2, [114, 38]), ([[1, 1]], None)]
    assert sizes == [32, 11]
