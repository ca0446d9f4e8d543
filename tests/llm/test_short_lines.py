import random

import corpus_pipeline
from helpers import prose
from weftline.llm import lines, registry


def brute(rows):
    """(doc, kept text, removed) by holding each line that is not blank against all before it, whatever its size."""
    before, out = [], []
    for doc, text in rows:
        kept, gone = [], 0
        for line in text.split("\n"):
            words = frozenset(line.lower().split())
            like = bool(words) and any(len(words & b) * 5 >= len(words | b) * 4 for b in before)
            before += [words] if words else []
            gone += like
            kept += [] if like else [line]
        out.append((doc, "\n".join(kept), gone))
    return out


def test_lines_of_any_size(make, monkeypatch):
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 9)) for _ in range(25)] + ["", " ", "Read more", "你好世界这是一个很长的句子", "la la la la la la"]
    rows = [(d, "\n".join(rng.choice(base) + rng.choice(("", "", " x")) for _ in range(rng.randint(1, 5)))) for d in range(60)]
    monkeypatch.setattr(lines, "COMMON", 3)
    got = sorted((r.doc_id, r.text, r.n_removed) for r in lines.dedup(make(rows).coalesce(1), floor=1).collect())
    assert got == brute(rows)
    # texts of short lines only
    few = [(1, "Read more\n\nread MORE"), (2, "read more"), (3, "Mehr")]
    assert sorted((r.doc_id, r.text, r.n_removed) for r in lines.dedup(make(few).coalesce(1), floor=1).collect()) == brute(few)


def test_query_and_stage_take_short_lines(spark, make, tmp_path):
    rows = [(1, "Read more\nalpha beta"), (2, "read more\n\ngamma"), (3, "gamma")]
    make(rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_removed for r in registry.op1_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 1}
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.line_dedup(spark, make(rows).coalesce(1), "").collect()) == [(1, "Read more\nalpha beta"), (2, "\ngamma")]
