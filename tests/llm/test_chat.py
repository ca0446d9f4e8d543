import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import chat

RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 1}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"prompt": "p", "messages": [{"role": "user", "content": None}]}, "messages", [("user", "")]),
    ({"messages": []}, "message_parts", []),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}]}, "message_parts", [("user", "xy")]),
    ([{"role": "user", "content": "a"}], "message_list", [("user", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}], "system": "s"}, "from_value", [("system", "s"), ("user", "q"), ("assistant", "r")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": 7}, "instruction", [("user", "do\n\nthis"), ("assistant", "7")]),
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c", "system": ""}, "prompt_response", [("user", "p"), ("assistant", "c")]),
    ({"question": "q", "answer": "a", "context": "c"}, "question_answer", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"role": None, "text": None}, "turn", [("", "")]),
    ({"messages.role": "x", "text": "y"}, None, []),
    ({}, None, []),
    ("text", None, []),
]


def test_layouts():
    reader = chat.Reader()
    for record, name, turns in RECORDS:
        assert reader.read(json.dumps(record))[1:] == (name, turns), record
    assert reader.read(None) == reader.read("{no json") == reader.read("null") == (None, None, [])


def test_fingerprints_hang_on_paths_alone():
    one, two = {"b": [{"x": 1}, {"y": "2"}], "a": None}, {"a": "z", "b": [{"y": [], "x": 0}]}
    assert chat.paths(one) == {"a", "b[].x", "b[].y"} and chat.paths(two) == {"a", "b[].x", "b[].y[]"}
    assert chat.fingerprint(chat.paths(one)) == chat.fingerprint(chat.paths({"b": [{"y": 1, "x": 1}], "a": 5}))
    assert chat.paths({"a.b": {"c[]": 1}}) == {r"a\.b.c\[\]"}


def test_canonical_keeps_every_record(make):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(99, None), (100, "{")]
    got = chat.canonical(make(rows, "key long, record string")).collect()
    for i, (_, name, turns) in enumerate(RECORDS):
        mine = sorted((r.place or 0, r.role, r.text) for r in got if r.key == i)
        assert [t[1:] for t in mine] == (turns or [(None, None)]) and {r.layout for r in got if r.key == i} == {name}
    assert [(r.place, r.layout, r.fingerprint) for r in got if r.key >= 99] == [(None, None, None)] * 2
    assert chat.canonical(make([], "key long, record string")).count() == 0


NASTY = ["", "\\", "### ", "</turn>\n", "\\### Assistant: </turn> ok", "#### #### ", "<</turn>", "a: b", "\\\\</turn>\\", "<|endoftext|>", "é\U0001f600", "#", "</turn", "\n", "aab", "### user: x</turn>\n### assistant: y</turn>\n"]


def shas(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest()


@pytest.mark.parametrize("template", [chat.Template(), chat.Template("<|", "|>", "<|end|>", control=("aa", "##", "\n\n"))])
def test_round_trip(make, template):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", *NASTY]), "".join(rng.choice(NASTY) for _ in range(rng.randrange(4)))) for c in range(60) for t in range(rng.randrange(1, 9))]
    pieces = chat.formatted(make(rows, "conversation long, turn long, role string, text string"), ["turn"], template)
    got = {r.conversation: r for r in chat.read_back(pieces, template).collect()}
    whole = {}
    for r in sorted(pieces.collect(), key=lambda r: r.n):
        assert r.start == len(whole.get(r.conversation, ""))
        whole[r.conversation] = whole.get(r.conversation, "") + r.piece
        body = r.piece[: -len(template.after_text)]
        assert not any(c in body[len(template.before_role) :] for c in (template.before_role, template.after_text, *template.control))
    for c, r in got.items():
        turns = [x[2:] for x in rows if x[0] == c]
        assert (r.n_turns, r.turns_sha256, r.loss_sha256) == (len(turns), *shas(turns))
        assert (r.loss_chars, r.formatted_chars) == (sum(len(t) for x, t in turns if x == "assistant"), len(whole[c]))


def test_long_conversation_and_odd_rows(make):
    long = [(1, t, ("user", "assistant")[t % 2], "w " * (t % 7)) for t in range(5000)]
    odd = [(None, None, None, None), (None, 2, "assistant", "x"), (2, 1, "assistant", "same"), (2, 1, "assistant", "same"), (2, None, "user", "first"), (3, 0, "assistant", "long " * 200_000)]
    turns = make(long + odd, "conversation long, turn long, role string, text string").withColumn("n", F.lit(1))
    got = {r.conversation: r for r in chat.read_back(chat.formatted(turns, ["turn"])).collect()}
    assert (got[1].n_turns, got[1].turns_sha256) == (5000, shas([r[2:] for r in long])[0])
    assert got[None].turns_sha256 == shas([("", ""), ("assistant", "x")])[0]
    assert got[2].turns_sha256 == shas([("user", "first"), ("assistant", "same"), ("assistant", "same")])[0] and got[2].loss_chars == 8
    assert got[3].loss_chars == 1_000_000


def test_marks_that_cannot_be_read_back():
    for bad in ({"after_text": "x"}, {"after_role": "a\\b"}, {"after_text": "aba"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)
