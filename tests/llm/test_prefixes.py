import hashlib
import random
import zlib

from weftline.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def turn_key(r):
    role, text = r[2] or "", r[3] or ""
    digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    return (r[1] is not None, r[1] or 0, role, digest)


def brute(rows):
    ids = {r[0] for r in rows} - {None}
    own = {c: [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=turn_key)] for c in ids}
    made = {}
    for c in ids:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [(p, m) for p, m in nodes.items() if p[: len(path)] == path]
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[:-1] == p for q in nodes)
        ends = ",".join(map(str, sorted(c for c in members if made[c] == path)))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p, _ in below), sum(leaf(p) for p, _ in below), sum((len(m) - 1) * len(p[-1][1].encode()) for p, m in below if p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.conversation, r.depth, r.parent, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    texts = ["", None, "é", "a", "bb", "ccc"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in range(-12, 40) if c % 7 for _ in range(rng.randrange(1, 14))]
    rows += [(c, t, "user", f"t{t}") for c in range(100, 160) for t in range(6)]  # copies
    return rows + [(None, 0, "user", "x")]


def test_against_brute_force(make):
    rows = corpus(1)
    assert result(prefixes.trie(prefixes.rebuilt(make(rows, SCHEMA)))) == brute(rows)


def test_all_by_shuffle_in_small_pieces(make, monkeypatch):
    monkeypatch.setattr("weftline.llm.common.HEAVY", 0)
    monkeypatch.setattr(prefixes, "PIECE", 5)
    rows = corpus(2)
    assert result(prefixes.trie(prefixes.rebuilt(make(rows, SCHEMA).repartition(23)))) == brute(rows)


def test_whole_tables(spark, sf):
    from weftline.llm import registry

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(registry.op13_prefix_trie(spark, sf).withColumnsRenamed({"conv_id": "conversation", "parent_conv_id": "parent"})) == brute(rows)


def test_long_conversation_makes_no_square(make):
    rows = [(7, t, "user", "x") for t in range(4000)] + [(8, 0, "user", "x")]
    got = result(prefixes.trie(prefixes.rebuilt(make(rows, SCHEMA))))
    assert len(got) == 4001 - zlib.crc32(b"7") % 9 and max(r[1] for r in got) == 4000 - zlib.crc32(b"7") % 9


def test_empty_table(make):
    assert result(prefixes.trie(prefixes.rebuilt(make([], SCHEMA)))) == []
