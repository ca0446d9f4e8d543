import duckdb

from weftline.llm import registry

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"


def both(make, tmp_path, rows):
    make(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark = make([], SCHEMA).sparkSession
    own = [tuple(r) for r in registry.op13_prefix_trie(spark, str(tmp_path)).select(*NAMES.split(", ")).collect()]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    return sorted(map(repr, own)), sorted(map(repr, duck.sql(f"SELECT {NAMES} FROM ({registry.oracle_sql()['op13_prefix_trie']})").fetchall()))


def test_rows_of_equal_turns_go_by_role_and_text(make, tmp_path):
    told = [("user", "x" * n) for n in range(12)] + [(None, "yyy"), ("", "zz"), ("user", None)]
    own, sql = both(make, tmp_path, [(c, t, *told[(c + 7 * k) % len(told)]) for c in range(40) for t in (None, 0) for k in range(1 + c % 6)])
    assert own == sql


def test_ids_at_the_ends_of_their_range(make, tmp_path):
    own, sql = both(make, tmp_path, [(c, t, "user", f"t{t}") for c in (2**63 - 1, 2**63 - 3, -(2**63), 3 - 2**63) for t in range(9)])
    assert own == sql
