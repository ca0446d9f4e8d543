"""DuckDB twins of the registered queries."""

from __future__ import annotations

from weftline.config import ClusterConfig
from weftline.sources.models import load_merge, load_rank

#: fixed values, written out here so that a twin shares no constant with what it checks
FEATURES = (
    "embedding_all", "NEWEST_TS", "OLDEST_TS", "RELEVANCE_TS", "title_repr", "paragraph_repr", "title_paragraph_repr",
    "paragraph_centroid", "title_paragraph_centroid", "cluster_density", "mean_similarity", "target_density",
)
RANK_MASK, JOIN_MASK = (1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1, 0), (1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 0, 1)
_TAGS = "address|article|aside|blockquote|canvas|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|noscript|ol|p|pre|section|table|tfoot|ul|video|br|tr"

_BASE = "epoch_us(TIMESTAMP '2024-01-01 00:00:00')"
_DOCS = f"""ds AS (SELECT doc_id AS id, coalesce(text, '') AS body, trim(regexp_extract(coalesce(text, ''), '^[^.!?\\n]*[.!?]?')) AS title, lang, source,
  'clusters_' || lang AS group_id, ts, (epoch_us(ts) - {_BASE}) / 3.6e9::DOUBLE AS h FROM documents JOIN events ON event_id = doc_id)"""
_VECS = f"""m0 AS (SELECT count(*) AS m FROM embeddings), e0 AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v, label::BIGINT AS label, (vec_id + 1) % m AS k1, (vec_id + 2) % m AS k2 FROM embeddings, m0),
vs AS MATERIALIZED (SELECT e.vec_id, e.label AS gold, lang, ts, (epoch_us(ts) - {_BASE}) / 3.6e9::DOUBLE AS h, e.v AS main, p.v AS par, t.v AS tp
  FROM e0 e JOIN documents ON doc_id = e.vec_id JOIN events ON event_id = e.vec_id JOIN e0 p ON p.vec_id = e.k1 JOIN e0 t ON t.vec_id = e.k2)"""


def _stamp(n="n", s="sum_h", q="sq_h"):
    return f"({s} / {n} + 1.282::DOUBLE * sqrt(greatest({q} / {n} - ({s} / {n}) * ({s} / {n}), 0)))"


def _sums(source, key, columns):
    parts = ", ".join(f"list(s_{c} ORDER BY i) AS {c}" for c in columns)
    cells = ", ".join(f"sum({c}[i]) AS s_{c}" for c in columns)
    return f"(SELECT {key}, {parts} FROM (SELECT {key}, i, {cells} FROM {source}, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY {key}, i) GROUP BY {key})"


_POOL = _VECS + f""", st AS (SELECT gold, count(*) AS n, sum(h) AS sum_h, sum(h * h) AS sq_h, max(h) AS newest_h, min(h) AS oldest_h, max(ts) AS newest, min(ts) AS oldest,
  list_sort(list(DISTINCT lang)) AS languages FROM vs GROUP BY gold),
pool AS (SELECT gold AS cid, n, sum_h, sq_h, newest_h, oldest_h, newest, oldest, languages, {_stamp()} AS stamp_h, main, par, tp FROM st JOIN {_sums('vs', 'gold', ('main', 'par', 'tp'))} USING (gold))"""


def _cos(a, b):
    na, nb = f"list_dot_product({a}, {a})", f"list_dot_product({b}, {b})"
    return f"(1 + CASE WHEN {na} = 0 OR {nb} = 0 THEN 0 ELSE list_dot_product({a}, {b}) / sqrt({na} * {nb}) END)"


def _gauss(x, std=3.0):
    return f"exp(-(({x}) * ({x})) / {2 * std * std}::DOUBLE)"


def _bin(n):
    return f"CASE WHEN {n} <= 3 THEN 0.1428::DOUBLE WHEN {n} <= 10 THEN 0.2856::DOUBLE WHEN {n} <= 20 THEN 0.4284::DOUBLE WHEN {n} <= 30 THEN 0.5712::DOUBLE WHEN {n} <= 40 THEN 0.714::DOUBLE WHEN {n} <= 50 THEN 0.8568::DOUBLE ELSE 1::DOUBLE END"


def _features(c, d, times, density=None):
    made = [_cos(f"{c}.main", f"{d}.main"), *(_gauss(f"({t}) / 24") for t in times), "0::DOUBLE", _cos(f"{c}.par", f"{d}.par"), _cos(f"{c}.tp", f"{d}.tp"), _cos(f"{c}.main", f"{d}.par"), _cos(f"{c}.main", f"{d}.tp")]
    made += [_bin(density[0]), "0::DOUBLE", _bin(density[1])] if density else ["0::DOUBLE"] * 3
    return ", ".join(f"{x} AS {n}" for x, n in zip(made, FEATURES))


def _score(model):
    return "(" + " + ".join([f"{model.bias!r}::DOUBLE", *(f"{w!r}::DOUBLE * {n}" for n, w in zip(FEATURES, model.weights) if w)]) + ")"


def _round(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


_CFG = ClusterConfig()
_RANK, _MERGE, _JOIN = load_rank(_CFG.rank_model), load_merge(_CFG.merge_model), load_merge(_CFG.join_model)

_SCORED = _POOL + f""", fx AS (SELECT d.vec_id AS doc, d.gold, d.lang, c.cid, {_features('c', 'd', ('d.h - c.newest_h', 'd.h - c.oldest_h', 'd.h - c.stamp_h'))} FROM vs d, pool c),
scored AS (SELECT *, {_score(_RANK)} AS rank FROM fx), placed AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(rank, 9) DESC, cid) AS place FROM scored),
best AS (SELECT * FROM placed WHERE place = 1), lab AS (SELECT doc, lang, gold, cid AS pred FROM best)"""


def _pairs(density=False, where="s.cid <> t.cid"):
    return _POOL + f""", px AS (SELECT s.cid AS s_cid, t.cid AS t_cid, {_features('s', 't', ('s.newest_h - t.newest_h', 's.oldest_h - t.oldest_h', 's.stamp_h - t.stamp_h'), ('s.n', 't.n') if density else None)} FROM pool s, pool t WHERE {where})"""


_SUMS = "sum(n * (n - 1) // 2)::BIGINT"


def _pair_scores(by=""):
    k = f"{by}, " if by else ""
    g = f" GROUP BY {by}" if by else ""
    on = f"USING ({by})" if by else "ON true"
    return f""", c AS (SELECT {k}gold, pred, count(*) AS n FROM lab GROUP BY {k}gold, pred), w AS (SELECT {k}{_SUMS} AS tp, (sum(n) * (sum(n) - 1) // 2)::BIGINT AS a FROM c{g}),
r AS (SELECT {k}{_SUMS} AS bg FROM (SELECT {k}gold, sum(n) AS n FROM c GROUP BY {k}gold){g}), l AS (SELECT {k}{_SUMS} AS bp, count(*) AS n_clu FROM (SELECT {k}pred, sum(n) AS n FROM c GROUP BY {k}pred){g}),
x AS (SELECT {k}tp, bp - tp AS fp, bg - tp AS fn, a - bp - bg + tp AS tn, n_clu FROM w JOIN r {on} JOIN l {on})""" + _rates(k)


def _rates(k="", tn=True):
    acc = "CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0 END AS acc, " if tn else ""
    last = "tn, n_clu, round(acc::DOUBLE, 6) AS acc, " if tn else ""
    return f""", y AS (SELECT *, {acc}CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE AS r FROM x)
SELECT {k}tp, fp, fn, {last}round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM y"""


def _cells(source, key="id", text="t"):
    return f"""tk AS (SELECT {key}, regexp_extract_all(lower({text}), '\\p{{L}}+') AS t FROM {source}),
gr AS (SELECT {key}, md5(t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) AS g FROM (SELECT {key}, t, unnest(generate_series(1, len(t) - 2)) AS i FROM tk WHERE len(t) >= 3)),
cl AS (SELECT {key}, bucket, sum(s)::BIGINT AS weight FROM (SELECT {key}, (('0x' || substr(g, 1, 4))::INT % 512)::BIGINT AS bucket, CASE WHEN ('0x' || substr(g, 5, 1))::INT < 8 THEN 1 ELSE -1 END AS s FROM gr) GROUP BY {key}, bucket HAVING sum(s) <> 0)"""


_PARAGRAPHS = "list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '\\S'))[1:40]"


def _number(x):
    return f"regexp_replace(format('{{:.6f}}', {x}), '\\.?0+$', '')"


def _line(mask):
    used = [n for n, m in zip(FEATURES, mask) if m]
    return " || ' ' || ".join(f"'{i}:' || {_number(f'round({n}, 4)')}" for i, n in enumerate(used, 1))


_OP = "CASE event_id % 3 WHEN 0 THEN 'Add' WHEN 1 THEN 'Update' ELSE 'Remove' END"
_LOCAL = lambda key: f""", k AS (SELECT {key} AS c, gold AS l, count(*) AS n, max((pred IN (0, 1, 2))::INT) AS mine FROM lab GROUP BY 1, 2), sz AS (SELECT c, sum(n) AS size FROM k GROUP BY c), ev AS (SELECT l, sum(n) AS every FROM k GROUP BY l),
x AS (SELECT coalesce(sum(n * (n - 1)), 0)::BIGINT AS tp, coalesce(sum(n * (size - n)), 0)::BIGINT AS fp, coalesce(sum(n * (every - n)), 0)::BIGINT AS fn FROM k JOIN sz USING (c) JOIN ev USING (l) WHERE mine = 1)""" + _rates(tn=False)  # noqa: E731


def sql() -> dict[str, str]:
    d, v, pl, sc = f"WITH {_DOCS} ", f"WITH {_VECS} ", f"WITH {_POOL} ", f"WITH {_SCORED} "
    nxt = f"WITH {_VECS}, nx AS (SELECT a.vec_id, a.main AS a, b.main AS b, list_transform(a.main, lambda x: x * 0) AS z FROM (SELECT vec_id, vec_id + 1 AS k, main FROM vs) a JOIN vs b ON b.vec_id = a.k) "
    vec = lambda x: f"list_transform({x}, lambda x: round(x, 6))"
    eh = f"WITH eh AS (SELECT *, (epoch_us(ts) - {_BASE}) / 3.6e9::DOUBLE AS h FROM events) "
    poly = " + ".join(f"{c}::DOUBLE * pow(0.5::DOUBLE * ({' + '.join(f'{x}::DOUBLE * {n}' for n, x in zip(FEATURES, sv) if x)}) + 1, 2)" for c, sv in ((0.75, (1, 0.5, 0, 0.25, 0, 1, 0.5, 0, 1, 0, 0, 0)), (-0.5, (0.5, 1, 0.25, 0, 0, 0, 1, 0.5, 0, 0, 0, 0))))
    links = f", one AS (SELECT a.vec_id AS doc_a, b.vec_id AS doc_b, a.gold = b.gold AS positive FROM vs a JOIN vs b ON b.vec_id - a.vec_id BETWEEN 1 AND 10), ln AS (SELECT * FROM one UNION ALL SELECT doc_b, doc_a, positive FROM one)"
    link = "SELECT DISTINCT a.conv_id::VARCHAR || '#' || a.turn::VARCHAR AS doc_a, b.conv_id::VARCHAR || '#' || b.turn::VARCHAR AS doc_b, CASE WHEN n > 4 THEN 'positive' ELSE 'negative' END AS verdict FROM conversations a JOIN conversations b USING (conv_id) JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) USING (conv_id) WHERE a.turn <> b.turn"
    part = "CASE WHEN ('0x' || substr(md5(doc::VARCHAR), 1, 6))::BIGINT % 100 < 80 THEN 'train' ELSE 'test' END AS part"
    own = _score(load_rank(_CFG.join_model))
    return {
        "src_linked_corpus": "SELECT DISTINCT a.conv_id::VARCHAR || '#' || a.turn::VARCHAR AS doc_a, b.conv_id::VARCHAR || '#' || b.turn::VARCHAR AS doc_b, CASE WHEN (a.conv_id // 4) % 2 = 0 THEN 'positive' ELSE 'negative' END AS verdict FROM conversations a JOIN conversations b ON a.conv_id // 4 = b.conv_id // 4 AND a.conv_id <> b.conv_id",
        "src_cross_pairs": f"SELECT doc_a, doc_b, verdict = 'positive' AS positive FROM ({link})",
        "rank_by_module": sc + f", r AS (SELECT * REPLACE (CASE WHEN lang = 'de' THEN {own} ELSE rank END AS rank) FROM scored), q AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(rank, 9) DESC, cid) AS p FROM r) SELECT doc, cid, round(rank, 6) AS rank FROM q WHERE p = 1",
        "train_written_lines": sc + f", z AS (SELECT *, row_number() OVER (PARTITION BY doc, cid = gold ORDER BY place) AS nth FROM placed) SELECT {part}, (cid = gold)::INT::VARCHAR || ' qid:' || doc::VARCHAR || ' ' || {_line(RANK_MASK)} AS line FROM z WHERE cid = gold OR nth <= 50",
        "eval_dumped_assignments": sc + "SELECT doc::VARCHAR AS \"documentId\", cid::VARCHAR AS \"clusterId\", round(embedding_all, 6)::VARCHAR AS similarity, [lang] AS \"availableLanguages\" FROM best",
        "flagship_fixed_pool_assign": sc + f"SELECT doc, cid, {_round(('rank',))}, round({_score(_MERGE)}, 6) AS merge_score, {_score(_MERGE)} > 0 AS accepted FROM best",
        "prj_payload": d + "SELECT id::VARCHAR AS id, group_id, id::VARCHAR || '_' || group_id AS unique_id, source AS source_feed_name, lang AS language, body, title, ts AS timestamp, ts AS update_timestamp, md5(body) AS forced_label FROM ds",
        "flt_nonempty": d + "SELECT id, length(body)::BIGINT AS n_chars FROM ds WHERE NOT (body = '' AND title = '')",
        "flt_deviation_step": d + "SELECT id, row_number() OVER (ORDER BY ts, id) AS seq, (row_number() OVER (ORDER BY ts, id) - 1) % 10 = 0 AS skips_gold FROM ds",
        "flt_language_list": d + "SELECT id, lang, group_id FROM ds WHERE lang IN ('en', 'de', 'es') AND id IN (SELECT doc_id FROM labels)",
        "txt_paragraphs": d + f"SELECT id, (i - 1)::BIGINT AS i, p[i] AS paragraph FROM (SELECT id, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT id, {_PARAGRAPHS} AS p FROM ds))",
        "txt_sentences": d + f""", pp AS (SELECT id, i, p[i] AS p FROM (SELECT id, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT id, {_PARAGRAPHS} AS p FROM ds))),
ss AS (SELECT id, i, CASE WHEN len(regexp_split_to_array(trim(p), '\\s+')) <= 128 THEN [p] ELSE list_filter(list_transform(regexp_extract_all(substr(p, 1, 4096), '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') END AS s FROM pp)
SELECT id, (i - 1)::BIGINT AS i, (k - 1)::BIGINT AS k, s[k] AS sentence FROM (SELECT id, i, s, unnest(generate_series(1, len(s))) AS k FROM ss)""",
        "txt_title_first_paragraph": d + f"SELECT id, CASE WHEN len(p) > 0 THEN title || ' ' || chr(10) || ' ' || p[1] ELSE title END AS title_paragraph, CASE WHEN len(p) > 0 THEN len(p) + 1 ELSE 1 END::BIGINT AS parts FROM (SELECT id, title, {_PARAGRAPHS} AS p FROM ds)",
        "txt_html_paragraphs": f"""WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<(script|style|head)\\b.*?</(script|style|head)>|<!--.*?-->', ' ', 'gis') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(x, '</?({_TAGS})\\b[^>]*>', chr(10), 'gi'), '<[^>]*>', ' ', 'g') AS x FROM a),
c AS (SELECT page_id, list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g'))), lambda y: y <> '') AS p FROM b)
SELECT page_id, (i - 1)::BIGINT AS i, p[i] AS paragraph FROM (SELECT page_id, p, unnest(generate_series(1, len(p))) AS i FROM c)""",
        "enc_hash_vectors": f"WITH {_DOCS}, {_cells('ds', 'id', 'body')} SELECT id, bucket, weight FROM cl",
        "enc_main_repr": f"""WITH {_DOCS}, pa AS (SELECT id, title, {_PARAGRAPHS} AS p FROM ds), tp AS (SELECT id, p, CASE WHEN len(p) > 0 THEN title || ' ' || chr(10) || ' ' || p[1] ELSE title END AS h FROM pa),
li AS (SELECT id, CASE WHEN len(p) > 1 THEN list_concat([h], p[2:]) ELSE [h] END AS q FROM tp), ro AS (SELECT struct_pack(id := id, i := i, n := len(q)) AS key, q[i] AS t FROM (SELECT id, q, unnest(generate_series(1, len(q))) AS i FROM li)),
{_cells('ro', 'key', 't')} SELECT key.id AS id, bucket, round(sum(weight) / max(key.n), 6)::DOUBLE AS weight FROM cl GROUP BY 1, 2""",
        "vec_add": nxt + f"SELECT vec_id, {vec('list_transform(list_zip(a, b), lambda z: z[1] + z[2])')} AS v FROM nx",
        "vec_subtract": nxt + f"SELECT vec_id, {vec('list_transform(list_zip(a, b), lambda z: z[1] - z[2])')} AS v FROM nx",
        "vec_dot": nxt + "SELECT vec_id, round(list_dot_product(a, b), 6) AS dot FROM nx",
        "vec_sq_norm": v + "SELECT vec_id, round(list_dot_product(main, main), 6) AS sq_norm FROM vs",
        "vec_cosine": nxt + f"SELECT vec_id, round({_cos('a', 'b')} - 1, 6) AS cos, round({_cos('a', 'b')}, 6) AS shifted, round({_cos('a', 'z')}, 6) AS against_zero FROM nx",
        "vec_mean": v + "SELECT vec_id, list_transform(generate_series(1, 64), lambda i: round((main[i] + par[i] + tp[i]) / 3, 6)) AS v FROM vs",
        "agg_centroid": v + f"SELECT gold, {vec('main')} AS centroid FROM {_sums('vs', 'gold', ('main',))}",
        "agg_cluster_stats": pl + f"SELECT cid AS gold, n, {_round(('sum_h', 'sq_h'))}, newest, oldest, round(stamp_h, 6) AS stamp_h FROM pool",
        "agg_languages": pl + "SELECT cid AS gold, array_to_string(languages, ',') AS languages FROM pool",
        "agg_label_histogram": v + "SELECT lang, gold, count(*) AS n FROM vs GROUP BY lang, gold",
        "agg_count_where": v + "SELECT gold, count(*) FILTER (lang = 'en') AS english, round(max(h), 6) AS last_h FROM vs GROUP BY gold",
        "agg_toppling": "SELECT event_id AS seq, sum((event_id % 3 = 0)::INT) OVER (ORDER BY event_id)::BIGINT AS ups, sum((event_id % 3 = 1)::INT) OVER (ORDER BY event_id)::BIGINT AS downs FROM events",
        "fn_gaussian_decay": f"WITH x AS (SELECT event_id, (epoch_us(max(ts) OVER (PARTITION BY user_id)) - epoch_us(ts)) / 8.64e10::DOUBLE AS days FROM events) SELECT event_id, round(days, 6) AS days, round({_gauss('days')}, 6) AS decay FROM x",
        "fn_relevance_stamp": eh + f", x AS (SELECT user_id, count(*) AS n, sum(h) AS sum_h, sum(h * h) AS sq_h FROM eh GROUP BY user_id) SELECT user_id, round({_stamp()}, 4) AS stamp_h FROM x",
        "fn_size_bin": f"SELECT user_id, n, round({_bin('n')}, 6) AS bin FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)",
        "fn_relevance_score": "SELECT user_id, round(avg(CASE WHEN nth < 5 THEN nth::DOUBLE ELSE value + 5 END), 6) AS mean_relevance FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events) GROUP BY user_id",
        "fn_logistic": sc + f"SELECT doc, round(1 / (1 + exp(-({_score(_MERGE)} - {_MERGE.bias!r}::DOUBLE - {_MERGE.bias!r}::DOUBLE))), 6) AS p FROM best",
        "fn_pair_counts": f"SELECT user_id, {_SUMS} AS pairs FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id",
        "fn_short_number": f"SELECT event_id, {_number('round(value, 3)')} AS text FROM events",
        "rank_top_pruned": sc.replace("e.label AS gold", "e.label * 40 + e.vec_id % 40 AS gold") + "SELECT doc, place, cid, round(rank, 6) AS rank FROM placed WHERE place <= 5",
        "agg_running_centroid": v + """SELECT vec_id, gold, any_value(n) AS n, list(round(s, 6) ORDER BY i) AS centroid
FROM (SELECT vec_id, gold, i, count(*) OVER w AS n, sum(main[i]) OVER w AS s FROM vs, (SELECT unnest(generate_series(1, 64)) AS i) WINDOW w AS (PARTITION BY gold, i ORDER BY ts, vec_id ROWS UNBOUNDED PRECEDING)) GROUP BY vec_id, gold""",
        "rank_all": sc + f"SELECT doc, cid, {_round((*FEATURES, 'rank'))} FROM scored",
        "rank_top50": sc + ", q AS (SELECT doc, cid, row_number() OVER (PARTITION BY doc ORDER BY round(rank, 9) DESC, cid) AS in_doc, row_number() OVER (PARTITION BY cid ORDER BY round(rank, 9) DESC, doc) AS in_cluster FROM scored) SELECT * FROM q WHERE in_doc <= 5 OR in_cluster <= 50",
        "rank_best": sc + f"SELECT doc, cid, {_round(('rank', 'embedding_all'))} FROM best",
        "merge_accept": sc + f"SELECT doc, {_score(_MERGE)} > 0 AS accepted, rank > 16.5 AS by_rank FROM best",
        "first_k_flag": d + "SELECT id, lang, row_number() OVER (PARTITION BY lang ORDER BY ts, id) AS seq, row_number() OVER (PARTITION BY lang ORDER BY ts, id) <= 4 AS opens FROM ds",
        "score_polynomial": sc + f"SELECT doc, cid, round({poly} - 0.25::DOUBLE, 5) AS score FROM scored",
        "pair_features": f"WITH {_pairs()} SELECT s_cid, t_cid, {_round(FEATURES)} FROM px",
        "pair_join_decision": f"WITH {_pairs(True)} SELECT s_cid, t_cid, round({_score(_MERGE)}, 6) AS merge_score, round({_score(_JOIN)}, 6) AS join_score, {_score(_JOIN)} > 0 AS joins FROM px",
        "nearest_clusters": f"WITH {_pairs(where='s.cid = 0 AND t.cid <> 0')} SELECT s_cid, t_cid, round({_score(_RANK)}, 6) AS score FROM px",
        "triangular_pairs": f"WITH {_pairs(where='s.cid < t.cid')} SELECT s_cid, t_cid, round({_score(_MERGE)}, 6) AS score FROM px",
        "join_cluster_merge": pl + f""", k AS (SELECT *, cid % 5 AS target FROM pool), j AS (SELECT target, sum(n)::BIGINT AS n, sum(sum_h) AS sum_h, sum(sq_h) AS sq_h, max(newest) AS newest, min(oldest) AS oldest FROM k GROUP BY target),
l AS (SELECT target, string_agg(DISTINCT x, ',' ORDER BY x) AS languages FROM (SELECT target, unnest(languages) AS x FROM k) GROUP BY target)
SELECT target, n, round(sum_h, 6) AS sum_h, newest, oldest, round({_stamp()}, 6) AS stamp_h, languages, {vec('main')} AS main FROM j JOIN l USING (target) JOIN {_sums('k', 'target', ('main',))} USING (target)""",
        "evict_candidate": pl + "SELECT cid, round(stamp_h, 6) AS stamp_h FROM pool ORDER BY round(stamp_h, 9), cid LIMIT 1",
        "changelog_compaction": f"""WITH RECURSIVE o AS (SELECT user_id, {_OP} AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT user_id, 0::BIGINT AS k, '' AS s FROM o WHERE k = 1 UNION ALL SELECT f.user_id, o.k, CASE WHEN o.op = 'Add' THEN 'Add' WHEN o.op = 'Update' THEN CASE WHEN s = '' THEN 'Update' ELSE s END WHEN s = 'Add' THEN '' ELSE 'Remove' END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, max_by(s, k) AS state FROM f GROUP BY user_id HAVING max_by(s, k) <> ''""",
        "eval_cooccurrence": sc + "SELECT gold, pred, count(*) AS n, grouping(gold)::BIGINT AS all_gold, grouping(pred)::BIGINT AS all_pred FROM lab GROUP BY CUBE (gold, pred)",
        "eval_pair_f1": sc + _pair_scores(),
        "eval_pair_f1_by_lang": sc + _pair_scores("lang"),
        "eval_cross_pairs": sc + links + """, pl AS (SELECT doc AS d, cid AS c FROM best), src AS (SELECT DISTINCT doc_a FROM ln),
pr AS (SELECT a.d AS da, b.d AS db, a.c = b.c AS same, positive FROM src JOIN pl a ON a.d = doc_a, pl b LEFT JOIN ln ON ln.doc_a = a.d AND ln.doc_b = b.d WHERE a.d <> b.d),
x AS (SELECT count(*) FILTER (same AND positive) // 2 AS tp, count(*) FILTER (same AND (positive IS NULL OR NOT positive)) // 2 AS fp, count(*) FILTER (NOT same AND positive) // 2 AS fn, count(*) FILTER (NOT same AND NOT positive) // 2 AS tn, (SELECT count(DISTINCT c) FROM pl) AS n_clu FROM pr)""" + _rates(),
        "eval_gold_position": sc + "SELECT doc, place - 1 AS position FROM placed WHERE cid = gold",
        "eval_recall_at_k": sc + ", ks AS (SELECT unnest([1, 5, 10, 20, 50, 100])::BIGINT AS k) SELECT k, round(count(*) FILTER (place - 1 < k) / count(*), 6) AS recall FROM ks, (SELECT place FROM placed WHERE cid = gold) GROUP BY k UNION SELECT max(place), 1 FROM placed WHERE cid = gold",
        "eval_local_f1_separate": sc + _LOCAL("pred::VARCHAR"),
        "eval_local_f1_joined": sc + _LOCAL("CASE WHEN pred IN (0, 1, 2) THEN 'candidates' ELSE pred::VARCHAR END"),
        "eval_density_histogram": "WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), b AS (SELECT CASE WHEN n <= 1 THEN 0 WHEN n <= 2 THEN 1 WHEN n <= 5 THEN 2 WHEN n <= 10 THEN 3 WHEN n <= 25 THEN 4 WHEN n <= 50 THEN 5 WHEN n <= 100 THEN 6 WHEN n <= 200 THEN 7 WHEN n <= 500 THEN 8 ELSE 9 END AS bin FROM s) SELECT i::BIGINT AS bin, (SELECT count(*) FROM b WHERE b.bin = i) AS clusters FROM (SELECT unnest(generate_series(0, 9)) AS i)",
        "eval_clusters_over_time": v + ", q AS (SELECT gold, row_number() OVER (ORDER BY ts, vec_id) AS seq FROM vs) SELECT seq, sum((seq = f)::INT) OVER (ORDER BY seq)::BIGINT AS clusters FROM (SELECT seq, min(seq) OVER (PARTITION BY gold) AS f FROM q)",
        "eval_replay_assignments": "SELECT user_id AS document_id, max_by(event_type, event_id) AS cluster_id FROM events GROUP BY user_id HAVING max(event_id) % 5 <> 0",
        "train_rank_lines": sc + f", z AS (SELECT *, row_number() OVER (PARTITION BY doc, cid = gold ORDER BY place) AS nth FROM placed) SELECT doc AS qid, cid, (cid = gold)::INT::VARCHAR || ' qid:' || doc::VARCHAR || ' ' || {_line(RANK_MASK)} AS line FROM z WHERE cid = gold OR nth <= 50",
        "train_merge_lines": sc + f"SELECT doc, cid, (cid = gold)::INT::VARCHAR || ' ' || {_line(RANK_MASK)} AS line FROM best",
        "train_merge_neg_lines": sc + f", z AS (SELECT *, max(CASE WHEN place = 1 THEN (cid = gold)::INT END) OVER (PARTITION BY doc) AS first FROM placed) SELECT doc, cid, (cid = gold)::INT::VARCHAR || ' ' || {_line(RANK_MASK)} AS line FROM z WHERE place = 1 OR (first = 1 AND place = 2) OR (first = 0 AND cid = gold)",
        "train_merge_random_lines": sc + f", z AS (SELECT *, max(CASE WHEN place = 1 THEN (cid = gold)::INT END) OVER (PARTITION BY doc) AS first, count(*) OVER (PARTITION BY doc) AS m, ('0x' || substr(md5(doc::VARCHAR), 1, 6))::BIGINT AS draw FROM placed) SELECT doc, cid, (cid = gold)::INT::VARCHAR || ' ' || {_line(RANK_MASK)} AS line FROM z WHERE place = 1 OR (first = 1 AND place = 2 + draw % greatest(least(10, m) - 1, 1)) OR (first = 0 AND cid = gold)",
        "train_join_lines": f"""WITH {_pairs(True)}, fx AS (SELECT d.vec_id AS doc, d.gold, d.lang, c.cid, {_features('c', 'd', ('d.h - c.newest_h', 'd.h - c.oldest_h', 'd.h - c.stamp_h'))} FROM vs d, pool c),
lab AS (SELECT doc, gold, cid AS pred FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round({_score(_RANK)}, 9) DESC, cid) AS place FROM fx) WHERE place = 1),
k AS (SELECT pred AS c, gold // 2 AS l, count(*) AS n FROM lab GROUP BY 1, 2), sz AS (SELECT c, sum(n) AS size FROM k GROUP BY c), ev AS (SELECT l, sum(n) AS every FROM k GROUP BY l),
pk AS (SELECT s_cid, t_cid, c, l, n, size, every FROM px JOIN k ON c = s_cid OR c = t_cid JOIN sz USING (c) JOIN ev USING (l)),
sep AS (SELECT s_cid, t_cid, sum(n * (n - 1)) AS tp, sum(n * (size - n)) AS fp, sum(n * (every - n)) AS fn FROM pk GROUP BY 1, 2),
js AS (SELECT s_cid, t_cid, sum(size) AS size FROM (SELECT DISTINCT s_cid, t_cid, c, size FROM pk) GROUP BY 1, 2), jl AS (SELECT s_cid, t_cid, l, sum(n) AS n, max(every) AS every FROM pk GROUP BY 1, 2, 3),
jn AS (SELECT s_cid, t_cid, sum(n * (n - 1)) AS tp, sum(n * (size - n)) AS fp, sum(n * (every - n)) AS fn FROM jl JOIN js USING (s_cid, t_cid) GROUP BY 1, 2),
g AS (SELECT s_cid, t_cid, 2.0 * jn.tp / greatest(2 * jn.tp + jn.fp + jn.fn, 1) > 2.0 * sep.tp / greatest(2 * sep.tp + sep.fp + sep.fn, 1) + 1e-12 AS better FROM sep JOIN jn USING (s_cid, t_cid)),
o AS (SELECT px.*, coalesce(better, false)::INT AS label, row_number() OVER (PARTITION BY s_cid ORDER BY round({_score(_MERGE)}, 6) DESC, t_cid) AS place FROM px LEFT JOIN g USING (s_cid, t_cid)),
q AS (SELECT *, min(CASE WHEN label = 1 THEN place END) OVER (PARTITION BY s_cid) AS found FROM o)
SELECT s_cid, t_cid, label::VARCHAR || ' ' || {_line(JOIN_MASK)} AS line FROM q WHERE place < found + 10""",
        "src_gold_stream": d + "SELECT row_number() OVER (ORDER BY ts, id) - 1 AS seq, id::VARCHAR AS id, title, lang, group_id, source, length(body)::BIGINT AS n_chars, md5(body) AS label FROM ds",
        "src_stored_vectors": v + "SELECT row_number() OVER (ORDER BY ts, vec_id) - 1 AS seq, vec_id, round(list_dot_product(main, par), 6) AS main_par, round(list_dot_product(par, tp), 6) AS par_tp FROM vs",
        "enc_title": f"WITH {_DOCS}, {_cells('ds', 'id', 'title')} SELECT id, bucket, weight FROM cl",
        "enc_sentence_mean": f"""WITH {_DOCS}, pp AS (SELECT id, i, p[i] AS p FROM (SELECT id, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT id, {_PARAGRAPHS} AS p FROM ds))),
ss AS (SELECT id, i, CASE WHEN len(regexp_split_to_array(trim(p), '\\s+')) <= 128 THEN [p] ELSE list_filter(list_transform(regexp_extract_all(substr(p, 1, 4096), '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') END AS s FROM pp),
ro AS (SELECT struct_pack(id := id, i := i - 1, k := k, n := len(s)) AS key, s[k] AS t FROM (SELECT id, i, s, unnest(generate_series(1, len(s))) AS k FROM ss)), {_cells('ro', 'key', 't')}
SELECT key.id AS id, key.i::BIGINT AS i, bucket, round(sum(weight) / max(key.n), 6)::DOUBLE AS weight FROM cl GROUP BY 1, 2, 3""",
        "cluster_gold_labels": d + """, k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ts, id) AS seq FROM ds WHERE NOT (body = '' AND title = '')), f AS (SELECT *, min(seq) OVER (PARTITION BY lang, body) AS first FROM k)
SELECT lang AS module, id::VARCHAR AS document_id, lang || '-' || lpad((CASE WHEN seq <= 4 THEN seq ELSE first END)::VARCHAR, 9, '0') AS cluster_id FROM f""",
        "eval_scores_over_time": sc + """, s AS (SELECT vec_id AS doc, row_number() OVER (ORDER BY ts, vec_id) AS seq FROM vs), ls AS (SELECT lab.*, seq FROM lab JOIN s USING (doc)), m AS (SELECT max(seq) AS m FROM ls),
ck AS (SELECT DISTINCT least(k * 1000, m) AS documents FROM m, (SELECT unnest(generate_series(1, (SELECT (m + 999) // 1000 FROM m))) AS k)), z AS (SELECT documents, gold, pred FROM ck JOIN ls ON seq <= documents),
c AS (SELECT documents, gold, pred, count(*) AS n FROM z GROUP BY 1, 2, 3), w AS (SELECT documents, sum(n * (n - 1) // 2)::BIGINT AS tp, (sum(n) * (sum(n) - 1) // 2)::BIGINT AS a FROM c GROUP BY 1),
g AS (SELECT documents, sum(n * (n - 1) // 2)::BIGINT AS bg FROM (SELECT documents, gold, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1), l AS (SELECT documents, sum(n * (n - 1) // 2)::BIGINT AS bp, count(*) AS n_clu FROM (SELECT documents, pred, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT documents, tp, bp - tp AS fp, bg - tp AS fn, a - bp - bg + tp AS tn, n_clu FROM w JOIN g USING (documents) JOIN l USING (documents))""" + _rates("documents, "),
        "train_split_by_qid": d + "SELECT id AS qid, CASE WHEN ('0x' || substr(md5(id::VARCHAR), 1, 6))::BIGINT % 100 < 80 THEN 'train' ELSE 'test' END AS part FROM ds",
        "link_cross_pairs": link,
        "pool_status": d + "SELECT strftime(max(ts), '%Y-%m-%dT%H%M%S.%f') AS latest_update_timestamp FROM ds",
    }
