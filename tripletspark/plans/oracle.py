"""DuckDB twins of the registered queries, written independently of the Spark plans:
all-pairs joins, window functions and plain aggregates over the whole tables."""

from __future__ import annotations

from tripletspark.sources.synthetic import PATTERNS

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
TRIM = rf"^{WS}|{WS}$"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '{TRIM}', '', 'g')"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{WS}', ' ', 'g'))"


def _index(table: str, key: str, group: str = "") -> str:
    part = f"PARTITION BY {group} " if group else ""
    return f"row_number() OVER ({part}ORDER BY md5('42:' || {key}), {key}) - 1"


def _uuid5(expr: str) -> str:
    """Name-based UUID of a text expression."""
    return f"""(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3)
        || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')
        || substr(h, 18, 3) || '-' || substr(h, 21, 12)
        FROM (SELECT sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({expr})) AS h))"""


def _hashed(text: str, modulus: str) -> str:
    """A number below ``modulus`` from the first 48 bits of an md5."""
    return f"(('0x' || substr(md5({text}), 1, 12))::BIGINT % {modulus})"


def _walk(table: str, key: str, k: int) -> str:
    """CTEs ix(key, a), n, drawn(key, pos, neg_id): the first k rows of each row's walk,
    found by comparing every pair of rows."""
    return f"""
    ix AS (SELECT {key}, {_index(table, key)} AS a, count(*) OVER () AS n FROM {table}),
    walk AS (SELECT x.{key}, y.{key} AS neg_id,
        ((y.a - x.a - 1 + x.n) % x.n - {_hashed("'42:walk:' || x.a", "(x.n - 1)")} + x.n - 1)
            % (x.n - 1) AS pos
        FROM ix x JOIN ix y ON x.a <> y.a),
    drawn AS (SELECT * FROM walk WHERE pos < {k})"""


EMB = """emb AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"""
SIM = f"""{EMB},
    sim AS (SELECT x.vec_id AS q, y.vec_id AS d, x.label AS lq, y.label AS ld,
        round(list_cosine_similarity(x.v, y.v), 6) AS s
        FROM emb x JOIN emb y ON x.vec_id <> y.vec_id)"""


def _top(k: int) -> str:
    return f"""{SIM},
    hits AS (SELECT q AS query_id, d AS doc_id, s AS score, lq, ld,
        row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS rank FROM sim
        QUALIFY rank <= {k})"""


# Cells around the first rows in hash order; how many nearest cells hold 95 % of the ten nearest of
# the first 256 rows; the ten nearest of every fiftieth row in that many of its cells.
CELLS = f"""{SIM},
    ranked AS (SELECT *, {_index("emb", "vec_id")} AS r FROM emb),
    near AS (SELECT x.vec_id, p.r AS cell, row_number() OVER (PARTITION BY x.vec_id
            ORDER BY list_cosine_similarity(x.v, p.v) DESC, p.r) AS place
        FROM emb x, ranked p WHERE p.r < ceil(2 * sqrt((SELECT count(*) FROM emb)))),
    home AS (SELECT vec_id AS d, cell FROM near WHERE place = 1),
    exact AS (SELECT q, d, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS rank FROM sim
        QUALIFY rank <= 10),
    opened AS (SELECT quantile_disc(place, 0.95) AS probes FROM exact
        JOIN ranked ON ranked.vec_id = q AND r < 256 JOIN home USING (d)
        JOIN near ON near.vec_id = q AND near.cell = home.cell),
    approx AS (SELECT q, d, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS rank
        FROM sim JOIN home USING (d) JOIN near ON near.vec_id = q AND near.cell = home.cell
        WHERE q % 50 = 0 AND place <= (SELECT probes FROM opened) QUALIFY rank <= 10)"""

# Principal axes by squaring the covariance until one direction is left, then of what remains.
def _axis(name: str, matrix: str) -> str:
    """CTE ``name`` (a): the direction of largest variance of the one-row table ``matrix`` (m);
    its entry of largest size is positive."""
    return f"""
    {name}_p AS (SELECT 0 AS k, m FROM {matrix} UNION ALL
        SELECT k + 1, list_transform(m, lambda r: list_transform(m, lambda s:
            list_dot_product(r, s) / list_max(list_transform(m, lambda t: list_dot_product(t, t)))))
        FROM {name}_p WHERE k < 24),
    {name}_r AS (SELECT m[list_position(d, list_max(d))] AS r FROM (SELECT m,
        list_transform(m, lambda t: list_dot_product(t, t)) AS d FROM {name}_p WHERE k = 24)),
    {name} AS (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r)) * sign(
        r[list_position(list_transform(r, lambda y: abs(y)), list_max(list_transform(r,
            lambda y: abs(y))))])) AS a FROM {name}_r)"""


PCA = f"""{EMB},
    cell AS (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM emb),
    middle AS (SELECT i, avg(x) AS mu FROM cell GROUP BY i),
    centred AS (SELECT vec_id, i, x - mu AS x FROM cell JOIN middle USING (i)),
    cov AS (SELECT x.i, y.i AS j, sum(x.x * y.x) / (SELECT count(*) FROM emb) AS c
        FROM centred x JOIN centred y USING (vec_id) GROUP BY x.i, y.i),
    cov_row AS (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY i),
    cov1 AS (SELECT list(r ORDER BY i) AS m FROM cov_row),
    {_axis("first_axis", "cov1")},
    share AS (SELECT list_dot_product(a, list_transform(m, lambda r: list_dot_product(r, a)))
        AS l FROM cov1, first_axis),
    cov2_row AS (SELECT i, list(c - l * a[i] * a[j] ORDER BY j) AS r
        FROM cov, first_axis, share GROUP BY i),
    cov2 AS (SELECT list(r ORDER BY i) AS m FROM cov2_row),
    {_axis("second_axis", "cov2")}"""

# Hard negatives: every pair, its walk position, its band; then the three cases.
MINED = f"""{SIM},
    {_walk("embeddings", "vec_id", 1)},
    band AS (SELECT q, d, s, pos, s BETWEEN 0.3 AND 0.5 AS in_band,
        s >= 0 AND NOT s BETWEEN 0.3 AND 0.5 AS valid
        FROM sim JOIN walk ON walk.vec_id = q AND walk.neg_id = d),
    counted AS (SELECT *, count(*) FILTER (in_band) OVER (PARTITION BY q) AS r,
        count(*) FILTER (valid) OVER (PARTITION BY q) AS v FROM band),
    placed AS (SELECT c.*, ix.a AS da,
        row_number() OVER (PARTITION BY q, in_band ORDER BY pos) AS by_walk,
        row_number() OVER (PARTITION BY q, valid ORDER BY s, ix.a) AS by_sim
        FROM counted c JOIN ix ON ix.vec_id = c.d),
    mined AS (SELECT q AS vec_id, d AS neg_id, s AS score,
        CASE WHEN in_band THEN 'in_range' ELSE 'fallback' END AS source,
        CASE WHEN in_band THEN by_walk ELSE by_sim + r END AS rank
        FROM placed
        WHERE (in_band AND by_walk <= 2)
           OR (valid AND r = 0 AND by_sim <= 2)
           OR (valid AND r > 0 AND r < 2 AND v >= 2 - r AND by_sim <= 2 - r))"""

TRIPLETS = f"""{EMB},
    {_walk("embeddings", "vec_id", 3)},
    mem AS (SELECT vec_id, label, {_index("embeddings", "vec_id", "label")} AS m,
        count(*) OVER (PARTITION BY label) AS size FROM embeddings),
    trip AS (SELECT x.vec_id AS id, x.label, w.pos AS neg_pos, a.v AS anchor,
        p.v AS positive, g.v AS negative
        FROM mem x JOIN mem y ON x.label = y.label AND y.m = (x.m + 1) % x.size
        JOIN drawn w ON w.vec_id = x.vec_id
        JOIN emb a ON a.vec_id = x.vec_id JOIN emb p ON p.vec_id = y.vec_id
        JOIN emb g ON g.vec_id = w.neg_id),
    cosd AS (SELECT *, 1 - list_cosine_similarity(anchor, positive) AS pos_dist,
        1 - list_cosine_similarity(anchor, negative) AS neg_dist FROM trip),
    l2d AS (SELECT *, list_distance(anchor, positive) AS pos_dist,
        list_distance(anchor, negative) AS neg_dist FROM trip)"""

_ABS_SUM = "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))"

VPAIRS = f"""{EMB}, {_walk("embeddings", "vec_id", 3)},
    vp AS (SELECT w.vec_id, w.neg_id, x.v AS va, y.v AS vb FROM drawn w
        JOIN emb x ON x.vec_id = w.vec_id JOIN emb y ON y.vec_id = w.neg_id)"""

# Pair space: every pair inside a label with its number in (label order, member, partner).
PAIRSPACE = f"""
    mem AS (SELECT vec_id, label, {_index("embeddings", "vec_id", "label")} AS m
        FROM embeddings),
    sizes AS (SELECT label, count(*) AS n_members, count(*) * (count(*) - 1) // 2 AS n_pairs
        FROM embeddings GROUP BY label),
    pg AS (SELECT *, coalesce(sum(n_pairs) OVER (ORDER BY md5(label::VARCHAR), label
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_pair,
        (sum(n_pairs) OVER ())::BIGINT AS all_pairs FROM sizes),
    stride AS (SELECT least(max(all_pairs), (SELECT count(*) FROM embeddings)) AS wanted,
        max(all_pairs) AS total FROM pg),
    numbered AS (SELECT x.label, least(x.vec_id, y.vec_id) AS id_a,
        greatest(x.vec_id, y.vec_id) AS id_b,
        pg.first_pair + x.m * (x.m - 1) // 2 + y.m AS p
        FROM mem x JOIN mem y ON x.label = y.label AND y.m < x.m
        JOIN pg ON pg.label = x.label),
    asked AS (SELECT k AS pair_no, k * total // wanted AS p FROM stride,
        (SELECT unnest(range((SELECT wanted FROM stride))) AS k)),
    pos_pairs AS (SELECT pair_no, label, id_a, id_b FROM numbered JOIN asked USING (p))"""

NEGPAIRS = f"""
    ixl AS (SELECT vec_id, label, {_index("embeddings", "vec_id")} AS i FROM embeddings),
    cnt AS (SELECT count(*) AS n FROM embeddings),
    tries AS (SELECT t.pair_no, u.u, {_hashed("'42:a:' || t.pair_no || ':' || u.u", "n")} AS a,
        {_hashed("'42:b:' || t.pair_no || ':' || u.u", "greatest(n - 1, 1)")} AS off, n
        FROM cnt, (SELECT unnest(range((SELECT wanted FROM slots))) AS pair_no) t,
        (SELECT unnest(range(10)) AS u) u),
    neg_pairs AS (SELECT pair_no, x.vec_id AS id_a, y.vec_id AS id_b FROM tries
        JOIN ixl x ON x.i = tries.a JOIN ixl y ON y.i = (tries.a + 1 + off) % n
        WHERE x.label <> y.label
        QUALIFY row_number() OVER (PARTITION BY pair_no ORDER BY u) = 1)"""

LABELLED = f"""{PAIRSPACE},
    slots AS (SELECT least(wanted, total) AS wanted FROM stride), {NEGPAIRS},
    labelled AS (SELECT id_a, id_b, 1 AS true_label FROM pos_pairs
        UNION ALL SELECT id_a, id_b, 0 FROM neg_pairs),
    {EMB},
    dist AS (SELECT l.*, 1 - list_cosine_similarity(x.v, y.v) AS distance FROM labelled l
        JOIN emb x ON x.vec_id = id_a JOIN emb y ON y.vec_id = id_b)"""

# Every pair of one label; as many drawn pairs of two labels.
ALLPAIRS = f"""{EMB},
    inside AS (SELECT round(1 - list_cosine_similarity(x.v, y.v), 6) AS distance
        FROM emb x JOIN emb y ON x.label = y.label AND x.vec_id < y.vec_id),
    slots AS (SELECT count(*) AS wanted FROM inside), {NEGPAIRS},
    dist AS (SELECT distance, 1 AS true_label FROM inside
        UNION ALL SELECT round(1 - list_cosine_similarity(x.v, y.v), 6), 0 FROM neg_pairs
        JOIN emb x ON x.vec_id = id_a JOIN emb y ON y.vec_id = id_b)"""

# Retrieval: top 100 of every vector, relevant = same label.
_KS = (1, 5, 10)
PERQ = f"""{_top(100)},
    need AS (SELECT vec_id AS query_id, count(*) OVER (PARTITION BY label) - 1 AS n_rel
        FROM embeddings),
    seen AS (SELECT *, (lq = ld)::INT AS hit,
        sum((lq = ld)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS found FROM hits),
    folded AS (SELECT query_id, min(rank) FILTER (hit = 1) AS first_rank,
        coalesce(sum(found / rank) FILTER (hit = 1), 0) AS ap_sum,
        {", ".join(f"sum(hit) FILTER (rank <= {k}) AS found_{k}, coalesce(sum(hit / log2(rank + 1)) FILTER (rank <= {k}), 0) AS dcg_{k}" for k in _KS)}
        FROM seen GROUP BY query_id),
    perq AS (SELECT n.query_id, n_rel, first_rank,
        CASE WHEN n_rel > 0 THEN coalesce(ap_sum, 0) / n_rel END AS ap,
        {", ".join(f"coalesce(found_{k}, 0) AS found_{k}, CASE WHEN n_rel > 0 THEN coalesce(dcg_{k}, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, {k} + 1) t(i) WHERE i <= n_rel) ELSE 0 END AS ndcg_{k}" for k in _KS)}
        FROM need n LEFT JOIN folded f USING (query_id))"""


def _rows(*cells: tuple[str, object, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {k if k is not None else 'NULL'}::BIGINT AS k, "
        f"round(({v})::DOUBLE, 6) AS value FROM perq" for m, k, v in cells)


_HIT = [("hit_rate", k, f"avg((found_{k} > 0)::INT)") for k in _KS]
_REC = [("recall", k, f"avg(CASE WHEN n_rel > 0 THEN found_{k} / n_rel ELSE 0 END)") for k in _KS]
_PRE = [("precision", k, f"avg(found_{k} / {k})") for k in _KS]
_NDCG = [("ndcg", k, f"avg(ndcg_{k})") for k in (5, 10)]
_MRR = [("mrr", None, "avg(coalesce(1 / first_rank, 0))")]
_MAP = [("map", None, "avg(ap)")]

_STEPS = """st AS (SELECT user_id AS run_id, event_id, ts, value AS loss,
    value / 10 AS separation, (props->>'$.k')::DOUBLE AS violations_pct,
    epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1
    AS step_no FROM events)"""

_GRAPH = f"""{_walk("documents", "doc_id", 2)},
    negs AS (SELECT drawn.doc_id, pos, text AS neg FROM drawn
        JOIN documents d ON d.doc_id = drawn.neg_id),
    pick AS (SELECT doc_id, text, source,
        row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS item FROM documents),
    nodes AS (
        SELECT doc_id, item, doc_id || '/anchor' AS node_id, 'anchor' AS type,
            'Code ' || item AS label, left(text, 100) AS text FROM pick
        UNION ALL SELECT doc_id, item, doc_id || '/positive', 'positive', 'Pos ' || item, source
            FROM pick
        UNION ALL SELECT p.doc_id, item, p.doc_id || '/negative/' || (pos + 1), 'negative',
            'Neg ' || item || '.' || (pos + 1), neg FROM pick p JOIN negs USING (doc_id))"""

_COMMENT = r"(?s)^\s*/\*(.*?)\*/(.*)$"
_HTML = r"(?s)^\s*<!--(.*?)-->(.*)$"

ORACLE: dict[str, str] = {
    "a1_scan_source_files": """
        SELECT lang, sum(length(t) + 1)::BIGINT AS n_chars,
            sum(length(t) - length(replace(t, chr(10), '')) + 1)::BIGINT AS n_lines
        FROM (SELECT lang, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))
            AS t FROM documents) GROUP BY lang""",
    "a2_scan_parquet": "SELECT doc_id, md5(text) AS text_md5, lang, n_chars FROM documents",
    "a3_scan_jsonl": """
        SELECT 'good' AS side, doc_id, md5(text) AS text_md5, lang, n_chars FROM documents
        UNION ALL SELECT 'rejected', doc_id, NULL, NULL, NULL FROM labels WHERE toxic = 1""",
    "a4_head": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100",
    "a5_sink_parquet": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "a6_sink_jsonl": """SELECT doc_id, md5(text) AS text_md5, quality::BIGINT AS quality
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "a7_append_jsonl": "SELECT doc_id, md5(text) AS text_md5, lang, n_chars FROM documents",
    "a8_convert": "SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels",
    "a9_log_run": """SELECT 'r1' AS run_id, sum(quality)::VARCHAR AS final_metric_value,
        NULL::VARCHAR AS notes, NULL::VARCHAR AS llm_model FROM labels
        UNION ALL SELECT 'r2', NULL, 'empty', NULL""",
    "a10_sink_metrics": """SELECT lang AS k, count(*)::DOUBLE AS value FROM documents
        GROUP BY lang""",
    "a11_embedding_cache": """SELECT vec_id, CASE WHEN label < 5 THEN len(embedding) ELSE 0 END
        ::BIGINT AS cached FROM embeddings""",
    "a11_get_or_encode": """SELECT run, doc_id, length(text)::DOUBLE AS chars,
        len(string_split(text, ' '))::DOUBLE AS words,
        (length(text) - length(replace(text, 'e', '')))::DOUBLE AS letters_e
        FROM documents, (SELECT unnest(['cold', 'warm']) AS run)""",
    "a12_generate_triplets": "WITH p AS (SELECT * FROM (VALUES " + ", ".join(
        "({}, '{}', '{}', '{}')".format(i, *[x.replace("'", "''") for x in row])
        for i, row in enumerate(PATTERNS)) + """) t(i, code_snippet, conceptual_feedback,
        hard_negative_feedback))
        """ + f"""SELECT {_uuid5("'code/' || doc_id")} AS code_id,
        {_uuid5("'author/' || doc_id")} AS author_id, code_snippet,
        conceptual_feedback AS generated_feedback, conceptual_feedback AS refined_feedback,
        hard_negative_feedback AS negative_feedback, conceptual_feedback,
        hard_negative_feedback, 0.3::DOUBLE AS hard_negative_similarity,
        {_uuid5("'source/' || doc_id")} AS hard_negative_source_id,
        hard_negative_feedback AS llm_negative_feedback
        FROM documents JOIN p ON p.i = doc_id % 10""",

    "b1_split_header": rf"""
        WITH c AS (SELECT doc_id, 'start' AS variant, chr(10) || '/* ' || source || ' */' ||
                chr(10) || text AS c FROM documents
            UNION ALL SELECT doc_id, 'later', 'x /* ' || source || ' */' || chr(10) || text
                FROM documents)
        SELECT doc_id, variant,
            CASE WHEN regexp_matches(c, '{_COMMENT}')
                THEN {_strip(f"regexp_extract(c, '{_COMMENT}', 1)")} ELSE '' END AS header,
            md5(CASE WHEN regexp_matches(c, '{_COMMENT}')
                THEN {_strip(f"regexp_extract(c, '{_COMMENT}', 2)")} ELSE {_strip("c")} END)
                AS body_md5 FROM c""",
    "b1_split_html_header": f"""
        SELECT page_id, {_strip("url")} AS header, md5({_strip("html")}) AS body_md5,
            CASE WHEN regexp_matches(html, '{_HTML}')
                THEN {_strip(f"regexp_extract(html, '{_HTML}', 1)")} ELSE '' END AS plain_header
        FROM pages""",
    "b2_parse_path": """
        WITH p AS (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host,
            regexp_extract(url, '//[^/]+/([a-z]+)/', 1) AS lang FROM pages)
        SELECT page_id,
            CASE WHEN contains(host, 'spam') THEN 'ERROR' ELSE split_part(host, '-', 1) END
                AS author,
            CASE WHEN contains(host, 'spam') THEN 'ERROR' ELSE 'cpoolday' || page_id END
                AS cohort,
            CASE WHEN contains(host, 'spam') THEN 'ERROR' ELSE lang END AS site FROM p""",
    "b3_pseudonymize": f"""
        SELECT doc_id, {_uuid5("source || '/' || doc_id")} AS uid FROM documents""",
    "b4_assign_id": f"""
        SELECT page_id, {_uuid5("sha256(url) || '/' || sha256(html)")} AS uid FROM pages""",
    "b5_clean_whitespace": f"""
        SELECT doc_id, md5(c) AS text_md5, length(c) AS n_chars
        FROM (SELECT doc_id, {_clean("text")} AS c FROM documents)""",
    "b6_truncate_chars": """SELECT doc_id, md5(substr(text, 1, 2000)) AS cut_md5,
        substr(text, 1, 100) || '...' AS preview FROM documents""",
    "b7_instruction_prefix": """
        SELECT conv_id, turn, model, md5(CASE
            WHEN model = 'BGE-base' AND role = 'user'
                THEN 'Represent this query for retrieving relevant documents: '
            WHEN model = 'BGE-base' AND role = 'assistant'
                THEN 'Represent this document for retrieval: '
            WHEN model IN ('multilingual-e5', 'embeddinggemma') AND role = 'user' THEN 'query: '
            WHEN model IN ('multilingual-e5', 'embeddinggemma') AND role = 'assistant'
                THEN 'passage: '
            ELSE '' END || text) AS text_md5
        FROM conversations, (VALUES ('BGE-base'), ('multilingual-e5'), ('embeddinggemma'),
            ('MiniLM')) m(model)""",
    "b8_resolve_fields": """
        SELECT 'doc_' || doc_id AS id, source AS anchor,
            md5(CASE WHEN quality = 1 THEN text WHEN quality = 0 THEN upper(lang) ELSE '' END)
                AS positive_md5,
            CASE WHEN toxic = 1 THEN lang || '|' || source WHEN quality = 1 THEN lang ELSE '' END
                AS negatives
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "b9_render_messages": """
        SELECT conv_id, turn, md5('system:Answer as {role}.|user:' || text) AS two_md5,
            md5('user:CODE ' || text || ' GOOD ' || role) AS one_md5 FROM conversations""",
    "b10_similarity_band": f"""WITH {EMB},
        x AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id,
            round(list_cosine_similarity(a.v, b.v), 6) AS s FROM emb a, emb b
            QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) <= 5)
        SELECT query_id, doc_id, s,
            CASE WHEN s > 0.6 THEN 'high' WHEN s > 0.4 THEN 'medium' ELSE 'low' END AS band,
            CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS badge,
            CASE WHEN s > 0.6 THEN 'bad' WHEN s > 0.5 THEN 'medium' ELSE 'good' END AS grade
        FROM x""",
    "b11_parse_judgement": """
        SELECT doc_id, CASE WHEN toxic = 1 THEN 0 ELSE quality * 90 END::DOUBLE AS score,
            toxic = 0 AND quality = 1 AS correct,
            CASE WHEN toxic = 1 THEN 'JSON parsing failed' ELSE 'i' END AS issues,
            toxic = 1 AS needs_correction FROM labels""",
    "b12_drop_legacy": "SELECT doc_id, lang FROM documents",
    "b13_item_stats": """SELECT doc_id, length(source) AS code_chars,
        length(text) AS feedback_chars,
        length(text) - length(replace(text, chr(10), '')) + 1 AS n_negatives FROM documents""",
    "b14_extract_json": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",

    "c1_require_fields": """
        SELECT doc_id, nullif('missing: ' || concat_ws(',',
            CASE WHEN text IS NULL OR text = '' THEN 'text' END,
            CASE WHEN quality IS NULL OR quality = 0 THEN 'quality' END,
            CASE WHEN toxic IS NULL OR toxic = 0 THEN 'toxic' END), 'missing: ') AS reason
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "c2_filter_length": """SELECT doc_id, n_chars FROM documents
        WHERE length(text) BETWEEN 10 AND 5000""",
    "c3_drop_blank": """SELECT doc_id, ' ok ' AS note FROM documents JOIN labels USING (doc_id)
        WHERE toxic = 0 AND quality = 1 AND trim(text) <> ''""",
    "c5_remaining": """SELECT doc_id, lang FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "c6_length_distribution": """SELECT lang, share::DOUBLE AS share, count(text) AS n,
        true AS within_bound FROM documents,
        (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS share) GROUP BY lang, share""",
    "c6_dataset_checks": """
        SELECT count(*) AS n_rows, count(*) FILTER (text IS NULL OR text = '') AS missing_text,
            count(*) FILTER (quality IS NULL OR quality = 0) AS missing_quality,
            count(*) FILTER (length(text) < 50) AS n_too_short,
            count(*) FILTER (length(text) > 10000) AS n_too_long,
            count(*) - count(DISTINCT text) AS n_repeated, min(length(text)) AS min_chars,
            max(length(text)) AS max_chars, round(avg(length(text)), 6) AS mean_chars
        FROM documents LEFT JOIN labels USING (doc_id)""",

    "d1_dedup_first": """SELECT doc_id, lang FROM documents
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "d1_dedup_last": """SELECT doc_id, lang FROM documents
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1""",
    "d1_dedup_none": """SELECT doc_id, lang FROM documents
        QUALIFY count(*) OVER (PARTITION BY text) = 1""",
    "d2_merge_collections": """
        SELECT doc_id, CASE WHEN old THEN lang END AS lang,
            CASE WHEN NOT old THEN source END AS source
        FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels) AS old FROM documents)
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY (NOT old)::INT, doc_id) = 1""",
    "d3_preprocess": f"""
        WITH c AS (SELECT doc_id, {_clean("text")} AS t FROM documents)
        SELECT doc_id, md5(t) AS text_md5 FROM c WHERE length(t) BETWEEN 10 AND 5000
        QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1""",
    "d3_preprocess_report": f"""
        WITH c AS (SELECT {_clean("text")} AS t FROM documents),
        a AS (SELECT count(DISTINCT t) AS k FROM c WHERE length(t) BETWEEN 10 AND 5000)
        SELECT count(*) AS n_initial, any_value(k) AS n_final,
            round(100.0 * any_value(k) / count(*), 6)::DOUBLE AS pct_retained FROM c, a""",

    "e1_sample_n": """SELECT doc_id, lang FROM documents
        ORDER BY md5('42:' || doc_id), doc_id LIMIT 100""",
    "e2_train_val_split": f"""
        SELECT doc_id, CASE WHEN i < ceil(0.1 * n) THEN 'validation' ELSE 'train' END AS part
        FROM (SELECT doc_id, {_index("documents", "doc_id")} AS i, count(*) OVER () AS n
            FROM documents)""",
    "e3_random_partners": f"WITH {_walk('documents', 'doc_id', 5)} SELECT * FROM drawn",
    "e3_random_negatives": f"""WITH {_walk('documents', 'doc_id', 3)}
        SELECT drawn.doc_id, md5(string_agg(text, '|' ORDER BY pos)) AS negatives_md5
        FROM drawn JOIN documents d ON d.doc_id = drawn.neg_id GROUP BY drawn.doc_id""",
    "e4_balanced_negative_pairs": f"""
        WITH slots AS (SELECT count(*) AS wanted FROM embeddings), {NEGPAIRS}
        SELECT * FROM neg_pairs""",

    "f1_embed_callable": """SELECT doc_id, length(text) AS n_chars,
        length(text) - length(replace(text, ' ', '')) AS n_spaces,
        length(text) - length(replace(text, chr(10), '')) AS n_lines FROM documents""",
    "f2_sanitize_vectors": """
        SELECT vec_id, label IN (0, 1, 2) AS repaired,
            round(list_sum(embedding::DOUBLE[])
                + CASE WHEN label IN (0, 1, 2) THEN 0 ELSE 0.5 END, 6) AS total FROM embeddings""",
    "f3_l2_normalize": f"""WITH {EMB}
        SELECT vec_id, CASE WHEN label = 0 THEN 0 ELSE 1 END::DOUBLE AS norm,
            round(CASE WHEN label = 0 THEN 0 ELSE v[1] / sqrt(list_inner_product(v, v)) END, 6)
                AS first FROM emb""",
    "f4_cosine_similarity": f"""WITH {VPAIRS}
        SELECT vec_id, neg_id, round(list_cosine_similarity(va, vb), 6) AS cos FROM vp""",
    "f5_cosine_distance": f"""WITH {VPAIRS}
        SELECT vec_id, neg_id, round(1 - list_cosine_similarity(va, vb), 6) AS dist,
            1.0::DOUBLE AS failed_dist FROM vp""",
    "f6_lp_distances": f"""WITH {VPAIRS}
        SELECT vec_id, neg_id, round(list_distance(va, vb), 6) AS l2,
            round({_ABS_SUM.format(a="va", b="vb")}, 6) AS l1 FROM vp""",
    "f7_mips_topk": f"WITH {_top(10)} SELECT query_id, rank, doc_id, score FROM hits",
    "f7_mips_topk_blocks": f"WITH {_top(10)} SELECT query_id, rank, doc_id, score FROM hits",
    "f8_self_similarity": f"""WITH {EMB},
        s AS (SELECT round(list_cosine_similarity(x.v, y.v), 6) AS s
            FROM emb x JOIN emb y ON x.vec_id <> y.vec_id)
        SELECT count(*) AS n, round(avg(s), 10) AS mean, round(median(s), 8) AS median,
            round(stddev_pop(s), 6) AS std, min(s) AS min, max(s) AS max,
            round(quantile_cont(s, 0.25), 8) AS q25, round(quantile_cont(s, 0.75), 8) AS q75,
            round(100.0 * count(*) FILTER (s > 0.5) / count(*), 6)::DOUBLE AS pct_above
        FROM s""",
    "f8_self_similarity_moments": f"""WITH {EMB},
        s AS (SELECT list_cosine_similarity(x.v, y.v) AS s
            FROM emb x JOIN emb y ON x.vec_id <> y.vec_id)
        SELECT count(*) AS n_pairs, round(avg(s), 6) AS mean_sim,
            round(stddev_pop(s), 6) AS std_sim FROM s""",
    "f9_mean_pool": """
        WITH u AS (SELECT label, abs(embedding[1]::DOUBLE) AS w,
            unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos
            FROM embeddings)
        SELECT label::BIGINT AS label, pos::BIGINT AS pos,
            round(sum(w * x) / greatest(sum(w), 1e-9), 6) AS value
        FROM u GROUP BY label, pos""",

    "f1_embed_default": """
        WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w
            FROM documents),
        tf AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 128 AS dim,
            sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END) AS tf
            FROM words GROUP BY ALL),
        idf AS (SELECT dim, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf
            FROM tf GROUP BY dim),
        raw AS (SELECT doc_id, dim, tf * idf AS x FROM tf JOIN idf USING (dim))
        SELECT doc_id, dim, round((x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 6)
            AS value FROM raw WHERE x <> 0""",
    "f10_project": f"""WITH RECURSIVE {PCA}
        SELECT vec_id, round(sum(x * p.a[i]), 6) AS x, round(sum(x * q.a[i]), 6) AS y
        FROM centred, first_axis p, second_axis q GROUP BY vec_id""",
    "f11_approx_topk": f"""WITH {CELLS}
        SELECT q AS query_id, rank, d AS doc_id, s AS score FROM approx""",
    "f11_index_exact": f"""WITH {CELLS}
        SELECT q AS query_id, rank, d AS doc_id, s AS score FROM exact WHERE q % 50 = 0""",
    "f11_recall": f"""WITH {CELLS}
        SELECT count(DISTINCT e.q) AS n_queries, count(*) AS wanted, count(a.d) AS found,
            round(avg((a.d IS NOT NULL)::INT), 6)::DOUBLE AS recall
        FROM exact e LEFT JOIN approx a ON a.q = e.q AND a.d = e.d WHERE e.q % 50 = 0""",

    "g1_hard_negatives": f"WITH {MINED} SELECT vec_id, rank, neg_id, score, source FROM mined",
    "g2_hybrid_negatives": f"""WITH {MINED},
        easy AS (SELECT w.vec_id, w.neg_id, row_number() OVER (PARTITION BY w.vec_id
                ORDER BY w.pos) AS rank
            FROM walk w ANTI JOIN mined m ON m.vec_id = w.vec_id AND m.neg_id = w.neg_id
            WHERE w.pos < 5 QUALIFY rank <= 3),
        both_kinds AS (SELECT vec_id, 0 AS kind, rank, neg_id FROM mined
            UNION ALL SELECT vec_id, 1, rank, neg_id FROM easy)
        SELECT vec_id, string_agg(neg_id::VARCHAR, '|' ORDER BY kind, rank) AS negatives,
            count(*) AS total, count(*) FILTER (kind = 0) AS num_hard,
            count(*) FILTER (kind = 1) AS num_easy, 'hybrid' AS generation_method
        FROM both_kinds GROUP BY vec_id""",
    "g3_ranked_negatives": f"""WITH {_top(20)}
        SELECT query_id AS vec_id, rank, doc_id AS neg_id, score, 'hardest' AS strategy
        FROM hits WHERE rank <= 3
        UNION ALL SELECT query_id, rank, doc_id, score, 'semi-hard' FROM hits
        WHERE rank BETWEEN 9 AND 11
        UNION ALL (SELECT query_id, rank, doc_id, score, 'random' FROM hits
        QUALIFY row_number() OVER (PARTITION BY query_id
            ORDER BY md5('42:' || query_id || '/' || doc_id), doc_id) <= 3)""",
    "g4_mining_report": f"""WITH {MINED}
        SELECT (SELECT count(*) FROM embeddings) AS n_examples,
            count(*) FILTER (source = 'in_range') AS n_in_range,
            round(100.0 * count(*) FILTER (source = 'in_range')
                / (2 * (SELECT count(*) FROM embeddings)), 6)::DOUBLE AS pct_in_range,
            count(*) FILTER (source = 'fallback') AS n_fallback,
            round(avg(score), 10) AS mean, round(median(score), 8) AS median,
            min(score) AS min, max(score) AS max, round(stddev_pop(score), 6) AS std
        FROM mined""",
    "g5_explode_triplets": f"""WITH {_walk('documents', 'doc_id', 3)}
        SELECT w.doc_id, (count(*) OVER (PARTITION BY w.doc_id))::BIGINT AS n_negatives,
            pos AS neg_pos, a.source AS anchor, md5(a.text) AS positive_md5,
            md5(g.text) AS negative_md5
        FROM drawn w JOIN documents a ON a.doc_id = w.doc_id
        JOIN documents g ON g.doc_id = w.neg_id""",
    "g6_triplet_graph_nodes": f"""WITH {_GRAPH}
        SELECT doc_id, item, node_id, type, label, md5(text) AS text_md5 FROM nodes
        WHERE item <= 30""",
    "g6_triplet_graph_edges": f"""WITH {_GRAPH}
        SELECT doc_id || '/anchor' AS src, node_id AS dst, type FROM nodes
        WHERE item <= 30 AND type <> 'anchor'""",
    "g6_item_graph": f"""WITH {_GRAPH}
        SELECT doc_id, 'anchor' AS type, 'Anchor (Code)' AS label, md5(text) AS text_md5
        FROM pick
        UNION ALL SELECT doc_id, 'positive', 'Positive', md5(source) FROM pick
        UNION ALL SELECT doc_id, 'negative', 'Negative ' || (pos + 1), md5(neg) FROM negs""",
    "g7_apply_edits": """
        SELECT doc_id, CASE WHEN quality = 1 THEN 't' || toxic
            WHEN quality IS NOT NULL THEN 'first' ELSE source END AS source,
            CASE WHEN quality = 0 THEN 'xx' ELSE lang END AS lang
        FROM documents LEFT JOIN labels USING (doc_id)""",

    "h1_triplet_loss": f"""WITH {TRIPLETS},
        e AS (SELECT id, avg(greatest(pos_dist + 0.5 - neg_dist, 0)) AS loss FROM l2d GROUP BY id),
        b AS (SELECT vec_id AS id, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch
            FROM embeddings)
        SELECT round(avg(loss), 6) AS loss, count(*) AS n_examples,
            (SELECT round(avg(m), 6) FROM (SELECT avg(loss) AS m FROM e JOIN b USING (id)
                GROUP BY batch)) AS batch_mean_loss FROM e""",
    "h2_triplet_metrics": f"WITH {TRIPLETS} " + " UNION ALL ".join(f"""
        SELECT '{name}' AS distance, count(*) AS n_triplets,
            round(avg(greatest(pos_dist + 0.5 - neg_dist, 0)), 6) AS loss,
            round(avg(pos_dist), 6) AS pos_dist_mean, round(stddev_samp(pos_dist), 6)
            AS pos_dist_std, round(avg(neg_dist), 6) AS neg_dist_mean,
            round(stddev_samp(neg_dist), 6) AS neg_dist_std,
            count(*) FILTER (pos_dist + 0.5 - neg_dist > 0) AS violations,
            round(100.0 * count(*) FILTER (pos_dist + 0.5 - neg_dist > 0) / count(*), 6)::DOUBLE
            AS violations_pct, round(avg(neg_dist - pos_dist), 6) AS separation,
            count(*) FILTER (pos_dist + 0.5 - neg_dist > 0.25) AS hard_triplets
        FROM {src}""" for name, src in (("cosine", "cosd"), ("euclidean", "l2d"))),
    "h3_validation_metrics": f"""WITH {TRIPLETS}
        SELECT count(*) AS n_examples, round(avg(pos_dist), 6) AS pos_dist,
            round(avg(neg_dist), 6) AS neg_dist,
            round(100.0 * count(*) FILTER (pos_dist + 0.5 - neg_dist > 0) / count(*), 6)::DOUBLE
            AS violations_pct, round(avg(neg_dist - pos_dist), 6) AS separation
        FROM l2d WHERE neg_pos = 0""",
    "h4_triplet_accuracy": f"""WITH {TRIPLETS}
        SELECT 'cosine' AS distance, round(avg((pos_dist < neg_dist)::INT), 6) AS accuracy
        FROM cosd
        UNION ALL SELECT 'euclidean', round(avg((pos_dist < neg_dist)::INT), 6) FROM l2d
        UNION ALL SELECT 'manhattan', round(avg(({_ABS_SUM.format(a="anchor", b="positive")}
            < {_ABS_SUM.format(a="anchor", b="negative")})::INT), 6) FROM trip""",
    "h5_separation_report": f"""WITH {TRIPLETS},
        m AS (SELECT 'm' || label AS model,
            avg(pos_dist) FILTER (neg_pos = 0) AS ap, avg(neg_dist) AS an,
            median(round(pos_dist, 6)) FILTER (neg_pos = 0) AS mp,
            median(round(neg_dist, 6)) AS mn FROM cosd GROUP BY label)
        SELECT model, round(ap, 6) AS avg_pos, round(an, 6) AS avg_neg, round(mp, 8) AS median_pos,
            round(mn, 8) AS median_neg, round(an - ap, 6) AS margin,
            row_number() OVER (ORDER BY an - ap DESC, model) AS rank FROM m""",
    "h6_similarity_stats": f"""WITH {VPAIRS},
        s AS (SELECT round(list_cosine_similarity(va, vb), 6) AS s FROM vp)
        SELECT count(*) AS n, round(avg(s), 10) AS mean, round(median(s), 8) AS median,
            round(stddev_pop(s), 6) AS std, min(s) AS min, max(s) AS max,
            round(quantile_cont(s, 0.25), 8) AS q25, round(quantile_cont(s, 0.75), 8) AS q75,
            round(100.0 * count(*) FILTER (s > 0.1) / count(*), 6)::DOUBLE AS pct_above
        FROM s""",
    "h7_histogram": """
        WITH e AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents),
        b AS (SELECT least(floor((n_chars - lo) * 40 / (hi - lo)), 39)::BIGINT AS bin
            FROM documents, e)
        SELECT g.bin, round(lo + g.bin * ((hi - lo) / 40), 6) AS lo,
            round(lo + (g.bin + 1) * ((hi - lo) / 40), 6) AS hi,
            (SELECT count(*) FROM b WHERE b.bin = g.bin) AS n
        FROM e, (SELECT unnest(range(40))::BIGINT AS bin) g""",
    "h8_dataset_stats": """
        WITH d AS (SELECT length(text) AS c,
            length(text) - length(replace(text, chr(10), '')) + 1 AS k FROM documents)
        SELECT count(*) AS n_examples, sum(k)::BIGINT AS n_negatives,
            round(avg(k), 6) AS mean_negatives, round(avg(c), 6) AS mean_code_chars FROM d""",
    "h9_corpus_stats": """
        SELECT count(*) AS n_documents, round(avg(length(text)), 6) AS mean_chars,
            (SELECT count(*) FROM embeddings) AS n_embeddings,
            (SELECT max(len(embedding)) FROM embeddings)::BIGINT AS dimension FROM documents""",
    "h10_judgement_summary": """
        WITH j AS (SELECT l.* FROM documents JOIN labels l USING (doc_id)),
        v AS (SELECT 'refined_feedback' AS feedback_type, quality * 80.0 AS score,
                quality = 1 AS ok, toxic = 1 AS fix FROM j
            UNION ALL SELECT 'conceptual_feedback', 0, quality <> 1, quality = 1 FROM j
                WHERE toxic = 1)
        SELECT feedback_type, count(*) AS n_judged, round(avg(score), 6)::DOUBLE AS mean_score,
            count(*) FILTER (ok) AS n_factually_correct,
            count(*) FILTER (ok) AS n_conceptually_clear, 0::BIGINT AS n_applicable,
            count(*) FILTER (fix) AS n_needs_correction,
            round(100.0 * count(*) FILTER (ok) / count(*), 6)::DOUBLE AS pct_factually_correct,
            round(100.0 * count(*) FILTER (ok) / count(*), 6)::DOUBLE AS pct_conceptually_clear,
            0::DOUBLE AS pct_applicable,
            round(100.0 * count(*) FILTER (fix) / count(*), 6)::DOUBLE AS pct_needs_correction
        FROM v GROUP BY feedback_type""",
    "h11_threshold_metrics": f"""WITH {ALLPAIRS},
        c AS (SELECT t::DOUBLE AS threshold,
            count(*) FILTER (distance < t AND true_label = 1) AS tp,
            count(*) FILTER (distance < t AND true_label = 0) AS fp,
            count(*) FILTER (distance >= t AND true_label = 1) AS fn,
            count(*) FILTER (distance >= t AND true_label = 0) AS tn
            FROM dist, (VALUES (0.5), (0.7), (0.8), (1.0)) th(t) GROUP BY t)
        SELECT threshold, tp, fp, fn, tn,
            round((tp + tn) / (tp + fp + fn + tn), 6)::DOUBLE AS accuracy,
            round(coalesce(tp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS precision,
            round(coalesce(tp / nullif(tp + fn, 0), 0), 6)::DOUBLE AS recall,
            round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1 FROM c""",
    "h11_threshold_metrics_drawn": f"""WITH {LABELLED},
        c AS (SELECT t::DOUBLE AS threshold,
            count(*) FILTER (distance < t AND true_label = 1) AS tp,
            count(*) FILTER (distance < t AND true_label = 0) AS fp,
            count(*) FILTER (distance >= t AND true_label = 1) AS fn,
            count(*) FILTER (distance >= t AND true_label = 0) AS tn
            FROM dist, (VALUES (0.5), (0.7), (0.8), (1.0)) th(t) GROUP BY t)
        SELECT threshold, tp, fp, fn, tn,
            round((tp + tn) / (tp + fp + fn + tn), 6)::DOUBLE AS accuracy,
            round(coalesce(tp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS precision,
            round(coalesce(tp / nullif(tp + fn, 0), 0), 6)::DOUBLE AS recall,
            round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1 FROM c""",
    "h12_roc_auc": f"""WITH {ALLPAIRS},
        places AS (SELECT true_label, distance, avg(place) OVER (PARTITION BY distance) AS place
            FROM (SELECT *, row_number() OVER (ORDER BY distance DESC) AS place FROM dist)),
        c AS (SELECT count(*) FILTER (true_label = 1) AS n_pos,
            count(*) FILTER (true_label = 0) AS n_neg,
            sum(place) FILTER (true_label = 1) AS places FROM places)
        SELECT n_pos, n_neg, round((places - n_pos * (n_pos + 1.0) / 2) / n_pos / n_neg, 6)::DOUBLE
            AS auc FROM c""",
    "h13_rank_models": f"""WITH {TRIPLETS},
        m AS (SELECT 'm' || label AS model, avg(1 - neg_dist) AS x FROM cosd GROUP BY label)
        SELECT model, round(x, 6) AS mean_sim,
            row_number() OVER (ORDER BY x DESC, model) AS rank FROM m""",
    "h13_model_spread": f"""WITH {TRIPLETS},
        m AS (SELECT 'm' || label AS model, avg(1 - neg_dist) AS x FROM cosd GROUP BY label)
        SELECT arg_max(model, x) AS best_model, round(max(x), 6) AS best_score,
            arg_min(model, x) AS worst_model, round(min(x), 6) AS worst_score,
            round(max(x) - min(x), 6) AS score_range, max(x) - min(x) > 0.1 AS choice_matters
        FROM m""",
    "h14_recall_at_k": f"WITH {PERQ} {_rows(*_HIT, *_REC)}",
    "h15_mrr": f"WITH {PERQ} {_rows(*_MRR)}",
    "h16_ndcg_at_k": f"WITH {PERQ} {_rows(*_NDCG)}",
    "h17_map_at": f"WITH {PERQ} {_rows(*_MAP)}",
    "h18_retrieval_report": f"WITH {PERQ} " + _rows(
        *_HIT, *_REC, *_PRE, *_NDCG, *_MRR, *_MAP, ("n_queries", None, "count(*)"),
        ("n_corpus", None, "(SELECT count(*) FROM embeddings)")).replace(
        "round(((SELECT count(*) FROM embeddings))::DOUBLE, 6) AS value FROM perq",
        "(SELECT count(*) FROM embeddings)::DOUBLE AS value"),
    "h19_precision_at_k": f"WITH {PERQ} {_rows(*_PRE)}",
    "h20_item_similarity": f"""WITH {TRIPLETS},
        s AS (SELECT id, list_cosine_similarity(positive, negative) AS s FROM trip),
        m AS (SELECT id, avg(s) AS a, min(s) AS lo, max(s) AS hi FROM s GROUP BY id)
        SELECT id, round(a, 6) AS mean_sim, round(lo, 6) AS min_sim, round(hi, 6) AS max_sim,
            CASE WHEN round(a, 6) > 0.6 THEN 'high' WHEN round(a, 6) > 0.4 THEN 'medium'
            ELSE 'low' END AS band FROM m""",

    "i1_rank_within": """
        SELECT l_suppkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber,
            round(l_extendedprice::DOUBLE, 6) AS price,
            row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey,
                l_linenumber) AS rank
        FROM lineitem QUALIFY rank <= 3""",
    "i2_rolling_window": f"""WITH {_STEPS}
        SELECT event_id, step_no, round(avg(loss) OVER w, 6) AS rolling_mean,
            min(loss) OVER w AS rolling_min, max(loss) OVER w AS rolling_max
        FROM st WINDOW w AS (PARTITION BY run_id ORDER BY step_no
            ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "i3_training_summary": f"""WITH {_STEPS},
        m AS (SELECT run_id, count(*) AS n, arg_min(loss, step_no) AS f,
            arg_max(loss, step_no) AS l, min(loss) AS b, max(separation) AS bs,
            min(violations_pct) AS bv, max(sec) - min(sec) AS el,
            arg_max(separation, step_no) AS ls, arg_max(violations_pct, step_no) AS lv
            FROM st GROUP BY run_id)
        SELECT run_id, n AS n_steps, f AS first_loss, l AS last_loss, b AS best_loss,
            round(bs, 6) AS best_separation, bv AS best_violations,
            round(100.0 * (f - l) / nullif(f, 0), 6)::DOUBLE AS loss_reduction_pct,
            round(el, 6) AS elapsed_sec, l < f AS loss_fell, ls > 0.5 AS separated,
            lv < 20 AS few_violations FROM m""",
    "i4_step_rate": f"""WITH {_STEPS}
        SELECT event_id, round(1 / (sec - lag(sec) OVER (PARTITION BY run_id ORDER BY step_no)
            + 1e-8), 4) AS steps_per_sec FROM st""",
    "i5_early_stopping": f"""WITH {_STEPS},
        p AS (SELECT *, min(loss) OVER (PARTITION BY run_id ORDER BY step_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM st),
        q AS (SELECT *, max(CASE WHEN low IS NULL OR loss < low THEN step_no END) OVER
            (PARTITION BY run_id ORDER BY step_no) AS best_at FROM p),
        s AS (SELECT run_id, count(*) AS n, min(step_no) FILTER (step_no - best_at >= 5) AS stop
            FROM q GROUP BY run_id)
        SELECT s.run_id, any_value(n) AS n_steps, arg_min(loss, (loss, step_no)) AS best_loss,
            any_value(stop) + 1 AS stop_step, any_value(stop) IS NOT NULL AS stopped,
            arg_min(step_no, (loss, step_no)) + 1 AS best_step
        FROM s JOIN st ON st.run_id = s.run_id AND (stop IS NULL OR st.step_no <= stop)
        GROUP BY s.run_id""",
    "i6_assign_batches_text": """SELECT doc_id, lang,
        (row_number() OVER (ORDER BY lang NULLS FIRST, doc_id) - 1) // 50 AS batch FROM documents""",
    "i6_global_rank": """SELECT doc_id,
        row_number() OVER (ORDER BY text NULLS FIRST, doc_id) - 1 AS rank FROM documents""",
    "i6_assign_batches": """SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch
        FROM documents""",

    "j1_pair_groups": f"""WITH {PAIRSPACE} SELECT label::BIGINT AS label, n_members,
        n_pairs::BIGINT AS n_pairs, first_pair, all_pairs FROM pg""",
    "j1_positive_pairs": f"""WITH {PAIRSPACE}
        SELECT pair_no::BIGINT AS pair_no, label::BIGINT AS label, id_a, id_b FROM pos_pairs""",
    "j2_labelled_pairs": f"""WITH {LABELLED}
        SELECT id_a, id_b, true_label::BIGINT AS true_label FROM labelled""",
    "j3_make_queries": """SELECT source AS query, doc_id::VARCHAR AS relevant_ids,
        doc_id::VARCHAR AS code_id, substr(text, 1, 100) || '...' AS expected_feedback
        FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100""",
    "j4_qrels_join": f"""WITH {_top(10)}, {_walk("embeddings", "vec_id", 20)}
        SELECT query_id, rank, doc_id, coalesce(pos + 1, 0)::DOUBLE AS rel FROM hits
        LEFT JOIN drawn ON drawn.vec_id = query_id AND drawn.neg_id = doc_id""",
    "j4_graded_ndcg": f"""WITH {_top(10)}, {_walk("embeddings", "vec_id", 20)},
        m AS (SELECT query_id, rank, coalesce(pos + 1, 0)::DOUBLE AS rel FROM hits
            LEFT JOIN drawn ON drawn.vec_id = query_id AND drawn.neg_id = doc_id),
        c AS (SELECT *, sum((rel > 0)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS found
            FROM m),
        need AS (SELECT vec_id AS query_id, count(*) AS n FROM drawn GROUP BY vec_id),
        ideal AS (SELECT query_id,
            (SELECT sum((n + 1 - i) / log2(i + 1)) FROM range(1, 6) t(i)) AS i5,
            (SELECT sum((n + 1 - i) / log2(i + 1)) FROM range(1, 11) t(i)) AS i10, n FROM need)
        SELECT query_id, any_value(n) AS n_relevant, min(rank) FILTER (rel > 0) AS first_rank,
            round(sum(rel / log2(rank + 1)) FILTER (rank <= 5) / any_value(i5), 6) AS ndcg_5,
            round(sum(rel / log2(rank + 1)) / any_value(i10), 6) AS ndcg_10,
            round(coalesce(sum(found / rank) FILTER (rel > 0), 0) / any_value(n), 6)::DOUBLE AS ap
        FROM c JOIN ideal USING (query_id) GROUP BY query_id""",
    "j5_similarity_range": f"""WITH {SIM}
        SELECT q AS vec_id, count(*) FILTER (s BETWEEN 0.3 AND 0.5) AS n_in_range,
            round(coalesce(sum(s) FILTER (s BETWEEN 0.3 AND 0.5), 0), 6) AS total_sim,
            min(s) FILTER (s BETWEEN 0.3 AND 0.5) AS min_sim,
            max(s) FILTER (s BETWEEN 0.3 AND 0.5) AS max_sim FROM sim GROUP BY q""",

    "k1_retry_failed": "SELECT doc_id, length(text) AS n FROM documents",
    "k1_incremental_process": "SELECT doc_id, length(text) AS n FROM documents",
    "k2_live_monitor": """
        SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n,
            round(avg(value), 10) AS mean, min(value) AS min, max(value) AS max FROM events
        GROUP BY date_trunc('day', ts)""",
    "l1_apply_chain": """SELECT conv_id, turn, md5(text || '!') AS draft_md5,
        md5(role || '>' || role || '>' || text || '!!!') AS refined_md5,
        'ok' AS status FROM (SELECT conv_id, turn, text, role FROM conversations)""",
    "l2_judge": """
        SELECT doc_id, CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 OR quality = 0 THEN 0
            ELSE 80 END::DOUBLE AS score,
            CASE WHEN quality IS NOT NULL THEN toxic = 0 AND quality = 1 END AS correct,
            CASE WHEN toxic = 1 THEN 'Validation error: refused'
                WHEN quality = 0 THEN 'JSON parsing failed' END AS issues,
            CASE WHEN toxic = 1 OR quality = 0 THEN true END AS needs_correction
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "l3_failure_policy": "SELECT conv_id, turn, role FROM conversations WHERE role = 'assistant'",
    "l4_run_stages": f"""
        WITH c AS (SELECT doc_id, {_clean("text")} AS t FROM documents),
        k AS (SELECT doc_id FROM c WHERE length(t) BETWEEN 10 AND 5000
            QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1)
        SELECT doc_id FROM k QUALIFY row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id)
            <= ceil(0.1 * count(*) OVER ())""",
}

ORACLE["c4_reject_unparsed"] = (
    f"SELECT * FROM ({ORACLE['b2_parse_path']}) WHERE author <> 'ERROR'")
