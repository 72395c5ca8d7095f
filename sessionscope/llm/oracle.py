"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

# the control conversation of op9, its text doubled as a SQL literal
_CONTROL = r"\### Assistant: </turn> ok"

_NEAREST = """
            SELECT q.vec_id, q.label, q.p, q.v,
                   min({{'d': (list_inner_product(q.v, q.v) - 2 * list_inner_product(q.v, b.c) + list_inner_product(b.c, b.c))::BIGINT,
                        'e': b.e}}) AS best
            FROM parts q JOIN {book} b USING (p) GROUP BY q.vec_id, q.label, q.p, q.v
"""
_MEANS = """
            SELECT b.p, b.e, coalesce(m.c, b.c) AS c
            FROM {book} b LEFT JOIN (
                SELECT p, e, list(mean ORDER BY i) AS c
                FROM (SELECT p, best.e AS e, i, floor(sum(v[i]) / count(*)) AS mean
                      FROM {near}, range(1, 17) AS r(i) GROUP BY ALL)
                GROUP BY p, e) m USING (p, e)
"""


def _codes_sql(rounds: int = 4) -> str:
    """Every round as a table of its own: nearest entries, then the floored means."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"near{i} AS MATERIALIZED ({_NEAREST.format(book=f'book{i}')})")
        if i < rounds:
            steps.append(f"book{i + 1} AS MATERIALIZED ({_MEANS.format(book=f'book{i}', near=f'near{i}')})")
    return f"""
        WITH kept AS (
            SELECT vec_id, label, [floor(1024 * x::DOUBLE) for x in embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        ), parts AS MATERIALIZED (
            SELECT vec_id, label, p::INTEGER AS p, v[16 * p + 1 : 16 * p + 16] AS v FROM kept, range(4) AS r(p)
        ), book0 AS MATERIALIZED (
            SELECT p, e, v AS c
            FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 256
        ), {", ".join(steps)}, coded AS (
            SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
            FROM near{rounds} GROUP BY vec_id, label
        ), digest AS (
            SELECT sha256(string_agg(array_to_string([x::BIGINT for x in c], ','), ',' ORDER BY p, e)) AS codebooks_sha256
            FROM book{rounds}
        )
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
        FROM coded, digest
    """


ORACLE_SQL: dict[str, str] = {
    "op13_vector_codes": _codes_sql(),
    "op1_url_filters": r"""
        WITH RECURSIVE parts AS (
            SELECT page_id, coalesce(html, '') AS html,
                   translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), rules(verdict, host, path) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                   ('block', 'net', '/es/'), ('block', 'net', '/fr/')
        ), places AS (
            SELECT DISTINCT host, path FROM parts
        ), ruled AS (
            SELECT p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
                   arg_max(r.verdict, length(r.host || r.path)) AS verdict
            FROM places p JOIN rules r
              ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
            GROUP BY ALL
        ), counted AS (
            SELECT host, count(*) AS n, count(*) FILTER (verdict = 'allow') AS allowed, count(*) FILTER (verdict = 'block') AS blocked
            FROM parts LEFT JOIN ruled USING (host, path)
            WHERE host <> '' GROUP BY host
        ), seeds AS (
            SELECT 'allow' AS kind, host, n FROM counted WHERE allowed * 2 > n
            UNION ALL SELECT 'block', host, n FROM counted WHERE blocked * 2 > n
        ), start AS (
            SELECT kind, host, 0.15::DOUBLE * (n / sum(n) OVER (PARTITION BY kind)) AS mass FROM seeds
        ), found AS (
            SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)),
                                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
            FROM parts
        ), links AS (
            SELECT 'allow' AS kind, src, dst, count(*) AS n FROM found WHERE src <> '' AND src <> dst GROUP BY ALL
            UNION ALL
            SELECT 'block', dst, src, count(*) FROM found WHERE src <> '' AND src <> dst GROUP BY ALL
        ), shares AS (
            SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM links
        ), walk AS (
            SELECT 0 AS round, kind, host, mass AS rank, 1.0::DOUBLE AS change FROM start
            UNION ALL
            SELECT round + 1, kind, host, rank, max(abs(rank - was) / rank) OVER () FROM (
                SELECT any_value(round) AS round, kind, host, sum(rank) AS rank, sum(was) AS was FROM (
                    SELECT w.round, w.kind, s.dst AS host, 0.85::DOUBLE * w.rank * s.share AS rank, 0.0::DOUBLE AS was
                    FROM walk w JOIN shares s ON w.kind = s.kind AND w.host = s.src WHERE w.change > 1e-6
                    UNION ALL
                    SELECT r.round, start.kind, start.host, start.mass, 0.0 FROM start, (SELECT max(round) AS round FROM walk WHERE change > 1e-6) r
                    WHERE r.round IS NOT NULL
                    UNION ALL
                    SELECT round, kind, host, 0.0, rank FROM walk WHERE change > 1e-6
                ) GROUP BY kind, host
            )
        ), hosts AS (
            SELECT host, coalesce(sum(rank) FILTER (kind = 'allow'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'block'), 0) AS distrust
            FROM walk WHERE round = (SELECT max(round) FROM walk) GROUP BY host
        )
        SELECT p.page_id, p.host, p.path, r.rule,
               coalesce(r.verdict, CASE WHEN h.distrust > h.trust THEN 'block' ELSE 'allow' END) AS verdict
        FROM parts p LEFT JOIN ruled r USING (host, path) LEFT JOIN hosts h ON p.host = h.host
    """,
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, [x for x in string_split_regex(lower(coalesce(text, '')), '\s+') if x <> ''] AS w FROM documents
        ), grams AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
        ), common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
            FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
            WHERE 10 * c.n >= 8 * (x.n + y.n - c.n)
        ), reached AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
        ), classes AS (
            SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size FROM reached GROUP BY a
        )
        SELECT c.doc_id, c.class_id, coalesce(l.n, 0) AS n_links, c.class_size
        FROM classes c LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a) l USING (doc_id)
    """,
    "op4_exact_topk": """
        WITH vectors AS (
            SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT query_id, vec_id, score,
                   row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op5_warc": """
        WITH captures AS (
            SELECT page_id, coalesce(html, '') AS payload, sha256(coalesce(html, '')) AS payload_digest,
                   strlen(coalesce(html, ''))::BIGINT AS payload_bytes, coalesce(url, '') AS u,
                   strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
            FROM pages
        ), keyed AS (
            SELECT *,
                   CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload) ELSE page_id END AS first,
                   CASE WHEN contains(u, '://')
                        THEN concat(array_to_string(list_reverse(string_split(lower(regexp_extract(u, '^(?s:.*?)://([^/?#]*)', 1)), '.')), ','),
                                    ')', regexp_extract(u, '^(?s:.*?)://[^/?#]*((?s:.*))$', 1))
                        ELSE '' END AS url_key
            FROM captures
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to,
               url_key, captured,
               row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS position
        FROM keyed
    """,
    "op9_chat_formatting": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{_CONTROL}'
            UNION ALL SELECT -7, 1, 'assistant', '{_CONTROL}'
        ), written AS (
            SELECT *,
                   replace(replace(replace(replace(role, '\\', '\\\\'), '</turn>', '<\\/turn>'), '### ', '\\### '), ':', '\\:') AS role_out,
                   replace(replace(replace(text, '\\', '\\\\'), '</turn>', '<\\/turn>'), '### ', '\\### ') AS text_out
            FROM turns
        ), joined AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text) AS plain,
                   coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS learned,
                   sum(length(role_out) + length(text_out) + length('### : </turn>') + 1)::BIGINT AS formatted_chars
            FROM written GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(plain) AS turns_sha256, length(learned) AS loss_chars,
               sha256(learned) AS loss_sha256, formatted_chars
        FROM joined
    """,
}
