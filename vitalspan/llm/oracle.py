"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {
    "op1_embeddings": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
        ), g AS (
            SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND len(e) > 0
              AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0
        ), links AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
            WHERE list_cosine_similarity(x.e, y.e) >= 0.93
        ), either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        walk(node, seen) AS (
            SELECT a, b FROM either UNION SELECT walk.node, either.b FROM walk JOIN either ON either.a = walk.seen
        ), least_of AS (SELECT node, min(seen) AS component_id FROM walk GROUP BY node),
        degree AS (SELECT a AS node, count(*) AS n FROM either GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least(component_id, vec_id), vec_id) AS component_id,
               coalesce(least(component_id, vec_id), vec_id) = vec_id AS kept
        FROM v LEFT JOIN least_of l ON l.node = vec_id LEFT JOIN degree d ON d.node = vec_id
    """,
    "op2_mixing": r"""
        WITH counts AS (SELECT source, count(*) AS n, pow(count(*), 0.5) AS weight FROM documents GROUP BY source),
        rates AS (SELECT source, sum(n) OVER () * weight / sum(weight) OVER () / n AS rate FROM counts),
        terms AS (
            SELECT source, rate, k, sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS log_factorial
            FROM rates, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS u(k)
        ), steps AS (
            SELECT source, k, sum(exp(k * ln(rate) - rate - log_factorial)) OVER (PARTITION BY source ORDER BY k) AS p FROM terms
        ), drawn AS (
            SELECT d.*, ('0x' || substr(md5('mix-1:' || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents d
        ), times AS (
            SELECT doc_id, count(*) AS n FROM drawn JOIN steps USING (source) WHERE p <= u GROUP BY doc_id
        )
        SELECT d.*, copy, md5('mix-1:' || d.doc_id::VARCHAR || ':' || copy::VARCHAR) AS shuffle_key
        FROM documents d JOIN times USING (doc_id), unnest(range(1, n + 1)) AS u(copy)
    """,
    "op3_jaccard": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w FROM documents
        ), grams AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS gram
            FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0
        ), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        shared AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
            FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
            WHERE 100 * common >= 75 * (p.n + q.n - common)
        ), either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        walk(node, seen) AS (
            SELECT a, a FROM links UNION SELECT a, b FROM either
            UNION SELECT walk.node, either.b FROM walk JOIN either ON either.a = walk.seen
        ), least_of AS (SELECT node, min(seen) AS component_id FROM walk GROUP BY node)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least(component_id, d.doc_id), d.doc_id)::BIGINT AS component_id
        FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON node = d.doc_id
    """,
    "op6_urls": r"""
        WITH r AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
        ), rules(verdict, h, p) AS (
            VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
        ), best AS (
            SELECT page_id, max_by(h || rules.p, length(h || rules.p)) AS rule, max_by(verdict, length(h || rules.p)) AS verdict
            FROM p JOIN rules ON ends_with('.' || host, '.' || h) AND starts_with(path, rules.p) GROUP BY page_id
        )
        SELECT page_id, host, path, rule, coalesce(verdict, CASE
            WHEN host = '' OR regexp_matches(host, 'spam|pills|casino|viagra|porn|xxx|payday|warez')
              OR contains(path, '/wp-login.php') OR contains(path, '/cgi-bin/') THEN 'block' ELSE 'allow' END) AS verdict
        FROM p LEFT JOIN best USING (page_id)
    """,
    "op7_decontam": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
            FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
        ), sizes AS (SELECT DISTINCT n FROM windows),
        grams AS (
            SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
            FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n
        ), found AS (
            SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, gram)
        ), hit AS (
            SELECT doc_id, count(DISTINCT k) AS n_hit FROM found, unnest(range(i, i + n)) AS u(k) GROUP BY doc_id
        ), named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op11_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        ), t AS (
            SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), c AS (
            SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL
        ), kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
        size_of AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)::HUGEINT) // (total + 5 * v)::HUGEINT AS q FROM kept JOIN size_of USING (lang)),
        groups AS (SELECT DISTINCT lang, source FROM d),
        cells AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
            FROM groups g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), p AS (
            SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)::HUGEINT) // (cells.total + 5 * v)::HUGEINT AS p FROM cells JOIN size_of USING (lang)
        ), far AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), items AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT lang, source, part, item, value::BIGINT AS value,
                   row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM items
        )
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
    "op12_conversations": r"""
        WITH t AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
                   {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (SELECT c, list(said ORDER BY place) AS turns FROM t GROUP BY c),
        opening AS (
            SELECT c, turns, xor(list_reduce(
                       list_transform(range(1, 8 * length(c::VARCHAR) + 1), lambda i: CASE WHEN i % 8 = 1 THEN ascii(substr(c::VARCHAR, (i + 7) // 8, 1)) ELSE 0 END),
                       lambda r, x: CASE WHEN xor(r, x) % 2 = 1 THEN xor(xor(r, x) // 2, 3988292384) ELSE xor(r, x) // 2 END, 4294967295), 4294967295) % 6 AS h
            FROM own
        ), made AS (
            SELECT o.c, list_concat(coalesce(b.turns[1:h], []), o.turns[h + 1:]) AS turns
            FROM opening o LEFT JOIN own b ON b.c = o.c - o.c % 100
        ), reach AS (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS depth FROM made),
        nodes AS (
            SELECT turns[1:depth] AS path, depth, min(c) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(turns) = depth), '')) AS ends_sha256
            FROM reach GROUP BY ALL
        ), children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
        held AS (
            SELECT path, depth, n IS NULL AS leaf, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].text) END AS saved
            FROM nodes LEFT JOIN children USING (path)
        ), under AS (
            SELECT path[1:above] AS path, sum(leaf::INT) AS n_leaves, sum(saved) AS saved_tokens
            FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM held) GROUP BY ALL
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
               n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN under USING (path) LEFT JOIN children k USING (path)
        LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
    """,
}
