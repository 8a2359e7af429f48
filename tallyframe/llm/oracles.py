"""DuckDB SQL for the registered queries that SQL can express: op1, op3, op4 and op5.

The others have none: SQL has no crc32 (op6, op8, op9) and cannot train a model (op6, op7, op9), read markup (op10) or
repeat Spark's hash draws (op2). Tests compare those with plain versions.
"""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CAST([1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
    FROM sized GROUP BY source
), steps AS (
    SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS place,
           (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM sources
    WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final AS (
    SELECT coalesce(arg_min(level, place) FILTER (WHERE level * weight <= cap), 1e300) AS level FROM steps
), plan AS (
    SELECT source, source_size, least(weight * final.level, cap) AS target,
           CASE WHEN source_size > 0 THEN CAST(floor(least(weight * final.level, cap) / source_size) AS BIGINT) ELSE 0 END AS whole
    FROM steps, final
), laid AS (
    SELECT s.*, p.source_size, p.target, p.whole, CAST(floor(p.target + 0.5) AS BIGINT) - p.whole * p.source_size AS rest,
           coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY digest, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM laid
"""

OP3 = f"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), sized AS (
    SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
), lengths AS (
    SELECT DISTINCT n FROM windows
), places AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
), found AS (
    SELECT p.doc_id, p.n, p.i, x.item_id FROM places p JOIN windows x USING (n, gram)
), hits AS (
    SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM found) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP4 = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))
                        WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' ' || len(w)] ELSE [] END AS s FROM docs
), tokens AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = doc_id
"""

OP5 = f"""
WITH lines AS (
    SELECT doc_id, n, l[n] AS line, {LOWER.format("trim(l[n], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), often AS (
    SELECT key, max(doc_id) AS owner FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT l.doc_id, l.n, l.line, o.key IS NOT NULL AND o.owner <> l.doc_id AS gone FROM lines l LEFT JOIN often o USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: crc32 of the decimal text of ``c`` in a column of that name; needs the table ``crc_table`` (one list of 256 numbers).
CRC_TABLE = (
    "crc_table AS (SELECT list(x ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), "
    "lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS x FROM range(256) t(i)))"
)
CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), "
    "lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295)"
)
OP13 = f"""
WITH {CRC_TABLE},
own AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
),
plan AS (
    SELECT c, n, h, base, coalesce(held, 0) AS held, least(h, coalesce(held, 0)) AS lent FROM (
        SELECT c, count(*) AS n FROM own GROUP BY c
    ) JOIN (SELECT DISTINCT c, {CRC} % 9 AS h, c - ((c % 5) + 5) % 5 AS base FROM own, crc_table) USING (c)
    LEFT JOIN (SELECT c AS base, count(*) AS held FROM own GROUP BY c) USING (base)
),
rebuilt AS (
    SELECT p.c, o.pos, o.role, o.text FROM plan p JOIN own o ON o.c = p.base AND o.pos < p.h
    UNION ALL SELECT p.c, o.pos - p.h + p.lent, o.role, o.text FROM plan p JOIN own o ON o.c = p.c AND o.pos >= p.h
),
prefixes AS (
    SELECT c, pos + 1 AS depth, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY pos)) AS path, strlen(text) AS bytes FROM rebuilt
    UNION ALL SELECT c, 0, '', 0 FROM plan
),
lengths AS (SELECT c, max(depth) AS length FROM prefixes GROUP BY c),
members AS (SELECT c, depth, path, bytes, lag(path) OVER (PARTITION BY c ORDER BY depth) AS above, length FROM prefixes JOIN lengths USING (c)),
nodes AS (
    SELECT depth, path, above, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
        coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = length), '') AS ends
    FROM members GROUP BY depth, path, above
),
children AS (SELECT above AS path, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above),
below AS (SELECT DISTINCT a.path, b.path AS lower_path FROM members a JOIN members b ON a.c = b.c AND b.depth >= a.depth),
sums AS (
    SELECT b.path, count(*) FILTER (k.path IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
    FROM below b JOIN nodes n ON n.path = b.lower_path LEFT JOIN children k ON k.path = n.path GROUP BY b.path
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens,
    sha256(n.ends) AS ends_sha256
FROM nodes n LEFT JOIN nodes u ON u.path = n.above LEFT JOIN children k ON k.path = n.path JOIN sums s ON s.path = n.path
"""
