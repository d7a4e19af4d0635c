"""DuckDB SQL for the rows of the queries that SQL can express."""

#: Exact links by an inverted index of shingles, then the least id reachable.
NEAR_SQL = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
                        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: list_slice(w, i, i + 3))) END AS s
    FROM texts),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
shingles AS (SELECT doc_id, n, unnest(s) AS x FROM sized),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT sized.doc_id, CAST(n AS BIGINT) AS n_shingles, min(b) AS component_id, sized.doc_id = min(b) AS kept
FROM sized JOIN reach ON reach.a = sized.doc_id
GROUP BY sized.doc_id, n
"""

#: The water level of the targets in closed form; the scale of the inclusion probabilities from the
#: distinct sizes; Pareto ranks by the same digest.
MIX_SQL = r"""
WITH sizes AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS d
    FROM documents),
units AS (
    SELECT source, d, max(size) AS size, count(*) AS m,
           (CAST(CAST('0x' || substr(d, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
    FROM sizes GROUP BY source, d),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k
    FROM sizes GROUP BY source),
weighed AS (SELECT *, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS cap FROM sources),
levels AS (
    SELECT *, CAST(cap AS DOUBLE) / w AS r,
           CAST(3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, k
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / CAST(2 * sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
    FROM weighed),
level AS (SELECT arg_min(level, (r, k)) AS level FROM levels WHERE r > level),
targets AS (
    SELECT l.*, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM level) * w, CAST(cap AS DOUBLE))) AS target FROM levels l),
shares AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM targets),
plans AS (SELECT *, floor(ratio) AS whole, target - floor(ratio) * source_size AS rest FROM shares),
distinct_sizes AS (
    SELECT k, rest, size, sum(m) AS n FROM units JOIN plans ON units.source IS NOT DISTINCT FROM plans.source WHERE size > 0 GROUP BY k, rest, size),
tried AS (
    SELECT k, size, (rest - CAST(coalesce(sum(size * n) OVER (PARTITION BY k ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
           / CAST(sum(size * size * n) OVER (PARTITION BY k ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS c
    FROM distinct_sizes),
scales AS (SELECT k, arg_max(c, size) AS c FROM tried WHERE c * size < 1 GROUP BY k),
odds AS (
    SELECT p.*, units.d, units.size * m AS words, units.u, least(1.0, coalesce(s.c, 0.0) * units.size) AS p
    FROM units JOIN plans p ON units.source IS NOT DISTINCT FROM p.source LEFT JOIN scales s ON s.k = p.k
    WHERE units.size > 0 AND coalesce(s.c, 0.0) > 0),
ranked AS (
    SELECT *, row_number() OVER o AS pos, sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM (SELECT *, CASE WHEN p >= 1 THEN 0.0 ELSE (u / (1 - u)) / (p / CASE WHEN p < 1 THEN 1 - p END) END AS q FROM odds)
    WINDOW o AS (PARTITION BY k ORDER BY q, d)),
gaps AS (SELECT k, max(rest) - coalesce(max(upto) FILTER (upto <= rest), 0) AS gap FROM ranked GROUP BY k),
closing AS (
    SELECT r.k, arg_min(pos, (abs(words - gap), pos)) AS closing_pos FROM ranked r JOIN gaps g ON r.k = g.k
    WHERE NOT upto <= rest AND abs(words - gap) < gap GROUP BY r.k),
chosen AS (
    SELECT source, d FROM ranked LEFT JOIN closing ON ranked.k = closing.k WHERE upto <= rest OR coalesce(pos = closing_pos, FALSE))
SELECT s.doc_id, s.size, p.source_size, p.target, CAST(s.size * (p.whole + CASE WHEN c.d IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sizes s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN chosen c ON c.source IS NOT DISTINCT FROM s.source AND c.d = s.d
"""


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a string of ASCII characters: a character goes in (x >= 0), then eight shifts (-1)."""
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split({text}, ''), "
            "lambda ch: [CAST(ord(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), "
            "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)")


def _field(column: str) -> str:
    return (f"CASE WHEN {column} IS NULL THEN '-' ELSE CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' "
            f"|| CAST({column} AS VARCHAR) END")


def _climb_sql(name: str, start: str) -> str:
    """Levels of a tree as (g, level, pos, h, n): each run of 16 becomes its hash while n > 1."""
    return f"""{name} AS (
    SELECT g, 0 AS level, pos, h, n FROM {start}
    UNION ALL
    SELECT g, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM {name} WHERE n > 1
    GROUP BY g, level, pos // 16, n)"""


def _paths_sql(name: str, tree: str) -> str:
    """For each node of level 0 and each level below the top: the siblings before and after."""
    return f"""{name} AS (
    SELECT a.g, a.pos, s.level, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < a.pos // CAST(16 ** s.level AS BIGINT)), '') AS l,
           coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > a.pos // CAST(16 ** s.level AS BIGINT)), '') AS r
    FROM {tree} a JOIN {tree} s ON a.level = 0 AND s.g = a.g AND s.n > 1 AND s.pos // 16 = a.pos // CAST(16 ** (s.level + 1) AS BIGINT)
    GROUP BY a.g, a.pos, s.level)"""


#: Trees by recursion over levels; a tampered leaf is folded up its path by list_reduce over the siblings.
MERKLE_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, sha256({_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} || {_field("text")}) AS leaf,
           CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0
                THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed,
           lang, n_chars
    FROM documents),
placed AS (
    SELECT doc_id, leaf AS h, sha256({_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} || {_field("changed")}) AS changed,
           coalesce('=' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY source) AS n
    FROM leaves),
{_climb_sql("tree", "placed")},
tops AS (SELECT g AS of_g, '' AS g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
{_climb_sql("upper", "tops")},
{_paths_sql("paths", "tree")},
{_paths_sql("upper_paths", "upper")},
steps AS (
    SELECT p.g, p.pos, s.level, s.l, s.r FROM placed p JOIN paths s ON s.g = p.g AND s.pos = p.pos
    UNION ALL
    SELECT p.g, p.pos, 100 + s.level, s.l, s.r FROM placed p JOIN tops t ON t.of_g = p.g JOIN upper_paths s ON s.pos = t.pos),
proofs AS (
    SELECT g, pos, string_agg(l || r, '' ORDER BY level) AS siblings, list([l, r] ORDER BY level) AS path FROM steps GROUP BY g, pos),
folded AS (
    SELECT p.doc_id, p.h AS leaf, t.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
           list_reduce(list_prepend([p.changed, ''], coalesce(path, [])), lambda x, s: [sha256(s[1] || x[1] || s[2]), ''])[1] AS folded_root
    FROM placed p JOIN tops t ON t.of_g = p.g LEFT JOIN proofs f ON f.g = p.g AND f.pos = p.pos)
SELECT *, folded_root = root AS verified FROM folded
"""


#: Prefixes as strings of fixed-width digests; a node's subtree is what starts with its string.
TRIE_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
           sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tie, strlen(coalesce(text, '')) AS size
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT conv_id, list({{'id': id, 'size': size}} ORDER BY turn NULLS FIRST, tie) AS own, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h
    FROM turns GROUP BY conv_id),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS t
    FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5),
members AS (
    SELECT conv_id, d, coalesce(list_aggregate(list_transform(t[1:d], lambda x: x.id), 'string_agg', ''), '') AS key,
           CASE WHEN d > 0 THEN t[d].size ELSE 0 END AS size, d = len(t) AS ends
    FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
nodes AS (
    SELECT key, d, min(conv_id) AS conv_id, count(*) AS n, max(size) AS size,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM members GROUP BY key, d),
children AS (SELECT left(key, 32 * (d - 1)) AS of_key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
    SELECT v.key, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((u.n - 1) * u.size) AS saved
    FROM nodes v JOIN nodes u ON starts_with(u.key, v.key) LEFT JOIN children c ON c.of_key = u.key GROUP BY v.key)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM nodes v JOIN below b ON b.key = v.key LEFT JOIN children c ON c.of_key = v.key
LEFT JOIN nodes p ON v.d > 0 AND p.key = left(v.key, 32 * (v.d - 1))
"""
