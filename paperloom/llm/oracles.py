"""DuckDB SQL for the queries that SQL can express, written apart from the Spark code."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1 = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, coalesce(html, '') AS html,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, url, html,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM p),
n AS (SELECT *, host || tail AS node FROM q),
x AS (SELECT node, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS x FROM n WHERE node <> ''),
t AS (SELECT node AS a, CASE WHEN regexp_matches(x, '(?i)^<link') AND regexp_matches(x, '(?i)\srel\s*=\s*["'']?canonical\b') THEN regexp_extract(x, '(?i)\shref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(x, '(?i)^<meta') AND regexp_matches(x, '(?i)http-equiv\s*=\s*["'']?refresh') THEN regexp_extract(x, '(?i)url\s*=\s*[''"]?([^''">]+)', 1) END AS u FROM x),
e AS (SELECT DISTINCT a, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(r, '^[^/?#]*([^#]*)', 1) AS b
    FROM (SELECT a, substr(replace(u, '&amp;', '&'), strpos(u, '://') + 3) AS r FROM t WHERE contains(u, '://'))),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT node AS a, node AS b FROM n UNION SELECT b, b FROM e UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
component AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1),
rules(verdict, h, s) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
nodes AS (SELECT node, component, regexp_extract(node, '^[^/?#]*', 0) AS host, regexp_extract(node, '^[^/?#]*([^?#]*)', 1) AS path FROM component),
fits AS (SELECT node, component, rules.verdict, h || s AS rule, row_number() OVER (PARTITION BY node ORDER BY length(h || s) DESC, rules.verdict) AS k
    FROM nodes JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)),
best AS (SELECT * FROM fits WHERE k = 1),
shared AS (SELECT component, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict FROM best GROUP BY 1)
SELECT n.page_id, n.host, n.path, b.rule, coalesce(b.verdict, CASE WHEN n.node <> '' THEN s.verdict END, 'allow') AS verdict, c.component
FROM n LEFT JOIN component c ON n.node = c.node LEFT JOIN best b ON n.node = b.node LEFT JOIN shared s ON c.component = s.component
"""

_SPANS = """
SELECT row_id, '{kind}' AS kind, {number} AS number, m, g, start_at, start_at + length(m) AS end_at FROM (
  SELECT row_id, m, g, CAST(sum(length(piece)) OVER w + sum(length(m)) OVER w - length(m) AS BIGINT) AS start_at
  FROM (SELECT row_id, unnest(ms) AS m, unnest(gs) AS g, unnest(pieces[1:len(ms)]) AS piece, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT row_id, regexp_extract_all(text, '{p}', 0) AS ms, regexp_extract_all(text, '{p}', {group}) AS gs, string_split_regex(text, '{p}') AS pieces
    FROM d WHERE regexp_matches(text, '{p}')))
  WINDOW w AS (PARTITION BY row_id ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE {passes}
"""


def _spans(kind: str, number: int, p: str, group: int, passes: str) -> str:
    return _SPANS.format(kind=kind, number=number, p=p.replace("'", "''"), group=group, passes=passes)


# In the text of the patterns a capital or small letter may stand for the other. Runs are as long as can be, so that
# their least length stands in the pattern. RE2 has no look-around: candidates are whole runs, whose characters outside
# base spans make up the stretches to judge.
OP4 = (
    "WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS text FROM documents), base AS MATERIALIZED ("
    + " UNION ALL ".join([
        _spans("assign", 0, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, "length(g) >= 8"),
        _spans("access", 1, "AKIA[A-Z0-9]{12,}", 0, "true"),
        _spans("hex", 2, "[0-9a-f]{32,}", 0, "true"),
    ])
    + "), runs AS MATERIALIZED ("
    + _spans("entropy", 3, "[A-Za-z0-9+/_=-]{20,}", 0, "true")
    + r"""), chars AS (
  SELECT row_id, start_at AS run, start_at + k - 1 AS pos, substr(m, k, 1) AS c FROM (SELECT row_id, start_at, m, unnest(range(1, length(m) + 1)) AS k FROM runs)),
covered AS (SELECT DISTINCT row_id, unnest(range(start_at, end_at)) AS pos FROM base),
outside AS (SELECT c.*, c.pos - row_number() OVER (PARTITION BY c.row_id, run ORDER BY c.pos) AS island FROM chars c ANTI JOIN covered v ON c.row_id = v.row_id AND c.pos = v.pos),
candidates AS (
  SELECT * FROM (SELECT row_id, min(pos) AS start_at, max(pos) + 1 AS end_at, string_agg(c, '' ORDER BY pos) AS m FROM outside GROUP BY row_id, run, island)
  WHERE length(m) >= 20 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')),
masked AS (
  SELECT m, regexp_replace(m, '(?i)example|sample|placeholder|dummy|changeme|your[_-]|0123456789|abcdefgh|987654321', ' ', 'g') AS x FROM (SELECT DISTINCT m FROM candidates)
  WHERE NOT regexp_matches(m, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')
    AND NOT (len(list_filter(string_split_regex(m, '[/_=-]'), lambda s: s <> '')) > 1 AND len(list_filter(string_split_regex(m, '[/_=-]'),
      lambda s: s <> '' AND NOT regexp_full_match(s, '[A-Za-z]{1,20}[0-9]{0,4}|[0-9]{1,8}|[a-z0-9]{1,4}|[0-9]{1,2}T[0-9]{1,6}Z?'))) = 0)),
windows AS (
  SELECT m, max(h) AS h FROM (SELECT m, i, log2(20) - sum(n * log2(n)) / 20 AS h FROM (SELECT m, i, c, count(*) AS n FROM (
      SELECT m, i, unnest(string_split(substr(x, i, 20), '')) AS c FROM (SELECT m, x, unnest(range(1, length(x) - 18)) AS i FROM masked) WHERE NOT contains(substr(x, i, 20), ' ')) GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1),
high AS (
  SELECT row_id, 'entropy' AS kind, 3 AS number, start_at, end_at FROM candidates c JOIN windows w ON c.m = w.m
  WHERE round(w.h, 6) >= CASE WHEN regexp_full_match(c.m, '[0-9a-fA-F]+') THEN 3.0 ELSE 3.7 END),
every AS (SELECT row_id, kind, number, start_at, end_at FROM base UNION ALL SELECT * FROM high),
listed AS (SELECT row_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(concat(kind, ':', CAST(start_at AS VARCHAR), ':', CAST(end_at AS VARCHAR)), ',' ORDER BY start_at, number) FILTER (kind <> 'entropy') AS base_spans,
  string_agg(concat(kind, ':', CAST(start_at AS VARCHAR), ':', CAST(end_at AS VARCHAR)), ',' ORDER BY start_at, number) AS spans FROM every GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed l ON d.row_id = l.row_id
"""
)

OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS t FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY t) AS n FROM x) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(0, 35)) AS k)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t, count(*) AS n FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i WHERE g.i IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

OP6 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d),
h AS (SELECT doc_id, i, w[i:i + 2] AS t FROM g),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM h) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS bullets, len(list_filter(l, lambda x: regexp_matches(x, '(?:\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS dots FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
f AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
  + CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 3 * n_words OR word_chars > 10 * n_words THEN 16 ELSE 0 END
  + CASE WHEN 10 * bullets > 9 * n_lines THEN 32 ELSE 0 END + CASE WHEN 10 * dots > 3 * n_lines THEN 64 ELSE 0 END + CASE WHEN n_words > 100000 THEN 128 ELSE 0 END AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_bits & 3 <> 0 AS base_failed, failure_bits & 31 = 0 AS kept, CAST(failure_bits AS BIGINT) AS failure_bits FROM f
"""

_NORMAL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP10 = f"""
WITH d AS (SELECT doc_id, {_NORMAL} AS w FROM documents), b AS (SELECT item_id, {_NORMAL} AS w FROM benchmark),
p AS (SELECT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
x AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT x.doc_id, x.i, x.n, p.item_id FROM x JOIN p ON x.t = p.t AND x.n = p.n),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(i.l, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""

#: DuckDB has no crc32: of each byte's eight steps the first takes in the byte.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({x}, ''), lambda d: [ord(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END)))"""


def _levels(name: str, leaves: str, key: str, levels: int) -> str:
    """Tables {name}0 to {name}{levels} of nodes(key, i, h, n), n being the nodes of their level.

    A key with one node keeps it on the levels above. Enough for 16 ** levels leaves of a key.
    """
    out = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM ({leaves}))"]
    for d in range(1, levels + 1):
        out.append(f"{name}{d} AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM (SELECT {key}, i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{d - 1} GROUP BY 1, 2))")
    return ",\n".join(out)


def _way(name: str, key: str, levels: int, start: str) -> tuple[str, str]:
    """Joins along the path of row start(key, i), and its siblings' digests."""
    joins, sibs = [], []
    for d in range(levels):
        i = f"({start}.i // {16**d})"
        joins.append(f"LEFT JOIN (SELECT a.{key}, a.i, string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i) AS l, string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i) AS r, any_value(a.n) AS n FROM {name}{d} a JOIN {name}{d} b ON a.{key} = b.{key} AND a.i // 16 = b.i // 16 GROUP BY 1, 2) {name}_{d} ON {name}_{d}.{key} = {start}.{key} AND {name}_{d}.i = {i}")
        sibs.append(f"coalesce({name}_{d}.l, '') || coalesce({name}_{d}.r, '')")
    return "\n".join(joins), " || ".join(sibs)


def _folds(name: str, levels: int, first: int) -> str:
    """A table for each level: f is the digest so far, folded with the siblings of that level."""
    return ",\n".join(f"f{first + d} AS (SELECT * REPLACE (CASE WHEN {name}{d}n > 1 THEN sha256(coalesce({name}{d}l, '') || f || coalesce({name}{d}r, '')) ELSE f END AS f) FROM f{first + d - 1})" for d in range(levels))


def _op13(deep: int = 6, wide: int = 3) -> str:
    piece = lambda x: f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf = lambda x: "sha256(" + " || ".join([*map(piece, ("doc_id", "source", "lang", "n_chars")), piece(x)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    s_joins, s_sibs = _way("s", "k", deep, "d")
    r_joins, r_sibs = _way("r", "z", wide, "q")
    kept = ", ".join(f"{n}_{d}.{c} AS {n}{d}{c}" for n, m in (("s", deep), ("r", wide)) for d in range(m) for c in "lrn")
    return f"""
WITH l AS (SELECT doc_id, coalesce('=' || source, '') AS k, {leaf("text")} AS h, CASE WHEN {_CRC32.format(x="CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS t FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM l),
{_levels("s", "SELECT k, i, h FROM d", "k", deep)},
q AS (SELECT 1 AS z, row_number() OVER (ORDER BY k) - 1 AS i, k, h FROM s{deep}),
{_levels("r", "SELECT z, i, h FROM q", "z", wide)},
f0 AS (SELECT d.doc_id, d.h AS leaf, q.h AS subroot, (SELECT h FROM r{wide}) AS root, sha256({s_sibs} || {r_sibs}) AS proof_sha256, d.t AS f, {kept}
  FROM d JOIN q ON d.k = q.k
{s_joins}
{r_joins}),
{_folds("s", deep, 1)},
{_folds("r", wide, deep + 1)}
SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM f{deep + wide}
"""


OP12 = f"""
WITH o AS (SELECT conv_id, length(coalesce(text, '')) AS chars, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS id FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, id, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS pos FROM o),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {_CRC32.format(x="CAST(conv_id AS VARCHAR)")} % 6 AS h FROM own),
turns AS (
  SELECT c.conv_id, 0 AS own, pos, id, chars FROM c JOIN own ON own.conv_id = base AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, id, chars FROM c JOIN own ON own.conv_id = c.conv_id AND pos >= h),
full_turns AS (SELECT c.conv_id, coalesce(ids, []) AS ids, coalesce(chars, []) AS chars FROM c LEFT JOIN (SELECT conv_id, list(id ORDER BY own, pos) AS ids, list(chars ORDER BY own, pos) AS chars FROM turns GROUP BY 1) t ON c.conv_id = t.conv_id),
p AS (SELECT conv_id, d, len(ids) AS n, array_to_string(ids[1:d], ',') AS k, array_to_string(ids[1:d - 1], ',') AS up, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM full_turns)),
nodes AS (SELECT k, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, max(n) = d AS leaf, any_value(chars) AS chars, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM p GROUP BY 1, 2),
sums AS (SELECT p.k, p.d, count(*) FILTER (leaf) AS n_leaves, sum((nodes.n - 1) * nodes.chars) AS saved FROM nodes JOIN p ON nodes.conv_id = p.conv_id AND p.d <= nodes.d GROUP BY 1, 2),
kids AS (SELECT up, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2)
SELECT x.conv_id, x.d AS depth, u.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(kids.n, 0) AS n_children, sums.n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x JOIN sums ON x.k = sums.k AND x.d = sums.d LEFT JOIN kids ON x.k = kids.up AND x.d = kids.d LEFT JOIN nodes u ON x.d > 0 AND u.k = x.up AND u.d = x.d - 1
"""

OP13 = _op13()
ORACLES = {"op1_url_filters": OP1, "op4_secrets": OP4, "op5_substring_dedup": OP5, "op6_quality": OP6, "op10_decontamination": OP10, "op12_prefix_trie": OP12, "op13_merkle_manifest": OP13}
