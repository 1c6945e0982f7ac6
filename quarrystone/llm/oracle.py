"""The queries of this subpackage that SQL can express, in DuckDB's SQL, from their contracts."""

from __future__ import annotations

from quarrystone.llm import pii, urls
from quarrystone.llm.secrets import RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OPEN, _SHUT = "chr(57344)", "chr(57345)"  # signs that no text has


def _matches(pattern: str, t: str = "t") -> str:
    """A list of structs (s, e, v): the leftmost matches of a pattern that don't overlap."""
    pattern = pattern.replace("'", "''")
    pieces = f"string_split_regex(regexp_replace({t}, '{pattern}', {_OPEN} || '\\0' || {_SHUT}, 'g'), '[' || {_OPEN} || {_SHUT} || ']')"
    return (
        f"list_transform([{pieces}], lambda p: list_transform(range(2, len(p) + 1, 2),"
        " lambda i: {'s': length(array_to_string(p[1 : i - 1], '')), 'e': length(array_to_string(p[1 : i], '')), 'v': p[i]}))[1]"
    )


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = {
    "assign": (_ASSIGN, f"length(regexp_extract(x.v, '{_ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 8"),
    "access": ("AKIA[A-Z0-9]+", "length(x.v) >= 16"),
    "hex": ("[0-9a-f]{32,}", "TRUE"),  # the same as shorter runs dropped
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "TRUE"),
    "github": ("gh[pousr]_[A-Za-z0-9]{36,}", "TRUE"),
    "slack": ("xox[abprs]-[A-Za-z0-9-]{10,}", "TRUE"),
}


def _op2() -> str:
    place = {r.kind: i for i, r in enumerate(RULES)}
    parts = [f"SELECT r, {place[kind]} AS k, '{kind}' AS kind, x.s AS s, x.e AS e FROM (SELECT r, unnest({_matches(p)}) AS x FROM d) WHERE {fits}" for kind, (p, fits) in _SECRETS.items()]
    marks = _matches("-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----")
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
marks AS (SELECT r, x.s AS s, x.e AS e, starts_with(x.v, '-----BEGIN') AS opens FROM (SELECT r, unnest({marks}) AS x FROM d)),
pairs AS (SELECT r, lag(s) OVER w AS s, e, opens, lag(opens) OVER w AS opened FROM marks WINDOW w AS (PARTITION BY r ORDER BY s)),
found AS ({" UNION ALL ".join(parts)} UNION ALL SELECT r, {place["pem"]}, 'pem', s, e FROM pairs WHERE opened AND NOT opens),
lists AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, {listed} FILTER (k < 3) AS base, {listed} AS spans FROM found GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN lists USING (r)"""


_OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunks AS (SELECT doc_id, a, substr(h, 2 * a + 1, 2 * 4195) AS c FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0), 4096)) AS a FROM d)),
strings AS (SELECT doc_id, a + i AS p, md5_number(substr(c, 2 * i + 1, 200)) AS w FROM (SELECT doc_id, a, c, unnest(range(0, least(4096, length(c) // 2 - 99))) AS i FROM chunks)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS n FROM strings) WHERE n > 1),
steps AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 1 ELSE 0 END AS apart FROM again),
runs AS (SELECT doc_id, min(p) AS b, max(p) + 100 AS e FROM (SELECT doc_id, p, sum(apart) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM steps) GROUP BY doc_id, run),
kept AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a, b FROM runs),
pieces AS (SELECT doc_id, a, substr(h, 2 * a + 1, 2 * (b - a)) AS x FROM (SELECT * FROM kept UNION ALL SELECT doc_id, max(e), 1000000000 FROM runs GROUP BY doc_id) JOIN d USING (doc_id)),
cleaned AS (SELECT doc_id, string_agg(x, '' ORDER BY a) AS x FROM pieces GROUP BY doc_id),
gone AS (SELECT doc_id, sum(e - b) AS n, count(*) AS m FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(m, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(x, h))) AS kept_sha256
FROM d LEFT JOIN cleaned USING (doc_id) LEFT JOIN gone USING (doc_id)"""

_OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(13, len(w)) AS size, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS x
            FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM i WHERE len(w) > 0)),
places AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
hits AS (SELECT r, k, p.size AS size, item FROM (SELECT r, k, size, array_to_string(w[k : k + size - 1], ' ') AS x FROM places) p JOIN windows USING (size, x)),
marks AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(k, k + size)) AS place FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS x FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(m.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256,
       coalesce(m.n, 0) > 0 AND 20 * coalesce(m.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marks m USING (r) LEFT JOIN items USING (r)"""

_OP7 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM d WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
of AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN of USING (doc_id) LEFT JOIN sizes USING (doc_id)"""

def _op8() -> str:
    digits, luhn = "regexp_replace(x.v, '[^0-9]', '', 'g')", (
        "list_sum(list_transform(range(1, length(q) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(q[-i] AS INT) WHEN CAST(q[-i] AS INT) > 4 THEN 2 * CAST(q[-i] AS INT) - 9 ELSE 2 * CAST(q[-i] AS INT) END)) % 10 = 0"
    )
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "TRUE", "lower(v)"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda o: length(ltrim(o, '0')) > 3 OR coalesce(TRY_CAST(o AS INT), 256) > 255)) = 0", "v"),
        "card": (r"[0-9]([\x20-]?[0-9])+", f"length(q) BETWEEN 12 AND 19 AND {luhn}", "q"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(q) BETWEEN 9 AND 15", "q"),
    }
    parts = [
        f"SELECT r, {k} AS k, '{kind}' AS kind, s, e, '{kind}:' || {name} AS entity FROM (SELECT r, x.s AS s, x.e AS e, x.v AS v, {digits} AS q FROM (SELECT r, unnest({_matches(p)}) AS x FROM d)) WHERE {fits}"
        for k, (kind, (p, fits, name)) in enumerate(kinds.items())
    ]
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e)"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED ({" UNION ALL ".join(parts)}),
texts AS (SELECT t, min(r) AS r FROM d GROUP BY t),
said AS MATERIALIZED (SELECT r, unnest(list_distinct(list_filter(string_split_regex(lower(t), '[^\p{{L}}]+'), lambda w: length(w) >= 3))) AS term FROM texts),
held AS MATERIALIZED (SELECT DISTINCT r, entity FROM base JOIN texts USING (r)),
n_t AS (SELECT term, count(*) AS n_t FROM said GROUP BY term),
n_e AS (SELECT entity, count(*) AS n_e FROM held GROUP BY entity),
n_te AS (SELECT entity, term, count(*) AS n_te FROM held JOIN said USING (r) GROUP BY ALL),
told AS (SELECT entity, term FROM n_te JOIN n_t USING (term) JOIN n_e USING (entity), (SELECT count(*) AS n FROM texts)
         WHERE n_e >= {pii.SUPPORT} AND n_te >= {pii.SUPPORT} AND ln(n * n_te / (n_t * n_e)) / greatest(ln(n / n_e), 1e-9) >= {pii.GENERALISE}),
terms AS (SELECT DISTINCT r, term FROM base JOIN told USING (entity)),
words AS (SELECT r, x.s AS s, x.e AS e, x.v AS v FROM (SELECT r, unnest({_matches(r"\p{L}+")}) AS x FROM d SEMI JOIN terms USING (r))),
added AS (SELECT r, s, e FROM words w JOIN terms USING (r) WHERE lower(v) = term AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.s < w.e AND w.s < b.e)),
found AS (SELECT r, k, kind, s, e FROM base UNION ALL SELECT r, 4, 'term', s, e FROM added),
lists AS (SELECT r, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 3) AS n3, {listed} FILTER (k < 4) AS base, {listed} AS spans FROM found GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_email, coalesce(n1, 0) AS n_ip, coalesce(n2, 0) AS n_card, coalesce(n3, 0) AS n_phone, sha256(coalesce(lists.base, '')) AS base_sha256, coalesce(lists.spans, '') AS spans
FROM d LEFT JOIN lists USING (r)"""


_OP9 = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
                        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def _crc32(text: str) -> tuple[str, str]:
    """The unsigned crc32 of a string's UTF-8 bytes, and the table t that it reads."""
    table = "(SELECT list(list_reduce([k] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY k) FROM range(256) AS r(k))"
    octets = "list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))"
    steps = f"list_transform([hex(encode({text}))], lambda x: list_reduce([4294967295] || {octets}, lambda c, b: xor(c // 256, t.crc[1 + CAST(xor(c, b) % 256 AS INT)])))[1]"
    return f"xor({steps}, 4294967295)", f"t AS MATERIALIZED (SELECT {table} AS crc)"


def _op11() -> str:
    small = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    order = sorted(urls.RULES, key=lambda r: -len(r.name))
    rule = "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in order) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in order) + " END"
    left_out = ", ".join(f"'{w}'" for w in sorted(urls.rule_words(urls.RULES)))
    return rf"""
WITH RECURSIVE p AS MATERIALIZED (SELECT *, {verdict} AS ruled FROM (SELECT *, {rule} AS rule FROM (
       SELECT row_number() OVER () AS r, page_id, {small("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages))),
text AS (SELECT regexp_replace({small("coalesce(html, '')")}, '(?s)<script.*?</script>|<style.*?</style>|<[^>]*>|&[a-z0-9#]+;', ' ', 'g') AS t FROM pages),
counts AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '\p{{L}}+')) AS word FROM text) WHERE length(word) <= 20 GROUP BY word),
total AS MATERIALIZED (SELECT ln(greatest(coalesce(sum(n), 0), 1)) AS log_n FROM counts),
named AS MATERIALIZED (SELECT r, ruled, name FROM (SELECT r, ruled, unnest(list_transform(regexp_extract_all({small("host || '/' || path")}, '\p{{L}}+|[0-9]+'), lambda n: CASE WHEN regexp_matches(n, '^[0-9]') THEN '#' ELSE n END)) AS name FROM p)
          WHERE name NOT IN ({left_out})),
names AS MATERIALIZED (SELECT DISTINCT name, name <> '#' AND length(name) <= 63 AS short FROM named),
pieces AS (SELECT name, fin, size, substr(name, fin - size + 1, size) AS word FROM (SELECT name, fin, unnest(range(1, least(20, fin) + 1)) AS size FROM (SELECT name, unnest(range(1, length(name) + 1)) AS fin FROM names WHERE short))),
arcs AS MATERIALIZED (SELECT name, fin, list({{'size': size, 'cost': CAST(round(1e6 * CASE WHEN n IS NULL THEN log_n + size * ln(10) ELSE log_n - ln(n) END) AS BIGINT)}}) AS ways FROM total, pieces LEFT JOIN counts USING (word) GROUP BY name, fin),
best AS (SELECT name, 0 AS i, [{{'c': 0::BIGINT, 'n': 0::BIGINT, 's': 0::BIGINT}}] AS b FROM names WHERE short
         UNION ALL SELECT name, i + 1, list_append(b, list_min(list_transform(ways, lambda a: {{'c': b[i + 2 - a.size].c + a.cost, 'n': b[i + 2 - a.size].n + 1, 's': -a.size}}))) FROM best JOIN arcs USING (name) WHERE fin = i + 1),
walk AS (SELECT name, b, i AS fin, CAST(NULL AS VARCHAR) AS word FROM best WHERE i = length(name)
         UNION ALL SELECT name, b, fin + b[fin + 1].s, substr(name, fin + b[fin + 1].s + 1, -b[fin + 1].s) FROM walk WHERE fin > 0),
words AS MATERIALIZED (SELECT name, word FROM walk WHERE word IS NOT NULL UNION ALL SELECT name, name FROM names WHERE NOT short),
model AS MATERIALIZED (SELECT word, count(*) FILTER (ruled = 'block') AS b, count(*) FILTER (ruled = 'allow') AS a FROM named JOIN words USING (name) GROUP BY word),
sums AS MATERIALIZED (SELECT coalesce(sum(a), 0) AS a, coalesce(sum(b), 0) AS b, count(*) FILTER (a + b > 0) + 1 AS v FROM model),
weights AS (SELECT word, CAST(round(1e6 * (ln(model.b + 1) - ln(model.a + 1) + (ln(sums.a + v) - ln(sums.b + v)))) AS BIGINT) AS weight FROM model, sums),
of_page AS (SELECT r, sum(weight) AS weight FROM named JOIN words USING (name) JOIN weights USING (word) GROUP BY r),
prior AS (SELECT CAST(round(1e6 * (ln(count(*) FILTER (ruled = 'block') + 1) - ln(count(*) FILTER (ruled = 'allow') + 1))) AS BIGINT) AS prior FROM p)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN s > 0 THEN 'block' ELSE 'allow' END) AS verdict, CAST(s AS DOUBLE) / 1e6 AS score
FROM (SELECT p.*, coalesce(weight, 0) + prior AS s FROM prior, p LEFT JOIN of_page USING (r))"""


def _op12() -> str:
    crc, crc_table = _crc32("k")
    return rf"""
WITH RECURSIVE {crc_table},
runs AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, times, {crc} AS h FROM (SELECT run, times, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k FROM runs), t),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT a.word AS word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word AS word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (SELECT word, word AS last, 0 AS d FROM forms UNION ALL SELECT chain.word, form, d + 1 FROM chain JOIN forms ON forms.word = last WHERE form IS NOT NULL),
roots AS (SELECT word, arg_max(last, d) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""


def _op13() -> str:
    crc, crc_table = _crc32("CAST(c AS VARCHAR)")
    return rf"""
WITH {crc_table},
turns AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS k, {{'role': role, 'text': text}} AS said
          FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS MATERIALIZED (SELECT c, c - c % 20 AS base, {crc} % 4 AS h FROM (SELECT DISTINCT c FROM turns), t),
again AS (SELECT convs.c AS c, 0 AS part, k, said FROM convs JOIN turns ON turns.c = base AND k <= h UNION ALL SELECT convs.c, 1, k, said FROM convs JOIN turns ON turns.c = convs.c AND k > h),
paths AS MATERIALIZED (SELECT convs.c AS c, coalesce(list(said ORDER BY part, k) FILTER (said IS NOT NULL), []) AS path FROM convs LEFT JOIN again ON again.c = convs.c GROUP BY convs.c),
occurs AS MATERIALIZED (SELECT c, d, path[1 : d] AS prefix, len(path) AS l FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM paths)),
nodes AS MATERIALIZED (SELECT prefix, d, min(c) AS c, count(*) AS n, bool_and(l = d) AS childless, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (l = d), '') AS ends,
          (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(prefix[d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM occurs GROUP BY prefix, d),
below AS (SELECT prefix[1 : k] AS top, saved, childless, d - k AS away FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM nodes)),
sums AS (SELECT top, sum(saved) AS saved, count(*) FILTER (childless) AS leaves, count(*) FILTER (away = 1) AS children FROM below GROUP BY top)
SELECT x.c AS conv_id, CAST(x.d AS BIGINT) AS depth, up.c AS parent_conv_id, x.n AS n_convs, s.children AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x JOIN sums s ON s.top = x.prefix LEFT JOIN nodes up ON x.d > 0 AND up.prefix = x.prefix[1 : x.d - 1]"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": _op2(), "op4_suffix_dedup": _OP4, "op6_decontamination": _OP6, "op7_minhash_dedup": _OP7, "op8_pii": _op8(), "op9_exact_topk": _OP9, "op11_url_filter": _op11(), "op12_spelling_variants": _op12(), "op13_prefix_trie": _op13()}
