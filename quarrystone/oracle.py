"""The registered queries in DuckDB's SQL, written from the rules' definitions, on the same derived extracts."""

from __future__ import annotations

from quarrystone import config
from quarrystone.config import CITY_ALIASES, COUNTRIES, LEGAL_TOKENS, NAME_ABBREVIATIONS
from quarrystone.functions.privacy import pads, secret_key
from quarrystone.operators.learning import TREE_ROWS, TREES
from quarrystone.operators.rules import ANOMALY, RULES
from quarrystone.sources.extract import INVOICES_SQL, SPELLED_SQL, VENDORS_SQL

_AS_OF = f"DATE '{config.AS_OF}'"


def _case(of: str, pairs: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {of}" + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {default} END"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _token(value: str, kind: str) -> str:
    inner, outer = (p.hex() for p in pads(secret_key()))
    return f"'tok_' || substr(sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode('{kind}:' || {value})))), 1, 24)"


_TOKENS = f"list_filter(string_split_regex(regexp_replace(replace(upper(vendor_name), '.', ''), '[^A-Z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> '' AND NOT list_contains({_list(LEGAL_TOKENS)}, w))"
_ISO = {n: iso for iso, (name, iso3, _, _) in COUNTRIES.items() for n in (iso, iso3, name.upper())}
_CURRENCY = {iso: c[3] for iso, c in COUNTRIES.items()}

_BASE = f"""vr AS MATERIALIZED ({VENDORS_SQL}),
ir AS MATERIALIZED ({INVOICES_SQL}),
v0 AS (SELECT *, regexp_replace(regexp_replace(phone_raw, '[^0-9]', '', 'g'), '^00', '') AS digits, lower(nullif(trim(email_raw), '')) AS em, nullif(regexp_replace(bank_raw, '[^0-9]', '', 'g'), '') AS bk, {_TOKENS} AS toks FROM vr),
v1 AS (SELECT *, CASE WHEN length(digits) >= 8 THEN '+' || digits END AS ph FROM v0),
v AS MATERIALIZED (SELECT record_key, source AS source_system, source_vendor_id, regexp_replace(trim(vendor_name), '\\s+', ' ', 'g') AS vendor_name,
  nullif(array_to_string(list_transform(toks, lambda w: {_case("w", NAME_ABBREVIATIONS, "w")}), ' '), '') AS vendor_name_norm, street,
  {_case("upper(city_raw)", CITY_ALIASES)} AS city, country_raw, {_case("upper(country_raw)", _ISO)} AS country_iso2,
  nullif(upper(regexp_replace(tax_id_raw, '[^A-Za-z0-9]', '', 'g')), '') AS tax_id,
  left(ph, 3) || repeat('*', greatest(length(ph) - 7, 0)) || right(ph, 4) AS phone,
  CASE WHEN contains(email_raw, '@') THEN left(email_raw, 1) || '***@' || string_split(email_raw, '@')[-1] ELSE left(email_raw, 1) || '***' END AS email,
  '****' || right(bk, 4) AS bank_account, {_token("ph", "phone")} AS phone_token, {_token("em", "email")} AS email_token, {_token("bk", "bank")} AS bank_token,
  CASE WHEN contains(em, '@') THEN string_split(em, '@')[-1] END AS email_domain FROM v1),
i AS MATERIALIZED (SELECT record_key, source AS source_system, invoice_no, source_vendor_id, vendor_record_key, nullif(trim(invoice_date_raw), '') AS invoice_date_raw,
  CAST(CASE source WHEN 'ERP_A' THEN try_strptime(invoice_date_raw, '%Y%m%d') WHEN 'ERP_B' THEN try_strptime(invoice_date_raw, '%d-%b-%Y') ELSE try_strptime(invoice_date_raw, '%Y-%m-%d') END AS DATE) AS invoice_date,
  TRY_CAST(replace(amount_raw, ',', '') AS DOUBLE) AS amount, nullif(trim(currency_raw), '') AS currency_raw, upper(nullif(trim(currency_raw), '')) AS currency, CAST(NULL AS VARCHAR) AS fixed_by FROM ir),
lim AS (SELECT vendor_record_key, {config.ANOMALY_MULTIPLIER} * quantile_cont(amount, 0.5) AS lim FROM i WHERE amount > 0 GROUP BY 1 HAVING count(*) >= {config.ANOMALY_MIN_HISTORY}),
ctx AS MATERIALIZED (SELECT i.*, v.record_key IS NOT NULL AS known, count(*) OVER (PARTITION BY i.record_key) AS copies, coalesce(i.amount > lim.lim, FALSE) AS outlier
  FROM i LEFT JOIN v ON v.record_key = i.vendor_record_key LEFT JOIN lim ON lim.vendor_record_key = i.vendor_record_key),
vf AS (SELECT *, list_filter([CASE WHEN tax_id IS NULL THEN 'R01' END, CASE WHEN tax_id IS NOT NULL AND NOT regexp_matches(tax_id, '{config.TAX_ID_PATTERN}') THEN 'R02' END,
  CASE WHEN country_iso2 IS NULL THEN 'R03' END, CASE WHEN email IS NOT NULL AND NOT regexp_matches(email, '{config.EMAIL_PATTERN}') THEN 'R04' END], lambda x: x IS NOT NULL) AS f FROM v),
f AS MATERIALIZED (SELECT *, list_filter([CASE WHEN outlier THEN 'A01' END, CASE WHEN amount IS NULL OR amount <= 0 THEN 'R05' END, CASE WHEN invoice_date IS NULL OR invoice_date > {_AS_OF} THEN 'R06' END,
  CASE WHEN currency IS NULL OR currency NOT IN ('INR', 'USD', 'GBP', 'EUR', 'SGD') THEN 'R07' END, CASE WHEN NOT known THEN 'R08' END, CASE WHEN copies > 1 THEN 'R09' END], lambda x: x IS NOT NULL) AS f FROM ctx),
flags AS MATERIALIZED (SELECT DISTINCT unnest(f) AS rule_id, 'vendor' AS entity, record_key, 'enforce' AS mode FROM vf UNION ALL SELECT DISTINCT unnest(f), 'invoice', record_key, 'enforce' FROM f),
rate AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {r})" for c, r in config.FX_TO_USD.items())}) t(currency, usd))"""

_SIM = """CASE WHEN x IS NULL OR y IS NULL OR x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0 ELSE
  2.0 * (length(x) - bit_count(list_reduce(list_prepend((1::BIGINT << length(x)) - 1, list_transform(string_split(y, ''), lambda c:
    CAST(coalesce(list_sum(list_transform(range(length(x)), lambda p: CASE WHEN substr(x, CAST(p AS INT) + 1, 1) = c THEN 1::BIGINT << CAST(p AS INT) ELSE 0 END)), 0) AS BIGINT))),
    lambda s, m: ((s + (s & m)) | (s - (s & m))) & ((1::BIGINT << length(x)) - 1)))) / (length(x) + length(y)) END"""


def _valid(c: str) -> str:
    return f"coalesce(regexp_matches({c}, '{config.TAX_ID_PATTERN}'), FALSE)"


_PAIRS = f"""keys AS (SELECT 'tax|' || tax_id AS block, record_key FROM v WHERE {_valid("tax_id")} UNION ALL SELECT 'phone|' || phone_token, record_key FROM v WHERE phone_token IS NOT NULL
  UNION ALL SELECT 'name|' || coalesce(country_iso2, '??') || '|' || substr(coalesce(vendor_name_norm, ''), 1, 4), record_key FROM v),
good AS (SELECT block FROM keys GROUP BY 1 HAVING count(*) BETWEEN 2 AND {config.MAX_BLOCK}),
pairs AS MATERIALIZED (SELECT DISTINCT a.record_key AS left_key, b.record_key AS right_key FROM keys a JOIN good USING (block) JOIN keys b USING (block) WHERE a.record_key < b.record_key),
p0 AS (SELECT left_key, right_key, l.vendor_name AS left_name, r.vendor_name AS right_name, array_to_string(list_sort(string_split(l.vendor_name_norm, ' ')), ' ') AS x, array_to_string(list_sort(string_split(r.vendor_name_norm, ' ')), ' ') AS y,
  {_valid("l.tax_id")} AND {_valid("r.tax_id")} AND l.tax_id = r.tax_id AS tax_eq, {_valid("l.tax_id")} AND {_valid("r.tax_id")} AND l.tax_id <> r.tax_id AS tax_conflict,
  coalesce(l.city = r.city, FALSE) AS city_eq, coalesce(l.phone_token = r.phone_token, FALSE) AS phone_eq, coalesce(l.email_domain = r.email_domain, FALSE) AS domain_eq
  FROM pairs JOIN v l ON l.record_key = left_key JOIN v r ON r.record_key = right_key),
p1 AS MATERIALIZED (SELECT *, {_SIM} AS sim FROM p0),
p2 AS (SELECT *, round(sim, 4) AS name_similarity, round(CASE WHEN tax_eq THEN 0.6 + 0.4 * sim WHEN tax_conflict THEN 0.4 * sim ELSE 0.55 * sim + 0.15 * city_eq::INT + 0.15 * phone_eq::INT + 0.15 * domain_eq::INT END, 4) AS score FROM p1),
scored AS MATERIALIZED (SELECT left_key, right_key, left_name, right_name, name_similarity, tax_eq, tax_conflict, city_eq, phone_eq, domain_eq, score,
  CASE WHEN score >= 0.9 THEN 'HIGH' WHEN score >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS band,
  'tax:' || CASE WHEN tax_eq THEN 'same' WHEN tax_conflict THEN 'conflict' ELSE 'missing' END || '|name>=' || CASE WHEN name_similarity >= 1 THEN '1.0' ELSE '0.' || CAST(floor(name_similarity * 10) AS INT) END
    || '|city:' || CASE WHEN city_eq THEN 'y' ELSE 'n' END || '|phone:' || CASE WHEN phone_eq THEN 'y' ELSE 'n' END || '|domain:' || CASE WHEN domain_eq THEN 'y' ELSE 'n' END AS signature,
  CASE WHEN tax_eq THEN 'Same tax ID; n' WHEN tax_conflict THEN 'Different valid tax IDs; n' ELSE 'N' END || 'ame similarity ' || printf('%.2f', CAST(round(CAST(name_similarity AS DECIMAL(10, 4)), 2) AS DOUBLE)) || CASE WHEN city_eq THEN '; same city' ELSE '; different or missing city' END
    || CASE WHEN phone_eq THEN '; same phone' ELSE '' END || CASE WHEN domain_eq THEN '; same email domain' ELSE '' END AS explanation FROM p2)"""

_GOLD = f"""sym AS (SELECT left_key AS a, right_key AS b FROM scored WHERE band = 'HIGH' UNION ALL SELECT right_key, left_key FROM scored WHERE band = 'HIGH'),
reach(a, b) AS (SELECT record_key, record_key FROM v UNION SELECT reach.a, sym.b FROM reach JOIN sym ON sym.a = reach.b),
cl AS MATERIALIZED (SELECT a AS record_key, min(b) AS cluster FROM reach GROUP BY 1),
mk AS (SELECT cluster, '{config.MASTER_KEY_PREFIX}' || lpad(CAST(row_number() OVER (ORDER BY count(*) DESC, cluster) AS VARCHAR), 6, '0') AS master_key FROM cl GROUP BY cluster),
m AS MATERIALIZED (SELECT v.*, mk.master_key, row_number() OVER (ORDER BY CASE source_system WHEN 'ERP_C' THEN 1 WHEN 'ERP_A' THEN 2 ELSE 3 END, record_key) AS rk FROM v JOIN cl USING (record_key) JOIN mk USING (cluster)),
xref AS MATERIALIZED (SELECT master_key, record_key, source_system, source_vendor_id FROM m)"""


def _modes(c: str, valid: str = "TRUE") -> str:
    return f"mode_{c} AS (SELECT master_key, arg_min({c}, o) AS {c} FROM (SELECT master_key, {c}, row_number() OVER (PARTITION BY master_key ORDER BY count(*) DESC, min(rk)) AS o FROM m WHERE {c} IS NOT NULL AND {c} <> '' AND {valid} GROUP BY master_key, {c}) WHERE o = 1 GROUP BY master_key)"


_MODE_COLUMNS = ("vendor_name_norm", "tax_id", "country_iso2", "city", "phone_token", "email_token", "bank_token")
_GOLDEN = (
    ",\n".join(_modes(c, _valid("tax_id") if c == "tax_id" else "TRUE") for c in _MODE_COLUMNS)
    + f""",
firsts AS (SELECT m.master_key, coalesce(arg_min(m.vendor_name, rk) FILTER (WHERE m.vendor_name_norm = n.vendor_name_norm), arg_min(m.vendor_name, rk)) AS vendor_name, arg_min(street, rk) FILTER (WHERE street <> '') AS street,
  arg_min(phone, rk) FILTER (WHERE phone <> '') AS phone, arg_min(email, rk) FILTER (WHERE regexp_matches(email, '{config.EMAIL_PATTERN}')) AS email, arg_min(bank_account, rk) FILTER (WHERE bank_account <> '') AS bank_account,
  string_agg(DISTINCT source_system, ',' ORDER BY source_system) AS source_systems, count(*) AS member_count FROM m LEFT JOIN mode_vendor_name_norm n USING (master_key) GROUP BY 1),
gold AS MATERIALIZED (SELECT * FROM firsts {" ".join(f"LEFT JOIN mode_{c} USING (master_key)" for c in _MODE_COLUMNS)}),
fact AS MATERIALIZED (SELECT f.record_key, master_key, f.source_system, invoice_no, invoice_date, currency, amount, round(amount * usd, 2) AS amount_usd FROM f JOIN xref ON xref.record_key = vendor_record_key JOIN rate USING (currency) WHERE len(f) = 0)"""
)

_PATTERNS = """fa AS (SELECT fl.rule_id, fl.record_key, v.tax_id, v.country_raw, ii.amount, ii.invoice_date, ii.currency_raw FROM flags fl LEFT JOIN v USING (record_key)
  LEFT JOIN (SELECT record_key, min(amount) AS amount, min(invoice_date) AS invoice_date, min(currency_raw) AS currency_raw FROM i GROUP BY 1) ii USING (record_key)),
fs AS (SELECT *, CASE rule_id WHEN 'R01' THEN 'tax ID missing' WHEN 'R02' THEN CASE WHEN length(tax_id) < 12 THEN 'tax ID too short' WHEN length(tax_id) > 12 THEN 'tax ID too long' ELSE 'tax ID bad characters' END
  WHEN 'R03' THEN 'country ''' || coalesce(country_raw, '(blank)') || '''' WHEN 'R04' THEN 'email without a valid domain' WHEN 'R05' THEN CASE WHEN amount IS NULL THEN 'amount missing' ELSE 'amount zero or negative' END
  WHEN 'R06' THEN CASE WHEN invoice_date IS NULL THEN 'date unparseable' ELSE 'date in the future' END WHEN 'R07' THEN 'currency ''' || coalesce(upper(currency_raw), '(blank)') || '''' WHEN 'R08' THEN 'vendor ID not in vendor master'
  WHEN 'R09' THEN 'duplicate invoice number' ELSE 'amount over 20x the vendor''s median' END AS signature FROM fa),
dp AS (SELECT rule_id, CASE WHEN rule_id = 'R07' AND signature <> 'currency ''XXX''' THEN split_part(record_key, ':', 1) ELSE '*' END AS source_system, signature, count(DISTINCT record_key) AS affected_records FROM fs GROUP BY ALL),
dqp AS (SELECT 'P-' || substr(sha1(CASE WHEN source_system <> '*' THEN 'FIX:' ELSE 'ACK:' END || rule_id || ':' || source_system || ':' || signature), 1, 10) AS pattern_id,
  CASE WHEN source_system <> '*' THEN 'record_fix' ELSE 'acknowledge' END AS kind, rule_id, source_system, signature, affected_records FROM dp)"""
_MATCH_PATTERNS = """mp AS (SELECT 'P-' || substr(sha1('MATCH:' || signature), 1, 10) AS pattern_id, 'match_rule' AS kind, 'MATCH:' || signature AS item_id, signature, count(*) AS affected_records,
  CASE WHEN avg(score) >= 0.8 THEN 'match' ELSE 'no_match' END AS decision, round(avg(score), 3) AS confidence FROM scored WHERE band = 'MEDIUM' GROUP BY signature)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


_B, _P = _with(_BASE), _with(_BASE, _PAIRS)
_G, _S = _with(_BASE, _PAIRS, _GOLD), _with(_BASE, _PAIRS, _GOLD, _GOLDEN)
_KEYS = "(SELECT record_key FROM v UNION ALL SELECT record_key FROM i)"

_CARD = " UNION ALL ".join(
    f"SELECT '{r.id}' AS rule_id, '{r.name.replace(chr(39), chr(39) * 2)}' AS name, '{r.entity}' AS entity, '{r.dimension}' AS dimension, '{r.severity}' AS severity, count(*) AS evaluated, count(*) FILTER (WHERE list_contains(f, '{r.id}')) AS failed,"
    f" round(1 - count(*) FILTER (WHERE list_contains(f, '{r.id}')) / count(*), 4) AS pass_rate, 'enforce' AS mode FROM {'vf' if r.entity == 'vendor' else 'f'}"
    for r in (*RULES, ANOMALY)
)
_SCORES = """SELECT source_system, 'vendor' AS entity, count(*) AS records, CAST(sum((len(f) = 0)::INT) AS BIGINT) AS passed, round(avg((len(f) = 0)::INT), 4) AS score FROM vf GROUP BY 1
UNION ALL SELECT source_system, 'invoice', count(*), CAST(sum((len(f) = 0)::INT) AS BIGINT), round(avg((len(f) = 0)::INT), 4) FROM f GROUP BY 1"""
_INVOICE_KEY = "CASE o_custkey % 3 WHEN 0 THEN 'ERP_A' WHEN 1 THEN 'ERP_B' ELSE 'ERP_C' END || ':INV:INV' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0')"
_VENDOR_KEY = "CASE c_custkey % 3 WHEN 0 THEN 'ERP_A' WHEN 1 THEN 'ERP_B' ELSE 'ERP_C' END || ':' || CAST(c_custkey AS VARCHAR)"
_INVOICE_DEFECTS = {
    "amount_missing": ("R05", "k % 33 = 2"), "amount_negative": ("R05", "k % 33 <> 2 AND k % 25 = 1"), "date_invalid": ("R06", "k % 33 = 5"), "date_future": ("R06", "k % 33 <> 5 AND k % 25 = 4"),
    "currency_missing": ("R07", "k % 20 = 6"), "currency_unknown": ("R07", "k % 20 = 16"), "orphan": ("R08", "k % 20 = 7"), "duplicate": ("R09", "k % 25 = 8"), "outlier": ("A01", "k % 25 <> 1 AND k % 33 = 3"),
}
_VENDOR_DEFECTS = {"tax_missing": ("R01", "k % 10 = 3"), "tax_invalid": ("R02", "k % 10 <> 3 AND k % 17 = 5"), "country_invalid": ("R03", "k % 20 = 11"), "email_invalid": ("R04", "k % 12 = 7")}
_DEFECTS = "defects AS (" + " UNION ALL ".join(
    f"SELECT '{entity}' AS entity, {key} AS record_key, '{rule}' AS expected_rule, '{d}' AS defect_type FROM (SELECT *, {col} AS k FROM {table}) WHERE {cond}"
    for entity, key, col, table, kinds in (("invoice", _INVOICE_KEY, "o_orderkey", "orders", _INVOICE_DEFECTS), ("vendor", _VENDOR_KEY, "c_custkey", "customer", _VENDOR_DEFECTS))
    for d, (rule, cond) in kinds.items()
) + ")"
_ALERTS = _S + """, al AS (SELECT m.master_key, count(*) AS member_count, count(DISTINCT CASE WHEN """ + _valid("tax_id") + """ THEN tax_id END) AS taxes, count(DISTINCT country_iso2) AS countries, count(DISTINCT bank_token) AS banks,
  string_agg(record_key, ',' ORDER BY record_key) AS members FROM m GROUP BY 1 HAVING count(*) > 1),
nm AS (SELECT DISTINCT master_key, replace(vendor_name_norm, ' ', '') AS x FROM m WHERE vendor_name_norm IS NOT NULL),
np AS (SELECT a.master_key, a.x, b.x AS y FROM nm a JOIN nm b ON a.master_key = b.master_key AND a.x < b.x),
worst AS (SELECT master_key, min(s) AS worst FROM (SELECT master_key, round(""" + _SIM + """, 4) AS s FROM np) GROUP BY 1),
alerts AS (SELECT master_key, concat_ws('; ', CASE WHEN taxes > 1 THEN taxes || ' different valid tax IDs' END, CASE WHEN countries > 1 THEN 'members in different countries' END, CASE WHEN banks > 1 THEN 'different bank accounts' END,
  CASE WHEN worst < 0.6 AND taxes <> 1 AND banks <> 1 THEN 'dissimilar names (similarity ' || printf('%.2f', worst) || ') and no shared tax ID or bank account' END) AS issues, members, member_count FROM al LEFT JOIN worst USING (master_key))
"""  # fmt: skip
_TRUTH = "tr AS (SELECT record_key, true_vendor FROM vr),\nbo AS (SELECT master_key, true_vendor, count(*) AS n FROM xref JOIN tr USING (record_key) GROUP BY 1, 2),\nexact AS (SELECT true_vendor, sum(n) AS records FROM bo GROUP BY 1 HAVING count(*) = 1 AND min(master_key) IN (SELECT master_key FROM bo GROUP BY 1 HAVING count(*) = 1))"
_VOCAB = """tok AS (SELECT unnest(list_distinct(list_filter(string_split_regex(regexp_replace(replace(upper({c}), '.', ''), '[^A-Z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> '' AND NOT list_contains(""" + _list(LEGAL_TOKENS) + """, w)))) AS token FROM {t}),
vo AS (SELECT token, count(*) AS names, CASE WHEN count(*) >= greatest(3, least(20, floor((SELECT count(*) FROM {t}) / 300))) THEN 'core' WHEN NOT regexp_matches(token, '^[0-9]+$') THEN 'rare' END AS kind FROM tok GROUP BY 1)"""  # fmt: skip
_LEARNED = _with(_BASE, _VOCAB.replace("{c}", "vendor_name").replace("{t}", "vr")) + f""",
open AS (SELECT 'city' AS domain, upper(trim(city_raw)) AS raw, count(*) AS affected FROM vr WHERE trim(city_raw) <> '' AND upper(trim(city_raw)) NOT IN ({", ".join(repr(c.upper()) for c in config.CITIES)}) GROUP BY 2
  UNION ALL SELECT 'currency', upper(trim(currency_raw)), count(*) FROM ir WHERE trim(currency_raw) <> '' AND upper(trim(currency_raw)) NOT IN ({", ".join(map(repr, config.VALID_CURRENCIES))}) GROUP BY 2
  UNION ALL SELECT 'token', token, names FROM vo WHERE kind = 'rare'),
words AS (SELECT domain, raw, unnest({_list(list(config.CITIES))}) AS canonical FROM open WHERE domain = 'city' UNION ALL SELECT domain, raw, unnest({_list(list(config.VALID_CURRENCIES))}) FROM open WHERE domain = 'currency'
  UNION ALL SELECT domain, raw, token FROM open JOIN vo ON domain = 'token' AND kind = 'core'
  UNION ALL SELECT 'legal', raw, unnest({_list(LEGAL_TOKENS)}) FROM open WHERE domain = 'token' AND length(raw) > 2),
sorted AS (SELECT *, array_to_string(list_sort(string_split(raw, ' ')), ' ') AS x, array_to_string(list_sort(string_split(upper(canonical), ' ')), ' ') AS y FROM words),
scored AS (SELECT domain, raw, canonical, {_SIM} AS sim FROM sorted),
legal AS (SELECT raw, max(sim) AS sim FROM scored WHERE domain = 'legal' AND substr(raw, 1, 1) = substr(canonical, 1, 1) GROUP BY 1 HAVING max(sim) >= 0.75),
best AS (SELECT domain, raw, options, best, best_s, substr(raw, 1, 1) = substr(upper(best), 1, 1) AS first, domain <> 'currency' AND best_s >= 0.85 AND first AND abs(length(raw) - length(best)) <= 2 AS near
  FROM (SELECT domain, raw, list(canonical ORDER BY sim DESC, canonical)[1 : 5] AS options, list(canonical ORDER BY sim DESC, canonical)[1] AS best, max(sim) AS best_s FROM scored WHERE domain <> 'legal' GROUP BY 1, 2)),
learned AS (SELECT domain, raw, affected, CASE WHEN near THEN best WHEN domain <> 'token' THEN NULL WHEN legal.sim IS NOT NULL THEN '{config.LEGAL_MARK}' WHEN first THEN best END AS canonical,
  coalesce(round(CASE WHEN near THEN best_s WHEN domain <> 'token' THEN NULL WHEN legal.sim IS NOT NULL THEN legal.sim WHEN first THEN best_s END, 3), 0.0) AS confidence, options
  FROM open LEFT JOIN best USING (domain, raw) LEFT JOIN legal ON legal.raw = open.raw AND domain = 'token'),
lm AS (SELECT domain, raw, canonical, confidence, affected, CASE WHEN canonical IS NULL THEN 'none' ELSE 'rule' END AS source, coalesce(array_to_string(options, '|'), '') AS options, canonical IS NOT NULL AND confidence >= 0.9 AS approved FROM learned)"""
_SHAPE = "substr(regexp_replace(regexp_replace(value, '\\p{L}', 'A', 'g'), '[0-9]', '9', 'g'), 1, 24)"
_PROFILE = _B + """, cells AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value FROM v" for c in ("vendor_name", "country_raw", "tax_id", "city", "email_domain")) + f"""),
base AS (SELECT col, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS nulls, count(DISTINCT value) + max((value IS NULL)::INT) AS d FROM cells GROUP BY 1),
sh AS (SELECT col, {_SHAPE} AS shape, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY 1, 2),
top AS (SELECT col, shape, sh.n, row_number() OVER (PARTITION BY col ORDER BY sh.n DESC, shape) AS pos FROM sh QUALIFY pos <= 3)
SELECT 'silver_vendor' AS "table", base.col AS "column", base.n AS rows, round(nulls / base.n, 4) AS null_rate, d AS "distinct", (SELECT string_agg(shape || '=' || CAST(round(top.n / base.n, 2) AS VARCHAR), '; ' ORDER BY pos) FROM top WHERE top.col = base.col) AS top_patterns FROM base"""  # fmt: skip

ORACLE = {
    "std_vendor": _B + "SELECT * FROM v",
    "std_vendor_seed_mappings": _B + f""", s AS (SELECT record_key, nullif(array_to_string(toks, ' '), '') AS vendor_name_norm, CASE upper(city_raw) {" ".join(f"WHEN '{c.upper()}' THEN '{c}'" for c in config.CITIES)} ELSE
      upper(left(city_raw, 1)) || lower(substr(city_raw, 2)) END AS city, ph AS phone, em AS email, bk AS bank_account FROM v1) SELECT * FROM s""",
    "std_invoice": _B + "SELECT * REPLACE (CAST(invoice_date AS VARCHAR) AS invoice_date) FROM i",
    "pii_tokens": _B + "SELECT record_key, phone, email, bank_account, phone_token, email_token, bank_token FROM v",
    "pii_vault": _B + "SELECT record_key, 'phone' AS field, phone_raw AS raw_value FROM vr UNION ALL SELECT record_key, 'email', email_raw FROM vr UNION ALL SELECT record_key, 'bank', bank_raw FROM vr",
    "pii_leak_audit": _B + "SELECT 'phone_raw' AS \"column\", count(*) AS n FROM vr UNION ALL SELECT 'email_raw', count(*) FROM vr UNION ALL SELECT 'bank_raw', count(*) FROM vr",
    "invoice_fixes": _B + f""", j AS (SELECT i.*, {_case("v.country_iso2", _CURRENCY)} AS cc FROM i LEFT JOIN v ON v.record_key = i.vendor_record_key),
      k AS (SELECT *, CASE WHEN cc IS NULL THEN NULL WHEN currency_raw = 'XXX' THEN 'FIX:R07:*:currency ''XXX''' WHEN currency_raw IS NULL AND source_system <> 'ERP_C' THEN 'FIX:R07:' || source_system || ':currency ''(blank)''' END AS fx FROM j)
      SELECT record_key, currency_raw, CASE WHEN fx IS NULL THEN currency ELSE cc END AS currency, fx AS fixed_by FROM k""",
    "dq_failures": _B + "SELECT * FROM flags",
    "dq_scorecard": _B + _CARD,
    "dq_shadow_rules": _B + "SELECT CASE WHEN rule_id IN ('R05', 'R07') THEN 'shadow' ELSE 'enforce' END AS mode, rule_id, count(*) AS failing_keys FROM flags GROUP BY ALL",
    "dq_range": "SELECT 'C01' AS rule_id, count(*) AS failed, count(DISTINCT c_custkey) AS failing_keys FROM customer WHERE c_acctbal IS NULL OR c_acctbal < -500 OR c_acctbal > 9000 HAVING count(*) > 0",
    "dq_allowed": "SELECT 'C02' AS rule_id, count(*) AS failed, count(DISTINCT c_custkey) AS failing_keys FROM customer WHERE c_mktsegment IS NULL OR c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE') HAVING count(*) > 0",
    "dq_regex": "SELECT 'C03' AS rule_id, count(*) AS failed, count(DISTINCT c_custkey) AS failing_keys FROM customer WHERE NOT regexp_matches(coalesce(c_name, ''), '^(?:Customer#0000[0-4])') HAVING count(*) > 0",
    "dq_positive": "SELECT 'C04' AS rule_id, count(*) AS failed, count(DISTINCT c_custkey) AS failing_keys FROM customer WHERE c_acctbal IS NULL OR c_acctbal <= 0 HAVING count(*) > 0",
    "dq_date": "SELECT o_orderstatus, count(*) AS failed FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1996-06-30' GROUP BY 1",
    "dq_unique": "SELECT copies, count(*) AS failing_keys, CAST(sum(copies) AS BIGINT) AS failed FROM (SELECT count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) GROUP BY 1",
    "dq_reference": _B + "SELECT source_system, count(*) AS orphans FROM i WHERE vendor_record_key NOT IN (SELECT record_key FROM v) GROUP BY 1",
    "a01_outliers": _B + "SELECT record_key, vendor_record_key, amount FROM ctx WHERE outlier",
    "a01_events": "SELECT event_id, e.user_id, value, round(m, 6) AS median FROM events e JOIN (SELECT user_id, quantile_cont(value, 0.5) AS m FROM events WHERE value > 0 GROUP BY 1 HAVING count(*) >= 3) t ON t.user_id = e.user_id WHERE value > 5 * m",
    "rule_preview": _B + """, b AS (SELECT split_part(record_key, ':', 1) AS source, count(DISTINCT record_key) AS n FROM i WHERE amount IS NULL OR amount > 1000 GROUP BY 1)
      SELECT count(*) AS evaluated, CAST(sum((amount IS NULL OR amount > 1000)::INT) AS BIGINT) AS failed, round(avg((amount IS NULL OR amount > 1000)::INT), 4) AS fail_rate, round(avg((amount IS NULL OR amount > 1000)::INT), 4) > 0.05 AS blocked,
      (SELECT '{' || string_agg('"' || source || '":' || n, ',' ORDER BY source) || '}' FROM b) AS by_source FROM i""",
    "invoice_valid": _B + "SELECT record_key, vendor_record_key, CAST(invoice_date AS VARCHAR) AS invoice_date, amount, currency FROM f WHERE len(f) = 0",
    "invoice_quarantine": _B + "SELECT record_key, amount, currency, failed_rules FROM f JOIN (SELECT record_key, string_agg(rule_id, ',' ORDER BY rule_id) AS failed_rules FROM flags WHERE entity = 'invoice' GROUP BY 1) USING (record_key)",
    "vendor_dq": _B + "SELECT record_key, source_system, NOT list_contains(f, 'R01') AS pass_R01, NOT list_contains(f, 'R02') AS pass_R02, NOT list_contains(f, 'R03') AS pass_R03, NOT list_contains(f, 'R04') AS pass_R04, len(f) = 0 AS passes_all FROM vf",
    "source_score": _B + _SCORES,
    "source_score_pivot": _B + f"SELECT source_system, max(score) FILTER (WHERE entity = 'vendor') AS vendor_score, max(score) FILTER (WHERE entity = 'invoice') AS invoice_score FROM ({_SCORES}) GROUP BY 1",
    "dq_score": _B + f"SELECT round(1 - avg((record_key IN (SELECT record_key FROM flags))::INT), 4) AS dq_score FROM {_KEYS}",
    "spend_by_country": _B + "SELECT coalesce(country_iso2, '??') AS country, count(*) AS invoices, count(*) FILTER (WHERE len(f) > 0) AS quarantined, round(coalesce(sum(CASE WHEN len(f) = 0 THEN round(amount * usd, 2) END), 0), 2) AS valid_usd FROM f LEFT JOIN v ON v.record_key = vendor_record_key LEFT JOIN rate USING (currency) GROUP BY 1",
    "spend_certified": _S + "SELECT record_key, master_key, CAST(invoice_date AS VARCHAR) AS invoice_date, currency, amount, amount_usd FROM fact",
    "spend_by_month": _S + "SELECT strftime(invoice_date, '%Y-%m') AS month, round(sum(amount_usd), 2) AS spend_usd, count(*) AS invoices FROM fact GROUP BY 1",
    "top10_vendors": _S + "SELECT master_key, spend_usd, vendor_name, country_iso2 FROM (SELECT master_key, round(sum(amount_usd), 2) AS spend_usd FROM fact GROUP BY 1) JOIN gold USING (master_key) ORDER BY spend_usd DESC, master_key LIMIT 10",
    "kpis": _S + "SELECT (SELECT round(sum(amount_usd), 2) FROM fact) AS total_spend_usd, (SELECT count(DISTINCT master_key) FROM fact) AS vendors_with_spend, count(*) AS golden_vendors, count(*) FILTER (WHERE contains(source_systems, ',')) AS multi_source_vendors FROM gold",
    "block_pairs": _P + "SELECT left_key, right_key FROM pairs",
    "pair_scores": _P + "SELECT * FROM scored",
    "band_counts": _P + "SELECT band, count(*) AS pairs FROM scored GROUP BY 1",
    "match_signatures": _P + "SELECT signature, count(*) AS pairs, round(avg(score), 6) AS mean_score FROM scored GROUP BY 1",
    "guarded_bands": _P + """, s AS (SELECT *, CASE WHEN length(left_key) % 2 = 0 THEN 'same' WHEN score < 0.6 THEN 'different' END AS d, city_eq AS sure FROM scored)
      SELECT left_key, right_key, band, CASE WHEN d IS NULL THEN band WHEN d = 'same' AND sure AND NOT tax_conflict THEN CASE WHEN score >= 0.8 THEN 'HIGH' ELSE 'MEDIUM' END WHEN d = 'different' AND sure AND score < 0.7 THEN 'LOW'
      WHEN tax_conflict THEN 'LOW' WHEN score >= 0.7 OR d = 'same' THEN 'MEDIUM' ELSE band END AS guarded FROM s""",
    "review_queue": _P + """SELECT band, CASE WHEN band = 'MEDIUM' AND signature = 'tax:missing|name>=0.9|city:y|phone:y|domain:n' THEN TRUE ELSE band = 'HIGH' END AS merge,
      CASE WHEN band = 'MEDIUM' AND signature = 'tax:missing|name>=0.9|city:y|phone:y|domain:n' THEN 'MATCH:1' ELSE 'rules' END AS decided_by, count(*) AS pairs FROM scored GROUP BY ALL""",
    "name_similarity": f"""WITH n AS (SELECT n_nationkey AS k, array_to_string(list_sort(list_filter(string_split(n_name, ' '), lambda w: w <> '')), ' ') AS s, substr(n_name, 1, 1) AS c FROM nation),
      q AS (SELECT a.k AS a_key, b.k AS b_key, a.s AS x, b.s AS y FROM n a JOIN n b ON a.c = b.c) SELECT a_key, b_key, round({_SIM}, 6) AS similarity FROM q""",
    "cluster_labels": _G + "SELECT record_key, cluster FROM cl",
    "golden_vendors": _S + "SELECT * FROM gold",
    "golden_xref": _G + "SELECT * FROM xref",
    "cluster_alerts": _ALERTS + "SELECT master_key, issues, members, member_count FROM alerts WHERE issues <> ''",
    "match_metrics": _with(_BASE, _PAIRS, _GOLD, _TRUTH) + """, a AS (SELECT sum(n * (n - 1) / 2) AS c FROM bo), p AS (SELECT sum(n * (n - 1) / 2) AS c, count(*) AS g FROM (SELECT sum(n) AS n FROM bo GROUP BY master_key)),
      t AS (SELECT sum(n * (n - 1) / 2) AS c, count(*) AS g FROM (SELECT sum(n) AS n FROM bo GROUP BY true_vendor)) SELECT round(a.c / p.c, 4) AS match_precision, round(a.c / t.c, 4) AS match_recall, p.g AS golden_vendors, t.g AS true_vendors FROM a, p, t""",
    "resolution": _with(_BASE, _PAIRS, _GOLD, _TRUTH) + "SELECT (SELECT count(*) FROM exact) AS vendors_exact, (SELECT count(*) FROM exact WHERE records > 1) AS multi_record_vendors_resolved, count(*) AS true_vendors, count(*) FILTER (WHERE n > 1) AS multi_record_vendors FROM (SELECT true_vendor, sum(n) AS n FROM bo GROUP BY 1)",
    "spend_on_exact": _with(_BASE, _PAIRS, _GOLD, _GOLDEN, _TRUTH) + """SELECT round(sum(CASE WHEN true_vendor IN (SELECT true_vendor FROM exact) THEN amount_usd ELSE 0 END) / sum(amount_usd), 4) AS spend_share_exact
      FROM fact JOIN (SELECT DISTINCT record_key, vendor_record_key FROM i) k USING (record_key) JOIN tr ON tr.record_key = k.vendor_record_key""",
    "catch_rate": _with(_BASE, _DEFECTS) + "SELECT defect_type, count(*) AS seeded, CAST(sum((fl.rule_id IS NOT NULL)::INT) AS BIGINT) AS caught, round(avg((fl.rule_id IS NOT NULL)::INT), 4) AS catch_rate FROM defects d LEFT JOIN flags fl ON fl.record_key = d.record_key AND fl.rule_id = d.expected_rule GROUP BY 1",
    "false_quarantine": _with(_BASE, _DEFECTS) + """, c AS (SELECT DISTINCT record_key FROM i WHERE record_key NOT IN (SELECT record_key FROM defects WHERE entity = 'invoice'))
      SELECT count(*) AS clean, count(*) FILTER (WHERE record_key IN (SELECT record_key FROM flags)) AS flagged, round(avg((record_key IN (SELECT record_key FROM flags))::INT), 4) AS false_quarantine_rate FROM c""",
    "profile_shapes": _PROFILE,
    "token_vocab": "WITH " + _VOCAB.replace("{c}", "p_name").replace("{t}", "part") + " SELECT * FROM vo WHERE kind IS NOT NULL",
    "learned_tokens": _with(_BASE, _VOCAB.replace("{c}", "vendor_name").replace("{t}", "vr")) + f""", q AS (SELECT a.token AS x, b.token AS y, a.names FROM vo a JOIN vo b ON a.kind = 'rare' AND b.kind = 'core' AND substr(a.token, 1, 1) = substr(b.token, 1, 1) AND abs(length(a.token) - length(b.token)) <= 2),
      s AS (SELECT x, y, names, round({_SIM}, 4) AS s FROM q) SELECT x AS raw, y AS canonical, s AS similarity, names AS affected FROM s WHERE s >= 0.85 QUALIFY row_number() OVER (PARTITION BY x ORDER BY s DESC, y) = 1""",
    "learned_mappings": _LEARNED + " SELECT * FROM lm",
    "learned_abbreviations": _LEARNED.replace(f"vr AS MATERIALIZED ({VENDORS_SQL})", f"vr AS MATERIALIZED (SELECT * REPLACE ({SPELLED_SQL} AS vendor_name) FROM ({VENDORS_SQL}) z)") + " SELECT * FROM lm WHERE domain = 'token'",
    "mapping_patterns": _LEARNED + """, b AS (SELECT *, canonical IS NULL AND affected >= 5 AS asks, CASE WHEN canonical IS NULL AND affected >= 5 THEN domain || ':' || raw WHEN canonical IS NULL THEN 'TAIL'
      ELSE 'BATCH:' || domain || ':' || source || ':' || CASE WHEN confidence >= 0.75 THEN 'confident' ELSE 'uncertain' END END AS signature FROM lm WHERE NOT approved AND (canonical IS NOT NULL OR domain <> 'currency'))
      SELECT 'P-' || substr(sha1(CASE WHEN asks THEN 'MAP:' || signature ELSE signature || ':' || string_agg(DISTINCT raw, ',' ORDER BY raw) END), 1, 10) AS pattern_id, CASE WHEN asks THEN 'value_mapping' ELSE 'mapping_batch' END AS kind, signature,
      count(*) AS items, CAST(sum(affected) AS BIGINT) AS affected_records, round(avg(CASE WHEN asks THEN 0.0 WHEN signature = 'TAIL' THEN 1.0 ELSE confidence END), 3) AS confidence, asks AS needs_input FROM b GROUP BY signature, asks""",
    "unmapped_cities": _B + f"SELECT city_raw AS value, count(*) AS affected FROM vr WHERE upper(city_raw) NOT IN ({', '.join(repr(c.upper()) for c in config.CITIES)}) GROUP BY 1",
    "dq_patterns": _with(_BASE, _PATTERNS) + "SELECT * FROM dqp",
    "match_patterns": _with(_BASE, _PAIRS, _MATCH_PATTERNS) + "SELECT * FROM mp",
    "pattern_coverage": _with(_BASE, _PAIRS, _PATTERNS, _MATCH_PATTERNS) + """, u AS (SELECT pattern_id, affected_records FROM dqp UNION ALL SELECT pattern_id, affected_records FROM mp)
      SELECT count(*) AS open_patterns, CAST(sum(affected_records) AS BIGINT) AS issues_in_patterns, round((SELECT sum(affected_records) FROM (SELECT affected_records FROM u ORDER BY affected_records DESC, pattern_id LIMIT 10)) / sum(affected_records), 4) AS top_coverage FROM u""",
    "library_active": "SELECT 'ITEM:' || user_id AS item_id, event_id AS library_version, event_type AS note FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'purchase'",
    "run_delta_alerts": """WITH d AS (SELECT date_trunc('day', ts) AS run_at, event_type AS object, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2), w AS (SELECT *, lag(value) OVER (PARTITION BY object ORDER BY run_at) AS p FROM d)
      SELECT CAST(run_at AS TIMESTAMP) AS run_at, object, 'AL02' AS alert_id, 'medium' AS severity, 'n' AS metric, round(value - p, 6) AS value FROM w WHERE value - p > 5 UNION ALL SELECT CAST(run_at AS TIMESTAMP), object, 'AL01', 'high', 'n', round(value - p, 6) FROM w WHERE p - value > 5
      UNION ALL SELECT CAST(run_at AS TIMESTAMP), object, 'AL03', 'high', 'n', round(value, 6) FROM w WHERE value < 3""",
    "run_metrics": _ALERTS + f""", card AS ({_CARD}) SELECT (SELECT count(*) FROM {_KEYS}) AS records, (SELECT round(1 - avg((record_key IN (SELECT record_key FROM flags))::INT), 4) FROM {_KEYS}) AS pass_rate, (SELECT count(*) FROM flags WHERE rule_id = 'A01') AS anomalies,
      (SELECT rule_id FROM card ORDER BY pass_rate, rule_id LIMIT 1) AS worst_rule, (SELECT min(pass_rate) FROM card) AS worst_rule_pass_rate, (SELECT count(*) FROM alerts WHERE issues <> '') AS suspect_golden_records,
      (SELECT round(count(*) FILTER (WHERE record_key IN (SELECT record_key FROM flags)) / count(*), 4) FROM i) AS quarantine_rate""",
}




def _train_matcher() -> str:
    """Coordinate descent, one Newton step of one weight a round, on the same loss."""
    x = ["name_similarity", *(f"CAST({f} AS DOUBLE)" for f in ("tax_eq", "tax_conflict", "city_eq", "phone_eq", "domain_eq")), "1.0"]
    z = "list_sum(list_transform(range(1, 8), lambda i: w[i] * x[i]))"
    return _with(_BASE, _PAIRS) + f""", truth AS (SELECT record_key, true_vendor FROM vr),
told AS (SELECT s.*, (l.true_vendor = r.true_vendor)::INT AS label FROM scored s JOIN truth l ON l.record_key = left_key JOIN truth r ON r.record_key = right_key WHERE band = 'MEDIUM'),
auto AS (SELECT * FROM (SELECT *, CASE WHEN tax_eq AND name_similarity >= 0.9 THEN 1 WHEN tax_conflict AND name_similarity < 0.5 THEN 0 END AS label FROM scored WHERE band <> 'MEDIUM') WHERE label IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(left_key || '|' || right_key), left_key, right_key) <= {config.AUTO_LABELS_PER_CLASS}),
labelled AS (SELECT * FROM told UNION ALL SELECT * FROM auto),
rows AS MATERIALIZED (SELECT x, label, held, count(*)::DOUBLE AS n FROM (SELECT [{", ".join(x)}] AS x, label, left(md5(left_key || '|' || right_key), 1) IN ('0', '4', '8', 'c') AS held FROM labelled) GROUP BY ALL),
fit AS (SELECT 0 AS it, [0.0::DOUBLE, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0] AS w UNION ALL
  SELECT it + 1, list_transform(range(1, 8), lambda i: CASE WHEN i = it % 7 + 1 THEN w[i] - (g + CASE WHEN i < 7 THEN w[i] ELSE 0 END) / greatest(h + CASE WHEN i < 7 THEN 1 ELSE 0 END, 1e-9) ELSE w[i] END)
  FROM (SELECT it, w, sum(n * (p - label) * x[it % 7 + 1]) AS g, sum(n * p * (1 - p) * x[it % 7 + 1] * x[it % 7 + 1]) AS h FROM (SELECT it, w, x, n, label, 1 / (1 + exp(-{z})) AS p FROM fit, rows WHERE NOT held AND it < 2100) GROUP BY it, w)),
said AS (SELECT label, n, {z} > 0 AS yes FROM rows, (SELECT w FROM fit ORDER BY it DESC LIMIT 1) WHERE held),
got AS (SELECT coalesce(sum(n) FILTER (label = 1 AND yes), 0) AS tp, coalesce(sum(n) FILTER (label = 0 AND yes), 0) AS fp, coalesce(sum(n) FILTER (label = 1 AND NOT yes), 0) AS fn FROM said),
enough AS (SELECT (SELECT count(*) FROM told) >= {config.MIN_STEWARD_LABELS} AND (SELECT count(DISTINCT label) FROM labelled) = 2 AS trained)
SELECT trained, CASE WHEN trained THEN CASE WHEN tp + fp = 0 THEN 1.0 ELSE round(tp / (tp + fp), 4) END END AS precision, CASE WHEN trained THEN CASE WHEN tp + fn = 0 THEN 1.0 ELSE round(tp / (tp + fn), 4) END END AS recall FROM got, enough"""


def _isolation_forest() -> str:
    """Trees level by level, then all rows down all trees."""
    levels = (TREE_ROWS - 1).bit_length()
    draw = lambda a: f"CAST('0x' || substr(md5(tree || ':' || node), {a}, 8) AS BIGINT)"
    expected = lambda n: f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649) - 2 * ({n} - 1) / {n} WHEN {n} = 2 THEN 1.0 ELSE 0.0 END"
    parts = [f"""med AS (SELECT vendor_record_key, quantile_cont(amount, 0.5) AS median FROM i WHERE amount > 0 AND vendor_record_key IS NOT NULL GROUP BY 1),
every AS MATERIALIZED (SELECT row_number() OVER () AS r, record_key, ln(1 + amount) AS a, coalesce(amount / median, 1.0) AS b FROM i LEFT JOIN med USING (vendor_record_key) WHERE amount > 0),
pool AS (SELECT a, b, row_number() OVER (ORDER BY md5(record_key), record_key, a, b) - 1 AS p FROM every QUALIFY p < {TREES * TREE_ROWS}),
size AS MATERIALIZED (SELECT count(*) AS n, least({TREE_ROWS}, n) AS size, greatest(1, ceil(log2(greatest(2, size)))) AS lim FROM pool),
l0 AS MATERIALIZED (SELECT tree, 1 AS node, a, b FROM pool, size, (SELECT unnest(range({TREES})) AS tree) WHERE ((p - tree * {TREE_ROWS}) % n + n) % n < size),
p0 AS MATERIALIZED (SELECT r, tree, 1 AS node, a, b, 0 AS depth, FALSE AS ended FROM every, (SELECT unnest(range({TREES})) AS tree))"""]
    for d in range(levels):
        parts.append(f"""s{d} AS MATERIALIZED (SELECT tree, node, f, CASE WHEN f = 0 THEN a0 + {draw(1)} / 4294967296 * (a1 - a0) ELSE b0 + {draw(1)} / 4294967296 * (b1 - b0) END AS cut FROM (
  SELECT *, CASE WHEN a0 = a1 THEN 1 WHEN b0 = b1 THEN 0 ELSE {draw(9)} % 2 END AS f FROM (SELECT tree, node, min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM l{d} GROUP BY tree, node) WHERE a0 < a1 OR b0 < b1), size WHERE {d} < lim),
l{d + 1} AS MATERIALIZED (SELECT tree, 2 * node + (CASE WHEN f = 0 THEN a ELSE b END >= cut)::INT AS node, a, b FROM l{d} JOIN s{d} USING (tree, node)),
p{d + 1} AS MATERIALIZED (SELECT r, p.tree, CASE WHEN cut IS NULL THEN p.node ELSE 2 * p.node + (CASE WHEN f = 0 THEN a ELSE b END >= cut)::INT END AS node, a, b, depth + (cut IS NOT NULL)::INT AS depth, cut IS NULL AS ended FROM p{d} p LEFT JOIN s{d} s ON NOT ended AND s.tree = p.tree AND s.node = p.node)""")
    leaves = " UNION ALL ".join(f"SELECT tree, node, count(*) AS n FROM l{d} GROUP BY tree, node" for d in range(levels + 1))
    return _B + ", " + ",\n".join(parts) + f""", leaves AS ({leaves}),
depths AS (SELECT r, avg(depth + {expected("coalesce(n, 0)")}) AS depth FROM p{levels} LEFT JOIN leaves USING (tree, node) GROUP BY r),
scores AS MATERIALIZED (SELECT record_key, round(pow(2, -depth / greatest(1e-9, {expected("size")})), 6) AS outlier_score FROM every JOIN depths USING (r), size)
SELECT record_key, outlier_score, outlier_score > (SELECT quantile_cont(outlier_score, 0.98) FROM scores) AS is_outlier FROM scores"""


#: Each component's edges one after the other; the state is the cluster (its first node's number) of every node.
_CANNOT = _with(
    _BASE,
    _PAIRS,
    """ed AS MATERIALIZED (SELECT left_key, right_key, score, left(md5(left_key), 1) IN ('0', '1') AS bar FROM scored WHERE band <> 'LOW'),
sym AS (SELECT left_key AS a, right_key AS b FROM ed UNION ALL SELECT right_key, left_key FROM ed),
reach(a, b) AS (SELECT record_key, record_key FROM v UNION SELECT reach.a, sym.b FROM reach JOIN sym ON sym.a = reach.b),
of AS MATERIALIZED (SELECT a AS record_key, min(b) AS comp, row_number() OVER (PARTITION BY min(b) ORDER BY a) AS pos FROM reach GROUP BY a),
en AS MATERIALIZED (SELECT l.comp AS comp, l.pos AS a, r.pos AS b, bar, row_number() OVER (PARTITION BY l.comp ORDER BY score DESC, left_key, right_key) AS i FROM ed JOIN of l ON l.record_key = left_key JOIN of r ON r.record_key = right_key),
bars AS (SELECT comp, list({'x': a, 'y': b}) AS bars FROM en WHERE bar GROUP BY comp),
start AS MATERIALIZED (SELECT comp, list(record_key ORDER BY pos) AS names, coalesce(any_value(bars), []) AS bars, max(pos) AS n FROM of LEFT JOIN bars USING (comp) GROUP BY comp),
steps AS (SELECT comp, 0 AS i, bars, range(1, n + 1) AS part FROM start
  UNION ALL SELECT comp, en.i, bars, CASE WHEN part[a] = part[b] OR len(list_filter(bars, lambda z: least(part[z.x], part[z.y]) = least(part[a], part[b]) AND greatest(part[z.x], part[z.y]) = greatest(part[a], part[b]))) > 0 THEN part
    ELSE list_transform(part, lambda l: CASE WHEN l = greatest(part[a], part[b]) THEN least(part[a], part[b]) ELSE l END) END FROM steps JOIN en USING (comp) WHERE en.i = steps.i + 1),
ends AS (SELECT comp, arg_max(part, i) AS part FROM steps GROUP BY comp)""",
)
ORACLE["cannot_link_clusters"] = _CANNOT + "SELECT record_key, names[part[pos]] AS cluster FROM of JOIN ends USING (comp) JOIN start USING (comp)"
ORACLE["std_many_mappings"] = _B.replace(f"vr AS MATERIALIZED ({VENDORS_SQL})", f"vr AS MATERIALIZED (SELECT * REPLACE (vendor_name || ' W' || source_vendor_id AS vendor_name) FROM ({VENDORS_SQL}) z)") + f""", ws AS (SELECT record_key, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos FROM v1),
  ns AS (SELECT record_key, string_agg(coalesce('GROUP' || (p_partkey % 100), {_case("w", NAME_ABBREVIATIONS, "w")}), ' ' ORDER BY pos) AS vendor_name_norm FROM ws LEFT JOIN part ON w = 'W' || p_partkey GROUP BY 1) SELECT record_key, ns.vendor_name_norm AS vendor_name_norm, city FROM ns JOIN v USING (record_key)"""
ORACLE["train_matcher"], ORACLE["isolation_forest"] = _train_matcher(), _isolation_forest()
#: A stream's result is that of the whole history.
ORACLE["stream_alerts"] = ORACLE["run_delta_alerts"]


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
