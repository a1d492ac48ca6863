"""DuckDB's SQL for those of the operators' queries that SQL can express."""

from __future__ import annotations

from . import mixing, url_filter

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HARD = "<|im_end|><|im_start|>assistant ok"

OP2 = rf"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_HARD}' UNION ALL SELECT -1, 1, 'assistant', '{_HARD}'),
w AS (SELECT *, (contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|')) AS hard FROM t),
e AS (SELECT *, CASE WHEN hard THEN regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') ELSE text END AS written FROM w),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS said,
  sum(length(role) + length(written) + 24) AS chars, count(*) FILTER (hard) AS escaped FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(said) AS BIGINT) AS loss_chars, sha256(said) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars, CAST(escaped AS BIGINT) AS escaped_turns FROM g"""


def _weight(level: str, plan: mixing.MixPlan) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {float(w)!r}" for name, w in plan.weights.get(level, {}).items())
    return f"CAST(CASE {level} {cases} ELSE {float(plan.other)!r} END AS DOUBLE)" if cases else f"CAST({float(plan.other)!r} AS DOUBLE)"


def _share(name: str, rows: str, parents: str, child: str) -> str:
    """CTEs that share the column given among children, as mixing.share_out does."""
    by = f"PARTITION BY {parents} " if parents else ""
    return f"""{name}_a AS (SELECT *, CASE WHEN weight > 0 THEN capacity / weight ELSE 0 END AS ratio FROM ({rows})),
{name}_b AS (SELECT *, coalesce(sum(CASE WHEN weight > 0 THEN capacity ELSE 0 END) OVER ({by}ORDER BY ratio, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
  sum(weight) OVER ({by}ORDER BY ratio, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS still FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN still > 0 THEN greatest(0, given - filled) / still END AS rate FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN rate < ratio THEN rate END AS served FROM {name}_c),
{name}_e AS (SELECT *, first_value(served IGNORE NULLS) OVER ({by}ORDER BY ratio, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fixed FROM {name}_d),
{name} AS (SELECT * EXCLUDE (given), CASE WHEN weight <= 0 THEN 0 WHEN fixed IS NULL THEN capacity ELSE least(capacity, fixed * weight) END AS budget FROM {name}_e)"""


def mixing_sql(plan: mixing.MixPlan) -> str:
    roots = f"SELECT domain, sum(capacity) AS capacity, {_weight('domain', plan)} AS weight, (SELECT sum(available) FROM leaves) * CAST({plan.budget_share!r} AS DOUBLE) AS given FROM leaves GROUP BY domain"
    langs = f"SELECT l.domain, lang, sum(l.capacity) AS capacity, {_weight('lang', plan)} AS weight, any_value(r.budget) AS given FROM leaves l JOIN roots r USING (domain) GROUP BY l.domain, lang"
    sources = f"SELECT l.domain, l.lang, source, available, l.capacity, {_weight('source', plan)} AS weight, g.budget AS given FROM leaves l JOIN langs g ON g.domain = l.domain AND g.lang = l.lang"
    return f"""WITH d AS (SELECT doc_id, lang, source, CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens, coalesce(lang, '') AS l, coalesce(source, '') AS s,
  CASE WHEN coalesce(source, '') = 'src0' THEN 'hub' WHEN regexp_matches(coalesce(source, ''), '[02468]$') THEN 'even' WHEN regexp_matches(coalesce(source, ''), '[13579]$') THEN 'odd' ELSE 'other' END AS domain FROM documents),
leaves AS (SELECT domain, l AS lang, s AS source, CAST(sum(tokens) AS BIGINT) AS available, CAST(sum(tokens) AS DOUBLE) * {plan.max_epochs} AS capacity FROM d GROUP BY ALL),
{_share('roots', roots, '', 'domain')},
{_share('langs', langs, 'domain', 'lang')},
{_share('sources', sources, 'domain, lang', 'source')},
b AS (SELECT domain, lang, source, available, CAST(floor(round(budget, 3)) AS BIGINT) AS budget FROM sources),
runs AS (SELECT *, unnest(range(0, (budget - 1) // available + 1)) AS epoch FROM b WHERE budget > 0),
p AS (SELECT d.*, r.epoch, least(r.available, r.budget - r.epoch * r.available) AS wanted, md5(concat_ws(':', '{plan.seed}', r.epoch, coalesce(CAST(doc_id AS VARCHAR), ''))) AS place
  FROM d JOIN runs r ON r.domain = d.domain AND r.lang = d.l AND r.source = d.s),
c AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, l, s, epoch ORDER BY place, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM p)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, tokens, CAST(least(tokens, wanted - sofar) AS BIGINT) AS taken FROM c WHERE sofar < wanted"""


OP3 = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\\t\\x0B\\f\\r ]'), lambda x: x <> ''))) AS ws FROM l),
s AS (SELECT ws, len(ws) AS n, min({'d': doc_id, 'i': line_no}) AS place, row_number() OVER () AS k FROM w WHERE len(ws) > 0 GROUP BY ws),
u AS (SELECT k, n, unnest(ws) AS word FROM s),
f AS (SELECT word, count(*) AS df FROM u GROUP BY word),
r AS (SELECT k, n, word, row_number() OVER (PARTITION BY k ORDER BY df, word) AS pos FROM u JOIN f USING (word)),
p AS (SELECT k, n, word FROM r WHERE pos <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.k AS a, b.k AS b FROM p a JOIN p b ON a.word = b.word AND a.k <> b.k AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
o AS (SELECT a, b, x.n + y.n AS sizes, len(list_intersect(x.ws, y.ws)) AS shared FROM c JOIN s x ON x.k = a JOIN s y ON y.k = b),
m AS (SELECT a AS k, y.place, shared / (sizes - shared) AS similarity FROM o JOIN s y ON y.k = b WHERE 5 * shared >= 4 * (sizes - shared) UNION ALL SELECT k, place, 1.0 FROM s),
e AS (SELECT k, min({'place': place, 'similarity': similarity}) AS x FROM m GROUP BY k)
SELECT DISTINCT doc_id, CAST(line_no AS INTEGER) AS line_no, x.place.d AS kept_doc_id, CAST(x.place.i AS INTEGER) AS kept_line_no, CAST(x.similarity AS DOUBLE) AS similarity
FROM w JOIN s USING (ws) JOIN e USING (k) WHERE x.place < {'d': doc_id, 'i': line_no}"""

_SHINGLES = f"""w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)"""

OP6 = f"""WITH RECURSIVE {_SHINGLES},
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS hits FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * hits >= 80 * (na + nb - hits) UNION SELECT b, a FROM i WHERE 100 * hits >= 80 * (na + nb - hits)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, CAST(c.component_id AS BIGINT) AS component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id"""

OP7 = f"""WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, rh, rp) AS (VALUES {', '.join(str(x) for x in url_filter.RULES)}),
f AS (SELECT page_id, arg_max(struct_pack(rule := rh || rp, verdict := verdict), length(rh || rp) * 1000 + length(rh)) AS best FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN host IN {url_filter.LISTED_HOSTS} THEN 'block' ELSE 'allow' END) AS verdict FROM h LEFT JOIN f USING (page_id)"""

OP8 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, CAST(component_id AS BIGINT) AS component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id"""


def _least_edits() -> str:
    """The recursive part of OP11: each signature's row after row, with the least (cost, edits) for each place in the grammar s0 to s3."""
    add = lambda x, cost, edits: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{edits}'}}"
    some = lambda x, cost, edits: f"CASE WHEN {x} IS NOT NULL THEN {add(x, cost, edits)} END"
    least = lambda *offers: f"list_min([{', '.join(offers)}])"
    user = least("s2", *(some(x, 2, "I") for x in ("s0", "s1", "s3")), some("s2", 4, "II"))
    assistant = least("s3", some("s2", 2, "I"), *(some(x, 4, "II") for x in ("s0", "s1", "s3")))

    def to(kept: str, sources: tuple[str, ...], target: str) -> str:
        keep = [f"CASE WHEN {x} IS NOT NULL AND low = '{kept}' THEN {add(x, 'late', 'K')} END" for x in sources]
        rerole = [f"CASE WHEN {x} IS NOT NULL AND low <> 'x' THEN {add(x, '2 + late', 'R')} END" for x in sources if kept != "s"]
        return least(some(target, 3, "D"), *keep, *rerole)

    inserted = f"""SELECT sig, i, s0 AS e0, s1 AS e1, {user} AS e2, {assistant} AS e3, lower(sig[i + 1]) AS low,
    CASE WHEN sig[i + 1] <> lower(sig[i + 1]) THEN 1 ELSE 0 END AS late FROM r WHERE i < length(sig)"""
    return f"""SELECT sig, i + 1, {some('e0', 3, 'D')}, {to('s', ('e0',), 'e1')}, {to('u', ('e0', 'e1', 'e3'), 'e2')}, {to('a', ('e2',), 'e3')} FROM ({inserted})"""


_STATE = "STRUCT(c INTEGER, a VARCHAR)"
OP11 = rf"""WITH RECURSIVE k AS (SELECT list(v ORDER BY n) AS t FROM
  (SELECT n, list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS v FROM range(256) x(n))),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 20 AS how FROM conversations, k),
g AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
  CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) FROM h WHERE how <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM g),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS shown FROM p),
f AS (SELECT *, CASE WHEN shown = '' THEN 3 WHEN seen > 1 THEN 2 WHEN shown[-1] NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault FROM q),
s AS (SELECT conv_id, string_agg(CASE WHEN fault >= 2 THEN 'x' WHEN fault = 1 THEN upper(l) ELSE l END, '' ORDER BY i) AS sig, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
  count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS l FROM f) GROUP BY conv_id),
r AS (SELECT DISTINCT sig, 0 AS i, CAST({{'c': 0, 'a': ''}} AS {_STATE}) AS s0, CAST(NULL AS {_STATE}) AS s1, CAST(NULL AS {_STATE}) AS s2, CAST(NULL AS {_STATE}) AS s3 FROM s
  UNION ALL {_least_edits()}),
b AS (SELECT sig, list_min([s0, s3, CASE WHEN s1 IS NOT NULL THEN {{'c': s1.c + 4, 'a': s1.a || 'II'}} END, CASE WHEN s2 IS NOT NULL THEN {{'c': s2.c + 2, 'a': s2.a || 'I'}} END]) AS best FROM r WHERE i = length(sig)),
c AS (SELECT s.*, best.c AS cost, best.a AS audit FROM s JOIN b USING (sig)),
e AS (SELECT conv_id, sig, audit, unnest(range(1, length(audit) + 1)) AS j FROM c WHERE audit <> ''),
n AS (SELECT conv_id, j, audit[j] AS edit, length(replace(audit[:j], 'I', '')) AS i, length(replace(audit[:j], 'D', '')) - CASE WHEN regexp_matches(audit, '^D*K') AND lower(sig[length(regexp_extract(audit, '^D*')) + 1]) = 's' THEN 1 ELSE 0 END AS o, FROM e WHERE audit[j] <> 'D'),
t AS (SELECT n.conv_id, sha256(string_agg(CASE edit WHEN 'K' THEN f.role ELSE CASE WHEN o % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE f.text END, chr(10) ORDER BY j)) AS digest
  FROM n LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.i = n.i GROUP BY n.conv_id)
SELECT d.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM d.conv_id"""


def _in_either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_in_either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: Kind, what stands before the measured part, the measured part, its least length.
_SECRETS = [
    ("assign", f"""({_KEYS})["'']?\\x20*[:=]\\x20*["'']?""", "[A-Za-z0-9+/_.=-]+", 8), ("access", "", "AKIA[A-Z0-9]+", 16), ("hex", "", "[0-9a-f]+", 32),
    ("github", "gh[pousr]_", "[A-Za-z0-9]+", 36), ("slack", "xox[abprs]-", "[A-Za-z0-9-]+", 10), ("google", "AIza", "[A-Za-z0-9_-]+", 35),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]+", 10),
]


def _found(k: int, kind: str, before: str, part: str, least: int) -> str:
    return f"""SELECT id, {k} AS k, '{kind}' AS kind, m, gap, i FROM (SELECT id, unnest(ms) AS m, unnest(gs[:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i
  FROM (SELECT id, regexp_extract_all(text, '{before}{part}') AS ms, string_split_regex(text, '{before}{part}') AS gs FROM t))"""


_MEASURED = " ".join(f"WHEN {k} THEN length(m) - length(regexp_extract(m, '^{before}')) >= {least}" for k, (_, before, _, least) in enumerate(_SECRETS))
OP12 = f"""WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({' UNION ALL '.join(_found(k, *rule) for k, rule in enumerate(_SECRETS))}),
p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY id, k ORDER BY i) AS stop FROM f),
s AS (SELECT id, k, kind, CAST(stop - length(m) AS BIGINT) AS start, kind || ':' || CAST(stop - length(m) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM p WHERE CASE k {_MEASURED} END),
g AS (SELECT id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM s GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (id)"""


_GRAMS = " UNION ALL ".join(f"""SELECT lang, {m} AS m, unnest(list_transform(range(1, len(ws) - {m} + 2), lambda i: array_to_string(ws[i:i + {m - 1}], ' '))) AS phrase FROM w""" for m in range(1, 6))
OP13 = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS a FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT c.lang, c.phrase, c.m, c.a, c.k, x.a AS l, y.a AS r, n.n, (CAST(1000 AS HUGEINT) * c.a * n.n) // (CAST(x.a AS HUGEINT) * y.a) AS score FROM c JOIN n USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
v AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.m > b.m AND 100 * f.a >= 100 * b.a AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM v QUALIFY rank <= 2000"""

ORACLE_SQL = {
    "op13_collocations": OP13,
    "op12_secret_scan": OP12,
    "op11_conversation_repair": OP11,
    "op2_chat_format": OP2, "op3_line_dedup": OP3, "op4_mixing": mixing_sql(mixing.PLAN), "op6_ngram_join": OP6, "op7_url_filter": OP7, "op8_embedding_dedup": OP8,
}
