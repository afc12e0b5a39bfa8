"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tesserae.llm import quality, url_filter

_Q = lambda s: "'" + s.replace("'", "''") + "'"

OP7 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
iw AS MATERIALIZED (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS MATERIALIZED (SELECT r, i, n, item FROM dw JOIN iw USING (n, s)),
h AS (SELECT r, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
t AS (SELECT r, count(*)::BIGINT AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


def _crc_rule() -> str:
    """SQL for the 256 entries of the CRC-32 table, from its rule."""
    half = lambda x: f"CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
    steps = "range(256)"
    for _ in range(8):
        steps = f"list_transform({steps}, lambda v: {half('v')})"
    return f"SELECT {steps} AS rule"


_CRC_RULE = _crc_rule()


def _op3(shards: int = 8, buckets: int = 1024) -> str:
    number = lambda text: f"('0x' || substr(md5({text}), 1, 13))::BIGINT"
    key = "coalesce(doc_id::VARCHAR, '')"
    costs = ", ".join(f"-ln(({number(f"concat('0:{i}:', {key})")}::DOUBLE + 0.5) / {1 << 52}.0)" for i in range(shards + 1))
    half = lambda x: f"CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
    steps = "x"
    for _ in range(8):
        steps = f"list_transform({steps}, lambda v: {half('v')})" if steps != "x" else f"list_transform(range(256), lambda v: {half('v')})"
    digits = "hex(encode(coalesce(text, '')))"
    byte = lambda at: f"(strpos('0123456789ABCDEF', substr(h, {at}, 1)) - 1)"
    return f"""
WITH x AS MATERIALIZED (SELECT {steps} AS rule),
t AS MATERIALIZED (SELECT text, list_transform(range(1, len(h) // 2 + 1), lambda i: {byte("2 * i - 1")} * 16 + {byte("2 * i")}) AS bytes FROM (SELECT DISTINCT text, {digits} AS h FROM documents WHERE text <> '')),
s AS (SELECT text, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, rule[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS crc FROM t, x),
d AS (SELECT doc_id, (strlen(coalesce(d.text, '')) + 1)::BIGINT AS size, coalesce(crc, 0) AS text_crc32, [{costs}] AS costs FROM documents d LEFT JOIN s ON d.text = s.text),
p AS (SELECT doc_id, size, text_crc32, list_position(costs[1:{shards}], list_min(costs[1:{shards}])) - 1 AS shard, list_position(costs, list_min(costs)) - 1 AS grown_shard,
 {number(f"concat('slot:', {key}, ':', size, ':', text_crc32)")} % {buckets} AS bucket FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, grown_shard::INT AS grown_shard FROM p
"""


def _op8() -> str:
    space = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    gone = lambda x, chars: f"length(translate({x}, {chars}, ''))"
    n = lambda x, chars: f"(length({x}) - {gone(x, chars)})"
    boiler = " OR ".join(f"contains(lower(x), {_Q(p)})" for p in quality.BOILERPLATE)
    words = f"len(regexp_extract_all(x, {_Q(quality.WORD)}))"
    bars = n("x", _Q("|»›•→>"))
    single = f"regexp_matches(lower(x), {_Q(quality.NAVIGATION_LINE)})"
    noisy = f"{n('x', _Q(quality.SYMBOLS))} * 100 > {words} * {quality.SYMBOL_WORD_PERCENT}"
    endless = f"({words} >= {quality.LONG_LINE_WORDS} AND {n('x', _Q(quality.CLOSING))} = 0)"
    menu = f"({bars} * 100 > {words} * {quality.SEPARATOR_PERCENT} AND {bars} >= 2)"
    passes = f"(translate(x, {space}, '') = '' OR NOT ((({boiler}) AND {words} <= {quality.BOILERPLATE_WORDS}) OR {menu} OR {single} OR ({words} >= 10 AND {noisy}) OR {endless}))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, body, list_filter(string_split(translate(body, {space}, '      '), ' '), lambda x: x <> '') AS words, string_split(body, chr(10)) AS lines FROM d),
t AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
tri AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM t),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, {gone('body', space)}::BIGINT AS word_chars, {n('body', _Q(quality.SYMBOLS))}::BIGINT AS n_symbols,
 list_filter(lines, lambda x: translate(x, {space}, '') <> '') AS worded, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
 list_filter(lines, lambda x: {passes}) AS kept_lines, len(lines)::BIGINT AS n_lines
 FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
 word_chars - length(translate(list_aggregate(kept_lines, 'string_agg', chr(10)), {space}, '')) AS lost FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, (len(worded) - len(list_distinct(worded)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
 (n_lines - len(kept_lines))::BIGINT AS n_failed_lines, coalesce(lost, word_chars)::BIGINT AS lost_chars,
 (NOT base_failed AND coalesce(lost, word_chars) * 100 <= word_chars * {quality.MAX_LOST_PERCENT}) AS kept
FROM b
"""


#: Rules of the url query: host, path, verdict.
URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


#: Levels written out in SQL, which has no loop: more than any url of the tables has.
URL_LEVELS = 8


def _op4() -> str:
    u = url_filter
    rest = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    host = f"translate(regexp_extract({rest}, '(?s)^([^/?#]*)([^?#]*)', 1), '{u.UPPER}', '{u.UPPER.lower()}')"
    path = f"regexp_extract({rest}, '(?s)^([^/?#]*)([^?#]*)', 2)"
    end, stem = r"regexp_extract(s, '(\.[A-Za-z]{1,5})$', 1)", r"regexp_replace(s, '\.[A-Za-z]{1,5}$', '')"
    template = f"""list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: concat(CASE
 WHEN regexp_matches({stem}, '^[0-9]+$') THEN '{{n}}' WHEN regexp_matches({stem}, '^[0-9]{{4}}-[0-9]{{1,2}}(-[0-9]{{1,2}})?$') THEN '{{date}}'
 WHEN regexp_matches({stem}, '^[0-9a-fA-F-]{{12,}}$') THEN '{{hex}}' WHEN regexp_matches({stem}, '^[^-_]+([-_][^-_]+){{2,}}$') THEN '{{slug}}'
 WHEN regexp_matches({stem}, '[0-9]') THEN regexp_replace({stem}, '[0-9]+', '{{n}}', 'g') ELSE {stem} END, {end}))"""
    rules = sorted(URL_RULES, key=lambda r: -len(r.name))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{pick(r)}'" for r in rules) + " END"
    z, prior = float(u.MERGE_Z * u.MERGE_Z), float(u.PRIOR_LABELS)
    levels, walk = "", ""
    for d in range(1, URL_LEVELS + 1):
        gap, spread = "(x.b * (y.n - x.n) - (y.b - x.b) * x.n)", "(y.b * (y.n - y.b) * x.n * (y.n - x.n))"
        levels += f"""
k{d} AS MATERIALIZED (SELECT host, node, steps[{d}] AS seg, sum(n)::DOUBLE AS n, sum(b)::DOUBLE AS b FROM r{d - 1} WHERE len(steps) >= {d} GROUP BY ALL),
m{d} AS MATERIALIZED (SELECT x.*, x.seg <> '{u.WILDCARD}' AND x.n >= {u.MIN_LABELS} AND y.n > x.n AND {gap} * {gap} * y.n > {spread} * {z} AS apart
 FROM k{d} x JOIN (SELECT host, node, sum(n) AS n, sum(b) AS b FROM k{d} GROUP BY ALL) y ON x.host = y.host AND x.node = y.node),
r{d} AS MATERIALIZED (SELECT r.host, r.steps, r.n, r.b, concat(r.node, '/', coalesce(o.seg, '{u.WILDCARD}')) AS node
 FROM r{d - 1} r LEFT JOIN m{d} o ON o.apart AND o.host = r.host AND o.node = r.node AND o.seg = r.steps[{d}] WHERE len(r.steps) >= {d}),
n{d} AS MATERIALIZED (SELECT host, concat(node, '/', CASE WHEN apart THEN seg ELSE '{u.WILDCARD}' END) AS node, sum(n) AS n, sum(b) AS b FROM m{d} GROUP BY ALL HAVING sum(n) >= {u.MIN_LABELS}),"""
        walk += f"""
v{d} AS MATERIALIZED (SELECT q.host, q.steps, q.node, CASE WHEN e.n IS NOT NULL THEN q.node ELSE q.branch END AS branch, coalesce((e.b + q.share * {prior}) / (e.n + {prior}), q.share) AS share
 FROM (SELECT w.host, w.steps, w.branch, w.share, CASE WHEN len(w.steps) >= {d} THEN concat(w.node, '/', coalesce(o.seg, '{u.WILDCARD}')) END AS node
  FROM v{d - 1} w LEFT JOIN m{d} o ON o.apart AND o.host = w.host AND o.node = w.node AND o.seg = w.steps[{d}]) q LEFT JOIN n{d} e ON e.host = q.host AND e.node = q.node),"""
    base = "coalesce((SELECT sum(b)::DOUBLE / sum(n) FROM c), 0.0)"
    return f"""
WITH p AS MATERIALIZED (SELECT page_id, url, {host} AS host, {path} AS path FROM pages), t AS MATERIALIZED (SELECT *, {template} AS steps FROM p),
l AS (SELECT host, steps, bad::BIGINT AS bad FROM (SELECT host, steps, regexp_extract(path, '/([0-9]{{1,18}})(\\.[a-z]+)?/?$', 1) AS n FROM t WHERE url IS NOT NULL)
 JOIN (SELECT doc_id::VARCHAR AS n, (toxic = 1 OR quality = 0) AS bad FROM labels) USING (n) WHERE bad IS NOT NULL),
c AS MATERIALIZED (SELECT host, steps, count(*)::BIGINT AS n, sum(bad)::BIGINT AS b FROM l GROUP BY ALL),
r0 AS MATERIALIZED (SELECT *, '' AS node FROM c),{levels}
h AS MATERIALIZED (SELECT host, sum(n)::DOUBLE AS n, sum(b)::DOUBLE AS b FROM c GROUP BY host),
v0 AS MATERIALIZED (SELECT d.host, d.steps, '' AS node, '' AS branch, coalesce((h.b + {base} * {prior}) / (h.n + {prior}), {base}) AS share FROM (SELECT DISTINCT host, steps FROM t) d LEFT JOIN h ON h.host = d.host),{walk}
z AS (SELECT * FROM v{URL_LEVELS})
SELECT page_id, t.host, path, {case(lambda r: r.name)} AS rule, coalesce({case(lambda r: r.verdict)}, CASE WHEN share >= {u.MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict,
 concat('/', array_to_string(t.steps, '/')) AS template, branch, round(share, 6) AS bad_share FROM t JOIN z ON z.host = t.host AND z.steps = t.steps
""".replace("(host = ", "(t.host = ").replace("ends_with(host", "ends_with(t.host")


def links_sql(n: int, percent: int, source: str = "documents") -> str:
    """Common table expressions up to ``comp(id, component)``: components of n-word Jaccard links."""
    space = "concat(chr(9), chr(10), chr(11), chr(12), chr(13))"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
jd AS MATERIALIZED (SELECT doc_id AS id, list_filter(string_split(translate({low}, {space}, '     '), ' '), lambda x: x <> '') AS w FROM {source}),
js AS MATERIALIZED (
  SELECT DISTINCT id, array_to_string(w[i:i + {n - 1}], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS i FROM jd WHERE len(w) > 0)),
jn AS MATERIALIZED (SELECT id, count(*) AS n FROM js GROUP BY id),
jp AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM js a JOIN js b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
jl AS MATERIALIZED (SELECT a, b FROM jp JOIN jn x ON a = x.id JOIN jn y ON b = y.id WHERE 100 * c >= {percent} * (x.n + y.n - c)),
je AS MATERIALIZED (SELECT a, b FROM jl UNION ALL SELECT b, a FROM jl),
jr AS (SELECT id, id AS r FROM jd UNION SELECT je.b, jr.r FROM jr JOIN je ON je.a = jr.id WHERE jr.r < je.b),
comp AS MATERIALIZED (SELECT id, min(r) AS component FROM jr GROUP BY id)"""


OP10 = f"""
WITH RECURSIVE {links_sql(4, 85)}
SELECT jd.id AS doc_id, coalesce(jn.n, 0)::BIGINT AS n_shingles, comp.component AS component_id
FROM jd LEFT JOIN jn ON jn.id = jd.id JOIN comp ON comp.id = jd.id
"""

def _op12() -> str:
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    more = lambda way, cost, edit: f"concat(lpad((substr({way}, 1, 9)::INT + {cost})::VARCHAR, 9, '0'), substr({way}, 10), '{edit}')"
    never = "'999000000'"
    # A way is its cost in nine digits and its audit; a state has those to nothing yet, s, u and a.
    u_in = lambda z, s, u, a: f"least({u}, {more(z, 5, 'I')}, {more(s, 5, 'I')}, {more(a, 5, 'I')})"
    go = "CASE WHEN x[1] IN ('b', 'd') THEN [{z}, {s}, {u}, {a}] ELSE [{z}, least({s}, {ks}), least({u}, {ku}), least({a}, {ka})] END"
    extra = "CASE WHEN x[1] BETWEEN 'A' AND 'Z' THEN 5 ELSE 0 END"
    way = {"z": "w[1]", "s": "w[2]", "u": "w[3]", "a": "w[4]"}
    kept = lambda frm, to: f"CASE WHEN lower(x[1]) = '{to}' THEN {more(frm, extra, 'K')} ELSE {more(frm, f'1 + {extra}', 'R')} END"
    step = go.format(
        **{k: more(v, 2, "D") for k, v in way.items()},
        ks=f"CASE WHEN lower(x[1]) = 's' THEN {more('w[1]', extra, 'K')} ELSE {never} END",
        ku=f"least({kept('w[1]', 'u')}, {kept('w[2]', 'u')}, {kept('w[4]', 'u')})",
        ka=kept("w[3]", "a"),
    )
    opened = lambda x: f"list_transform([{x}], lambda q: [q[1], q[2], {u_in('q[1]', 'q[2]', 'q[3]', 'q[4]')}, q[4]])[1]"
    closed = lambda x: f"list_transform([{opened(x)}], lambda q: [q[1], q[2], q[3], least(q[4], {more('q[3]', 5, 'I')})])[1]"
    begin = closed(f"['000000000', {never}, {never}, {never}]")
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS body, o, crc FROM (
 SELECT *, row_number() OVER () AS o, list_reduce(list_transform(range(1, strlen(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT), lambda a, b: xor(a >> 8, rule[(xor(a, b) & 255) + 1]), 4294967295::BIGINT) AS crc
 FROM (SELECT *, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k FROM conversations), ({_CRC_RULE}))),
k AS (SELECT *, xor(crc, 4294967295) % 20 AS kind FROM c),
r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(body, '.!?', '') ELSE body END AS body, o, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS rep FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body, o, rep) AS i, row_number() OVER (PARTITION BY conv_id, role, body ORDER BY turn NULLS FIRST, o, rep) AS again,
 lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body, o, rep) AS before FROM r),
f AS (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial, regexp_matches(body, '[.!?]{space}*\\z') AS ended FROM n),
g AS (SELECT *, CASE WHEN NOT regexp_matches(body, '{word}') THEN 'b' WHEN again > 1 THEN 'd' WHEN ended THEN initial ELSE upper(initial) END AS letter FROM f),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (letter = 'b')::BIGINT AS blank, count(*) FILTER (letter = 'd')::BIGINT AS duplicate,
 count(*) FILTER (letter BETWEEN 'A' AND 'Z')::BIGINT AS truncated, count(*) FILTER (before IS NOT NULL AND concat(before, left(role, 1)) NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal,
 list([letter] ORDER BY i) AS letters FROM g GROUP BY conv_id),
w AS (SELECT * EXCLUDE (letters), list_reduce(letters, lambda w, x: {closed(step)}, {begin}) AS ways FROM t),
p AS (SELECT * EXCLUDE (ways), substr(least(ways[1], ways[4]), 10) AS audit, substr(least(ways[1], ways[4]), 1, 9)::BIGINT AS cost FROM w),
e AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS j FROM p),
a AS (SELECT conv_id, j, audit[j] AS edit, j - len(translate(audit[1:j], 'DKR', '')) AS i, len(translate(audit[1:j], 'D', '')) AS place FROM e WHERE audit[j] <> 'D'),
l AS (SELECT a.conv_id, a.place, CASE WHEN edit = 'K' THEN g.role ELSE NULL END AS own, CASE WHEN edit = 'I' THEN '' ELSE g.body END AS body, first_value(CASE WHEN edit = 'K' AND g.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY a.conv_id ORDER BY place) AS lead
 FROM a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id AND g.i = a.i AND edit <> 'I'),
h AS (SELECT conv_id, string_agg(concat(coalesce(own, CASE WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END), ':', body), chr(10) ORDER BY place) AS whole FROM l GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM d.conv_id
"""


OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, sha256(concat('42:', coalesce(doc_id::VARCHAR, ''))) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(body, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
 ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(tokens)::BIGINT AS n, h1 % (len(tokens) + 1) AS c1, h2 % (len(tokens) + 1) AS c2,
 CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(tokens[1:least(c1, c2)], '') AS head, array_to_string(tokens[least(c1, c2) + 1:greatest(c1, c2)], '') AS core, array_to_string(tokens[greatest(c1, c2) + 1:], '') AS tail FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(core) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN concat('<P>', head, '<S>', tail, '<M>', core) ELSE concat('<S>', tail, '<P>', head, '<M>', core) END) AS output_sha256,
 sha256(body) AS restored_sha256
FROM p
"""

ORACLES: dict[str, str] = {"op3_rendezvous_shards": _op3(), "op4_url_templates": _op4(), "op7_content_sort": OP7, "op8_line_rules": _op8(), "op10_ngram_jaccard": OP10, "op11_suffix_automaton": OP11, "op12_turn_repair": _op12(), "op13_fill_middle": OP13}
