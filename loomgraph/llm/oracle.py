"""Check SQL of the corpus operators, for DuckDB. Patterns, thresholds and tables of numbers come from the operators."""

from __future__ import annotations

from loomgraph.llm import decontam, pii, quality, resample, secret_scan, sharding, substring, vector_codes

WORD = r"[^\x20\x09-\x0D]+"
TEXTS = "select doc_id, coalesce(text, '') as t from documents"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SHARDING = f"""
with recursive rows as (
  select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint as h from documents),
sums as (select d, h >> ({sharding.KEY_BITS} - d) as p, sum(n_bytes)::bigint as b, count(*) as n from rows, range(0, 31) r(d) group by all),
leaf as (select doc_id, n_bytes, h, min(d) as depth from rows, range(0, 31) r(d) join sums s using (d) where s.p = h >> ({sharding.KEY_BITS} - d) and s.b <= {sharding.LIMIT_BYTES} group by all)
select doc_id, n_bytes, substr(lpad(bin(h), {sharding.KEY_BITS}, '0'), 1, depth::int) as shard, depth::bigint as depth, b as shard_bytes, n::bigint as shard_rows
from leaf join sums on d = depth and p = h >> ({sharding.KEY_BITS} - depth)
"""

_BIT = quality.BIT
QUALITY = f"""
with w as (select doc_id, t, regexp_extract_all(t, '{WORD}') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as ls from ({TEXTS})),
win as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as k from w, unnest(range(1, len(ws) - 1)) u(i)),
twice as (select doc_id, i, count(*) over (partition by doc_id, k) as c from win),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice where c > 1) group by doc_id),
m as (
  select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
    length(regexp_replace(t, '\\P{{Lu}}+', '', 'g'))::bigint as n_capitals
  from w left join rep using (doc_id)),
b as (
  select *, (case when n_words < {quality.MIN_WORDS} then {_BIT['few_words']} else 0 end
    + case when 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words then {_BIT['repeated_words']} else 0 end
    + case when 100 * n_symbols > {quality.MAX_SYMBOLS} * n_words then {_BIT['symbols']} else 0 end
    + case when 100 * n_dup_lines > {quality.MAX_LINES} * n_lines then {_BIT['repeated_lines']} else 0 end
    + case when 100 * n_capitals > {quality.MAX_CAPITALS} * word_chars then {_BIT['capitals']} else 0 end
    + case when word_chars < {quality.WORD_LENGTHS[0]} * n_words or word_chars > {quality.WORD_LENGTHS[1]} * n_words then {_BIT['word_length']} else 0 end)::int as bits
  from m)
select *, (bits & {quality.mask_of(quality.BASE)}) <> 0 as base_failed,
  (bits & {quality.mask_of(quality.BASE)}) = 0 and (bits & {quality.mask_of(quality.POLICIES[quality.CURRENT])}) = 0 as kept from b
"""

_BLOCKS = r"(?i)</?(?:b|i|em|strong|a|span|u|s|small|sub|sup|code|mark|q|cite|font)(?:\s[^>]*)?>"
HTML_TEXT = rf"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(?:</article>|\z)', 1) as h from pages),
b as (select page_id, url, regexp_replace(regexp_replace(h, '{_BLOCKS}', '', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g') as t from a),
c as (select page_id, url, replace(replace(replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&#39;', '''') as t from b),
d as (select page_id, url, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as text from c)
select page_id, url, text, length(text)::bigint as n_chars from d
"""

NEAR = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as ws from ({TEXTS})),
s as materialized (
  select distinct doc_id, ws[i] || ' ' || ws[i + 1] as k from w, unnest(range(1, len(ws))) u(i) where len(ws) >= 2
  union all select doc_id, ws[1] from w where len(ws) = 1),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
sized as materialized (select s.doc_id, hash(k) as k, n from s join n using (doc_id)),
pairs as materialized (
  select a.doc_id as a, b.doc_id as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb
  from sized a join sized b on a.k = b.k and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2),
links as materialized (select a, b from pairs where 100 * c >= 80 * (na + nb - c)),
both_ways as materialized (select a, b from links union all select b, a from links),
reach as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
low as (select a, min(b) as m from reach group by a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(low.m, w.doc_id)) as component_id, w.doc_id <= coalesce(low.m, w.doc_id) as kept
from w left join n on n.doc_id = w.doc_id left join low on low.a = w.doc_id
"""


def span_views(name: str, pattern: str) -> str:
    """Views `name` (doc_id, t, hit, s, e): matches with places, from the pieces between them."""
    p = quoted(pattern)
    return f"""
{name}_m as (select doc_id, t, regexp_extract_all(t, {p}) as hits, string_split_regex(t, {p}) as gaps from texts),
{name} as (
  select doc_id, t, hits[i] as hit, e - length(hits[i]) as s, e from (
    select doc_id, t, hits, i, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(hits[1:i], lambda x: length(x))))::bigint as e
    from {name}_m, unnest(range(1, len(hits) + 1)) u(i)))"""


_LUHN = """list_sum(list_transform(range(0, length(d)), lambda i: case when i % 2 = 0 then d[length(d) - i]::int
  when d[length(d) - i]::int > 4 then 2 * d[length(d) - i]::int - 9 else 2 * d[length(d) - i]::int end)) % 10 = 0"""
_MOD97 = """list_reduce(list_transform(string_split(d[5:] || d[:4], ''), lambda c: case when c between '0' and '9' then c::int else ascii(c) - 55 end),
  lambda acc, v: case when v < 10 then (acc * 10 + v) % 97 else (acc * 100 + v) % 97 end) = 1"""


def pii_sql() -> str:
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+",
            "phone": pii.PATTERNS["phone"], "iban": pii.PATTERNS["iban"], "ssn": pii.PATTERNS["ssn"]}
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    near = " or ".join(f"regexp_matches(near, '(?i)\\b{w}\\b')" for w in pii.CONTEXT["ssn"])
    keep = {
        "email": "select doc_id, s, e from email",
        "ip": "select doc_id, s, e from ip where len(list_filter(string_split(hit, '.'), lambda x: coalesce(try_cast(x as bigint) <= 255, false))) = 4",
        "card": f"select doc_id, s, e from (select *, {digits} as d from card) where length(d) between 16 and 19 and {_LUHN}",
        "phone": f"select doc_id, s, e from phone where length({digits}) between 8 and 15",
        "iban": f"select doc_id, s, e from (select *, replace(hit, ' ', '') as d from iban) where {_MOD97}",
        "ssn": f"""select doc_id, s, e from (select *, substr(t, greatest(s - {pii.CONTEXT_REACH}, 0) + 1, s - greatest(s - {pii.CONTEXT_REACH}, 0)) || ' '
          || substr(t, e + 1, {pii.CONTEXT_REACH}) as near from ssn) where {near}""",
    }
    views = ",".join(span_views(k, base[k]) for k in pii.KINDS)
    spans = " union all ".join(f"select doc_id, {r} as r, '{k}' as kind, s, e from ({keep[k]})" for r, k in enumerate(pii.KINDS))
    counts = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in pii.KINDS)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' order by r, s)"
    return f"""
with texts as ({TEXTS}), {views},
spans as ({spans}),
g as (select doc_id, {counts}, coalesce({joined} filter (r < {len(pii.BASE)}), '') as base, {joined} as spans from spans group by doc_id)
select doc_id, {', '.join(f'coalesce(n_{k}, 0)::bigint as n_{k}' for k in pii.KINDS)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join g using (doc_id)
"""


def secrets_sql() -> str:
    assign = secret_scan.ASSIGN
    allow = " or ".join(f"regexp_matches(hit, {quoted(p)})" for p in secret_scan.ALLOW)
    bits = {n: secret_scan.most_weight(b) for n, _, b in secret_scan.CLASSES}
    has = lambda p: f"regexp_matches(hit, '{p}')"
    limit = f"""case when {has('^[0-9a-fA-F]+$')} and {has('[0-9]')} and {has('[a-fA-F]')} then {bits['hex']}
      when {has('^[0-9a-z]+$')} and {has('[0-9]')} and {has('[a-z]')} then {bits['lower']}
      when {has('^[0-9A-Z]+$')} and {has('[0-9]')} and {has('[A-Z]')} then {bits['upper']}
      when {has('[0-9]')} and {has('[a-z]')} and {has('[A-Z]')} then {bits['mixed']} else -1 end"""
    w = secret_scan.WINDOW
    least = f"""list_min(list_transform(range(1, length(hit) - {w} + 2), lambda i: list_sum(list_transform(
      map_values(list_histogram(string_split(substr(hit, i, {w}), ''))), lambda c: {secret_scan.WEIGHT}[c::int + 1]))))"""
    keep = {
        "assign": f"select doc_id, s, e from assign where length(regexp_extract(hit, {quoted(assign)}, 1)) >= 6",
        "access": "select doc_id, s, e from access where length(hit) >= 20",
        "hex": "select doc_id, s, e from hex where length(hit) >= 24",
        "entropy": f"""select doc_id, s, e from (select *, {limit} as lim from entropy where length(hit) >= {w} and {has('[0-9]')} and not ({allow}))
          where lim >= 0 and {least} <= lim""",
    }
    base = {"assign": assign, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "entropy": "[A-Za-z0-9+/_=-]+"}
    views = ",".join(span_views(k, base[k]) for k in secret_scan.KINDS)
    spans = " union all ".join(f"select doc_id, {r} as r, '{k}' as kind, s, e from ({keep[k]})" for r, k in enumerate(secret_scan.KINDS))
    counts = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in secret_scan.KINDS)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' order by s, r)"
    return f"""
with texts as ({TEXTS}), {views},
spans as ({spans}),
g as (select doc_id, {counts}, coalesce({joined} filter (r < 3), '') as base, {joined} as spans from spans group by doc_id)
select doc_id, {', '.join(f'coalesce(n_{k}, 0)::bigint as n_{k}' for k in secret_scan.KINDS)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join g using (doc_id)
"""


_W = substring.WINDOW
SUBSTRING = f"""
with w as materialized (select doc_id, regexp_extract_all(t, '{WORD}') as ws from ({TEXTS})),
win as (select doc_id, i, array_to_string(ws[i:i + {_W - 1}], ' ') as k from w, unnest(range(1, len(ws) - {_W - 2})) u(i)),
first as (select doc_id, i, min(doc_id) over (partition by k) as m from win),
gone as (select distinct doc_id, unnest(range(i, i + {_W})) as p from first where m < doc_id),
each as (select doc_id, i as p, ws[i] as word from w, unnest(range(1, len(ws) + 1)) u(i)),
left_over as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as kept from each anti join gone using (doc_id, p) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join left_over using (doc_id)
"""

_TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _tokens(table: str, key: str) -> str:
    return f"""select {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TOKEN}') as ws from {table}"""


OVERLAPS = f"""
with d as (select doc_id, i - 1 as p, ws[i] as word from ({_tokens('documents', 'doc_id')}), unnest(range(1, len(ws) + 1)) u(i)),
b as (select item_id, i - 1 as q, ws[i] as word, len(ws) as n from ({_tokens('benchmark', 'item_id')}), unnest(range(1, len(ws) + 1)) u(i)),
need as (select *, (least({decontam.WINDOW}, n) * {decontam.LEAST} + {decontam.WINDOW - 1}) // {decontam.WINDOW} as need from b),
m as (select doc_id, item_id, p - q as shift, q, p, need, count(*) over (partition by doc_id, item_id, p - q) as total from d join need using (word)),
held as (
  select *, count(*) over (partition by doc_id, item_id, shift order by q range between current row and {decontam.WINDOW - 1} following) as c from m where total >= need)
select doc_id, item_id, max(c)::bigint as n_equal, min(p)::bigint as doc_start from held where c >= need group by doc_id, item_id
"""

_FEATURE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_B = resample.BUCKETS


def _features(table: str, key: str) -> str:
    """(key, n_words, f): the runs of one and two words of each text."""
    return f"""select {key}, n_words, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as f from (
      select {key}, len(ws) as n_words, ws from (select {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_FEATURE}') as ws from {table}))"""


RESAMPLE = f"""
with crc as materialized (select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b::bigint)) as t),
df as materialized (select doc_id, f, count(*) as n from ({_features('documents', 'doc_id')}) group by all),
bf as materialized (select f, count(*) as n from ({_features('benchmark', 'item_id')}) group by all),
hashed as (select f, hex(f) as h from (select f from df union select f from bf)),
bucket as materialized (
  select f, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::bigint),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % {_B} as k from hashed, crc),
s as (select k, sum(n)::bigint as n from df join bucket using (f) group by k),
t as (select k, sum(n)::bigint as n from bf join bucket using (f) group by k),
total as (select (select coalesce(sum(n), 0) from s)::bigint + {_B} as s, (select coalesce(sum(n), 0) from t)::bigint + {_B} as t),
gain as (select s.k, floor({resample.SCALE} * ln((coalesce(t.n, 0) + 1)::double * total.s::double / ((s.n + 1)::double * total.t::double)))::bigint as g from total, s left join t using (k)),
w as (select doc_id, sum(n)::bigint as n_features, floor(sum(n * g)::double / sum(n)::double)::bigint as weight from df join bucket using (f) join gain using (k) group by doc_id),
words as (select doc_id, len(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_FEATURE}')) as n_words from documents),
scored as (
  select doc_id, n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0)
    + floor(-{resample.SCALE}.0 * ln(-ln((('0x' || substr(sha256('{resample.SEED}:' || doc_id), 1, 8))::bigint::double + 0.5) / 4294967296.0)))::bigint as score
  from words left join w using (doc_id)),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_words >= {resample.LEAST_WORDS})
select doc_id, n_features, weight, score, case when place <= {resample.PERCENT} * n // 100 then place end as rank from scored left join placed using (doc_id)
"""


def vector_codes_sql(size: int = 64) -> str:
    """For vectors of `size` components: assignment and means, round after round."""
    parts, entries, width = vector_codes.PARTS, vector_codes.ENTRIES, size // vector_codes.PARTS
    steps = []
    for r in range(vector_codes.ROUNDS + 1):
        steps.append(f"""a{r} as materialized (
  select vec_id, p, any_value(part.w) as w, min((list_sum(list_transform(range(1, {width} + 1), lambda i: (part.w[i] - b.w[i]) * (part.w[i] - b.w[i]))))::bigint * {entries} + e) as best
  from part join b{r} b using (p) group by vec_id, p)""")
        if r < vector_codes.ROUNDS:
            steps.append(f"""m{r} as (
  select p, e, list(m order by i) as w from (select p, best % {entries} as e, i, floor(sum(w[i])::double / count(*)::double)::bigint as m from a{r}, range(1, {width} + 1) d(i) group by all) group by p, e),
b{r + 1} as materialized (select b.p, b.e, coalesce(m.w, b.w) as w from b{r} b left join m{r} m using (p, e))""")
    last = vector_codes.ROUNDS
    return f"""
with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor(x::double * {vector_codes.SCALE})::bigint) as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
part as materialized (select vec_id, p, v[p * {width} + 1:p * {width} + {width}] as w from kept, range({parts}) t(p)),
b0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, w from part where vec_id in (select vec_id from kept order by vec_id limit {entries})),
{", ".join(steps)},
coded as (select vec_id, string_agg(lower(lpad(hex(best % {entries}), 2, '0')), '' order by p) as code, sum(best // {entries})::bigint as error from a{last} group by vec_id),
book as (select sha256(string_agg(x::varchar, ',' order by p, e, i)) as h from (select p, e, i, w[i] as x from b{last}, range(1, {width} + 1) d(i)))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from coded join kept using (vec_id), book
"""


ORACLE = {
    "op1_sharding": SHARDING,
    "op2_quality_rules": QUALITY,
    "op3_html_text": HTML_TEXT,
    "op4_near_duplicates": NEAR,
    "op5_personal_data": pii_sql(),
    "op6_secrets": secrets_sql(),
    "op8_substring_dedup": SUBSTRING,
    "op10_benchmark_overlaps": OVERLAPS,
    "op12_importance_resampling": RESAMPLE,
    "op13_vector_codes": vector_codes_sql(),
}
