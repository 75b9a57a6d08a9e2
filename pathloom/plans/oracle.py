"""DuckDB SQL of the queries, written as common table expressions over the same tables.

It shares with the library the fixed patterns and word lists alone; the order of
rules, the joins and the arithmetic are stated here again.
"""

from __future__ import annotations

from ..functions import lexicon as L
from .queries import HOSTS, WORDS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(items: list[str]) -> str:
    return "(" + ", ".join(map(_q, items)) + ")"


def _re(pattern: str) -> str:
    return _q(pattern.replace("(?iu:", "(?i:").replace("(?iu)", "(?i)").replace(r"\u000B", r"\x0B").replace(r"\u000C", r"\x0C"))


def _m(v: str, pattern: str) -> str:
    return f"regexp_matches({v}, {_re(pattern)})"


def _g(v: str, pattern: str, k: int) -> str:
    return f"regexp_extract({v}, {_re(pattern)}, {k})"


def sql_plausible(y: str, m: str, d: str) -> str:
    return f"(try_cast({y} as int) between 1900 and 2100 and try_cast({m} as int) between 1 and 12 and try_cast({d} as int) between 1 and 31)"


def sql_currency(v: str) -> str:
    return f"case when upper({v}) in {_in(L.CURRENCIES)} then upper({v}) end"


def sql_date(v: str) -> str:
    def made(p: str, y: int, m: int, d: int) -> str:
        parts = _g(v, p, y), f"lpad({_g(v, p, m)}, 2, '0')", f"lpad({_g(v, p, d)}, 2, '0')"
        return f"when {_m(v, p)} then case when {sql_plausible(*parts)} then {parts[0]} || '-' || {parts[1]} || '-' || {parts[2]} end"

    return "case " + " ".join([made(L.DATE_ISO, 1, 2, 3), made(L.DATE_SLASH, 1, 2, 3), made(L.DATE_US, 3, 1, 2), made(L.COMPACT_DATE, 1, 2, 3)]) + " end"


def sql_type(v: str, activations: tuple[tuple[str, str], ...] = (), learned: str = "") -> str:
    """``learned`` is a table (prefix, type) of activations."""
    word = _g(v, r"^([a-z]+_)[A-Za-z0-9]+\z", 1)
    slug_or = f"case when {_m(v, L.SLUG)} then 'slug' else "
    n = f"try_cast({v} as bigint)"
    exts = [x for xs in L.FILE_KINDS.values() for x in xs]
    rules = [
        (f"{v} = ''", "'literal'"),
        (_m(v, L.UUID), "'uuid'"),
        (f"{_m(v, L.DATE_ISO)} or {_m(v, L.DATE_SLASH)} or {_m(v, L.DATE_US)}", "'date'"),
        (f"{_m(v, L.INTEGER)} and ({n} between 1000000000 and 9999999999 or {n} between 1000000000000 and 9999999999999)", "'timestamp'"),
        (f"{_m(v, L.COMPACT_DATE)} and {sql_plausible(f'substr({v}, 1, 4)', f'substr({v}, 5, 2)', f'substr({v}, 7, 2)')}", "'date'"),
        (_m(v, L.INTEGER), "'integer'"),
        *((_m(v, "^" + p + r"[A-Za-z0-9]+\z"), _q(t)) for p, t in activations),
        *([(f"{word} in (select prefix from {learned})", f"(select max(type) from {learned} where prefix = {word})")] if learned else []),
        (_m(v, L.JWT), "'jwt'"),
        (_m(v, L.COLOR_HEX), "'color'"),
        (_m(v, L.URL), "'url'"),
        (_m(v, L.EMAIL), "'email'"),
        (_m(v, L.MIME), "'mime'"),
        (_m(v, L.SCHEMELESS_URL), "'url'"),
        (_m(v, L.IPV4), f"case when list_max(list_transform(string_split({v}, '.'), lambda o: o::int)) <= 255 then 'ipv4' else 'opaque_id' end"),
        (f"{_m(v, L.IPV6_FULL)} or (contains({v}, '::') and {_m(v, L.IPV6_COMPRESSED)})", "'ipv6'"),
        (_m(v, L.COORDINATE), "'coordinate'"),
        (_m(v, L.HASH), "'hash'"),
        (_m(v, L.VERSION), "'version'"),
        (_m(v, L.BOOLEAN), "'boolean'"),
        (_m(v, L.LOCALE), f"case when {_g(v, L.LOCALE, 1)} in {_in(L.LANGUAGES)} then 'locale' else {slug_or} 'literal' end end"),
        (_m(v, L.LOCALE_BARE), f"case when {v} in {_in(L.LANGUAGES)} then 'locale' else 'literal' end"),
        (_m(v, L.ISO_TIME), "'timestamp'"),
        (_m(v, L.PHONE), f"case when length(regexp_replace({v}, '[^0-9]', '', 'g')) between 7 and 15 then 'phone' else 'opaque_id' end"),
        (f"{_m(v, L.PHONE_NANP)} and regexp_matches({v}, '[-.]|^\\(')", "'phone'"),
        (_m(v, L.FLOAT), "'float'"),
        (_m(v, L.CURRENCY), f"case when upper({v}) in {_in(L.CURRENCIES)} then 'currency' else 'literal' end"),
        (_m(v, L.COUNTRY), f"case when {v} in {_in(L.COUNTRIES)} then 'country' else 'literal' end"),
        (f"{_m(v, L.BASE64)} and regexp_matches({v}, '[=+/]')", "'base64'"),
        (_m(v, L.FILE), f"case when lower({_g(v, L.FILE, 1)}) in {_in(exts)} then 'file' else {slug_or} 'opaque_id' end end"),
        (_m(v, L.SLUG), "'slug'"),
        (_m(v, L.LITERAL), "'literal'"),
        (_m(v, L.OPAQUE), "'opaque_id'"),
    ]
    return "case " + " ".join(f"when {a} then {b}" for a, b in rules) + " else 'literal' end"


def sql_kind(v: str) -> str:
    ext = f"lower({_g(v, L.FILE_EXT, 1)})"
    return "case " + " ".join(f"when {ext} in {_in(xs)} then '{k}'" for k, xs in L.FILE_KINDS.items()) + " else 'unknown' end"


def sql_name_hint(name: str, t: str) -> str:
    return f"case when {t} in ('literal', 'opaque_id', 'slug') then case " + " ".join(f"when lower({name}) in {_in(xs)} then '{k}'" for k, xs in L.NAME_HINTS.items()) + " end end"


def sql_singular(w: str) -> str:
    special = " ".join(f"when lower({w}) = '{a}' then '{b}'" for a, b in L.IRREGULAR.items())
    rules = " ".join(f"when {_m(w, p)} then regexp_replace({w}, {_re(p)}, {_q(r.replace('$', chr(92)))})" for p, r in L.SINGULAR_RULES)
    return f"case when lower({w}) in {_in(L.UNCOUNTABLE)} then {w} {special} {rules} else {w} end"


def sql_registrable(h: str) -> str:
    l = f"string_split({h}, '.')"  # noqa: E741
    two = f"array_to_string({l}[-2:], '.')"
    return f"case when {_m(h, L.IPV4)} or len({l}) <= 2 then {h} when {two} in {_in(L.TWO_LABEL_SUFFIXES)} then array_to_string({l}[-3:], '.') else {two} end"


def _display(t: str) -> str:
    return f"case when {t} in ('ipv4', 'ipv6') then 'ip' else {t} end"


def _place(t: str) -> str:
    return "'{' || " + _display(t) + " || '}'"


def _canon(t: str, v: str) -> str:
    return f"case {t} when 'date' then {sql_date(v)} when 'currency' then {sql_currency(v)} end"


def _rendered(name: str, v: str, t: str) -> str:
    up = f"coalesce({sql_name_hint(name, t)}, {t})"
    return f"coalesce({_canon(up, v)}, case when {up} <> 'literal' then {_place(up)} end, {v})"


_DATES = "case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y/%m/%d') when 2 then strftime(o_orderdate, '%-m/%-d/%Y') when 3 then strftime(o_orderdate, '%Y%m%d') else '2024-' || (10 + o_orderkey % 9) || '-' || (20 + o_orderkey % 17) end"

LOGS = {
    "pages": "select page_id as obs_id, url from pages",
    "orders": "select o_orderkey as obs_id, 'https://api.example.com/v1/customers/' || o_custkey || '/orders/' || o_orderkey || '?status=' || o_orderstatus || '&date=' || cast(o_orderdate as date) as url from orders",
    "customers": "select c_custkey as obs_id, 'https://crm.example.com/segments/' || lower(c_mktsegment) || '/customers/cus_' || c_custkey as url from customer",
    "workspaces": "select c_custkey as obs_id, 'https://www.example.org/workspaces/ws' || translate(cast(c_custkey as varchar), '0123456789', 'abcdefghij') as url from customer",
    "events": "select event_id as obs_id, 'https://' || case when event_id % 2 = 1 then 'api' else 'www' end || '.example.net/' || event_type || '/' || user_id || '?code=' || (200 + event_id % 20) || '&year=' || (1990 + event_id % 40) || '&v=' || cast(value as decimal(12,2)) || '&k=' || event_id as url from events",
    "lineitem": "select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as obs_id, 'https://shop.example.com/orders/' || l_orderkey || '/items/' || l_linenumber || '?flag=' || l_returnflag || '&qty=' || cast(l_quantity as int) || '&disc=' || cast(l_discount as decimal(12,2)) || '&size=' || case when l_linenumber % 2 = 0 then cast(cast(l_quantity as int) as varchar) else cast(cast(l_quantity + 0.5 as decimal(12,1)) as varchar) end as url from lineitem",
    "urns": "select 2 * p_partkey as obs_id, 'urn:isbn:' || (p_partkey + 1000000) as url from part union all select 2 * p_partkey + 1, 'mailto:u' || p_partkey || '@example.com' from part",
    "notes": f"select o_orderkey as obs_id, 'https://api.example.com/orders/' || o_orderkey || '?date=' || {_DATES} || '&email=nobody&cur=' || case when o_orderkey % 2 = 0 then 'usd' else 'EUR' end as url from orders",
    "files": "select p_partkey as obs_id, 'https://files.example.com/get?name=doc' || p_partkey || ['.pdf', '.png', '.csv', '.zip'][p_partkey % 4 + 1] as url from part",
}
LOGS["mixed"] = f"select obs_id * 4 as obs_id, url from ({LOGS['pages']}) union all select obs_id * 4 + 1, url from ({LOGS['urns']})"
LOGS["orders_workspaces"] = f"{LOGS['orders']} union all select obs_id + 1000000000, url from ({LOGS['workspaces']})"
LOGS["pages_orders"] = f"{LOGS['pages']} union all select obs_id + (select max(page_id) from pages), url from ({LOGS['orders']})"


_RAW = {  # texts in which URLs are found; after each boundary at most one starts, and goes to the next
    "text": r"""case page_id % 12 when 0 then 'See (' || url || '), then ' || url || '. Done' when 1 then '<' || url || '>' when 2 then 'x' || url when 3 then url || '!!? or ' || url || ').'
when 4 then '[' || url || '](' || url || '/a)' when 5 then upper(substr(url, 1, 4)) || substr(url, 5) when 6 then chr(8220) || url || chr(8221) || chr(12304) || url || chr(12305) when 7 then 'visit ' || regexp_replace(url, '^[a-z]+://', '') || '; bye'
when 8 then 'user@' || regexp_replace(url, '^[a-z]+://', '') when 9 then 'urn:isbn:' || page_id || '; mailto:a@b.com ' || url || '/(a)b)}]' when 10 then null else 'a_' || url || ' ' || url || ':' || chr(9) || url || '...' end""",
    "start": rf"(?:^|[^A-Za-z0-9_/.@])((?i:{'|'.join(L.EXTRACT_SCHEMES)})://.+|urn:[a-zA-Z0-9][a-zA-Z0-9\-]{{0,30}}:.+|(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{{0,61}}[a-zA-Z0-9])?\.)+(?i:{'|'.join(L.EXTRACT_TLDS)})/.+)$",
}


def _found() -> str:
    """(page_id, pos, url) of the odd texts: cut at boundaries, then trimmed step by step, more often than any text needs."""
    marks = "[" + "".join("\\" + c if c in "\\]^-" else c for c in L.EXTRACT_TRAILING) + "]+$"
    edges = r"[ \t\r\n\x0B\x0C" + "".join("\\" + c if c in "\\]^-[" else c for c in L.EXTRACT_BOUNDARIES) + "]+"
    v = "url"
    steps = f"select page_id, i, regexp_extract(x, {_q(_RAW['start'])}, 1) as url from (select page_id, i, xs[i] as x from (select page_id, regexp_split_to_array({_RAW['text']}, {_q(edges)}) as xs from pages) as c, unnest(range(1, len(xs) + 1)) as g(i))"
    for _ in range(5):
        steps = f"select page_id, i, regexp_replace(url, {_q(marks)}, '') as url from ({steps})"
        for a, b in ("()", "[]", "{}"):
            steps = f"select page_id, i, case when ends_with({v}, '{b}') and len({v}) - len(replace({v}, '{b}', '')) > len({v}) - len(replace({v}, '{a}', '')) then substr({v}, 1, len({v}) - 1) else {v} end as url from ({steps})"
    return f"select page_id, row_number() over (partition by page_id order by i) - 1 as pos, url from ({steps}) where url <> ''"


LOGS["odd"] = f"select page_id * 64 + pos as obs_id, case when regexp_matches(url, '^(?:[a-zA-Z]+://|urn:)') then url else 'https://' || url end as url from ({_found()})"
LOGS["pages_repeats"] = f"select obs_id * 2 as obs_id, url from ({LOGS['pages']}) union all select o_orderkey * 2 + 1, 'https://api.example.com/o?a=' || o_orderkey % 7 || '&b&a=' || o_orderkey % 5 || '&=' || o_orderkey || '&c=&b=' || o_orderstatus || case when o_orderkey % 3 = 0 then '&a' else '' end || '&&d=x=' || o_orderkey % 2 from orders"
_BROKEN = r"""select p_partkey * 4 + 2 as obs_id, trim(case p_partkey % 7 when 0 then ' https://a' || p_partkey || '.com:8080/x ' || chr(9) when 1 then '  ' when 2 then case when p_partkey % 2 = 0 then 'urn:' else 'URN:' end when 3 then 'h' || p_partkey || ':' when 4 then 'word' || p_partkey
  when 5 then 'http://' || case when p_partkey % 2 = 0 then ':80/x' else '/y' end else 'https://b.com:' || p_partkey || '99999999999999999999/' end, ' ' || chr(9)) as t from part"""
_ERRORS = rf"""select obs_id, case when t = '' then 'input is empty' when regexp_matches(t, '^(?i:urn):$') then 'urn without content' when regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.\-]*:$') then 'scheme without content'
  when not regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.\-]*:') then 'neither a scheme nor a host' when regexp_matches(t, '^[a-zA-Z]+://(?:[/?#]|$)') then 'no authority' when regexp_matches(t, '^[a-zA-Z]+://[^/?#:]+:[0-9]') and try_cast(regexp_extract(t, '^[a-zA-Z]+://[^/?#:]+:([0-9]+)', 1) as bigint) is null then 'invalid port' end as error, t from ({_BROKEN})"""


def base(log: str, strategy: str = "full", activations: tuple[tuple[str, str], ...] = (), learned: str = "") -> str:
    """CTEs log, iri, seg (with type, hint, tokens and locator), par, obs of a log whose URLs have an authority or are opaque."""
    host = {"full": "host", "registrable": sql_registrable("host"), "none": "''"}[strategy]
    return rf"""
with recursive {f"learned as materialized ({learned})," if learned else ""} log as materialized ({LOGS[log]}),
cut as (select obs_id, url, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+\-.]*):', 1)) as scheme, substr(url, strpos(url, ':') + 1) as rest from log),
auth as (select obs_id, scheme, rest, case when starts_with(rest, '//') then 'url' else 'urn' end as kind, regexp_extract(rest, '^//([^/?#:]*)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?', ['host', 'port', 'path', 'query', 'fragment']) as a, contains(rest, '#') as hashed, contains(rest, '?') as asked from cut),
iri as materialized (select obs_id, kind, scheme, case when kind = 'url' then lower(a.host) else '' end as host,
  case when kind = 'url' and (scheme, a.port) not in (('http', '80'), ('https', '443')) then try_cast(a.port as bigint) end as port,
  case when kind = 'url' then list_filter(string_split(a.path, '/'), lambda x: x <> '' and x <> '.') else [] end as segs,
  case when kind = 'url' and asked then a.query end as query, case when kind = 'url' and hashed then a.fragment end as fragment, case when kind = 'urn' then rest end as nss from auth),
canon as (select *, case when kind = 'urn' then scheme || ':' || nss else scheme || '://' || host || coalesce(':' || port, '') || case when len(segs) > 0 then '/' || array_to_string(segs, '/') when coalesce(query, '') <> '' or coalesce(fragment, '') <> '' then '/' else '' end
  || case when coalesce(query, '') <> '' then '?' || query else '' end || case when coalesce(fragment, '') <> '' then '#' || fragment else '' end end as canonical from iri),
parts as (select obs_id, kind, scheme, host, case when kind = 'url' then segs when strpos(nss, ':') > 0 then [split_part(nss, ':', 1), substr(nss, strpos(nss, ':') + 1)] else [nss] end as ps from iri),
part as (select obs_id, kind, (i - 1)::int as pos, ps[i] as value from parts, unnest(range(1, len(ps) + 1)) as g(i)),
kinds as materialized (select value, {sql_type('value', activations, 'learned' if learned else '')} as type from (select distinct value from part)),
near as (select obs_id, kind, pos, value, type, lag(value) over w as pv, lag(type) over w as pt from part join kinds using (value) window w as (partition by obs_id order by pos)),
hinted as (select *, case when type in {_in(L.HINTED_TYPES)} and pt = 'literal' then {sql_singular('pv')} || case when type = 'uuid' then '_uuid' else '_id' end end as hint from near),
tok as materialized (select *, case when type = 'literal' then value else coalesce('{{' || hint || '}}', {_place('type')}) end as hinted_token, case when type = 'literal' then value else {_place('type')} end as raw_token, case when type = 'literal' then value else '{{' || type || '}}' end as way from hinted),
shaped as (select obs_id, string_agg(hinted_token, '/' order by pos) as hs, string_agg(raw_token, '/' order by pos) as rs, max(case when pos = 1 then case when type = 'literal' then value else coalesce('{{' || hint || '}}', '{{' || type || '}}') end end) as second from tok group by obs_id),
obs as materialized (select c.obs_id, c.kind, c.scheme, case when c.kind = 'url' then {host.replace('host', 'c.host') if strategy != 'none' else host} else '' end as khost, c.host, c.canonical, len(c.segs) as length, case when c.kind = 'url' then '/' || coalesce(s.hs, '') else '/' end as shape, case when c.kind = 'url' then '/' || coalesce(s.rs, '') else '/' end as raw_shape, c.nss, s.second from canon c left join shaped s using (obs_id)),
keyed as materialized (select *, case when kind = 'url' then scheme || '://' || khost || shape else scheme || ':' || split_part(nss, ':', 1) || ':' || coalesce(second, '') end as cluster_key from obs),
seg as materialized (select t.obs_id, k.khost as host, k.cluster_key, 'path' as scope, coalesce(string_agg('/' || t.way, '') over (partition by t.obs_id order by t.pos rows between unbounded preceding and 1 preceding), '') as locator, t.pos, t.value, t.type, t.hint, t.hinted_token, t.raw_token from tok t join keyed k using (obs_id) where t.kind = 'url'),
pairs as (select i.obs_id, x as raw, split_part(x, '=', 1) as name, case when contains(x, '=') then substr(x, strpos(x, '=') + 1) end as value from iri i, unnest(string_split(query, '&')) as g(x) where kind = 'url' and coalesce(query, '') <> ''),
ptypes as materialized (select value, {sql_type('value')} as type from (select distinct coalesce(value, '') as value from pairs)),
par as materialized (select p.obs_id, k.cluster_key, p.name, coalesce(p.value, '') as value, y.type from pairs p join keyed k using (obs_id) join ptypes y on y.value = coalesce(p.value, '') where p.name <> '')"""


_PV = "pv as (select cluster_key, name, value, n, first_obs from (select *, row_number() over (partition by cluster_key, name order by first_obs) as r from (select cluster_key, name, value, count(*) as n, min(obs_id) as first_obs from par group by all)) where r <= 5000)"
_PT = "pt as (select cluster_key, name, type, count(*) as n from par group by all)"
_NUM = "num as (select cluster_key, name, count(x) as num_count, min(x) as num_min, max(x) as num_max, avg(x) as num_avg from (select cluster_key, name, try_cast(value as double) as x from par where type in ('integer', 'float')) where isfinite(x) group by all)"
#: The type of a parameter over the columns of ps.
_LADDER = f"""case
  when dominant = 'integer' and num_count > 0 and cardinality between 2 and 150 and total >= 5 and num_min >= 1900 and num_max <= 2100 then 'year'
  when dominant = 'integer' and num_count > 0 and cardinality between 2 and 30 and total >= 5 and num_min >= 100 and num_max <= 599 then 'http_status'
  when dominant <> 'boolean' and total >= 20 and est between 2 and 10 and estn / total::double >= 0.9 then 'enum'
  when dominant = 'date' then case when dates / total::double >= 0.8 then 'date' else coalesce(undated, 'literal') end
  when dominant in ('integer', 'float') and integers / total::double < 0.8 and floats / total::double < 0.8 and (integers + floats) / total::double >= 0.8 then 'number'
  else coalesce({sql_name_hint('name', 'dominant')}, case when dominant = 'literal' and cardinality >= 2 then 'string' else dominant end) end"""
_PS = f"""{_PV}, {_PT}, {_NUM},
pd as (select cluster_key, name, max(case when r = 1 then type end) as dominant, sum(n)::bigint as total, sum(case when type = 'date' then n else 0 end) as dates, sum(case when type = 'integer' then n else 0 end) as integers, sum(case when type = 'float' then n else 0 end) as floats, max(case when u = 1 and type <> 'date' then type end) as undated
  from (select *, row_number() over (partition by cluster_key, name order by n desc, type) as r, row_number() over (partition by cluster_key, name order by type = 'date', n desc, type) as u from pt) group by all),
pc as (select cluster_key, name, count(*) as cardinality, count(*) filter (n >= 3) as est, coalesce(sum(n) filter (n >= 3), 0) as estn from pv group by all),
ps as (select pd.*, pc.cardinality, pc.est, pc.estn, num.num_count, num.num_min, num.num_max, num.num_avg, {_LADDER} as ptype
  from pd join pc using (cluster_key, name) left join num using (cluster_key, name))"""
_EV = """posv as (select host, scope, locator, value, n as vc from (select *, row_number() over (partition by host, scope, locator order by first_obs) as r from (select host, scope, locator, value, count(*) as n, min(obs_id) as first_obs from seg group by all)) where r <= 5000),
post as (select host, scope, locator, count(*) as tot, count(*) filter (type <> 'literal') as var from seg group by all),
posc as (select host, scope, locator, count(*) as card from posv group by all),
ev as (select s.*, t.tot, t.var, c.card, v.vc, coalesce(v.vc, 0) / t.tot::double as vf from seg s join post t using (host, scope, locator) join posc c using (host, scope, locator) left join posv v using (host, scope, locator, value))"""


def _verdict(stable: str = _in(L.STABLE_TYPES)) -> str:
    rare = "case when vc is not null then 'rare_literal' else 'ambiguous' end"
    return f"""case when type <> 'literal' and type not in {stable} then 'variable_identifier'
  when type <> 'literal' then case when tot >= 5 and vf >= 0.5 then 'stable_literal' else 'variable_identifier' end
  when tot >= 5 and var / tot::double >= 0.8 then {rare}
  when vf >= 0.5 then 'stable_literal'
  when tot >= 5 and (card / tot::double >= 0.8 or (card / tot::double >= 0.5 and card >= 20)) then case when vc >= 5 and vf >= 3.0 / card then 'stable_literal' else 'corpus_inferred_variable' end
  when card = 1 then 'stable_literal' else {rare} end"""


def _render(segs: str, params: str) -> str:
    """The normal forms of a log from token CTEs (obs_id, pos, token) and (obs_id, name, token)."""
    return f"""select k.obs_id, k.scheme || '://' || k.host || coalesce(':' || i.port, '') || '/' || coalesce(s.t, '') || coalesce('?' || p.t, '') as normalized from keyed k join iri i using (obs_id)
left join (select obs_id, string_agg(token, '/' order by pos) as t from {segs} group by obs_id) s using (obs_id)
left join (select obs_id, string_agg(name || '=' || token, '&' order by name) as t from {params} group by obs_id) p using (obs_id)"""


_INFORMED = f"""coalesce({_canon('type', 'value')}, case when verdict in ('variable_identifier', 'corpus_inferred_variable') then case when type <> 'literal' then coalesce('{{' || hint || '}}', {_place('type')})
  else coalesce('{{' || (select {sql_singular('w')} from (select list_filter(string_split(locator, '/'), lambda x: x <> '' and not starts_with(x, '{{'))[-1] as w) where w is not null) || '}}', '{{value}}') end end, value)"""
_PARAM_INFORMED = f"case when total >= 5 then coalesce({_canon('ptype', 'value')}, case when ptype <> 'literal' then {_place('ptype')} end, value) else {_rendered('name', 'value', 'type')} end"
def _running_params() -> str:
    """Columns of ps for each parameter as it stood with its row, from running counts of values and of each type."""
    def at(what: str, keep: str = "") -> str:
        return f"{what}{f' filter ({keep})' if keep else ''} over (partition by cluster_key, name order by obs_id)"

    counts = ", ".join(f"(-{at('count(*)', f'type = {_q(t)}')}, {_q(t)})" for t in sorted(L.BUILT_IN_TYPES))
    finite = "case when type in ('integer', 'float') and isfinite(try_cast(value as double)) then try_cast(value as double) end"
    return f"""r1 as (select *, row_number() over (partition by cluster_key, name, value order by obs_id) as seen, {finite} as x from par),
r2 as (select *, {at("sum((seen = 1)::int)")} as d from r1),
r3 as (select *, case when max(case when seen = 1 then d end) over (partition by cluster_key, name, value) <= 5000 then seen end as vc from r2),
r4 as (select *, least(d, 5000) as cardinality, {at("count(*)")} as total, {at("count(*)", "vc = 3")} as est, coalesce({at("sum(case when vc = 3 then 3 else 1 end)", "vc >= 3")}, 0) as estn,
  {at("count(x)")} as num_count, {at("min(x)")} as num_min, {at("max(x)")} as num_max, {at("count(*)", "type = 'date'")} as dates, {at("count(*)", "type = 'integer'")} as integers, {at("count(*)", "type = 'float'")} as floats, [{counts}] as cs from r3),
r5 as (select *, list_min(cs)[2] as dominant, list_min(list_filter(cs, lambda c: c[1] < 0 and c[2] <> 'date'))[2] as undated from r4),
rp as (select *, {_LADDER} as ptype from r5)"""


_RUNNING = """s1 as (select *, count(*) over w as tot, count(*) filter (type <> 'literal') over w as var, row_number() over (partition by host, scope, locator, value order by obs_id) as seen from seg window w as (partition by host, scope, locator order by obs_id)),
s2 as (select *, sum((seen = 1)::int) over (partition by host, scope, locator order by obs_id) as d from s1),
s3 as (select *, least(d, 5000) as card, case when max(case when seen = 1 then d end) over (partition by host, scope, locator, value) <= 5000 then seen end as vc from s2),
ev as (select *, coalesce(vc, 0) / tot::double as vf from s3)"""
_CLUSTERS = "select cluster_key, min(khost) as host, min(scheme) as scheme, min(case when kind = 'url' then shape else cluster_key end) as shape, count(*) as n, min(obs_id) as ord from keyed group by cluster_key"
_SEGSTATS = "select cluster_key, pos, count(*) as distinct_values, count(*) = 1 as stable, string_agg(value, ',' order by n desc, value) filter (r <= 5000) as values from (select *, row_number() over (partition by cluster_key, pos order by n desc, value) as r from (select cluster_key, pos, value, count(*) as n from seg group by all)) group by cluster_key, pos"


def r(x: str, k: int) -> str:
    return f"floor(({x}) * 1e{k} + 0.5) / 1e{k}"


#: Fields of ``parse_fields`` of the texts that mostly are no URLs.
_BROKEN_FIELDS = f"select obs_id, case when error is null then 'url' end, case when error is null then regexp_extract(t, '^[a-z]+') end, case when error is null then regexp_extract(t, '^[a-z]+://([^/?#]+?)(?::[0-9]+)?/', 1) end, case when error is null then try_cast(regexp_extract(t, '[^/]:([0-9]+)/', 1) as bigint) end, case when error is null then 1 end, null, null, error from ({_ERRORS})"
SQL: dict[str, str] = {
    "routes": base("pages") + " select khost as host, shape, count(*) as n from keyed group by all",
    "parse_fields": f"select * from ({base('mixed')} select obs_id, kind, scheme, host, port, len(segs)::bigint as n_segments, fragment, nss, cast(null as varchar) as error from iri)"
    + f" union all {_BROKEN_FIELDS}",
    "canonical": base("mixed") + " select obs_id, canonical from canon",
    "distinct_identifiers": base("mixed") + " select canonical, count(*) as n from canon group by all",
    "path_segments": base("pages") + " select obs_id, pos, value from part",
    "query_params": base("pages_repeats") + " select obs_id, name, value from (select *, row_number() over (partition by obs_id, name order by i desc) as r from (select obs_id, i, split_part(xs[i], '=', 1) as name, case when contains(xs[i], '=') then substr(xs[i], strpos(xs[i], '=') + 1) end as value from (select obs_id, string_split(query, '&') as xs from iri where kind = 'url' and coalesce(query, '') <> '') as q, unnest(range(1, len(xs) + 1)) as g(i)) where name <> '') where r = 1",
    "classify_segments": f"select value, type, type <> 'literal' as variable, {_display('type')} as display from (select value, {sql_type('value')} as type from ("
    + " union ".join(f"({base(x)} select value from seg)" for x in ("pages", "orders", "customers"))
    + "))",
    "classify_params": f"select *, {sql_name_hint('name', 'type')} as hint from (({base('events')} select name, value, type from par) union ({base('pages')} select name, value, type from par))",
    "file_kind": base("pages") + f" select distinct value, {sql_kind('value')} as kind from seg where type = 'file'",
    "canonical_date": f"select o_orderkey, value, {sql_date('value')} as canonical from (select o_orderkey, {_DATES} as value from orders)",
    "canonical_currency": f"select p_partkey, value, {sql_currency('value')} as canonical from (select p_partkey, ['usd', 'EUR', 'abc', 'Jpy', 'euros'][p_partkey % 5 + 1] as value from part)",
    "registrable_domain": f"select host, {sql_registrable('host')} as registrable from (select distinct host from ({base('pages')} select host from iri) union all select unnest([{', '.join(map(_q, HOSTS))}]))",
    "singularize": f"select word, {sql_singular('word')} as singular from (select unnest([{', '.join(map(_q, WORDS))}]) as word union select value from ({base('events')} select value from seg where type = 'literal'))",
    "hinted_shape": base("orders") + " select obs_id, shape, cluster_key from keyed",
    "raw_shape": base("orders") + " select obs_id, raw_shape from keyed",
    "locators": base("orders") + " select obs_id, pos, locator from seg",
    "normalize": base("orders") + f", st as (select obs_id, pos, coalesce({_canon('type', 'value')}, hinted_token) as token from seg), pa as (select obs_id, name, {_rendered('name', 'value', 'type')} as token from par) " + _render("st", "pa"),
    "normalize_nohints": base("events") + f", st as (select obs_id, pos, coalesce({_canon('type', 'value')}, raw_token) as token from seg), pa as (select obs_id, name, {_rendered('name', 'value', 'type')} as token from par) " + _render("st", "pa"),
    "normalize_urn": base("urns") + " select k.obs_id, case when k.scheme = 'urn' then 'urn:' || split_part(k.nss, ':', 1) || ':' || t.hinted_token else k.canonical end as normalized from keyed k left join tok t on t.obs_id = k.obs_id and t.pos = 1",
    "explain": base("events") + " select obs_id, pos, value, type, type <> 'literal' as variable, hint from tok",
    "trace_notes": base("notes") + f""", up as (select *, {sql_name_hint('name', 'type')} as lift from par), fin as (select *, coalesce(lift, type) as t2 from up), shown as (select *, {_canon('t2', 'value')} as form from fin),
outp as (select *, coalesce(form, case when t2 <> 'literal' then {_place('t2')} end, value) as output from shown)
select obs_id, name, t2 as type, output, 'param-name hint (`' || name || '=`) lifted ' || type || ' → ' || lift as note from outp where lift is not null
union all select obs_id, name, t2, output, case t2 when 'date' then 'canonical date' else 'currency upcase' end || ' (' || value || ' → ' || form || ')' from outp where form is not null and form <> value""",
    "trace_evidence": base("orders") + f" select obs_id, 'segment' as subject_kind, pos::varchar as subject, 'classifier' as source, type from seg union all select obs_id, 'param', name, 'classifier', coalesce({sql_name_hint('name', 'type')}, type) from par",
    "extract_urls": base("odd") + " select obs_id // 64 as page_id, (obs_id % 64)::int as pos, canonical from canon",
    "extract_strings": base("odd") + " select page_id, string_agg(canonical, ' ' order by p) as urls from (select obs_id // 64 as page_id, canonical, min(obs_id) as p from canon group by all) group by page_id",
    "url_list": base("odd") + " select canonical, count(*) as n from canon group by all",
    "host_counts": base("mixed") + " select khost as host, count(*) as n from keyed group by all",
    "path_length_counts": base("mixed") + " select length::bigint as length, count(*) as n from keyed group by all",
    "raw_shape_counts": base("mixed") + " select raw_shape, count(*) as n from keyed group by all",
    "fingerprint_counts": base("lineitem") + " select shape, count(*) as n from keyed group by all",
    "position_totals": base("events") + " select host, scope, locator, count(*) as total from seg group by all",
    "position_values_capped": base("orders") + " select host, scope, locator, value, n, first_obs from (select *, row_number() over (partition by host, scope, locator order by first_obs) as r from (select host, scope, locator, value, count(*) as n, min(obs_id) as first_obs from seg group by all)) where r <= 5000",
    "position_values": base("orders") + " select host, scope, locator, value, n, first_obs from (select *, row_number() over (partition by host, scope, locator order by first_obs) as r from (select host, scope, locator, value, count(*) as n, min(obs_id) as first_obs from seg group by all)) where r <= 5000",
    "position_types": base("customers") + " select host, scope, locator, type, count(*) as n from seg group by all",
    "dominant_type": base("customers") + " select host, scope, locator, arg_min(type, (-n, type)) as dominant, sum(n)::bigint as total from (select host, scope, locator, type, count(*) as n from seg group by all) group by host, scope, locator",
    "clusters": base("mixed") + " " + _CLUSTERS,
    "cluster_examples": base("events") + " select cluster_key, canonical, first_obs from (select *, row_number() over (partition by cluster_key order by first_obs) as r from (select cluster_key, canonical, min(obs_id) as first_obs from keyed group by all)) where r <= 10",
    "cluster_segments": base("pages") + " select cluster_key, pos, value, count(*) as n from seg group by all",
    "segment_stats": base("pages") + " " + _SEGSTATS,
    "cluster_params": base("lineitem") + " select cluster_key, name, count(*) as total from par group by all",
    "cluster_param_values": base("events") + " select cluster_key, name, value, n, first_obs from (select *, row_number() over (partition by cluster_key, name order by first_obs) as r from (select cluster_key, name, value, count(*) as n, min(obs_id) as first_obs from par group by all)) where r <= 5000",
    "cluster_param_values_full": base("events") + f", {_PV} select * from pv",
    "cluster_param_types": base("lineitem") + f", {_PT} select * from pt",
    "param_numeric": base("lineitem") + f", {_NUM} select cluster_key, name, num_count, num_min, num_max, {r('num_avg', 4)} as num_avg from num",
    "stats_top10": base("mixed") + """ select 'observations' as section, '' as key, count(*) as n from keyed union all select 'clusters', '', count(distinct cluster_key) from keyed
union all (select 'hosts', khost, count(*) as n from keyed group by khost order by n desc, khost limit 10) union all (select 'shapes', shape, count(*) as n from keyed group by shape order by n desc, shape limit 10) union all (select 'raw_shapes', raw_shape, count(*) as n from keyed group by raw_shape order by n desc, raw_shape limit 10)""",
    "param_type_ladder": " union all ".join(f"({base(x)}, {_PS} select cluster_key, name, total, cardinality, ptype as type from ps)" for x in ("events", "lineitem", "orders")),
    "param_summary": base("events") + f", {_PS} select cluster_key, name, ptype as type, total, {r('total / n::double', 4)} as presence, cardinality, {r('total / (total + 15)::double', 2)} as confidence, case when ptype in ('integer', 'float', 'number', 'year', 'http_status') then num_min end as num_min, case when ptype in ('integer', 'float', 'number', 'year', 'http_status') then num_max end as num_max, case when ptype in ('integer', 'float', 'number', 'year', 'http_status') then {r('num_avg', 4)} end as num_avg from ps join ({_CLUSTERS}) using (cluster_key)",
    "enum_members": base("lineitem") + f", {_PS} select cluster_key, name, string_agg(value, ',' order by n desc, value) as members from pv join ps using (cluster_key, name) where ptype = 'enum' and n >= 3 group by all",
    "value_distribution": base("lineitem") + f", {_PS} select cluster_key, name, value, {r('n / total::double', 4)} as share from pv join ps using (cluster_key, name) where ptype in ('enum', 'boolean')",
    "subtype_distribution": base("lineitem") + f", {_PS} select cluster_key, name, {r('integers / total::double', 4)} as integer_share, {r('floats / total::double', 4)} as float_share from ps where ptype = 'number'",
    "kind_distribution": base("files") + f", {_PS} select cluster_key, name, kind, {r('k / sum(k) over (partition by cluster_key, name)::double', 4)} as share from (select cluster_key, name, {sql_kind('value')} as kind, sum(n) as k from pv join ps using (cluster_key, name) where ptype = 'file' group by all)",
    "params_for": base("events") + f", {_PS} select cluster_key, name, ptype as type, total, cardinality, {r('total / (total + 15)::double', 2)} as confidence from ps where cluster_key in (select cluster_key from keyed)",
    "params_for_log": base("events") + f", {_PS} select cluster_key, name, ptype as type, total, cardinality, {r('total / (total + 15)::double', 2)} as confidence from ps where cluster_key in (select cluster_key from keyed)",
    "cluster_assembly": base("pages") + f""", {_PS}, cl as ({_CLUSTERS}), ss as ({_SEGSTATS}),
ex as (select cluster_key, string_agg(canonical, ' ' order by first_obs) as examples from (select *, row_number() over (partition by cluster_key order by first_obs) as r from (select cluster_key, canonical, min(obs_id) as first_obs from keyed group by all)) where r <= 10 group by cluster_key),
sg as (select cluster_key, string_agg(pos || ':' || values, ' ' order by pos) as segments from ss group by cluster_key), pp as (select cluster_key, string_agg(name || ':' || ptype, ' ' order by total desc, name) as params from ps group by cluster_key)
select cluster_key, n, ord, examples, segments, params from cl left join ex using (cluster_key) left join sg using (cluster_key) left join pp using (cluster_key)""",
    "corpus_explain": base("orders") + f", {_EV} select obs_id, pos, value, type, {_verdict()} as verdict from ev",
    "corpus_normalize": base("orders_workspaces") + f", {_EV}, {_PS}, ve as (select *, {_verdict()} as verdict from ev), st as (select obs_id, pos, {_INFORMED} as token from ve), pa as (select par.obs_id, name, {_PARAM_INFORMED} as token from par join ps using (cluster_key, name)) " + _render("st", "pa"),
    "running_normalize": base("orders") + f", {_RUNNING}, {_running_params()}, ve as (select *, {_verdict()} as verdict from ev), st as (select obs_id, pos, {_INFORMED} as token from ve), pa as (select obs_id, name, {_PARAM_INFORMED} as token from rp) " + _render("st", "pa"),
    "explain_stability": base("pages") + f", ss as ({_SEGSTATS}) select s.obs_id, s.pos, s.value, s.type, not ss.stable and s.type <> 'literal' as variable from seg s join ss using (cluster_key, pos)",
    "proposals": base("customers") + f""", v as (select host, scope, locator, value, n from (select *, row_number() over (partition by host, scope, locator order by first_obs) as r from (select host, scope, locator, value, count(*) as n, min(obs_id) as first_obs from seg group by all)) where r <= 5000), t as (select host, scope, locator, arg_min(type, (-n, type)) as dominant, sum(n) as total from (select host, scope, locator, type, count(*) as n from seg group by all) group by all),
c as (select regexp_extract(value, '^([a-z]+)_([A-Za-z0-9]+)\\z', 1) || '_' as prefix, v.*, t.total from v join t using (host, scope, locator) where dominant in ('slug', 'opaque_id') and regexp_matches(value, '^([a-z]+)_([A-Za-z0-9]+)\\z')),
b as (select prefix, host, scope, locator, sum(n) as matching, max(total) as total from c group by all), p as (select prefix, sum(matching)::bigint as matching, sum(total)::bigint as observations, count(distinct host) as hosts from b group by prefix),
s as (select prefix, string_agg(value, ',' order by value) as samples from (select prefix, value, row_number() over (partition by prefix order by value) as r from c) where r <= 5 group by prefix)
select prefix, rtrim(prefix, '_') as type, matching, observations, hosts, {r('matching / observations::double', 4)} as coverage, {r('least(1.0, matching / observations::double + 0.05 * (hosts - 1))', 4)} as confidence, samples from p join s using (prefix) where matching >= 20 and matching / observations::double >= 0.7""",
    "cross_host_shapes": base("events") + " select shape, string_agg(distinct khost, ',' order by khost) as hosts, count(distinct khost) as n_hosts, count(*) as observations from keyed where khost <> '' group by shape having count(distinct khost) >= 2",
    "host_strategy_registrable": base("events", "registrable") + " " + _CLUSTERS,
    "host_strategy_none": base("pages", "none") + " " + _CLUSTERS,
    "union_of_logs": base("pages_orders") + " select khost as host, count(*) as n from keyed group by all",
}
# Which prefixes are activated is decided by the proposals.
SQL["activate_reinfer"] = base("customers", learned=f"select prefix, type from ({SQL['proposals']}) where confidence >= 0.9") + " select shape, count(*) as n from keyed group by all"
SQL["running_normalize_carried"] = SQL["running_normalize"]


def _all_views() -> str:
    first = "row_number() over (partition by {0} order by first_obs) as r"
    views = {
        "host_counts": ("select khost, count(*) as n from keyed group by all", "n"),
        "path_length_counts": ("select length, count(*) as n from keyed group by all", "n"),
        "raw_shape_counts": ("select raw_shape, count(*) as n from keyed group by all", "n"),
        "fingerprint_counts": ("select shape, count(*) as n from keyed group by all", "n"),
        "position_totals": ("select host, scope, locator, count(*) as n from seg group by all", "n"),
        "position_values": (f"select n from (select *, {first.format('host, scope, locator')} from (select host, scope, locator, value, count(*) as n, min(obs_id) as first_obs from seg group by all)) where r <= {L.VALUE_CAP}", "n"),
        "position_types": ("select host, scope, locator, type, count(*) as n from seg group by all", "n"),
        "clusters": ("select cluster_key, count(*) as n from keyed group by all", "n"),
        "cluster_examples": (f"select first_obs from (select *, {first.format('cluster_key')} from (select cluster_key, canonical, min(obs_id) as first_obs from keyed group by all)) where r <= {L.EXAMPLE_CAP}", "first_obs"),
        "cluster_segments": ("select cluster_key, pos, value, count(*) as n from seg group by all", "n"),
        "cluster_params": ("select cluster_key, name, count(*) as n from par group by all", "n"),
        "cluster_param_values": (f"select n from (select *, {first.format('cluster_key, name')} from (select cluster_key, name, value, count(*) as n, min(obs_id) as first_obs from par group by all)) where r <= {L.VALUE_CAP}", "n"),
        "cluster_param_types": ("select cluster_key, name, type, count(*) as n from par group by all", "n"),
        "cluster_param_numeric": ("select num_count as n from num", "n"),
    }
    return base("events") + f", {_NUM} " + " union all ".join(f"select '{k}' as view, count(*) as n_rows, coalesce(sum({n}), 0)::bigint as total from ({q})" for k, (q, n) in views.items())


SQL["merged_views"] = _all_views()
SQL["corpus_log"] = f"""with b as ({_ERRORS}), a as ({base('pages')} select obs_id * 2 as obs_id, canonical as url from canon)
select row_number() over (order by obs_id) as obs_id, url from (select * from a union all select (obs_id - 2) // 2 + 1, t from b where error is null)"""
SQL["corpus_views"] = base("events") + " select cluster_key, pos, value, count(*) as n from seg group by all"
SQL["corpus_lookup"] = f"select canonical as url, normalized from ({SQL['corpus_normalize'].replace(LOGS['orders_workspaces'], LOGS['orders'])}) join ({base('orders')} select obs_id, canonical from canon) using (obs_id)"
_OWN_PORTS = " or ".join(f"(s = '{k}' and p = {v})" for k, v in L.DEFAULT_PORTS.items())
SQL["hosts_and_ports"] = f"""select obs_id, s as scheme, h as host, case when not ({_OWN_PORTS}) then p end as port, s || '://' || h || case when not ({_OWN_PORTS}) then ':' || p else '' end || '/A/' || obs_id as canonical from (
select p_partkey as obs_id, ['http', 'https', 'ftp', 'ws', 'wss'][p_partkey % 5 + 1] as s, ['shop.example.com', 'm\u00fcnchen.de', '\u0142\u00f3d\u017a.pl', '\u043f\u0440\u0438\u043c\u0435\u0440.\u0440\u0444', '\u4f8b\u3048.jp', 'localhost'][p_partkey % 6 + 1] as h, cast([80, 443, 21, 8080, 80, 0][(p_partkey % 36) // 6 + 1] as bigint) as p from part)"""
SQL["sql_segments"] = f"""{base('pages')}, pair as (select *, {sql_type("coalesce(value, '')")} as type from ({SQL['query_params'].replace(LOGS['pages_repeats'], LOGS['pages'])}) as q)
select obs_id, pos, null as name, value, type from seg union all select obs_id, null, name, value, type from pair"""
SQL["sql_extraction"] = SQL["extract_urls"]
SQL["sql_parts"] = f"""select * from ({base('mixed')} select obs_id, kind, scheme, host, port, canonical, null as error from canon)
union all select obs_id, kind, scheme, host, port, case when error is null then scheme || '://' || host || coalesce(':' || port, '') || regexp_extract(t, '^[a-z]+://[^/]*(/.*)$', 1) end, error from ({_BROKEN_FIELDS.replace(" from (", ", t from (", 1)}) as p(obs_id, kind, scheme, host, port, n, f, s, error, t)
union all select obs_id * 4 + 3, 'url', scheme, host, port, canonical, null from ({SQL['hosts_and_ports']})"""
