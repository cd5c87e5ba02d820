"""What the core's queries must give, as SQL over the same tables for another engine.

Written independently of the operators: windows, lists and recursion instead of
the Arrow stages and array functions.
"""

from __future__ import annotations

from notarium.functions.text import EN_ENDINGS, RU_ENDINGS

_WS = r"[\p{Z}\s\x0B\x85]+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_q, words)) + "]" if words else "[]::varchar[]"


def low(x: str) -> str:
    return f"lower(translate({x}, 'İΣ', 'iσ'))"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"


def camel(x: str) -> str:
    for a, b in ((r"(\p{Ll})(\p{Lu})", r"\1|\2"), (r"(\p{Lu})(\p{Lu}\p{Ll})", r"\1|\2"), (r"(\p{Nd})(\P{Nd})", r"\1|\2"), (r"(\P{Nd})(\p{Nd})", r"\1|\2")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


def stem(w: str) -> str:
    endings = f"case when regexp_matches({w}, '^[а-яё]') then {_list(RU_ENDINGS)} else {_list(EN_ENDINGS)} end"
    return f"case when length({w}) < 5 then {w} else substr({w}, 1, length({w}) - coalesce(length(list_filter({endings}, lambda e: ends_with({w}, e) and length({w}) - length(e) >= 4)[1]), 0)) end"


_CHUNKS = "c as (select distinct chunk_id, path, ord, breadcrumb, line, body from chunks)"
_NOTES = "n as (select distinct on (note_id) * from notes)"
_POSTED = "p as (select distinct term, chunk_id, tf from postings where chunk_id in (select chunk_id from chunks))"
_RAW = r"regexp_extract_all(body, '[\p{L}\p{Nd}_]+')"
_VOCABULARY = f"v as (select distinct unnest({_RAW}) token from chunks)"
_HEX = "'^0[xX][0-9a-fA-F]+$'"
_EXPANDED = f"""
v0 as (select token, {low("token")} lw, regexp_matches(token, {_HEX}) hex from v),
p1 as (select token, lw, unnest(string_split(token, '_')) part from v0 where not hex),
p2 as (select token, lw, unnest(string_split({camel("part")}, '|')) w from p1 where part <> ''),
forms as (select token, lw f from v0 where not hex union select token, {low("w")} from p2 where length({low("w")}) > 1 and {low("w")} <> lw),
x as (select token, f term from forms union select token, {stem("f")} from forms
  union select token, f[1:6] from forms where length(f) >= 8 and not regexp_matches(f, '\\p{{Nd}}')
  union select token, lw from v0 where hex union select token, substr(lw, 3) from v0 where hex)"""

# --- dates and metadata ---


def day(v: str) -> str:
    """Microseconds of one date value."""
    t = trim(v)
    return f"""case when regexp_matches({t}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') then epoch_us(try_strptime({t}, '%Y-%m-%d'))
  when regexp_matches({t}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?(Z|[+-]\\d{{2}}:\\d{{2}})$') then epoch_us(try_cast({t} as timestamptz))
  when regexp_matches({t}, '^\\d{{4}}/\\d{{2}}/\\d{{2}}$') then epoch_us(try_strptime({t}, '%Y/%m/%d'))
  when regexp_matches({t}, '^\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}$') then epoch_us(try_strptime({t}, '%d.%m.%Y')) end"""


def vals(key: str) -> str:
    return f"coalesce(meta['{key}'], [])"


_AT = f"coalesce(list_filter(list_transform(list_concat(list_concat({vals('date')}, {vals('updated')}), {vals('created')}), lambda v: {day('v')}), lambda u: u is not null)[1], epoch_us(mtime))"
_SINCE = "epoch_us(timestamp '2024-06-01')"
_DATED = f"{_NOTES}, d as (select *, {_AT} at_us from n)"
_FILTER = f"contains(lower(path), 'net/') and len(list_filter({vals('status')}, lambda v: lower({trim('v')}) = 'done')) > 0 and at_us >= {_SINCE}"


def _entries(extra: str = "") -> str:
    return f"{_NOTES}, e as (select path, unnest(map_entries(meta)) e from n), f as (select path, e.key field, e.value vs from e where len(coalesce(e.value, [])) > 0), present as (select field, count(*) present from f group by 1), counts as (select field, v as value, count(*) n from (select field, unnest(vs) v from f) group by 1, 2)"


def _facets(chosen: str) -> str:
    return f"""with {_entries()}, chosen as ({chosen})
select field_rank::int field_rank, field, row_number() over (partition by field order by n desc, value)::int value_rank, value, n from counts join chosen using (field)
union all select field_rank::int, field, 2147483647, '(not set)', (select count(*) from n) - present from chosen where (select count(*) from n) > present"""


_FACET_COUNTS = _facets("select field, present, row_number() over (order by present desc, field) field_rank from present where present > 1 and field not in ('title', 'date', 'created', 'updated', 'aliases') and (select count(*) from counts where counts.field = present.field) <= 200")

# --- refreshing ---

_SEEN = "o as (select distinct g.path, coalesce(sum_hash, hash, 'gone') old from crawl_log g left join n using (path) where g.path is not null)"
_CHANGED = f"{_NOTES}, {_SEEN}, ch as (select coalesce(n.path, o.path) path, case when o.path is null then 'added' when n.path is null then 'removed' when old <> hash then 'updated' else 'unchanged' end change from n full outer join o using (path))"
#: dn: the documents, which are new notes; s: paths with sections; kept: notes that stay as they are; gone: notes that nobody crawled.
_REFRESH = f"""dn as (select doc_id, path, sha256(coalesce(text, ''))[:16] hash from documents), s as (select path, min(section_id) sid from sections where path is not null group by 1),
kept as (select path from n where path not in (select path from s) and path in (select path from crawl_log where path is not null)), gone as (select path from n where path not in (select path from s) and path not in (select path from kept))"""

# --- search ---


#: The queries asked, and what is looked up for each, written out by hand from the rules of tokens and literals.
_ASKED = {
    1: ("page leak under heavy load", "page leak under heavy load"),
    2: ("DropBarrierChunk 0x7C1E22", "dropbarrierchunk drop barrier chunk dropba 0x7c1e22 7c1e22"),
    3: ("гипотеза о работе кэша", "гипотеза гипотез гипоте о работе работ кэша"),
    4: ("retry policy, \"lock order\" replicated handshakes", "retry policy lock order replicated replicat replic handshakes handshak handsh"),
    5: ("stHeaderTokenFSM buffer::ReleaseHeaderToken", "stheadertokenfsm st header token fsm sthead buffer releaseheadertoken release releas"),
    6: ("...", ""),
}
_LITERALS = (
    (1, 0, "page leak under heavy load", "page leak under heavy load"),
    (2, 0, "DropBarrierChunk 0x7C1E22", "dropbarrierchunk drop barrier chunk dropba 0x7c1e22 7c1e22"),
    (2, 1, "DropBarrierChunk", "dropbarrierchunk drop barrier chunk dropba"),
    (2, 2, "0x7C1E22", "0x7c1e22 7c1e22"),
    (3, 0, "гипотеза о работе кэша", "гипотеза гипотез гипоте о работе работ кэша"),
    (3, 1, "гипотеза", "гипотеза гипотез гипоте"),
    (3, 2, "работе", "работе работ"),
    (3, 3, "кэша", "кэша"),
    (4, 0, "retry policy, \"lock order\" replicated handshakes", "retry policy lock order replicated replicat replic handshakes handshak handsh"),
    (4, 1, "policy", "policy"),
    (4, 2, "replicated", "replicated replicat replic"),
    (4, 3, "handshakes", "handshakes handshak handsh"),
    (5, 0, "stHeaderTokenFSM buffer::ReleaseHeaderToken", "stheadertokenfsm st header token fsm sthead buffer releaseheadertoken release releas"),
    (5, 1, "stHeaderTokenFSM", "stheadertokenfsm st header token fsm sthead"),
    (5, 2, "buffer::ReleaseHeaderToken", "buffer releaseheadertoken release header token releas"),
)


def _asked() -> str:
    rows = ", ".join(f"({q}, {_q(text)}, {_list(toks.split())})" for q, (text, toks) in _ASKED.items())
    return f"asked(query_id, query, toks) as (values {rows}), q as (select query_id, unnest(toks) term, generate_subscripts(toks, 1) pos from asked)"


def _literals() -> str:
    rows = ", ".join(f"({q}, {i}, {_q(lit)}, {_list(toks.split())})" for q, i, lit, toks in _LITERALS)
    return f"lits(query_id, n, lit, toks) as (values {rows}), lt as (select query_id, n, lit, unnest(toks) term, generate_subscripts(toks, 1) pos from lits)"


def _count(hay: str, needle: str) -> str:
    h, x = low(f"coalesce({hay}, '')"), low(needle)
    return f"(length({h}) - length(replace({h}, {x}, ''))) // length({x})"


def _lists(condition: str) -> str:
    return f"""{_DATED}, {_CHUNKS}, {_POSTED}, {_asked()}, {_literals()},
live as (select chunk_id from c where path in (select path from d where {condition})),
df as (select term, count(*) df from p group by 1), dl as (select chunk_id, sum(tf) len from p group by 1),
st as (select (select count(*) from c) n, (select sum(tf) from p) / (select count(*) from c) avg_len),
bm as (select query_id, chunk_id, round(sum(ln(1 + (st.n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) score
  from q join p using (term) join df using (term) join dl using (chunk_id) join live using (chunk_id), st group by all),
best as (select query_id, n, lit, arg_min(term, (coalesce(df, 0), pos)) token from lt left join df using (term) group by all having count(df) = count(*)),
li as (select query_id, chunk_id, sum(k * strlen(lit))::double score from (select query_id, chunk_id, lit, {_count("body", "lit")} + {_count("breadcrumb", "lit")} + {_count("path", "lit")} k
  from best join p on p.term = best.token join live using (chunk_id) join c using (chunk_id)) where k > 0 group by all),
rb as (select *, row_number() over (partition by query_id order by score desc, chunk_id) r from bm),
rl as (select *, row_number() over (partition by query_id order by score desc, chunk_id) r from li)"""


def _fused(condition: str, k: int) -> str:
    flat = f"trim(regexp_replace(coalesce(body, ''), '{_WS}', ' ', 'g'))"
    return f"""with {_lists(condition)},
fu as (select query_id, chunk_id, coalesce(1.0::double / (60 + rb.r), 0) + coalesce(1.0::double / (60 + rl.r), 0) score, rl.r is not null exact from rb full outer join rl using (query_id, chunk_id)),
rk as (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int "rank" from fu qualify "rank" <= {k}),
s0 as (select rk.*, c.path, c.line, title, breadcrumb, body, query, toks, {flat} flat from rk join c using (chunk_id) left join d on d.path = c.path join asked using (query_id)),
s1 as (select *, case when instr({low("flat")}, {low("trim(query)")}) > 0 then instr({low("flat")}, {low("trim(query)")}) else coalesce(list_filter(list_transform(toks, lambda t: instr({low("flat")}, t)), lambda p: p > 0)[1], 1) end hit from s0),
s2 as (select *, greatest(hit - 61, 0) a, least(greatest(hit - 61, 0) + 260, length(flat)) b from s1)
select query_id::bigint query_id, "rank", path, line, title, breadcrumb, round(score, 9) score, exact, case when a > 0 then '…' else '' end || {trim("substr(flat, a + 1, b - a)")} || case when b < length(flat) then '…' else '' end snippet, length(body)::int n_chars from s2"""


# --- notes taken apart ---

_LINES = f"""
docs as (select distinct doc_id, path, text from documents),
l0 as (select doc_id, string_split(replace(text, E'\\r\\n', E'\\n'), E'\\n') ls from docs),
l1 as (select doc_id, unnest(ls) s, generate_subscripts(ls, 1) - 1 i from l0),
l2 as (select doc_id, s, i, {trim("s")} t from l1),
opened as (select doc_id from l2 where i = 0 and t = '---'),
fm as (select doc_id, min(i) close from l2 join opened using (doc_id) where i > 0 and t = '---' group by 1),
head as (select l2.* from l2 join fm using (doc_id) where i > 0 and i < close and t <> '' and t[1] <> '#'),
ln as (select doc_id, s, t, i, i - coalesce(close + 1, 0) b, coalesce(close + 1, 0) start from l2 left join fm using (doc_id) where i >= coalesce(close + 1, 0)),
keyed as (select *, not starts_with(t, '- ') and strpos(t, ':') > 1 is_key from head),
run as (select *, sum(is_key::int) over (partition by doc_id order by i) kid from keyed),
keys as (select doc_id, kid, lower({trim("t[:strpos(t, ':') - 1]")}) key, {trim("t[strpos(t, ':') + 1:]")} val from run where is_key qualify row_number() over (partition by doc_id, lower({trim("t[:strpos(t, ':') - 1]")}) order by i desc) = 1)"""


def _bare(x: str) -> str:
    t = trim(x)
    return f"case when length({t}) > 1 and {t}[1] = {t}[-1] and {t}[1] in ('\"', '''') then {t}[2:length({t}) - 1] else {t} end"


_META = f"""{_LINES},
own as (select doc_id, key, kid, case when val = '' then []::varchar[] when val[1] = '[' and val[-1] = ']' then list_transform(list_filter(string_split(val[2:length(val) - 1], ','), lambda v: {trim("v")} <> ''), lambda v: {_bare("v")}) else [{_bare("val")}] end vs from keys),
items as (select doc_id, kid, list({_bare("t[3:]")} order by i) more from run where not is_key and starts_with(t, '- ') and kid > 0 group by 1, 2),
meta as (select doc_id, key, list_concat(vs, coalesce(more, [])) vs from own left join items using (doc_id, kid))"""

_MARKED = f"""{_META},
marks as (select doc_id, b, t[1:3] mk, row_number() over (partition by doc_id order by b) m from ln where starts_with(t, '```') or starts_with(t, '~~~')),
fences as (select doc_id, m, b, mk open from marks where m = 1 union all
  select k.doc_id, k.m, k.b, case when f.open is null then k.mk when k.mk = f.open then null else f.open end from fences f join marks k on k.doc_id = f.doc_id and k.m = f.m + 1),
within as (select ln.*, f.open is not null or starts_with(t, '```') or starts_with(t, '~~~') code from ln asof left join fences f on ln.doc_id = f.doc_id and ln.b > f.b),
hd as (select *, case when not code and regexp_matches(s, '^#{{1,6}} ') then length(regexp_extract(s, '^#+')) else 0 end level from within),
hx as (select *, case when level > 0 then {trim("regexp_replace(s[level + 2:], '#+$', '')")} end htext, sum((level > 0)::int) over (partition by doc_id order by b) sec from hd),
h1 as (select doc_id, {trim("regexp_replace(s[3:], '#+$', '')")} h from ln where regexp_matches(s, '^# ') qualify row_number() over (partition by doc_id order by b) = 1),
titles as (select doc_id, coalesce(nullif((select vs[1] from meta where meta.doc_id = docs.doc_id and key = 'title'), ''), nullif(h, ''), regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '')) title from docs left join h1 using (doc_id))"""

_TITLES = f"""with recursive {_MARKED},
prose as (select doc_id, b, t from hx where not code and level = 0 and t <> '' and t[1] not in ('|', '>')),
first as (select doc_id, min(b) a from prose group by 1),
stop as (select doc_id, min(b) z from hx join first using (doc_id) where t = '' and not code and b > a group by 1),
leads as (select doc_id, string_agg(t, ' ' order by b) lead from prose left join stop using (doc_id) where b < coalesce(z, 1e9) group by 1)
select doc_id, title, case when length(coalesce(lead, '')) > 400 then {trim("lead[:400]")} || '…' else coalesce(lead, '') end lead from titles left join leads using (doc_id)"""

_OUTLINE = f"""with recursive {_MARKED}
select doc_id, (row_number() over (partition by doc_id order by b) - 1)::int pos, repeat('  ', level - 1) || htext heading from hx where level > 0"""

_LEVELS = range(1, 7)
_SECTIONS = f"""with recursive {_MARKED},
hs as (select doc_id, b, sec, level, {", ".join(f"max(case when level = {j} then b end) over w l{j}, max(case when level < {j} then b end) over w u{j}" for j in _LEVELS)}
  from hx where level > 0 window w as (partition by doc_id order by b)),
crumbs as (select hs.doc_id, hs.sec, array_to_string(list_filter([{", ".join(f"case when hs.level >= {j} and l{j} > coalesce(u{j}, -1) then x{j}.htext end" for j in _LEVELS)}], lambda v: v is not null and v <> ''), ' > ') crumb
  from hs {" ".join(f"left join hx x{j} on x{j}.doc_id = hs.doc_id and x{j}.b = l{j}" for j in _LEVELS)}),
body as (select doc_id, sec, b, s, t, start from hx where level = 0),
edge as (select doc_id, sec, min(b) a, max(b) z from body where t <> '' group by 1, 2),
rows_ as (select body.*, row_number() over (partition by doc_id, sec order by b) r, lead(t) over (partition by doc_id, sec order by b) nxt from body join edge using (doc_id, sec) where b between a and z),
size as (select doc_id, sec, sum(length(s) + 1) total from rows_ group by 1, 2),
big as (select rows_.* from rows_ join size using (doc_id, sec) where total > 2000),
cutting(doc_id, sec, r, mk, from_r, n, done_from) as (
  select doc_id, sec, 0::bigint, null::varchar, null::bigint, 0::bigint, null::bigint from size where total > 2000
  union all
  select doc_id, sec, r, mk, case when flush then null else from_r end, case when flush then 0 else n end, case when flush then from_r end from (
    select *, from_r is not null and mk is null and (n >= 3000 or (n >= 2000 and (t = '' or coalesce(nxt, '') = ''))) flush from (
      select g.doc_id, g.sec, g.r, g.t, g.nxt,
        case when starts_with(g.t, '```') or starts_with(g.t, '~~~') then case when x.mk is null then g.t[1:3] when starts_with(g.t, x.mk) then null else x.mk end else x.mk end mk,
        case when x.from_r is null and g.t = '' then null else coalesce(x.from_r, g.r) end from_r,
        case when x.from_r is null and g.t = '' then 0 else x.n + length(g.s) + 1 end n
      from cutting x join big g on g.doc_id = x.doc_id and g.sec = x.sec and g.r = x.r + 1))),
last_ as (select doc_id, sec, max(r) r from cutting group by 1, 2),
spans as (select doc_id, sec, done_from a, r z from cutting where done_from is not null union all
  select doc_id, sec, from_r, r from cutting join last_ using (doc_id, sec, r) where from_r is not null),
parts as (select doc_id, sec, a, min(b) b, {trim("string_agg(s, E'\\n' order by b)")} body from spans join rows_ using (doc_id, sec) where r between a and z group by 1, 2, 3
  union all select doc_id, sec, 1, min(b), string_agg(s, E'\\n' order by b) from rows_ join size using (doc_id, sec) where total <= 2000 group by 1, 2)
select parts.doc_id, (row_number() over (partition by parts.doc_id order by parts.sec, a) - 1)::int ord, coalesce(nullif(crumb, ''), title) breadcrumb, (parts.b + start + 1)::int line, length(body)::int n_chars, md5(body) digest
from parts join titles using (doc_id) join (select distinct doc_id, start from ln) using (doc_id) left join crumbs on crumbs.doc_id = parts.doc_id and crumbs.sec = parts.sec"""

# --- timestamps ---

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])[Mm])?"
_TAIL = r"(?:\s*([+-]\d{2}(?::?\d{2})?)(?:\[[^\]]*\])?|\s*([A-Z]{1,4}))?"
_SHAPES = (
    (r"(\d{4})-(\d{1,2})-(\d{1,2})(?:(?:T|\s+)" + _CLOCK + _TAIL + ")?", "ymd"),
    (r"(\d{4})/(\d{1,2})/(\d{1,2})(?:\s+" + _CLOCK + _TAIL + ")?", "ymd"),
    (r"(\d{1,2})\.(\d{1,2})\.(\d{4})(?:\s+" + _CLOCK + _TAIL + ")?", "dmy"),
    (r"(\d{1,2})/(\d{1,2})/(\d{4})(?:\s+" + _CLOCK + _TAIL + ")?", "mdy"),
    (r"([A-Z][a-z]{2}) (\d{1,2}), (\d{4})(?:\s+" + _CLOCK + _TAIL + ")?", "ndy"),
    (r"(?:[A-Z][a-z]{2}, )?(\d{1,2}) ([A-Z][a-z]{2}) (\d{4})(?:\s+" + _CLOCK + _TAIL + ")?", "dny"),
    (r"(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})()()" + _TAIL, "ymd"),
)


def _instants() -> str:
    from notarium.operators.timestamps import ABBREVIATIONS

    names = ["a1", "a2", "a3", "h", "i", "s", "f", "p", "o", "ab"]
    got = []
    for shape, order in _SHAPES:
        at = {c: f"g.a{k + 1}" for k, c in enumerate(order)}
        month = f"lpad({at['m']}, 2, '0')" if "m" in at else f"strftime(try_strptime({at['n']}, '%b'), '%m')"
        got.append(f"select src, row_id, field, raw, zone, {at['y']} y, {month} mo, lpad({at['d']}, 2, '0') d, g.h h, g.i i, g.s s, g.f f, lower(g.p) p, g.o o, g.ab ab from (select *, regexp_extract(x, '^{shape}$', {_list(names)}) g from v where regexp_matches(x, '^{shape}$'))")
    abb = "map {" + ", ".join(f"'{k}': {m}" for k, m in ABBREVIATIONS.items()) + "}"
    minutes = lambda z: f"(case when {z}[1] = '-' then -1 else 1 end * (cast(replace({z}, ':', '')[2:3] as int) * 60 + coalesce(try_cast(replace({z}, ':', '')[4:5] as int), 0)))"
    return f"""with {_NOTES},
m0 as (select note_id, meta, list_filter(coalesce(meta['tz'], []), lambda z: trim(z) <> '')[1] zone, unnest(['date', 'created', 'updated']) field from n),
v0 as (select 'meta' src, note_id row_id, field, unnest(coalesce(meta[field], [])) raw, zone from m0 union all select 'crawl', crawl_id, 'mtime', mtime_raw, host_zone from crawl_log),
v as (select distinct src, row_id, field, raw, coalesce(nullif(trim(zone), ''), 'UTC') zone, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') x from v0 where raw is not null),
parts as ({" union all ".join(got)}),
checked as (select *, case when p in ('a', 'p') then case when try_cast(h as int) between 1 and 12 then cast(h as int) % 12 + case when p = 'p' then 12 else 0 end else 99 end else coalesce(try_cast(h as int), 0) end hh from parts),
loc as (select *, try_strptime(y || '-' || mo || '-' || d || ' ' || lpad(hh::varchar, 2, '0') || ':' || coalesce(nullif(i, ''), '00') || ':' || coalesce(nullif(s, ''), '00'), '%Y-%m-%d %H:%M:%S') wall, coalesce(try_cast(rpad(f[:6], 6, '0') as bigint), 0) us from checked where ab = '' or ab in (select unnest(map_keys({abb})))),
named as (select *, timezone(zone, wall) u from loc where wall is not null and o = '' and ab = '' and not regexp_matches(zone, '^[+-]')),
dated as (
  select src, row_id, field, raw, epoch_us(wall) - {minutes("o")} * 60000000::bigint + us utc_us from loc where wall is not null and o <> ''
  union all select src, row_id, field, raw, epoch_us(wall) - ({abb})[ab] * 60000000::bigint + us from loc where wall is not null and o = '' and ab <> ''
  union all select src, row_id, field, raw, epoch_us(wall) - {minutes("zone")} * 60000000::bigint + us from loc where wall is not null and o = '' and ab = '' and regexp_matches(zone, '^[+-]')
  union all select src, row_id, field, raw, epoch_us(case when timezone(zone, u - interval 1 hour) = wall then u - interval 1 hour else u end) + us from named),
counted as (select src, row_id, field, raw, regexp_extract(x, '^(-?\\d+)', 1)::hugeint k, rpad(coalesce(regexp_extract(x, '\\.(\\d{{1,6}})', 1), ''), 6, '0')::bigint fr from v where regexp_matches(x, '^-?\\d{{1,19}}(\\.\\d+)?$'))
select src, row_id, field, utc_us::bigint utc_us from dated
union all select src, row_id, field, (case when abs(k) < 100000000000 then k * 1000000 + fr when abs(k) < 100000000000000 then k * 1000 when abs(k) < 100000000000000000 then k else k // 1000 end)::bigint from counted"""


def queries() -> dict[str, str]:
    blocks = f"""with {_DATED},
t as (select *, array_to_string(list_filter([case when len({vals("status")}) > 0 then 'status: ' || array_to_string({vals("status")}, ', ') end, case when len({vals("tags")}) > 0 then 'tags: ' || array_to_string({vals("tags")}, ', ') end, strftime(make_timestamp(at_us), '%Y-%m-%d')], lambda v: v is not null and v <> ''), ' · ') tags, coalesce(nullif(summary, ''), lead, '') said, coalesce(headings, []) hs from d where at_us >= {_SINCE})
select case when contains(path, '/') then string_split(path, '/')[1] else '(root)' end "name", at_us date_us, path,
  '### [' || coalesce(title, '') || '](' || path || E')\\n\\n' || case when tags <> '' then '`' || tags || E'`\\n\\n' else '' end || case when said <> '' then said || E'\\n\\n' else '' end
  || case when len(hs) > 0 then array_to_string(list_transform(hs[:3], lambda h: '- ' || h || E'\\n'), '') || case when len(hs) > 3 then '- …' || (len(hs) - 3) || E' more\\n' else '' end || E'\\n' else '' end block from t"""
    return {
        "search_fused": _fused("true", 10),
        "search_filtered": _fused(_FILTER, 5),
        "search_bm25": f'with {_lists("true")} select query_id::bigint query_id, chunk_id, round(score, 6) score, r::int "rank" from rb where r <= 20',
        "search_literal": f'with {_lists("true")} select query_id::bigint query_id, chunk_id, score, r::int "rank" from rl',
        "p4_found": _instants(),
        "tok_raw": f"with {_CHUNKS} select unnest({_RAW}) token, count(*) n from c group by 1",
        "tok_expand": f"with {_VOCABULARY}, {_EXPANDED} select token, term from x",
        "tok_stem": f"with {_VOCABULARY}, w as (select distinct {low('token')} word from v) select word, {stem('word')} stem, case when length(word) >= 8 and not regexp_matches(word, '\\p{{Nd}}') then word[1:6] end prefix_key from w",
        "ident_like": f"with w as (select distinct unnest(list_filter(regexp_split_to_array(regexp_replace(body, '[\\s\\x0B]', ' ', 'g'), '[ ,\"'']'), lambda x: x <> '')) piece from chunks) select piece, regexp_matches(piece, {_HEX}) or regexp_matches(piece, '[_:]') or (regexp_matches(piece, '\\p{{Lu}}') and regexp_matches(piece, '\\p{{Ll}}') and strlen(piece) > 3) ident, regexp_matches(piece, {_HEX}) hex from w",
        "index_postings": f"with {_CHUNKS}, i as (select chunk_id, coalesce(breadcrumb, '') || E'\\n' || coalesce(path, '') || E'\\n' || coalesce(body, '') body from c), r as (select chunk_id, unnest({_RAW}) token from i), v as (select distinct token from r), {_EXPANDED} select term, chunk_id, count(*)::int tf from r join x using (token) group by 1, 2",
        "index_doc_len": f"with {_POSTED} select chunk_id, sum(tf)::int len from p group by 1",
        "index_stats": f"with {_POSTED} select (select count(distinct path) from notes) n_notes, (select count(distinct chunk_id) from chunks) n_chunks, count(distinct term) n_terms, sum(tf)::bigint total_len, round(sum(tf) / (select count(distinct chunk_id) from chunks), 9) avg_len from p",
        "index_idf": f"with {_POSTED}, c as (select count(distinct chunk_id) n from chunks), d as (select term, count(*) df from p group by 1) select term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) idf from d, c",
        "notes_filtered": f"with {_DATED} select note_id, path from d where {_FILTER}",
        "note_date": f"with {_DATED} select note_id, at_us from d",
        "parse_meta": f"with {_META} select doc_id, key, len(vs)::int n, array_to_string(vs, '|') vals from meta",
        "parse_title": _TITLES,
        "parse_outline": _OUTLINE,
        "parse_sections": _SECTIONS,
        "content_hash": "select doc_id, sha256(text)[:16] hash from documents",
        "change_set": f"with {_CHANGED} select path, change from ch",
        "change_counts": f"with {_CHANGED} select count(*) filter (change = 'added') added, count(*) filter (change = 'updated') updated, count(*) filter (change = 'removed') removed from ch",
        "refresh_notes": f"""with recursive {_MARKED}, {_NOTES}, {_REFRESH}
select path, hash, title, null::varchar summary, null::varchar sum_hash from dn join titles using (doc_id)
union all select n.path, 'section ' || s.sid, 'Rewritten', summary, sum_hash from n join s using (path)
union all select path, hash, title, summary, sum_hash from n where path in (select path from kept)""",
        "refresh_chunks": f"""with parsed as ({_SECTIONS}), {_NOTES}, {_CHUNKS}, {_REFRESH},
fresh as (select path, ord from parsed join dn using (doc_id) union all select s.path, 0 from s join n using (path)),
ids as (select path, row_number() over (order by string_split(path, '/'), ord) + (select max(chunk_id) from c) id from fresh)
select path, count(*) n, min(id) first_id, max(id) last_id from (select path, id from ids union all select path, chunk_id from c where path not in (select s.path from s join n using (path)) and path not in (select path from gone)) group by 1""",
        "refresh_counts": f"with {_NOTES}, {_REFRESH} select (select count(*) from dn) added, (select count(*) from s join n using (path)) updated, (select count(*) from gone) removed",
        "crawl_filter": r"select distinct path from crawl_log where lower(regexp_extract(path, '\.[^./]*$')) in ('.md', '.markdown') and not regexp_matches(path, '(^|/)(\.[^/]*|node_modules|vendor|build|dist|obj|bin|target)/') and not contains(path, 'INDEX.md') and not contains(path, 'gone/') and not regexp_matches(path, '[^/]*-quorum-[^/]*$')",
        "facet_counts": _FACET_COUNTS,
        "facet_fields": _facets("select field, present, list_position(['owner', 'tz', 'status'], field) field_rank from present where field in ('owner', 'tz', 'status')"),
        "digest_groups": f"with {_DATED} select coalesce(nullif({vals('status')}[1], ''), '(no status)') \"name\", count(*) n, max(at_us) newest_us from d group by 1",
        "digest_blocks": blocks,
        "digest_document": f"""with b as ({blocks}) select row_number() over (order by "name", date_us desc nulls last, path) pos, case when row_number() over (partition by "name" order by date_us desc nulls last, path) = 1 then '## ' || "name" || E'\\n\\n' else '' end || block text from b""",
        "meta_lines": f"with {_NOTES} select note_id, array_to_string(list_filter([{', '.join(f"case when len({vals(k)}) > 0 then '{k}=' || array_to_string({vals(k)}, ',') end" for k in ('status', 'tags', 'owner'))}], lambda v: v is not null), ' ') line from n",
        "stats_report": f"""with fc as ({_FACET_COUNTS}), {_POSTED}, t as (select (select count(distinct path) from notes) a, (select count(distinct chunk_id) from chunks) b, count(distinct term) c, sum(tf) d from p)
select 0 field_rank, 0 value_rank, 'files ' || a || ' · chunks ' || b || ' · terms ' || c || ' · avg chunk length ' || round(d / b)::bigint || ' tokens' line from t
union all select distinct field_rank, 0, field || ':' from fc
union all select field_rank, value_rank, '  ' || value || repeat(' ', greatest(24 - length(value), 0)) || ' ' || n from fc""",
        "since_dates": "select typed, epoch_us(ts) at_us from (values ('2025-02-28', timestamp '2025-02-28'), ('7d', timestamp '2026-03-24 12:00:00'), ('2w', timestamp '2026-03-17 12:00:00'), ('1m', timestamp '2026-03-03 12:00:00'), ('13m', timestamp '2025-03-03 12:00:00'), ('0d', timestamp '2026-03-31 12:00:00'), ('', null)) v(typed, ts)",
        "summary_first": f"with {_NOTES} select note_id, path from n where sum_hash is distinct from hash order by path limit 25",
        "search_titles": f"""with {_NOTES}, {_CHUNKS}, {_POSTED}, t as (select note_id query_id, unnest(regexp_extract_all(title, '[\\p{{L}}\\p{{Nd}}_]+')) token from n where note_id % 20 = 0), v as (select distinct token from t), {_EXPANDED},
q as (select distinct query_id, term from t join x using (token)), df as (select term, count(*) df from p group by 1), dl as (select chunk_id, sum(tf) len from p group by 1),
st as (select (select count(*) from c) n, (select sum(tf) from p) / (select count(*) from c) avg_len),
bm as (select query_id, chunk_id, round(sum(ln(1 + (st.n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) score
  from q join p using (term) join df using (term) join dl using (chunk_id), st where chunk_id in (select chunk_id from c where path in (select path from n)) group by all)
select query_id, chunk_id, round(score, 6) score, (row_number() over w)::int "rank" from bm window w as (partition by query_id order by score desc, chunk_id) qualify "rank" <= 10""",
        "summary_pending": f"with {_NOTES} select note_id, path from n where sum_hash is distinct from hash",
        "summary_input": f"""with {_NOTES}, {_CHUNKS}, h as (select path, coalesce(title, '') || E'\\n\\n' || coalesce(lead, '') || E'\\n\\n' || array_to_string(coalesce(headings, []), E'\\n') head from n),
k as (select path, chunk_id, E'\\n\\n' || coalesce(breadcrumb, '') || E'\\n' || coalesce(body, '') part from c),
w as (select path, chunk_id, part, strlen(head) + coalesce(sum(strlen(part)) over (partition by path order by chunk_id rows between unbounded preceding and 1 preceding), 0) before from k join h using (path)),
b as (select path, string_agg(part, '' order by chunk_id) body from w where before <= 24000 group by 1)
select path, strlen(head || coalesce(body, ''))::int n_bytes, md5(head || coalesce(body, '')) digest from h left join b using (path)""",
    }
