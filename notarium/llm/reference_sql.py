"""What queries of the subpackage must give, as brute-force SQL over whole tables for another engine."""

from __future__ import annotations

_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


def _pairs(field: str, table: str, key: str, column: str, shingles: str, least: int) -> str:
    return f"""{field}w as (select distinct {key} id, {_WORDS.format(column)} ws from {table} where {column} is not null),
{field}s as (select distinct id, {shingles} sh from {field}w where len(ws) >= {least}),
{field}n as (select id, count(*) n from {field}s group by 1),
{field}x as (select a.id a, b.id b, count(*) k from {field}s a join {field}s b on a.sh = b.sh and a.id < b.id group by 1, 2),
{field}p as (select '{field}' field, a id_a, b id_b from {field}x join {field}n na on na.id = a join {field}n nb on nb.id = b where k * 2 >= na.n + nb.n - k)"""


def _size(column: str) -> str:
    lf = f"replace({column}, E'\\r\\n', E'\\n')"
    return f"length(regexp_replace(regexp_replace({lf}, '^(?: *\\n)+', ''), '(?:\\n *)+$', ''))"


_SIMILAR = (
    _pairs("body", "chunks", "chunk_id", "body", "unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))", 40)
    + ", "
    + _pairs("title", "notes", "note_id", "title", "unnest(list_transform(range(1, length(array_to_string(ws, ' ')) - 1), lambda i: array_to_string(ws, ' ')[i:i + 2]))", 1)
)
_COUNTED = """with p as (select distinct term, chunk_id, tf from postings where term is not null and chunk_id in (select chunk_id from chunks)), n as (select distinct on (note_id) note_id, meta from notes),
e as (select note_id, unnest(map_entries(meta)) e from n), m as (select 'meta.' || e.key field, note_id, unnest(e.value) v from e where e.key not in ('title', 'date', 'created', 'updated', 'aliases')),
u as (select 'term' field, term val, sum(tf)::bigint n_total, count(distinct chunk_id) n_records, (select count(distinct chunk_id) from chunks) n_all from p group by 2
  union all select field, lower(trim(v)), count(*), count(distinct note_id), (select count(*) from n) from m where v is not null group by 1, 2)
select * exclude (n_all) from (select *, case when n_records < 3 then 'rare' when n_records > 0.1 * n_all then 'common' end mark from u)"""

SQL = {
    "p1_found": f"with {_SIMILAR} select * from bodyp union all select * from titlep",
    "p1_groups": f"""with recursive {_SIMILAR}, edges as (select field, id_a a, id_b b from (select * from bodyp union all select * from titlep)), sym as (select field, a, b from edges union all select field, b, a from edges),
reach(field, id, root) as (select 'body', id, id from bodyn union all select 'title', id, id from titlen union select r.field, b, root from reach r join sym on sym.field = r.field and a = r.id)
select field, id, min(root) group_id from reach group by all""",
    "p3_found": f"select 'section' item, section_id item_id from sections where {_size('body')} > 2000 group by 2 union all select 'chunk', chunk_id from chunks where {_size('body')} > 2000 group by 2",
    "p5_counts": _COUNTED,
    "p5_found": f"{_COUNTED} where mark is not null",
    "p6_found": f"""with d as (select doc_id, {_WORDS.format("text")} ws from documents where text is not null), i as (select item_id, {_WORDS.format("text")} ws from eval_items where text is not null),
x as (select doc_id, unnest(list_transform(range(1, len(ws) - 11), lambda k: array_to_string(ws[k:k + 12], ' '))) g from d), y as (select item_id, unnest(list_transform(range(1, len(ws) - 11), lambda k: array_to_string(ws[k:k + 12], ' '))) g from i)
select distinct doc_id, item_id from x join y using (g)""",
}
