"""SQL of the tables of nested records: the same rows by JSON functions and a recursive query."""

from __future__ import annotations


def _many(e: str) -> str:
    e = f"({e})"
    return f"case json_type({e}) when 'ARRAY' then json_extract({e}, '$[*]') when 'OBJECT' then [{e}] else [] end"


def _ident(e: str) -> str:
    e = f"({e})"
    return f"coalesce(case when json_type({e}) = 'VARCHAR' then ({e} ->> '$') when json_type({e}) in ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') then {e}::varchar end, '')"


def _piece(e: str) -> str:
    e = f"({e})"
    return f"coalesce(case json_type({e}) when 'OBJECT' then coalesce(({e} ->> '$.value'), ({e} ->> '$.\"#text\"'), ({e} ->> '$.text'), ({e} ->> '$.content')) when 'VARCHAR' then ({e} ->> '$') end, '')"


def _text(e: str) -> str:
    e = f"({e})"
    return f"case when json_type({e}) = 'ARRAY' then coalesce(array_to_string(list_transform(json_extract({e}, '$[*]'), lambda q: {_piece('q')}), ''), '') else {_piece(e)} end"


_NESTED = f"""with recursive docs as (select rec_id, payload::json as j from xliff_records where payload is not null and json_valid(payload)),
roots as (select rec_id, case when json_exists(j, '$.xliff') then (j -> '$.xliff') else j end as r from docs where json_type(j) = 'OBJECT'),
listed as (select rec_id, {_ident("r -> '$.version'")} as version, {_many("r -> '$.file'")} as l from roots where json_type(r) = 'OBJECT'),
numbered as (select rec_id, version, unnest(l) as f, unnest(range(len(l))) as file_no from listed),
files as (select rec_id, version, file_no, f, {_ident("f -> '$.original'")} as original from numbered where json_type(f) = 'OBJECT'),
metas as (select rec_id, file_no, unnest({_many("b -> '$.meta'")}) as m, bn from (select rec_id, file_no, unnest({_many("f -> '$.metadata'")}) as b, unnest(range(len({_many("f -> '$.metadata'")}))) as bn from files)),
types as (select rec_id, file_no, arg_min((m ->> '$.value'), bn) as datatype from metas where (m ->> '$.type') = 'datatype' group by all),
holders as (
  select rec_id, file_no, original, '' as group_id, null::varchar as parent_group, 0 as depth, case when json_type((f -> '$.body')) = 'OBJECT' then (f -> '$.body') else f end as node from files
  union all
  select rec_id, file_no, original, {_ident("g -> '$.id'")}, group_id, depth + 1, g from (select * exclude (node), unnest({_many("node -> '$.group'")}) as g from holders) where json_type(g) = 'OBJECT'
),
units as (select rec_id, file_no, original, group_id, {_ident("u -> '$.id'")} as unit_id, u from (
  select *, unnest(list_concat({_many("node -> '$.trans-unit'")}, {_many("node -> '$.unit'")})) as u from holders) where json_type(u) = 'OBJECT'),
held as (
  select *, 'unit' as place, [u] as l from units where not json_exists(u, '$.segment')
  union all select *, 'unit', {_many("u -> '$.segment'")} from units
  union all select *, 'match', list_concat({_many("u -> '$.alt-trans'")}, {_many("case when json_exists(u, '$.matches.match') then (u -> '$.matches.match') else (u -> '$.matches') end")}) from units
),
each as (select * exclude (l, u), unnest(l) as x, unnest(range(len(l))) as target_no from held),
targets as (select rec_id, file_no, original, group_id, unit_id, place, target_no, nullif({_ident("case when json_exists(x, '$.match-quality') then (x -> '$.match-quality') else (x -> '$.matchQuality') end")}, '') as quality, {_text("x -> '$.source'")} as source, {_text("x -> '$.target'")} as target from each where json_type(x) = 'OBJECT')
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_files": _NESTED + "select rec_id, file_no, version, original, coalesce((f ->> '$.datatype'), datatype) as datatype from files left join types using (rec_id, file_no)",
        "p3_groups": _NESTED + "select rec_id, file_no, original, group_id, parent_group, depth from holders where depth > 0",
        "p3_units": _NESTED + "select rec_id, file_no, original, group_id, unit_id from units",
        "p3_targets": _NESTED + "select * from targets where trim(target) <> ''",
        "p3_found": _NESTED + "select rec_id, file_no, original, group_id, unit_id, place, target_no from targets where trim(target) <> ''",
    }
