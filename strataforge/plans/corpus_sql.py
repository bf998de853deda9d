"""DuckDB statements equivalent to the queries p1 to p5."""

_SPACES = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"


def key(x: str) -> str:
    return f"nullif(lower(trim({x}, {_SPACES})), '')"


def path(x: str) -> str:
    """Cleaned path; ``..`` is resolved up to four times."""
    p = f"replace({x}, '\\', '/')"
    p = f"array_to_string(list_filter(string_split({p}, '/'), lambda s: s <> '' and s <> '.'), '/')"
    for _ in range(4):
        p = f"regexp_replace({p}, '(^|/)[^/]+/\\.\\.(/|$)', '\\1')"
    return f"rtrim({p}, '/')"


def latest(table: str, id_col: str, cols: str) -> str:
    return f"""select id, first_arrived, {cols} from (
        select *, {key(id_col)} as id, min(arrived_at) over (partition by {key(id_col)}) as first_arrived,
               row_number() over (partition by {key(id_col)} order by arrived_at desc nulls last) as newest
        from (select * exclude ({id_col}), {id_col} as {id_col} from {table})) where newest = 1 and id is not null"""


BUSY = f"""
with h as (
  select distinct branch, {key('fileset_id')} as ref, {path('path')} as path, seq, {key('hash')} as key_value, size, start_offset, recorded_at as seen_at, arrived_at
  from block_refs where {key('hash')} is not null),
f as (
  select distinct {path('f')} as key_value, ref, seen_at
  from (select {key('hash')} as ref, checked_at as seen_at, unnest(files) as f from block_checks)
  where f is not null and {path('f')} <> '' and ref is not null),
u as (select 'hash' as key_field, key_value, ref, seen_at from h union all select 'file', key_value, ref, seen_at from f)
"""
BUSY_KEYS = BUSY + """
select key_field, key_value, count(*) as n_rows,
  first(ref order by seen_at asc nulls last, ref asc nulls last) as first_ref,
  first(ref order by seen_at desc nulls last, ref desc nulls last) as last_ref
from u group by all"""
P1_GAPS = BUSY + """
select key_field, key_value, max(gap) as longest_gap from (
  select key_field, key_value, epoch_us(seen_at) - lag(epoch_us(seen_at)) over (partition by key_field, key_value order by seen_at nulls last, ref) as gap from u)
where gap is not null group by all"""

P2 = f"""
with src as (
  select distinct {key('id')} as id, {key('branch')} as branch, taken_at, arrived_at, files from filesets),
one as (
  select * from (select *, row_number() over (partition by id order by arrived_at desc) as k from src) where k = 1 and id is not null),
snap as (
  select id, branch, files, row_number() over (partition by branch order by taken_at, id) as n
  from one where files is not null and branch is not null and taken_at is not null),
e as (
  select id, branch, n, path, sig from (
    select id, branch, n, path, sig, row_number() over (partition by id, path order by pos desc) as k from (
      select id, branch, n, pos, {path('f.path')} as path,
        coalesce(array_to_string(list_transform(f.blocks, lambda b: coalesce({key('b.hash')}, '?') || ':' || coalesce(b.size::varchar, '?')), ','), '') as sig
      from (select id, branch, n, unnest(files) as f, generate_subscripts(files, 1) as pos from snap))
    where path <> '') where k = 1),
cur as (select s.id, s.branch, s.n, e.path, e.sig from snap s join e on e.id = s.id where s.n > 1),
prev as (select s.id, e.path, e.sig from snap s join e on e.branch = s.branch and e.n = s.n - 1)
select coalesce(c.id, p.id) as fileset_id, coalesce(c.path, p.path) as path,
  case when p.path is null then 'added' when c.path is null then 'removed' else 'changed' end as change_kind
from cur c full join prev p on c.id = p.id and c.path = p.path
where p.path is null or c.path is null or c.sig <> p.sig"""

P3 = f"""
with c as ({latest('commits', 'id', 'parents, commit_time, fileset_id, deleted_at')}),
fs as ({latest('filesets', 'id', 'deleted_at')}),
b as ({latest('blocks', 'hash', 'deleted_at')}),
t as (
  select 'commits.fileset_id' as ref_field, id, first_arrived, deleted_at from fs union all
  select 'commits.parents', id, first_arrived, deleted_at from c union all
  select 'block_refs.hash', id, first_arrived, deleted_at from b),
cm as (
  select *, case when regexp_full_match(commit_time, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?(Z|[+-]\\d\\d:\\d\\d)')
      then strftime(try_cast(commit_time as timestamptz) at time zone 'UTC', '%Y-%m') end as m from c),
r as (
  select 'commits.fileset_id' as ref_field, id as record_id, {key('fileset_id')} as target_key, coalesce(m, 'unknown') as ref_month, first_arrived as at from cm union
  select distinct 'commits.parents', id, {key('p')}, coalesce(m, 'unknown'), first_arrived from (select *, unnest(parents) as p from cm) union
  select 'block_refs.hash', record_id, target_key, coalesce(strftime(min(recorded_at) at time zone 'UTC', '%Y-%m'), 'unknown'), min(arrived_at)
  from (select {key('fileset_id')} as record_id, {key('hash')} as target_key, recorded_at, arrived_at from block_refs) group by record_id, target_key),
j as (
  select r.ref_field, record_id, target_key, ref_month,
    case when t.id is null then 'missing' when t.deleted_at is not null then 'deleted' when t.first_arrived > r.at then 'late' end as ref_state
  from r left join t on t.ref_field = r.ref_field and t.id = r.target_key where r.target_key is not null)
select ref_field, record_id, target_key, ref_month, ref_state from j where ref_state is not null"""

LINKS = f"""
with recursive c as ({latest('commits', 'id', 'parents')}),
raw as (select id, list_filter(list_transform(parents, lambda p: {key('p')}), lambda p: p is not null)[1] as parent from c),
e as (select raw.id, p.id as parent from raw left join raw p on raw.parent = p.id),
size as (select count(*) as n from e),
walk as (
  select id, id as node, 0 as d from e union all
  select w.id, e.parent, d + 1 from walk w join e on e.id = w.node where e.parent is not null and d <= 2 * (select n from size)),
far as (select id, max(d) as depth from walk group by id),
cyc as (select id from far where depth > (select n from size))
"""

P5 = LINKS + """
select w.id, w.node as root_id, f.depth::bigint as depth from walk w join far f on f.id = w.id and f.depth = w.d where w.id not in (from cyc)
union all
select id, min(node), -1 from walk where id in (from cyc) and d >= (select n from size) group by id"""

P5_DESCENDANTS = LINKS + """
select node as id, (count(*) - 1)::bigint as n_descendants, (any_value(f.depth) + 1)::bigint as path_length
from walk w join far f on f.id = w.node where w.id not in (from cyc) group by node"""

P5_TIPS = LINKS + f"""
, tips as (select distinct {key('tip')} as id from branches)
select w.id as tip_id, (f.depth - w.d)::bigint as step, w.node as commit_id
from walk w join far f on f.id = w.id where w.id in (select id from tips where id is not null) and w.id not in (from cyc)"""

P4 = """
with f as (
  select trim(body, ' ' || chr(9) || chr(10) || chr(13) || chr(65279)) as t from loose_files
  where body is not null and not regexp_matches(coalesce(file_name, ''), '(^|[/\\\\])\\.?tmp-[^/\\\\]*$')),
v as (select t, json_valid(t) as whole from f),
o as (
  select t::json as j from v where whole and json_type(t) = 'OBJECT' union all
  select unnest(json_extract(t, '$[*]')) from v where whole and json_type(t) = 'ARRAY' union all
  select case when json_valid(line) then line::json end from (select trim(unnest(string_split(t, chr(10))), ' ' || chr(13)) as line from v where not whole)),
r as (select json_extract_string(j, '$.id') as id, json_extract_string(j, '$.hash') as hash from o where json_type(j) = 'OBJECT')
select distinct case when id is not null then 'commit' else 'block' end as record_kind, lower(trim(coalesce(id, hash))) as record_id
from r where trim(coalesce(id, hash)) <> ''"""

SQL = {
    "p1_found": f"select key_field, key_value, first_ref from ({BUSY_KEYS}) where n_rows >= 20",
    "p1_counts": BUSY_KEYS,
    "p1_gaps": P1_GAPS,
    "p2_found": P2,
    "p2_summary": f"select fileset_id, change_kind, count(*) as n_paths from ({P2}) group by all",
    "p3_found": P3,
    "p3_counts": f"select ref_field, ref_month, ref_state, count(*) as n_refs, count(distinct target_key) as n_targets from ({P3}) group by all",
    "p4_found": P4,
    "p5_found": P5,
    "p5_descendants": P5_DESCENDANTS,
    "p5_tip_paths": P5_TIPS,
}
