"""DuckDB statements equivalent to the catalogue."""

from strataforge.plans.corpus_sql import key, latest, path

_C = f"""commits_v as (
  select id, list_transform(coalesce(parents, []), lambda p: {key('p')}) as parents, {key('branch')} as branch, message,
    case when regexp_full_match(commit_time, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?(Z|[+-]\\d\\d:\\d\\d)') then try_cast(commit_time as timestamptz) at time zone 'UTC' end as ts,
    {key('fileset_id')} as fileset_id
  from ({latest('commits', 'id', 'parents, branch, message, commit_time, fileset_id')}))"""
_B = f"""branches_v as (
  select name, first({key('tip')} order by updated_at desc nulls last, {key('tip')} desc nulls last) as tip from (select {key('name')} as name, tip, updated_at from branches) where name is not null group by name)"""
_S = f"""snap_v as (
  select id as fileset_id, {key('branch')} as branch, taken_at, files from ({latest('filesets', 'id', 'branch, taken_at, files')}) where files is not null)"""
_E = f"""entries_v as (
  select fileset_id, branch, taken_at, path, arg_max(list_transform(coalesce(blocks, []), lambda b: {{'hash': {key('b.hash')}, 'size': b.size}}), pos) as blocks
  from (select fileset_id, branch, taken_at, {path('f.path')} as path, f.blocks as blocks, pos
        from (select fileset_id, branch, taken_at, unnest(files) as f, generate_subscripts(files, 1) as pos from snap_v)) where path <> '' group by all)"""
_T = """tip_refs_v as (
  select branch, path, seq, b.hash as hash, b.size as size from (
    select br.name as branch, e.path, generate_subscripts(e.blocks, 1) - 1 as seq, unnest(e.blocks) as b
    from branches_v br join commits_v c on c.id = br.tip join entries_v e on e.fileset_id = c.fileset_id) where b.hash is not null)"""
_A = f"""all_refs_v as (
  select distinct branch, {key('fileset_id')} as fileset_id, {path('path')} as path, seq, {key('hash')} as hash, size from block_refs where {key('hash')} is not null)"""
_N = """nth_v as (
  select e.*, h.n from entries_v e join (
    select fileset_id, row_number() over (partition by branch order by taken_at desc, fileset_id desc) as n from snap_v where branch is not null and taken_at is not null) h on h.fileset_id = e.fileset_id)"""
_L = """lines_v as (
  select path, seq, md5(content) as hash, content from (
    select coalesce(source, 'none') || '/' || doc_id as path, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) - 1 as seq
    from (select distinct doc_id, source, text from documents where text is not null and doc_id is not null)))"""
_V = """store_v as (select distinct hash, case when hash[1] = '1' then content || '?' else content end as content from lines_v where hash[1] <> '0'),
verify_v as (
  select h.hash, case when s.hash is null then 'Missing' when md5(s.content) = h.hash then 'OK' else 'Damaged' end as status
  from (select distinct hash from lines_v) h left join store_v s on s.hash = h.hash)"""

_TIPS = f"with {_C}, {_B}, {_S}, {_E}, {_T}"
_NTH = f"with {_S}, {_E}, {_N}"
_LINES = f"with {_L}, {_V}"
_LOG = f"with {_C}, log_v as (select * from commits_v where ts is not null)"
_TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S') as committed_at"

_SHORT = "case when length(f) <= 40 then f else f[1:18] || '...' || right(f, 18) end"
_SHORT70 = "case when length({0}) <= 70 then {0} else {0}[1:33] || '...' || right({0}, 33) end"
_FILES = f"""{_TIPS}, many as (select hash from tip_refs_v group by hash having count(*) > 1),
files_v as (select path, count(*) as n_blocks, count(*) filter (where hash in (from many)) as n_shared from tip_refs_v group by path)"""

_STATUS = f"""{_NTH},
h as (select branch, path, blocks from nth_v where n = 3), s as (select branch, path, blocks from nth_v where n = 2), w as (select branch, path, blocks from nth_v where n = 1),
k as (select branch, path from h union select branch, path from s union select branch, path from w),
j as (select k.branch, k.path, h.blocks as h, s.blocks as s, w.blocks as w from k left join h using (branch, path) left join s using (branch, path) left join w using (branch, path)),
c as (select branch, path,
  case when s is not null and h is null then 'A' when s is not null and h is not null and h <> s then 'M' when h is not null and w is null and s is not null then 'D' end as st,
  case when w is not null and h is not null and h <> w then 'M' when h is not null and w is null and s is null then 'D' end as un,
  s is null and h is null and w is not null as fresh from j),
status_v as (select branch, path, case when fresh then '?' else coalesce(st, ' ') end as staged, case when fresh then '?' else coalesce(un, ' ') end as unstaged
  from c where st is not null or un is not null or fresh)"""

_MERGE = f"""{_NTH},
b as (select branch, path, blocks from nth_v where n = 3),
o as (select branch, path, blocks from nth_v where n = 2),
t as (select branch, path, blocks from nth_v where n = 1),
k as (select branch, path from b union select branch, path from o union select branch, path from t),
verdict_v as (select k.branch, k.path, o.blocks as ours, t.blocks as theirs,
  case when o.blocks is not distinct from t.blocks then case when o.blocks is null then 'gone' else 'same' end
    when b.blocks is not distinct from o.blocks then case when t.blocks is null then 'deleted-by-theirs' else 'theirs' end
    when b.blocks is not distinct from t.blocks then case when o.blocks is null then 'deleted-by-ours' else 'ours' end
    when t.blocks is null then 'ours-kept-silently' else 'conflict' end as verdict
  from k left join b using (branch, path) left join o using (branch, path) left join t using (branch, path)),
merged_v as (
  select branch, path, theirs as blocks, false as conflict from verdict_v where verdict = 'theirs' union all
  select branch, path, ours, false from verdict_v where verdict in ('same', 'ours', 'ours-kept-silently') union all
  select branch, path, ours, true from verdict_v where verdict = 'conflict' and ours is not null union all
  select branch, path || '.MERGE_THEIRS', theirs, true from verdict_v where verdict = 'conflict')"""

_CHAIN = f"""with recursive {_C}, {_B}, edge_v as (select c.id, p.id as parent from commits_v c left join commits_v p on p.id = c.parents[1]),
chain_v as (
  select tip, 0 as step, tip as id, [tip] as seen from (select distinct tip from branches_v where tip in (select id from commits_v)) union all
  select tip, step + 1, e.parent, list_append(seen, e.parent) from chain_v c join edge_v e on e.id = c.id where e.parent is not null and not list_contains(seen, e.parent))"""

_CLASSES = f"""{_NTH}, class_v as (select path, case when path like 'shared/%' or path = 'shared' or regexp_matches(path, '(^|/)[^/]*\\.cfg$')
    or regexp_matches(path, '^[^/]*/scripts/.*[^/]*\\.txt$') or regexp_matches(path, '(^|/)tests(/|$)') then 'ignored'
  when path in (select path from nth_v where n = 1) then 'staged' else 'tracked' end as class from (select distinct path from entries_v))"""

#: Breadth first from the other tip through what the main tip does not reach; of equally short ways the first parents count.
_BASES = f"""with recursive {_C}, {_B},
up_v as (select c.id, p.id as parent, min(c.place) as place from (select id, unnest(parents) as p, generate_subscripts(parents, 1) as place from commits_v) c join commits_v p on p.id = c.p group by all),
edge_v as (select id, parent, row_number() over (partition by id order by place) as choice from up_v),
tip_v as (select name, tip, string_split(name, '-')[1] as project from branches_v where tip is not null),
pair_v as (select t.name, m.tip as a, t.tip as b from tip_v t join tip_v m on m.project = t.project and m.name = m.project || '-main' where m.tip <> t.tip),
reach_v as (select name, a as id from pair_v where a in (select id from commits_v) union select r.name, e.parent from reach_v r join edge_v e on e.id = r.id),
walk_v as (
  select name, b as id, 0 as d, []::bigint[] as route, [b] as seen, (name, b) in (select (name, id) from reach_v) as met from pair_v where b in (select id from commits_v) union all
  select w.name, e.parent, d + 1, list_append(route, e.choice), list_append(seen, e.parent), (w.name, e.parent) in (select (name, id) from reach_v)
  from walk_v w join edge_v e on e.id = w.id where not w.met and not list_contains(seen, e.parent)),
base_v as (select p.name, p.a, p.b, m.base from pair_v p left join (select name, first(id order by d, route) as base from walk_v where met group by name) m on m.name = p.name)"""

_TIP_MERGE = f"""{_BASES}, {_S}, {_E},
side_v as (select s.name, s.side, c.fileset_id, v.fileset_id as here from (
    select name, 'base' as side, base as id from base_v where base is not null union all select name, 'ours', a from base_v union all select name, 'theirs', b from base_v) s
  left join commits_v c on c.id = s.id left join snap_v v on v.fileset_id = c.fileset_id),
rows_v as (select s.name as branch, s.side, e.path, e.blocks from side_v s join entries_v e on e.fileset_id = s.fileset_id where s.name not in (select name from side_v where here is null)),
b as (select branch, path, blocks from rows_v where side = 'base'), o as (select branch, path, blocks from rows_v where side = 'ours'), t as (select branch, path, blocks from rows_v where side = 'theirs'),
{_MERGE[_MERGE.index('k as (select branch'):]}"""

SQL = {
    "merge_base": f"{_BASES} select name, base from base_v",
    "merge_tips_verdict": f"{_TIP_MERGE} select branch, verdict, count(*) as n_paths from verdict_v group by branch, verdict",
    "merge_tips_result": f"{_TIP_MERGE} select branch, path, len(blocks) as n_blocks, conflict from merged_v",
    "block_list_all_files": f"""{_TIPS}, g as (select hash, string_agg(distinct path, ',' order by path) as files, string_agg(distinct branch, ',' order by branch) as branches from tip_refs_v group by hash)
        select hash, {_SHORT70.format('files')} as files, {_SHORT70.format('branches')} as branches from g""",
    "block_repair_totals": f"{_LINES} select count(*) as n_bad, count(*) filter (where hash in (select hash from lines_v)) as n_repairable, count(*) filter (where hash not in (select hash from lines_v)) as n_lost from verify_v where status <> 'OK'",
    "block_file_reuse_pct": f"{_FILES} select round(count(*) filter (where n_shared > 0) * 100.0::double / nullif(count(*), 0), 6) as file_reuse_pct from files_v",
    "block_reuse_report": f"""{_FILES}, blocks_v as (select count(*) as n from tip_refs_v group by hash),
        t as (select count(*) as total, count(*) filter (where n > 1) as shared, (select count(*) from files_v) as files from blocks_v)
        select 0 as line_no, rpad('Total blocks', 24, '.') || ' ' || total as line from t union all select 1, rpad('Shared blocks', 24, '.') || ' ' || shared from t union all
        select 2, rpad('Total files', 24, '.') || ' ' || files from t union all select 3, rpad('Overall reuse', 24, '.') || ' ' || printf('%.1f%%', round(shared * 100.0::double / nullif(total, 0), 6)) from t""",
    "block_verify_stream": f"{_LINES} select hash, case when md5(content) = hash then 'OK' else 'Damaged' end as status from store_v",
    "block_store_appended": f"{_LINES} select hash, 1 as n, hash as content_md5 from (select distinct hash from lines_v)",
    "commit_files": f"with {_C} select id, coalesce(array_to_string(parents, ','), '') as parents, branch, message, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as timestamp, fileset_id from commits_v",
    "snapshot_files": f"with {_S}, {_E} select fileset_id, path, len(blocks) as n_blocks, coalesce(array_to_string(list_transform(blocks, lambda b: b.hash), ','), '') as hashes from entries_v",
    "branch_files": f"with {_B} select name, tip from branches_v where tip is not null",
    "leftover_files": "select distinct file_name from loose_files where regexp_matches(file_name, '(^|[/\\\\])\\.?tmp-[^/\\\\]*$')",
    "log_detailed": f"""with {_C}, {_B}, cur as (select min(name) as head from branches_v),
        r as (select tip as id, string_agg(case when name = head then 'HEAD -> ' || name else name end, ', ' order by name <> head, name) as refs from branches_v, cur where tip is not null group by tip),
        p as (select *, list_filter(parents, lambda x: x is not null) as known from commits_v where ts is not null)
        select p.id, 'commit ' || p.id || case when refs is null then '' else ' (' || refs || ')' end as header,
          case when len(known) > 1 then 'Merge: ' || array_to_string(list_transform(known, lambda x: x[1:7]), ' ') end as merge_line,
          'Date:   ' || strftime(ts, '%a %b %-d %H:%M:%S %Y +0000') as date_line, '    ' || replace(coalesce(message, ''), chr(10), chr(10) || '    ') as body
        from p left join r on r.id = p.id""",
    "block_reuse_summary": f"""{_FILES}, blocks_v as (select count(*) as n from tip_refs_v group by hash)
        select (select count(*) from blocks_v) as total_blocks, (select count(*) from blocks_v where n > 1) as shared_blocks, (select count(*) from blocks_v where n = 1) as unique_blocks,
          (select count(*) from files_v) as total_files, (select count(*) from files_v where n_shared > 0) as files_with_shared,
          (select round(avg(n_shared * 100.0::double / n_blocks), 6) from files_v) as avg_file_reuse, (select count(*) from branches_v) as total_branches,
          (select round(count(*) filter (where n > 1) * 100.0::double / nullif(count(*), 0), 6) from blocks_v) as overall_reuse""",
    "block_reuse_shared_list": f"{_TIPS} select hash, count(*) as n, count(distinct path) as n_files, count(distinct branch) as n_branches from tip_refs_v group by hash having count(*) > 1",
    "block_list": f"""{_TIPS}, g as (select hash, min(size) as size, count(distinct path) as n_files, min(path) as f, string_agg(distinct branch, ',' order by branch) as branches from tip_refs_v group by hash)
        select hash, size, n_files, {_SHORT} as first_file, branches from g""",
    "block_list_by_branch": f"{_TIPS} select hash, min(branch) as first_branch from tip_refs_v group by hash",
    "block_list_by_name": f"{_TIPS} select hash, min(path) as first_file from tip_refs_v group by hash",
    "block_count_tips": f"{_TIPS} select count(distinct hash) as n_blocks from tip_refs_v",
    "block_count_history": f"""{_CHAIN}, {_S}, {_E}, fs as (select distinct fileset_id from commits_v where id in (select id from chain_v) and fileset_id is not null)
        select count(distinct b.hash) as n_blocks from (select unnest(blocks) as b from entries_v where fileset_id in (from fs))""",
    "block_occurrences": f"with {_A} select hash, count(*) as n, count(distinct path) as n_files, count(distinct branch) as n_branches from all_refs_v group by hash",
    "file_reuse_ratio": f"{_FILES} select path, n_blocks, n_shared, round(n_shared * 100.0::double / n_blocks, 6) as reuse_pct from files_v",
    "block_dedup_ratio_by_branch": f"{_TIPS} select branch, count(*) as n_refs, count(distinct hash) as n_blocks, round(count(*)::double / count(distinct hash), 6) as ratio from tip_refs_v group by branch",
    "blocks_to_write": f"""with {_A}, st as (select id as hash, size from ({latest('blocks', 'hash', 'size, deleted_at')}) where deleted_at is null)
        select hash, size from (select hash, min(size) as size from all_refs_v where size is not null group by hash) w anti join st using (hash, size)""",
    "block_verify": f"{_LINES} select * from verify_v",
    "block_verify_summary": f"{_LINES} select status, count(*) as n_blocks from verify_v group by status",
    "block_verify_first_bad": f"{_LINES} select * from verify_v where status <> 'OK' order by hash limit 1",
    "block_repair_plan": f"{_LINES} select v.hash, v.status, min(l.path) as path, arg_min(l.seq, (l.path, l.seq))::integer as seq from verify_v v join lines_v l on l.hash = v.hash where v.status <> 'OK' group by all",
    "check_results": f"select status, count(*) as n_checks, count(distinct hash) as n_blocks from (select distinct {key('hash')} as hash, coalesce({key('status')}, 'unknown') as status, checked_at from block_checks) group by status",
    "restore_content": "select coalesce(source, 'none') || '/' || doc_id as path, md5(text) as content_md5 from (select distinct doc_id, source, text from documents where text is not null and doc_id is not null)",
    "fileset_id": f"""with {_S}, {_E} select fileset_id, md5(coalesce(string_agg(h, '' order by path), '')) as content_id
        from (select fileset_id, path, array_to_string(list_transform(blocks, lambda b: coalesce(b.hash, '') || chr(10)), '') as h from entries_v) group by fileset_id""",
    "entry_equal": f"""{_NTH}, a as (select branch, path, blocks from nth_v where n = 2), b as (select branch, path, blocks from nth_v where n = 1)
        select branch, path, a.blocks is not distinct from b.blocks as is_equal from a full join b using (branch, path)""",
    "status_full": f"{_STATUS} select * from status_v",
    "status_short": f"{_STATUS} select branch, staged || unstaged || ' ' || path as line from status_v",
    "status_snapshots": f"{_STATUS} select * from status_v",
    "status_tracked_only": f"{_STATUS} select * from status_v where staged <> '?'",
    "status_counts": f"{_STATUS} select staged, unstaged, count(*) as n_paths from status_v group by all",
    "scan_classes": f"{_CLASSES} select * from class_v",
    "scan_classes_snapshots": f"{_CLASSES} select * from class_v",
    "scan_counts": f"{_CLASSES} select class, count(*) as n_files from class_v group by class",
    "add_pathspec": f"{_NTH} select branch, path from nth_v where n = 1 and (path like '%.pak' or starts_with(path, '*.pak'))",
    "add_prefix": f"{_NTH} select branch, path from nth_v where n = 1 and starts_with(path, 'shared/')",
    "add_update": f"{_NTH} select branch, path from nth_v where n = 1 and (branch, path) in (select (branch, path) from nth_v where n = 2)",
    "index_upsert": f"{_NTH} select branch, path, len(arg_min(blocks, n)) as n_blocks from nth_v where n <= 2 group by branch, path",
    "merge_verdict": f"{_MERGE} select verdict, count(*) as n_paths from verdict_v group by verdict",
    "merge_result": f"{_MERGE} select branch, path, len(blocks) as n_blocks, conflict from merged_v",
    "merge_conflicts": f"{_MERGE} select branch, path from merged_v where conflict",
    "log_all": f"{_LOG} select id, branch, {_TIME} from log_v",
    "log_since_until": f"{_LOG} select id, branch, {_TIME} from log_v where ts >= timestamp '2023-03-01' and ts <= timestamp '2023-06-01'",
    "log_limit": f"{_LOG} select id, {_TIME} from log_v order by ts desc, id desc limit 25",
    "log_oneline": f"{_LOG} select id[1:7] as short_id, coalesce(string_split(message, chr(10))[1], '') as subject from log_v",
    "log_branch": f"{_LOG} select branch, first(id order by ts desc, id desc) as newest, count(*) as n_commits from log_v where branch is not null group by branch",
    "log_refs": f"""with {_C}, {_B}, cur as (select min(name) as head from branches_v)
        select c.id, string_agg(case when name = head then 'HEAD -> ' || name else name end, ', ' order by name <> head, name) as refs, any_value(len(parents) > 1) as is_merge
        from commits_v c join branches_v on tip = c.id, cur group by c.id""",
    "branch_list": f"with {_B} select name, coalesce(tip, '') as tip from branches_v",
    "tip_snapshots": f"""with {_C}, {_B}, {_S}, {_E}, n as (select fileset_id, count(*) as n_files from entries_v group by all)
        select name, tip, c.fileset_id, coalesce(n_files, 0) as n_files from branches_v join commits_v c on c.id = tip left join n on n.fileset_id = c.fileset_id""",
    "first_parent_chain": f"{_CHAIN} select tip, step::bigint as step, id from chain_v",
    "ancestor_counts": f"""with recursive {_C}, {_B}, e as (select distinct c.id, p.id as parent from (select id, unnest(parents) as p from commits_v) c join commits_v p on p.id = c.p),
        a as (select name, tip as id from branches_v where tip in (select id from commits_v) union select name, e.parent from a join e on e.id = a.id)
        select name, count(*) as n_ancestors from a group by name""",
    "cherry_pick": f"""with {_C}, {_B}, p as (select id, fileset_id from commits_v where ts is not null and fileset_id is not null order by ts desc, id desc limit 1)
        select name, tip as parent, p.id as picked, p.fileset_id from branches_v, p where tip is not null""",
    "reset_plan": f"""with {_C}, {_B}, {_S}, {_E} select name, t.id as target, path from branches_v b join commits_v c on c.id = b.tip join commits_v t on t.id = c.parents[1] join entries_v e on e.fileset_id = t.fileset_id""",
}
