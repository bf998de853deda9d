"""The engine's own queries over the repository tables, one per operator."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions import chunking, glob, strings
from strataforge.functions.normal import counting_rows, key
from strataforge.operators import blocks, compaction, diff, graph, log
from strataforge.plans.views import Repository
from strataforge.session import cut, scratch_dir
from strataforge.sources import layout
from strataforge.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

IGNORE = ["# build products", "", "shared/**", "**/*.cfg", "*/scripts/**/*.txt", "**/tests/**"]


def query(f: Callable[[Repository], DataFrame]) -> Callable[[Repository], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf: f(Repository(spark, sf))
    return f


# --- blocks -----------------------------------------------------------------


@query
def block_reuse_summary(r: Repository) -> DataFrame:
    return blocks.reuse_summary(r.tip_refs(), r.branches())


@query
def block_reuse_shared_list(r: Repository) -> DataFrame:
    return blocks.shared_list(r.tip_refs())


@query
def block_list(r: Repository) -> DataFrame:
    return blocks.inventory_report(r.tip_refs()).orderBy("hash")


@query
def block_list_all_files(r: Repository) -> DataFrame:
    """The block list with every file and branch of a block, as the reference prints it."""
    return blocks.inventory_listing(r.tip_refs()).orderBy("hash")


@query
def block_list_by_branch(r: Repository) -> DataFrame:
    return r.tip_refs().groupBy("hash").agg(F.min("branch").alias("first_branch")).orderBy("first_branch", "hash")


@query
def block_list_by_name(r: Repository) -> DataFrame:
    return r.tip_refs().groupBy("hash").agg(F.min("path").alias("first_file")).orderBy("first_file", "hash")


@query
def block_count_tips(r: Repository) -> DataFrame:
    return r.tip_refs().agg(F.countDistinct("hash").alias("n_blocks"))


@query
def block_count_history(r: Repository) -> DataFrame:
    commits = r.commits()
    seen = graph.history(commits, r.branches().where(F.col("tip").isNotNull()).select(F.col("tip").alias("id")))
    sets = commits.join(seen, "id", "left_semi").where(F.col("fileset_id").isNotNull()).select("fileset_id").distinct()
    return blocks.explode_blocks(r.entries(sets)).agg(F.countDistinct("hash").alias("n_blocks"))


@query
def block_occurrences(r: Repository) -> DataFrame:
    return blocks.occurrences(r.all_refs())


@query
def file_reuse_ratio(r: Repository) -> DataFrame:
    return blocks.file_reuse(r.tip_refs()).withColumn("reuse_pct", F.round("reuse_pct", 6))


@query
def block_dedup_ratio_by_branch(r: Repository) -> DataFrame:
    per = r.tip_refs().groupBy("branch").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("hash").alias("n_blocks"))
    return per.withColumn("ratio", F.round(F.col("n_refs") / F.col("n_blocks"), 6))


@query
def blocks_to_write(r: Repository) -> DataFrame:
    rows = r.table("blocks").select(key(F.col("hash")).alias("hash"), "size", "deleted_at", "arrived_at")
    store = counting_rows(rows, "hash", ["size", "deleted_at"]).where(F.col("deleted_at").isNull())
    return blocks.to_write(r.all_refs(), store)


@query
def block_verify(r: Repository) -> DataFrame:
    return blocks.verify(r.lines(), r.line_store())


@query
def block_verify_summary(r: Repository) -> DataFrame:
    return block_verify(r).groupBy("status").agg(F.count(F.lit(1)).alias("n_blocks"))


@query
def block_verify_first_bad(r: Repository) -> DataFrame:
    return blocks.first_bad(block_verify(r))


@query
def block_repair_plan(r: Repository) -> DataFrame:
    return blocks.repair_plan(block_verify(r), r.lines())


@query
def block_repair_totals(r: Repository) -> DataFrame:
    return blocks.repair_totals(block_repair_plan(r))


@query
def block_file_reuse_pct(r: Repository) -> DataFrame:
    return blocks.file_reuse_pct(block_reuse_summary(r))


@query
def block_reuse_report(r: Repository) -> DataFrame:
    """The reuse summary as the lines of a text report, without the colours of the screen."""
    s = block_reuse_summary(r)
    number = lambda c: F.concat(F.lit("\x1b[32m"), F.col(c).cast("string"), F.lit("\x1b[0m"))
    lines = [("Total blocks", number("total_blocks")), ("Shared blocks", number("shared_blocks")), ("Total files", number("total_files")), ("Overall reuse", strings.percent(F.col("overall_reuse")))]
    report = F.array(*[F.struct(F.lit(i).alias("line_no"), strings.plain(F.concat(strings.dotted(F.lit(n), 24), F.lit(" "), v)).alias("line")) for i, (n, v) in enumerate(lines)])
    return s.select(F.explode(report).alias("l")).select("l.line_no", "l.line")


@query
def block_verify_stream(r: Repository) -> DataFrame:
    """Every stored block verified as a stream."""
    path = f"{scratch_dir(r.spark)}/verify-{uuid.uuid4().hex}"
    store = r.line_store()
    store.write.parquet(f"{path}/store")
    return ingest.run_once(ingest.verify(ingest.read(r.spark, f"{path}/store", store.schema)), f"{path}/checks")


@query
def block_store_appended(r: Repository) -> DataFrame:
    """All lines delivered twice to a block store that keeps each once."""
    path = f"{scratch_dir(r.spark)}/store-{uuid.uuid4().hex}"
    deliver = ingest.append_missing(path, ["hash"])
    lines = r.lines().select("hash", "content")
    deliver(lines, 0)
    deliver(lines, 1)
    return r.spark.read.schema(lines.schema).parquet(path).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max(F.md5("content")).alias("content_md5"))


def _folder(r: Repository) -> str:
    """A fresh folder that driver and executors see as files."""
    return re.sub("^file:(//)?", "", f"{scratch_dir(r.spark)}/layout-{uuid.uuid4().hex}")


@query
def commit_files(r: Repository) -> DataFrame:
    """All commits written as JSON files and read back."""
    root = _folder(r)
    rows = r.commits().select("id", "parents", "branch", "message", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "fileset_id")
    document = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    layout.write_documents(rows.select("id", document.alias("d")), f"{root}/commits", "id", "d")
    return layout.read_commits(r.spark, f"file:{root}").select("id", F.array_join("parents", ",").alias("parents"), "branch", "message", "timestamp", "fileset_id")


@query
def snapshot_files(r: Repository) -> DataFrame:
    """All snapshots written as JSON files and read back."""
    root = _folder(r)
    rows = r.entries().select("fileset_id", F.struct(F.col("path").alias("Path"), F.col("blocks").alias("Blocks")).alias("e"))
    sets = rows.groupBy("fileset_id").agg(F.sort_array(F.collect_list("e")).alias("files"))
    layout.write_documents(sets.select("fileset_id", F.to_json(F.struct(F.col("fileset_id").alias("id"), "files")).alias("d")), f"{root}/snapshots", "fileset_id", "d")
    return layout.read_entries(r.spark, f"file:{root}").select("fileset_id", "path", F.size("blocks").cast("bigint").alias("n_blocks"), F.array_join(F.transform("blocks", lambda b: b["hash"]), ",").alias("hashes"))


@query
def branch_files(r: Repository) -> DataFrame:
    """All branch pointers with a tip written as files and read back."""
    root = _folder(r)
    layout.write_branches(r.branches().where(F.col("tip").isNotNull()), root)
    return layout.read_branches(r.spark, f"file:{root}")


@query
def leftover_files(r: Repository) -> DataFrame:
    """Leftovers of interrupted writes among the loose files."""
    return compaction.leftovers(r.table("loose_files"))


@query
def check_results(r: Repository) -> DataFrame:
    """Scan results by status in one spelling, repeated rows once."""
    rows = r.table("block_checks").select(key(F.col("hash")).alias("hash"), F.coalesce(key(F.col("status")), F.lit("unknown")).alias("status"), "checked_at").distinct()
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n_checks"), F.countDistinct("hash").alias("n_blocks"))


@query
def restore_content(r: Repository) -> DataFrame:
    store = r.lines().select("hash", "content").distinct()
    return blocks.restore(r.lines().select("path", "seq", "hash"), store).select("path", F.md5("content").alias("content_md5"))


@query
def fileset_id(r: Repository) -> DataFrame:
    return blocks.fileset_ids(r.entries())


@query
def fileset_id_xxh3(r: Repository) -> DataFrame:
    return blocks.fileset_ids(r.entries(), chunking.xxh3)


@query
def cdc_chunks(r: Repository) -> DataFrame:
    docs = r.table("documents").where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return chunking.split_files(docs, smallest=32, largest=256, modulus=64)


# --- status, staging, merge -------------------------------------------------


@query
def entry_equal(r: Repository) -> DataFrame:
    t = diff.three_way(["branch", "path"], a=r.triple(2), b=r.triple(1))
    return t.select("branch", "path", diff.same(F.col("a"), F.col("b")).alias("is_equal"))


def _status(r: Repository, show_untracked: bool = True) -> DataFrame:
    """Over whole snapshots: the third last is committed, the second last staged, the last in the tree."""
    return diff.status(r.triple(3), r.triple(2), r.triple(1), ["branch", "path"], show_untracked)


@query
def status_full(r: Repository) -> DataFrame:
    return _status(r)


@query
def status_short(r: Repository) -> DataFrame:
    return _status(r).select("branch", F.concat("staged", "unstaged", F.lit(" "), "path").alias("line"))


@query
def status_counts(r: Repository) -> DataFrame:
    return _status(r).groupBy("staged", "unstaged").agg(F.count(F.lit(1)).alias("n_paths"))


@query
def status_snapshots(r: Repository) -> DataFrame:
    return _status(r)


@query
def status_tracked_only(r: Repository) -> DataFrame:
    return _status(r, show_untracked=False)


@query
def scan_classes(r: Repository) -> DataFrame:
    """Classes of all paths, the index being the last snapshots."""
    paths = r.entries().select("path").distinct()
    index = r.triple(1).select("path").distinct().withColumn("known", F.lit(True))
    hit = glob.ignored(F.col("path"), *glob.rules(IGNORE))
    return paths.join(index, "path", "left").select("path", F.when(hit, "ignored").when(F.col("known"), "staged").otherwise("tracked").alias("class"))


@query
def scan_classes_snapshots(r: Repository) -> DataFrame:
    return scan_classes(r)


@query
def scan_counts(r: Repository) -> DataFrame:
    """Files of every class."""
    return scan_classes(r).groupBy("class").agg(F.count(F.lit(1)).alias("n_files"))


@query
def add_pathspec(r: Repository) -> DataFrame:
    return diff.pathspec(r.triple(1), "*.pak").select("branch", "path")


@query
def add_prefix(r: Repository) -> DataFrame:
    return diff.pathspec(r.triple(1), "shared/").select("branch", "path")


@query
def add_update(r: Repository) -> DataFrame:
    return r.triple(1).join(r.triple(2), ["branch", "path"], "left_semi").select("branch", "path")


@query
def index_upsert(r: Repository) -> DataFrame:
    return diff.upsert(r.triple(2), r.triple(1), ["branch", "path"]).select("branch", "path", F.size("blocks").cast("bigint").alias("n_blocks"))


def _verdicts(r: Repository) -> DataFrame:
    """A merge of the two last snapshots of every branch, from the third last."""
    return diff.merge_verdicts(r.triple(3), r.triple(2), r.triple(1), ["branch", "path"])


@query
def merge_verdict(r: Repository) -> DataFrame:
    return _verdicts(r).groupBy("verdict").agg(F.count(F.lit(1)).alias("n_paths"))


@query
def merge_result(r: Repository) -> DataFrame:
    return diff.merged(_verdicts(r)).select("branch", "path", F.size("blocks").cast("bigint").alias("n_blocks"), "conflict")


@query
def merge_conflicts(r: Repository) -> DataFrame:
    return diff.merged(_verdicts(r)).where("conflict").select("branch", "path")


# --- log and graph ----------------------------------------------------------

_at = lambda: F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("committed_at")


@query
def log_all(r: Repository) -> DataFrame:
    return log.log(r.commits()).select("id", "branch", _at())


@query
def log_since_until(r: Repository) -> DataFrame:
    return log.log(r.commits(), since="2023-03-01", until="2023-06-01").select("id", "branch", _at())


@query
def log_limit(r: Repository) -> DataFrame:
    return log.log(r.commits(), limit=25).select("id", _at())


@query
def log_oneline(r: Repository) -> DataFrame:
    return log.oneline(log.log(r.commits()))


@query
def log_detailed(r: Repository) -> DataFrame:
    return log.detailed(log.log(r.commits()), log_refs(r))


@query
def log_branch(r: Repository) -> DataFrame:
    """Newest commit and number of commits of every branch."""
    return log.log(r.commits()).where(F.col("branch").isNotNull()).groupBy("branch").agg(F.max_by("id", F.struct("ts", "id")).alias("newest"), F.count(F.lit(1)).alias("n_commits"))


@query
def log_refs(r: Repository) -> DataFrame:
    head = r.branches().agg(F.min("name")).first()[0] or ""
    return log.with_refs(r.commits(), r.branches(), head)


@query
def branch_list(r: Repository) -> DataFrame:
    return r.branches().select("name", F.coalesce("tip", F.lit("")).alias("tip")).orderBy("name")


@query
def tip_snapshots(r: Repository) -> DataFrame:
    tips = r.branches().where(F.col("tip").isNotNull()).join(r.commits().select(F.col("id").alias("tip"), "fileset_id"), "tip")
    counted = r.entries(tips.where(F.col("fileset_id").isNotNull())).groupBy("fileset_id").agg(F.count(F.lit(1)).alias("n_files"))
    return tips.join(counted, "fileset_id", "left").select("name", "tip", "fileset_id", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def _tips(r: Repository) -> DataFrame:
    return r.branches().where(F.col("tip").isNotNull()).select("name", "tip")


@query
def first_parent_chain(r: Repository) -> DataFrame:
    return graph.first_parent_chain(r.commits(), _tips(r).select(F.col("tip").alias("id")).distinct()).select("tip", "step", "id")


@query
def ancestor_counts(r: Repository) -> DataFrame:
    """Number of commits reachable from every branch tip over any parents."""
    found = graph.Compressed(r.commits()).ancestors(_tips(r).select(F.col("name").alias("query"), F.col("tip").alias("id")))
    return found.groupBy(F.col("query").alias("name")).agg(F.count(F.lit(1)).alias("n_ancestors"))


def _merge_pairs(r: Repository) -> DataFrame:
    """``query, a, b``: tips of the main branch of its project (``a``) and of every branch (``b``)."""
    tips = _tips(r)
    project = F.substring_index("name", "-", 1)
    main = tips.where(F.col("name") == F.concat(project, F.lit("-main"))).select(project.alias("project"), F.col("tip").alias("a"))
    return tips.select(F.col("name").alias("query"), F.col("tip").alias("b"), project.alias("project")).join(main, "project").where(F.col("a") != F.col("b")).select("query", "a", "b")


@query
def merge_base(r: Repository) -> DataFrame:
    """Merge base of every branch with the main branch of its project."""
    return graph.Compressed(r.commits()).merge_bases(_merge_pairs(r)).select(F.col("query").alias("name"), "base")


def _tip_verdicts(r: Repository) -> DataFrame:
    """Every branch merged into the main branch of its project, from their merge base.

    Without a base everything is new on both sides; a merge that lacks one of its
    snapshots cannot be made and is passed over.
    """
    pairs = _merge_pairs(r)
    bases = graph.Compressed(r.commits()).merge_bases(pairs).select("query", "base")
    merges = pairs.join(bases, "query", "left")
    sides = merges.select("query", F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).alias("id")) for n, c in (("base", "base"), ("ours", "a"), ("theirs", "b"))])).alias("s")).select("query", "s.*")
    sides = sides.where(F.col("id").isNotNull())
    known = r.snapshots().select("fileset_id").withColumn("here", F.lit(True))
    sets = cut(sides.join(r.commits().select("id", "fileset_id"), "id", "left").join(known, "fileset_id", "left"), "merge-sides")
    whole = sets.groupBy("query").agg(F.count_if(F.col("here").isNull()).alias("lacking")).where(F.col("lacking") == 0)
    rows = cut(sets.join(whole, "query", "left_semi").join(r.entries(sets.where(F.col("fileset_id").isNotNull())).select("fileset_id", "path", "blocks"), "fileset_id").select(F.col("query").alias("branch"), "side", "path", "blocks"), "merge-entries")
    return diff.merge_verdicts(*[rows.where(F.col("side") == n).select("branch", "path", "blocks") for n in ("base", "ours", "theirs")], ["branch", "path"])


@query
def merge_tips_verdict(r: Repository) -> DataFrame:
    return _tip_verdicts(r).groupBy("branch", "verdict").agg(F.count(F.lit(1)).alias("n_paths"))


@query
def merge_tips_result(r: Repository) -> DataFrame:
    return diff.merged(_tip_verdicts(r)).select("branch", "path", F.size("blocks").cast("bigint").alias("n_blocks"), "conflict")


@query
def cherry_pick(r: Repository) -> DataFrame:
    """The commit that picks the newest commit of all onto every branch: whole snapshot, not a difference."""
    picked = r.commits().where(F.col("ts").isNotNull() & F.col("fileset_id").isNotNull()).agg(F.max(F.struct("ts", "id", "fileset_id", "message")).alias("p")).select("p.*")
    return _tips(r).crossJoin(F.broadcast(picked)).select("name", F.col("tip").alias("parent"), F.col("id").alias("picked"), "fileset_id")


@query
def reset_plan(r: Repository) -> DataFrame:
    """A mixed reset of every branch to the parent of its tip: the index it leaves."""
    commits = r.commits()
    back = _tips(r).join(commits.select(F.col("id").alias("tip"), F.get("parents", 0).alias("target")), "tip")
    aim = back.join(commits.select(F.col("id").alias("target"), "fileset_id"), "target")
    return aim.join(r.entries(aim.where(F.col("fileset_id").isNotNull())).select("fileset_id", "path"), "fileset_id").select("name", "target", "path")
