from datetime import datetime

from strataforge.plans import catalog


def tables(spark, at, commits, branches, filesets):
    spark.createDataFrame([(i, p, "b", "m", "2023-01-01T00:00:00Z", f, None) for i, p, f in commits], "id string, parents array<string>, branch string, message string, commit_time string, fileset_id string, arrived_at timestamp").write.parquet(f"{at}/commits.parquet")
    spark.createDataFrame([(n, t, None) for n, t in branches], "name string, tip string, updated_at timestamp").write.parquet(f"{at}/branches.parquet")
    rows = [(i, b, datetime(2023, 1, day), [(path, [(h, 1)]) for path, h in files.items()], None) for i, b, day, files in filesets]
    spark.createDataFrame(rows, "id string, branch string, taken_at timestamp, files array<struct<path:string,blocks:array<struct<hash:string,size:bigint>>>>, arrived_at timestamp").write.parquet(f"{at}/filesets.parquet")


def test_merge_of_tips_from_their_base(spark, tmp_path):
    base = {"a" * n: "1" for n in range(1, 9)}
    ours = base | {"a": "2", "aaa": "2", "new": "2"}
    theirs = {k: v for k, v in base.items() if k != "aaaaaaa"} | {"aa": "3", "aaa": "3"}
    commits = [("c0", [], "f0"), ("c1", ["c0"], "f1"), ("c2", ["c0"], "f2"), ("c3", ["c0"], "lost")]
    tables(spark, tmp_path, commits, [("p-main", "c1"), ("p-dev", "c2"), ("p-odd", "c3")], [("f0", "p-main", 1, base), ("f1", "p-main", 2, ours), ("f2", "p-dev", 3, theirs)])
    got = sorted(map(tuple, catalog.QUERIES["merge_tips_verdict"](spark, str(tmp_path)).collect()))
    assert got == [("p-dev", "conflict", 1), ("p-dev", "deleted-by-theirs", 1), ("p-dev", "ours", 2), ("p-dev", "same", 4), ("p-dev", "theirs", 1)]
    rows = {(r["path"], r["conflict"]) for r in catalog.QUERIES["merge_tips_result"](spark, str(tmp_path)).collect()}
    assert rows == {(p, p == "aaa") for p in ours if p != "aaaaaaa"} | {("aaa.MERGE_THEIRS", True)}


def test_status_and_scan_take_whole_snapshots(spark, tmp_path):
    first, second, third = {"a": "1", "bb": "1", "ccc": "1"}, {"a": "2", "bb": "1", "ccc": "1", "dd": "1"}, {"a": "2", "bb": "3", "dd": "1", "eeee": "1"}
    tables(spark, tmp_path, [("c0", [], "f1")], [("m", "c0")], [("f1", "m", 1, first), ("f2", "m", 2, second), ("f3", "m", 3, third)])
    got = {r["path"]: r["staged"] + r["unstaged"] for r in catalog.QUERIES["status_snapshots"](spark, str(tmp_path)).collect()}
    assert got == {"a": "MM", "bb": " M", "ccc": "D ", "dd": "A ", "eeee": "??"}
    classes = {r["path"]: r["class"] for r in catalog.QUERIES["scan_classes_snapshots"](spark, str(tmp_path)).collect()}
    assert classes == {"a": "staged", "bb": "staged", "ccc": "tracked", "dd": "staged", "eeee": "staged"}
