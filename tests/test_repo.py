import os

import pytest

from strataforge.functions import chunking
from strataforge.operators import blocks, diff
from strataforge.repo import Repo, RepositoryError
from strataforge.sources import layout, worktree


def put(root, **files):
    for name, text in files.items():
        where = os.path.join(root, name.replace("__", "/"))
        os.makedirs(os.path.dirname(where), exist_ok=True)
        with open(where + ("" if "." in name else ".txt"), "w") as f:
            f.write(text)


def get(root, name):
    with open(os.path.join(root, name)) as f:
        return f.read()


@pytest.fixture
def repo(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    r = Repo(spark, str(tmp_path / "repo"), str(tree), smallest=32, largest=256, modulus=64)
    r.init()
    return r


def test_life_of_a_repository(repo):
    put(repo.tree, a="one " * 100, sub__b="two", empty="", log__x="ignored")
    with open(os.path.join(repo.tree, worktree.IGNORE_FILE), "w") as f:
        f.write("# comment\nlog/**\n")
    classes = {r["path"]: r["class"] for r in repo.scan().collect()}
    assert classes["log"] == "ignored" and classes["a.txt"] == "tracked" and "empty.txt" in classes
    with pytest.raises(RepositoryError):
        repo.commit("nothing")
    assert repo.add() == 4
    with pytest.raises(RepositoryError):
        repo.cherry_pick("unknown")
    repo.commit("first", id="c1")
    assert repo.tip() == "c1" and repo.index().isEmpty()
    assert {r["status"] for r in repo.block_scan().collect()} == {"OK"}

    repo.branch("feature")
    with pytest.raises(RepositoryError):
        repo.branch("feature")
    put(repo.tree, a="main " * 100, new="fresh")
    shown = {r["path"]: (r["staged"], r["unstaged"]) for r in repo.status().collect()}
    assert shown == {"a.txt": (" ", "M"), "new.txt": ("?", "?")}
    repo.add()
    repo.commit("on main", id="c2")

    repo.checkout("feature")
    assert get(repo.tree, "a.txt") == "one " * 100 and get(repo.tree, "empty.txt") == ""
    put(repo.tree, a="theirs " * 90, sub__b="two changed")
    repo.add("a.txt", "sub/", worktree.IGNORE_FILE)
    repo.commit("on feature", id="f1")

    repo.checkout("main")
    done, clashes = repo.merge("feature", id="m1")
    assert [r["path"] for r in clashes.collect()] == ["a.txt", "a.txt.MERGE_THEIRS"] or sorted(r["path"] for r in clashes.collect()) == ["a.txt", "a.txt.MERGE_THEIRS"]
    assert get(repo.tree, "a.txt.MERGE_THEIRS") == "theirs " * 90 and get(repo.tree, "sub/b.txt") == "two changed"
    assert [r["id"] for r in repo.log().collect()][-1] == "c1" or {r["id"] for r in repo.log().collect()} == {"m1", "c2", "c1"}

    repo.reset("c1", "hard")
    assert repo.tip() == "c1" and get(repo.tree, "a.txt") == "one " * 100
    repo.cherry_pick("f1", id="p1")
    assert repo.tip() == "p1" and get(repo.tree, "a.txt") == "theirs " * 90
    assert repo.block_reuse().first()["total_branches"] == 2

    # damage a block, repair it from the tree
    spark = repo.spark
    bad = repo.block_scan().where("array_contains(files, 'a.txt')").first()["hash"]
    rows = [(r["hash"], r["size"], b"?" if r["hash"] == bad else bytes(r["content"])) for r in repo.store().collect()]
    spark.createDataFrame(rows, "hash string, size bigint, content binary").write.mode("overwrite").parquet(f"{repo.root}/blocks")
    assert [r["hash"] for r in repo.block_scan().where("status = 'Damaged'").collect()] == [bad]
    with pytest.raises(RepositoryError, match="damaged"):
        repo.commit("on a damaged store", allow_empty=True)
    after = repo.block_repair()
    assert {r["status"] for r in after.collect()} == {"OK"}
    assert [tuple(r) for r in repo.repair_totals(after).collect()] == [("OK", 1)]
    assert repo.block_scan().count() == repo.block_scan().select("hash").distinct().count()
    assert repo.read_block(bad) and repo.read_block("none") is None


def test_a_tip_that_has_moved_is_not_overwritten(repo):
    repo._write("branches/main", "other")
    with pytest.raises(RepositoryError, match="moved"):
        repo._move("main", "c1", "c2")
    repo._move("main", "other", "c2")
    assert repo.tip() == "c2"


def test_leftovers_are_removed(tmp_path):
    for name, text in (("good.bin", "123"), ("tmp-abc", ""), (".tmp-xyz", "")):
        (tmp_path / name).write_text(text)
    assert layout.clean_temporary(str(tmp_path)) == 2
    assert [p.name for p in tmp_path.iterdir()] == ["good.bin"]


def test_block_ids_need_the_library(monkeypatch):
    monkeypatch.setattr(chunking, "xxhash", None)
    with pytest.raises(RuntimeError):
        chunking.block_hash(b"x")


def test_head_and_names(repo):
    assert repo.current() == "main" and repo.tip() is None and repo.log().isEmpty()
    for bad in ("a/b", ""):
        with pytest.raises(RepositoryError):
            repo.branch(bad)
    with pytest.raises(RepositoryError):
        repo.checkout("none")


def test_json_layout_round_trip(spark, tmp_path):
    root = str(tmp_path)
    commits = spark.createDataFrame([("c1", [], "main", "müll", "2024-01-01T00:00:00Z", "fs1"), ("c2", ["c1"], "main", None, None, None)], layout.COMMIT)
    block = "array<struct<hash:string,size:bigint,offset:bigint>>"
    entries = spark.createDataFrame([("fs1", "a.txt", [("h1", 123, 0)]), ("fs1", "empty", [])], f"fileset_id string, path string, blocks {block}")
    layout.write_layout(root, commits, entries)
    assert get(root, "commits/c1.json").startswith('{\n  "id"')
    assert sorted(map(str, layout.read_commits(spark, root).collect())) == sorted(map(str, commits.collect()))
    assert sorted(map(str, layout.read_entries(spark, root).collect())) == sorted(map(str, entries.collect()))
    os.makedirs(f"{root}/branches")
    for name, tip in (("main", "c2"), ("bare", "")):
        with open(f"{root}/branches/{name}", "w") as f:
            f.write(tip)
    assert [tuple(r) for r in layout.read_branches(spark, root).collect()] in ([("bare", ""), ("main", "c2")], [("main", "c2")])
    with open(f"{root}/HEAD", "w") as f:
        f.write("ref: branches/main")
    assert layout.read_head(spark, root) == "main"
    assert layout.read_index(spark, root).isEmpty()
    with open(f"{root}/index.json", "w") as f:
        f.write('[{"Path":"a.txt","Blocks":null}]')
    assert [tuple(r) for r in layout.read_index(spark, root).collect()] == [("a.txt", [])]
    with open(f"{root}/commits/bad.json", "w") as f:
        f.write("{torn")
    with pytest.raises(Exception):
        layout.read_commits(spark, root).collect()


def side(spark, rows):
    return spark.createDataFrame([(p, None if b is None else [(h, 1) for h in b]) for p, b in rows.items() if b is not None], f"path string, blocks {diff.BLOCKS}")


def test_merge_table(spark):
    base = {"same": "x", "ours": "x", "theirs": "x", "del-t": "x", "del-o": "x", "keep": "x", "clash": "x", "lost": "x", "gone": "x", "empty": ""}
    ours = {"same": "y", "ours": "y", "theirs": "x", "del-t": "x", "keep": "y", "clash": "y", "new-o": "n", "both": "o", "empty": "z"}
    theirs = {"same": "y", "ours": "x", "theirs": "y", "del-o": "x", "clash": "z", "lost": "y", "new-t": "n", "both": "t", "empty": ""}
    v = diff.merge_verdicts(side(spark, base), side(spark, ours), side(spark, theirs), ["path"])
    got = {r["path"]: r["verdict"] for r in v.collect()}
    assert got == {"same": "same", "ours": "ours", "theirs": "theirs", "del-t": "deleted-by-theirs", "del-o": "deleted-by-ours", "keep": "ours-kept-silently", "clash": "conflict", "lost": "conflict", "gone": "gone", "new-o": "ours", "new-t": "theirs", "both": "conflict", "empty": "ours"}
    files = {r["path"]: (r["blocks"][0]["hash"] if r["blocks"] else "", r["conflict"]) for r in diff.merged(v).collect()}
    assert files["clash"] == ("y", True) and files["clash.MERGE_THEIRS"] == ("z", True) and files["lost.MERGE_THEIRS"] == ("y", True)
    assert "lost" not in files and files["keep"] == ("y", False) and "del-t" not in files and "gone" not in files


def test_status_table(spark):
    head = {"staged-mod": "x", "staged-same": "x", "mod": "x", "deleted": "x", "clean": "x"}
    staged = {"staged-new": "x", "staged-mod": "y", "staged-same": "x"}
    work = {"mod": "y", "clean": "x", "untracked": "x"}
    run = lambda **k: {r["path"]: r["staged"] + r["unstaged"] for r in diff.status(side(spark, head), side(spark, staged), side(spark, work), ["path"], **k).collect()}
    want = {"staged-new": "A ", "staged-mod": "M ", "staged-same": "D ", "mod": " M", "deleted": " D", "untracked": "??"}
    assert run() == want
    del want["untracked"]
    assert run(show_untracked=False) == want


def test_fileset_id_ignores_order_and_paths(spark):
    one = spark.createDataFrame([("f", "b", [("2", 1)]), ("f", "a", [("1", 1), ("3", 1)]), ("g", "x", [("1", 9), ("3", 1)]), ("g", "y", [("2", 1)]), ("g", "e", [])], f"fileset_id string, path string, blocks {diff.BLOCKS}")
    got = {r["fileset_id"]: r["content_id"] for r in blocks.fileset_ids(one, chunking.xxh3).collect()}
    assert got["f"] == got["g"] == chunking.block_hash(b"1\n3\n2\n")
