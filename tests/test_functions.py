import random
from io import BytesIO

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataforge.functions import chunking, glob, normal, strings
from strataforge.sources import worktree

# fixed values: the glob cases that the behaviour is defined by
GLOBS = """
foo.txt foo.txt 1|foo.txt bar.txt 0|*.txt foo.txt 1|*.txt bar.log 0|foo* foobar 1|foo* barfoo 0|file?.txt file1.txt 1|file?.txt file12.txt 0
dir/*.txt dir/foo.txt 1|dir/*.txt dir/sub/foo.txt 0|dir/** dir/foo.txt 1|dir/** dir/sub/foo.txt 1|dir/** dir/sub/deep/foo.txt 1|dir/** other/foo.txt 0|dir/** dir 1
dir/**/foo.txt dir/foo.txt 1|dir/**/foo.txt dir/sub/foo.txt 1|dir/**/foo.txt dir/a/b/c/foo.txt 1|dir/**/foo.txt dir/bar/baz.txt 0|dir/**/ dir/sub 1|dir/**/ dir/sub/deep 1|dir/**/ other 0
**/*.txt a.txt 1|**/*.txt a/b/c.txt 1|**/*.txt a/b/c.log 0|**/foo.txt foo.txt 1|**/foo.txt a/foo.txt 1|**/foo.txt a/b/foo.txt 1|**/foo.txt a/b/c/bar.txt 0|**/*.log foo/bar/baz.log 1
config/*.yml config/test.yml 1|config/*.yml config/sub/test.yml 0|build/** build/output/file.txt 1|build/** docs/file.txt 0|** foo/bar 1|** - 1|- - 1|- foo 0
foo/**/bar foo/bar 1|foo/**/bar foo/x/bar 1|foo/**/bar foo/x/y/z/bar 1|foo/**/bar bar/foo/bar 0|a/**/** a 1|a/**/**/b a/b 1
[ab].c a.c 1|[^ab].c a.c 0|[^ab].c x.c 1|[a-c]x bx 1|[a-c]x dx 0|[ [ 0|[] x 0|a\\*b a*b 1|a\\*b axb 0|a.b axb 0|[z-a] b 0
"""


def cases():
    for line in GLOBS.strip().split("\n"):
        for case in line.split("|"):
            pattern, path, hit = case.split()
            yield pattern.replace("\\\\", "\\").replace("-", "") if pattern == "-" else pattern.replace("\\\\", "\\"), "" if path == "-" else path, hit == "1"


def test_globs(spark):
    rows = [(pattern, path, hit) for pattern, path, hit in cases()]
    for pattern in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == pattern]
        df = spark.createDataFrame([(r[1],) for r in mine], "path string")
        got = {r["path"]: r["hit"] for r in df.select("path", glob.ignored(F.col("path"), [], [pattern]).alias("hit")).collect()}
        assert got == {r[1]: r[2] for r in mine}, pattern


def test_ignore_rules(spark):
    static, patterns = glob.rules(["# x", "", " exact.txt ", "temp.log", "*.bak", "logs/**", "**/*.tmp"])
    paths = {"exact.txt": 1, "temp.log": 1, "something.log": 0, "foo.bak": 1, "bar.txt": 0, "logs/file.log": 1, "logs/sub/deep.txt": 1, "notlogs/file.log": 0, "foo.tmp": 1, "deep/dir/file.tmp": 1, "deep/dir/file.txt": 0, ".strata": 1}
    df = spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string")
    got = {r["path"]: int(r["hit"]) for r in df.select("path", glob.ignored(F.col("path"), static, patterns).alias("hit")).collect()}
    assert got == paths | {None: 0}


def sequential(data, smallest, largest, modulus):
    table, ends, rolling, size = chunking.gear().tolist(), [], 0, 0
    for i, byte in enumerate(data):
        rolling, size = ((rolling << 1) + table[byte]) & 0xFFFFFFFF, size + 1
        if (size >= smallest and rolling % modulus == 0) or size >= largest:
            ends.append(i + 1)
            rolling = size = 0
    return ends + ([len(data)] if size else [])


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([(16, 64, 32), (12, 200, 4096), (64, 64, 16), (32, 256, 64)]))
def test_chunks_equal_the_sequential_rule(data, setting):
    ends = chunking.cut_points(data, *setting)
    assert ends == sequential(data, *setting)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert sum(sizes) == len(data) and all(s <= setting[1] for s in sizes) and all(s >= setting[0] for s in sizes[:-1])
    longer = chunking.cut_points(data + b"tail", *setting)
    assert longer[: max(len(ends) - 1, 0)] == ends[:-1]


def test_gear_table():
    words = chunking.gear()
    assert [hex(w) for w in words[:4]] == ["0x243f6a88", "0x85a308d3", "0x13198a2e", "0x3707344"]
    assert len(words) == 256 and not words[chunking.FILLED :].any()
    assert chunking.cut_points(b"\xff" * 5000, 1000, 3000, 4096) == [1000, 2000, 3000, 4000, 5000]
    assert chunking.cut_points(b"A" * (5 << 20))[-1] == 5 << 20
    with pytest.raises(ValueError):
        chunking.cut_points(b"x", 100, 200, 1000)


def test_streamed_files_cut_alike(monkeypatch):
    data = random.Random(3).randbytes(50_000)
    monkeypatch.setattr(worktree, "READ_BYTES", 777)
    pieces = list(worktree.split_stream(BytesIO(data), 64, 300, 64))
    assert b"".join(pieces) == data
    assert [len(p) for p in pieces] == [b - a for a, b in zip([0, *chunking.cut_points(data, 64, 300, 64)], chunking.cut_points(data, 64, 300, 64))]


def test_split_files(spark):
    df = spark.createDataFrame([("a", b"x" * 500), ("empty", b""), ("null", None)], "path string, content binary")
    got = chunking.split_files(df, 32, 256, 64).collect()
    assert {r["path"] for r in got} == {"a"} and sum(r["size"] for r in got) == 500
    assert all(len(r["hash"]) == 32 for r in got)


def test_normal_forms(spark):
    keys = {" AB\n": "ab", " x ": "x", "": None, " \t": None, None: None, "É ": "é", "a b": "a b"}
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert {r[0]: r[1] for r in df.select("k", normal.key(F.col("k"))).collect()} == keys
    assert {r[0]: r[1] for r in df.select("k", normal.element_key(F.col("k"))).collect()} == keys
    paths = {"a/b": "a/b", "a\\b": "a/b", "./a//b/.": "a/b", "a/../b": "b", "../a": "a", "a/b/../../c": "c", "..": "", "": "", "a/...": "a/...", "a./b": "a./b", "/a/": "a", "x/..y": "x/..y", None: None}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r[0]: r[1] for r in df.select("p", normal.clean_path(F.col("p"))).collect()} == paths


def test_months(spark):
    times = {"2024-01-31T23:30:00-02:00": "2024-02", "2024-01-01T00:00:00Z": "2024-01", "2024-01-01T00:30:00.5+05:30": "2023-12", "2024-02-30T00:00:00Z": None, "2024-01-01": None, "2024-01-01 00:00:00Z": None, "yesterday": None, "1700000000": None, "": None, None: None, "2024-01-01T00:00:00": None}
    df = spark.createDataFrame([(t,) for t in times], "t string")
    assert {r[0]: r[1] for r in df.select("t", normal.utc_month(normal.rfc3339(F.col("t")))).collect()} == times


def test_fingerprint_tells_nulls_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", "a"), (None, None)], "x string, y string")
    assert df.select(*normal.fingerprint(F.col("x"), F.col("y"))).distinct().count() == 4


def test_counting_rows(spark):
    df = spark.createDataFrame([("a", 1, "2024-01-01"), ("a", 2, "2024-01-03"), ("a", 3, "2024-01-02"), (None, 9, "2024-01-01"), ("b", None, None)], "id string, v int, t string").withColumn("arrived_at", F.col("t").cast("timestamp"))
    got = sorted((r["id"], r["v"], str(r["first_arrived"])[:10]) for r in normal.counting_rows(df, "id", ["v"]).collect())
    assert got == [("a", 2, "2024-01-01"), ("b", None, "None")]


def test_strings(spark):
    row = spark.range(1).select(strings.shorten(F.lit("x" * 100), 70).alias("a"), strings.shorten(F.lit("abcdefgh"), 5).alias("b"), strings.plain(F.lit("\x1b[31mred\x1b[0m")).alias("c"), strings.percent(F.lit(12.345)).alias("d"), strings.first_line(F.lit("a\n\nb")).alias("e"), strings.base_name(F.lit("x/y/z.txt")).alias("f"), strings.dotted(F.lit("ab"), 5).alias("g")).first()
    assert (len(row["a"]), row["b"], row["c"], row["d"], row["e"], row["f"], row["g"]) == (69, "abcde", "red", "12.3%", "a", "z.txt", "ab...")


def test_pack_round_trip(spark):
    texts = ["", "00ff", "abc", "ABCD", "é—", "0" * 64, "00f", None, "a b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normal.unpack(normal.pack(F.col("t"))).alias("u"), F.length(normal.pack(F.col("t"))).alias("n")).collect()
    assert all(r["t"] == r["u"] for r in rows)
    assert [r["n"] for r in rows if r["t"] == "0" * 64] == [33]
