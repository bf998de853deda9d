from datetime import datetime

import pytest

from strataforge.operators import compaction

T0 = datetime(2024, 1, 1)
SCHEMA = "file_name string, body string, modified_at timestamp, record_id string"

FILES = [
    ("commits/a.json", '{\n "id": "A1 ",\n "parents": []\n}', {("commit", "a1")}),
    ("commits/a (1).json", '﻿{"id":"a1"}\r\n', {("commit", "a1")}),
    ("commits/b.jsonl", '{"id": "b1"}\n{"id": "b2"}\r\n\n{"id": "b3", "mess', {("commit", "b1"), ("commit", "b2")}),
    ("blocks/x.json", '[{"hash": "h1"}, {"hash": null}, {"hash": " "}, 5, {"id": null, "hash": "h2"}]', {("block", "h1"), ("block", "h2")}),
    ("blocks/torn.json", '[{"hash": "h3"}, {"hash": "h4", "si', {("block", "h3")}),
    ("blocks/torn2.json", '{"hash": "h5", "si', set()),
    ("tmp-1", '{"id": "t"}', set()),
    ("x/.tmp-2", '{"id": "t"}', set()),
    ("x/notmp-2.bak", '{"id": "kept", "message": "a}\\n{"}', {("commit", "kept")}),
    ("e.json", "", set()),
    ("n.json", None, set()),
    ("null.json", "null", set()),
    ("nested.json", '{"x": {"id": "inner"}}', set()),
    (None, '{"id": "noname"}', {("commit", "noname")}),
    ("several.json", '{\n"id": "m1"\n}\n{\n"id": "m2"\n}', {("commit", "m1"), ("commit", "m2")}),
]


def loose(spark, files=FILES):
    return spark.createDataFrame([(n, b, T0, "clash") for n, b, _ in files], SCHEMA)


def ids(df):
    return sorted((r["record_kind"], r["record_id"]) for r in df.collect())


@pytest.mark.parametrize("small", [0, 10_000])
def test_every_record_once(spark, tmp_path, small):
    table = compaction.VersionedTable(spark, str(tmp_path / f"t{small}"))
    got = ids(compaction.compact(loose(spark), table, small_files=small))
    assert got == sorted(set().union(*[w for _, _, w in FILES]))
    assert table.version() == (1 if small == 0 else 0)


def test_second_delivery_rewrites_only_touched_partitions(spark, tmp_path):
    table = compaction.VersionedTable(spark, str(tmp_path / "t"))
    compaction.compact(loose(spark), table, small_files=0)
    before = {p: sorted(x.name for x in p.iterdir()) for p in (tmp_path / "t" / "data").glob("*/*")}
    more = loose(spark, [("c/n.json", '{"id": "n1"}', None), ("c/o.json", '{"id": "a1"}', None)])
    got = ids(compaction.compact(more, table, small_files=0))
    assert got == sorted(set().union(*[w for _, _, w in FILES]) | {("commit", "n1")})
    after = {p: sorted(x.name for x in p.iterdir()) for p in (tmp_path / "t" / "data").glob("*/*")}
    assert {p.parent.name for p in after if after[p] != before.get(p)} == {"record_kind=commit"}
    assert table.version() == 2


def one(spark, kind, name):
    return spark.createDataFrame([(kind, name, "{}", "f", 0, T0, 0)], compaction.TABLE), spark.createDataFrame([(kind, 0)], "record_kind string, bucket int")


def test_conflicting_writers(spark, tmp_path):
    table = compaction.VersionedTable(spark, str(tmp_path / "t"))
    rows, part = one(spark, "commit", "a")
    table.rewrite(rows, part, 0)
    with pytest.raises(compaction.Conflict):
        table.rewrite(rows, part, 0)
    assert table.rewrite(*one(spark, "block", "a"), 0) == 2
    assert table.read(compaction.TABLE).count() == 2


def test_a_writer_overtaken_between_write_and_commit_loses_nothing(spark, tmp_path, monkeypatch):
    """B starts after A and commits while A has written but not committed: A must fail."""
    table, other = (compaction.VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    publish, begun = table._publish, []

    def late(version, notes):
        if not begun:
            begun.append(compaction.compact(loose(spark, [("b", '{"id": "fromb"}', None)]), other, small_files=0))
        return publish(version, notes)

    monkeypatch.setattr(table, "_publish", late)
    with pytest.raises(compaction.Conflict):
        compaction.compact(loose(spark, [("a", '{"id": "froma"}', None)]), table, small_files=0)
    assert ids(other.read(compaction.TABLE)) == [("commit", "fromb")]
    assert ids(compaction.compact(loose(spark, [("a", '{"id": "froma"}', None)]), table, small_files=0)) == [("commit", "froma"), ("commit", "fromb")]
    assert table.versions() == [1, 2]


def test_a_record_of_table_and_loose_files_comes_once(spark, tmp_path):
    table = compaction.VersionedTable(spark, str(tmp_path / "t"))
    compaction.compact(loose(spark, [("a", '{"id": "a1"}\n{"id": "b1"}', None)]), table, small_files=0)
    assert ids(compaction.compact(loose(spark, [("b", '{"id": "a1"}', None)]), table)) == [("commit", "a1"), ("commit", "b1")]
    mixed = loose(spark, [("b", '{"id": "a1"}', None), ("c", '{"hash": "h"}', None), ("d", '{"hash": "h"}', None)])
    assert ids(compaction.compact(mixed, table, small_files=1)) == [("block", "h"), ("commit", "a1"), ("commit", "b1")]


def test_a_reader_keeps_its_version(spark, tmp_path):
    table = compaction.VersionedTable(spark, str(tmp_path / "t"))
    compaction.compact(loose(spark, [("a", '{"id": "a1"}', None)]), table, small_files=0)
    held = table.read(compaction.TABLE)
    compaction.compact(loose(spark, [("b", '{"id": "b1"}', None)]), table, small_files=0)
    assert ids(held) == [("commit", "a1")]
    assert ids(table.read(compaction.TABLE, 1)) == [("commit", "a1")]
    assert ids(table.read(compaction.TABLE)) == [("commit", "a1"), ("commit", "b1")]
    assert table.vacuum(2) == 1
    assert ids(table.read(compaction.TABLE)) == [("commit", "a1"), ("commit", "b1")]


def test_buckets_follow_the_table(spark, tmp_path):
    table = compaction.VersionedTable(spark, str(tmp_path / "t"))
    want = []
    for n in range(3):
        files = [(f"{n}-{i}", f'{{"id": "c{n}-{i}"}}', None) for i in range(30)]
        want += [("commit", f"c{n}-{i}") for i in range(30)]
        assert ids(compaction.compact(loose(spark, files), table, small_files=0, target_bytes=300)) == sorted(want)
    assert table.manifest(3)["buckets"] > table.manifest(1)["buckets"]
    assert ids(table.read(compaction.TABLE, 2)) == sorted(want[:60])


def test_no_files(spark, tmp_path):
    table = compaction.VersionedTable(spark, str(tmp_path / "t"))
    assert compaction.compact(loose(spark, []), table).collect() == []
