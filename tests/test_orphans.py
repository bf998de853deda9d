from collections import Counter
from datetime import datetime, timedelta

from strataforge.operators import orphans
from strataforge.plans import corpus

T0 = datetime(2024, 1, 1)
DAY = timedelta(days=1)


def test_heavy_and_light_keys_agree(spark):
    refs = [("f", f"r{i}", "gone" if i % 2 else f"k{i % 9}", "2024-01", T0) for i in range(400)] + [("f", "r", None, "2024-01", T0), ("g", "r", "gone", "unknown", None)]
    targets = [("f", f"k{i}", T0 + (DAY if i % 3 == 0 else -DAY), T0 if i % 4 == 0 else None) for i in range(8)] + [("f", "unused", T0, None)]
    refs = spark.createDataFrame(refs, "ref_field string, record_id string, target_key string, ref_month string, ref_arrived timestamp")
    targets = spark.createDataFrame(targets, "ref_field string, target_key string, first_arrived timestamp, deleted_at timestamp")
    plain = sorted(map(tuple, orphans.unresolved(refs, targets).collect()))
    keys = orphans.heavy_keys(refs.where("target_key is not null"), heavy_rows=20)
    assert keys.count() > 0
    assert sorted(map(tuple, orphans.unresolved(refs, targets, keys).collect())) == plain
    counts = Counter((r[0], r[3], r[4]) for r in plain)
    assert {(r[0], r[1], r[2]): r["n_refs"] for r in orphans.orphan_counts(refs, targets, keys).collect()} == counts
    states = {(r[2], r[4]) for r in plain}
    assert states == {("gone", "missing"), ("k8", "missing"), ("k0", "deleted"), ("k4", "deleted"), ("k3", "late"), ("k6", "late")}
    assert len([r for r in plain if r[2] == "gone"]) == 201


def test_empty_tables(spark):
    refs = spark.createDataFrame([], "ref_field string, record_id string, target_key string, ref_month string, ref_arrived timestamp")
    targets = spark.createDataFrame([], "ref_field string, target_key string, first_arrived timestamp, deleted_at timestamp")
    assert orphans.unresolved(refs, targets).collect() == []
    one = spark.createDataFrame([("f", "r", "k", "m", None)], refs.schema)
    assert [r["ref_state"] for r in orphans.unresolved(one, targets).collect()] == ["missing"]


def test_references_count_once_and_take_the_counting_row(spark):
    commits = spark.createDataFrame(
        [(" C1", ["P", "p ", "", None], "b", "m", "2024-01-31T23:30:00-02:00", "F", T0, None), ("c1", ["q"], "b", "m", "yesterday", "f", T0 + DAY, None), ("c2", None, None, None, None, " ", T0, None), (None, ["x"], "b", "m", "", "f", T0, None)],
        "id string, parents array<string>, branch string, message string, commit_time string, fileset_id string, arrived_at timestamp, deleted_at timestamp",
    )
    refs = spark.createDataFrame([("F1", "h", T0, T0 + DAY), ("f1", "H", T0, T0), ("f1", None, T0, T0)], "fileset_id string, hash string, recorded_at timestamp, arrived_at timestamp")
    got = sorted(map(tuple, corpus.references(commits, refs).collect()))
    assert got == [("block_refs.hash", "f1", "h", "2024-01", T0), ("commits.fileset_id", "c1", "f", "unknown", T0), ("commits.parents", "c1", "q", "unknown", T0)]
    got = sorted(map(tuple, corpus.references(commits.limit(1), refs.limit(0)).collect()))
    assert got == [("commits.fileset_id", "c1", "f", "2024-02", T0), ("commits.parents", "c1", "p", "2024-02", T0)]


def test_the_split_stays_on_with_more_heavy_keys_than_fit(spark, monkeypatch):
    """Then the heaviest are taken."""
    monkeypatch.setattr(orphans, "HEAVY_KEYS", 10)
    sizes = {f"k{i}": 30 for i in range(40)} | {"hot": 3000}
    rows = [("f", f"r{n}", k, "m", T0) for k, c in sizes.items() for n in range(c)]
    refs = spark.createDataFrame(rows, "ref_field string, record_id string, target_key string, ref_month string, ref_arrived timestamp")
    keys = orphans.heavy_keys(refs, heavy_rows=20)
    assert [r["target_key"] for r in keys.collect()] == ["hot"]
    targets = spark.createDataFrame([], "ref_field string, target_key string, first_arrived timestamp, deleted_at timestamp")
    assert orphans.unresolved(refs, targets, keys).count() == len(rows)
