from datetime import datetime, timedelta

import numpy as np
import pytest

from strataforge.operators import snapshots

T0 = datetime(2024, 1, 1)
BLOCKS = "array<struct<hash:string,size:bigint,start_offset:bigint>>"
SCHEMA = f"id string, branch string, taken_at timestamp, arrived_at timestamp, files array<struct<path:string,blocks:{BLOCKS}>>, snap_no string, bucket int"


def row(id, day, files, branch="main", arrived=0):
    files = None if files is None else [(p, b) for p, b in files]
    return (id, branch, T0 + timedelta(days=day), T0 + timedelta(days=day, seconds=arrived), files, "clash", 1)


def changes(spark, rows):
    return sorted(tuple(r) for r in snapshots.changes(spark.createDataFrame(rows, SCHEMA)).collect())


def b(h, size=1, at=0):
    return (h, size, at)


def test_rules(spark):
    rows = [
        row("S1", 0, [("a", [b("x")]), ("c", None), ("dup", [b("x")]), ("dup", [b("y")]), ("same", [b("x", 1, 0)])]),
        row("s2 ", 1, None),  # not delivered
        row("s3", 2, [("./a", [b(" X")]), ("c", []), ("dup", [b("x")]), ("n\\new", [b("q")]), ("same", [b("x", 1, 9)]), (None, [b("q")])]),
        row("s3", 2, [("a", [b("z")])], arrived=5),  # corrected delivery
        row("s4", 3, []),
        row("s4", 3, []),
        row("o1", 0, [("a", [b("x")])], "other"),
        row("o2", 9, [("a", [b("x", 2)])], " OTHER"),
        row(None, 5, [("a", [])]),
        row("nb", 5, [("a", [])], None),
    ]
    assert changes(spark, rows) == sorted([("s3", "a", "changed"), ("s3", "c", "removed"), ("s3", "dup", "removed"), ("s3", "same", "removed"), ("s4", "a", "removed"), ("o2", "a", "changed")])
    rows = rows[:3]
    assert changes(spark, rows) == [("s3", "dup", "changed"), ("s3", "n/new", "added")]
    assert changes(spark, []) == []


def test_against_brute_force_over_runs_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "RUN_SNAPSHOTS", 4)
    monkeypatch.setattr(snapshots, "BUCKET_ROWS", 60)
    rng = np.random.default_rng(1)
    rows, want = [], []
    for branch, n in (("hot", 23), ("cold", 3)):
        before = None
        for i in range(n):
            state = {f"p{k}": f"h{rng.integers(3)}" for k in range(30) if rng.random() < 0.7}
            id = f"{branch}-{i}"
            rows.append(row(id, i, [(p, [b(h)]) for p, h in state.items()], branch))
            if before is not None:
                want += [(id, p, "added") for p in state.keys() - before.keys()] + [(id, p, "removed") for p in before.keys() - state.keys()]
                want += [(id, p, "changed") for p in state.keys() & before.keys() if state[p] != before[p]]
            before = state
    assert changes(spark, rows) == sorted(want)


def test_gaps_in_a_bucket(spark, monkeypatch):
    """Snapshots without any path in a bucket, at the ends and inside of runs."""
    monkeypatch.setattr(snapshots, "RUN_SNAPSHOTS", 3)
    there = [(), ("a",), (), (), ("a", "b"), ("b",), (), ("b",), ("b",), ()]
    rows = [row(f"s{i}", i, [(p, [b("x")]) for p in names]) for i, names in enumerate(there)]
    want = [(f"s{i}", p, "added") for i in range(1, len(there)) for p in set(there[i]) - set(there[i - 1])] + [(f"s{i}", p, "removed") for i in range(1, len(there)) for p in set(there[i - 1]) - set(there[i])]
    assert changes(spark, rows) == sorted(want)


def test_kept_ordinals_stay(spark):
    first = [row("s1", 0, [("b", [b("x")]), ("d", [b("x")])])]
    both = [*first, row("s2", 1, [("a", [b("x")]), ("b", [b("y")]), ("c", None)])]
    table = snapshots.ordinals(spark.createDataFrame(first, SCHEMA))
    old = {r["path"]: r["ordinal"] for r in table.collect()}
    kept = spark.createDataFrame(table.collect(), table.schema)
    new = {r["path"]: r["ordinal"] for r in snapshots.ordinals(spark.createDataFrame(both, SCHEMA), kept).collect()}
    assert old == {"b": 0, "d": 1}
    assert new == {"b": 0, "d": 1, "a": 2, "c": 3}
    got = sorted(map(tuple, snapshots.changes(spark.createDataFrame(both, SCHEMA), kept).collect()))
    assert got == changes(spark, both) == [("s2", "a", "added"), ("s2", "b", "changed"), ("s2", "c", "added"), ("s2", "d", "removed")]


@pytest.mark.parametrize("limit", [0, 10_000])
def test_containers(monkeypatch, limit):
    monkeypatch.setattr(snapshots, "ARRAY_MAX", limit)
    x, y = snapshots.Container(np.array([1, 3, 5, 900]), 1000), snapshots.Container(np.array([3, 4, 900]), 1000)
    assert x.and_not(y).tolist() == [1, 5] and y.and_not(x).tolist() == [4] and x.both(y).tolist() == [3, 900]
