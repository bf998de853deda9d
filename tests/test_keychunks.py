from collections import defaultdict
from datetime import datetime, timedelta

from strataforge.operators import keychunks
from strataforge.plans import corpus

T0 = datetime(2024, 1, 1)
SCHEMA = "k string, at timestamp, ref string, fp1 bigint, fp2 bigint, n_rows string, chunk_no int"


def brute(rows):
    seen, out = set(), defaultdict(list)
    for k, at, ref, a, b, *_ in rows:
        if k is not None and (k, a, b) not in seen:
            seen.add((k, a, b))
            out[k].append((at, ref))
    first = lambda v: min(v, key=lambda x: (x[0] is None, x[0] or T0, x[1] is None, x[1] or ""))[1]
    return {k: (len(v), first(v)) for k, v in out.items()}


def test_skewed_keys_nulls_ties_and_repeats(spark):
    rows = []
    for i in range(3000):  # one key holds a third and more
        k = "hot" if i % 3 else f"k{i % 50}"
        rows.append((k, T0 + timedelta(seconds=i % 7), f"r{i % 11:02d}", i % 900, i % 901, "clash", 5))
    rows += rows[:200] + [(None, T0, "x", 1, 1, None, None), ("n", None, "late", 1, 2, None, None), ("n", T0, None, 1, 3, None, None), ("only-null", None, None, 9, 9, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["k"]: (r["n_rows"], r["first_ref"]) for r in keychunks.key_states(df.drop("n_rows", "chunk_no"), ["k"], "at", "ref", ["fp1", "fp2"], chunk_rows=100).collect()}
    assert got == brute(rows)


def test_numbers_are_gapless_and_chunks_equal(spark):
    rows = [("hot", T0, f"r{i}", i * 7919, i, None, None) for i in range(1234)] + [("cold", T0, "r", i, i, None, None) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).drop("n_rows", "chunk_no")
    numbered = keychunks.number_rows(df, ["k"], ["at", "ref"], ["fp1", "fp2"], chunk_rows=100).collect()
    assert sorted(r["row_no"] for r in numbered if r["k"] == "hot") == list(range(1, 1235))
    sizes = defaultdict(int)
    for r in numbered:
        sizes[r["k"], r["chunk_no"]] += 1
    assert [sizes["hot", c] for c in range(13)] == [100] * 12 + [34]
    assert sizes["cold", 0] == 3


def test_numbers_follow_the_order_over_all_parts(spark):
    """Nulls come last; copies of one row, a third of all, count once."""
    rows = [("hot", T0 + timedelta(seconds=i * 37 % 2000) if i % 50 else None, f"r{i % 13}", i * 7919, i, None, None) for i in range(3000)]
    rows += [rows[1]] * 1500
    df = spark.createDataFrame(rows, SCHEMA).drop("n_rows", "chunk_no").repartition(5)
    got = sorted((r["row_no"], r["at"], r["ref"]) for r in keychunks.number_rows(df, ["k"], ["at", "ref"], ["fp1", "fp2"], chunk_rows=50).collect() if r["at"])
    assert [n for n, _, _ in got] == list(range(1, len(got) + 1))
    assert [x[1:] for x in got] == sorted(x[1:] for x in got)
    state = keychunks.key_states(df, ["k"], "at", "ref", ["fp1", "fp2"], chunk_rows=50).first()
    times = sorted(x[1] for x in {r[:5] for r in rows} if x[1])
    assert state["n_rows"] == 3000
    assert state["longest_gap"] == max((b - a) / timedelta(microseconds=1) for a, b in zip(times, times[1:]))


def test_more_heavy_keys_than_parts(spark, monkeypatch):
    monkeypatch.setattr(keychunks, "MAX_PARTS", 8)
    monkeypatch.setattr(keychunks, "CUT_BLOCK", 4)
    rows = [(f"k{i % 20}" if i % 2 else "hot", T0 + timedelta(seconds=i * 7919 % 5003), f"r{i}", i * 31, i, None, None) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).drop("n_rows", "chunk_no")
    got = {r["k"]: (r["n_rows"], r["first_ref"]) for r in keychunks.key_states(df, ["k"], "at", "ref", ["fp1", "fp2"], chunk_rows=20).collect()}
    assert got == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA).drop("n_rows", "chunk_no")
    assert keychunks.key_states(df, ["k"], "at", "ref", ["fp1", "fp2"]).collect() == []


def test_busy_rows_normalise_keys_and_paths(spark):
    refs = spark.createDataFrame(
        [("b", "F1", "a/b", 0, " AB\n", 1, 0, T0, T0, "x"), ("b", "f1 ", "a//b", 0, "ab", 1, 0, T0, T0, "y"), ("b", "f1", "a", 0, None, 1, 0, T0, T0, "z"), ("b", "f1", "a", 0, "  ", 1, 0, T0, T0, "z")],
        "branch string, fileset_id string, path string, seq int, hash string, size bigint, start_offset bigint, recorded_at timestamp, arrived_at timestamp, ref string",
    )
    checks = spark.createDataFrame([("H ", ["x\\y", "./x/y", None, ""], T0), (None, ["x/y"], T0), ("h", None, T0)], "hash string, files array<string>, checked_at timestamp")
    rows = corpus.busy_rows(refs, checks).distinct().collect()
    assert sorted((r["key_field"], r["key_value"], r["ref"]) for r in rows) == [("file", "x/y", "h"), ("hash", "ab", "f1")]
