import random

from pyspark.sql import functions as F

from strataforge.operators import graph, hierarchy
from strataforge.plans import corpus


def brute(parent):
    out = {}
    for v in parent:
        seen, at = [v], v
        while True:
            p = parent[at]
            if p is None or p not in parent:
                out[v] = (at, len(seen) - 1, list(reversed(seen)))
                break
            if p in seen:
                circle = seen[seen.index(p) :]
                out[v] = (min(circle), -1, None)
                break
            seen.append(p)
            at = p
    return out


def forest():
    rng, parent = random.Random(5), {}
    for t in range(6):
        for i in range(40):
            parent[f"t{t}-{i:02d}"] = None if i == 0 else f"t{t}-{rng.randrange(i):02d}"
    for i in range(300):  # a long chain
        parent[f"c{i:03d}"] = f"c{i - 1:03d}" if i else "unknown"
    for i in range(200):  # a star: one parent with most children
        parent[f"s{i:03d}"] = "s000" if i else None
    parent |= {"x1": "x3", "x2": "x1", "x3": "x2", "y": "x2", "z": "y", "self": "self", "t0-own": "t0-39"}
    return parent


def test_hierarchy_and_its_paths(spark):
    parent = forest()
    rows = list(parent.items())
    links = spark.createDataFrame([*rows, *rows[:20], (None, "t0-00")], "id string, parent string")
    tree = hierarchy.hierarchy(links).cache()
    got = {r["id"]: r for r in tree.collect()}
    want = brute(parent)
    assert {k: (r["root_id"], r["depth"]) for k, r in got.items()} == {k: w[:2] for k, w in want.items()}
    below = {v: sum(1 for w in want.values() if w[2] and v in w[2][:-1]) for v in parent if want[v][1] >= 0}
    assert {k: r["n_descendants"] for k, r in got.items() if r["depth"] >= 0} == below
    assert max(len(r["segments"]) for r in got.values() if r["segments"]) <= 10
    wanted = spark.createDataFrame([("c299",), ("t3-39",), ("s100",), ("x1",)], "id string")
    steps = {}
    for r in hierarchy.paths(tree, wanted).orderBy("id", "step").collect():
        steps.setdefault(r["id"], []).append(r["node"])
    assert steps == {k: want[k][2] for k in ("c299", "t3-39", "s100")}
    some = spark.createDataFrame([("t1-00",), ("c290",)], "id string")
    under = {}
    for r in hierarchy.descendants(tree, some).collect():
        under.setdefault(r["id"], set()).add(r["descendant"])
    assert under == {v: {u for u, w in want.items() if w[2] and v in w[2][:-1]} for v in ("t1-00", "c290")}


def test_paths_of_all_tips(spark, tmp_path):
    parent = forest()
    rows = [(k, [p] if p else [], None) for k, p in parent.items()]
    tips = ["c299", "c150", " C010", "c010", "t3-39", "t3-20", "t3-00", "s100", "s101", "x1", "z", "self", "nowhere", "", None]
    spark.createDataFrame(rows, "id string, parents array<string>, arrived_at timestamp").write.parquet(f"{tmp_path}/commits.parquet")
    spark.createDataFrame([(t,) for t in tips], "tip string").write.parquet(f"{tmp_path}/branches.parquet")
    got = {}
    for r in corpus.p5_tip_paths(spark, str(tmp_path)).orderBy("tip_id", "step").collect():
        got.setdefault(r["tip_id"], []).append((r["step"], r["commit_id"]))
    want = brute(parent)
    assert got == {t: list(enumerate(want[t][2])) for t in ("c299", "c150", "c010", "t3-39", "t3-20", "t3-00", "s100", "s101")}


def test_every_path_and_all_descendants(spark, tmp_path):
    parent = forest()
    rows = [(k, [p] if p else [], None) for k, p in parent.items()]
    spark.createDataFrame(rows, "id string, parents array<string>, arrived_at timestamp").write.parquet(f"{tmp_path}/commits.parquet")
    got = {r["id"]: r for r in corpus.QUERIES["p5_hierarchy"](spark, str(tmp_path)).collect()}
    want = brute(parent)
    assert {k: r["root_id"] for k, r in got.items()} == {k: w[0] for k, w in want.items()}
    assert all(r["segments"] is r["first"] is r["last"] is None for k, r in got.items() if want[k][1] < 0)
    inside = {k: r for k, r in got.items() if want[k][1] >= 0}
    node = {tuple(r["segments"][-1]): k for k, r in inside.items()}
    path = lambda r: [node[s["head"], at] for s in r["segments"] for at in range(s["upto"] + 1)]
    assert {k: path(r) for k, r in inside.items()} == {k: want[k][2] for k in inside}
    below = {k: {u for u, x in inside.items() if x["root_id"] == r["root_id"] and r["first"] < x["first"] <= r["last"]} for k, r in inside.items()}
    assert below == {k: {u for u in inside if k in want[u][2][:-1]} for k in inside}


def test_no_links(spark):
    assert hierarchy.hierarchy(spark.createDataFrame([], "id string, parent string")).collect() == []


def dag():
    rng, parents = random.Random(11), {}
    for g in range(12):
        for i in range(25):
            ps = [f"g{g}-{rng.randrange(max(0, i - 6), i):02d}" for _ in range(rng.choice([1, 1, 1, 2, 3]))] if i else []
            if rng.random() < 0.1:
                ps.insert(0, None)
            parents[f"g{g}-{i:02d}"] = ps
    parents |= {"a": ["b"], "b": ["a"], "in": ["a", "g0-03"]}
    return parents


def closure(parents, start):
    order, seen = [start], {start}
    for v in order:
        for p in parents.get(v, []):
            if p is not None and p in parents and p not in seen:
                seen.add(p)
                order.append(p)
    return order


def test_ancestors_and_merge_bases_like_a_queue(spark):
    parents = dag()
    commits = spark.createDataFrame(list(parents.items()), "id string, parents array<string>")
    compressed = graph.Compressed(commits)
    rng = random.Random(2)
    pairs = [(f"q{g}-{k}", f"g{g}-{rng.randrange(15, 25)}", f"g{g}-{rng.randrange(15, 25)}") for g in range(12) for k in range(6)] + [("none", "g1-20", "g2-20"), ("circle", "in", "b")]
    df = spark.createDataFrame(pairs, "query string, a string, b string")
    got = {r["query"]: r["base"] for r in compressed.merge_bases(df).collect()}
    assert got == {q: next((x for x in closure(parents, b) if x in set(closure(parents, a))), None) for q, a, b in pairs}
    found = {}
    for r in compressed.ancestors(df.select("query", F.col("a").alias("id"))).collect():
        found.setdefault(r["query"], []).append(r["id"])
    assert {q: sorted(v) for q, v in found.items()} == {q: sorted(closure(parents, a)) for q, a, _ in pairs}


def test_first_parent_chain_stops_at_circles(spark):
    commits = spark.createDataFrame([("A", ["B"]), ("B", ["A"]), ("r", []), ("s", ["r", "A"]), ("t", [None, "r"])], "id string, parents array<string>")
    tips = spark.createDataFrame([("A",), ("s",), ("t",)], "id string")
    got = sorted(map(tuple, graph.first_parent_chain(commits, tips).collect()))
    assert got == [("A", 0, "A"), ("A", 1, "B"), ("s", 0, "s"), ("s", 1, "r"), ("t", 0, "t")]
    assert sorted(r["id"] for r in graph.history(commits, tips).collect()) == ["A", "B", "r", "s", "t"]
