from strataforge.operators import blocks
from strataforge.plans import catalog


def test_listing_names_all_files_and_branches(spark):
    many = [f"dir/file{i:02d}.txt" for i in range(20)]
    rows = [("dev", "b.txt", 0, "h1", 5), ("main", "a.txt", 0, "h1", 5), ("main", "b.txt", 0, "h1", 5), *[("main", p, 1, "h2", 7) for p in many]]
    got = {r["hash"]: (r["files"], r["branches"]) for r in blocks.inventory_listing(spark.createDataFrame(rows, "branch string, path string, seq int, hash string, size bigint")).collect()}
    joined = ",".join(many)
    assert got == {"h1": ("a.txt,b.txt", "dev,main"), "h2": (joined[:33] + "..." + joined[-33:], "main")}
    assert "block_list_all_files" in catalog.QUERIES
