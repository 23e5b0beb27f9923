"""The tag hierarchy: deep chains, cycles, missing parents, and many users."""

from pyspark.sql import functions as F

from tessera.operators import access

TAGS = "tag_id string, parent_tag string, name string"


def chain(n):
    return [(f"t{i}", f"t{i - 1}" if i else None, "x") for i in range(n)]


def test_deep_chains_and_cycles(spark):
    rows = chain(150) + [("a", "b", ""), ("b", "c", ""), ("c", "a", ""), ("d", "c", ""), ("e", "gone", ""), ("f", "e", ""), ("alone", None, "")]
    tags = spark.createDataFrame(rows, TAGS)
    up = {}
    for r in access.ancestors(tags).collect():
        up.setdefault(r["tag"], set()).add(r["ancestor"])
    assert up["t149"] == {f"t{i}" for i in range(149)} and "t0" not in up
    assert up["a"] == up["b"] == up["c"] == up["d"] == {"a", "b", "c"} and up["f"] == {"e", "gone"}
    tree = {r["tag_id"]: (r["path"], r["depth"]) for r in access.tag_tree(tags).collect()}
    assert set(tree) == {f"t{i}" for i in range(150)} | {"alone"}
    assert tree["t149"] == ("/".join(f"t{i}" for i in range(150)), 149) and tree["alone"] == ("alone", 0)
    moves = spark.createDataFrame([("t3", "t140"), ("t140", "t3"), ("t3", "t3"), ("a", "d"), ("f", "nobody"), ("f", None)], "tag_id string, new_parent string")
    assert [r[2] for r in access.reparenting_cycles(tags, moves).orderBy("tag_id", "new_parent").collect()] == [True, False, False, False, True, True]


def test_two_million_users(spark):
    tags = spark.createDataFrame(chain(12), TAGS)
    users = spark.range(2_000_000).select("id", F.concat(F.lit("t"), F.col("id") % 12, F.lit(",PRIVATE_"), "id").alias("org_tags"))
    got = access.effective_tags(users, tags)
    assert got.count() == sum(2_000_000 // 12 * (i + 1) + (2_000_000 % 12 > i) * (i + 1) for i in range(12)) + 4_000_000
    assert {r["tag"] for r in got.where("id = 2").collect()} == {"t0", "t1", "t2", "PRIVATE_2", "DEFAULT"}


def test_no_tags(spark):
    tags = spark.createDataFrame([], TAGS)
    users = spark.createDataFrame([(1, "x"), (2, None)], "id long, org_tags string")
    assert sorted(map(tuple, access.effective_tags(users, tags).collect())) == [(1, "DEFAULT"), (1, "x"), (2, "DEFAULT")]
    assert access.tag_tree(tags).count() == 0
