"""Who may see what: search and listing filters, resource rule, tag hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import written

DEFAULT_TAG = "DEFAULT"


def visible(user_id: int, tags: list[str]) -> Column:
    """Mine, public, or of one of my effective tags."""
    return F.coalesce((F.col("user_id") == user_id) | F.col("is_public") | F.col("org_tag").isin(*tags), F.lit(False))


def resource_allowed(username: str, role: str, tags: list[str]) -> Column:
    """The rule for a single resource: no hierarchy, and private tags are for their owner alone."""
    tag = F.col("org_tag")
    open_ = F.col("is_public") | tag.isNull() | (tag == "") | (tag == DEFAULT_TAG) | (F.col("user_id").cast("string") == username) | F.lit(role == "ADMIN")
    return F.coalesce(F.when(open_, True).when(tag.startswith("PRIVATE_"), False).otherwise(tag.isin(*tags)), F.lit(False))


def ancestors(tags: DataFrame) -> DataFrame:
    """tag and ancestor: every tag with each tag above it, however far.

    Pairs are doubled: those that are known are joined to each other until none is new, so a hierarchy of depth n takes about
    log2(n) rounds over the tag table alone. Each round is a table in the shared folder. In a cycle each tag is an ancestor of
    every other and of itself. A parent without a row of its own is an ancestor like any other.
    """
    known = written(tags.where("parent_tag IS NOT NULL").select(F.col("tag_id").alias("tag"), F.col("parent_tag").alias("ancestor")).distinct(), "ancestors")
    n = known.count()
    while n:
        up = known.select(F.col("tag").alias("ancestor"), F.col("ancestor").alias("further"))
        more = written(known.union(known.join(up, "ancestor").select("tag", F.col("further").alias("ancestor"))).distinct(), "ancestors")
        if (m := more.count()) == n:
            break
        known, n = more, m
    return known


def effective_tags(users: DataFrame, tags: DataFrame) -> DataFrame:
    """id and tag: own tags that exist or not, all their ancestors, and the default tag. Users are joined once."""
    own = users.select("id", F.explode(F.split("org_tags", ",")).alias("tag"))
    above = own.join(ancestors(tags), "tag").select("id", F.col("ancestor").alias("tag"))
    return own.union(above).union(users.select("id", F.lit(DEFAULT_TAG))).distinct()


def tag_tree(tags: DataFrame) -> DataFrame:
    """tag_id, parent_tag, path from the root and depth of the tags that hang from a root; those on or below a cycle, or below a
    tag that isn't there, have no path."""
    up = ancestors(tags)
    depth = tags.select("tag_id", "parent_tag").distinct().join(up.groupBy("tag").agg(F.count("*").cast("int").alias("depth")), F.col("tag_id") == F.col("tag"), "left")
    depth = depth.select("tag_id", "parent_tag", F.coalesce("depth", F.lit(0)).alias("depth"))
    # a tag's ancestors form a chain, in the order of their own depths
    place = F.struct(F.col("d.depth").alias("depth"), "ancestor")
    chain = up.join(depth.alias("d"), F.col("ancestor") == F.col("d.tag_id"), "left").groupBy("tag").agg(F.array_sort(F.collect_list(F.when(F.col("d.tag_id").isNotNull(), place))).alias("chain"))
    both = depth.join(chain, F.col("tag_id") == F.col("tag"), "left").withColumn("chain", F.coalesce("chain", F.array()))
    whole = (F.size("chain") == F.col("depth")) & F.forall(F.transform("chain", lambda c, i: c["depth"] == i), lambda x: x)
    names = F.concat(F.transform("chain", lambda c: c["ancestor"]), F.array("tag_id"))
    return both.where(whole).select("tag_id", "parent_tag", F.array_join(names, "/").alias("path"), "depth")


def reparenting_cycles(tags: DataFrame, moves: DataFrame) -> DataFrame:
    """tag_id, new_parent and would_cycle: whether the new parent lies below the tag, or is it."""
    below = ancestors(tags).select(F.col("tag").alias("new_parent"), F.col("ancestor").alias("tag_id"), F.lit(True).alias("below"))
    asked = moves.select("tag_id", "new_parent").distinct()
    return asked.join(below, ["tag_id", "new_parent"], "left").select("tag_id", "new_parent", F.coalesce(F.col("below") | (F.col("tag_id") == F.col("new_parent")), F.col("tag_id") == F.col("new_parent"), F.lit(False)).alias("would_cycle"))
