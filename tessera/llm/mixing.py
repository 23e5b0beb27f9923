"""Mixing sources to target weights by Pareto order sampling: DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WHITE, prepare, written

#: A round deals the open stretch of a source's order into so many buckets; a stretch of at most OPEN_ROWS rows is settled at once.
BUCKETS, OPEN_ROWS, ROUNDS = 16, 2000, 12
#: Times that documents which still fit are looked for after the first that doesn't.
FILLS = 4


def word_count(text: Column) -> Column:
    """Stretches without the six ASCII white-space characters; null: 0."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def unit(*columns: Column) -> Column:
    """A number above 0 and below 1 for each row, from a hash of the columns: the same in every run."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + 0.5) / F.lit(2.0**53)


def numbered_rows(docs: DataFrame, weight: Column | None, seed: int) -> DataFrame:
    """A row for each row of docs: doc_id, text_hash, source, key (source, null included), size, weight, u.

    Rows that repeat a doc_id, a source and a text are counted and dealt out again with numbers, so that each gets an own u which
    no partitioning changes.
    """
    w = (F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(1.0))).alias("weight")
    own = docs.select(F.col("doc_id").cast("long"), "source", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"), w)
    same = own.groupBy("doc_id", "source", "text_hash", "size", "weight").agg(F.count("*").alias("n"))
    each = same.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "source"))
    return each.withColumn("key", key).withColumn("u", unit(F.lit(seed), "doc_id", "key", "text_hash", "copy")).drop("n", "copy")


def source_targets(rows: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """key, source_size and target for each source.

    Sources, by code point and null last, get weights in turn and share `share` times all words. A target stops at cap times its
    source's words; the excess is shared again by weight until none is above. Those that stop are the first in the order of cap *
    words / weight, so that running sums settle it. A row for each source meets in one task, no document does.
    """
    sizes = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    s = sizes.withColumn("w", F.get(F.array(*(F.lit(float(w)) for w in weights)), turn % len(weights))).withColumn("most", cap * F.col("source_size"))
    all_, order = Window.partitionBy(), Window.orderBy(F.col("most") / F.col("w"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = share * F.sum("source_size").over(all_)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("stops", level * F.col("w") >= F.col("most")).withColumn("total", total)
    rest = F.col("total") - F.sum(F.when(F.col("stops"), F.col("most")).otherwise(0.0)).over(all_)
    open_ = F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("w"))).over(all_)
    target = F.when(F.col("stops"), F.col("most")).otherwise(F.least("most", F.col("w") * rest / open_))
    return s.select("key", "source_size", target.alias("target"))


def rates(rows: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """targets with `rate`: a document's copies are rate * weight in expectation, cap at most, and add up to the target in words.

    Each round takes the documents that reached cap out of the sum, until no source has more of them.
    """
    now = targets.withColumn("rate", F.lit(0.0)).withColumn("stopped", F.lit(-1).cast("long"))
    while True:
        at_cap = (F.col("rate") > 0) & (F.col("rate") * F.col("weight") >= cap)
        sums = rows.join(now.select("key", "rate"), "key").groupBy("key").agg(
            F.sum(F.when(at_cap, F.col("size")).otherwise(0)).alias("whole"), F.sum(F.when(at_cap, 0.0).otherwise(F.col("size") * F.col("weight"))).alias("open"), F.count_if(at_cap).alias("n")
        )
        rate = F.when(F.col("open") > 0, F.greatest(F.lit(0.0), F.col("target") - cap * F.col("whole")) / F.col("open")).otherwise(F.col("rate"))
        now = written(now.join(sums, "key").withColumn("changed", F.col("n") != F.col("stopped")).select("key", "source_size", "target", rate.alias("rate"), F.col("n").alias("stopped"), "changed"), "rates")
        if not now.where("changed").count():
            return now.select("key", "source_size", "target", "rate")
        now = now.drop("changed")


def _settled(open_rows: DataFrame) -> DataFrame:
    """open_rows with `chosen`: in order, those that still fit into `left` words, then what comes nearest to it."""
    by, order = Window.partitionBy("key"), Window.partitionBy("key").orderBy("place", "tie", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    df = open_rows.withColumn("chosen", F.lit(False)).withColumn("gap", F.col("left"))
    for i in range(FILLS):
        fits = ~F.col("chosen") & (F.col("size") <= F.col("gap"))
        df = df.withColumn("run", F.sum(F.when(fits if i else F.lit(True), F.col("size")).otherwise(0)).over(order))
        df = df.withColumn("chosen", F.col("chosen") | ((fits if i else F.lit(True)) & (F.col("run") <= F.col("gap"))))
        df = df.withColumn("gap", F.col("left") - F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0)).over(by))
    off = F.when(~F.col("chosen"), F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "place", "tie", "doc_id"))
    df = df.withColumn("off", off).withColumn("nearest", F.min("off").over(by)).withColumn("at", F.row_number().over(Window.partitionBy("key", "off").orderBy("size")))
    last = F.coalesce((F.col("off") == F.col("nearest")) & (F.col("nearest.off") < F.col("gap")) & (F.col("at") == 1), F.lit(False))
    return df.withColumn("chosen", F.col("chosen") | last)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, weight: Column | None = None, seed: int = 13) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, text_hash for each row of docs: how often the mix takes it.

    size is the text's words (null: 0). Targets are source_targets'. In expectation a document comes rate * weight times, cap at
    most; weight is a column of docs, null counting as 1, by default 1 for all, so that every document of a source comes target / source_size
    times. Its whole copies are certain. What is left of the target is a sample of fixed size, in words, of documents with unequal
    inclusion probabilities p, the fractional parts: they are ranked by the odds of a random number over the odds of p, and the
    first go in until the words are reached. At the border, documents that don't fit are passed over, up to four times, and a
    last one goes in if that comes nearer to the target; so a source is off by less than its smallest document left, or by
    rounding. The random numbers are hashes of doc_id, source, text and the number among equal rows: reruns agree.

    A source's border is found by histograms of the order, each round dealing the open stretch of every source into 16 buckets;
    only a stretch of at most 2,000 rows meets in one task. Sums are combined before they are shuffled, so a source that holds a
    third of all rows is 16 rows a task. Texts are not shuffled; a few numbers for each row are, once, to count equal rows.

    Null sources are one source, the last. Empty and null texts have size 0 and are never taken. Rows that repeat a doc_id are
    taken each. Where no document has words, targets and taken are 0; an empty table gives an empty table. Further columns are
    ignored; `draw` gives the texts.
    """
    prepare(docs.sparkSession)
    rows = written(numbered_rows(docs, weight, seed), "mix-rows")
    targets = written(source_targets(rows, weights, share, cap), "targets")
    sources = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)) if weight is None else rates(rows, targets, cap)
    wanted = F.least(F.lit(float(cap)), F.col("rate") * F.col("weight"))
    whole = F.when(F.col("size") > 0, F.floor(wanted)).otherwise(0)
    p = F.when(F.col("size") > 0, wanted - F.floor(wanted)).otherwise(0.0)
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = rows.join(sources, "key").withColumns({"whole": whole, "p": p}).withColumn("rank", F.when(F.col("p") > 0, odds)).withColumns({"place": F.col("rank") / (1 + F.col("rank")), "tie": F.xxhash64("u", "text_hash")})
    sums = ranked.groupBy("key").agg(F.first("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.count("place").alias("n"))
    stretch = written(sums.select("key", (F.col("target") - F.col("certain")).alias("left"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), "n"), "stretch")
    for _ in range(ROUNDS):
        wide = stretch.where(F.col("n") > OPEN_ROWS)
        if not wide.count():
            break
        bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("place") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS).cast("int"))
        inside = ranked.select("key", "place", "size").join(wide, "key").where((F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi")))
        counts = inside.groupBy("key", "left", "lo", "hi", bucket.alias("b")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = F.sum("words").over(Window.partitionBy("key").orderBy("b"))
        step = (F.col("hi") - F.col("lo")) / BUCKETS
        over = counts.withColumn("upto", upto).where(F.col("upto") >= F.col("left"))  # the first of them holds the border
        first = over.groupBy("key").agg(F.min_by(F.struct((F.col("left") - F.col("upto") + F.col("words")).alias("left"), (F.col("lo") + F.col("b") * step).alias("lo"), F.when(F.col("b") == BUCKETS - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("b") + 1) * step).alias("hi"), "n"), "b").alias("s"))
        # where all that is open stays below the target, the stretch ends after it
        done = wide.join(first.select("key"), "key", "left_anti").select("key", "left", F.col("hi").alias("lo"), "hi", F.lit(0).cast("long").alias("n"))
        stretch = written(stretch.where(F.col("n") <= OPEN_ROWS).union(first.select("key", "s.*")).union(done), "stretch")
    dealt = ranked.join(stretch.drop("n"), "key")
    open_ = F.coalesce((F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi")), F.lit(False))
    border = _settled(dealt.where(open_))
    names = ["doc_id", "size", "source_size", "target", "source", "text_hash", "whole", "chosen"]
    both = dealt.where(~open_).withColumn("chosen", F.coalesce(F.col("place") < F.col("lo"), F.lit(False))).select(*names).union(border.select(*names))
    copies = F.col("whole") + F.col("chosen").cast("int")
    return both.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.cast("int").alias("copies"), "source", "text_hash")


def draw(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: the rows of docs as often as mix() takes them. Of rows that repeat a doc_id, a source and a text, one stands for all."""
    keys = ["__d", "__s", "__h"]
    parts = plan.where("copies > 0").groupBy(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("text_hash").alias("__h")).agg(F.sum("copies").alias("__n"))
    own = docs.withColumns({"__d": F.col("doc_id").cast("long"), "__s": F.col("source"), "__h": F.xxhash64("text")}).dropDuplicates(keys)
    on = [own[k].eqNullSafe(parts[k]) for k in keys]
    return own.join(parts, on).withColumn("__c", F.explode(F.sequence(F.lit(1).cast("long"), "__n"))).select(*docs.columns)
