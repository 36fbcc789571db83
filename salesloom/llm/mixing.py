"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot ``j`` of the mix goes to the source whose interval of the cumulative target shares holds
the ``j``-th van der Corput point, so any stretch of the mix has the sources in their shares. A
source's documents, in hashed order, form one stream of words cut into blocks of equal length;
its slots, ranked, take the blocks in turn, starting again when the stream ends. A source stops
when its target is reached: its last slot takes part of a block. A source that the points gave
too few slots gets the rest at the end.

Everything is DataFrame functions. No window gathers a source: slots are ranked in runs of
``RUN`` of the schedule, documents are ordered in buckets of their hash, and totals of runs and
buckets carry the offsets, so a source with a third of all rows is many small groups. The table
of sources has one row each and is ordered in one task; it must be a table of sources, not of hosts.

Defined results: a null text has size 0; a null source is a source, the last; sources without
words have target 0; documents of size 0 are in no block (taken 0); rows alike in all columns
may swap their ``taken``, which leaves the result the same; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.llm.common import store

WEIGHTS = (5, 2, 1)
BLOCK = 512
#: Slots ranked together, and documents ordered together (on average).
RUN = 1 << 12
BUCKET_DOCS = 512
MOST_REPEATS = 3


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key): words of each document and its place in the hashed order."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", F.lit("order")).alias("key"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target, ...) from (source, source_size): weights in turn by name, null last.

    A target stops at ``most`` times its source's size; the excess is shared by weight among
    the others. Ordered by the level at which each source is full, the sources before some point
    are full, and those after it share what is left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = F.lit(float(most)) * F.col("source_size")
    full = Window.orderBy("_level", F.col("source").asc_nulls_last())
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    levelled = sources.withColumn("_w", weight).withColumn("_cap", cap).withColumn("_level", F.col("_cap") / F.col("_w")).withColumn("_total", total)
    # the level at which the rest would be shared if all sources before this one were full
    shared = levelled.withColumn("_share", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    open_ = F.when(F.col("_share") <= F.col("_level"), F.struct("_level", F.col("source").isNull(), "source", "_share"))
    filled = shared.withColumn("_stop", F.min(open_).over(full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["_share"])
    target = F.when(F.col("_stop").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_stop")))
    return filled.select("source", "source_size", target.alias("target"))


def _plan(sources: DataFrame, block: int) -> DataFrame:
    """Targets with each source's interval of points, its blocks, and the slots it needs."""
    named = Window.orderBy(F.col("source").asc_nulls_last())
    goal = F.floor("target").cast("long")
    rest = F.col("goal") - F.col("passes") * F.col("source_size")
    planned = (
        targets(sources)
        .where("source_size > 0")
        .withColumn("goal", goal)
        .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
        .withColumn("passes", F.floor(F.col("goal") / F.col("source_size")).cast("long"))
        .withColumn("rest", rest)
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    )
    share = F.col("slots") / F.sum("slots").over(named.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    high = F.sum(share).over(named.rowsBetween(Window.unboundedPreceding, 0))
    last = F.row_number().over(Window.orderBy(F.col("source").desc_nulls_first())) == 1
    planned = planned.withColumn("high", F.when(last, F.lit(2.0)).otherwise(high))
    return planned.withColumn("low", F.coalesce(F.lag("high").over(named), F.lit(0.0)))


def _corput(j: Column) -> Column:
    """The binary digits of a slot's number mirrored at the point: 0, 1/2, 1/4, 3/4, 1/8 …"""
    bits = j
    for width, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0xFFFFFFFF)):
        even = F.lit(mask).cast("long")
        bits = F.shiftright(bits, width).bitwiseAND(even).bitwiseOR(F.shiftleft(bits.bitwiseAND(even), width))
    return F.shiftrightunsigned(bits, 12) / F.lit(float(1 << 52))


def schedule(plan: DataFrame, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """(slot, source, rank, block, words): which block each slot takes, and how much of it.

    ``rank`` counts a source's slots. Slots past a source's need are left out; the missing ones
    of a source follow at the end, numbered after the points.
    """
    spark = plan.sparkSession
    n_slots = plan.agg(F.sum("slots")).first()[0] or 0
    cuts = plan.select("source", "low", "high")
    points = spark.range(n_slots).select(F.col("id").alias("slot"), _corput(F.col("id")).alias("point"), F.floor(F.col("id") / run).alias("run"))
    # the sources' intervals as one sorted array on every row: no join by range
    bounds = cuts.agg(F.array_sort(F.collect_list(F.struct("low", "high", "source"))).alias("bounds"))
    place = F.filter("bounds", lambda b: (F.col("point") >= b["low"]) & (F.col("point") < b["high"]))[0]
    given = store(points.withColumn("bounds", bounds.scalar()).select("slot", "run", place["source"].alias("source")), "slots")
    in_run = given.groupBy("source", "run").agg(F.count("*").alias("m"))
    offsets = in_run.withColumn("before", F.sum("m").over(Window.partitionBy("source").orderBy("run")) - F.col("m"))
    ranked = given.withColumn("r", F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1)
    same = F.col("g.source").eqNullSafe(F.col("o.source")) & (F.col("g.run") == F.col("o.run"))
    ranked = ranked.alias("g").join(offsets.alias("o"), same).select("g.slot", "g.source", (F.col("o.before") + F.col("g.r")).alias("rank"))
    got = in_run.groupBy("source").agg(F.sum("m").alias("got"))
    short = plan.alias("p").join(got.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source")), "left").select("p.source", "p.slots", F.coalesce("g.got", F.lit(0)).alias("got"))
    late = short.where("got < slots").select("source", F.explode(F.sequence("got", F.col("slots") - 1)).alias("rank"))
    ranked = ranked.unionByName(late.withColumn("slot", F.lit(n_slots) + F.col("rank")))
    taken = ranked.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).where("s.rank < p.slots")
    number = F.col("s.rank") % F.col("p.blocks")
    whole = F.least(F.lit(block), F.col("p.source_size") - number * block)
    left = F.when(F.col("s.rank") >= F.col("p.passes") * F.col("p.blocks"), F.least(whole, F.col("p.rest") - number * block)).otherwise(whole)
    return taken.select("s.slot", "s.source", "s.rank", number.alias("block"), left.cast("long").alias("words"))


def streams(rows: DataFrame) -> DataFrame:
    """Each row with ``start``: its first word's place in its source's stream."""
    n_docs = rows.count()
    buckets = max(1, n_docs // BUCKET_DOCS)
    spread = rows.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    sums = spread.groupBy("source", "bucket").agg(F.sum("size").alias("m"))
    sums = sums.withColumn("before", F.sum("m").over(Window.partitionBy("source").orderBy("bucket")) - F.col("m"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    spread = spread.withColumn("upto", F.sum("size").over(inside))
    same = F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.bucket") == F.col("o.bucket"))
    return spread.alias("d").join(sums.alias("o"), same).select("d.doc_id", "d.source", "d.size", "d.key", (F.col("o.before") + F.col("d.upto") - F.col("d.size")).alias("start"))


def mix_report(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, and source."""
    rows = store(sized(docs), "sizes")
    sources = store(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    plan = store(_plan(sources, block), "mix-plan")
    # how often a block is taken whole, and the part of it that is taken once more
    slots = schedule(plan, block).withColumn("whole", F.col("words") == F.lit(block))
    blocks = slots.groupBy("source", "block").agg(F.collect_list("words").alias("takes"))
    placed = store(streams(rows).withColumn("row", F.monotonically_increasing_id()), "streams")
    pieces = placed.where("size > 0").select(
        "row", "source", "start", (F.col("start") + F.col("size")).alias("end"), F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block")
    )
    same = F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.block") == F.col("b.block"))
    low = F.greatest(F.col("p.start") - F.col("p.block") * block, F.lit(0))
    high = F.least(F.col("p.end") - F.col("p.block") * block, F.lit(block))
    words = F.aggregate("b.takes", F.lit(0).cast("long"), lambda n, take: n + F.greatest(F.lit(0), F.least(high, take) - low))
    taken = pieces.alias("p").join(blocks.alias("b"), same).select("p.row", words.alias("words")).groupBy("row").agg(F.sum("words").alias("taken"))
    goals = store(targets(sources), "targets")
    full = placed.join(taken, "row", "left")
    return (
        full.alias("d")
        .join(goals.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.doc_id", "d.size", "t.source_size", "t.target", F.coalesce("d.taken", F.lit(0)).cast("long").alias("taken"), "d.source")
    )
