"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

With integer weights a of sum D, block j (from 0) of a source is released at slot floor(j * D / a) and due by
ceil((j + 1) * D / a). Earliest-deadline-first over released blocks gives every source its share to within less than one
block at every slot. The schedule repeats after D slots, so one period is computed by a SQL fold over D slots and rows
only look up their block's slot. Row numbers come from counts on three levels, so a hot source is spread over many tasks.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_PART = 5000
#: Slots scheduled in one inner fold, and parts of a source whose sizes are summed in one window.
SLOTS_AT_ONCE, PARTS_AT_ONCE = 1000, 1000
OTHER = "\u0000other"
MOST_BROADCAST_SLOTS = 1 << 20


def period(spark: SparkSession, weights: dict[str, int]) -> DataFrame:
    """One period of the schedule: (grp, k, slot), the k-th block of a source within the period and its slot.

    Weights are reduced by their common divisor. A long period is folded a thousand slots at a time, so that the list of
    all picks is copied once for each thousand.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive integers")
    weights = reduced(weights)
    total, names = sum(weights.values()), sorted(weights)
    table = spark.range(1).select(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(weights[n]).cast("long").alias("a")) for i, n in enumerate(names))).alias("src"))
    # at each slot, of the sources whose next block is released the one with the earliest deadline, then the first name
    pick = f"""array_min(transform(filter(src, s -> (acc.done[s.i] * {total}) div s.a <= t and acc.done[s.i] < s.a),
        s -> named_struct('due', ((acc.done[s.i] + 1) * {total} + s.a - 1) div s.a, 'i', s.i))).i"""
    some = f"""aggregate(sequence(c * {SLOTS_AT_ONCE}L, least({total}L, (c + 1) * {SLOTS_AT_ONCE}L) - 1),
        named_struct('done', whole.done, 'picks', cast(array() as array<int>)),
        (acc, t) -> named_struct('done', transform(acc.done, (d, i) -> d + if(i = {pick}, 1L, 0L)), 'picks', concat(acc.picks, array({pick}))))"""
    fold = f"""aggregate(sequence(0L, {(total - 1) // SLOTS_AT_ONCE}L), named_struct('done', transform(src, s -> 0L), 'picks', cast(array() as array<int>)),
        (whole, c) -> transform(array({some}), part -> named_struct('done', part.done, 'picks', concat(whole.picks, part.picks)))[0],
        whole -> whole.picks)"""
    picks = table.select(F.posexplode(F.expr(fold)).alias("slot", "i"))
    lookup = F.array(*(F.lit(n) for n in names))
    picks = picks.select(F.element_at(lookup, F.col("i") + 1).alias("grp"), F.col("slot").cast("long").alias("slot"))
    return picks.select("grp", (F.row_number().over(Window.partitionBy("grp").orderBy("slot")) - 1).cast("long").alias("k"), "slot")


def reduced(weights: dict[str, int]) -> dict[str, int]:
    """The same shares in the smallest integers."""
    common = gcd(*weights.values())
    return {k: v // common for k, v in weights.items()}


def mix_sources(docs: DataFrame, weights: dict[str, int], block: int = 64, other: int = 1) -> DataFrame:
    """Every row of ``docs`` with its place in the mix: mix_slot, mix_place (place within the block), mix_within.

    ``weights``: source -> positive integer, of any sum; sources not named there and null share the weight ``other``. The order
    of rows is (mix_slot, mix_place); a source's rows come in the order of md5(doc_id as text), ties by doc_id. No row
    is dropped or repeated: a source that has run out leaves its later slots empty, and mix_within is true for the
    slots before the first one left unfilled or partly filled, where each source deviates from its target by less
    than one block. Only the columns doc_id and source are needed; columns named like the new ones are replaced.
    Rows with equal doc_id and source keep separate places, in any order. Empty table: empty result.
    """
    spark = docs.sparkSession
    full = reduced({**weights, OTHER: other})
    total = sum(full.values())
    docs = docs.drop("mix_slot", "mix_place", "mix_within")
    n = docs.count()
    parts = n // ROWS_PER_PART + 1
    grp = F.when(F.col("source").isin(*weights), F.col("source")).otherwise(F.lit(OTHER)) if weights else F.lit(OTHER)
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # the part comes from the hash's leading digits, so parts follow the hash's order
    part = F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / 2.0**32 * parts).cast("long")
    rows = docs.select(F.struct("*").alias("row"), grp.alias("grp"), order.alias("h"), part.alias("part"), F.col("doc_id").alias("id"))
    counts = docs.select(grp.alias("grp"), part.alias("part")).groupBy("grp", "part").agg(F.count("*").alias("c"))
    far = F.floor(F.col("part") / PARTS_AT_ONCE).alias("far")
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("grp", far).agg(F.sum("c").alias("c")).select("grp", "far", F.coalesce(F.sum("c").over(earlier("grp", "far")), F.lit(0)).alias("start"))
    offsets = counts.select("grp", "part", far, F.coalesce(F.sum("c").over(earlier("grp", far, "part")), F.lit(0)).alias("near"))
    offsets = offsets.join(sums, ["grp", "far"]).select("grp", "part", (F.col("near") + F.col("start")).alias("offset"))
    number = F.row_number().over(Window.partitionBy("grp", "part").orderBy("h", "id")) - 1
    placed = rows.withColumn("number", number.cast("long")).join(offsets, ["grp", "part"])
    a = F.create_map(*(x for k, v in full.items() for x in (F.lit(k), F.lit(v).cast("long"))))
    placed = placed.withColumn("rn", F.col("number") + F.col("offset")).withColumn("j", F.floor(F.col("rn") / block))
    placed = placed.withColumn("a", a[F.col("grp")]).withColumn("k", F.col("j") % F.col("a"))
    schedule = period(spark, full)
    slots = F.floor(F.col("j") / F.col("a")) * total + F.col("slot")
    ends = counts.groupBy("grp").agg(F.sum("c").alias("c"))
    ends = spark.createDataFrame([(k,) for k in full], "grp string").join(ends, "grp", "left")
    ends = ends.where("c > 0").select("grp", F.floor(F.col("c") / block).alias("j"), a[F.col("grp")].alias("a")).withColumn("k", F.col("j") % F.col("a"))
    # a source whose blocks are used up leaves its next slot unfilled; one without a single row has no say
    stop = ends.join(schedule, ["grp", "k"]).agg(F.min(slots)).first()[0]
    # a period is as long as the sum of the weights, whatever the rows; a very long one is joined by a shuffle
    placed = placed.join(F.broadcast(schedule) if total <= MOST_BROADCAST_SLOTS else schedule, ["grp", "k"])
    slot = slots.alias("mix_slot")
    return placed.select("row.*", slot, (F.col("rn") % block).alias("mix_place"), (slots < F.lit(stop or 0)).alias("mix_within"))
