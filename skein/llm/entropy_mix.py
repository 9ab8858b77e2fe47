"""Mixing sources to target weights by entropy balancing.

The rates r of documents (copies on average, between 0 and `cap`) minimise the sum over documents of r log r - r (the relative
entropy to one copy each) under the constraint that each source gives its target of words, sum(size * r) = target. The dual is
convex and separable by source; its solution tilts documents exponentially by their size, r = min(cap, exp(lambda * size)).
Newton steps on lambda run for all sources at once: each step sums size * r and size^2 * r over the (source, size) classes,
which are counted once, in a distributed aggregate, inside a bracket that is halved where a step would leave it.

Rates become whole copies along the classes of equal size within a source (largest first), by the differences of the rounded
running sum of rates, so that any run of similar documents takes its share; what is still missing from or above the target
is made up with the smallest classes. Within a class documents are dealt by a hash of the id. Only tables of classes and
sources are windowed; documents are ranked within sub-classes, so that no source or size comes together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, words

CAP, SUBS, STEPS, TOLERANCE = 3, 256, 100, 1e-10


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Adds rank (from 1) by code point, null last: a range partitioning with the counts of its parts, as sources may be many."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    dealt = cut(sources.repartitionByRange(parts, order).sortWithinPartitions(order))
    dealt = dealt.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    counts = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}  # a number for each part
    before, offsets = 0, []
    for part in sorted(counts):
        offsets += [F.lit(part), F.lit(before)]
        before += counts[part]
    offset = F.element_at(F.create_map(*offsets), F.col("__part")) if offsets else F.lit(0)
    return dealt.withColumn("rank", offset + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__id", "__part")


def water_fill(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds target to (source, size, weight): shares of the total by weight, none above cap x size; what is above is shared anew, round by round."""
    full = F.lit(float(cap)) * F.col("size")
    total = sources.agg(F.sum("size").alias("s")).first()["s"] or 0
    level = None
    while True:
        above = F.lit(False) if level is None else F.lit(level) * F.col("weight") > full
        r = sources.agg(F.sum(F.when(above, full).otherwise(F.lit(0.0))).alias("full"), F.sum(F.when(above, F.lit(0.0)).otherwise(F.col("weight").cast("double"))).alias("open")).first()
        now = (total - r["full"]) / r["open"] if r["open"] else float("inf")
        if level is not None and now <= level or now == float("inf"):
            break
        level = now
    return sources.withColumn("target", full if level is None else F.least(full, F.lit(level) * F.col("weight")))


def tilted(lam: Column, size: Column, cap: float = CAP) -> Column:
    """The rate of a document of a size."""
    return F.when(lam * size >= F.log(F.lit(float(cap))), F.lit(float(cap))).otherwise(F.exp(lam * size))


def _sum(x: Column) -> Column:
    """A sum of doubles that does not depend on the order of rows, so that reruns agree to the last digit."""
    return F.sum(x.cast("decimal(38,14)")).cast("double")


def newton_tilts(classes: DataFrame, targets: DataFrame, cap: float = CAP, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """s (source), lam: where the dual's gradient sum(n * size * r) - target is zero, from classes (source, size, n) and targets (s, target).

    Null lam: every document is taken cap times (the target is the cap) or not at all (it is 0); the target tells which.
    """
    worded = classes.filter("size > 0")
    ends = worded.groupBy(F.col("source").alias("s0")).agg(F.min("size").alias("least"), F.sum(F.col("n") * F.col("size")).cast("double").alias("words"))
    share = F.col("target") / F.col("words")
    state = targets.join(ends, F.col("s").eqNullSafe(F.col("s0"))).drop("s0").withColumn("share", share)
    edge = F.log(F.greatest(F.least("share", F.lit(float(cap))), F.lit(1e-300))) / F.col("least")
    inner = (F.col("share") > 0) & (F.col("share") < cap)
    high = F.when(F.col("share") > 1, F.log(F.lit(float(cap))) / F.col("least")).otherwise(F.lit(0.0))
    state = cut(state.select("s", "target", "words", F.when(inner, F.lit(0.0)).alias("lam"), F.least(F.lit(0.0), edge).alias("low"), high.alias("high"), (~inner).alias("done")))
    for _ in range(steps):
        if not state.filter("not done").limit(1).count():
            break
        now = worded.join(state.filter("not done"), F.col("source").eqNullSafe(F.col("s")))
        r = tilted(F.col("lam"), F.col("size"), cap)
        sums = now.groupBy(F.col("source").alias("s1")).agg(_sum(F.col("n") * F.col("size") * r).alias("f"), _sum(F.when(r < cap, F.col("n") * F.col("size") * F.col("size") * r).otherwise(F.lit(0.0))).alias("h"))
        both = state.join(sums, F.col("s").eqNullSafe(F.col("s1")), "left").withColumn("g", F.col("f") - F.col("target"))
        low, high = F.when(F.col("g") <= 0, F.col("lam")).otherwise(F.col("low")), F.when(F.col("g") >= 0, F.col("lam")).otherwise(F.col("high"))
        both = both.withColumn("low", F.when(F.col("done"), F.col("low")).otherwise(low)).withColumn("high", F.when(F.col("done"), F.col("high")).otherwise(high))
        jump = F.col("lam") - F.col("g") / F.when(F.col("h") > 0, F.col("h"))
        jump = F.when(jump.isNotNull() & (jump > F.col("low")) & (jump < F.col("high")), jump).otherwise((F.col("low") + F.col("high")) / 2)
        settled = (F.abs("g") <= tolerance * F.col("target")) | (jump == F.col("lam"))
        lam = F.when(F.col("done") | settled, F.col("lam")).otherwise(jump)
        state = cut(both.select("s", "target", "words", lam.alias("lam"), "low", "high", (F.col("done") | F.coalesce(settled, F.lit(False))).alias("done")))
    return state.select("s", "lam")


def mix_sources(docs: DataFrame, cap: int = CAP, subs: int = SUBS, carry: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies (0 to cap); with carry also row, a struct of those columns of docs.

    Null sources form one source, ranked last. Null and empty texts have size 0 and take 0 copies; sources without words have
    target 0. Equal documents are told apart by doc_id only: rows that repeat a doc_id within a class are ranked in any order
    and get the same number of copies in total.
    """
    row = [F.struct(*carry).alias("row")] if carry else []
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), *row)
    sized = sized.withColumn("sub", F.pmod(F.xxhash64(F.col("doc_id")), F.lit(subs)))
    classes = cut(sized.groupBy("source", "size", "sub").agg(F.count("*").alias("n")))
    sources = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    weighted = ranked_sources(sources).withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumnRenamed("source_size", "size")
    filled = cut(water_fill(weighted, cap).withColumnRenamed("size", "source_size").drop("rank", "weight"))
    whole = cut(classes.groupBy("source", "size").agg(F.sum("n").alias("n")))
    tilts = newton_tilts(whole, _renamed(filled).select("s", "target"), cap).withColumnRenamed("s", "s2")
    rates = cut(filled.join(tilts, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2"))
    rate = F.when(F.col("lam").isNotNull(), tilted(F.col("lam"), F.col("size"), cap)).when(F.col("target") > 0, F.lit(float(cap))).otherwise(F.lit(0.0))

    sizes = whole.filter("size > 0").join(_renamed(rates), F.col("source").eqNullSafe(F.col("s")), "inner").drop("s").withColumn("rate", rate)
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("source")
    run = F.floor(F.sum(F.col("n") * F.col("rate")).over(down) + F.lit(0.5))
    sizes = sizes.withColumn("run", run).withColumn("m", F.least(F.col("run") - F.coalesce(F.lag("run").over(Window.partitionBy("source").orderBy(F.col("size").desc())), F.lit(0)), cap * F.col("n")))
    sizes = sizes.withColumn("gap", F.col("target") - F.sum(F.col("m") * F.col("size")).over(every))
    # The smallest classes give or take one copy a document each, up to the gap.
    room = F.when(F.col("gap") > 0, F.least(F.col("n"), cap * F.col("n") - F.col("m"))).otherwise(F.least(F.col("n"), F.col("m")))
    sizes = sizes.withColumn("room", room)
    left = F.abs(F.col("gap")) - (F.sum(F.col("room") * F.col("size")).over(up) - F.col("room") * F.col("size"))
    change = F.greatest(F.lit(0), F.least(F.col("room"), F.floor(left / F.col("size"))))
    sizes = sizes.withColumn("m", F.col("m") + F.signum("gap").cast("long") * change)
    deal = sizes.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "m")

    offsets = classes.withColumn("before", F.sum("n").over(Window.partitionBy("source", "size").orderBy("sub").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    deal = offsets.drop("n").join(deal, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").drop("s", "z")
    deal = deal.join(_renamed(rates), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    deal = deal.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("sub").alias("b"), "before", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"), "source_size", "target", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0)).alias("rate"))
    place = F.row_number().over(Window.partitionBy("source", "size", "sub").orderBy("doc_id"))
    ranked = sized.withColumn("place", place).join(deal, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("sub") == F.col("b")), "left")
    k = F.col("before") + F.col("place")
    copies = F.floor(k * F.col("m") / F.col("n")) - F.floor((k - 1) * F.col("m") / F.col("n"))
    return ranked.select("doc_id", "source", "size", "source_size", "target", "rate", copies.cast("long").alias("copies"), *(["row"] if carry else []))


def _renamed(rates: DataFrame) -> DataFrame:
    return rates.withColumnRenamed("source", "s")


def op7_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op7_entropy_mix": op7_entropy_mix}
ORACLES: dict[str, str] = {}
