"""Mixing sources to target weights by entropy balancing; DataFrame operations only.

Only counts decide a mix.  Rows that are alike in source, id and text are one
group, so the plan is made on (source, size, hash, number of rows), and texts
are read once to make it and once to apply it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize

#: No document is taken more often than this, and no source gets more than this times its size.
CAP = 3
#: Bins of the rounding order within a source, from -1 to 1; a document's copies move by one at the most from bin to bin.
BINS = 1 << 12
#: Newton steps end when every source is so near its target, or after so many.
NEAR, STEPS = 1e-8, 80
#: A table of repeated rows' hashes is broadcast up to so many rows (of 8 bytes), joined by exchange beyond.
BROADCAST_ROWS = 400_000
RESULTS = ("size", "source_size", "target", "rate", "copies")


def n_words(text: str = "text") -> Column:
    """Words of a text, 0 for null, by built-in functions."""
    return F.when(F.col(text).isNull(), 0).otherwise(F.size(F.filter(F.split(F.col(text), f"{SPACE}+"), lambda x: x != ""))).cast("long")


def _key(source: str = "source") -> Column:
    """Sources as strings that are never null, in their order: by code point, null last."""
    return F.when(F.col(source).isNull(), "b").otherwise(F.concat(F.lit("a"), F.col(source).cast("string")))


def _ordinals(sources: DataFrame) -> DataFrame:
    """sources with `ordinal`, their place by key from 0: counted in each range of keys, then added up over the ranges, which are as many as tasks."""
    spark = sources.sparkSession
    parts = materialize(sources.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").withColumn("part", F.spark_partition_id()), "mix")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return parts.join(before, "part").withColumn("ordinal", F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1 + F.col("before")).drop("part", "before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """(source, source_size) -> the same with target.

    Sources by code point, null last, weigh as `weights`, repeating.  A target
    is min(cap * size, level * weight), the level being such that all targets
    add up to all sizes.  It is found as the rule says: sources above their cap
    are cut to it and the excess is shared again, until none is above; each
    round is one sum over the sources.
    """
    s = _ordinals(sizes.withColumn("key", _key()))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("ordinal", F.lit(len(weights))) + 1).cast("int")).cast("double"))
    s = materialize(s.withColumn("top", cap * F.col("source_size").cast("double")), "mix")
    whole, weight = (float(x or 0) for x in s.agg(F.sum("source_size"), F.sum("w")).first())
    level, capped = whole / weight if weight else 0.0, 0
    while True:
        over = F.col("w") * F.lit(level) > F.col("top")
        n, mass, gone = s.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("top"))), F.lit(0.0)), F.coalesce(F.sum(F.when(over, F.col("w"))), F.lit(0.0))).first()
        if n == capped or gone >= weight:
            break
        level, capped = (whole - mass) / (weight - gone), n
    return s.select(*sizes.columns, F.least("top", F.col("w") * F.lit(level)).alias("target"))


def rate(lam: Column, size: Column, mean: Column, cap: int = CAP) -> Column:
    """A document's expected copies: exp(lam * size / mean), cap at most."""
    return F.exp(F.least(F.lit(math.log(cap)), lam * size / mean))


def balance(hist: DataFrame, goal: DataFrame, cap: int = CAP) -> DataFrame:
    """Newton on the dual, one number a source: (key, lam, mean) such that the rates give the target.

    hist is (key, size, n): all that the dual depends on, so a step reads the
    distinct sizes and not the documents, and adds them up by source with
    partial sums before the exchange.  The dual of "least relative entropy of
    the rates to 1 under sum(rate * size) = target, rate <= cap" is convex in
    lam and its slope is monotone; each step is a Newton step on the logarithm
    of the sum, kept inside the bracket found so far.  Steps end when every
    source is within NEAR of its target.
    """
    far = 50_000.0
    state = goal.filter((F.col("source_size") > 0) & (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12)))
    state = state.select("key", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.log(F.col("target") / F.col("source_size")).alias("lam"), F.lit(-far).alias("lo"), F.lit(far).alias("hi"), F.lit(1.0).alias("off"))
    state, hist = materialize(state, "mix"), hist.filter("size > 0")
    for _ in range(STEPS):
        r = rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
        free = F.col("lam") * F.col("size") / F.col("mean") < math.log(cap)
        mass = F.col("n") * F.col("size") * r
        sums = hist.join(state.select("key", "lam", "mean"), "key").groupBy("key").agg(F.sum(mass).alias("got"), F.sum(F.when(free, mass * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        s = state.join(sums, "key")
        less = F.col("got") < F.col("target")
        s = s.withColumns({"lo": F.when(less, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(less, F.col("hi")).otherwise(F.col("lam")), "off": F.abs(F.col("got") / F.col("target") - 1)})
        step = F.col("lam") + F.least(F.lit(4.0), F.greatest(F.lit(-4.0), F.try_divide((F.log("target") - F.log(F.greatest("got", F.lit(1e-300)))) * F.col("got"), F.col("slope"))))
        mid = (F.greatest(F.col("lo"), F.col("lam") - 64) + F.least(F.col("hi"), F.col("lam") + 64)) / 2
        new = F.when(F.col("off") <= NEAR, F.col("lam")).when((F.col("slope") > 0) & (step > F.col("lo")) & (step < F.col("hi")), step).otherwise(mid)
        state = materialize(s.select("key", "target", "mean", new.alias("lam"), "lo", "hi", "off"), "mix")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= NEAR:
            break
    return state.select("key", "lam", "mean")


def _rated(groups: DataFrame, goal: DataFrame, cap: int) -> DataFrame:
    """Groups with the rate of their documents, its whole part, and `upper`: how much more a document may get at all."""
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    r = groups.join(goal, "key")
    r = r.withColumn("rate", F.when(F.col("size") == 0, 1.0).when(full, float(cap)).when(F.col("lam").isNull(), 0.0).otherwise(rate(F.col("lam"), F.col("size"), F.col("mean"), cap)))
    r = r.withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("long"))
    return r.withColumns({"part": F.col("rate") - F.col("whole"), "can": (F.col("whole") < cap) & (F.col("size") > 0), "u": F.shiftrightunsigned("h", 24).cast("double") / float(1 << 40)})


def _more(cut: Column) -> Column:
    """How many of a group's n rows get one copy more at this cut: row k does if (u + k) / n is below the rate's fraction plus the cut."""
    up = F.ceil(F.col("n") * (F.col("part") + cut) - F.col("u")).cast("long")
    return F.when(F.col("can"), F.greatest(F.lit(0), F.least(F.col("n"), up))).otherwise(F.lit(0)).cast("long")


def _edge(bin_: Column) -> Column:
    """The upper end of a bin."""
    return 2.0 * (bin_ + 1) / BINS - 1


def _cuts(groups: DataFrame, goal: DataFrame, cap: int) -> DataFrame:
    """goal with each source's cut, what is then still missing (or too much), and the group in which one row closes that gap best."""
    r = _rated(groups, goal, cap)
    # rows of a large group are spread evenly over [0, 1): as many strands as bins stand for them
    strands = F.least(F.col("n"), F.lit(BINS // 2))
    r = r.withColumn("strands", strands).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("strands") - 1)))
    first = F.floor(F.col("k") * F.col("n") / F.col("strands"))
    many = F.floor((F.col("k") + 1) * F.col("n") / F.col("strands")) - first
    place = (F.col("u") + first) / F.col("n") - F.col("part")
    bins = r.select("key", "target", F.least(F.lit(BINS - 1), F.floor((place + 1) / 2 * BINS)).cast("int").alias("bin"), (many * F.col("whole") * F.col("size")).alias("base"), F.when(F.col("can"), many * F.col("size")).otherwise(0).alias("more"))
    bins = bins.groupBy("key", "bin").agg(F.sum("base").alias("base"), F.sum("more").alias("more"), F.first("target").alias("target"))
    of = Window.partitionBy("key")  # BINS rows a source at most
    bins = bins.withColumn("upto", F.sum("base").over(of) + F.sum("more").over(of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    # the last bin whose tokens bring the source nearer to its target
    nearer = F.abs(F.col("upto") - F.col("target")) < F.abs(F.col("upto") - F.col("more") - F.col("target"))
    cut = bins.groupBy("key").agg(_edge(F.coalesce(F.max(F.when(nearer, F.col("bin"))), F.lit(-1))).alias("cut"))
    g = materialize(goal.join(cut, "key"), "mix")
    r = _rated(groups, g, cap).withColumn("e", _more(F.col("cut")))
    rest = r.groupBy("key").agg((F.first("target") - F.sum(F.col("size") * (F.col("n") * F.col("whole") + F.col("e")))).alias("rest"))
    g = materialize(g.join(rest, "key"), "mix")
    r = _rated(groups, g, cap).withColumn("e", _more(F.col("cut")))
    fits = (F.col("rest") > 0) & F.col("can") & (F.col("e") < F.col("n")) | (F.col("rest") < 0) & (F.col("e") > 0)
    one = r.filter(fits).withColumn("gap", F.abs(F.abs("rest") - F.col("size"))).filter(F.col("gap") < F.abs("rest"))
    one = one.groupBy("key").agg(F.min(F.struct("gap", "h", "size")).alias("one")).select("key", F.col("one.h").alias("move_h"), F.col("one.size").alias("move_size"))
    return materialize(g.join(one, "key", "left"), "mix")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, seed: int = 17) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_rate and mix_copies, a row per row.

    Rates come from balance(); a document gets floor(rate) copies, and one more
    if its place in a fixed pseudo-random order of its source comes before the
    point where the source's copies reach its target.  The order is by hash of
    id and text against the rate's fraction (systematic rounding), and the point
    is found on a histogram of BINS bins a source: the documents are never
    sorted.  Then one document a source may change by a copy to close the gap.

    Rows alike in source, id and text are spread evenly over the order, so each
    source comes as near its target whatever repeats; which of them get a copy
    more does not matter to (source, id, text), but other columns may differ.
    They are ranked in salted groups.  Null texts have size 0; sizes 0 are taken
    once at rate 1, which adds nothing; a null source is a source; null ids
    differ by their texts; an empty table gives no rows; other columns pass
    through, but a column called as a result is replaced.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in {f"mix_{r}" for r in RESULTS}]
    at = {c: f"d{i}" for i, c in enumerate(names)}
    own = list(at.values())
    d = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in at.items()])
    d = d.withColumn("key", _key(at["source"])).withColumn("h", F.xxhash64(F.lit(seed), F.col(at["doc_id"]), F.col(at["text"])))
    sized = lambda df: df.withColumn("size", n_words(at["text"]))
    groups = materialize(sized(d).groupBy("key", "size", "h").agg(F.count("*").alias("n")), "mix")
    hist = materialize(groups.groupBy("key", "size").agg(F.sum("n").alias("n")), "mix")
    per = hist.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs"))
    per = per.withColumn("source", F.when(F.col("key") != "b", F.substring("key", 2, 1 << 30)))
    goal = targets(per, weights, cap).drop("source")
    goal = materialize(goal, "mix")
    goal = materialize(goal.join(balance(hist, goal, cap), "key", "left"), "mix")
    goal = _cuts(groups, goal, cap)

    twins = materialize(groups.filter("n > 1"), "mix")
    repeated = twins.count()
    if repeated:
        hashes = twins.select("h").distinct()
        hashes = F.broadcast(hashes) if repeated <= BROADCAST_ROWS else hashes
        ones = d.join(hashes, "h", "left_anti")
        # rows of one group are dealt to salted ones by their place, written once
        some = materialize(sized(d.join(hashes, "h", "left_semi")).withColumn("salt", (F.monotonically_increasing_id() % 4096).cast("int")), "mix")
        by = ["key", "size", "h"]
        counts = some.groupBy(*by, "salt").agg(F.count("*").alias("c"))
        before = counts.select(*by, "salt", F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        some = some.withColumn("k", F.row_number().over(Window.partitionBy(*by, "salt").orderBy(F.lit(0))) - 1)
        some = some.join(before, [*by, "salt"]).withColumn("k", F.col("k") + F.col("before")).join(twins, by, "left").withColumn("n", F.coalesce("n", F.lit(1))).drop("salt", "before")
        rows = sized(ones).withColumns({"n": F.lit(1).cast("long"), "k": F.lit(0).cast("long")}).unionByName(some.withColumn("k", F.col("k").cast("long")))
    else:
        rows = sized(d).withColumns({"n": F.lit(1).cast("long"), "k": F.lit(0).cast("long")})
    out = _rated(rows, goal, cap)
    moved = F.when((F.col("h") == F.col("move_h")) & (F.col("size") == F.col("move_size")), F.signum("rest").cast("long")).otherwise(F.lit(0))
    out = out.withColumn("copies", F.col("whole") + (F.col("k") < _more(F.col("cut")) + moved).cast("long"))
    return out.select(*[F.col(a).alias(c) for c, a in at.items()], *[F.col(c).alias(f"mix_{c}") for c in RESULTS])
