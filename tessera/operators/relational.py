"""Joins that SQL has no direct form for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a bucket of an as-of join, about.
ASOF_ROWS = 1_000_000


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, take: list[str], width: float | None = None) -> DataFrame:
    """Each left row with the columns ``take`` of the last right row of the same ``by`` at or before its ``on``.

    One shuffle of the union by key, then a running last value; no pairs are made.  A key's
    rows are cut into buckets of a ``width`` (in the units of ``on`` as a number, seconds for
    times), so that a hot key spreads over many tasks; the last right row of the earlier
    buckets is carried in from one row per bucket.  Without a width, one is taken that
    leaves about ``ASOF_ROWS`` rows of an even spread to a bucket.
    """
    a = left.select("*", F.lit(1).alias("__side"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"__{c}") for c in take])
    b = right.select(F.col(by), F.col(on), F.lit(0).alias("__side"), *[F.col(c).alias(f"__{c}") for c in take])
    both = a.unionByName(b, allowMissingColumns=True)
    number = F.col(on).cast("timestamp").cast("double") if right.schema[on].dataType.typeName().startswith("timestamp") else F.col(on).cast("double")
    if width is None:
        rows, low, high = both.agg(F.count("*"), F.min(number), F.max(number)).first()
        buckets = rows // ASOF_ROWS
        width = (high - low) / buckets if buckets and low is not None and high > low else None
    both = both.withColumn("__bucket", F.lit(0) if width is None else F.floor(number / width))
    upto = Window.partitionBy(by, "__bucket").orderBy(F.col(on).asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("__side") == 0, F.struct(*[F.col(f"__{c}").alias(c) for c in take]))
    found = both.withColumn("__last", F.last(mark, ignorenulls=True).over(upto))
    if width is not None:
        ends = both.withColumn("__mark", mark).groupBy(by, "__bucket").agg(F.max_by("__mark", F.when(F.col("__side") == 0, F.col(on))).alias("__end"))
        earlier = Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(F.col(by).alias("__by"), F.col("__bucket").alias("__nth"), F.last("__end", ignorenulls=True).over(earlier).alias("__carried"))
        found = found.join(carried, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__bucket") == F.col("__nth")), "left")
        found = found.withColumn("__last", F.coalesce("__last", "__carried"))
    return found.where("__side = 1").select(*left.columns, *[F.col("__last")[c].alias(f"right_{c}") for c in take])


#: Buckets that one span is dealt to, at most; longer spans go by wider buckets.
SPAN_BUCKETS = 64


def range_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the spans [low, high) that hold them, by an equi-join on buckets.

    A span takes the narrowest buckets (``width`` times a power of ``SPAN_BUCKETS``) of
    which it needs few, so a span of any length is dealt to a bounded number; a point goes
    to the bucket of each width that some span has.
    """
    length = F.greatest((F.col(high) - F.col(low)) / width, F.lit(1.0))
    level = F.ceil(F.log(float(SPAN_BUCKETS), length) - 1e-9).cast("int")
    leveled = spans.withColumn("__level", F.greatest(level - 1, F.lit(0))).where(F.col(low) < F.col(high))
    levels = sorted(r[0] for r in leveled.select("__level").distinct().collect())
    bucket = lambda c, n: F.floor(F.col(c) / (width * F.pow(F.lit(float(SPAN_BUCKETS)), n))).cast("bigint")
    dealt = leveled.withColumn("__bucket", F.explode(F.sequence(bucket(low, F.col("__level")), bucket(high, F.col("__level")))))
    each = points.withColumn("__level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    each = each.withColumn("__bucket", bucket(at, F.col("__level")))
    met = each.join(dealt, ["__level", "__bucket"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high)))
    return met.drop("__level", "__bucket")


def salted_join(facts: DataFrame, side: DataFrame, on: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys spread over several tasks: facts get a salt, the other side one copy per salt.

    Inner, left, semi and anti joins, which keep rows of the facts only.  The salt is drawn
    by row, so equal rows spread too.  The copies are never broadcast: Spark takes them for
    as few as the rows of the other side.
    """
    if how not in ("inner", "left", "left_outer", "leftouter", "left_semi", "semi", "leftsemi", "left_anti", "anti", "leftanti"):
        raise ValueError(f"a salted join cannot be {how}: copies of the other side would come back")
    # By the row's number and not at random: a task that runs again draws the same.
    salt: Column = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    copies = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return facts.withColumn("__salt", salt).join(copies, [on, "__salt"], how).drop("__salt")
