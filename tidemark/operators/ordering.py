"""Order-dependent steps over one long series without a single-task window.

Rows are handled in chunks of the time axis; what must pass from chunk to chunk is a summary row
for each, so a series of any length keeps all tasks busy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.storage import stored

CHUNK = 100_000


def chunk_of(t: Column, size: int = CHUNK) -> Column:
    return F.floor(t / size).cast("bigint")


DRAW_BITS = 52


def drawn(seed: int) -> Column:
    """A seeded number of ``DRAW_BITS`` bits for each row (series_id, t)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", "series_id", F.col("t").cast("string"), F.lit(str(seed)))), 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def smallest_draws(df: DataFrame, most: int, seed: int, bits: int = 12) -> Column:
    """Tells the ``most`` rows (series_id, t) of the smallest draws, exactly as many, ties in order of series and time.

    The last of them is found by refining a histogram: each pass counts 2^bits buckets of the bucket that
    holds it, so two or three passes over the keys do, without a sort. What comes back is a bucket's few rows.
    """
    draw, low, width, before = drawn(seed), 0, DRAW_BITS, 0
    if most <= 0:
        return F.lit(False)
    while True:
        inside = df.where(draw.between(low, low + (1 << width) - 1))
        step = min(bits, width)
        counts = {r["b"]: r["n"] for r in inside.groupBy(F.shiftright(draw - low, width - step).alias("b")).agg(F.count("*").alias("n")).collect()}
        if before + sum(counts.values()) <= most:
            return F.lit(True)  # there are no more rows than that; a narrower bucket always holds the last of them
        for b in sorted(counts):
            if before + counts[b] >= most:
                break
            before += counts[b]
        width -= step
        low += b << width
        if counts[b] <= 1 << bits or not width:
            break
    rows = df.where(draw.between(low, low + (1 << width) - 1)).select(draw.alias("draw"), "series_id", "t").orderBy("draw", "series_id", "t").limit(most - before).collect()
    last = rows[-1]
    key = F.struct(draw.alias("draw"), F.col("series_id"), F.col("t").cast("bigint").alias("t"))
    return key <= F.struct(F.lit(last["draw"]).cast("bigint").alias("draw"), F.lit(last["series_id"]).alias("series_id"), F.lit(last["t"]).cast("bigint").alias("t"))


def with_ordinal(df: DataFrame, name: str = "t") -> DataFrame:
    """Numbers rows 0, 1, … in the order they are stored in: place in the partition plus the rows before it."""
    held = stored(df.select("*", F.monotonically_increasing_id().alias("__id")))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = held.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))
    return held.withColumn("__part", part).join(starts, "__part").withColumn(name, F.col("__start") + place).drop("__part", "__start", "__id")


def with_rank(df: DataFrame, name: str = "rank", chunk: int = CHUNK) -> DataFrame:
    """Ranks rows (series_id, t, …) within their series from 0, closing gaps in ``t``."""
    cut = df.withColumn("__c", chunk_of(F.col("t"), chunk))
    sizes = cut.groupBy("series_id", "__c").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("series_id").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("series_id", "__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("series_id", "__c").orderBy("t")) - 1
    return cut.join(starts, ["series_id", "__c"]).withColumn(name, F.col("__start") + inside).drop("__c", "__start")


def carried(df: DataFrame, values: dict[str, Column], strict: bool = False, forward: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Adds for each name the last non-null of its expression up to each row (or the next, looking back).

    ``strict`` leaves the row itself out. Within a chunk a window does it; across chunks the last
    value of every earlier chunk is carried over a summary.
    """
    ahead = Window.partitionBy("series_id", "__c").orderBy("t" if forward else F.desc("t"))
    upto = ahead.rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    cut = df.select("*", chunk_of(F.col("t"), chunk).alias("__c"), *[v.alias(f"__v_{k}") for k, v in values.items()])
    edge = F.max_by if forward else F.min_by
    sums = cut.groupBy("series_id", "__c").agg(*[edge(F.col(f"__v_{k}"), F.when(F.col(f"__v_{k}").isNotNull(), F.col("t"))).alias(k) for k in values])
    chain = Window.partitionBy("series_id").orderBy("__c" if forward else F.desc("__c")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("series_id", "__c", *[F.last(k, ignorenulls=True).over(chain).alias(f"__b_{k}") for k in values])
    inside = cut.withColumns({f"__v_{k}": F.last(f"__v_{k}", ignorenulls=True).over(upto) for k in values})
    done = inside.join(before, ["series_id", "__c"]).withColumns({k: F.coalesce(f"__v_{k}", f"__b_{k}") for k in values})
    return done.drop("__c", *[f"__{p}_{k}" for p in "vb" for k in values])
