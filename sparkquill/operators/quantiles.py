"""Exact percentiles of large groups without gathering a group's values anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

#: Bins of one pass, values that are sorted at last, and rows of a group that ``percentile`` may hold.
BINS, FEW, SMALL = 4096, 10_000, 1_000_000


def percentiles(rows: DataFrame, group: str, value: str, shares: list[float], small: int = SMALL, few: int = FEW, bins: int = BINS) -> DataFrame:
    """``group`` and p0, p1, ... for ``shares``: linear between the two nearest ranks; a share under 0 counts as 0, one over 1 as 1.

    Groups of up to ``small`` values go to Spark's own aggregate. In each of the others, of which there are at most rows /
    ``small``, the range that holds a rank is cut into ``bins``, the values of each bin are counted, and the bin that holds the rank is
    the next range, until it holds one distinct value or ``few`` rows: each pass carries counts alone. Nulls and NaN are left out.
    """
    shares = [min(1.0, max(0.0, s)) for s in shares]
    rows = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    sizes = scratch.saved(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "sizes")
    large = sizes.where(F.col("n") > small)
    plain = rows if large.isEmpty() else _without(rows, large)
    usual = plain.groupBy("g").agg(*[F.percentile("v", F.lit(s)).alias(f"p{i}") for i, s in enumerate(shares)])
    found = usual if large.isEmpty() else usual.unionByName(_refined(rows, large, shares, few, bins))
    return found.withColumnRenamed("g", group)


def _without(rows: DataFrame, large: DataFrame) -> DataFrame:
    named = large.select(F.col("g").alias("_g"))
    return rows.join(F.broadcast(named), F.col("g").eqNullSafe(F.col("_g")), "left_anti")


def _refined(rows: DataFrame, large: DataFrame, shares: list[float], few: int, bins: int) -> DataFrame:
    spark = rows.sparkSession
    kind = rows.schema["g"].dataType.simpleString()
    # ranks are asked for by number: which group and share they belong to stays here, in one row a large group
    held = [(r.g, r.n, r.low, r.high) for r in large.collect()]
    open_, done = {}, {}
    for at, (g, n, low, high) in enumerate(held):
        for s in shares:
            for rank in {int(s * (n - 1)), min(n - 1, int(s * (n - 1)) + 1)}:
                open_[at, rank] = (g, low, high, rank)  # of the values from low to high, the one with ``rank`` below it
    while open_:
        done |= {key: low for key, (_, low, high, _) in open_.items() if low == high}
        open_ = {key: o for key, o in open_.items() if key not in done}
        if not open_:
            break
        asked = spark.createDataFrame([(at, rank, *o) for (at, rank), o in open_.items()], f"at int, rank long, g {kind}, low double, high double, below long")
        asked = asked.withColumnRenamed("g", "_g")
        met = rows.join(F.broadcast(asked), F.col("g").eqNullSafe(F.col("_g")) & F.col("v").between(F.col("low"), F.col("high")))
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        counted = met.groupBy("at", "rank", "below", F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int").alias("bin"))
        counts = counted.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        bins_of: dict[tuple[int, int], list] = {}
        for r in counts.collect():  # at most ``bins`` rows a rank
            bins_of.setdefault((r["at"], r["rank"]), []).append((r.bin, r.n, r.low, r.high))
        last = []
        for key, found in bins_of.items():
            g, _, _, below = open_[key]
            for _, n, low, high in sorted(found):
                if below < n:
                    break
                below -= n
            open_[key] = (g, low, high, below)
            if n <= few and low < high:
                last.append(key)
        if last:
            asked = spark.createDataFrame([(*key, *open_[key]) for key in last], f"at int, rank long, g {kind}, low double, high double, below long").withColumnRenamed("g", "_g")
            met = rows.join(F.broadcast(asked), F.col("g").eqNullSafe(F.col("_g")) & F.col("v").between(F.col("low"), F.col("high")))
            picked = met.groupBy("at", "rank", "below").agg(F.sort_array(F.collect_list("v")).alias("vs")).select("at", "rank", F.get("vs", F.col("below").cast("int")).alias("v"))
            done |= {(r["at"], r["rank"]): r.v for r in picked.collect()}
            open_ = {key: o for key, o in open_.items() if key not in done}
    out = []
    for at, (g, n, _, _) in enumerate(held):
        row = []
        for s in shares:
            place = s * (n - 1)
            low, high = done[at, int(place)], done[at, min(n - 1, int(place) + 1)]
            row.append(low + (high - low) * (place - int(place)) if place != int(place) else low)
        out.append((g, *row))
    return spark.createDataFrame(out, f"g {kind}, " + ", ".join(f"p{i} double" for i in range(len(shares))))
