"""Labels, colours and legends as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default ramp, fills of unknown and last-mile places, words of band labels.
RAMP = ("#eaf1f5", "#164a68")
UNKNOWN_FILL, LAST_MILE_FILL = "#c9ccce", "#9da0a2"
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth"]
FRACTIONS = {2: "half", 3: "third", 4: "quarter", 5: "fifth", 6: "sixth", 7: "seventh"}


def band_label(band: Column, k: Column) -> Column:
    """"lowest fifth", "second-lowest fifth", "highest fifth", or "whole area" for one band."""
    part = F.concat(F.lit("1/"), k.cast("string"))
    for n, word in FRACTIONS.items():
        part = F.when(k == n, word).otherwise(part)
    nth = F.coalesce(F.get(F.array(*map(F.lit, ORDINALS)), band), F.concat((band + 1).cast("string"), F.lit("th")))
    return F.when(k <= 1, "whole area").when(band == 0, F.concat(F.lit("lowest "), part)).when(band == k - 1, F.concat(F.lit("highest "), part)).otherwise(F.concat(nth, F.lit("-lowest "), part))


def subarea_label(band: Column, k: Column, scattered: Column) -> Column:
    base = F.concat(band_label(band, k), F.lit(" of this area"))
    return F.when(scattered, F.concat(F.lit("scattered points — "), base)).otherwise(base)


def _mix(low: str, high: str, t: Column, at: int) -> Column:
    a, b = int(low[at : at + 2], 16), int(high[at : at + 2], 16)
    return F.lpad(F.lower(F.hex(F.floor(F.lit(float(a)) + F.lit(float(b - a)) * t + 0.5).cast("long"))), 2, "0")


def ramp_colour(t: Column, ramp: tuple[str, str] = RAMP) -> Column:
    """The colour at ``t`` between the ramp's ends, held to 0..1."""
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.concat(F.lit("#"), *(_mix(*ramp, u, at) for at in (1, 3, 5)))


def scale_colour(value: Column, low: Column, high: Column, ramp: tuple[str, str] = RAMP) -> Column:
    """The colour of a value between two ends; the ramp's low end where they are one."""
    return ramp_colour(F.when(high - low > 0, (value - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.0), ramp)


def absolute_fill(subareas: DataFrame, ramp: tuple[str, str] = RAMP) -> DataFrame:
    """``subareas`` with ``fill`` by mean ability over all of them; without a mean, the unknown fill."""
    ends = subareas.agg(F.min("mean_ability").alias("_lo"), F.max("mean_ability").alias("_hi"))  # one row
    fill = F.when(F.col("mean_ability").isNull(), UNKNOWN_FILL).otherwise(scale_colour(F.col("mean_ability"), F.col("_lo"), F.col("_hi"), ramp))
    return subareas.crossJoin(F.broadcast(ends)).withColumn("fill", fill).drop("_lo", "_hi")


def band_fill(band: Column, k: Column, ramp: tuple[str, str] = RAMP) -> Column:
    """A band's colour by its rank in its own cluster."""
    return scale_colour(band.cast("double"), F.lit(0.0), F.greatest(F.lit(1), k - 1).cast("double"), ramp)


def absolute_legend(subareas: DataFrame, steps: int = 5, ramp: tuple[str, str] = RAMP) -> DataFrame:
    """(stop, value, colour): evenly spaced values from the lowest to the highest mean, two at least."""
    n = max(2, steps)
    ends = subareas.agg(F.min("mean_ability").alias("lo"), F.max("mean_ability").alias("hi")).where("lo is not null")
    each = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("stop"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("stop") / (n - 1)
    return each.select("stop", value.alias("value"), scale_colour(value, F.col("lo"), F.col("hi"), ramp).alias("colour"))


def band_legend(subareas: DataFrame, clusters: DataFrame) -> DataFrame:
    """(parent, band, label, range_min, range_max) of each cluster's bands."""
    each = subareas.groupBy("parent", "band").agg(F.min_by(F.struct("range_min", "range_max"), F.struct("scattered", "seq")).alias("r"))
    return each.join(clusters.select("parent", "k"), "parent").select("parent", "band", band_label(F.col("band"), F.col("k")).alias("label"), "r.range_min", "r.range_max")
