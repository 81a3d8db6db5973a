"""Rasters as long tables of cells: loading, sampling, filtering, populated cells and weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions.geo import cell_area_km2, project
from geostrata.operators.spatial import nearest


@dataclass(frozen=True)
class Raster:
    """A raster: its cells (row, col, value) and where they lie.

    The step along rows is forced to be positive and that along columns negative, whatever sign a
    provider ships; a unit length of 0 or none reads as 1. ``to_xy`` and ``from_xy`` turn columns
    (lon, lat) into the raster's coordinates and back; without them they are the same.
    """

    name: str
    cells: DataFrame
    width: int
    height: int
    ox: float
    oy: float
    rx: float
    ry: float
    nodata: float | None = None
    is_density: bool = False
    is_geographic: bool = True
    to_meter: float = 1.0
    to_xy: object = None
    from_xy: object = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "rx", abs(self.rx))
        object.__setattr__(self, "ry", -abs(self.ry))
        object.__setattr__(self, "to_meter", self.to_meter or 1.0)

    def _xy(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return self.to_xy(lon, lat) if self.to_xy else (lon, lat)

    def area(self, lat: Column) -> Column:
        return cell_area_km2(F.lit(self.is_geographic), F.lit(self.rx), F.lit(self.ry), lat, F.lit(self.to_meter))

    def cell(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(row, col) of a place, null outside the extent."""
        x, y = self._xy(lon, lat)
        col, row = F.floor((x - self.ox) / self.rx), F.floor((y - self.oy) / self.ry)
        inside = (col >= 0) & (col < self.width) & (row >= 0) & (row < self.height)
        return F.when(inside, row), F.when(inside, col)

    def good(self) -> DataFrame:
        """Cells with a value: neither null, nor infinite or not a number, nor the no-data value."""
        v = F.col("value")
        ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        return self.cells.where(ok if self.nodata is None else ok & (v != self.nodata))

    def sample(self, points: DataFrame, out: str = "sample", covers: str | None = None) -> DataFrame:
        """``points`` with the value of each one's cell: null outside the extent or without a value; and whether the extent covers it."""
        row, col = self.cell(F.col("lon"), F.col("lat"))
        at = points.withColumn("_row", row).withColumn("_col", col)
        cells = self.good().select(F.col("row").cast("long").alias("_row"), F.col("col").cast("long").alias("_col"), F.col("value").alias(out))
        # points outside have no cell: they are set aside, so that they don't meet in one task under a null key
        got = at.where("_row is not null").join(cells, ["_row", "_col"], "left").unionByName(at.where("_row is null").withColumn(out, F.lit(None).cast(cells.schema[out].dataType)))
        if covers:
            got = got.withColumn(covers, F.col("_row").isNotNull())
        return got.drop("_row", "_col")

    def people(self, points: DataFrame, out: str = "people") -> DataFrame:
        """``points`` with the people of each one's cell: 0 without a value, density times area; negative values pass."""
        v = F.col("_v") * self.area(F.col("lat")) if self.is_density else F.col("_v")
        return self.sample(points, "_v").withColumn(out, F.coalesce(v, F.lit(0.0))).drop("_v")

    def populated(self) -> DataFrame:
        """(row, col, lon, lat, people): cells with more than 0, by their centre."""
        x, y = self.ox + (F.col("col") + 0.5) * self.rx, self.oy + (F.col("row") + 0.5) * self.ry
        lon, lat = self.from_xy(x, y) if self.from_xy else (x, y)
        cells = self.good().where("value > 0").select("row", "col", "value", lon.alias("lon"), lat.alias("lat"))
        return cells.select("row", "col", "lon", "lat", (F.col("value") * self.area(F.col("lat")) if self.is_density else F.col("value")).alias("people"))


@dataclass(frozen=True)
class Filter:
    """Keep points whose sample compares so; ``op`` is '<=' or, for anything else, '>='."""

    raster: Raster
    op: str
    value: float


def apply_filters(points: DataFrame, filters: list[Filter]) -> DataFrame:
    """``points`` with ``keep`` and ``outside`` (names of rasters whose extent missed it while it was still kept).

    All filters hold together, in order; no value reads as 0.
    """
    out = points.withColumn("keep", F.lit(True)).withColumn("outside", F.array().cast("array<string>"))
    for f in filters:
        out = f.raster.sample(out, "_s", "_c")
        out = out.withColumn("outside", F.when(F.col("keep") & ~F.col("_c"), F.array_append("outside", F.lit(f.raster.name))).otherwise(F.col("outside")))
        v = F.coalesce("_s", F.lit(0.0))
        out = out.withColumn("keep", F.col("keep") & (v <= f.value if f.op == "<=" else v >= f.value)).drop("_s", "_c")
    return out


def outside_counts(filtered: DataFrame) -> DataFrame:
    """(raster, n): points outside each raster's extent, of those kept when its filter was reached."""
    return filtered.select(F.explode("outside").alias("raster")).groupBy("raster").agg(F.count(F.lit(1)).alias("n"))


def allocate(cells: DataFrame, points: DataFrame, out: str) -> DataFrame:
    """(idx, ``out``): people of the cells (idx, x_m, y_m, people) that are nearest to each point; points without a cell are left out."""
    to = nearest(cells, points).where("other >= 0").join(cells.select("idx", "people"), "idx")
    return to.groupBy(F.col("other").alias("idx")).agg(F.sum("people").alias(out))


def weights(raster: Raster, points: DataFrame, allocation: str, frame: DataFrame, out: str) -> DataFrame:
    """``points`` (idx, lon, lat, x_m, y_m) with ``out``: people of its own cell ('sample'), or of all populated cells that are nearest to it ('allocate')."""
    if allocation == "sample":
        return raster.people(points, out)
    cells = project(raster.populated(), frame).withColumn("idx", F.col("row").cast("long") * raster.width + F.col("col"))
    return points.join(allocate(cells, points, out), "idx", "left").withColumn(out, F.coalesce(out, F.lit(0.0)))
