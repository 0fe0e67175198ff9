"""Regions: their settings, where their themes come from, and a cache that is read through and verified."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import sinks
from quadrille.sources import tables


@dataclass(frozen=True)
class Region:
    """name, its projected reference system such as EPSG:3414, and its bounds in degrees (min_lon, min_lat, max_lon, max_lat)."""

    name: str
    crs: str
    box: tuple[float, float, float, float]

    def __post_init__(self) -> None:
        if not re.fullmatch(r"EPSG:[0-9]+", self.crs):
            raise ValueError(f"{self.name}: {self.crs!r} isn't of the form EPSG:<digits>")
        x0, y0, x1, y1 = self.box
        if not (x0 <= x1 and y0 <= y1):
            raise ValueError(f"{self.name}: the bounds are the wrong way round")


def region_of(settings: dict, name: str) -> Region:
    """The region of that name in settings (name to crs and bbox); an unknown name is an error that lists the known ones."""
    if name not in settings:
        raise KeyError(f"unknown region {name}; known: {', '.join(sorted(settings))}")
    return Region(name, settings[name]["crs"], tuple(settings[name]["bbox"]))


class Backend(Protocol):
    """Where themes come from."""

    def read_theme(self, theme: str, box: Sequence[float] | None) -> DataFrame: ...

    def estimate(self, theme: str, box: Sequence[float] | None) -> DataFrame: ...


@dataclass
class PartitionedBackend:
    """Themes as directories theme=.../type=...; the box reaches the scan."""

    spark: SparkSession
    root: str

    def read_theme(self, theme: str, box: Sequence[float] | None) -> DataFrame:
        return tables.read_theme(self.spark, self.root, theme, box)

    def estimate(self, theme: str, box: Sequence[float] | None) -> DataFrame:
        return tables.estimate(self.read_theme(theme, box))


@dataclass
class FolderBackend:
    """Themes as <theme>.parquet in a folder; the box isn't looked at, since such a folder is one region."""

    spark: SparkSession
    folder: str

    def read_theme(self, theme: str, box: Sequence[float] | None) -> DataFrame:
        return tables.require(self.spark.read.parquet(f"{self.folder.rstrip('/')}/{theme}.parquet"), tables.THEMES[theme][1])

    def estimate(self, theme: str, box: Sequence[float] | None) -> DataFrame:
        return tables.estimate(self.read_theme(theme, box))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def invalidate(spark: SparkSession, cache: str, region: str) -> bool:
    """Deletes a cached region; whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{cache.rstrip('/')}/{region}")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))


def load_region(cache: str, region: Region, release: str, backend: Backend, themes: Sequence[str] = tuple(tables.THEMES), refresh: bool = False, confirm: bool = False, limit: int = tables.LARGE) -> dict[str, DataFrame]:
    """The region's themes, from the cache if it has this release and its rows are those of the manifest, else from the backend and into the
    cache. A cache whose rows have changed is an error; so are themes too large together that aren't confirmed (a confirmed load isn't counted)."""
    spark = backend.spark  # type: ignore[attr-defined]
    base = f"{cache.rstrip('/')}/{region.name}"
    if not refresh and _exists(spark, f"{base}/manifest"):
        then = spark.read.parquet(f"{base}/manifest")
        if then.where(F.col("release") != release).isEmpty() and {r.theme for r in then.select("theme").distinct().collect()} >= set(themes):
            found = {t: spark.read.parquet(f"{base}/{t}") for t in themes}
            now = _manifest(found, release, region)
            drift = then.where(F.col("theme").isin(*themes)).join(now, ["theme", "n_rows", "digest"], "left_anti")
            if bad := [r.theme for r in drift.collect()]:
                raise ValueError(f"the cache of {region.name} has changed since it was written: {', '.join(sorted(bad))}")
            return found
    if not confirm:
        total = sum(backend.estimate(t, region.box).first()["n_bytes"] for t in themes)
        if total > limit:
            raise ValueError(f"{region.name}: about {total} bytes; confirm to read them")
    invalidate(spark, cache, region.name)
    for t in themes:
        sinks.write_sorted(backend.read_theme(t, region.box), f"{base}/{t}", ["id"], [])
    found = {t: spark.read.parquet(f"{base}/{t}") for t in themes}
    _manifest(found, release, region).write.parquet(f"{base}/manifest")
    return found


def _manifest(found: dict[str, DataFrame], release: str, region: Region) -> DataFrame:
    """release, region, crs, theme, n_rows, digest."""
    out = None
    for t, df in found.items():
        part = sinks.manifest(df.withColumn("theme", F.lit(t)), ["theme"]).select(F.lit(release).alias("release"), F.lit(region.name).alias("region"), F.lit(region.crs).alias("crs"), "theme", "n_rows", "digest")
        out = part if out is None else out.unionByName(part)
    return out
