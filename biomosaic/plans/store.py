"""The study kept on disk: facts by boundary, results by region and species.

Every stored table lies in buckets (:mod:`..sources.buckets`). A manifest holds
fingerprints of the input files and of what the results of each region are made from: a
store whose inputs have changed since is not read, and bringing it up to date rewrites
the regions that differ.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import fold
from ..operators import habitat as hab
from ..operators import ranges as rng
from ..operators import summary as smy
from ..sources.buckets import Buckets
from ..sources.tables import read_tables, stored
from .study import MacrogroupStudy, StudyTables

# Boundary tables as they are kept, their species codes folded.
BY_BOUNDARY = {
    "boundaries": "boundary long, huc12rng string",
    "boundary_species": "boundary long, species_cd string, count long",
    "boundary_cover": "boundary long, cover long, count long",
    "boundary_vegetation": "boundary long, vegetation long, count long",
}


def _by_boundary(root: str, buckets: int) -> dict[str, Buckets]:
    return {name: Buckets(f"{root}/{name}", ddl, "boundary", buckets) for name, ddl in BY_BOUNDARY.items()}


def write_by_boundary(tables: dict[str, DataFrame], root: str, buckets: int) -> dict[str, DataFrame]:
    """Keeps the facts and the watershed unit of each boundary in buckets of the boundary.

    ``tables`` are conformed tables, ``hucs`` among them; those not given are not kept.
    The returned ``boundaries`` hold the unit, so that facts meet it where they lie, and
    take the place of the table of that name in the operators and in the study.
    """
    ready = {name: tables[name] for name in BY_BOUNDARY if name in tables}
    ready["boundaries"] = rng.boundary_hucs(tables["hucs"], tables["boundaries"])
    if "boundary_species" in ready:
        ready["boundary_species"] = ready["boundary_species"].withColumn("species_cd", fold("species_cd"))
    kept = _by_boundary(root, buckets)
    return {name: kept[name].write(frame) for name, frame in ready.items()}


def read_by_boundary(spark: SparkSession, root: str, buckets: int, *names: str) -> dict[str, DataFrame]:
    kept = _by_boundary(root, buckets)
    return {name: kept[name].open(spark) for name in names or BY_BOUNDARY}


class StaleStore(Exception):
    """The inputs have changed since the store was written, or nothing was."""


def _digest(*columns: str) -> list:
    """Count and order-free sum of hashes of rows."""
    hashed = F.xxhash64(*columns).cast("decimal(38, 0)")
    return [F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(hashed), F.lit(0)).cast("string").alias("digest")]


def _nowhere(frame: DataFrame, part: str) -> DataFrame:
    """Digest of a whole frame, which belongs to no region."""
    return frame.agg(*_digest(*frame.columns)).select(
        F.lit(part).alias("part"), F.lit(None).cast("int").alias("region_code"), "records", "digest"
    )


def input_fingerprints(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """(part, region_code, records, digest) of the files of each table, which are not read."""

    def listed(name: str) -> DataFrame:
        files = (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
            .load(f"{root}/{name}").select("path", "length", "modificationTime")
        )
        return _nowhere(files, f"{_FILES}{name}")

    return reduce(DataFrame.unionAll, map(listed, names))


# Another label when the layout of a store changes: what was written before is then stale.
_FILES = "files, units in longs, of "
_MANIFEST = "part string, region_code int, records long, digest string"
_SUMS = "spp_key string, spp_code string, mg_code string, mg_name string, hab_mu_cnt long, hab_mg_cnt long, region_code int"
_BITMAPS = "spp_key string, spp_code string, mg_code string, bucket long, units long"


@dataclass(frozen=True)
class StudyStore:
    """Regional sums and unit bitmaps of the study over the tables in ``inputs``.

    ``inputs`` and ``path`` are folders that driver and executors share; ``inputs`` has a
    Parquet folder for each base table. Sums lie in directories of their region and, like
    the bitmaps, in buckets of the folded species code: ``open().of_species(code)`` reads
    one bucket. A store is written by one job at a time.
    """

    spark: SparkSession
    inputs: str
    path: str
    buckets: int = 64
    uc_width: int = StudyTables.uc_width

    @cached_property
    def study(self) -> MacrogroupStudy:
        """The study over the inputs."""
        return MacrogroupStudy(StudyTables(**read_tables(self.spark, self.inputs, *StudyTables.table_names()), uc_width=self.uc_width))

    @property
    def _sums(self) -> Buckets:
        return Buckets(f"{self.path}/by_region", _SUMS, "spp_key", self.buckets, "region_code")

    @property
    def _bitmaps(self) -> Buckets:
        return Buckets(f"{self.path}/unit_longs", _BITMAPS, "spp_key", self.buckets)

    def _files(self) -> DataFrame:
        return input_fingerprints(self.spark, self.inputs, *StudyTables.table_names())

    @property
    def _manifest(self) -> Buckets:
        return Buckets(f"{self.path}/manifest", _MANIFEST, "part", 1)

    def _known(self) -> set[tuple]:
        return {tuple(r) for r in self._manifest.open(self.spark).collect()}  # a few rows a region

    def _remember(self, rows: set[tuple]) -> None:
        self._manifest.write(self.spark.createDataFrame(sorted(rows, key=str), _MANIFEST))

    @staticmethod
    def _parts(study: MacrogroupStudy) -> DataFrame:
        """Digests of what each region's sums are made from, and of the legends."""
        t = study.tables
        habitat, submodels, ranges = study._counted
        regions = t.huc_region.distinct()
        of_region = {
            "cells": study._cells.join(regions, "huc12rng"),
            "ranges": rng.region_range_bits(ranges, regions),
            "habitat": hab.region_habitat(habitat, submodels),
        }
        digests = [
            frame.dropna(subset=["region_code"]).groupBy("region_code").agg(*_digest(*sorted(frame.columns)))
            .select(F.lit(part).alias("part"), "region_code", "records", "digest")
            for part, frame in of_region.items()
        ]
        digests += [_nowhere(getattr(t, part), part) for part in ("cover_legend", "vegetation_legend")]
        return reduce(DataFrame.unionAll, digests)

    @staticmethod
    def _changed(known: set[tuple], parts: set[tuple]) -> list[int]:
        """Regions whose parts differ; all of them where a legend does."""
        kept = {r for r in known if not r[0].startswith(_FILES)}
        differ = {region for _, region, _, _ in kept ^ parts}
        if None in differ:
            differ = {region for _, region, _, _ in kept | parts}
        return sorted(differ - {None})

    def refresh(self) -> list[int]:
        """Brings the store up to date and returns the regions that were rewritten.

        The cells are counted once and kept; regions are compared by digests of their
        cells, ranges and habitat. A rewritten region holds a row without a species,
        which makes its directory even where no sums are left, and is never read. What
        is about to change leaves the manifest first and enters it last: a job that is
        lost leaves a store that counts as stale and whose regions are written again.
        """
        spark, known, files = self.spark, self._known(), {tuple(r) for r in self._files().collect()}
        if files <= known:
            return []
        counts = stored(spark, "counts", self.study.counts, self.path)
        screening = stored(spark, "screening", self.study.screening, self.path)
        study = MacrogroupStudy(replace(self.study.tables, counts=counts, screening=screening))
        parts = {tuple(r) for r in self._parts(study).collect()}
        regions = self._changed(known, parts)
        self._remember(known & parts)
        if regions:
            t = study.tables
            own = replace(t, huc_region=t.huc_region.filter(F.col("region_code").isin(regions)))
            sums = MacrogroupStudy(own).by_region.withColumn("spp_key", fold("spp_code"))
            marks = spark.createDataFrame([(r,) for r in regions], "region_code int")
            self._sums.write(sums.unionByName(marks, allowMissingColumns=True))
        units = smy.unit_bitmaps(study.habitat_keys)
        self._bitmaps.write(units.withColumn("spp_key", fold("spp_code")))
        self._remember(files | parts)
        return regions

    def open(self) -> MacrogroupStudy:
        """The study over what is stored; :class:`StaleStore` unless that fits the inputs."""
        if not {tuple(r) for r in self._files().collect()} <= self._known():
            raise StaleStore(f"{self.path} does not fit {self.inputs}: refresh it")
        return MacrogroupStudy(
            replace(
                self.study.tables,
                by_region=self._sums.open(self.spark).filter("spp_key IS NOT NULL"),
                unit_bitmaps=self._bitmaps.open(self.spark),
            )
        )
