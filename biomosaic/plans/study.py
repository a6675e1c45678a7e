"""The macrogroup study: from base tables to the species summaries.

Every step is a lazy DataFrame. Steps used by several results appear in the
plan several times with the same shape, and Spark then runs their shuffles once
per query (reused exchanges); nothing is cached or collected here.
"""

from __future__ import annotations

from dataclasses import MISSING, dataclass, fields, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import UC_WIDTH, fold, species_part
from ..operators import habitat as hab
from ..operators import ranges as rng
from ..operators import screening as scr
from ..operators import summary as smy
from ..sources.tables import stored


@dataclass(frozen=True)
class StudyTables:
    taxa: DataFrame
    submodels: DataFrame
    ancillary: DataFrame
    presence: DataFrame
    map_units: DataFrame
    vegetation_legend: DataFrame
    cover_legend: DataFrame
    ranges: DataFrame
    hucs: DataFrame
    huc_region: DataFrame
    boundaries: DataFrame
    boundary_species: DataFrame
    boundary_cover: DataFrame
    uc_width: int = UC_WIDTH
    # Ranges kept from an earlier run; derived from the other tables if absent.
    season_ranges: DataFrame | None = None
    # The screening kept from an earlier run: all scored species, 1 for those that pass.
    screening: DataFrame | None = None
    # Cells by map unit and HUC, and tight and expanded sums by region, likewise.
    counts: DataFrame | None = None
    by_region: DataFrame | None = None
    # Selected units as bitmaps; tallies are then merged from them.
    unit_bitmaps: DataFrame | None = None

    @classmethod
    def table_names(cls) -> list[str]:
        """The base tables, by the names under which their schemas are declared."""
        return [f.name for f in fields(cls) if f.default is MISSING]


def stored_study(study: MacrogroupStudy, path: str) -> MacrogroupStudy:
    """The study over its counts and regional sums, written once under ``path``.

    ``path`` is a folder that driver and executors share. The sums are made from the
    written counts; summaries of the returned study read what is stored.
    """
    spark = study.tables.taxa.sparkSession
    tables = replace(
        study.tables,
        screening=stored(spark, "screening", study.screening, path),
        counts=stored(spark, "counts", study.counts, path),
    )
    sums = MacrogroupStudy(tables, study.compat).by_region
    return MacrogroupStudy(
        replace(tables, by_region=stored(spark, "by_region", sums, path)), study.compat
    )


class MacrogroupStudy:
    def __init__(self, tables: StudyTables, compat: bool = False):
        self.tables = tables
        self.compat = compat

    def with_season_ranges(self, season_ranges: DataFrame) -> MacrogroupStudy:
        return MacrogroupStudy(replace(self.tables, season_ranges=season_ranges), self.compat)

    def of_species(self, code: str) -> MacrogroupStudy:
        """The study of one species; every table is reduced to it where it is read.

        Stored sums and bitmaps are read by their folded code, of which they keep buckets.
        """
        t = self.tables
        key = fold(F.lit(code))

        def only(frame: DataFrame | None, column: str) -> DataFrame | None:
            if frame is None:
                return None
            if "spp_key" in frame.columns:
                return frame.filter(F.col("spp_key") == key)
            own = F.col(column)
            if column == "species_model_code":
                own = species_part(own, t.uc_width)
            return frame.filter(fold(own) == key)

        by_uc = {name: only(getattr(t, name), "uc") for name in ("taxa", "submodels", "ranges", "season_ranges", "screening")}
        by_model = {name: only(getattr(t, name), "species_model_code") for name in ("ancillary", "presence")}
        by_code = {name: only(getattr(t, name), "spp_code") for name in ("by_region", "unit_bitmaps")}
        cells = only(t.boundary_species, "species_cd")
        return MacrogroupStudy(replace(t, **by_uc, **by_model, **by_code, boundary_species=cells), self.compat)

    @cached_property
    def species(self) -> DataFrame:
        """Species that depend on land cover alone.

        Read from a stored screening, they are a filter over a scan: Spark then knows
        their size when it plans, and while that is below its broadcast threshold it
        reduces ranges and boundary records to them before any shuffle.
        """
        t = self.tables
        if t.screening is not None:
            return t.screening.filter(F.col("screened") == 1).select("uc")
        score = scr.ancillary_score(scr.ancillary_flags(t.ancillary, t.submodels))
        return scr.species_without_ancillary(score, t.submodels, t.presence, t.map_units)

    @cached_property
    def screening(self) -> DataFrame:
        """All scored species and whether they are among :attr:`species`, to be stored."""
        t = self.tables
        score = scr.ancillary_score(scr.ancillary_flags(t.ancillary, t.submodels))
        passed = scr.species_without_ancillary(score, t.submodels, t.presence, t.map_units)
        marked = passed.select("uc", F.lit(1).alias("screened"))
        return score.select("uc").join(marked, "uc", "left").fillna(0, ["screened"])

    def _habitat(self, build, **options) -> DataFrame:
        t = self.tables
        return build(
            t.presence,
            t.taxa,
            t.map_units,
            t.submodels,
            t.vegetation_legend,
            self.species,
            uc_width=t.uc_width,
            **options,
        )

    @cached_property
    def habitat(self) -> DataFrame:
        return self._habitat(hab.habitat_table, compat=self.compat)

    @cached_property
    def habitat_keys(self) -> DataFrame:
        """What the counts need of the habitat table."""
        if self.compat:
            return self._habitat(hab.habitat_table, compat=True, keyed=True)
        return self._habitat(hab.habitat_keys)

    def _season_hucs(self, species: DataFrame | None) -> DataFrame:
        t = self.tables
        if t.season_ranges is not None:
            return t.season_ranges
        return rng.species_season_huc(
            t.ranges, t.hucs, t.boundaries, t.boundary_species, species
        )

    @cached_property
    def season_hucs(self) -> DataFrame:
        return self._season_hucs(self.species)

    @cached_property
    def _cells(self) -> DataFrame:
        """Counts that can match anything: one shape, one shuffle for all uses.

        Two plain null tests, which Spark moves to the tables in every use alike; of
        ``dropna`` it cannot tell what follows for them.
        """
        return self.counts.filter(F.col("huc12rng").isNotNull() & F.col("mu_code").isNotNull())

    @cached_property
    def _counted(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Habitat, submodels and ranges as the counts take them.

        The habitat is limited to the screened species already, so the two
        others need no filter of their own: that would only repeat the
        screening inside the plan. A stored screening repeats nothing and keeps
        other species' records out of the shuffles.
        """
        submodels = hab.submodel_list(self.tables.submodels)
        species = self.species if self.tables.screening is not None else None
        return self.habitat_keys, submodels, self._season_hucs(species)

    @cached_property
    def counts(self) -> DataFrame:
        t = self.tables
        if t.counts is not None:
            return t.counts
        return hab.mapunit_huc_counts(t.hucs, t.boundaries, t.boundary_cover)

    @cached_property
    def submodels(self) -> DataFrame:
        return hab.submodel_list(self.tables.submodels, self.species)

    @cached_property
    def submodel_ranges(self) -> DataFrame:
        return rng.submodel_range(
            self.submodels, self.season_hucs, self.tables.huc_region, self.compat
        )

    @cached_property
    def tight(self) -> DataFrame:
        t = self.tables
        return hab.tight_counts(
            *self._counted,
            t.huc_region,
            self._cells,
            t.cover_legend,
            compat=self.compat,
        )

    @cached_property
    def expanded(self) -> DataFrame:
        t = self.tables
        return hab.expanded_counts(
            *self._counted,
            t.huc_region,
            self._cells,
            t.vegetation_legend,
            compat=self.compat,
        )

    @cached_property
    def by_region(self) -> DataFrame:
        if self.tables.by_region is not None:
            return self.tables.by_region.drop("spp_key")
        return smy.combine_tight_expanded(
            self.tight, self.expanded, self.tables.vegetation_legend, self.compat
        )

    @cached_property
    def tallies(self) -> DataFrame:
        if self.tables.unit_bitmaps is not None:
            return smy.bitmap_tallies(self.tables.unit_bitmaps, self.tables.vegetation_legend)
        return smy.mapunit_tallies(self.habitat_keys, self.tables.vegetation_legend)

    @cached_property
    def summary(self) -> DataFrame:
        return smy.species_macrogroup_summary(self.by_region, self.tallies, self.tables.taxa)

    @cached_property
    def species_summary(self) -> DataFrame:
        return smy.species_summary(self.summary, self.compat)

    @cached_property
    def totals(self) -> DataFrame:
        return smy.species_totals_raw(self.by_region)

    @cached_property
    def huc_habitat(self) -> DataFrame:
        t = self.tables
        return rng.species_huc_habitat(
            t.ranges, t.hucs, t.boundaries, t.boundary_species, self.species, self.compat
        )

    @cached_property
    def ratio(self) -> DataFrame:
        """Region-free comparison."""
        t = self.tables
        return smy.species_macrogroup_ratio(
            self.habitat_keys,
            self.huc_habitat,
            self._cells,
            t.vegetation_legend,
            t.cover_legend,
            self.compat,
        )
