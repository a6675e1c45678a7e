"""Seasonal species ranges over watershed units (HUCs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import (
    RANGE_SEASONS,
    fold,
    range_season,
    range_season_bits,
    season_code,
)

# Fixed value: range records at or above this presence code are not occupied.
PRESENCE_LIMIT = 4


def boundary_hucs(hucs: DataFrame, boundaries: DataFrame) -> DataFrame:
    """HUC of each boundary; boundaries that are stored with it bring it along."""
    if "huc12rng" in boundaries.columns:
        return boundaries.select("boundary", "huc12rng")
    return boundaries.join(hucs, boundaries["huc_id"] == hucs["objectid"]).select(
        "boundary", "huc12rng"
    )


def _occupied(ranges: DataFrame, species: DataFrame | None) -> DataFrame:
    """Occupied range records, counted per spelling of the code, season and HUC.

    Counting by the code as written leaves few rows for the later steps, which
    compare folded codes and pick one spelling; picking a string while grouping
    needs sorted input, which the full table should not be put through.
    """
    records = (
        ranges.filter(
            (F.col("range_pres") < PRESENCE_LIMIT) & F.col("range_seas").isin(*RANGE_SEASONS)
        )
        .groupBy("uc", "range_seas", "huc12rng")
        .agg(F.count(F.lit(1)).alias("records"))
        .withColumn("uc_key", fold("uc"))
    )
    return _of_species(records, species)


def _of_species(records: DataFrame, species: DataFrame | None) -> DataFrame:
    """Records of the listed species only, before anything else is joined or shuffled."""
    if species is None:
        return records
    return records.join(species.select(fold("uc").alias("uc_key")), "uc_key", "left_semi")


def species_season_huc(
    ranges: DataFrame,
    hucs: DataFrame,
    boundaries: DataFrame,
    boundary_species: DataFrame,
    species: DataFrame | None = None,
) -> DataFrame:
    """Seasons and HUCs of each range in which the species has a boundary record.

    The boundary records are reduced to distinct (species, HUC) before they
    meet the ranges, so that a HUC with many boundaries is never expanded.
    """
    recorded = (
        _of_species(boundary_species.select("boundary", fold("species_cd").alias("uc_key")), species)
        .join(boundary_hucs(hucs, boundaries), "boundary")
        .select("uc_key", "huc12rng")
        .distinct()
    )
    return (
        _occupied(ranges, species)
        .groupBy("uc_key", range_season(F.col("range_seas")).alias("season"), "huc12rng")
        .agg(F.min("uc").alias("uc"), F.sum("records").alias("records"))
        .filter(F.col("records") > 0)  # always so; it keeps the grouping by the code as written
        .join(recorded, ["uc_key", "huc12rng"], "left_semi")
        .select("uc", "season", "huc12rng")
    )


def species_huc_habitat(
    ranges: DataFrame,
    hucs: DataFrame,
    boundaries: DataFrame,
    boundary_species: DataFrame,
    species: DataFrame | None = None,
    compat: bool = False,
) -> DataFrame:
    """Cells of a species in the HUCs of its range, all seasons together.

    With ``compat`` the cells of a HUC count once per range record of it.
    """
    counted = boundary_species.select("boundary", fold("species_cd").alias("uc_key"), "count")
    cells = (
        _of_species(counted, species)
        .join(boundary_hucs(hucs, boundaries), "boundary")
        .groupBy("uc_key", "huc12rng")
        .agg(F.sum("count").alias("cells"))
    )
    range_hucs = (
        _occupied(ranges, species)
        .groupBy("uc_key", "huc12rng")
        .agg(F.min("uc").alias("uc"), F.sum("records").alias("records"))
    )
    hab_cnt = F.col("cells") * F.col("records") if compat else F.col("cells")
    return range_hucs.join(cells, ["uc_key", "huc12rng"]).select(
        "uc", "huc12rng", F.coalesce(hab_cnt, F.lit(0)).alias("hab_cnt")
    )


def submodel_range(
    submodels: DataFrame, season_hucs: DataFrame, huc_region: DataFrame, compat: bool = False
) -> DataFrame:
    """HUCs of a submodel: in its region, occupied in its season or all year.

    Year-round records are turned into one record per season beforehand, which
    leaves a join on equal keys only. ``compat`` keeps repeated HUCs.
    """
    season = season_code(F.col("season"))
    serves = F.when(season == "Y", F.array(*map(F.lit, "SWY"))).otherwise(F.array(season))
    served = season_hucs.select(
        fold("uc").alias("uc_key"), "huc12rng", F.explode(serves).alias("season_key")
    )
    places = served.join(huc_region, "huc12rng")
    models = submodels.select(
        "uc",
        fold("uc").alias("uc_key"),
        "region_code",
        "season_code",
        season_code(F.col("season_code")).alias("season_key"),
    ).distinct()
    keys = ["uc_key", "region_code", "season_key"]
    if not compat:
        places = places.distinct()
    return places.join(models, keys).select("uc", "region_code", "season_code", "huc12rng")


def region_range_bits(season_hucs: DataFrame, huc_region: DataFrame) -> DataFrame:
    """Per species, region and HUC: the submodel seasons that the range serves.

    Rows without a key match nothing. They go here, so that every use of the ranges has
    the same null tests and their shuffles can be reused.
    """
    return (
        season_hucs.select(
            fold("uc").alias("uc_key"),
            "huc12rng",
            range_season_bits(F.col("season")).alias("bits"),
        )
        .join(huc_region, "huc12rng")
        .dropna(subset=["uc_key", "region_code", "huc12rng"])
        .groupBy("uc_key", "region_code", "huc12rng")
        .agg(F.bit_or("bits").alias("range_bits"))
    )
