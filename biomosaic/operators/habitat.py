"""Habitat of submodels and its cell counts: tight and expanded.

*Tight* habitat is made of the map units a submodel selects, *expanded* habitat
of every map unit in the same macrogroups.

By default repeated legend rows and overlapping seasons count once.
``compat=True`` keeps the multiplicities that follow from joining the tables
as they are; it is there to reproduce old figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import (
    UC_WIDTH,
    fold,
    season_code,
    species_part,
    submodel_code,
    submodel_season_bit,
)
from .ranges import boundary_hucs, region_range_bits, submodel_range
from .screening import included_submodels
from .triangle import Triangle


def macrogroup_units(legend: DataFrame) -> DataFrame:
    """Distinct pairs of map unit and macrogroup."""
    return legend.select(
        F.col("level3").alias("mu_code"), F.col("macro_cd").alias("mg_code")
    ).distinct()


def macrogroup_names(legend: DataFrame) -> DataFrame:
    """One name per macrogroup, also where the legend has several."""
    names = legend.select(
        F.col("macro_cd").alias("mg_code"), F.col("nvc_macro").alias("mg_name")
    ).distinct()
    return names.groupBy("mg_code").agg(F.min("mg_name").alias("mg_name"))


def _selected_units(
    presence: DataFrame,
    taxa: DataFrame,
    map_units: DataFrame,
    submodels: DataFrame,
    units: DataFrame,
    species: DataFrame | None,
    uc_width: int,
) -> DataFrame:
    models = included_submodels(submodels).select(
        fold("species_model_code").alias("smc_key"),
        fold(species_part(F.col("species_model_code"), uc_width)).alias("uc_key"),
    )
    if species is not None:
        models = models.join(species.select(fold("uc").alias("uc_key")), "uc_key", "left_semi")
    models = models.join(
        taxa.select(
            fold("uc").alias("uc_key"), F.col("uc").alias("spp_code"), "sci_name", "com_name"
        ),
        "uc_key",
    )
    # The dimensions are joined with each other first: the large presence table
    # then meets one table per key instead of one per dimension.
    return (
        presence.filter(F.col("pres") == 1)
        .join(map_units.select("mu_code", "mu_name").join(units, "mu_code"), "mu_code")
        .withColumn("smc_key", fold("species_model_code"))
        .join(models, "smc_key")
    )


def habitat_table(
    presence: DataFrame,
    taxa: DataFrame,
    map_units: DataFrame,
    submodels: DataFrame,
    legend: DataFrame,
    species: DataFrame | None = None,
    uc_width: int = UC_WIDTH,
    compat: bool = False,
    keyed: bool = False,
) -> DataFrame:
    """Map units that each included submodel selects, with their macrogroups.

    ``keyed`` adds the folded submodel code ``smc_key``, by which the rows lie.
    """
    if compat:
        units = legend.select(
            F.col("level3").alias("mu_code"),
            F.col("macro_cd").alias("mg_code"),
            F.col("nvc_macro").alias("mg_name"),
        )
    else:
        units = macrogroup_units(legend).join(macrogroup_names(legend), "mg_code", "left")
    return _selected_units(
        presence, taxa, map_units, submodels, units, species, uc_width
    ).select(
        "spp_code",
        "species_model_code",
        "sci_name",
        "com_name",
        "mu_code",
        "mu_name",
        "mg_code",
        "mg_name",
        *(["smc_key"] if keyed else []),
    )


def habitat_keys(
    presence: DataFrame,
    taxa: DataFrame,
    map_units: DataFrame,
    submodels: DataFrame,
    legend: DataFrame,
    species: DataFrame | None = None,
    uc_width: int = UC_WIDTH,
) -> DataFrame:
    """The codes of :func:`habitat_table` without the names, for counting.

    ``smc_key`` is the folded submodel code, by which the rows lie.
    """
    return _selected_units(
        presence, taxa, map_units, submodels, macrogroup_units(legend), species, uc_width
    ).select("spp_code", "species_model_code", "mu_code", "mg_code", "smc_key")


def habitat_table_species(habitat: DataFrame) -> DataFrame:
    """Map units per species, whichever submodel selects them."""
    return habitat.drop("species_model_code", "smc_key").distinct()


def mapunit_huc_counts(
    hucs: DataFrame, boundaries: DataFrame, boundary_cover: DataFrame
) -> DataFrame:
    """Cells of each land-cover class in each HUC."""
    return (
        boundary_cover.join(boundary_hucs(hucs, boundaries), "boundary")
        .groupBy("huc12rng", F.col("cover").alias("mu_code"))
        .agg(F.sum("count").alias("cells"))
    )


def submodel_list(submodels: DataFrame, species: DataFrame | None = None) -> DataFrame:
    """Included seasonal submodels in the six regions."""
    rows = included_submodels(submodels).filter(
        F.col("region_code").between(1, 6) & season_code(F.col("season_code")).isin(*"SWY")
    )
    if species is not None:
        rows = rows.withColumn("uc_key", fold("uc")).join(
            species.select(fold("uc").alias("uc_key")), "uc_key", "left_semi"
        )
    return rows.select("uc", "season_code", "region_code", "species_model_code")


def _in_submodels(habitat: DataFrame, submodels: DataFrame) -> DataFrame:
    """Habitat rows with region and season of their submodel.

    The link is the code composed from species, season and region.
    """
    code = fold(submodel_code(F.col("uc"), F.col("season_code"), F.col("region_code")))
    models = submodels.select(
        code.alias("smc_key"), "region_code", season_code(F.col("season_code")).alias("season")
    ).distinct()
    if "smc_key" not in habitat.columns:
        habitat = habitat.withColumn("smc_key", fold("species_model_code"))
    return habitat.join(models, "smc_key")


def region_habitat(habitat: DataFrame, submodels: DataFrame) -> DataFrame:
    """Per species, region and map unit: the submodel seasons that select it.

    Rows lie by species (``uc_key``) and region, as both counts join them with ranges.
    """
    return (
        _in_submodels(habitat, submodels)
        .dropna(subset=["spp_code", "region_code", "mu_code"])
        .withColumn("uc_key", fold("spp_code"))
        .repartition("uc_key", "region_code")
        .groupBy("uc_key", "spp_code", "region_code", "mu_code", "mg_code")
        .agg(F.bit_or(submodel_season_bit(F.col("season"))).alias("habitat_bits"))
    )


_SHARED_SEASON = "(habitat_bits & range_bits) != 0"


def _known_classes(counts: DataFrame, cover_legend: DataFrame | None) -> DataFrame:
    """Counts of classes in the legend.

    Not a semi-join: the optimizer would move that below the aggregation of the
    counts, and the expanded side could no longer share their shuffle.
    """
    if cover_legend is None:
        return counts
    classes = cover_legend.select(F.col("value").alias("mu_code")).distinct()
    return counts.join(classes, "mu_code")


def _tight_cells(
    selected: DataFrame, counts: DataFrame, huc_region: DataFrame, in_range: DataFrame
) -> Triangle:
    placed = counts.join(huc_region.distinct(), "huc12rng")
    return Triangle(
        selected, placed, ["region_code", "mu_code"], in_range, ["uc_key", "region_code"], ["huc12rng"]
    )


def tight_counts(
    habitat: DataFrame,
    submodels: DataFrame,
    season_hucs: DataFrame,
    huc_region: DataFrame,
    counts: DataFrame,
    cover_legend: DataFrame | None = None,
    zero_fill: bool = False,
    compat: bool = False,
) -> DataFrame:
    """Cells of the selected map units per species, region, unit and HUC.

    Selected units, the HUCs that contain them and the ranges of the species
    form a triangle. A selection is opened by the HUCs that have the unit or by
    those of the species' range in the region, whichever are fewer: a unit that
    every species selects does not bring all its HUCs to species that live in
    few, nor a wide range all its HUCs to a rare unit. ``zero_fill`` starts
    from all HUCs in range instead and reports units without cells there as
    zero, which adds nothing to any sum.
    """
    counts = _known_classes(counts, cover_legend)
    if compat:
        return _tight_counts_as_joined(habitat, submodels, season_hucs, huc_region, counts)
    selected = region_habitat(habitat, submodels)
    in_range = region_range_bits(season_hucs, huc_region)
    if zero_fill:
        cells = (
            selected.join(in_range, ["uc_key", "region_code"])
            .filter(_SHARED_SEASON)
            .join(counts, ["huc12rng", "mu_code"], "left")
        )
    else:
        cells = _tight_cells(selected, counts, huc_region, in_range).joined().filter(_SHARED_SEASON)
    return cells.select(
        "spp_code",
        "region_code",
        "mu_code",
        "mg_code",
        "huc12rng",
        F.coalesce("cells", F.lit(0)).alias("hab_mu_cnt"),
    )


def _rows_by_species(habitat: DataFrame, submodels: DataFrame) -> DataFrame:
    """Habitat rows of submodels with all their names, lying by species."""
    rows = _in_submodels(habitat, submodels).withColumn("uc_key", fold("spp_code"))
    return (
        rows.select("uc_key", "spp_code", "region_code", "season", "mu_code", "mu_name", "mg_code", "mg_name")
        .filter(F.col("uc_key").isNotNull() & F.col("region_code").isNotNull())
        .repartition("uc_key")
    )


def _reduced(rows: DataFrame, keys: list[str], *sums: Column) -> DataFrame:
    """``rows`` grouped by ``keys`` in a way that needs all their columns: none is pruned,
    and one shuffle of the rows serves all that is made of them."""
    return rows.groupBy(*keys).agg(*sums, F.max(F.xxhash64(*rows.columns)).alias("_all")).filter("_all IS NOT NULL").drop("_all")


def _tight_counts_as_joined(
    habitat: DataFrame,
    submodels: DataFrame,
    season_hucs: DataFrame,
    huc_region: DataFrame,
    counts: DataFrame,
) -> DataFrame:
    """Tight counts with the multiplicities of the unreduced joins.

    A cell count is repeated for every legend row of the unit, every season row
    of the species in the HUC and every matching range row. Only distinct
    results are kept over the seasons of a region, so differing ones add up.
    The factors are counted and multiplied; the repeated rows are never made. A unit of a
    species and region is opened by its HUCs without seasons and names, and shuffled by
    the species, so that what it opened stays side by side and compresses. Rows lie by
    the species from then on, as do its ranges, with the factors of all seasons in one
    row, and its selections, which bring the seasons and names back.
    """
    unit = ["uc_key", "spp_code", "region_code", "season", "mu_code"]
    names = ["mu_name", "mg_code", "mg_name"]
    pair = ["uc_key", "region_code", "mu_code"]
    rows = _rows_by_species(habitat, submodels)
    selected = (
        rows.groupBy(*unit, *names)
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("legend_rows", F.sum("rows").over(Window.partitionBy(*unit)))
        .drop("rows")
    )

    place = ["uc_key", "huc12rng"]
    season_rows = season_hucs.groupBy(fold("uc").alias("uc_key"), "huc12rng").agg(
        F.count(F.lit(1)).alias("season_rows")
    )
    range_rows = (
        submodel_range(submodels, season_hucs, huc_region, compat=True)
        .groupBy(
            fold("uc").alias("uc_key"),
            "region_code",
            season_code(F.col("season_code")).alias("season"),
            "huc12rng",
        )
        .agg(F.count(F.lit(1)).alias("range_rows"))
        .join(season_rows, place)
        .select(*place, "region_code", F.struct("season", F.col("season_rows") * F.col("range_rows")).alias("factor"))
        .groupBy(*place, "region_code")
        .agg(F.map_from_entries(F.collect_list("factor")).alias("factors"))
        .repartition("uc_key")
    )
    opened = _reduced(rows, pair).join(counts.join(huc_region.distinct(), "huc12rng"), ["region_code", "mu_code"])
    return (
        opened.select(*pair, "huc12rng", "cells")
        .repartition("uc_key")
        .join(range_rows, [*place, "region_code"])
        .join(selected, pair)
        .withColumn("factor", F.try_element_at("factors", "season"))
        .filter(F.col("factor").isNotNull())
        .select(
            *place, "spp_code", "region_code", "mu_code", *names,
            (F.col("cells") * F.col("legend_rows") * F.col("factor")).alias("hab_mu_cnt"),
        )
        .distinct()
        .select("spp_code", "region_code", "mu_code", *names, "huc12rng", "hab_mu_cnt")
    )


def macrogroup_huc_counts(counts: DataFrame, units: DataFrame) -> DataFrame:
    """Cells of each macrogroup in each HUC."""
    return (
        counts.join(units.filter(F.col("mg_code").isNotNull()), "mu_code")
        .groupBy("huc12rng", "mg_code")
        .agg(F.sum("cells").alias("hab_mg_cnt"))
    )


def expanded_counts(
    habitat: DataFrame,
    submodels: DataFrame,
    season_hucs: DataFrame,
    huc_region: DataFrame,
    counts: DataFrame,
    legend: DataFrame,
    compat: bool = False,
) -> DataFrame:
    """Cells of whole macrogroups per species, region, macrogroup and HUC.

    The counts are added up per macrogroup first, so the map units of a
    macrogroup are never listed per species. ``compat`` counts a map unit once
    per name it has and keeps one row per macrogroup name.
    """
    keys = ["spp_code", "region_code", "mg_code"]
    if compat:
        keys.append("mg_name")
        bits = F.bit_or(submodel_season_bit(F.col("season"))).alias("habitat_bits")
        chosen = _reduced(_rows_by_species(habitat, submodels), ["uc_key", *keys], bits)
        units = legend.select(
            F.col("level3").alias("mu_code"), "ecosys_lu", F.col("macro_cd").alias("mg_code")
        ).distinct()
    else:
        chosen = (
            region_habitat(habitat, submodels)
            .groupBy("uc_key", *keys)
            .agg(F.bit_or("habitat_bits").alias("habitat_bits"))
        )
        units = macrogroup_units(legend)
    # Both groups of a key are bounded by dimensions here: the macrogroups of
    # the legend and the HUCs of one region.
    placed = (
        chosen.join(region_range_bits(season_hucs, huc_region), ["uc_key", "region_code"])
        .filter(_SHARED_SEASON)
    )
    # No macrogroup in the counts and no HUC in range is null, so null-safe equality
    # finds the same rows. Unlike plain equality it puts no filter below region_habitat
    # and the ranges, whose shuffles the tight counts can then share.
    cells = macrogroup_huc_counts(counts, units).withColumnsRenamed(
        {"huc12rng": "_huc", "mg_code": "_mg"}
    )
    same_place = F.col("huc12rng").eqNullSafe(F.col("_huc")) & F.col("mg_code").eqNullSafe(F.col("_mg"))
    return placed.join(cells, same_place).select(*keys, "huc12rng", "hab_mg_cnt")
