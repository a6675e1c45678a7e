"""Tight against expanded habitat per macrogroup and per species."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import fold
from ..functions.numbers import expanded_share_pct, growth_pct, hectares, ratio_pct
from .habitat import (
    _known_classes,
    _reduced,
    macrogroup_huc_counts,
    macrogroup_names,
    macrogroup_units,
)
from .triangle import Triangle

_ANY_CELLS = "hab_mu_cnt > 0 OR hab_mg_cnt > 0"


def _sum_sides(tight: DataFrame, expanded: DataFrame, keys: list[str]) -> DataFrame:
    """Both sums per key, zero where a side has none, without all-zero rows.

    Stacking the sides and adding up gives what a full join with zero fill
    would, in one aggregation with partial sums before the shuffle.
    """
    none = F.lit(0).cast("long")
    stacked = tight.select(*keys, "hab_mu_cnt", none.alias("hab_mg_cnt")).unionByName(
        expanded.select(*keys, none.alias("hab_mu_cnt"), "hab_mg_cnt")
    )
    return (
        stacked.groupBy(*keys)
        .agg(F.sum("hab_mu_cnt").alias("hab_mu_cnt"), F.sum("hab_mg_cnt").alias("hab_mg_cnt"))
        .filter(_ANY_CELLS)
    )


def _full_join_sides(tight: DataFrame, expanded: DataFrame, keys: list[str]) -> DataFrame:
    """The two sides summed per macrogroup name but joined on the code alone."""
    named = [*keys, "mg_name"]
    mu = tight.groupBy(*named).agg(F.sum("hab_mu_cnt").alias("hab_mu_cnt"))
    mg = expanded.groupBy(*named).agg(F.sum("hab_mg_cnt").alias("hab_mg_cnt"))
    mg = mg.withColumnRenamed("mg_name", "mg_name_expanded")
    return (
        mu.join(mg, keys, "full")
        .select(
            *keys,
            F.coalesce("mg_name", "mg_name_expanded").alias("mg_name"),
            F.coalesce("hab_mu_cnt", F.lit(0)).alias("hab_mu_cnt"),
            F.coalesce("hab_mg_cnt", F.lit(0)).alias("hab_mg_cnt"),
        )
        .filter(_ANY_CELLS)
    )


def combine_tight_expanded(
    tight: DataFrame, expanded: DataFrame, legend: DataFrame, compat: bool = False
) -> DataFrame:
    """Tight and expanded cells per species, region and macrogroup."""
    keys = ["spp_code", "region_code", "mg_code"]
    if compat:
        return _full_join_sides(tight, expanded, keys)
    return (
        _sum_sides(tight, expanded, keys)
        .join(macrogroup_names(legend), "mg_code", "left")
        .select(*keys, "mg_name", "hab_mu_cnt", "hab_mg_cnt")
    )


def mapunit_tallies(habitat: DataFrame, legend: DataFrame) -> DataFrame:
    """Selected map units per species and macrogroup, and all units it has."""
    per_group = (
        macrogroup_units(legend).groupBy("mg_code").agg(F.count_distinct("mu_code").alias("n_mu_expanded"))
    )
    return (
        habitat.groupBy("spp_code", "mg_code")
        .agg(F.count_distinct("mu_code").alias("n_mu_tight"))
        .join(per_group, "mg_code", "left")
        .select("spp_code", "mg_code", "n_mu_tight", "n_mu_expanded")
    )


def unit_bitmaps(habitat: DataFrame) -> DataFrame:
    """The selected units of each species and macrogroup as bitmaps.

    A bitmap is a long: the bits of 64 neighbouring unit codes, its bucket. Bitmaps of a
    bucket can be merged, so that units are counted once over any macrogroups or species.
    They are never more than the units and a row of them has a fixed size, so that they
    are added up in hash tables: a bitmap of thousands of codes takes kilobytes for a
    species that selects one of them, and all of those would be sorted.
    """
    bit = F.expr("shiftleft(1L, CAST(mu_code & 63 AS INT))")
    return habitat.groupBy(
        "spp_code", "mg_code", F.shiftright(F.col("mu_code").cast("long"), 6).alias("bucket")
    ).agg(F.coalesce(F.bit_or(bit), F.lit(0).cast("long")).alias("units"))


def count_units(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """Distinct units per ``keys``, from bitmaps merged bucket by bucket."""
    merged = bitmaps.groupBy(*keys, "bucket").agg(F.bit_or("units").alias("units"))
    return merged.groupBy(*keys).agg(F.sum(F.bit_count("units").cast("long")).alias("n_mu"))


def bitmap_tallies(bitmaps: DataFrame, legend: DataFrame) -> DataFrame:
    """:func:`mapunit_tallies` from :func:`unit_bitmaps`."""
    all_units = unit_bitmaps(macrogroup_units(legend).withColumn("spp_code", F.lit(None)))
    return (
        count_units(bitmaps, "spp_code", "mg_code").withColumnRenamed("n_mu", "n_mu_tight")
        .join(count_units(all_units, "mg_code").withColumnRenamed("n_mu", "n_mu_expanded"), "mg_code", "left")
        .select("spp_code", "mg_code", "n_mu_tight", "n_mu_expanded")
    )


def _with_measures(
    sums: DataFrame, *leading: str, area_of_expanded: str = "hab_mg_cnt"
) -> DataFrame:
    tight, expanded = F.col("hab_mu_cnt"), F.col("hab_mg_cnt")
    return sums.select(
        *leading,
        "n_mu_tight",
        "n_mu_expanded",
        "hab_mu_cnt",
        "hab_mg_cnt",
        hectares(tight).alias("tight_ha"),
        hectares(F.col(area_of_expanded)).alias("expanded_ha"),
        expanded_share_pct(tight, expanded).alias("pct_increase"),
        growth_pct(tight, expanded).alias("increase_over_tight_pct"),
    )


def species_macrogroup_summary(
    by_region: DataFrame, tallies: DataFrame, taxa: DataFrame
) -> DataFrame:
    """Regions added up per species and macrogroup, with names and tallies."""
    names = taxa.select(fold("uc").alias("uc_key"), "com_name", "sci_name")
    # A join on the names would test the codes for null below the tallies, whose habitat
    # would then be joined and shuffled a second time. Null codes have no tallies.
    known = F.col("spp_code").isNotNull() & F.col("mg_code").isNotNull()
    tallied = [F.when(known, F.col(c)).alias(c) for c in ("n_mu_tight", "n_mu_expanded")]
    tallies = tallies.withColumnsRenamed({"spp_code": "_spp", "mg_code": "_mg"})
    same_group = F.col("spp_code").eqNullSafe(F.col("_spp")) & F.col("mg_code").eqNullSafe(F.col("_mg"))
    sums = (
        by_region.groupBy("spp_code", "mg_code", "mg_name")
        .agg(F.sum("hab_mu_cnt").alias("hab_mu_cnt"), F.sum("hab_mg_cnt").alias("hab_mg_cnt"))
        .join(tallies, same_group, "left")
        .select("spp_code", "mg_code", "mg_name", "hab_mu_cnt", "hab_mg_cnt", *tallied)
        .withColumn("uc_key", fold("spp_code"))
        .join(names, "uc_key")
    )
    return _with_measures(sums, "spp_code", "com_name", "sci_name", "mg_code", "mg_name")


def species_summary(summary: DataFrame, compat: bool = False) -> DataFrame:
    """Macrogroups added up per species.

    ``compat`` repeats the tight area in the column of the expanded area.
    """
    sums = summary.groupBy("spp_code", "com_name", "sci_name").agg(
        *[F.sum(c).alias(c) for c in ("n_mu_tight", "n_mu_expanded", "hab_mu_cnt", "hab_mg_cnt")]
    )
    area = "hab_mu_cnt" if compat else "hab_mg_cnt"
    return _with_measures(sums, "spp_code", "com_name", "sci_name", area_of_expanded=area)


def species_totals_raw(by_region: DataFrame) -> DataFrame:
    """Tight and expanded cells per species."""
    return by_region.groupBy("spp_code").agg(
        F.sum("hab_mu_cnt").alias("hab_mu_cnt"), F.sum("hab_mg_cnt").alias("hab_mg_cnt")
    )


def species_macrogroup_ratio(
    habitat_species: DataFrame,
    huc_habitat: DataFrame,
    counts: DataFrame,
    legend: DataFrame,
    cover_legend: DataFrame | None = None,
    compat: bool = False,
) -> DataFrame:
    """Tight and expanded cells over the whole range, without regions.

    ``compat`` counts a unit once per macrogroup it belongs to on the tight
    side and once per legend row on the expanded side. A selected unit is opened by its
    HUCs or by those of the species' range, whichever are fewer. Units lie by species
    throughout, so that they are shuffled once before that. A unit may come several times.
    """
    keys = ["spp_code", "mg_code"]
    in_range = (
        huc_habitat.select(fold("uc").alias("uc_key"), "huc12rng").dropna(subset=["uc_key", "huc12rng"]).distinct()
    )
    known = habitat_species.dropna(subset=["spp_code", "mu_code"]).withColumn("uc_key", fold("spp_code"))
    if compat:
        keys_named = [*keys, "mg_name"]
        rows = known.select("uc_key", *keys_named, "mu_code", "mu_name").repartition("uc_key").distinct()
        unit = Window.partitionBy("uc_key", "spp_code", "mu_code")
        selected = rows.withColumn("rows", F.count(F.lit(1)).over(unit))
        units = legend.select(
            F.col("level3").alias("mu_code"), F.col("macro_cd").alias("mg_code")
        )
    else:
        keys_named = keys
        rows = known.select("uc_key", *keys, "mu_code").repartition("uc_key").distinct()
        selected = rows.withColumn("rows", F.lit(1))
        units = macrogroup_units(legend)
    tight = Triangle(
        selected, _known_classes(counts, cover_legend), ["mu_code"], in_range, ["uc_key"], ["huc12rng"]
    ).summed(keys_named, F.col("cells") * F.col("rows"), "hab_mu_cnt", {"uc_key": fold("spp_code")})
    # Null-safe equality adds no null tests to the tight side's: see expanded_counts.
    cells = macrogroup_huc_counts(counts, units).withColumnsRenamed({"huc12rng": "_huc", "mg_code": "_mg"})
    same_place = F.col("huc12rng").eqNullSafe(F.col("_huc")) & F.col("mg_code").eqNullSafe(F.col("_mg"))
    expanded = (
        _reduced(rows, ["uc_key", *keys_named])
        .join(in_range, "uc_key")
        .join(cells, same_place)
    )
    if compat:
        sides = _full_join_sides(tight, expanded, keys)
    else:
        sides = _sum_sides(tight, expanded, keys).join(macrogroup_names(legend), "mg_code", "left")
    return sides.select(
        *keys,
        "mg_name",
        "hab_mu_cnt",
        "hab_mg_cnt",
        hectares(F.col("hab_mu_cnt")).alias("tight_ha"),
        hectares(F.col("hab_mg_cnt")).alias("expanded_ha"),
        ratio_pct(F.col("hab_mu_cnt"), F.col("hab_mg_cnt")).alias("ratio_pct"),
    )


def mapunits_per_species(habitat_species: DataFrame) -> DataFrame:
    """Rows of the species habitat table."""
    return habitat_species.groupBy("spp_code").agg(F.count(F.lit(1)).alias("n_mu"))


def mapunits_in_selected_macrogroups(habitat_species: DataFrame, legend: DataFrame) -> DataFrame:
    """Distinct selected units per species and macrogroup of the legend."""
    groups = legend.select(F.col("macro_cd").alias("mg_code"))
    return (
        habitat_species.join(groups, "mg_code", "left_semi")
        .groupBy("spp_code", "mg_code")
        .agg(F.count_distinct("mu_code").alias("n_mu"))
    )


def _cells_per_species(frame: DataFrame, code: str, cells: str) -> DataFrame:
    return (
        frame.groupBy("spp_code")
        .agg(F.sum("cells").alias(cells))
        .groupBy(fold("spp_code").alias("spp_key"))
        .agg(F.min("spp_code").alias(code), F.sum(cells).alias(cells))
    )


def reconcile(expected: DataFrame, actual: DataFrame, tolerance_pct: float = 2.0) -> DataFrame:
    """Expected and actual cells per species and how far they are apart.

    Both inputs have ``spp_code`` and ``cells``. A species on one side only has
    a null difference and is marked as missing there.
    """
    e = _cells_per_species(expected, "e_code", "expected_cnt")
    a = _cells_per_species(actual, "a_code", "actual_cnt")
    diff = ratio_pct(F.col("actual_cnt") - F.col("expected_cnt"), F.col("expected_cnt"))
    return (
        e.join(a, "spp_key", "full")
        .select(
            F.coalesce("e_code", "a_code").alias("spp_code"),
            "expected_cnt",
            "actual_cnt",
            diff.alias("diff_pct"),
            F.when(F.col("actual_cnt").isNull(), "actual")
            .when(F.col("expected_cnt").isNull(), "expected")
            .alias("missing_in"),
        )
        .withColumn("within_tolerance", F.abs("diff_pct") < tolerance_pct)
    )


def missing_species(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected species without any actual record."""
    seen = actual.select(fold("spp_code").alias("spp_key"))
    return (
        expected.select("spp_code")
        .distinct()
        .withColumn("spp_key", fold("spp_code"))
        .join(seen, "spp_key", "left_anti")
        .select("spp_code")
    )
