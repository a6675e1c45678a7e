"""Schemas of the input tables and their readers.

Identifiers are wide integers, flags are 0/1 integers and codes are strings.
Nothing is inferred: a table is either read with its schema or conformed to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

SCHEMAS = {
    "taxa": "uc string, sci_name string, com_name string, include_spp int",
    "taxa_names": "uc string, scientific_name string, common_name string",
    "submodels": (
        "species_model_code string, uc string, include_submodel int, "
        "season_code string, region_code int"
    ),
    "ancillary": (
        "species_model_code string, hand_model int, hydro_fw int, hydro_ow int, "
        "hydro_wv int, hydro_springs int, salinity string, stream_vel string, "
        "edge_type string, use_for_int string, cont_patch int, non_c_patch int, "
        "percent_canopy int, aux_buff int, avoid string, urban_exclude int, "
        "urban_include int, elev_min int, elev_max int, slope_min int, slope_max int"
    ),
    "presence": "species_model_code string, mu_code long, pres int",
    "map_units": "mu_code long, mu_name string, forest int",
    "ranges": "uc string, huc12rng string, range_pres int, range_seas int",
    "hucs": "objectid long, huc12rng string",
    "huc_region": "huc12rng string, region_code int",
    "boundaries": "boundary long, huc_id long",
    "boundary_species": "boundary long, species_cd string, count long",
    "boundary_cover": "boundary long, cover long, count long",
    "boundary_vegetation": "boundary long, vegetation long, count long",
    "cover_legend": "value long",
    "vegetation_legend": (
        "value long, level3 long, ecosys_lu string, nvc_macro string, macro_cd string"
    ),
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def conform(table: str, frame: DataFrame) -> DataFrame:
    """Columns of ``table`` in its types; fails early when one is missing.

    Bit flags arrive as booleans from some exports and become 0/1 here, since
    presence labels are made of digits.
    """
    wanted = schema(table)
    have = {f.name: f.dataType for f in frame.schema}
    absent = [f.name for f in wanted if f.name not in have]
    if absent:
        raise ValueError(f"table {table} lacks columns: {', '.join(absent)}")
    if list(have.items()) == [(f.name, f.dataType) for f in wanted]:
        return frame

    def typed(field):
        col = F.col(field.name)
        if isinstance(have[field.name], BooleanType):
            col = col.cast("int")
        return col.cast(field.dataType).alias(field.name)

    return frame.select(*[typed(f) for f in wanted])


def read_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Parquet table conformed to its schema."""
    return conform(table, spark.read.parquet(path))


def read_tables(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    """Tables kept as ``<root>/<name>``: all of them unless named."""
    return {name: read_table(spark, name, f"{root}/{name}") for name in names or SCHEMAS}


def read_catalog_tables(spark: SparkSession, names: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of the session's catalogs, by names of up to three parts, conformed to their
    schemas; ``names`` may point into several databases."""
    return {table: conform(table, spark.table(name)) for table, name in names.items()}


def read_csv_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """CSV export with a header line, such as the land-cover class list."""
    return spark.read.schema(schema(table)).csv(
        path, header=True, enforceSchema=False, mode="FAILFAST"
    )


def write_season_ranges(season_hucs: DataFrame, path: str) -> None:
    """Keeps species ranges between runs, one directory per season."""
    season_hucs.write.mode("overwrite").partitionBy("season").parquet(path)


def read_season_ranges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("uc string, huc12rng string, season string").parquet(path)


# Intermediate results of the study that are worth keeping.
STORED = {
    "screening": "uc string, screened int",
    "counts": "huc12rng string, mu_code long, cells long",
    "by_region": (
        "spp_code string, region_code int, mg_code string, mg_name string, "
        "hab_mu_cnt long, hab_mg_cnt long"
    ),
}


def stored(spark: SparkSession, name: str, frame: DataFrame, root: str) -> DataFrame:
    """``frame`` written to ``<root>/<name>`` and read again."""
    frame.write.mode("overwrite").parquet(f"{root}/{name}")
    return read_stored(spark, name, root)


def read_stored(spark: SparkSession, name: str, root: str) -> DataFrame:
    return spark.read.schema(STORED[name]).parquet(f"{root}/{name}")
