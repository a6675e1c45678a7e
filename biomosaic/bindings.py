"""The model tables as views of an order-processing star schema.

The habitat databases are not public, so the registered queries run over tables
with the same relations: orders play boundaries, customers their position in
watershed units (nations), line items the cell counts, suppliers the species
and parts the map units. Every view covers its whole source tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.study import StudyTables
from .sources.constants import crosswalk_pairs
from .sources.tables import conform

# Digits of the largest long: no key is ever cut.
KEY_WIDTH = 19

# The columns in use, declared so that opening a table needs no job.
TABLES = {
    "nation": "n_nationkey int, n_regionkey int",
    "customer": (
        "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey long, s_name string, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_size int",
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_returnflag string, l_linestatus string"
    ),
}

# Retired and replacing part size, many to one.
SIZE_PAIRS = (
    (1, 26), (2, 26), (3, 27), (5, 28), (6, 28), (8, 30), (9, 30), (11, 31), (12, 33), (13, 33),
    (14, 33), (17, 36), (18, 36), (19, 38), (20, 40), (21, 40), (22, 40), (24, 44), (25, 50),
)

_SEASON_OF_FLAG = {"A": "S", "N": "W", "R": "Y"}
_RANGE_SEASON_OF_FLAG = {"A": 4, "N": 3, "R": 1}
_SEASON_OF_STATUS = {"F": "s", "O": "w", "P": "y"}


def _mapped(column: str, values: dict) -> Column:
    entries = [F.lit(x) for entry in values.items() for x in entry]
    return F.create_map(*entries)[F.col(column)]


def key(number: str | Column) -> Column:
    number = F.col(number) if isinstance(number, str) else number
    return F.lpad(number.cast("string"), KEY_WIDTH, "0")


class StarSchema:
    """Bindings over the parquet tables in one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = str(sf_dir).rstrip("/")
        self._opened: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._opened:
            path = f"{self.dir}/{name}.parquet"
            self._opened[name] = self.spark.read.schema(TABLES[name]).parquet(path)
        return self._opened[name]

    # Watershed units and boundaries

    def hucs(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("objectid"),
            F.col("c_nationkey").cast("string").alias("huc12rng"),
        )

    def huc_region(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("string").alias("huc12rng"),
            (F.col("n_regionkey") + 1).alias("region_code"),
        )

    def boundaries(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("boundary"), F.col("o_custkey").alias("huc_id")
        )

    def _lines(self, *columns: str) -> DataFrame:
        """Line items with the watershed unit of their order."""
        place = (
            self.boundaries().join(self.hucs(), F.col("huc_id") == F.col("objectid"))
            .select(F.col("boundary").alias("l_orderkey"), "huc12rng")
        )
        return self.table("lineitem").select("l_orderkey", *columns).join(place, "l_orderkey")

    # Cell counts

    def _cells(self, item: str, name: Column) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("boundary"),
            name.alias(item),
            F.col("l_quantity").cast("long").alias("count"),
        )

    def boundary_cover(self) -> DataFrame:
        return self._cells("cover", F.col("l_partkey"))

    def boundary_species(self) -> DataFrame:
        return self._cells("species_cd", key("l_suppkey"))

    @staticmethod
    def keyed(cells: DataFrame) -> DataFrame:
        """One record per boundary and item, as the boundary reports expect."""
        *keys, count = cells.columns
        return cells.groupBy(*keys).agg(F.sum(count).alias(count))

    def boundary_vegetation(self) -> DataFrame:
        return self._cells("vegetation", F.col("l_partkey"))

    # Map units and legends

    def map_units(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("mu_code"),
            F.col("p_name").alias("mu_name"),
            (F.col("p_size") <= 25).cast("int").alias("forest"),
        )

    def cover_legend(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("value"))

    def vegetation_legend(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("value"),
            F.col("p_partkey").alias("level3"),
            F.col("p_name").alias("ecosys_lu"),
            F.col("p_brand").alias("nvc_macro"),
            F.col("p_brand").alias("macro_cd"),
        )

    # Species and submodels

    def taxa(self) -> DataFrame:
        return self.table("supplier").select(
            key("s_suppkey").alias("uc"),
            F.col("s_name").alias("sci_name"),
            F.lower("s_name").alias("com_name"),
            (F.col("s_acctbal") > 0).cast("int").alias("include_spp"),
        )

    def taxa_names(self) -> DataFrame:
        return self.taxa().select(
            "uc",
            F.col("sci_name").alias("scientific_name"),
            F.col("com_name").alias("common_name"),
        )

    def _supplier_models(self, *columns: Column) -> DataFrame:
        """Submodels of each supplier: four seasons in regions 0 to 6.

        The regions are joined, as Spark takes rows exploded from an array for no more than
        the array's table, and would send 28 times the suppliers through the driver.
        """
        seasons = self.table("supplier").select(
            key("s_suppkey").alias("uc"),
            "s_acctbal",
            F.explode(F.array(*map(F.lit, "SWYM"))).alias("season_code"),
        )
        regions = self.spark.range(0, 7, 1, 1).select(F.col("id").cast("int").alias("region_code"))
        grid = seasons.crossJoin(regions)
        code = F.concat("uc", F.lit("-"), "season_code", F.col("region_code").cast("string"))
        return grid.select(code.alias("species_model_code"), *columns)

    def submodels(self) -> DataFrame:
        return self._supplier_models(
            F.col("uc"),
            (F.col("s_acctbal") >= -500).cast("int").alias("include_submodel"),
            F.col("season_code"),
            F.col("region_code"),
        )

    def ancillary(self) -> DataFrame:
        acctbal = F.col("s_acctbal")
        return _with_unset_criteria(
            self._supplier_models(
                F.when(acctbal < 200, "Fresh").when(acctbal < 5000, "All Types").alias("salinity"),
                F.when(acctbal < 0, 100).when(acctbal < 9000, 0).alias("elev_min"),
                F.when(acctbal > 9500, 500).alias("elev_max"),
                ((acctbal >= 3000) & (acctbal < 3300)).cast("int").alias("hand_model"),
            )
        )

    def presence(self) -> DataFrame:
        """A submodel's units: present if any of its lines is filled."""
        filled = (F.col("l_linestatus") == "F").cast("int")
        return (
            self._lines("l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")
            .join(self.huc_region(), "huc12rng")
            .groupBy("l_suppkey", "region_code", "l_returnflag", "l_partkey")
            .agg(F.max(filled).alias("pres"))
            .select(
                F.concat(
                    key("l_suppkey"),
                    F.lit("-"),
                    _mapped("l_returnflag", _SEASON_OF_FLAG),
                    F.col("region_code").cast("string"),
                ).alias("species_model_code"),
                F.col("l_partkey").alias("mu_code"),
                "pres",
            )
        )

    def ranges(self) -> DataFrame:
        return self._lines("l_suppkey", "l_linenumber", "l_returnflag").select(
            key("l_suppkey").alias("uc"),
            "huc12rng",
            F.col("l_linenumber").alias("range_pres"),
            _mapped("l_returnflag", _RANGE_SEASON_OF_FLAG).alias("range_seas"),
        )

    def study(self) -> StudyTables:
        frames = {
            name: conform(name, getattr(self, name)()) for name in StudyTables.table_names()
        }
        return StudyTables(**frames, uc_width=KEY_WIDTH)

    # Screening: one submodel per order, its customer the species

    def screened_taxa(self) -> DataFrame:
        return self.table("customer").select(
            key("c_custkey").alias("uc"),
            F.col("c_name").alias("sci_name"),
            F.col("c_mktsegment").alias("com_name"),
            (F.col("c_acctbal") > 0).cast("int").alias("include_spp"),
        )

    def _order_models(self, *columns: Column) -> DataFrame:
        regions = self.hucs().join(self.huc_region(), "huc12rng").select("objectid", "region_code")
        orders = self.table("orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
        ).join(regions, F.col("o_custkey") == F.col("objectid"))
        orders = orders.withColumn("season_code", _mapped("o_orderstatus", _SEASON_OF_STATUS))
        return orders.select(
            F.concat(
                key("o_custkey"),
                F.lit("-"),
                "season_code",
                F.col("region_code").cast("string"),
                F.lit("-"),
                F.col("o_orderkey").cast("string"),
            ).alias("species_model_code"),
            *columns,
        )

    def screened_submodels(self) -> DataFrame:
        return self._order_models(
            key("o_custkey").alias("uc"),
            (F.col("o_totalprice") >= 3000).cast("int").alias("include_submodel"),
            F.col("season_code"),
            F.col("region_code"),
        )

    def screened_ancillary(self) -> DataFrame:
        price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
        # Each criterion is in use for orders of its own remainder of the whole price.
        rest = F.floor(price).cast("long") % 97
        flag = lambda name, value: (rest == value).cast("int").alias(name)
        text = lambda name, value, word: F.when(rest == value, word).alias(name)
        return _with_unset_criteria(
            self._order_models(
                (price > 470000).cast("int").alias("hand_model"),
                F.when(rest == 1, None).otherwise((rest == 2).cast("int")).alias("hydro_fw"),
                flag("hydro_ow", 3),
                flag("hydro_wv", 4),
                flag("hydro_springs", 5),
                F.when(rest == 6, "Slow").when(rest < 50, "ALL types ").alias("stream_vel"),
                text("edge_type", 7, "Forest"),
                text("use_for_int", 8, "Core"),
                F.when(rest == 9, None).otherwise((rest == 10).cast("int")).alias("cont_patch"),
                flag("non_c_patch", 11),
                F.when(rest == 12, 0).when(rest == 13, 40).alias("percent_canopy"),
                F.when(rest == 14, 30).alias("aux_buff"),
                text("avoid", 15, "Roads"),
                flag("urban_include", 16),
                F.when(rest == 17, 0).alias("slope_max"),
                F.when(priority == "1-URGENT", None)
                .when((priority == "5-LOW") & (price < 20000), "Fresh")
                .otherwise("All Types")
                .alias("salinity"),
                F.when(price < 5000, 100).when(price < 200000, 0).alias("elev_min"),
                F.when((price > 300000) & (price < 303000), 500).alias("elev_max"),
                F.when((price > 100000) & (price < 103000), 2).alias("slope_min"),
                F.when(price < 460000, 0).alias("urban_exclude"),
            )
        )

    def screened_presence(self) -> DataFrame:
        filled = (F.col("l_linestatus") == "F").cast("int")
        units = (
            self.table("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max(filled).alias("pres"))
        )
        codes = self._order_models(F.col("o_orderkey"))
        return units.join(codes, F.col("l_orderkey") == F.col("o_orderkey")).select(
            "species_model_code", F.col("l_partkey").alias("mu_code"), "pres"
        )

    # Crosswalk: part sizes are the map units, one submodel per supplier

    def size_pairs(self) -> DataFrame:
        return crosswalk_pairs(self.spark, SIZE_PAIRS)

    def size_units(self) -> DataFrame:
        sizes = self.table("part").select(F.col("p_size").cast("long").alias("mu_code")).distinct()
        name = F.concat(F.lit(" size "), F.col("mu_code").cast("string"), F.lit("  "))
        return sizes.withColumn("mu_name", name)

    def size_submodels(self) -> DataFrame:
        return self.table("supplier").select(
            key("s_suppkey").alias("species_model_code"),
            key("s_suppkey").alias("uc"),
            (F.col("s_acctbal") < 9000).cast("int").alias("include_submodel"),
        )

    def size_presence(self) -> DataFrame:
        """Present where the lines of supplier and size add up to an odd quantity."""
        sizes = self.table("part").select("p_partkey", "p_size")
        return (
            self.table("lineitem")
            .select("l_suppkey", "l_partkey", F.col("l_quantity").cast("long").alias("quantity"))
            .join(sizes, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("l_suppkey", "p_size")
            .agg((F.sum("quantity") % 2).cast("int").alias("pres"))
            .select(
                key("l_suppkey").alias("species_model_code"),
                F.col("p_size").cast("long").alias("mu_code"),
                "pres",
            )
        )


class LayeredSchema(StarSchema):
    """The same tables with a legend and regions as they occur in practice.

    Units have several legend rows: a second class name and macrogroup name under the
    same code for small parts, a second macrogroup for large ones, a plain repetition for
    some. The first nations lie in two regions.
    """

    def huc_region(self) -> DataFrame:
        region = F.col("n_regionkey") + 1
        both = F.when(F.col("n_nationkey") < 5, F.array(region, region % 5 + 1)).otherwise(F.array(region))
        return self.table("nation").select(
            F.col("n_nationkey").cast("string").alias("huc12rng"), F.explode(both).alias("region_code")
        )

    def vegetation_legend(self) -> DataFrame:
        size, name, brand = F.col("p_size"), F.col("p_name"), F.col("p_brand")

        def row(ecosys: Column, macro: Column, code: Column) -> Column:
            return F.struct(ecosys.alias("ecosys_lu"), macro.alias("nvc_macro"), code.alias("macro_cd"))

        rows = F.array(
            row(name, brand, brand),
            F.when(size <= 10, row(F.concat(name, F.lit(" b")), F.concat(brand, F.lit(" b")), brand)),
            F.when(size >= 45, row(name, F.lit("Brand#00"), F.lit("Brand#00"))),
            F.when(size.between(20, 22), row(name, brand, brand)),
        )
        part = F.col("p_partkey")
        found = self.table("part").select(part.alias("value"), part.alias("level3"), F.explode(rows).alias("r"))
        return found.filter("r IS NOT NULL").select("value", "level3", "r.*")


def _with_unset_criteria(frame: DataFrame) -> DataFrame:
    """Criteria the frame does not set: flags zero, everything else null."""
    given = set(frame.columns)
    flags = (
        "hand_model", "hydro_fw", "hydro_ow", "hydro_wv", "hydro_springs", "cont_patch",
        "non_c_patch", "urban_exclude", "urban_include",
    )
    blank = {
        "string": ("salinity", "stream_vel", "edge_type", "use_for_int", "avoid"),
        "int": ("percent_canopy", "aux_buff", "elev_min", "elev_max", "slope_min", "slope_max"),
    }
    unset = {c: F.lit(0) for c in flags if c not in given}
    for as_type, names in blank.items():
        unset |= {c: F.lit(None).cast(as_type) for c in names if c not in given}
    return frame.withColumns(unset)
