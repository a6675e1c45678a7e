"""What the planner takes the dimensions for, by which it decides what goes through the driver."""

import pytest
from pyspark.sql import functions as F

from biomosaic.bindings import StarSchema
from biomosaic.session import HOT_KEY_SETTINGS, split_hot_keys

SUPPLIERS = 5000


@pytest.fixture
def star(spark, tmp_path):
    before = {name: spark.conf.get(name) for name in HOT_KEY_SETTINGS}
    split_hot_keys(spark)
    suppliers = spark.range(0, SUPPLIERS, 1, 1).select(
        F.col("id").alias("s_suppkey"),
        F.concat(F.lit("Supplier#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("s_name"),
        (F.col("id") % 9000 - 600).cast("double").alias("s_acctbal"),
    )
    suppliers.write.parquet(f"{tmp_path}/supplier.parquet")
    yield StarSchema(spark, tmp_path)
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("table", ["taxa", "submodels", "ancillary"])
def test_sides_of_joins_are_not_taken_for_small(star, table):
    frame = getattr(star, table)()
    # A row of n columns takes eight bytes for each, and eight more.
    held = frame.count() * 8 * (1 + len(frame.columns))
    assert frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= held


def test_submodels_of_a_supplier(star):
    found = star.submodels().filter(F.col("uc").endswith("0007")).collect()
    assert sorted((r.season_code, r.region_code) for r in found) == sorted((s, g) for s in "SWYM" for g in range(7))
    assert {r.species_model_code for r in found} == {f"{r.uc}-{r.season_code}{r.region_code}" for r in found}
    assert star.submodels().count() == 28 * SUPPLIERS
