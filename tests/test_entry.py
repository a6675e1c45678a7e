"""Registered queries against their SQL, on given and on skewed tables."""

import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from biomosaic.bindings import TABLES, StarSchema
from biomosaic.session import split_hot_keys

GIVEN = Path("/root/testdata/sf0.001")


def _agree(spark, directory, name):
    frame = entry.queries()[name](spark, str(directory))
    columns = sorted(frame.columns)
    found = Counter(tuple(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect())
    with duckdb.connect() as con:
        for t in TABLES:
            path = Path(directory) / f"{t}.parquet"
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
        result = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in result.description]
        order = [names.index(c) for c in columns]
        expected = Counter(tuple(r[i] for i in order) for r in result.fetchall())
    assert sorted(names) == columns
    assert found == expected
    assert found or name == "missing_species"


def test_every_query_of_the_library_has_sql():
    assert set(entry._QUERIES) == set(entry.oracles.names())


@pytest.mark.skipif(not GIVEN.exists(), reason="needs the generated tables")
@pytest.mark.parametrize("name", list(entry._QUERIES))
def test_given_tables(spark, name):
    _agree(spark, GIVEN, name)


def _shuffles(spark, directory, name):
    """The plan of a query with shuffle joins throughout, as lines, and its shuffles."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        frame = entry._QUERIES[name](StarSchema(spark, str(directory)))
        lines = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return lines, [re.sub(r"#\d+L?", "", x).partition("Exchange ")[2] for x in lines if re.search(r"[-:] Exchange ", x)]


@pytest.mark.parametrize("name", ["species_summary", "compat_species_mg_ratio", "compat_tight_counts", "species_boundary_counts"])
def test_shuffles(spark, skewed, name):
    """The counts are shuffled once for all uses, rows that one side opens by its key only."""
    lines, shuffles = _shuffles(spark, skewed, name)
    counted = [x for x in shuffles if x.startswith("hashpartitioning(huc12rng, cover,")]
    assert len(counted) == (name != "species_boundary_counts")
    assert not any("_opened" in x.partition("ENSURE")[0] for x in shuffles)
    if name == "compat_tight_counts":  # distinct rows of all seasons where the last join left them
        first = lambda word: next(i for i, x in enumerate(lines) if word in x)
        assert first("SortMergeJoin") < first("Exchange")
    if name == "species_summary":  # codes as written are grouped in hash tables before one is picked
        assert any(x.startswith("hashpartitioning(uc, range_seas, huc12rng,") for x in shuffles)


@pytest.mark.parametrize("name", ["compat_tight_counts", "compat_tight_expanded_by_region"])
def test_compat_counts_lie_by_species(spark, skewed, name):
    """Opened units are shuffled by species, without names; both sides share the habitat's shuffles."""
    split_hot_keys(spark)
    _, shuffles = _shuffles(spark, skewed, name)
    assert not any(x.startswith("hashpartitioning(uc_key, huc12rng, region_code,") for x in shuffles)
    assert sum(x.startswith("hashpartitioning(uc_key,") and "REPARTITION" in x for x in shuffles) == 3
    assert sum(x.startswith("hashpartitioning(smc_key,") for x in shuffles) == 6


@pytest.mark.parametrize("name", ["species_mg_ratio", "layered_species_mg_ratio", "compat_species_mg_ratio"])
def test_ratio_shares_its_shuffles(spark, skewed, name):
    """Units lie by species once for both sides; counts and base rows are shuffled by the
    unit once for degrees and joins."""
    split_hot_keys(spark)
    _, shuffles = _shuffles(spark, skewed, name)
    assert sum(x.startswith("hashpartitioning(uc_key,") and "REPARTITION" in x for x in shuffles) == 1
    by_unit = [x for x in shuffles if re.match(r"hashpartitioning\(mu_code, \d+\)", x)]
    assert len(by_unit) == 9, by_unit


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """One order, one supplier and one part hold a third of the lines each."""
    out = tmp_path_factory.mktemp("skewed")
    n = spark.range(3000, numPartitions=4)
    h = F.xxhash64("id")
    third = F.col("id") % 3
    pick = lambda hot, seed, size: F.when(third == hot, 0).otherwise(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(size)))
    code = lambda letters, seed: F.element_at(F.array(*map(F.lit, letters)), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(letters))) + 1).cast("int"))
    frames = {
        "lineitem": n.select(
            pick(0, 1, 300).alias("l_orderkey"), pick(1, 2, 60).alias("l_partkey"), pick(2, 3, 12).alias("l_suppkey"),
            (F.pmod(h, F.lit(7)) + 1).cast("int").alias("l_linenumber"), (F.pmod(h, F.lit(50)) + 1).cast("double").alias("l_quantity"),
            code("ANR", 4).alias("l_returnflag"), code("FO", 5).alias("l_linestatus")),
        "orders": spark.range(300).select(
            F.col("id").alias("o_orderkey"), F.pmod(h, F.lit(40)).alias("o_custkey"), code("FOP", 6).alias("o_orderstatus"),
            (F.pmod(h, F.lit(500000)) + 0.5).cast("double").alias("o_totalprice"), F.lit("2-HIGH").alias("o_orderpriority")),
        "customer": spark.range(40).select(
            F.col("id").alias("c_custkey"), F.lit("c").alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"),
            F.lit(1.0).alias("c_acctbal"), F.lit("m").alias("c_mktsegment")),
        "supplier": spark.range(12).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name"), (F.col("id") * 700 + 250.0).cast("double").alias("s_acctbal")),
        "part": spark.range(60).select(
            F.col("id").alias("p_partkey"), F.lit("p").alias("p_name"), F.concat(F.lit("B"), F.col("id") % 5).alias("p_brand"),
            (F.col("id") % 50 + 1).cast("int").alias("p_size")),
        "nation": spark.range(25).select(F.col("id").cast("int").alias("n_nationkey"), (F.col("id") % 5).cast("int").alias("n_regionkey")),
    }
    for name, frame in frames.items():
        frame.write.parquet(str(out / f"{name}.parquet"))
    return out


@pytest.mark.parametrize(
    "name", ["species_summary", "tight_counts", "species_macrogroup_boundary", "xwalk_transitions"]
)
def test_skewed_tables(spark, skewed, name):
    _agree(spark, skewed, name)


def test_hot_partitions_are_split(spark, skewed):
    """With thresholds scaled down to the fixture, the hot order's join is cut."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    try:
        for name, value in small.items():
            spark.conf.set(name, value)
        frame = entry.queries()["mapunit_huc_counts"](spark, str(skewed))
        frame.collect()
        assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()
        _agree(spark, skewed, "mapunit_huc_counts")
        _agree(spark, skewed, "species_boundary_counts")
    finally:
        for name in small:
            spark.conf.unset(name)


def test_large_inputs_are_hash_aggregated(spark, skewed):
    """No grouping over line items needs sorted input."""
    for name in (
        "mapunit_huc_counts", "xwalk_transitions", "species_macrogroup_boundary",
        "filter_funnel",
    ):
        frame = entry.queries()[name](spark, str(skewed))
        assert "SortAggregate" not in frame._jdf.queryExecution().executedPlan().toString(), name


@pytest.mark.parametrize(("name", "key", "shuffles"), [("species_summary", "smc_key", 6), ("species_mg_ratio", "range_seas", 1)])
def test_shared_steps_are_shuffled_once(spark, skewed, name, key, shuffles):
    """Null tests are alike in all uses of habitat and ranges; unlike ones have each use joined anew."""
    planned = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    frame = entry.queries()[name](spark, str(skewed))
    before = {n: spark.conf.get(n) for n in planned}
    for n, value in planned.items():
        spark.conf.set(n, value)
    try:
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
    made = [x for x in plan.split("\n") if "- Exchange hashpartitioning" in x and f"{key}#" in x.split("Exchange")[1].split(")")[0]]
    assert len(made) == shuffles, made


def test_results_from_stored_steps(spark, skewed, tmp_path):
    """One computation of the counts and sums gives the three result sets."""
    from biomosaic.plans.study import MacrogroupStudy, stored_study
    from biomosaic.sources.tables import read_stored

    study = MacrogroupStudy(entry.StarSchema(spark, str(skewed)).study())
    kept = stored_study(study, str(tmp_path))
    for name in ("summary", "species_summary", "totals"):
        direct, again = (Counter(tuple(r) for r in getattr(s, name).collect()) for s in (study, kept))
        assert direct == again and direct
    assert "boundary_cover" not in kept.totals._jdf.queryExecution().optimizedPlan().toString()
    for name, frame in (("counts", study.counts), ("by_region", study.by_region)):
        assert read_stored(spark, name, str(tmp_path)).schema.simpleString() == frame.schema.simpleString()


def test_every_step_of_the_funnel_drops_rows(spark):
    if not GIVEN.exists():
        pytest.skip("needs the generated tables")
    steps = entry.queries()["filter_funnel"](spark, str(GIVEN).replace("sf0.001", "sf0.01")).orderBy("step").collect()
    assert all(a.records > b.records for a, b in zip(steps, steps[1:]))
