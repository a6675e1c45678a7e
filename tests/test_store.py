"""Stored facts and results: plans without exchanges, upkeep by region, one species."""

from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from tables import rows
from test_study import _fixture, _tables

from biomosaic.operators import habitat as hab
from biomosaic.operators import ranges as rng
from biomosaic.operators import summary as smy
from biomosaic.plans.store import StaleStore, StudyStore, read_by_boundary, write_by_boundary
from biomosaic.plans.study import MacrogroupStudy, stored_study
from biomosaic.sources.tables import read_catalog_tables


@pytest.fixture(scope="module")
def data():
    return _fixture()


def _write(table, data, folder, *names):
    for name in names or data:
        table(name, *data[name]).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def as_at_scale(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_facts_meet_their_boundary_where_they_lie(spark, table, data, tmp_path, as_at_scale):
    frames = {name: table(name, *data[name]) for name in ("hucs", "boundaries", "boundary_species", "boundary_cover")}
    write_by_boundary(frames, str(tmp_path / "kept"), 4)
    kept = read_by_boundary(spark, str(tmp_path / "kept"), 4, "boundaries", "boundary_species", "boundary_cover")
    places = rng.boundary_hucs(frames["hucs"], kept["boundaries"])
    for fact in ("boundary_species", "boundary_cover"):
        joined = kept[fact].join(places, "boundary")
        assert "Exchange" not in _plan(joined) and "Bucketed: true" in _plan(joined)
        plain = frames[fact].join(rng.boundary_hucs(frames["hucs"], frames["boundaries"]), "boundary")
        assert "Exchange" in _plan(plain)
        if fact == "boundary_cover":
            assert rows(joined) == rows(plain)
    counts = hab.mapunit_huc_counts(frames["hucs"], kept["boundaries"], kept["boundary_cover"])
    assert rows(counts) == rows(hab.mapunit_huc_counts(frames["hucs"], frames["boundaries"], frames["boundary_cover"]))
    assert _plan(counts).count("Exchange hashpartitioning") == 1  # of the sums, none of the facts
    study = MacrogroupStudy(_tables(table, data | {}))
    over_kept = MacrogroupStudy(type(study.tables)(**{**{f: getattr(study.tables, f) for f in study.tables.table_names()}, **kept}))
    assert rows(over_kept.by_region) == rows(study.by_region)


@pytest.fixture
def store(spark, table, data, tmp_path):
    _write(table, data, tmp_path / "inputs")
    return StudyStore(spark, str(tmp_path / "inputs"), str(tmp_path / "store"), buckets=4)


def _files(folder):
    return {p.relative_to(folder): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_store_gives_the_direct_results(store, table, data):
    with pytest.raises(StaleStore):
        store.open()
    assert store.refresh() == [1, 2]
    kept, direct = store.open(), MacrogroupStudy(_tables(table, data))
    for name in ("by_region", "tallies", "summary", "species_summary", "totals"):
        columns = getattr(direct, name).columns
        assert rows(getattr(kept, name), *columns) == rows(getattr(direct, name), *columns), name
        assert "boundary_cover" not in getattr(kept, name)._jdf.queryExecution().optimizedPlan().toString()


def test_only_the_changed_region_is_rewritten(spark, store, table, data, tmp_path):
    store.refresh()
    before = _files(tmp_path / "store" / "by_region")
    assert store.refresh() == []
    # h3 and h4 lie in region 2 only; unit 103 is selected there.
    huc_of = dict(data["hucs"])
    inside = [b for b, o in data["boundaries"] if huc_of[o] == "h3"]
    data = data | {"boundary_cover": [*data["boundary_cover"], *[(b, 103, 1000) for b in inside]]}
    _write(table, data, tmp_path / "inputs", "boundary_cover")
    later = StudyStore(spark, store.inputs, store.path, buckets=4)
    with pytest.raises(StaleStore, match="refresh"):
        later.open()
    assert later.refresh() == [2]
    after = _files(tmp_path / "store" / "by_region")
    same = {p for p in before if after.get(p) == before[p]}
    assert same == {p for p in before if "region_code=1" in str(p)} and same
    direct = MacrogroupStudy(_tables(table, data))
    assert rows(later.open().by_region, *direct.by_region.columns) == rows(direct.by_region)


def test_a_legend_changes_all_regions_and_an_empty_region_is_emptied(spark, store, table, data, tmp_path):
    store.refresh()
    _write(table, data | {"cover_legend": data["cover_legend"][:-2]}, tmp_path / "inputs", "cover_legend")
    later = StudyStore(spark, store.inputs, store.path, buckets=4)
    assert later.refresh() == [1, 2]
    less = data | {"cover_legend": data["cover_legend"][:-2], "huc_region": [r for r in data["huc_region"] if r[1] == 1]}
    _write(table, less, tmp_path / "inputs", "huc_region")
    last = StudyStore(spark, store.inputs, store.path, buckets=4)
    assert last.refresh() == [2]
    direct = MacrogroupStudy(_tables(table, less))
    found = rows(last.open().by_region, *direct.by_region.columns)
    assert found == rows(direct.by_region) and {r[1] for r in found} == {1}


def test_a_lost_refresh_is_done_again(spark, store, table, data, tmp_path, monkeypatch):
    """Sums of inputs that are gone again must not be taken for the current ones."""
    store.refresh()
    expected = rows(store.open().by_region)
    changed = [(b, mu, n + 1) for b, mu, n in data["boundary_cover"]]
    _write(table, data | {"boundary_cover": changed}, tmp_path / "inputs", "boundary_cover")
    lost = StudyStore(spark, store.inputs, store.path, buckets=4)
    monkeypatch.setattr(smy, "unit_bitmaps", lambda frame: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        lost.refresh()
    monkeypatch.undo()
    _write(table, data, tmp_path / "inputs", "boundary_cover")
    later = StudyStore(spark, store.inputs, store.path, buckets=4)
    with pytest.raises(StaleStore):
        later.open()
    assert later.refresh() == [1, 2] and rows(later.open().by_region) == expected


def test_files_touched_without_a_change_rewrite_nothing(spark, store, table, data, tmp_path):
    store.refresh()
    _write(table, data, tmp_path / "inputs", "ranges")
    later = StudyStore(spark, store.inputs, store.path, buckets=4)
    with pytest.raises(StaleStore):
        later.open()
    assert later.refresh() == []
    assert later.open().by_region.count()


def test_one_species(spark, store, table, data):
    study = MacrogroupStudy(_tables(table, data))
    one = study.of_species("BaaaAx ")
    for name in ("season_hucs", "species_summary", "ratio", "tallies"):
        whole = getattr(study, name)
        own = whole.filter(hab.fold("uc" if "uc" in whole.columns else "spp_code") == "baaaax")
        assert rows(getattr(one, name), *whole.columns) == rows(own) != [], name
    assert study.of_species("none").totals.collect() == []
    store.refresh()
    kept = store.open().of_species("baaaAX")
    assert rows(kept.species_summary) == rows(one.species_summary)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else not shown
    try:
        for frame in (kept.by_region, kept.tables.unit_bitmaps):
            assert "SelectedBucketsCount: 1 out of 4" in _plan(frame)
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert kept.by_region.select(F.input_file_name()).distinct().count() <= 2  # one bucket of each region


def test_bitmaps_count_units_once(spark, table, data):
    study = MacrogroupStudy(_tables(table, data))
    legend = study.tables.vegetation_legend
    bitmaps = smy.unit_bitmaps(study.habitat_keys)
    assert rows(smy.bitmap_tallies(bitmaps, legend)) == rows(study.tallies)
    # Unit 104 lies in two macrogroups and counts once for a species.
    per_species = rows(smy.count_units(bitmaps, "spp_code"))
    assert per_species == rows(study.habitat_keys.groupBy("spp_code").agg(F.count_distinct("mu_code")))
    assert sum(n for _, n in per_species) < sum(r.n_mu_tight for r in study.tallies.collect())
    wide = spark.createDataFrame([("s", "g", u) for u in (-70000, -1, 0, 1, 32768, 32769, 10**12, 10**12)], "spp_code string, mg_code string, mu_code long")
    assert rows(smy.count_units(smy.unit_bitmaps(wide), "spp_code")) == [("s", 7)]


def test_bitmaps_take_no_more_than_a_long_a_unit(spark):
    """Units far apart: a species that selects one of thousands keeps one row of fixed size."""
    apart = spark.range(50).select(F.concat(F.lit("s"), F.col("id") % 5).alias("spp_code"), F.lit("g").alias("mg_code"), (F.col("id") * 40000).alias("mu_code"))
    bitmaps = smy.unit_bitmaps(apart.unionAll(apart).unionAll(apart.withColumn("mu_code", F.col("mu_code") + 1)))
    assert bitmaps.schema["units"].dataType.simpleString() == "bigint"
    assert bitmaps.count() == 50
    counted = smy.count_units(bitmaps, "spp_code")
    assert "SortAggregate" not in _plan(counted)
    assert rows(counted) == [(f"s{i}", 20) for i in range(5)]
    nothing = smy.unit_bitmaps(apart.limit(1).withColumn("mu_code", F.lit(None).cast("long")))
    assert rows(smy.count_units(nothing, "spp_code")) == [("s0", 0)]


def test_a_store_of_an_earlier_layout_is_stale(spark, store):
    store.refresh()
    store._remember({(r[0].replace("files, units in longs, of ", "files of "), *r[1:]) for r in store._known()})
    with pytest.raises(StaleStore):
        store.open()
    assert store.refresh() == [1, 2] and store.open().tallies.count()


def test_tables_of_two_databases(spark, table, data):
    try:
        for base, name in (("land", "boundary_cover"), ("animals", "ranges")):
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {base}")
            table(name, *data[name]).withColumn("more", F.lit(1)).write.mode("overwrite").saveAsTable(f"{base}.{name}")
        found = read_catalog_tables(spark, {"boundary_cover": "land.boundary_cover", "ranges": "spark_catalog.animals.ranges"})
        assert {k: Counter(map(tuple, f.collect())) for k, f in found.items()} == {k: Counter(data[k]) for k in found}
    finally:
        for base in ("land", "animals"):
            spark.sql(f"DROP DATABASE IF EXISTS {base} CASCADE")


def _rare(table, data):
    """Forty species, two of which pass the screening."""
    flags = data["ancillary"][0]
    code = lambda i: f"x{i:04d}x"
    models = [(f"{code(i)}-Y1", code(i), 1, "Y", 1) for i in range(40)]
    more = {
        "taxa": [(code(i), "s", "c", 1) for i in range(40)],
        "submodels": models,
        "ancillary": [(m[0], int(i >= 2), *flags[2:]) for i, m in enumerate(models)],
        "presence": [(m[0], mu, 1) for m in models for mu in (101, 103)],
        "ranges": [(code(i), f"h{h}", 1, 1) for i in range(40) for h in range(3)],
        "boundary_species": [(b, code(i), 1) for b, _ in data["boundaries"] for i in range(40)],
    }
    return data | more


def _above(plan, leaf):
    """For each scan of a column list: the operators from it up to its first shuffle."""
    nodes = [(len(line) - len(line.lstrip(" :+-")), line) for line in plan.splitlines()]
    for i, (depth, line) in enumerate(nodes):
        if "Scan" in line and leaf in line:
            path, level = [], depth
            for d, text in reversed(nodes[:i]):
                if d < level:
                    level = d
                    path.append(text)
                    if "Exchange hashpartitioning" in text:
                        break
            yield " | ".join(path)


def test_records_of_other_species_stay_out_of_the_shuffles(spark, table, data, tmp_path):
    data = _rare(table, data)
    _write(table, data, tmp_path / "inputs")
    study = StudyStore(spark, str(tmp_path / "inputs"), str(tmp_path / "store")).study
    direct = rows(study.by_region)
    kept = stored_study(study, str(tmp_path / "kept"))
    fresh = MacrogroupStudy(replace(kept.tables, by_region=None, counts=None))
    assert rows(fresh.species) == [("x0000x",), ("x0001x",)]
    assert rows(fresh.by_region) == direct != []
    plan = _plan(fresh.summary)
    for leaf in ("range_pres", "species_cd"):
        paths = list(_above(plan, leaf))
        assert paths and all("LeftSemi" in path for path in paths), (leaf, paths)
