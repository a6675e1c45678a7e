"""Joins opened from the cheaper side: results, and rows before the last join."""

import random

import pytest
from pyspark.sql import functions as F
from tables import rows

from biomosaic.operators import boundary as bnd
from biomosaic.operators import habitat as hab
from biomosaic.operators import summary as smy
from biomosaic.operators import triangle


@pytest.fixture
def as_at_scale(spark):
    """Shuffle joins throughout and no merging of small partitions."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("salted", [False, True])
def test_equals_the_plain_joins(spark, monkeypatch, salted):
    monkeypatch.setattr(triangle, "HOT_ROWS", 5)
    pick = random.Random(1)
    some = lambda n: pick.choice([None, 0, 0, 0, *range(n)])
    base = spark.createDataFrame([(some(8), some(6), i) for i in range(120)], "s int, u int, x int")
    first = spark.createDataFrame([(some(6), some(9), i) for i in range(60)], "u int, h int, y int")
    second = spark.createDataFrame([(some(8), some(9), i) for i in range(60)], "s int, h int, z int")
    joined = triangle.Triangle(base, first, ["u"], second, ["s"], ["h"], salted).joined()
    columns = ["s", "u", "h", "x", "y", "z"]
    assert sorted(joined.columns) == sorted(columns)
    assert rows(joined, *columns) == rows(base.join(first, "u").join(second, ["s", "h"]), *columns)
    opened = triangle.Triangle(base, first, ["u"], second, ["s"], ["h"], salted).opened()
    assert {r._opened for r in opened.select("_opened").collect()} == {1, 2}


def test_sums_equal_those_of_the_plain_joins(spark):
    pick = random.Random(2)
    some = lambda n: pick.choice([None, 0, 0, 0, *range(n)])
    name = lambda n: None if n is None else f"S{n}"
    base = spark.createDataFrame(
        [(k, name(k), some(6), some(3)) for k in (some(8) for _ in range(150))], "s int, spp string, u int, g int"
    )
    first = spark.createDataFrame([(some(6), some(9), pick.choice([None, 1, i])) for i in range(60)], "u int, h int, y int")
    second = spark.createDataFrame([(some(8), some(9)) for _ in range(60)], "s int, h int")
    own = {"s": F.substring("spp", 2, 9).cast("int")}
    summed = triangle.Triangle(base, first, ["u"], second, ["s"], ["h"]).summed(["spp", "g"], F.col("y") * 2, "n", own)
    plain = base.join(first, "u").join(second, ["s", "h"]).groupBy("spp", "g").agg(F.sum(F.col("y") * 2).alias("n"))
    assert rows(summed, "spp", "g", "n") == rows(plain, "spp", "g", "n") != []


def test_empty_sides(spark):
    base = spark.createDataFrame([(1, 2)], "s int, u int")
    first, second = spark.createDataFrame([(2, 3)], "u int, h int"), spark.createDataFrame([(1, 3)], "s int, h int")
    for b, f, s in ((base.limit(0), first, second), (base, first.limit(0), second), (base, first, second.limit(0))):
        assert triangle.Triangle(b, f, ["u"], s, ["s"], ["h"], True).joined().collect() == []


SPECIES, HUCS = 60, 200


@pytest.fixture(scope="module")
def narrow(table):
    """Unit 0 lies in every HUC and is selected by all species; all but the last live in
    one HUC. The last lives everywhere and selects units that lie in one HUC each."""
    code = lambda i: f"b{i:04d}x"
    wide = code(SPECIES)
    models = [(f"{code(i)}-Y1", code(i), 1, "Y", 1) for i in range(SPECIES + 1)]
    chosen = [(i, 0) for i in range(SPECIES)] + [(SPECIES, u) for u in range(1, 80)]
    habitat = [(code(i), f"{code(i)}-Y1", u, f"g{u % 7}") for i, u in chosen]
    counts = [(f"h{h}", 0, h + 1) for h in range(HUCS)] + [(f"h{u}", u, 5) for u in range(1, 80)]
    return {
        "submodels": table("submodels", *models),
        "season_hucs": [(code(i), "Y", f"h{i * 3 % HUCS}") for i in range(SPECIES)] + [(wide, "Y", f"h{h}") for h in range(HUCS)],
        "huc_region": table("huc_region", *[(f"h{h}", 1) for h in range(HUCS)]),
        "habitat": habitat,
        "counts": counts,
    }


def _narrow(spark, narrow):
    return (
        spark.createDataFrame(narrow["habitat"], "spp_code string, species_model_code string, mu_code long, mg_code string"),
        spark.createDataFrame(narrow["season_hucs"], "uc string, season string, huc12rng string"),
        spark.createDataFrame(narrow["counts"], "huc12rng string, mu_code long, cells long"),
    )


def test_tight_counts_of_narrow_ranges(spark, narrow, as_at_scale):
    habitat, ranges, counts = _narrow(spark, narrow)
    place = {}
    for uc, _, huc in narrow["season_hucs"]:
        place.setdefault(uc, set()).add(huc)
    expected = sorted(
        (spp, u, huc, n) for spp, _, u, _ in narrow["habitat"] for huc, v, n in narrow["counts"] if u == v and huc in place[spp]
    )
    found = hab.tight_counts(habitat, narrow["submodels"], ranges, narrow["huc_region"], counts)
    assert sorted(tuple(r) for r in found.select("spp_code", "mu_code", "huc12rng", "hab_mu_cnt").collect()) == expected
    sides = hab._tight_cells(
        hab.region_habitat(habitat, narrow["submodels"]).withColumn("uc_key", hab.fold("spp_code")), counts,
        narrow["huc_region"], hab.region_range_bits(ranges, narrow["huc_region"]),
    )
    assert sides.opened().count() <= 2 * len(expected)
    # Always by unit, or always by range, it would be very many more.
    joined = sides.base.join(sides.first, sides.first_on).count()
    assert min(joined, sides.base.join(sides.second, sides.second_on).count()) > 50 * len(expected)


def test_ratio_of_narrow_ranges(spark, narrow, as_at_scale):
    habitat, ranges, counts = _narrow(spark, narrow)
    legend = spark.createDataFrame([(u, u, "e", f"g{u % 7}", f"g{u % 7}") for u in range(80)], "value long, level3 long, ecosys_lu string, nvc_macro string, macro_cd string")
    found = smy.species_macrogroup_ratio(habitat, ranges, counts, legend).collect()
    tight = {}
    place = {}
    for uc, _, huc in narrow["season_hucs"]:
        place.setdefault(uc, set()).add(huc)
    for spp, _, u, mg in narrow["habitat"]:
        tight[spp, mg] = tight.get((spp, mg), 0) + sum(n for huc, v, n in narrow["counts"] if v == u and huc in place[spp])
    assert {(r.spp_code, r.mg_code): r.hab_mu_cnt for r in found if r.hab_mu_cnt} == {k: v for k, v in tight.items() if v}


@pytest.fixture(scope="module")
def crowded(table):
    """Unit 0 is in every boundary and selected by 50 species, unit 1 in every boundary and
    selected by one; boundary 0 has records of all species and all units."""
    code = lambda i: f"b{i:04d}x"
    units = range(20)
    presence = [(f"{code(i)}-Y1", 0, 1) for i in range(50)] + [(f"{code(50)}-Y1", 1, 1)] + [(f"{code(i)}-Y1", u, 1) for i in range(40, 50) for u in units if u > 1]
    records = [(0, code(i), i + 1) for i in range(51)] + [(b, code(b % 51), 1) for b in range(1, 400)]
    classes = [(0, u, 1) for u in units] + [(b, u, 2) for b in range(1, 400) for u in (0, 1)]
    legend = [(u, u, f"e{u}", f"g{u % 3}", f"g{u % 3}") for u in units]
    return {
        "presence": presence, "taxa": [(code(i), f"s{i}", f"c{i}", 1) for i in range(51)],
        "map_units": [(u, f"unit {u}", 0) for u in units], "boundary_species": records,
        "boundary_vegetation": classes, "vegetation_legend": legend, "taxa_names": [(code(i), "s", "c") for i in range(51)],
    }


def _crowded_result(data):
    chosen = {}
    for smc, u, _ in data["presence"]:
        chosen.setdefault(smc[:6], set()).add(u)
    taxa = {t[0]: t for t in data["taxa"]}
    group = {v: (eco, macro) for v, _, eco, macro, _ in data["vegetation_legend"]}
    units = {}
    for b, u, _ in data["boundary_vegetation"]:
        units.setdefault(b, []).append(u)
    return sorted(
        (spp, *taxa[spp][1:3], *group[u], b, n)
        for b, spp, n in data["boundary_species"] for u in units.get(b, []) if u in chosen[spp]
    )


@pytest.mark.parametrize("salted", [False, True])
def test_crowded_units_and_boundaries(spark, table, crowded, as_at_scale, monkeypatch, salted):
    monkeypatch.setattr(triangle, "HOT_ROWS", 20)
    made = []
    plain = triangle.Triangle.joined
    monkeypatch.setattr(triangle.Triangle, "joined", lambda self: made.append(self) or plain(self))
    found = bnd.species_boundary_counts(*[table(name, *data) for name, data in crowded.items()], salted=salted)
    assert rows(found) == sorted(_crowded_result(crowded), key=lambda r: tuple((x is None, str(x)) for x in r))
    (sides,) = made
    opened = sides.opened()
    assert opened.count() <= 3 * found.count()
    assert sides.base.join(sides.first, sides.first_on).count() > 10 * found.count()
    # Unit 1 has 400 class records for one selection: without salts all are in one task.
    by_unit = opened.filter("mu_code = 1 AND _opened = 1")
    share = [r["count"] for r in by_unit.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(share) > 300 and (max(share) < 0.35 * sum(share)) == salted


def test_class_records_bring_no_names(spark, table, crowded, as_at_scale, monkeypatch):
    """Class values differ from units, have several legend rows or several units, and
    boundaries repeat a class; records pass the shuffles as a boundary and a value."""
    legend = [(100 + u, u, f"e{u}", f"g{u % 3}", f"g{u % 3}") for u in range(20)]
    legend += [(100, 0, "e0 b", "g0", "g0"), (101, 2, "e2", "g2", "g2"), (103, 3, "e3", "g0", "g0"), (None, 4, "e4", "g1", "g1"), (104, None, "e", "g", "g")]
    records = [(b, 100 + u, n) for b, u, n in crowded["boundary_vegetation"]] + [(0, 103, 1), (None, 100, 1), (1, None, 1), (2, 999, 1)]
    made = []
    plain = triangle.Triangle.joined
    monkeypatch.setattr(triangle.Triangle, "joined", lambda self: made.append(self) or plain(self))
    data = crowded | {"boundary_vegetation": records, "vegetation_legend": legend}
    found = bnd.species_boundary_counts(*[table(name, *rs) for name, rs in data.items()])
    chosen = {(smc[:6], u) for smc, u, _ in data["presence"]}
    taxa = {t[0]: t for t in data["taxa"]}
    expected = [
        (spp, *taxa[spp][1:3], eco, macro, b, n)
        for b, value, _ in records for v, u, eco, macro, _ in legend if v == value is not None
        for b2, spp, n in data["boundary_species"] if b2 == b and (spp, u) in chosen
    ]
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)
    (sides,) = made
    assert set(sides.base.columns) == {"boundary", "mu_code"}
