"""The counts against a replica that loops over species, regions and seasons."""

import random
from collections import Counter, defaultdict

import pytest
from tables import rows

from biomosaic.operators import habitat as hab
from biomosaic.operators import summary as smy
from biomosaic.plans.study import MacrogroupStudy, StudyTables
from biomosaic.sources.tables import schema

SPECIES = ["bAAAAx", "bBBBBx", "mCCCCx"]
HUCS = [f"h{i}" for i in range(6)]


def _fixture():
    r = random.Random(7)
    models = [
        (f"{u}-{s}{g}", u, 1, s, g) for u in SPECIES for s in "SWY" for g in (0, 1, 2, 7)
    ] + [("bAAAAx-M1", "bAAAAx", 1, "M", 1), ("bAAAAx-S3", "bAAAAx", 0, "S", 3)]
    legend = [
        (1, 100, "e100", "Group A", "A"), (2, 101, "e101", "Group A", "A"), (3, 102, "e102", "Group A2", "A"),
        (4, 103, "e103", "Group B", "B"), (5, 103, "e103 b", "Group B", "B"), (6, 104, "e104", "Group B", "B"),
        (7, 104, "e104", "Group C", "C"), (8, 105, "e105", None, None), (9, 106, "e106", "Group D", "D"),
    ]
    units = range(100, 108)
    orders = [(b, b % 9) for b in range(40)]
    objects = [(i, HUCS[i % 5]) for i in range(9)]
    flags = [f.name for f in schema("ancillary")]
    clean = dict.fromkeys(flags) | dict.fromkeys(
        ["hand_model", "hydro_fw", "hydro_ow", "hydro_wv", "hydro_springs", "cont_patch", "non_c_patch",
         "urban_exclude", "urban_include"], 0)
    return dict(
        taxa=[("BaaaAx" if u == "bAAAAx" else u, f"sci {u}", f"com {u}", 1) for u in SPECIES],
        submodels=models,
        ancillary=[tuple((clean | {"species_model_code": m[0]}).values()) for m in models],
        presence=[(m[0], mu, int(r.random() < 0.6)) for m in models for mu in units],
        map_units=[(mu, f"unit {mu}", mu % 2) for mu in units],
        vegetation_legend=legend,
        cover_legend=[(mu,) for mu in units if mu != 101],
        ranges=[(u, h, r.randint(1, 4), r.choice([1, 2, 3, 4])) for u in SPECIES for h in HUCS for _ in range(3)],
        hucs=objects,
        huc_region=[("h0", 1), ("h1", 1), ("h2", 1), ("h2", 2), ("h3", 2), ("h4", 2), ("h5", 2)],
        boundaries=orders,
        boundary_species=[(b, u.lower(), r.randint(1, 9)) for b, _ in orders for u in SPECIES if r.random() < 0.7],
        boundary_cover=[(b, mu, r.randint(0, 9)) for b, _ in orders for mu in units if r.random() < 0.25],
    )


@pytest.fixture(scope="module")
def data():
    return _fixture()


def _tables(table, data):
    return StudyTables(**{name: table(name, *rs) for name, rs in data.items()})


def _replica(data, seasons, habitat, literal):
    """Sums per species, region and macrogroup, one submodel after the other."""
    huc_of = dict(data["hucs"])
    place = {b: huc_of[o] for b, o in data["boundaries"]}
    cells = Counter()
    for b, mu, n in data["boundary_cover"]:
        cells[place[b], mu] += n
    known = {v for (v,) in data["cover_legend"]}
    legend = [(l[1], l[2], l[4]) for l in data["vegetation_legend"]]
    out = []
    for spp in SPECIES:
        own = [(s, h) for u, s, h in seasons if u.lower() == spp.lower()]
        for reg in (1, 2):
            tight, expanded = set(), set()
            for seas in "SWY":
                srh = [h for h, g in data["huc_region"] if g == reg for s, h2 in own if h2 == h and s in (seas, "Y")]
                smu = [x for x in habitat if x[0] == f"{spp}-{seas}{reg}"]
                smuh = [(x, h2) for x in smu for _, h2 in own for h in srh if h == h2]
                got = Counter()
                for x, h in smuh:
                    if x[1] in known:
                        got[x[1], h] += cells[h, x[1]]
                for x, h in smuh:
                    value = got[x[1], h] if literal else cells[h, x[1]] * (x[1] in known)
                    tight.add((x[1], x[2], x[3], x[4], h, value))
                for mg, name in {(x[3], x[4]) for x in smu}:
                    for mu, eco, code in legend:
                        if code is not None and code == mg:
                            for h in srh:
                                expanded.add((mu, eco if literal else None, mg, name, h, cells[h, mu]))
            sums = defaultdict(lambda: [0, 0])
            for side, found in enumerate((tight, expanded)):
                for row in found:
                    sums[row[2], row[3]][side] += row[5]
            out += [(spp.lower(), reg, mg, name, *v) for (mg, name), v in sums.items() if any(v)]
    return out


def _sorted(found):
    return sorted(found, key=lambda r: tuple(str(x) for x in r))


def test_default_counts_equal_the_loops(table, data):
    study = MacrogroupStudy(_tables(table, data))
    seasons = rows(study.season_hucs)
    habitat = rows(study.habitat, "species_model_code", "mu_code", "mu_name", "mg_code", "mg_name")
    assert len(set(habitat)) == len(habitat)
    expected = _replica(data, seasons, habitat, literal=False)
    found = [(r[0].lower(), *r[1:]) for r in rows(study.by_region)]
    assert _sorted(found) == _sorted(expected)
    assert all(tight <= expanded for *_, mg, _, tight, expanded in expected if mg is not None)


def test_compat_tight_counts_equal_the_literal_joins(table, data):
    study = MacrogroupStudy(_tables(table, data), compat=True)
    seasons = rows(study.season_hucs)
    habitat = rows(study.habitat, "species_model_code", "mu_code", "mu_name", "mg_code", "mg_name")
    expected = _replica(data, seasons, habitat, literal=True)
    sides = defaultdict(int)
    for spp, reg, mg, name, tight, _ in expected:
        sides[spp, reg, mg, name] += tight
    found = defaultdict(int)
    for r in study.tight.collect():
        found[r["spp_code"].lower(), r["region_code"], r["mg_code"], r["mg_name"]] += r["hab_mu_cnt"]
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in sides.items() if v}
    both = defaultdict(int)
    for spp, reg, mg, name, _, n in expected:
        both[spp, reg, mg, name] += n
    found = defaultdict(int)
    for r in study.expanded.collect():
        found[r["spp_code"].lower(), r["region_code"], r["mg_code"], r["mg_name"]] += r["hab_mg_cnt"]
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in both.items() if v}
    assert sum(sides.values()) > sum(r["hab_mu_cnt"] for r in MacrogroupStudy(_tables(table, data)).tight.collect())


def test_zero_fill_adds_only_zero_rows(table, data):
    study = MacrogroupStudy(_tables(table, data))
    t = study.tables
    filled = hab.tight_counts(
        study.habitat_keys, study.submodels, study.season_hucs, t.huc_region, study.counts, t.cover_legend, zero_fill=True
    )
    nonzero = [r for r in rows(filled) if r[-1]]
    assert nonzero == [r for r in rows(study.tight) if r[-1]]
    assert filled.count() > len(nonzero)


def test_summaries_add_up(spark, table, data):
    study = MacrogroupStudy(_tables(table, data))
    summary = study.summary.collect()
    per_species = {r["spp_code"]: r for r in study.species_summary.collect()}
    totals = {r["spp_code"]: tuple(r)[1:] for r in study.totals.collect()}
    assert set(per_species) == set(totals) and "BaaaAx" in totals
    for code, r in per_species.items():
        own = [s for s in summary if s["spp_code"] == code]
        assert r["n_mu_tight"] == sum(s["n_mu_tight"] or 0 for s in own)
        assert (r["hab_mu_cnt"], r["hab_mg_cnt"]) == totals[code]
        assert float(r["tight_ha"]) == pytest.approx(r["hab_mu_cnt"] * 0.09)
    assert all(s["n_mu_tight"] <= s["n_mu_expanded"] for s in summary if s["mg_code"])
    compat = smy.species_summary(study.summary, compat=True).collect()
    assert all(r["tight_ha"] == r["expanded_ha"] for r in compat)


def test_result_does_not_depend_on_partitions_or_stored_ranges(spark, table, data):
    study = MacrogroupStudy(_tables(table, data))
    expected = rows(study.by_region)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert rows(MacrogroupStudy(_tables(table, data)).by_region) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stored = spark.createDataFrame(study.season_hucs.collect(), "uc string, season string, huc12rng string")
    assert rows(study.with_season_ranges(stored).by_region) == expected


def test_ratio_without_regions(table, data):
    study = MacrogroupStudy(_tables(table, data))
    huc_of = dict(data["hucs"])
    cells = Counter()
    place = {b: huc_of[o] for b, o in data["boundaries"]}
    for b, mu, n in data["boundary_cover"]:
        cells[place[b], mu] += n
    known = {v for (v,) in data["cover_legend"]}
    units = {(l[1], l[4]) for l in data["vegetation_legend"]}
    chosen = defaultdict(set)
    for spp, mu, mg in rows(study.habitat_keys, "spp_code", "mu_code", "mg_code"):
        chosen[spp, mg].add(mu)
    where = defaultdict(set)
    for uc, huc, _ in rows(study.huc_habitat):
        where[uc.lower()].add(huc)
    expected = {}
    for (spp, mg), mus in chosen.items():
        hucs = where[spp.lower()]
        tight = sum(cells[h, mu] for h in hucs for mu in mus if mu in known)
        wide = sum(cells[h, mu] for h in hucs for mu, g in units if g is not None and g == mg)
        if tight or wide:
            expected[spp, mg] = (tight, wide, tight / wide * 100 if wide else None)
    found = {(r["spp_code"], r["mg_code"]): (r["hab_mu_cnt"], r["hab_mg_cnt"], r["ratio_pct"]) for r in study.ratio.collect()}
    assert found == expected
    literal = MacrogroupStudy(_tables(table, data), compat=True).ratio.collect()
    assert sum(r["hab_mg_cnt"] for r in literal) > sum(v[1] for v in expected.values())


def test_tallies_of_units(spark, table, data):
    study = MacrogroupStudy(_tables(table, data))
    by_species = hab.habitat_table_species(study.habitat)
    selected = {r["spp_code"]: r["n_mu"] for r in smy.mapunits_per_species(by_species).collect()}
    assert set(selected) == {"BaaaAx", "bBBBBx", "mCCCCx"}
    in_groups = rows(smy.mapunits_in_selected_macrogroups(by_species, study.tables.vegetation_legend))
    tallies = {(r["spp_code"], r["mg_code"]): r["n_mu_tight"] for r in study.tallies.collect()}
    assert in_groups == sorted((s, g, n) for (s, g), n in tallies.items() if g is not None)


def test_reconcile(spark):
    frame = lambda *r: spark.createDataFrame(list(r), "spp_code string, cells long")
    expected = frame(("bAAAAx", 1000), ("bBBBBx", 100), ("bCCCCx", 10))
    actual = frame(("baaaax", 1010), ("bBBBBx", 90), ("bDDDDx", 1))
    result = {r["spp_code"]: r for r in smy.reconcile(expected, actual).collect()}
    assert result["bAAAAx"]["within_tolerance"] and not result["bBBBBx"]["within_tolerance"]
    assert (result["bCCCCx"]["missing_in"], result["bDDDDx"]["missing_in"]) == ("actual", "expected")
    assert rows(smy.missing_species(expected, actual)) == [("bCCCCx",)]
