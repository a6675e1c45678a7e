from tables import rows

from biomosaic.operators import ranges as rng


def _tables(table):
    return (
        table("hucs", (1, "h1"), (2, "h2"), (3, "h2"), (4, "h3")),
        table("boundaries", (10, 1), (20, 2), (30, 3), (40, 4), (50, 99)),
        table("boundary_species", (10, "baaaax", 5), (20, "baaaax", 7), (30, "baaaax", 1), (50, "baaaax", 9)),
    )


RANGES = [
    ("bAAAAx", "h1", 1, 1), ("bAAAAx", "h1", 2, 4), ("bAAAAx", "h2", 1, 3),
    ("bAAAAx", "h2", 3, 3), ("bAAAAx", "h1", 4, 3),  # presence code too high
    ("bAAAAx", "h2", 1, 2),  # season not used
    ("bAAAAx", "h3", 1, 1),  # no boundary record of the species there
    ("bBBBBx", "h1", 1, 1),  # species without any record
]


def test_season_hucs(spark, table):
    result = rng.species_season_huc(table("ranges", *RANGES), *_tables(table))
    assert rows(result) == [("bAAAAx", "S", "h1"), ("bAAAAx", "W", "h2"), ("bAAAAx", "Y", "h1")]
    none = spark.createDataFrame([("bBBBBx",)], "uc string")
    assert rng.species_season_huc(table("ranges", *RANGES), *_tables(table), none).count() == 0


def test_huc_habitat_counts_range_records_only_in_compat(table):
    ranges = table("ranges", *RANGES)
    assert rows(rng.species_huc_habitat(ranges, *_tables(table))) == [("bAAAAx", "h1", 5), ("bAAAAx", "h2", 8)]
    doubled = rng.species_huc_habitat(ranges, *_tables(table), compat=True)
    assert rows(doubled) == [("bAAAAx", "h1", 10), ("bAAAAx", "h2", 16)]


def test_submodel_range(spark, table):
    seasons = spark.createDataFrame(
        [("baaaax", "Y", "h1"), ("bAAAAx", "S", "h1"), ("bAAAAx", "W", "h2"), ("bAAAAx", "S", "h3")],
        "uc string, season string, huc12rng string",
    )
    regions = table("huc_region", ("h1", 1), ("h2", 1), ("h3", 1), ("h3", 2))
    models = table("submodels", *[(f"bAAAAx-{s}{r}", "bAAAAx", 1, s, r) for s, r in [("S", 1), ("w", 1), ("Y", 1), ("S", 2)]])
    result = rng.submodel_range(models, seasons, regions)
    assert rows(result, "season_code", "region_code", "huc12rng") == [
        ("S", 1, "h1"), ("S", 1, "h3"), ("S", 2, "h3"), ("Y", 1, "h1"), ("w", 1, "h1"), ("w", 1, "h2"),
    ]
    repeated = rng.submodel_range(models, seasons, regions, compat=True)
    assert repeated.count() == result.count() + 1
