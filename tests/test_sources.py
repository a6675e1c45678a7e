from decimal import Decimal

import pytest
from tables import rows
from pyspark.sql import functions as F

from biomosaic.functions.numbers import fixed, parse_fixed
from biomosaic.operators import report as rep
from biomosaic.operators import summary as smy
from biomosaic.sources import reports, tables


def test_conform_turns_flags_into_digits_and_names_absent_columns(spark):
    frame = spark.createDataFrame([(7, True, "c")], "mu_code int, pres boolean, species_model_code string")
    result = tables.conform("presence", frame)
    assert result.columns == ["species_model_code", "mu_code", "pres"]
    assert rows(result) == [("c", 7, 1)]
    with pytest.raises(ValueError, match="pres"):
        tables.conform("presence", frame.drop("pres"))


def test_csv_legend(spark, tmp_path):
    path = tmp_path / "legend.csv"
    path.write_text("value\n1\n20\n")
    assert rows(tables.read_csv_table(spark, "cover_legend", str(path))) == [(1,), (20,)]


def test_parquet_table(spark, table, tmp_path):
    frame = table("hucs", (1, "h1"))
    frame.write.parquet(str(tmp_path / "hucs"))
    assert rows(tables.read_table(spark, "hucs", str(tmp_path / "hucs"))) == [(1, "h1")]


def test_season_ranges_are_kept_per_season(spark, tmp_path):
    frame = spark.createDataFrame([("a", "S", "h1"), ("a", "Y", "h2")], "uc string, season string, huc12rng string")
    path = str(tmp_path / "ranges")
    tables.write_season_ranges(frame, path)
    assert {p.name for p in (tmp_path / "ranges").glob("season=*")} == {"season=S", "season=Y"}
    again = tables.read_season_ranges(spark, path)
    assert rows(again, "uc", "season", "huc12rng") == rows(frame)
    assert rows(again.filter("season = 'Y'"), "huc12rng") == [("h2",)]


@pytest.mark.parametrize(
    "value, digits, text",
    [
        (Decimal("0.45"), 1, "0.5"), (Decimal("0.25"), 1, "0.3"), (Decimal("1652848.88"), 1, "1,652,848.9"),
        (43.5, 0, "44"), (42.5, 0, "43"), (-0.3, 0, "0"), (Decimal("51717888.00"), 1, "51,717,888.0"),
    ],
)
def test_fixed_rounds_half_away_from_zero(spark, value, digits, text):
    kind = "decimal(23,2)" if isinstance(value, Decimal) else "double"
    frame = spark.createDataFrame([(value,)], f"v {kind}")
    assert frame.select(fixed(F.col("v"), digits)).first()[0] == text


def _sums(spark):
    return spark.createDataFrame(
        [
            ("rBBBBx", "Snake \"Big\" (x)", "B b", "M2", "Two", 2, 5, 18364988, 32795000),
            ("aAAAAx", "Hurter's Toad", "A a", "M1", "One", 1, 3, 5, 0),
            ("aAAAAx", "Hurter's Toad", "A a", "M3", "Three", 1, 1, 100, 200),
        ],
        "spp_code string, com_name string, sci_name string, mg_code string, mg_name string, "
        "n_mu_tight long, n_mu_expanded long, hab_mu_cnt long, hab_mg_cnt long",
    )


def test_report_round_trip(spark, tmp_path):
    summary = smy.species_summary(_sums(spark))
    report = rep.format_report(summary)
    assert report.columns[3:] == ["N MU Tight", "N MU Expanded", "HabMG_Ha (Tight)", "HabMG_Ha (Expanded)", "MacroGroup % Increase"]
    assert rows(report, "Sppcode", "`HabMG_Ha (Tight)`", "`MacroGroup % Increase`") == [
        ("aAAAAx", "9.5", "48"), ("rBBBBx", "1,652,848.9", "44"),
    ]
    path = str(tmp_path / "report")
    reports.write_report(report, path)
    again = reports.read_report(spark, path)
    assert rows(again, "spp_code", "com_name", "tight_ha", "pct_increase") == [
        ("aAAAAx", "Hurter's Toad", Decimal("9.5"), 48.0),
        ("rBBBBx", "Snake \"Big\" (x)", Decimal("1652848.9"), 44.0),
    ]
    assert rows(rep.format_report(again)) == rows(report)


def test_report_with_macrogroups_and_division_by_zero(spark, tmp_path):
    measured = smy._with_measures(_sums(spark), "spp_code", "com_name", "sci_name", "mg_code", "mg_name")
    report = rep.format_report(measured)
    assert rows(report, "MGCode", "`MacroGroup % Increase`")[0] == ("M1", None)
    reports.write_report(report, str(tmp_path / "report"))
    again = reports.read_report(spark, str(tmp_path / "report"), with_macrogroups=True)
    assert rows(again, "mg_code", "pct_increase") == [("M1", None), ("M2", 44.0), ("M3", 50.0)]


def test_parse_fixed(spark):
    frame = spark.createDataFrame([("449,834,658.2",)], "t string")
    assert frame.select(parse_fixed(F.col("t"), "decimal(20,1)")).first()[0] == Decimal("449834658.2")


def test_study_from_a_directory_of_tables(spark, table, tmp_path):
    from biomosaic.plans.study import MacrogroupStudy, StudyTables

    names = StudyTables.table_names()
    for name in names:
        table(name).write.parquet(str(tmp_path / name))
    study = MacrogroupStudy(StudyTables(**tables.read_tables(spark, str(tmp_path), *names)))
    assert study.species_summary.count() == 0
