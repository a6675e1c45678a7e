"""Tab-separated report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import fold
from ..functions.numbers import parse_fixed
from ..operators import report as r

# Names contain apostrophes and parentheses; nothing is quoted or escaped.
_FORMAT = {"sep": "\t", "header": True, "quote": "", "encoding": "UTF-8"}


def write_report(report: DataFrame, path: str) -> None:
    """Writes a formatted report in species order, as many files as Spark makes."""
    order = [c for c in (r.SPECIES_CODE, r.MACROGROUP_CODE) if c in report.columns]
    report.orderBy(*[fold(c) for c in order]).write.mode("overwrite").options(
        **_FORMAT, emptyValue="", escapeQuotes=False
    ).csv(path)


def read_report(spark: SparkSession, path: str, with_macrogroups: bool = False) -> DataFrame:
    """Numbers of a published report, thousands separators removed."""
    group = [r.MACROGROUP_CODE, r.MACROGROUP_NAME] if with_macrogroups else []
    columns = [
        r.SPECIES_CODE, r.COMMON_NAME, r.SCIENTIFIC_NAME, *group, r.UNITS_TIGHT,
        r.UNITS_EXPANDED, r.AREA_TIGHT, r.AREA_EXPANDED, r.INCREASE,
    ]
    text = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(
        path, **_FORMAT, enforceSchema=False, mode="FAILFAST"
    )
    names = {r.SPECIES_CODE: "spp_code", r.COMMON_NAME: "com_name", r.SCIENTIFIC_NAME: "sci_name"}
    if with_macrogroups:
        names |= {r.MACROGROUP_CODE: "mg_code", r.MACROGROUP_NAME: "mg_name"}
    numbers = {
        r.UNITS_TIGHT: ("n_mu_tight", "long"),
        r.UNITS_EXPANDED: ("n_mu_expanded", "long"),
        r.AREA_TIGHT: ("tight_ha", "decimal(20,1)"),
        r.AREA_EXPANDED: ("expanded_ha", "decimal(20,1)"),
        r.INCREASE: ("pct_increase", "double"),
    }
    return text.select(
        *[F.col(c).alias(n) for c, n in names.items()],
        *[parse_fixed(F.col(f"`{c}`"), t).alias(n) for c, (n, t) in numbers.items()],
    )
