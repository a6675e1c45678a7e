"""Small constant tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Retired map unit and the unit that replaces it.
CROSSWALK_PAIRS = (
    (3108, 3110),
    (3109, 3110),
    (3204, 3206),
    (4142, 9213),
    (4542, 5515),
    (5108, 5812),
    (8104, 8402),
    (8105, 8402),
    (8403, 8407),
    (8405, 8407),
    (8503, 8407),
    (9229, 9221),
    (9234, 9221),
    (9242, 9214),
    (9308, 9214),
    (9402, 9214),
    (9601, 9240),
    (9855, 9825),
    (9912, 4206),
)


def crosswalk_pairs(spark: SparkSession, pairs=CROSSWALK_PAIRS) -> DataFrame:
    """Pairs as a constant relation, whose size Spark knows when it plans a join."""
    rows = ", ".join(f"({old:d}L, {new:d}L)" for old, new in pairs)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS pairs(mu_2001, mu_2011)")
