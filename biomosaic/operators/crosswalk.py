"""Species presence under a retired map unit and under its replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import fold

# Presence pairs (retired unit, replacing unit) that become columns.
PRESENCE_PAIRS = ("0-0", "0-1", "1-0", "1-1")

_PAIR = ["mu_2001", "mu_2011"]
_STATES = {"absent": 0, "present": 1, "unknown": None}


def _in_state(state: str):
    value = _STATES[state]
    return F.col("pres").isNull() if value is None else F.col("pres") == value


def _labels(pairs: DataFrame, map_units: DataFrame) -> DataFrame:
    old = map_units.select(F.col("mu_code").alias("mu_2001"), F.col("mu_name").alias("old_name"))
    new = map_units.select(F.col("mu_code").alias("mu_2011"), F.col("mu_name").alias("new_name"))
    return pairs.join(old, "mu_2001").join(new, "mu_2011")


def crosswalk_transitions(
    pairs: DataFrame,
    presence: DataFrame,
    submodels: DataFrame,
    taxa: DataFrame,
    map_units: DataFrame,
) -> DataFrame:
    """Number of submodels per pair of map units and pair of presence values.

    Only included submodels of included species count, and only those with a
    presence record in both units. ``pairs`` may be of any length; Spark
    broadcasts it where its size allows, as it knows that of a constant table.

    The match of old with new records of a submodel is not a self-join: one
    scan counts the records of each side per submodel, and their product is the
    number of matches.
    """
    sides = pairs.select(*_PAIR, F.explode(F.array("mu_2001", "mu_2011")).alias("mu_code")).distinct()
    included = (
        submodels.filter(F.col("include_submodel") == 1)
        .select(fold("species_model_code").alias("smc_key"), fold("uc").alias("uc_key"))
        .join(taxa.filter(F.col("include_spp") == 1).select(fold("uc").alias("uc_key")), "uc_key")
        .select("smc_key")
    )
    records = (
        presence.select(fold("species_model_code").alias("smc_key"), "mu_code", "pres")
        .join(sides, "mu_code")
        .join(included, "smc_key")
    )
    per_submodel = records.groupBy(*_PAIR, "smc_key").agg(
        *[
            F.count_if((F.col("mu_code") == F.col(unit)) & _in_state(state)).alias(f"{side}_{state}")
            for side, unit in (("old", "mu_2001"), ("new", "mu_2011"))
            for state in _STATES
        ]
    )
    combos = [(a, b) for a in _STATES for b in _STATES]
    per_pair = per_submodel.groupBy(*_PAIR).agg(
        *[
            F.sum(F.col(f"old_{a}") * F.col(f"new_{b}")).alias(f"{a}_{b}")
            for a, b in combos
        ]
    )
    counted = per_pair.select(
        *_PAIR,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(_STATES[a]).cast("string").alias("old_pres"),
                        F.lit(_STATES[b]).cast("string").alias("new_pres"),
                        F.col(f"{a}_{b}").alias("n"),
                    )
                    for a, b in combos
                ]
            )
        ),
    ).filter("n > 0")
    unit_names = [F.trim("old_name"), F.lit(" TO "), F.trim("new_name")]
    codes = {c: F.col(c).cast("string") for c in _PAIR}
    return (
        counted.join(_labels(pairs, map_units), _PAIR)
        .groupBy(*_PAIR, "old_name", "new_name", "old_pres", "new_pres")
        .agg(F.sum("n").alias("count"))
        .select(
            *[code.alias(c) for c, code in codes.items()],
            F.concat(
                codes["mu_2001"], F.lit("-"), codes["mu_2011"], F.lit("    "), *unit_names
            ).alias("xwalk"),
            F.concat("old_pres", F.lit("-"), "new_pres").alias("xw_pres"),
            "count",
        )
    )


def crosswalk_pivot(transitions: DataFrame) -> DataFrame:
    """One row per pair of map units, one column per pair of presence values."""
    return (
        transitions.groupBy("mu_2001", "mu_2011", "xwalk")
        .pivot("xw_pres", list(PRESENCE_PAIRS))
        .agg(F.max("count"))
    )
