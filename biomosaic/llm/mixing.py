"""Operator 6: mixing sources by temperature, in DataFrame functions only.

Source token shares are raised to an exponent and normalised. The exponent is the
largest, found by bisection, at which the weights are as even as a target entropy asks
and no source is repeated more often than a limit allows. Weights times a budget of
tokens say how many passes over each source are made; every pass takes the blocks of
the source in its own random order, the last one up to the budget.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import checked, prepare, settle

#: Binary digits of the exponent, and those found in one pass over the sources.
DIGITS, DIGITS_AT_ONCE = 25, 5
#: Tokens of a block: a pass is cut to the budget within one block.
BLOCK_TOKENS = 1_000_000

_WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mixture:
    """entropy: least share of the largest entropy; repeats: most passes over a source
    (at least 1); budget: tokens of the mixture, None for those of the input."""

    entropy: float = 0.9
    repeats: float = 4.0
    budget: int | None = None
    seed: int = 17


def n_tokens(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _fits(sources: DataFrame, low: float, step: float, mixture: Mixture, budget: float) -> list[tuple[float, bool]]:
    """For exponents above ``low``: is the entropy reached, is no source repeated too often?

    One grouped sum over sources and exponents; logarithms keep large shares exact.
    """
    tried = sources.select("tokens", "log", F.explode(F.sequence(F.lit(1), F.lit(1 << DIGITS_AT_ONCE))).alias("i"))
    exponent = F.lit(low) + F.col("i") * F.lit(step)
    raised = F.exp(exponent * F.col("log"))
    sums = tried.groupBy("i").agg(
        F.sum(raised).alias("z"), F.sum(raised * exponent * F.col("log")).alias("zl"),
        F.max(raised / F.col("tokens")).alias("most"), F.count(F.lit(1)).alias("n"),
    )
    entropy = F.log("z") - F.col("zl") / F.col("z")
    found = sums.select(
        "i",
        (entropy >= mixture.entropy * F.log(F.col("n").cast("double")) - 1e-12).alias("even"),
        (F.col("most") / F.col("z") * budget <= mixture.repeats + 1e-12).alias("within"),
    )
    return [(low + r["i"] * step, r["even"], r["within"]) for r in found.orderBy("i").collect()]


def exponent(sources: DataFrame, mixture: Mixture, budget: float) -> float:
    """The largest exponent in [0, 1] that meets the entropy; then raised, if it must
    be, to the smallest that keeps to the repetition limit.

    A smaller exponent evens weights out: the entropy falls and repetition of small
    sources falls as the exponent grows, so that both limits are found by bisection.
    The repetition limit counts more, for it can always be met at exponent 1.
    """
    low, step = 0.0, 1.0 / (1 << DIGITS_AT_ONCE)
    for _ in range(DIGITS // DIGITS_AT_ONCE):
        even = [x for x, ok, _ in _fits(sources, low, step, mixture, budget) if ok]
        low, step = max([low, *even]), step / (1 << DIGITS_AT_ONCE)
    target = low
    high, low, step = 1.0, -1.0 / (1 << DIGITS_AT_ONCE), 1.0 / (1 << DIGITS_AT_ONCE)
    for _ in range(DIGITS // DIGITS_AT_ONCE):
        high = min([high, *[x for x, _, ok in _fits(sources, low, step, mixture, budget) if ok]])
        if high <= 0:
            break
        low, step = high - step, step / (1 << DIGITS_AT_ONCE)
    return max(target, high, 0.0)


_KEY, _N, _COPIES, _BLOCK = "__mix_source", "__mix_tokens", "__mix_copies", "__mix_block"


def _read(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, a source key that is never null, and the tokens of the text."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(*columns, key.alias(_KEY), n_tokens(F.col("text")).alias(_N))


def weights(sources: DataFrame, mixture: Mixture) -> DataFrame:
    """Sources with their weight, full passes and the tokens of the last pass.

    ``sources`` has a source's key and its tokens as a double. Sources without tokens
    have weight 0.
    """
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0.0))).first()[0]
    budget = float(total if mixture.budget is None else mixture.budget)
    filled = sources.filter("tokens > 0").withColumn("log", F.log(F.col("tokens") / F.lit(total or 1.0)))
    power = exponent(filled, mixture, budget) if total else 0.0
    z = filled.agg(F.sum(F.exp(F.lit(power) * F.col("log")))).first()[0] or 1.0
    share = F.exp(F.lit(power) * F.log(F.col("tokens") / F.lit(total or 1.0))) / F.lit(z)
    weighted = sources.withColumn("weight", F.when(F.col("tokens") > 0, share).otherwise(0.0))
    goal = F.round(F.col("weight") * F.lit(budget))
    full = F.when(F.col("tokens") > 0, F.floor(goal / F.col("tokens"))).otherwise(F.lit(0))
    return weighted.withColumn("full", full.cast("int")).withColumn("rest", goal - F.col("full") * F.col("tokens")).withColumn(
        "blocks", (F.floor(F.col("tokens") / BLOCK_TOKENS) + 1).cast("int")
    )


def _copied(rows: DataFrame, light: DataFrame, mixture: Mixture) -> DataFrame:
    """``rows`` with weight, block, full passes and whether the last pass has the row.

    Blocks of a source are the rows with the same hash of the id, so many that each
    holds about BLOCK_TOKENS. In the last pass blocks follow in random order: whole
    ones while they end within the rest of the budget, and of the one that reaches it
    the rows, in random order, that begin within it. Rows that agree in source, id and
    tokens go together. Texts are not dealt out while the tables of sources, blocks and
    cut rows are small enough to be broadcast.
    """
    seed = F.lit(mixture.seed)
    sources = settle(light.groupBy(_KEY).agg(F.sum(_N).cast("double").alias("tokens")))
    plan = settle(weights(sources, mixture))
    block = F.pmod(F.xxhash64("doc_id", seed), F.col("blocks")).alias(_BLOCK)
    placed = light.join(plan.select(_KEY, "full", "rest", "blocks"), _KEY).select(_KEY, "doc_id", _N, "full", "rest", block)
    sizes = placed.groupBy(_KEY, _BLOCK, "full", "rest").agg(F.sum(_N).alias("size"))
    turn = Window.partitionBy(_KEY).orderBy(F.xxhash64(_KEY, _BLOCK, "full", seed), _BLOCK)
    before = F.coalesce(F.sum("size").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = settle(
        sizes.withColumn("before", before).select(
            _KEY, _BLOCK, (F.col("rest") - F.col("before")).alias("room"),
            (F.col("before") + F.col("size") <= F.col("rest")).alias("whole"),
        )
    )
    cut = last.filter("NOT whole AND room > 0").select(_KEY, _BLOCK, "room")
    within = (
        placed.join(cut, [_KEY, _BLOCK])
        .groupBy(_KEY, _BLOCK, "room", "doc_id", _N).agg(F.sum(_N).alias("size"))
    )
    row_turn = Window.partitionBy(_KEY, _BLOCK).orderBy(F.xxhash64("doc_id", F.lit(mixture.seed + 1)), "doc_id", _N)
    ahead = F.coalesce(F.sum("size").over(row_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = within.withColumn("ahead", ahead).filter("ahead < room").select(
        F.col(_KEY).alias("__t_key"), F.col("doc_id").alias("__t_id"), F.col(_N).alias("__t_n"), F.lit(True).alias("__t_in")
    )
    decided = plan.select(_KEY, F.col("weight").alias("__mix_weight"), F.col("full").alias("__mix_full"), F.col("blocks").alias("__mix_blocks"))
    rows = rows.join(checked(decided), _KEY).withColumn(_BLOCK, F.pmod(F.xxhash64("doc_id", seed), F.col("__mix_blocks")))
    rows = rows.join(checked(last.select(_KEY, _BLOCK, F.col("whole").alias("__mix_whole"))), [_KEY, _BLOCK], "left")
    same = (F.col("__t_key") == F.col(_KEY)) & F.col("__t_id").eqNullSafe(F.col("doc_id")) & (F.col("__t_n") == F.col(_N))
    rows = rows.join(checked(settle(taken)), same, "left")
    in_last = F.coalesce("__mix_whole", F.lit(False)) | F.coalesce("__t_in", F.lit(False))
    return rows.withColumn(_COPIES, F.col("__mix_full") + F.when(in_last & (F.col(_N) > 0), 1).otherwise(0))


def mix(docs: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """The mixture: doc_id, source, n_tokens, weight, pass, block and turn of each row taken.

    A row appears once for each pass that has it; pass 0 is the first. Sorted by pass,
    turn (of the block in the pass, random) and row_turn, a source's rows are its block
    permutations. A null source is a source of its own; rows without a word, of null
    or empty texts, carry no tokens and are in the full passes only; an empty table
    gives no rows. Repeated rows are taken alike. Further columns are not read.
    """
    prepare(docs.sparkSession)
    light = settle(_read(docs, ["doc_id", "source"]))
    rows = _copied(light, light, mixture).filter(F.col(_COPIES) > 0)
    seed = F.lit(mixture.seed)
    each = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col(_COPIES) - 1)))
    return each.select(
        "doc_id", "source", F.col(_N).alias("n_tokens"), F.col("__mix_weight").alias("weight"), "pass",
        F.col(_BLOCK).alias("block"),
        F.xxhash64(_KEY, _BLOCK, "pass", seed).alias("turn"),
        F.xxhash64("doc_id", F.lit(mixture.seed + 1)).alias("row_turn"),
    )


def mixed(docs: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture has it, with their columns."""
    prepare(docs.sparkSession)
    light = settle(_read(docs, ["doc_id"]))
    rows = _copied(_read(docs, docs.columns), light, mixture).filter(F.col(_COPIES) > 0)
    return rows.withColumn("__mix_pass", F.explode(F.sequence(F.lit(1), F.col(_COPIES)))).select(*docs.columns)
