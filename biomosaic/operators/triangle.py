"""Joins of three tables of which each two share a key.

Selections (species, unit), records (unit, place) and ranges (species, place) meet in
such a triangle. Opened along one key throughout, a key that is common on two sides makes
rows that the third throws away again: a unit that all species select meets every place
that has the unit, though each species lives in a few of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base rows of one key that meet the first side in one place; more are dealt out.
HOT_ROWS = 200_000

_FIRST, _SECOND = 1, 2


@dataclass(frozen=True)
class Triangle:
    """``base`` joined with ``first`` on ``first_on`` and with ``second`` on ``second_on``,
    where rows of the two sides also agree in ``meet``.

    Every base row is opened by the side on which it has fewer matches; the other side
    only looks up what that gave, by its whole key. Degrees are counted per key, with
    partial counts before the shuffle. The rows before the last join are thus at most
    the sum over base rows of the smaller of two degrees, whichever keys are common.
    Base rows are weighed under the keys of the second side first and of the first side
    last, where those that the first side opens then lie already; only rows that the
    second side opens are shuffled again for it. ``second_last`` is the other way round,
    for base rows most of which the second side opens. ``packed`` is for base rows of
    nothing but a key of each side: those that the second side opens are shuffled as one
    row for each of its rows, with a list of the first side's keys, opened where they lie.

    ``salted`` deals the base rows of a key of the first side out to places of at most
    HOT_ROWS, each with a copy of the key's rows on that side. Copies are as many as base
    rows over HOT_ROWS, so they add little to what the join makes of them. It takes a
    count of the base rows; without it Spark splits such partitions while it runs
    (:func:`..session.split_hot_keys`). Null keys match nothing. Columns that the sides
    have besides their keys need names of their own.
    """

    base: DataFrame
    first: DataFrame
    first_on: list[str]
    second: DataFrame
    second_on: list[str]
    meet: list[str]
    salted: bool = False
    second_last: bool = False
    packed: bool = False

    def __post_init__(self):
        # The same null tests in every use: the sides' shuffles can then be reused.
        for name, columns in (
            ("base", self._keys),
            ("first", [*self.first_on, *self.meet]),
            ("second", [*self.second_on, *self.meet]),
        ):
            known = reduce(and_, [F.col(c).isNotNull() for c in columns])
            object.__setattr__(self, name, getattr(self, name).filter(known))

    @property
    def _keys(self) -> list[str]:
        return list(dict.fromkeys([*self.first_on, *self.second_on]))

    def _own(self, side: int) -> list[str]:
        return self.first_on if side == _FIRST else self.second_on

    def _payload(self, side: int) -> list[str]:
        frame = self.first if side == _FIRST else self.second
        return [c for c in frame.columns if c not in (*self._own(side), *self.meet)]

    def _degree(self, side: int) -> Column:
        """Number of rows, counted in a way that needs all columns of the side: none is
        pruned, and the shuffles behind the side serve count and joins alike."""
        odd = F.xxhash64(*self._payload(side), *self.meet) % 2 != 0
        return F.count_if(odd) + F.count_if(~odd) if self._payload(side) else F.count(F.lit(1))

    def _copies(self) -> DataFrame:
        """How many more places each key of the first side needs."""
        rows = self.base.groupBy(*self.first_on).agg(F.count(F.lit(1)).alias("_rows"))
        return rows.select(*self.first_on, F.floor(F.col("_rows") / F.lit(HOT_ROWS)).alias("_more"))

    def _weighed(self) -> DataFrame:
        """Base rows with matches on both sides, and the side that opens them."""
        first = self.first.groupBy(*self.first_on).agg(self._degree(_FIRST).alias("_n_first"))
        second = self.second.groupBy(*self.second_on).agg(self._degree(_SECOND).alias("_n_second"))
        place = F.lit(0).cast("long")
        if self.salted:
            first = first.join(self._copies(), self.first_on)
            place = F.pmod(F.xxhash64(*self.second_on), F.col("_more") + 1)
        # The last term is zero and needs all base columns: one shuffle of the base rows
        # serves those of both sides, whichever columns are taken from them later.
        even = F.pmod(F.xxhash64(*self.base.columns), F.lit(1).cast("long"))
        side = F.when(F.col("_n_first") <= F.col("_n_second") + even, _FIRST).otherwise(_SECOND)
        order = [(second, self.second_on), (first, self.first_on)]
        weighed = self.base
        for degrees, on in reversed(order) if self.second_last else order:
            weighed = weighed.join(degrees, on)
        weighed = weighed.withColumn("_opened", side).withColumn("_place", place)
        return weighed.select(*self.base.columns, "_opened", "_place")

    def _places(self) -> DataFrame:
        """The first side, with a copy of each row for every place of its key."""
        if not self.salted:
            return self.first
        places = F.explode(F.sequence(F.lit(0).cast("long"), "_more")).alias("_place")
        return self.first.join(self._copies().select(*self.first_on, places), self.first_on)

    def _opened_by(self, side: int) -> DataFrame:
        """Base rows that the side opens, with their matches on it."""
        rows = self._weighed().filter(F.col("_opened") == side)
        if side == _FIRST and self.salted:
            found = rows.join(self._places(), [*self.first_on, "_place"])
        elif side == _FIRST:
            found = rows.join(self.first, self.first_on)
        else:
            found = rows.join(self.second, self.second_on)
        return found.select(*self.base.columns, "_opened", *self.meet, *self._payload(side))

    def _packed(self) -> DataFrame:
        """The rows of ``_opened_by(_SECOND)``, made after the shuffle to the other side."""
        (item,) = self.first_on
        lists = (
            self._weighed().filter(F.col("_opened") == _SECOND)
            .groupBy(*self.second_on).agg(F.collect_list(item).alias("_items"))
        )
        found = lists.join(self.second, self.second_on).repartition(*self.meet)
        return found.withColumn(item, F.explode("_items")).drop("_items")

    def _closed(self, side: int) -> DataFrame:
        """Rows that the side opened, looked up on the other side."""
        other = self.second if side == _FIRST else self.first
        opened = self._packed() if self.packed and side == _SECOND else self._opened_by(side)
        found = opened.join(other, [*self._own(_FIRST + _SECOND - side), *self.meet])
        return found.select(*self.base.columns, *self.meet, *self._payload(_FIRST), *self._payload(_SECOND))

    def opened(self) -> DataFrame:
        """Base rows with their matches on the side that opens them, before the last join."""
        return self._opened_by(_FIRST).unionByName(self._opened_by(_SECOND), allowMissingColumns=True)

    def joined(self) -> DataFrame:
        return self._closed(_FIRST).unionByName(self._closed(_SECOND))

    def summed(self, keys: list[str], value: Column, name: str, own: dict[str, Column]) -> DataFrame:
        """``value``, of columns of base and first, added up per ``keys`` of the base.

        ``own`` makes the key of the second side from the first of ``keys``. What the first
        side opened is shuffled by that one and added up before it is looked up on the
        second: rows of a base row stay side by side, where they compress, none carries
        the same code twice, and a code's rows add up where they lie.
        """
        place = [*keys, *self.meet]
        found = self._opened_by(_FIRST).select(*place, value.alias(name)).repartition(keys[0])
        found = found.groupBy(*place).agg(F.sum(name).alias(name)).withColumns(own)
        first = found.join(self.second, [*self.second_on, *self.meet]).select(*keys, name)
        rows = first.unionByName(self._closed(_SECOND).select(*keys, value.alias(name)))
        return rows.groupBy(*keys).agg(F.sum(name).alias(name))
