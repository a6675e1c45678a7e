from tables import rows

from biomosaic.operators.crosswalk import crosswalk_pivot, crosswalk_transitions
from biomosaic.sources.constants import CROSSWALK_PAIRS, crosswalk_pairs


def _inputs(spark, table, presence):
    models = [
        (f"b{i}", "bAAAAx" if i < 5 else "bEXCLx", int(i != 4), "S", 1) for i in range(6)
    ]
    return (
        crosswalk_pairs(spark, [(1, 10), (2, 10)]),
        table("presence", *presence),
        table("submodels", *models),
        table("taxa", ("bAAAAx", "A a", "Aa", 1), ("bEXCLx", "E e", "Ee", 0)),
        table("map_units", (1, " Old one ", 1), (2, "Old two", 1), (10, "New", 1)),
    )


PRESENCE = [
    ("b0", 1, 0), ("b0", 10, 0),
    ("b1", 1, 1), ("b1", 10, 0), ("b1", 2, 1),
    ("B2 ", 1, 1), ("b2", 10, 1),
    ("b3", 1, 0),  # no record in the new unit
    ("b4", 1, 1), ("b4", 10, 1),  # submodel not included
    ("b5", 1, 1), ("b5", 10, 1),  # species not included
]


def test_constant_pairs():
    assert len(CROSSWALK_PAIRS) == len({a for a, _ in CROSSWALK_PAIRS}) == 19


def test_transitions(spark, table):
    result = crosswalk_transitions(*_inputs(spark, table, PRESENCE))
    one, two = "1-10    Old one TO New", "2-10    Old two TO New"
    assert rows(result) == [
        ("1", "10", one, "0-0", 1),
        ("1", "10", one, "1-0", 1),
        ("1", "10", one, "1-1", 1),
        ("2", "10", two, "1-0", 1),
    ]


def test_pivot_leaves_absent_pairs_null(spark, table):
    pivot = crosswalk_pivot(crosswalk_transitions(*_inputs(spark, table, PRESENCE)))
    assert pivot.columns[3:] == ["0-0", "0-1", "1-0", "1-1"]
    assert [r[3:] for r in rows(pivot)] == [(1, None, 1, 1), (None, None, 1, None)]


def test_labels_that_differ_in_blanks_are_grouped_apart_and_merged_by_the_pivot(spark, table):
    pairs, presence, models, taxa, units = _inputs(spark, table, PRESENCE)
    units = units.union(table("map_units", (1, "Old one", 1)))
    result = crosswalk_transitions(pairs, presence, models, taxa, units)
    assert len([r for r in rows(result) if r[0] == "1" and r[3] == "1-1"]) == 2
    assert len(rows(crosswalk_pivot(result))) == 2


def test_repeated_and_unknown_records_match_like_a_join(spark, table):
    presence = [("b0", 1, 1), ("b0", 1, 1), ("b0", 10, 1), ("b0", 10, 1), ("b0", 10, 1), ("b1", 1, None), ("b1", 10, 0)]
    result = crosswalk_transitions(*_inputs(spark, table, presence))
    assert rows(result, "xw_pres", "count") == [("1-1", 6), (None, 1)]
