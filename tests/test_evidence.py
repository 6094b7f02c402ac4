import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evidence

ROWS = [(1, "a", None), (2, "b,1:c", 2.5), (2, "b,1:c", 2.5), (3, "", 0.0), (4, None, 1.0)]
SCHEMA = "id int, text string, size double"


def mark(df):
    return tuple(evidence.fingerprint(df).first())


def test_order_and_dealing_keep_a_fingerprint(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert mark(df) == mark(spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(7)) and mark(df)[0] == 5
    parts = evidence.fingerprint(df, ["id"])
    assert tuple(evidence.merge_fingerprints(parts).first()) == mark(df)
    assert mark(df.limit(0)) == (0, "0", "0") == tuple(evidence.merge_fingerprints(parts.limit(0)).first())


@pytest.mark.parametrize("rows", [ROWS[1:], ROWS + ROWS[:1], [(1, "a", 0.0), *ROWS[1:]], [(1, "", None), *ROWS[1:]], [(1, "a", None), (2, "b", 2.5), *ROWS[2:]], [ROWS[0], *ROWS[2:], ROWS[3]]])
def test_any_change_breaks_it(spark, rows):
    assert mark(spark.createDataFrame(rows, SCHEMA)) != mark(spark.createDataFrame(ROWS, SCHEMA))


def test_states_of_a_frozen_table(spark):
    df = spark.createDataFrame([*ROWS, (None, "n", 1.0)], SCHEMA)
    now = spark.createDataFrame([ROWS[0], ROWS[1], (3, "", 1.0), (9, "new", 1.0), (None, "n", 1.0)], SCHEMA)
    got = {r.id: r.state for r in evidence.frozen_state(evidence.fingerprint(df.where("id is not null"), ["id"]), evidence.fingerprint(now.where("id is not null"), ["id"]), ["id"]).collect()}
    assert got == {1: "same", 2: "changed", 3: "changed", 4: "missing", 9: "new"}


def test_known_texts_are_not_computed_again(spark):
    rows = spark.createDataFrame([(1, "10,500 sq m. 12 docks"), (2, "10,500 sq m. 12 docks"), (3, "plot 2 500 000; 3.50"), (4, None), (5, "")], "id int, text string")
    memo = spark.createDataFrame([], "digest string, value array<bigint>")
    first, new = evidence.remembered(rows, "text", memo, evidence.schedule_figures, "figures")
    assert {r.id: r.figures for r in first.collect()} == {1: [10500], 2: [10500], 3: [2500000], 4: None, 5: []}
    assert new.count() == 3
    fails = lambda c: F.raise_error("computed").cast("array<bigint>")
    again, more = evidence.remembered(rows, "text", new.unionByName(new), fails, "figures")
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect())) and more.count() == 0


def test_changes_replay_to_what_is_implied(spark):
    schema = "property_id int, field string, original string, translated string, reconstructed boolean"
    held = spark.createDataFrame([(1, "a", "x", "y", False), (2, "a", None, "y", False), (3, "a", "x", "y", True)], schema)
    now = spark.createDataFrame([(1, "a", "x", "y", False), (2, "a", "z", "y", False), (4, "b", None, "y", False)], schema)
    changes = evidence.row_changes(held, now, ["property_id", "field"])
    assert sorted((r.change, r.property_id) for r in changes.collect()) == [("add", 2), ("add", 4), ("keep", 1), ("retract", 2), ("retract", 3)]
    assert sorted(map(str, evidence.apply_changes(held, changes).collect())) == sorted(map(str, now.collect()))
    assert {r.change for r in evidence.row_changes(now, now, ["property_id", "field"]).collect()} == {"keep"}


def test_reach(spark):
    touched = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "C"), (5, "D"), (6, "D"), (1, "A")], "claimant int, deck string")
    figures = spark.createDataFrame([(2, 5000), (3, 7000), (4, 8000), (3, 9000), (4, 9000), (5, 7000), (None, 1)], "claimant int, figure int")
    pages = spark.createDataFrame([("A", 0, []), ("A", 1, [1]), ("B", 0, [5000]), ("B", 1, []), ("C", 0, [7000, 9000]), ("C", 1, [7000, 8000]), ("C", 2, [8000]), ("C", 3, [9000]), ("D", 0, [7000])], "deck string, page int, figures array<int>")
    spoken = spark.createDataFrame([("A", 1), ("C", 2)], "deck string, page int")
    got = {tuple(r) for r in evidence.reach_pages(touched, spoken, figures, pages).collect()}
    assert got == {(1, "A", 0, "alone"), (2, "B", 0, "own figure"), (3, "C", 0, "only figure")}


def test_contested_stretches(spark):
    claims = spark.createDataFrame([("d", "x", 1, 5), ("d", "x", 4, 6), ("d", "y", 5, 8), ("d", "z", 6, 6), ("d", "z", 12, 14), ("d", "y", 14, 20), ("d", "y", 9, 2), ("e", "x", 1, 9)], "deck string, claimant string, first int, last int")
    assert sorted(tuple(r) for r in evidence.contested_pages(claims).collect()) == [("d", 5, 6, 3), ("d", 14, 14, 2)]
