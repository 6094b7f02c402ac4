import duckdb
import pytest

from ledgerloom import catalog
from ledgerloom.operators import harvest


def test_media(spark):
    claims = spark.createDataFrame([(1, "a", [0]), (2, "a", [1, 1]), (3, "b", [0, 1]), (4, "c", [0]), (5, "c", None), (6, "gone", [0])], "card int, deck string, looked array<int>")
    decks = spark.createDataFrame([("a", 5, 0, "text", 0), ("b", 3, 9, "raster", 0), ("c", 1, 0, "text", 0), ("d", 2, 0, "text", None)], "deck string, pages int, images int, mode string, renders int")
    cards = spark.createDataFrame([(1, 9, True, False), (2, 3, True, False), (3, 9, False, False), (4, None, None, None), (5, 0, True, True)], "card int, gallery int, has_plan boolean, placeholder boolean")
    acks = spark.createDataFrame([("blind_interpretation_ok", " D "), ("other", "all")], "key string, value string")
    run = lambda a: {tuple(r) for r in harvest.media_findings(claims, decks, cards, a).collect()}
    want = {(1, "a", "under-harvest", "1", "note"), (2, "a", "under-harvest", "2", "signal"), (3, "b", "no plan, pages unlooked", "3", "signal"), (None, "a", "no renders", "5", "blocking"), (None, "d", "no renders", "2", "acked"), (None, "a", "orphan pages", "3,4,5", "signal"), (None, "b", "orphan pages", "3", "signal")}
    assert run(acks) == want
    assert (None, "a", "no renders", "5", "acked") in run(spark.createDataFrame([("blind_interpretation_ok", "ALL")], "key string, value string"))
    assert (None, "d", "no renders", "2", "blocking") in run(acks.limit(0))


def test_reviews(spark):
    needed = spark.createDataFrame([(1, g) for g in "abcdea"], "run int, gate string")
    said = spark.createDataFrame([(1, "a", "All is well.\nVERDICT: PASS, ship it"), (1, "a", "short"), (1, "b", "  tiny "), (1, "c", "long words without any of them"), (1, "d", "**VERDICT**: BLOCKED, PASS later"), (2, "e", "PASS " * 9)], "run int, gate string, text string")
    got = {(r.gate, r.defect) for r in harvest.review_defects(needed, said, r"\b(?:PASS|BLOCKED)\b", "(?i)block").collect()}
    assert got == {("b", "stub"), ("c", "no verdict"), ("d", "blocking"), ("e", "missing")}


def test_words_end_at_letters_beyond_ascii(spark, tmp_path):
    rows = [(1, 0, "user", "ein langer Satz inßpf"), (1, 1, "assistant", "ein langer Satz innen"), (1, 2, "system", "und dieser, AND so fort")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.queries()["review_defects"](spark, str(tmp_path)).collect()
    sql = catalog.oracle_sql()["review_defects"].replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(tuple(r) for r in got) == sorted(duckdb.sql(sql).fetchall()) == [(1, "assistant", "no verdict")]


def test_gaps(spark):
    rows = spark.createDataFrame([("x", 3, "C", "u", False), ("x", 1, "A", "u", False), ("x", 2, "B", " ", True), ("x", 4, "D", "v", True), ("y", 1, "E", "w", True)], "list string, number int, label string, url string, direct boolean")
    got = {k: [r.text for r in harvest.gaps_markdown(rows, "list").where(f"list = '{k}'").orderBy("line").collect()] for k in "xy"}
    assert got["x"] == ["- Properties: **4**", "- Files: **2**", "- Direct: **1**", "- Need attention: **1**", "- No link: **1**", "## Not a direct link", "- **No. 1+3** A — u", "## No link", "- **No. 2** B"]
    assert got["y"][-1] == "- No link: **0**" and len(got["y"]) == 5


@pytest.mark.parametrize("said,want", [("48°29'51.0\"N 17°01'39.7\"E", (48.4975, 17.027694)), ("E 17°, at 17°01' E; 48°29′ n", (48.483333, 17.016667)), ("10°0'S,\n20°30'W", (-10.0, -20.5)), ("10°0'N 20°0'S", None), ("95°0'N 20°0'E", None), ("a 48 m x 17 m unit", None), (None, None)])
def test_compass(spark, said, want):
    d = spark.createDataFrame([(said,)], "t string")
    got = d.select(harvest.dms_from_text(d.t)).first()[0]
    assert (got and (round(got.lat, 6), round(got.lng, 6))) == want
