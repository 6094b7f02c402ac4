from ledgerloom import catalog
from ledgerloom.operators import sheets

GOOD = """# Outreach angles: ACME
Researched 12 March 2025. Private.
## The situation in plain English
fine
## Angles
### 1. One
What is happening: a
What it means for them: b
Your way in: c
Developability: High
Trigger: Structural [FACT] x
  [FACT] y [INFERENCE] z
Readiness: Send now
Email hook:
 - First line: Your lease ends in May
Call opener: d
Evidence: 3/4/2025
Stakeholder: e
Confidence: Medium
## Jargon buster
## Why this is a live prospect
## At a glance
| a | b |
## Source Ledger
| fact | ageing | refresh: none |
"""


def verdicts(spark, text, ledger=None):
    rows = sheets.sheet_findings(spark.createDataFrame([(1, text, ledger)], "id int, text string, ledger string")).collect()
    return {(r.item, r.rule): r.verdict for r in rows}


def test_a_good_sheet_passes(spark):
    got = verdicts(spark, GOOD)
    assert set(got.values()) == {"PASS"} and (1, "structural_fence") in got and (None, "angle_rank_order") in got and (1, "trigger_dated") not in got


def test_what_breaks_each_rule(spark):
    def broken(text, ledger=None):
        return {k for k, v in verdicts(spark, text, ledger).items() if v != "PASS"}

    assert broken(GOOD.replace("fine", "fine - or – not")) == {(None, "no_em_en_dashes")}
    assert broken(GOOD.replace("fine", "They have a Complete network")) == {(None, "footprint_reconciliation")}
    assert broken(GOOD.replace("fine", "It is no complete network; RECONCILIATION: UNRESOLVED GAP")) == set()
    assert broken(GOOD.replace("fine", "A complete network. RECONCILIATION: RECONCILED")) == set()
    assert broken(GOOD.replace("| a | b |", "|---|")) == {(None, "at_a_glance")}
    assert broken(GOOD.replace("refresh: none", "none")) == {(None, "recency_refresh")}
    assert broken(GOOD, "| https://www.investing.com/x | y |") == {(None, "aggregator_sources")}
    assert broken(GOOD, "| https://notinvesting.com/x | y |") == set()
    assert broken(GOOD.replace("[INFERENCE] z", "z")) == {(1, "structural_fence")}
    assert broken(GOOD.replace("First line: Your", "First line: *Note* your")) == {(1, "hook_pasteable")}
    more = GOOD.replace("## Jargon", GOOD[GOOD.index("### 1.") : GOOD.index("## Jargon")].replace("1. One", "2. Two").replace("Developability: High", "Developability: Low") + GOOD[GOOD.index("### 1.") : GOOD.index("## Jargon")].replace("1. One", "3. Three") + "## Jargon")
    assert broken(more) == {(None, "angle_rank_order")}
    assert broken("# Outreach angles: x\nResearched 2025, Listed\n## The situation in plain English\n## Angles\nDo not call them.") == {(None, "watchlist")}
    assert {(None, "title"), (None, "zero_angle_ok")} <= broken(None)
    assert (None, "no_unsourced_absence") in broken(GOOD + "\nWe could not find any")
    assert (None, "no_unsourced_absence") not in broken(GOOD + "\n## Reading the signals\nno evidence of it")
    assert (None, "inference_block") in broken(GOOD + "\n## Reading the signals\n### Bet 1\nthin")


def test_tables(spark):
    d = spark.createDataFrame([("# a | b |\n| x | y |\n|---|:-:|\n z | w | v \nplain | text",)], "t string")
    assert d.select(sheets.table_rows(d.t)).first()[0] == [["x", "y"], ["z", "w", "v"]]


def test_notes_stand_apart_from_the_tables_above(spark, tmp_path):
    spark.createDataFrame([(2090,), (2091,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r.id, r.rule): r.verdict for r in catalog.queries()["sheet_findings"](spark, str(tmp_path)).where("item is null").collect()}
    assert (got[2090, "at_a_glance"], got[2090, "coverage_map"], got[2091, "at_a_glance"]) == ("FAIL", "FAIL", "PASS")
