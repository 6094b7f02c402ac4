"""Rules of finished sheets: markdown with ranked items, a ledger and labelled fields, each rule a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import saturation_claim

#: Sections, labels of an item, bands, hosts that only repeat figures, and verbs that begin an instruction.
SECTIONS = ["## The situation in plain English", "## Angles"]
ITEM_SECTIONS = {"jargon_buster": "## Jargon buster", "why_prospect": "## Why this is a live prospect", "at_a_glance": "## At a glance"}
LABELS = ["What is happening:", "What it means for them:", "Your way in:", "Developability:", "Trigger:", "Readiness:", "Email hook:", "Call opener:", "Evidence:", "Stakeholder:", "Confidence:"]
BANDS = {"high": 3, "medium": 2, "low": 1}
AGGREGATORS = ["finance.yahoo.com", "investing.com", "marketscreener.com", "simplywall.st", "stockanalysis.com", "wallmine.com", "tipranks.com", "barchart.com"]
INSTRUCTIONS = ["note", "reference", "mention", "highlight", "flag", "point", "lead", "open", "cite", "raise", "remind", "stress", "underscore", "call"]
DASHES = "[‒–—―−]"
_MONTHS = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DATE = rf"(?i)\b(?:19|20)\d{{2}}\b|\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b|\b\d{{1,2}}\s+{_MONTHS}\b|\b{_MONTHS}\s+\d{{1,2}}(?:st|nd|rd|th)?\b"
ABSENCE = r"(?i)\b(?:found no|could not find|couldn't find|did not find|didn't find|we found no|no evidence of|unable to find|no trace of|appears to have no|not found in (?:my|our) search\w*)\b"
SATURATION = r"(?i)\b(?:saturat\w*|complete network|full footprint|fully mapped|complete (?:european )?footprint|all\s+\d+\s+(?:sites|distribution centres|warehouses|logistics centres))\b"
NEGATION = r"(?i)\b(?:no|not|without|never|lacks?|lacking|incomplete|cannot|can't|isn't|aren't|yet to|too early|unconfirmed|unverified|provisional|tbd|n't)\b"
NO_CALL = r"(?i)do not call|no live reason to call|no shortlist angle is live|no opportunity is developable"
PASS, FAIL, WARN = "PASS", "FAIL", "WARN"


def table_rows(c: Column) -> Column:
    """The rows of markdown tables as arrays of cells: lines with two bars that aren't headings or rules between rows."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: ~x.startswith("#") & x.rlike(r"\|.*\|") & x.rlike(r"[^|\-: ]"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda v: F.trim(v)))


def section(c: Column, heading: str) -> Column:
    """The body below the first line that begins with the heading (in any case), up to the next one of its level."""
    return F.regexp_extract(c, rf"(?ims)^\Q{heading}\E[^\n]*\n?(.*?)(?=^##\s|\z)", 1)


def field(block: Column, label: str) -> Column:
    """A labelled field with what follows it up to the next label."""
    ends = "|".join(rf"\Q{x}\E" for x in LABELS)
    return F.regexp_extract(block, rf"(?ms)^\s*(\Q{label}\E.*?)(?=^\s*(?:{ends})|\z)", 1)


def _verdict(when: Column, other: str = FAIL) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), PASS).otherwise(other)


def sheet_findings(sheets: DataFrame) -> DataFrame:
    """(id, item, rule, verdict) for sheets (id, text, ledger): PASS, FAIL or WARN of each rule that applies.

    Rules of a whole sheet have no item; those of its ranked items (`### 1.` and so on) name its place among them. A sheet
    without items must say that there is nothing to call about, or keep a watch-list. What stands under `Reading the
    signals` is inference and kept out of the rules on claims; its bets have a rule of their own. Null texts are empty.
    """
    said = F.coalesce("text", F.lit(""))
    s = sheets.select("id", said.alias("t"), F.coalesce("ledger", F.lit("")).alias("ledger"), F.regexp_replace(said, r"(?ims)^##\s+Reading the signals[^\n]*\n?.*?(?=^##\s|\z)", "").alias("x"))
    blocks = F.filter(F.split("x", r"(?m)(?=^#{2,3}\s)"), lambda b: b.rlike(r"^###\s+\d+\."))
    own = F.when(F.col("t").contains("## Source Ledger"), F.regexp_extract("t", r"(?s)## Source Ledger(.*)", 1)).otherwise("")
    s = s.withColumn("blocks", blocks).withColumn("listed", F.concat(own, F.lit("\n"), F.col("ledger"))).withColumn("own", own)
    some, t, x = F.size("blocks") > 0, F.col("t"), F.col("x")
    both = F.concat(x, F.lit("\n"), F.col("ledger"))
    watch = t.rlike(r"(?i)##\s*Watch-?list")
    ledger_rows, old = table_rows(F.col("listed")), lambda r: F.exists(r, lambda c: F.lower(c).isin("ageing", "aging"))
    fresh = lambda r: F.array_join(r, "|").rlike(r"(?i)refresh:\s*(?:confirmed-ageing|none)")
    hosts = F.regexp_extract_all(F.lower("listed"), F.lit(r"https?://([a-z0-9.\-]+)"), 1)
    repeated = F.exists(hosts, lambda h: F.exists(F.array(*map(F.lit, AGGREGATORS)), lambda a: (h == a) | h.endswith(F.concat(F.lit("."), a))))
    gap, solved = both.rlike(r"(?i)RECONCILIATION:\s*UNRESOLVED GAP\b"), both.rlike(r"(?i)RECONCILIATION:\s*RECONCILED\b")
    unsure = F.exists(table_rows(both), lambda r: F.array_join(r, "|").rlike(r"(?i)\bINCONCLUSIVE\b"))
    bets = F.filter(F.split(section(t, "## Reading the signals"), r"(?m)(?=^###\s)"), lambda b: b.rlike(r"^###\s+Bet\b"))
    grounded = lambda b: b.contains("What would confirm it:") & b.contains("What would kill it:") & (F.size(F.regexp_extract_all(b, F.lit(r"(\[FACT\b)"), 1)) >= 2) & b.rlike(r"(?im)^\s*move[ -]type:") & b.rlike(r"(?im)^\s*posture:")
    rule = lambda name, verdict, when=None: F.struct(F.lit(name).alias("rule"), (verdict if when is None else F.when(when, verdict)).alias("verdict"))
    whole = F.array(
        rule("no_em_en_dashes", _verdict(~t.rlike(DASHES))), rule("title", _verdict(t.rlike(r"(?m)^#\s+Outreach angles:"))),
        rule("header_run_date", _verdict(F.regexp_extract(t, r"(?m)^([^\n]*Researched[^\n]*)", 1).rlike(DATE), WARN)), rule("header_listed_private", _verdict(t.rlike(r"\b(?:Listed|Private)\b"), WARN)),
        rule("required_sections", _verdict(t.contains(SECTIONS[0]) & t.contains(SECTIONS[1]))),
        rule("zero_angle_ok", _verdict(t.rlike(NO_CALL) | watch), ~some), rule("watchlist", _verdict(watch, WARN), ~some), rule("angle_count", F.lit(PASS), some),
        *[rule(name, _verdict(t.contains(h) & ((F.size(table_rows(section(t, h))) > 0) if name == "at_a_glance" else F.lit(True))), some) for name, h in ITEM_SECTIONS.items()],
        rule("source_ledger", _verdict((F.size(table_rows(F.col("own"))) > 0) | F.lower("own").contains("ledger.md") | (F.size(table_rows(F.col("ledger"))) > 0)), some),
        rule("recency_refresh", _verdict(F.forall(F.filter(ledger_rows, old), fresh)), some),
        rule("footprint_reconciliation", F.when(~saturation_claim(x, SATURATION, NEGATION), PASS).when(gap | ~solved, FAIL).otherwise(PASS)),
        rule("no_unsourced_absence", _verdict(~x.rlike(ABSENCE))), rule("coverage_map", _verdict(~(solved & unsure))), rule("aggregator_sources", _verdict(~repeated, WARN)),
        rule("inference_block", _verdict((F.size(bets) <= 4) & F.forall(bets, grounded), WARN), F.size(bets) > 0),
    )
    of_sheet = s.select("id", F.lit(None).cast("int").alias("item"), F.explode(whole).alias("r")).select("id", "item", "r.*")

    b = s.select("id", F.posexplode("blocks").alias("n", "b")).select("id", (F.col("n") + 1).alias("item"), "b")
    trigger, hook = field(F.col("b"), "Trigger:"), field(F.col("b"), "Email hook:")
    first = F.regexp_extract("hook", r"(?im)^\s*[-*+]?\s*First line:\s*(\S+)", 1)
    count = lambda c, tag: F.size(F.regexp_extract_all(c, F.lit(rf"(?i)(\[{tag}\b)"), 1))
    b = b.select("*", trigger.alias("trigger"), hook.alias("hook"), F.lower(F.regexp_extract("b", r"(?im)^Developability:\s*(High|Medium|Low)\b", 1)).alias("band"), F.lower(F.regexp_extract("b", r"(?im)^Trigger:\s*(Event-driven|Structural)\b", 1)).alias("kind"), F.lower(F.regexp_extract("b", r"(?im)^Readiness:\s*(Send now|Verify first)\b", 1)).alias("ready"))
    block, tr = F.col("b"), F.col("trigger")
    every = block.contains(LABELS[0])
    for label in LABELS[1:]:
        every = every & block.contains(label)
    items = F.array(
        rule("fields", _verdict(every)), rule("dated", _verdict(block.rlike(DATE), WARN)), rule("developability", _verdict(F.col("band") != "")), rule("trigger_type", _verdict(F.col("kind") != "")),
        rule("trigger_dated", _verdict(tr.rlike(DATE)), F.col("kind") == "event-driven"), rule("structural_fence", _verdict((count(tr, "FACT") >= 2) & (count(tr, "INFERENCE") >= 1)), F.col("kind") == "structural"),
        rule("readiness", _verdict(F.col("ready") != "")), rule("sendnow_anchor", _verdict(count(tr, "FACT") >= 1), F.col("ready") == "send now"),
        rule("confidence", _verdict(F.lower(F.regexp_extract("b", r"(?m)^Confidence:\s*([A-Za-z]+)", 1)).isin(list(BANDS)))), rule("fia", _verdict(block.rlike(r"(?i)\[(?:FACT|INFERENCE|ASSUMPTION)\b"))),
        rule("hook_pasteable", _verdict(~F.regexp_replace(F.lower(first), "[^a-z]", "").isin(INSTRUCTIONS), WARN), first != ""),
    )
    of_items = b.select("id", "item", F.explode(items).alias("r")).select("id", "item", "r.*")

    rank = F.coalesce(*[F.when(F.col("band") == k, v) for k, v in BANDS.items()])
    ranked = b.select("id", "item", rank.alias("rank"))
    before = F.lag("rank").over(Window.partitionBy("id").orderBy("item"))
    falls = ranked.where("rank is not null").withColumn("up", F.col("rank") > before).groupBy("id").agg(F.max("up").alias("up"))
    order = ranked.select("id").distinct().join(falls, "id", "left").select("id", F.lit(None).cast("int").alias("item"), F.lit("angle_rank_order").alias("rule"), _verdict(~F.coalesce("up", F.lit(False))).alias("verdict"))
    return of_sheet.unionByName(of_items).unionByName(order).where("verdict is not null")
