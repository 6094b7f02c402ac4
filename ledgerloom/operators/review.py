"""Side inputs under review: caches, rejections, verdicts, column maps, blocks of prose and what is still unresolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.facilities import PAGE_CHARS, TEXT_SHARE, region_label_key

#: Words of descriptions and of legal notes.
GOOD = r"(?i)\b(?:located|situated|location|comprises?|offers?|prominent|established|prime|development|warehouse|logistics|distribution|industrial|unit|scheme|access|connectivity|motorway|strategically|position(?:ed)?|accommodation|central|specification|sustainab|BREEAM|delivers?|providing|benefit|reach|hub|catchment|transport)\b"
BAD = r"(?i)misrepresentation|every care has been taken|measurements|\bapproximate\b|\bVAT\b|legal costs|anti-money|money laundering|subject to contract|satisfy themselves|expressly excluded|repairing and insuring|please contact|all parties|business rates|particulars are set out|to be agreed"


def cached_places(records: DataFrame, city: str, country: str, cache: DataFrame, at: list[str]) -> DataFrame:
    """records with the cached columns `at`: of the same city and country; a record of unknown country takes the city's first.

    cache: (city, country, seq, *at). A known country never takes another country's place.
    """
    key = lambda c: F.lower(F.trim(c))
    unknown = F.coalesce(F.trim(F.col(country)).isin("", "??", "tbd"), F.lit(True))
    exact = cache.groupBy(key(F.col("city")).alias("_city"), key(F.col("country")).alias("_cc")).agg(F.min_by(F.struct(*at), "seq").alias("_hit"))
    first = exact.join(cache.groupBy(key(F.col("city")).alias("_city")).agg(F.min_by(key(F.col("country")), "seq").alias("_cc")), ["_city", "_cc"]).select("_city", F.col("_hit").alias("_any"))
    keyed = records.withColumn("_city", key(F.col(city))).withColumn("_cc", key(F.coalesce(F.col(country), F.lit(""))))
    found = keyed.join(exact, ["_city", "_cc"], "left").join(first, "_city", "left").withColumn("_hit", F.coalesce("_hit", F.when(unknown, F.col("_any"))))
    return found.select(*records.columns, *[F.col("_hit")[c].alias(c) for c in at])


def all_or_nothing(labels: DataFrame, stem: str, region: str, noise: list[str], known: DataFrame) -> DataFrame:
    """labels if each names a known stem and a real region; else none of them."""
    judged = labels.join(known.select(F.col(stem).alias("_known")).distinct(), labels[stem] == F.col("_known"), "left")
    bad = F.col("_known").isNull() | F.coalesce(F.lower(F.trim(F.col(region))).isin("", *noise), F.lit(True))
    return labels if judged.where(bad).isEmpty() else labels.limit(0)


def not_rejected(pages: DataFrame, file: str, page: str, rejects: DataFrame) -> DataFrame:
    """pages without those rejected by file or by `file#page`; rejects: one column `entry`."""
    base = lambda c: F.trim(F.lower(F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1)))
    entries = rejects.select(base(F.col("entry")).alias("_entry")).distinct()
    name = base(F.col(file))
    kept = pages.withColumn("_name", name).join(entries, F.col("_name") == F.col("_entry"), "left_anti")
    return kept.withColumn("_name", F.concat_ws("#", "_name", F.col(page).cast("string"))).join(entries, F.col("_name") == F.col("_entry"), "left_anti").drop("_name")


def newest_review(reviews: DataFrame, gate: str, round_: str, text: str, upto: Column) -> DataFrame:
    """(gate, round, text): each gate's newest review at or below a round."""
    return reviews.where(F.col(round_) <= upto).groupBy(gate).agg(F.max(round_).alias(round_), F.max_by(text, round_).alias(text))


def poor_sources(records: DataFrame, source: str, poor: Column, most: float = 0.5) -> DataFrame:
    """Sources of which more than a share of the records parsed poorly."""
    return records.groupBy(source).agg(F.avg(F.coalesce(poor, F.lit(True)).cast("int")).alias("poor_share")).where(F.col("poor_share") > most)


def map_disagreements(first: DataFrame, second: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """(at, key, pass1, pass2) where two column maps differ, case aside; a column that one lacks differs in all it says."""
    long = lambda df, out: df.select(at, F.explode(F.map_filter(F.create_map(*[x for k in keys for x in (F.lit(k), F.nullif(F.trim(F.col(k)), F.lit("")))]), lambda k, v: v.isNotNull())).alias("key", out))
    both = long(first, "pass1").join(long(second, "pass2"), [at, "key"], "full")
    return both.where(~F.lower("pass1").eqNullSafe(F.lower("pass2"))).select(at, "key", "pass1", "pass2")


def link_column(cells: DataFrame, sheet: str, headers: list[str], header_row: int) -> DataFrame:
    """(sheet, col, how): each sheet's column of documents; cells: (sheet, row, col, text, kind), kind pdf, map, other or null.

    A header in `headers` counts first (exactly, then as a beginning), then most links to documents, then most links.
    """
    name = F.lower(F.trim("text"))
    top = F.col("row") == header_row
    linked = (F.col("row") > header_row) & F.col("kind").isNotNull() & (F.col("kind") != "map")
    exact = F.array_position(F.array(*map(F.lit, headers)), name)
    begins = F.coalesce(*[F.when(name.startswith(h), n) for n, h in enumerate(headers, 1)], F.lit(0))
    by = cells.groupBy(sheet, "col").agg(F.max(F.when(top, exact)).alias("exact"), F.max(F.when(top, begins)).alias("begins"), F.count_if(linked & (F.col("kind") == "pdf")).alias("pdf"), F.count_if(linked).alias("links"))
    rank = lambda level, strength: F.struct(F.lit(level).alias("level"), strength.cast("long").alias("strength"), F.col("col"))
    order = F.when(F.col("exact") > 0, rank(1, F.col("exact"))).when(F.col("begins") > 0, rank(2, F.col("begins"))).when(F.col("pdf") > 0, rank(3, -F.col("pdf"))).when(F.col("links") > 0, rank(4, -F.col("links")))
    best = by.withColumn("_rank", order).groupBy(sheet).agg(F.min("_rank").alias("r"))
    how = F.when(F.col("r.level") <= 2, "header name").when(F.col("r.level") == 3, "most documents").when(F.col("r.level") == 4, "most links").otherwise("not found")
    return best.select(sheet, F.col("r.col").alias("col"), how.alias("how"))


def unresolved_labels(records: DataFrame, label: str, city: str, country: str, names: DataFrame, located: Column) -> DataFrame:
    """Distinct labels that no name of an area resolves, whose city doesn't either and that have no place of their own."""
    known = names.select(F.lower(F.trim("name")).alias("_n")).distinct()
    open_ = records.where(~F.coalesce(located, F.lit(False)) & F.col(label).isNotNull() & (F.trim(label) != ""))
    for c in (label, city):
        open_ = open_.join(known, F.lower(F.trim(open_[c])) == known["_n"], "left_anti")
    key = region_label_key(F.col(label), F.col(country), F.col(city))
    return open_.groupBy(key.alias("key")).agg(F.min(F.struct(label, city, country)).alias("x")).select("key", "x.*")


def best_block(blocks: DataFrame, source: str, page: str, text: str) -> DataFrame:
    """(source, page, text): each source's best block of prose; ties go to the earlier page."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    lower = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Ll}"))) / F.greatest(F.size(words), F.lit(1))
    prose = (F.char_length(text) >= 120) & F.col(text).contains(". ") & ~F.col(text).rlike(BAD) & (lower >= 0.5)
    score = F.char_length(text) + F.when(F.col(text).rlike(GOOD), 300).otherwise(0) + F.greatest(F.lit(0), 10 - F.col(page)) * 25
    return blocks.where(prose).groupBy(source).agg(F.max_by(F.struct(page, text), F.struct(score, -F.col(page))).alias("x")).select(source, "x.*")


def deck_modes(pages: DataFrame, source: str, text: str) -> DataFrame:
    """(source, mode): text where enough pages hold enough characters, else raster."""
    holds = F.char_length(F.trim(F.coalesce(F.col(text), F.lit("")))) >= PAGE_CHARS
    return pages.groupBy(source).agg(F.when(F.avg(holds.cast("int")) >= TEXT_SHARE, "text").otherwise("raster").alias("mode"))


def repair_rows(repairs: DataFrame, key: str, changed: str, reason: str) -> DataFrame:
    """One ledger row for each field that a repair sets; changed: a map of field to value."""
    return repairs.select(key, F.explode(changed).alias("field", "value"), F.col(reason).alias("note"), F.lit("Medium").alias("confidence"))


def answer_gaps(cells: DataFrame, answers: str, required: DataFrame) -> DataFrame:
    """(answer, problem): required answers that no cell gives, and tags that are no answer; required: one column `answer`."""
    given = cells.select(F.explode(answers).alias("answer")).distinct()
    return required.join(given, "answer", "left_anti").withColumn("problem", F.lit("missing")).unionByName(given.join(required, "answer", "left_anti").withColumn("problem", F.lit("unknown")))


def cell_defects(cells: DataFrame, slide: str, kind: str, text: str, claims: str) -> DataFrame:
    """(slide, problem) of content cells: empty slides, prose too short to say anything, judgements without a claim."""
    filled = F.trim(F.coalesce(F.col(text), F.lit(""))) != ""
    content = F.col(kind).isin("prose", "stat", "list", "table", "panel", "quote") & filled
    found = F.array_compact(F.array(F.when((F.col(kind) == "prose") & (F.char_length(F.trim(F.coalesce(F.col(text), F.lit("")))) < 60), "short prose"), F.when(F.col(kind).isin("prose", "stat", "quote") & filled & (F.coalesce(F.size(claims), F.lit(0)) <= 0), "no claim")))
    empty = cells.groupBy(slide).agg(F.bool_or(content).alias("some")).where("not some").select(slide, F.lit("no content").alias("problem"))
    return cells.select(slide, F.explode(found).alias("problem")).unionByName(empty)


def sheet_structure(cells: DataFrame, sheet: str, rows: int = 12) -> DataFrame:
    """(sheet, n_cells, structure): a hash of the header and first rows; equal for sheets laid out and filled alike."""
    some = cells.where(F.col("row").between(0, rows)).withColumn("_c", F.concat_ws(":", F.lpad(F.col("row").cast("string"), 3, "0"), F.lpad(F.col("col").cast("string"), 4, "0"), "text"))
    return some.groupBy(sheet).agg(F.count("*").alias("n_cells"), F.sha1(F.array_join(F.array_sort(F.collect_list("_c")), "\n").cast("binary")).alias("structure"))


def resolve_names(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, relpath, n): the file of each wanted name, by equality; one at the top comes first, then by path. files: relpath."""
    base = files.select("relpath", F.substring_index("relpath", "/", -1).alias("name"))
    order = F.struct(F.contains("relpath", F.lit("/")), "relpath")
    return base.join(wanted.select("name").distinct(), "name").groupBy("name").agg(F.min_by("relpath", order).alias("relpath"), F.count("*").alias("n"))


def anything_to_chase(rows: DataFrame, gap: Column, conflict: Column, core: list[str]) -> DataFrame:
    """One row: whether anything is left to chase."""
    open_ = gap | conflict | F.exists(F.array(*[F.col(c).isNull() for c in core]), lambda x: x)
    return rows.agg(F.coalesce(F.bool_or(open_), F.lit(False)).alias("chase"))
