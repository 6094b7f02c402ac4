"""What a run took from its decks against what they hold, which reviews are in, and which fields a reader misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pictures or pages that make a deck rich, pictures that make a card thin, letters of a real review.
RICH_IMAGES, RICH_PAGES, THIN, REAL_REVIEW = 6, 4, 3, 20


def media_findings(claims: DataFrame, decks: DataFrame, cards: DataFrame, acks: DataFrame) -> DataFrame:
    """(card, deck, kind, pages, state): state is signal, note, or blocking unless signed off (acked).

    claims: card, deck, looked (array of pages). decks: deck, pages (number), images, mode, renders. cards: card, gallery
    (number of pictures), has_plan, placeholder. acks: key, value (a deck, a capability, or `all`). Kinds: `under-harvest`
    (one page looked at of a rich deck; a signal where the card is thin), else `no plan, pages unlooked`; for decks
    `no renders` (read as text though it has several pages) and `orphan pages`, that no card looked at.
    """
    looked = claims.select("card", "deck", F.explode_outer("looked").alias("page")).groupBy("card", "deck").agg(F.array_sort(F.collect_set("page")).alias("looked"))
    held = decks.select("deck", F.col("pages").alias("_n"), "images", "mode", "renders")
    j = looked.join(held.where("_n is not null"), "deck").join(cards, "card")
    every = F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array().cast("array<int>"))
    unlooked = F.array_except(every, F.col("looked"))
    plan = F.coalesce("has_plan", F.lit(False))
    under = (F.size("looked") == 1) & ((F.coalesce("images", F.lit(0)) >= RICH_IMAGES) | (F.col("_n") >= RICH_PAGES))
    thin = F.coalesce("placeholder", F.lit(False)) | (F.coalesce("gallery", F.lit(0)) <= THIN) | ~plan
    kind = F.when(under, "under-harvest").when(~plan & (F.size(unlooked) > 0), "no plan, pages unlooked")
    shown = F.when(under, F.col("looked")).otherwise(unlooked)
    listed = lambda a: F.array_join(F.transform(a, lambda p: (p + 1).cast("string")), ",")
    own = j.select("card", "deck", kind.alias("kind"), listed(shown).alias("pages"), F.when(under & ~thin, "note").otherwise("signal").alias("state")).where("kind is not null")
    signed = acks.where("key = 'blind_interpretation_ok'").agg(F.coalesce(F.max(F.lower(F.trim("value")) == "all"), F.lit(False)).alias("_all"), F.collect_set(F.lower(F.trim("value"))).alias("_signed"))
    blind = held.where("mode = 'text' and _n > 1 and coalesce(renders, 0) = 0").crossJoin(F.broadcast(signed))  # signed: one row, what people signed by hand
    acked = F.col("_all") | F.array_contains("_signed", F.lower(F.trim("deck")))
    none = F.lit(None).cast(claims.schema["card"].dataType).alias("card")
    unseen = blind.select(none, "deck", F.lit("no renders").alias("kind"), F.col("_n").cast("string").alias("pages"), F.when(acked, "acked").otherwise("blocking").alias("state"))
    claimed = claims.select("deck", F.explode("looked").alias("page")).groupBy("deck").agg(F.collect_set("page").alias("_claimed"))
    left = F.array_except(every, F.coalesce("_claimed", F.array().cast("array<int>")))
    orphans = held.where("_n is not null").join(claimed, "deck").select(none, "deck", F.lit("orphan pages").alias("kind"), listed(left).alias("pages"), F.lit("signal").alias("state")).where("pages <> ''")
    return own.unionByName(unseen).unionByName(orphans)


def review_defects(required: DataFrame, verdicts: DataFrame, tokens: str, blocking: str) -> DataFrame:
    """(run, gate, defect) for the gates that a run needs (run, gate) and what reviewers left (run, gate, text).

    Missing, a stub below REAL_REVIEW letters, no verdict by any of the tokens (a pattern), or a line `VERDICT:` that the
    blocking pattern finds. Several texts of a gate are judged by the longest.
    """
    one = verdicts.groupBy("run", "gate").agg(F.max_by(F.trim("text"), F.struct(F.length(F.trim("text")), F.col("text"))).alias("said"))
    line = F.regexp_extract("said", r"(?im)^\W*VERDICT\W*:\s*(.+)$", 1)
    defects = F.when(F.col("said").isNull(), F.array(F.lit("missing"))).when(F.length("said") < REAL_REVIEW, F.array(F.lit("stub"))).otherwise(F.array_compact(F.array(F.when(~F.col("said").rlike(tokens), "no verdict"), F.when((line != "") & line.rlike(blocking), "blocking"))))
    return required.distinct().join(one, ["run", "gate"], "left").select("run", "gate", F.explode(defects).alias("defect"))


def field_drift(declared: DataFrame, read: DataFrame, by: list[str], field: str = "field") -> DataFrame:
    """(by, field, side): fields that are declared but not read, and read but not declared."""
    d, r = declared.select(*by, field).distinct(), read.select(*by, field).distinct()
    only = lambda a, b, side: a.exceptAll(b).withColumn("side", F.lit(side))
    return only(d, r, "not read").unionByName(only(r, d, "not declared"))


def gaps_markdown(rows: DataFrame, by: str) -> DataFrame:
    """(by, line, text): for each longlist (number, label, url, direct) its gaps as lines of markdown, in order.

    Counts first, then files that are no direct link, each once with the numbers of its rows, then rows without a link.
    """
    some = F.coalesce(F.trim("url") != "", F.lit(False))
    files = rows.where(some).groupBy(by, "url").agg(F.array_join(F.transform(F.array_sort(F.collect_set("number")), lambda n: n.cast("string")), "+").alias("numbers"), F.min_by("label", "number").alias("label"), F.min("number").alias("first"), F.min("direct").alias("direct"))
    sums = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(~some).alias("bare")).join(files.groupBy(by).agg(F.count("*").alias("files"), F.count_if(F.col("direct")).alias("direct")), by, "left")
    said = lambda name, c: F.concat(F.lit(f"- {name}: **"), F.coalesce(F.col(c), F.lit(0)).cast("string"), F.lit("**"))
    flagged = F.coalesce("files", F.lit(0)) - F.coalesce("direct", F.lit(0))
    head = sums.withColumn("flagged", flagged).select(by, F.posexplode(F.array_compact(F.array(said("Properties", "n"), said("Files", "files"), said("Direct", "direct"), said("Need attention", "flagged"), said("No link", "bare")))).alias("at", "text"), F.lit(0).alias("part"))
    line = lambda df, part, key, text: df.select(by, F.col(key).cast("int").alias("at"), text.alias("text"), F.lit(part).alias("part"))
    odd = line(files.where(~F.col("direct")), 2, "first", F.concat(F.lit("- **No. "), "numbers", F.lit("** "), "label", F.lit(" — "), "url"))
    bare = line(rows.where(~some), 4, "number", F.concat(F.lit("- **No. "), F.col("number").cast("string"), F.lit("** "), "label"))
    titles = [df.select(by).distinct().select(by, F.lit(0).alias("at"), F.lit(t).alias("text"), F.lit(p).alias("part")) for df, t, p in ((odd, "## Not a direct link", 1), (bare, "## No link", 3))]
    out = head
    for part in (odd, bare, *titles):
        out = out.unionByName(part)
    return out.select(by, F.row_number().over(Window.partitionBy(by).orderBy("part", "at", "text")).alias("line"), "text")


def dms_from_text(c: Column) -> Column:
    """(lat, lng) of the first pair of degrees, minutes and seconds with letters of the compass, in either order; null if
    both halves name one axis or the place is not on the globe."""
    half = r"(\d{1,3})\s*[°º]\s*(\d{1,2})\s*['′´]\s*(\d{1,2}(?:[.,]\d+)?)?\s*(?:\"|”|″|'')?\s*([NSEW])"
    pair = rf"(?is){half}[\s,;/]*{half}"
    part = lambda n: F.regexp_extract(c, pair, n)
    seconds = lambda n: F.coalesce(F.replace(part(n), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))
    value = lambda n: (part(n).try_cast("double") + part(n + 1).try_cast("double") / 60 + seconds(n + 2) / 3600) * F.when(F.upper(part(n + 3)).isin("S", "W"), -1).otherwise(1) + 0.0
    north = F.upper(part(4)).isin("N", "S")
    lat, lng = F.when(north, value(1)).otherwise(value(5)), F.when(north, value(5)).otherwise(value(1))
    good = (north != F.upper(part(8)).isin("N", "S")) & lat.between(-90, 90) & lng.between(-180, 180)
    return F.when(good, F.struct(lat.alias("lat"), lng.alias("lng")))
