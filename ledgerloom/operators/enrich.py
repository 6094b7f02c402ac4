"""Enrichment: regions by a cascade, two-pass places, points of interest, routes and aligned units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.geo import haversine_km
from ledgerloom.functions.numbers import area_factor

from .selection import medians


def cascade(df: DataFrame, key: str, steps: list[tuple[str, DataFrame]], out: str) -> DataFrame:
    """The first step (name, table of key and value) that knows the key gives `out` and its name; else null."""
    value, by = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (name, t) in enumerate(steps):
        k, v = t.columns
        df = df.join(t.select(F.col(k).alias(key), F.col(v).alias(f"_s{n}")), key, "left")
        by = F.coalesce(by, F.when(F.col(f"_s{n}").isNotNull(), name))
        value = F.coalesce(value, F.col(f"_s{n}").cast("string"))
    return df.withColumn(out, value).withColumn(f"{out}_by", by).drop(*[f"_s{n}" for n in range(len(steps))])


def dominant_country(located: DataFrame, cc: str, seq: str, km: float = 1000.0) -> DataFrame:
    """One row: the most frequent country of the places within km of the median place (the first seen of several)."""
    lat, lng = (F.lit(m).cast("double") for m in medians(located, ["lat", "lng"]))
    near = located.where(haversine_km(F.col("lat"), F.col("lng"), lat, lng) <= km)
    counted = near.groupBy(cc).agg(F.count("*").alias("n"), F.min(seq).alias("s"))
    return counted.agg(F.max_by(cc, F.struct("n", -F.col("s"))).alias("dominant"))


def two_pass_places(records: DataFrame, seq: str, city: str, country: str, gazetteer: DataFrame) -> DataFrame:
    """Records with lat, lng and how: exact by country or unique name first, then by the dominant country of those."""
    g = gazetteer.withColumn("_same", F.count("*").over(Window.partitionBy("name")))
    base = records.select(*[F.col(c) for c in records.columns])
    first = base.join(g, (F.col(city) == F.col("name")) & (F.col(country).eqNullSafe(F.col("cc")) | (F.col(country).isNull() & (F.col("_same") == 1))), "left").select(*records.columns, "cc", "lat", "lng")
    top = dominant_country(first.where("lat is not null"), "cc", seq)
    again = g.select(F.col("name").alias("_name"), F.col("cc").alias("_cc"), F.col("lat").alias("_lat2"), F.col("lng").alias("_lng2"))
    j = first.crossJoin(F.broadcast(top)).join(again, (F.col(city) == F.col("_name")) & (F.col("dominant") == F.col("_cc")) & F.col(country).isNull(), "left")
    how = F.when(F.col("lat").isNotNull(), "exact").when(F.col("_lat2").isNotNull(), "dominant").otherwise("none")
    return j.select(*records.columns, F.coalesce("lat", "_lat2").alias("lat"), F.coalesce("lng", "_lng2").alias("lng"), how.alias("how"))


def harmonise(df: DataFrame, label: str, code: str, names: DataFrame) -> DataFrame:
    """Where a code's rows state two labels or more, all take the code's own name; the stated one is kept beside it."""
    stated = df.groupBy(code).agg(F.count_distinct(label).alias("_labels"))
    j = df.join(stated, code, "left").join(names.select(F.col(names.columns[0]).alias(code), F.col(names.columns[1]).alias("_name")), code, "left")
    fire = (F.col("_labels") >= 2) & F.col("_name").isNotNull() & ~F.col(label).eqNullSafe(F.col("_name"))
    return j.select(*[c for c in df.columns if c != label], F.when(fire, F.col("_name")).otherwise(F.col(label)).alias(label), F.when(fire, F.col(label)).alias(f"{label}_stated"))


def align_areas(df: DataFrame, value: str, unit: str, dominant: Column) -> DataFrame:
    """Areas in the dominant unit: converted from the unit of their own source, withheld for unknown ones, assumed for none."""
    f = area_factor(F.col(unit), dominant)
    silent = F.col(unit).isNull()
    return df.withColumn("aligned", F.when(silent, F.col(value)).otherwise(F.round(F.col(value) * f, 4))).withColumn("state", F.when(silent, "assumed").when(f.isNull(), "withheld").when(f == 1, "kept").otherwise("converted"))


def total_rent(area: Column, rate: Column, office_area: Column, office_rate: Column) -> Column:
    """Areas by their own rates; the office by the main rate where it has none. Money is counted in decimals, halves up."""
    exact = lambda c: c.cast("decimal(18,4)")
    office = F.coalesce(exact(office_area), F.lit(0))
    return F.round(exact(area) * exact(rate) + office * F.coalesce(exact(office_rate), exact(rate)), 2).cast("double")


def ingest_routes(responses: DataFrame, request: str, body: str, offset: int) -> DataFrame:
    """(request, target, minutes, km) of matrix responses; an error envelope or an unreachable target gives no row."""
    m = F.from_json(body, "durations array<array<double>>, distances array<array<double>>, error string")
    rows = responses.select(request, m.alias("m")).where("m is not null and m.error is null and m.durations is not null")
    each = F.arrays_zip(F.col("m.durations")[0].alias("s"), F.col("m.distances")[0].alias("d"))
    out = rows.select(request, F.posexplode(each).alias("target", "x")).where(F.col("target") >= offset)
    return out.select(request, (F.col("target") - offset).cast("long").alias("target"), F.round(F.col("x.s") / 60).cast("long").alias("minutes"), F.round(F.col("x.d") / 1000, 1).alias("km")).where("minutes is not null")


def merge_members(members: DataFrame, cluster: str, seq: str, fields: list[str]) -> DataFrame:
    """The first member stands for its cluster; a field that members state differently becomes tbd, with the values beside it.

    sources (array of url and tier) are joined, each url once, the first wins.
    """
    known = lambda f: F.when(~F.coalesce(F.lower(F.col(f).cast("string")) == "tbd", F.lit(False)), F.col(f).cast("string"))
    values = {f: F.array_sort(F.collect_set(known(f))) for f in fields}
    w = Window.partitionBy(cluster, "url").orderBy(seq, "pos")
    urls = members.select(cluster, seq, F.posexplode("sources").alias("pos", "s")).select(cluster, seq, "pos", "s.url", "s.tier").withColumn("n", F.row_number().over(w)).where("n = 1")
    joined = urls.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq), F.col("pos"), F.col("url"), F.col("tier")))), lambda x: F.struct(x["url"].alias("url"), x["tier"].alias("tier"))).alias("sources"))
    merged = members.groupBy(cluster).agg(F.min(seq).alias(seq), F.count("*").alias("n_members"), *[v.alias(f"_{f}") for f, v in values.items()])
    shown = [F.when(F.size(f"_{f}") == 1, F.col(f"_{f}")[0]).when(F.size(f"_{f}") > 1, "tbd").alias(f) for f in fields]
    return merged.join(joined, cluster, "left").select(cluster, seq, "n_members", *shown, *[F.when(F.size(f"_{f}") > 1, F.col(f"_{f}")).alias(f"{f}_conflict") for f in fields], "sources")


def sole_claims(claims: DataFrame, place: list[str], owner: str) -> DataFrame:
    """Places (of a file, a page) that one owner alone claims."""
    return claims.groupBy(*place).agg(F.count_distinct(owner).alias("n"), F.min(owner).alias(owner)).where("n = 1").drop("n")


def best_by_signature(items: DataFrame, signature: str, page: str, score: str) -> DataFrame:
    """Equal items once: earliest page and best score, ranked by score, page and signature."""
    g = items.groupBy(signature).agg(F.min(page).alias(page), F.max(score).alias(score))
    return g.orderBy(F.col(score).desc(), page, signature)
