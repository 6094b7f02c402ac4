"""Transcribed records against their decks, on the driver tables: suppliers are decks, parts their records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import numbers
from ledgerloom.operators import decks, readback

from .registry import Tables, query

_LO, _HI = numbers.RENT_SQM
_ALO, _AHI = numbers.AREA_SQM


@query(f"""WITH d AS (SELECT s_suppkey AS deck, 'deck ' || s_suppkey AS source, range(0, 2 + (s_suppkey % 7)::INT) AS pages, [s_acctbal, s_suppkey * 100.0, 5000.0] AS vals FROM supplier WHERE s_suppkey % 9 <> 0),
r AS (SELECT p_partkey % 250 AS deck, p_partkey AS record, CASE WHEN p_partkey % 17 <> 0 THEN p_partkey // 250 % 9 END AS page, CASE WHEN p_partkey % 5 <> 0 THEN [p_size % 4, p_partkey // 250 % 8, -(p_partkey % 23 = 0)::INT] END AS image_pages, CASE WHEN p_partkey % 3 = 0 THEN p_size % 9 END AS plan_page, p_partkey % 4 <> 0 AS plan_stated,
  p_size % 3 AS hero, CASE WHEN p_partkey % 6 = 0 THEN p_size % 10 END AS ex, 'deck ' || (p_partkey % 250 + (p_partkey % 19 = 0)::INT) AS source, CASE WHEN p_partkey % 2 = 0 THEN p_size * 8.0 END AS rent, CASE WHEN p_partkey % 8 = 0 THEN 'rent x 12' END AS note,
  p_partkey * 50.0 AS area, CASE WHEN p_partkey % 7 = 0 THEN 95.0 ELSE 45.0 END AS lat, 10.0 AS lng, p_partkey % 29 = 0 AS unreadable FROM part),
j AS (SELECT r.*, d.source AS ds, d.pages, d.vals FROM r LEFT JOIN d USING (deck)), q AS (SELECT * FROM j WHERE NOT unreadable),
n AS (SELECT DISTINCT deck, page FROM j WHERE page >= 0 AND (pages IS NULL OR list_contains(pages, page))),
c AS (SELECT DISTINCT deck, record, p FROM (SELECT deck, record, pages, unnest(image_pages) AS p FROM q) WHERE p >= 0 AND (pages IS NULL OR list_contains(pages, p))),
h AS (SELECT *, min(record) OVER (PARTITION BY deck, p) AS f FROM c)
SELECT deck, record, 'no page' AS rule, NULL AS detail, 'error' AS severity FROM q WHERE page IS NULL
UNION ALL SELECT deck, record, 'page out of deck', page::VARCHAR, 'error' FROM q WHERE NOT list_contains(pages, page)
UNION ALL SELECT deck, record, 'keys not stated', NULL, 'warning' FROM q WHERE len(pages) > 1 AND (image_pages IS NULL OR NOT plan_stated)
UNION ALL SELECT deck, record, 'plan out of deck', plan_page::VARCHAR, 'error' FROM q WHERE NOT list_contains(pages, plan_page)
UNION ALL SELECT deck, record, 'hero on the plan page', page::VARCHAR, 'warning' FROM q WHERE plan_page = page AND coalesce(list_contains(pages, page), TRUE)
UNION ALL SELECT deck, record, 'hero excluded', hero::VARCHAR, 'error' FROM q WHERE ex = page AND hero IN (0, 1)
UNION ALL SELECT deck, record, 'excluded page out of deck', ex::VARCHAR, 'error' FROM q WHERE NOT list_contains(pages, ex)
UNION ALL SELECT deck, record, 'other source', source, 'warning' FROM q WHERE source <> ds
UNION ALL SELECT deck, record, 'rent out of band', rent::DOUBLE::VARCHAR, 'error' FROM q WHERE rent NOT BETWEEN {_LO} AND {_HI}
UNION ALL SELECT deck, record, 'rent of a month', rent::DOUBLE::VARCHAR, 'warning' FROM q WHERE rent BETWEEN {_LO} AND {_HI} AND rent < 15 AND note IS NULL
UNION ALL SELECT deck, record, 'place out of range', NULL, 'error' FROM q WHERE lat > 90
UNION ALL SELECT deck, record, 'rent not in text', rent::DOUBLE::VARCHAR, 'warning' FROM q WHERE rent BETWEEN {_LO} AND {_HI} AND len(list_distinct(vals)) > 1 AND len(list_filter(vals, lambda v: abs(v - rent) <= greatest(0.05, 0.005 * greatest(abs(v), abs(rent))) OR abs(v - rent / 12) <= greatest(0.05, 0.005 * greatest(abs(v), abs(rent / 12))))) = 0
UNION ALL SELECT deck, record, 'area out of band', area::DOUBLE::VARCHAR, 'warning' FROM q WHERE area NOT BETWEEN {_ALO} AND {_AHI}
UNION ALL SELECT deck, record, 'area of the other unit', area::DOUBLE::VARCHAR, 'warning' FROM q WHERE area > {numbers.SUSPECT_SQM}
UNION ALL SELECT deck, record, 'area not in text', area::DOUBLE::VARCHAR, 'warning' FROM q WHERE area BETWEEN 200 AND 2000000 AND len(list_distinct(vals)) > 1 AND len(list_filter(vals, lambda v: abs(v - area) <= greatest(0.05, 0.005 * greatest(abs(v), abs(area))))) = 0
UNION ALL SELECT deck, record, 'image page out of deck', p::VARCHAR, 'error' FROM (SELECT deck, record, pages, unnest(image_pages) AS p FROM q) WHERE p < 0 OR NOT list_contains(pages, p)
UNION ALL SELECT h.deck, record, CASE WHEN n.page IS NOT NULL THEN 'page claimed twice, anchored' ELSE 'page claimed twice' END, p::VARCHAR, 'warning' FROM h LEFT JOIN n ON n.deck = h.deck AND n.page = p WHERE record <> f
UNION ALL SELECT deck, NULL, 'pages without a record', array_to_string(list_sort(bare), ','), 'warning' FROM (SELECT d.deck, list_filter(pages, lambda p: NOT list_contains(coalesce(seen, []), p)) AS bare FROM d LEFT JOIN (SELECT deck, list(page) AS seen FROM n GROUP BY 1) l ON l.deck = d.deck WHERE d.deck IN (SELECT deck FROM r)) WHERE len(bare) > 0
UNION ALL SELECT d.deck, NULL, 'few records', k::VARCHAR, 'warning' FROM d JOIN (SELECT deck, count(*) AS k FROM q GROUP BY 1) USING (deck) WHERE 2 * k < len(pages)""")
def record_findings(t: Tables) -> DataFrame:
    """What transcribed records break: pages, plans, claims, rents, areas and places, each rule a row."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    known = t.supplier.where("s_suppkey % 9 <> 0").select(s.alias("deck"), F.concat(F.lit("deck "), s.cast("string")).alias("source"), F.sequence(F.lit(0), (1 + s % 7).cast("int")).alias("pages"), F.array(F.col("s_acctbal").cast("double"), s * 100.0, F.lit(5000.0)).alias("values"))
    size, number = F.col("p_size").cast("int"), F.floor(k / 250)
    spread = F.array(size % 4, (number % 8).cast("int"), F.when(k % 23 == 0, -1).otherwise(0))
    records = t.part.select(
        (k % 250).alias("deck"), k.alias("record"), F.when(k % 17 != 0, (number % 9).cast("int")).alias("page"), F.when(k % 5 != 0, spread).alias("image_pages"), F.when(k % 3 == 0, size % 9).alias("plan_page"), (k % 4 != 0).alias("plan_stated"),
        (size % 3).alias("hero"), F.when(k % 6 == 0, F.create_map(size % 10, F.array(F.lit(0), F.lit(1)))).alias("excluded"), F.concat(F.lit("deck "), (k % 250 + F.when(k % 19 == 0, 1).otherwise(0)).cast("string")).alias("source"),
        F.when(k % 2 == 0, size * 8.0).alias("rent"), F.lit("€/sq m/yr").alias("rent_unit"), (k * 50.0).alias("area"), F.lit(None).cast("double").alias("plot_area"), F.lit(None).cast("string").alias("area_unit"),
        F.when(k % 7 == 0, 95.0).otherwise(45.0).alias("lat"), F.lit(10.0).alias("lng"), F.when(k % 8 == 0, "rent x 12").alias("note"), (k % 29 == 0).alias("unreadable"),
    )
    return readback.record_findings(records, known.select("deck", "source", "pages"), known.select("deck", "values"))


def _laid_out(t: Tables) -> DataFrame:
    """Conversations as decks: turns are pages with labels that stand alone, inline ones, or neither; some have contents."""
    c, n = F.col("conv_id"), F.col("turn")
    number = F.char_length("text").cast("string")
    alone = F.concat(F.lit("Warehouse area\n"), number, F.lit(" sq m\nStatus:\nCity\n"), F.when(n % 2 == 0, "tbd").otherwise("Brno"), F.lit("\nRent: "), n.cast("string"))
    inline = F.concat(F.lit("Owner: ACME "), c.cast("string"), F.lit("\n Site area : "), number, F.lit("\nnothing\ngla\n"))
    top = F.concat(F.lit("Contents\nPark A"), c.cast("string"), F.lit(" ..... 2\nPark B\t3\nPark C   14\n"))
    first = F.when((n == 0) & (c % 3 == 0), top)
    said = F.coalesce(first, F.when((c + n) % 5 < 2, F.when(c % 2 == 0, alone).otherwise(inline)).when((c + n) % 5 == 2, inline).otherwise(F.regexp_replace("text", "[:\r\x0b\x0c]", " ")))
    return t.conversations.where("text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).select(c.alias("deck"), n.alias("page"), said.alias("text"))


@query("""WITH v AS (SELECT conv_id AS c, turn AS n, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2),
k AS (SELECT c, n, length(text) AS size, CASE WHEN n = 0 AND c % 3 = 0 THEN 'top' WHEN (c + n) % 5 < 2 AND c % 2 = 0 THEN 'alone' WHEN (c + n) % 5 < 3 THEN 'inline' ELSE 'text' END AS kind, trim(text) = '' AS blank FROM v),
f AS (SELECT c, min(n) AS first FROM k WHERE kind <> 'text' OR NOT blank GROUP BY 1), t AS (SELECT k.c FROM k JOIN f ON f.c = k.c AND n = first WHERE kind = 'top'),
a AS (SELECT c, bool_or(kind = 'alone') AS found FROM k GROUP BY 1), u AS (SELECT k.*, found, row_number() OVER (PARTITION BY k.c ORDER BY n) AS i FROM k JOIN a USING (c) WHERE kind = CASE WHEN found THEN 'alone' ELSE 'inline' END)
SELECT u.c AS deck, n AS page, CASE WHEN found AND t.c IS NOT NULL THEN ['Park A' || u.c, 'Park B', 'Park C'][i] END AS park,
  CASE kind WHEN 'alone' THEN CASE WHEN n % 2 = 0 THEN '' ELSE 'city=Brno;' END || 'warehouseArea=' || size || ' sq m;warehouseRent=' || n ELSE 'landlord=ACME ' || u.c || ';plotArea=' || size END AS fields FROM u LEFT JOIN t ON t.c = u.c""")
def deck_records(t: Tables) -> DataFrame:
    """Records of decks: pages with labels of their own, named by the contents page in order, or pages with inline labels."""
    found = decks.deck_records(_laid_out(t))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.select("deck", "page", "park", shown.alias("fields"))
