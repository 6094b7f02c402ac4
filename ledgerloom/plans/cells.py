"""Cells of listings and pairs of areas on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import cells

from .registry import Tables, query

_UNITS = ["sq ft", "sq m", "", "acres", "SQ FT "]


@query("""WITH p AS (SELECT p_partkey AS k, p_size * 1000 AS area, ['sq ft', 'sq m', '', 'acres', 'sq ft'][(1 + p_partkey % 5)::INT] AS unit, p_partkey % 13 = 0 AS span FROM part),
j AS (SELECT a.k, NOT a.span AND NOT b.span AS known, a.area AS x, b.area AS y, a.unit AS u, b.unit AS v FROM p a JOIN p b ON b.k = a.k + 1 + a.k % 3),
c AS (SELECT k, x, CASE WHEN u = v THEN y::DOUBLE WHEN u = 'sq ft' AND v = 'sq m' THEN y * 10.7639::DOUBLE WHEN u = 'sq m' AND v = 'sq ft' THEN y / 10.7639::DOUBLE END AS y, known FROM j)
SELECT k, CASE WHEN known AND y IS NOT NULL THEN x::DOUBLE END AS a, CASE WHEN known THEN round(y, 6) END AS b FROM c""")
def areas_on_one_footing(t: Tables) -> DataFrame:
    """Areas of parts and of a later neighbour on one footing; ranges and unlike units can't be compared."""
    k = F.col("p_partkey")
    said = F.when(k % 13 == 0, "25,000 - 50,000").otherwise(F.concat(F.format_number(F.col("p_size") * 1000, 0), F.lit(" in all")))
    p = t.part.select(k.alias("k"), said.alias("area"), F.element_at(F.array(*map(F.lit, _UNITS)), (1 + k % 5).cast("int")).alias("unit"))
    after = p.select((F.col("k")).alias("_k"), F.col("area").alias("_area"), F.col("unit").alias("_unit"))
    j = p.withColumn("_k", F.col("k") + 1 + F.col("k") % 3).join(after, "_k")
    x = cells.on_one_footing(F.col("area"), F.col("unit"), F.col("_area"), F.col("_unit"))
    return j.select("k", x.alias("x")).select("k", "x.a", F.round("x.b", 6).alias("b"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS rent, CASE WHEN s_suppkey % 3 <> 0 THEN CASE WHEN s_suppkey % 4 = 0 THEN 'POA' ELSE 'On application' END END AS said,
array_to_string(list_filter([CASE WHEN s_suppkey % 5 <> 0 THEN 'Org' END, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END], lambda x: x IS NOT NULL), ' – ') AS agent,
array_to_string(list_filter([CASE WHEN s_suppkey % 7 <> 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'm' ELSE 't' END || s_suppkey END, CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0 THEN 'e@x' END], lambda x: x IS NOT NULL), ' / ') AS contact,
array_to_string(list_filter([CASE WHEN s_suppkey % 2 = 0 THEN 'line' END, 'town'], lambda x: x IS NOT NULL), ', ') AS street FROM supplier""")
def listing_cells(t: Tables) -> DataFrame:
    """Rent, agent, contact and street of listings as an export shows them."""
    s = F.col("s_suppkey")
    agent = F.struct(F.col("s_name").alias("name"), F.concat(F.lit("t"), s.cast("string")).alias("tel"), F.when(s % 2 == 0, F.concat(F.lit("m"), s.cast("string"))).otherwise("").alias("mobile"), F.when(s % 11 != 0, "e@x").alias("email"))
    agents = F.when(s % 7 != 0, F.array(agent, agent))
    rent = cells.rent_cell(F.when(s % 3 == 0, F.col("s_acctbal")), F.when(s % 4 == 0, "POA").otherwise(""))
    return t.supplier.select(
        "s_suppkey", rent["value"].alias("rent"), rent["text"].alias("said"), cells.agent_cell(F.when(s % 5 != 0, "Org"), agents).alias("agent"), cells.contact_cell(agents).alias("contact"),
        cells.street_cell(F.when(s % 2 == 0, "line"), F.lit(""), F.lit("town")).alias("street"),
    )
