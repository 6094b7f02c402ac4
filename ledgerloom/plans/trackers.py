"""Tracker sheets on the driver tables: orders are sheets, their lines are columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import headers

from .registry import Tables, query

#: Spellings of headers as clients write them.
_SAID = [
    "Park", "Marketing Name ", "Developer", "Developer (verified)", "Owner", "City", "City notes", "Town / City", "Country", "Warehouse  Area (sq m)", "Size", "Unit size", "Land area", "Office area",
    "Asking rent (EUR / month)", "Rent free period", "Rent", "Service charge", "Land price", "Land price psf", "Status", "Statuz", "Availability date", "Eaves (m)", "Eaves 10m or above?", "Floor loading kN",
    "Docks", "Total docks", "Dock level doors", "Level access", "Power supply kVA", "EV charging power", "EPC rating", "BREEAM / EPC", "Motorway", "Brochure link", "Lat, Long", "Latitude", "Longitud", "Remarks", "Contact", "carparking", "Solus / park",
]
_LIST = "[" + ", ".join("'" + x + "'" for x in _SAID) + "]"
_AT = "(l_orderkey * 7 + l_linenumber * 11 + l_suppkey) % {n}"
_NAMES = ", ".join(f"({k}, '{f}', {i}, '{n}')" for k, (f, own) in enumerate(headers.FIELDS.items()) for i, n in enumerate(own))
_BARRED = "CASE field " + " ".join(f"WHEN '{f}' THEN regexp_matches(h, '{p}')" for f, p in headers.NEVER.items()) + " ELSE FALSE END"
_HEADERS = f"""s AS (SELECT l_orderkey AS sheet, l_linenumber AS col, min({_LIST}[(1 + {_AT.format(n=len(_SAID))})::INT]) AS header FROM lineitem GROUP BY 1, 2),
a(k, field, i, name) AS (VALUES {_NAMES}), u AS (SELECT DISTINCT header, lower(trim(regexp_replace(header, '\\s+', ' ', 'g'))) AS h FROM s),
t AS (SELECT header, k, field, i, length(name) / length(h)::DOUBLE AS part, CASE WHEN h = name THEN 3 WHEN regexp_matches(h, '(^|[^a-z0-9])' || replace(name, '/', '\\/') || '([^a-z0-9]|$)') THEN 2
  WHEN 100 * (2 * levenshtein(h, name) - abs(length(h) - length(name))) <= 10 * (length(h) + length(name)) THEN 1 END AS tier FROM u, a WHERE NOT {_BARRED}),
b AS (SELECT header, field, tier, CASE tier WHEN 3 THEN 1.0 ELSE part END AS coverage, i FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY header ORDER BY tier DESC, CASE tier WHEN 3 THEN 1.0 ELSE part END DESC, i, k) = 1)"""


#: The rules alone, for sheets made otherwise.
_RULES = _HEADERS[_HEADERS.index("a(k, field") :]


def _headers(t: Tables) -> DataFrame:
    number = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 11 + F.col("l_suppkey")) % len(_SAID)
    said = F.element_at(F.array(*map(F.lit, _SAID)), (1 + number).cast("int"))
    return t.lineitem.groupBy(F.lit("book").alias("path"), F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("col")).agg(F.min(said).alias("header"))


@query(f"""WITH {_HEADERS} SELECT sheet, col, s.header, field, tier, round(coverage, 6) AS coverage, CASE WHEN field IS NOT NULL THEN row_number() OVER (PARTITION BY sheet, field ORDER BY tier DESC, coverage DESC, i, col) END AS rank FROM s LEFT JOIN b USING (header)""")
def header_bindings(t: Tables) -> DataFrame:
    """Which field each column of a sheet is, how well it fits, and its rank among the field's columns."""
    return headers.bind_columns(_headers(t)).select("sheet", "col", "header", "field", "tier", F.round("coverage", 6).alias("coverage"), "rank")


_TOLD = "SELECT sheet, col, ['rent', 'city', 'epc', 'electricity', 'warehouseArea'][(1 + (sheet + col) % 5)::INT] AS told FROM s WHERE (sheet + col) % 4 = 0"


def _told(t: Tables) -> DataFrame:
    names = ["rent", "city", "epc", "electricity", "warehouseArea"]
    rows = _headers(t).where((F.col("sheet") + F.col("col")) % 4 == 0)
    return rows.select("path", "sheet", "col", F.element_at(F.array(*map(F.lit, names)), (1 + (F.col("sheet") + F.col("col")) % 5).cast("int")).alias("field"))


@query(f"""WITH {_HEADERS}, o AS ({_TOLD}), c AS (SELECT sheet, col, s.header, told AS field, told, b.field AS named, lower(trim(regexp_replace(s.header, '\\s+', ' ', 'g'))) AS h FROM s JOIN o USING (sheet, col) LEFT JOIN b USING (header))
SELECT sheet, col, header, told, named, verdict FROM (SELECT *, CASE WHEN told = 'rent' THEN 'unknown field' WHEN {_BARRED} THEN 'barred' WHEN told IS DISTINCT FROM named THEN 'differs' END AS verdict FROM c) WHERE verdict IS NOT NULL""")
def header_map_conflicts(t: Tables) -> DataFrame:
    """Where a map given by other means names another field than the header, one that the header bars, or none there is."""
    return headers.map_conflicts(_headers(t), _told(t)).select("sheet", "col", "header", "told", "named", "verdict")


def _cells(t: Tables) -> DataFrame:
    """Twenty lines make a sheet: headers from the first one's numbers, values from each line's."""
    k = F.col("l_orderkey")
    sheet, row = F.floor(k / 20).alias("sheet"), (1 + k % 20).cast("int").alias("row")
    lines = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("col")).agg(F.min("l_quantity").cast("int").alias("q"))
    said = F.when(F.col("q") % 9 == 0, "0").when(F.col("q") % 7 == 0, "tbd").otherwise(F.concat(F.col("q").cast("string"), F.lit(" x")))
    values = lines.select(sheet, row, "col", said.alias("text"))
    tops = values.groupBy("sheet", "col").agg(F.min("row").alias("n"))
    name = F.element_at(F.array(*map(F.lit, _SAID)), (1 + (F.col("sheet") * 5 + F.col("col") * 11) % len(_SAID)).cast("int"))
    return values.unionByName(tops.select("sheet", F.lit(0).alias("row"), "col", name.alias("text"))).select(F.lit("book").alias("path"), "sheet", "row", "col", "text")


@query(f"""WITH l AS (SELECT l_orderkey // 20 AS sheet, 1 + l_orderkey % 20 AS row, l_linenumber AS col, min(l_quantity)::INT AS q FROM lineitem GROUP BY 1, 2, 3), v AS (SELECT sheet, row, col, CASE WHEN q % 9 = 0 THEN '0' WHEN q % 7 = 0 THEN 'tbd' ELSE q || ' x' END AS text FROM l),
s AS (SELECT DISTINCT sheet, col, {_LIST}[(1 + (sheet * 5 + col * 11) % {len(_SAID)})::INT] AS header FROM v), {_RULES},
m AS (SELECT sheet, col, header, field, row_number() OVER (PARTITION BY sheet, field ORDER BY tier DESC, coverage DESC, i, col) AS rank FROM s JOIN b USING (header)), n AS (SELECT sheet FROM m GROUP BY 1 HAVING count(DISTINCT field) >= 3),
x AS (SELECT v.*, field, rank FROM v JOIN m USING (sheet, col) JOIN n USING (sheet) WHERE text <> 'tbd' AND NOT (text = '0' AND field IN ({', '.join("'" + f + "'" for f in headers.ZERO_IS_UNKNOWN)}))),
w AS (SELECT sheet, row, field, arg_min(text, rank) AS value, arg_min(col, rank) AS col FROM x GROUP BY 1, 2, 3) SELECT * FROM w WHERE field <> 'latlng' QUALIFY count(*) OVER (PARTITION BY sheet, row) >= 2""")
def tracker_values(t: Tables) -> DataFrame:
    """Values of tracker sheets: each field's first known cell by how well its columns fit."""
    return headers.read_trackers(_cells(t)).select("sheet", "row", "field", "value", "col")


@query(f"""WITH l AS (SELECT DISTINCT l_orderkey // 20 AS sheet, l_linenumber AS col FROM lineitem), s AS (SELECT sheet, col, {_LIST}[(1 + (sheet * 5 + col * 11) % {len(_SAID)})::INT] AS header FROM l), {_RULES}
SELECT sheet, count(*) AS populated, count(field) AS mapped, count(DISTINCT field) >= 8 AS rich, coalesce(string_agg(DISTINCT header, '; ' ORDER BY header) FILTER (WHERE field IS NULL), '') AS unmapped FROM s LEFT JOIN b USING (header) GROUP BY 1 HAVING count(DISTINCT field) >= 3""")
def tracker_reports(t: Tables) -> DataFrame:
    """How much of each sheet its headers explain."""
    return headers.header_report(_cells(t)).select("sheet", "populated", "mapped", "rich", F.array_join("unmapped", "; ").alias("unmapped"))
