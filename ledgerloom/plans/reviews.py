"""Facilities, keys, names and reviewed side inputs on the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import facilities
from ledgerloom.operators import review

from .records import _pick, _sql
from .registry import Tables, query


def _maps(options: list[dict[str, str]], key: str) -> Column:
    maps = [F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) for d in options]
    return F.element_at(F.array(*maps), (1 + F.col(key) % len(options)).cast("int"))


_POSTS = [{"barrier": "border_control", "name": "Swiecko (PL/DE)"}, {"barrier": "border_control", "name": "Aduana Norte"}, {"barrier": "border_control", "level": "1"}, {"barrier": "border_control"}, {"barrier": "gate", "name": "x"}, {"barrier": "border_control", "amenity": "customs"}]


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'Swiecko (PL/DE) (Border)' ELSE 'N' || s_nationkey || ' border crossing (Border)' END AS name, CASE WHEN s_suppkey % 6 = 0 THEN 'PL/DE' END AS pair FROM supplier WHERE s_suppkey % 6 IN (0, 3)")
def border_crossings(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", F.concat(F.lit("N"), "s_nationkey").alias("cc"), _maps(_POSTS, "s_suppkey").alias("tags")).where(facilities.is_road_crossing(F.col("tags")))
    return rows.select("s_suppkey", facilities.crossing_name(F.col("tags"), F.col("cc")).alias("name"), facilities.crossing_pair(F.col("tags")).alias("pair"))


_EXPORTS = [
    {"name": "A", "type": "large_airport", "scheduled_service": "yes", "latitude_deg": "50.5", "longitude_deg": "14.25"}, {"name": "Strip", "type": "medium_airport", "scheduled_service": "no", "latitude_deg": "1", "longitude_deg": "1"},
    {"name": "P", "itemtype_id": "port", "lat": "1.5", "lng": "2.5"}, {"name": "Office", "itemtype_id": "operator", "lat": "1", "lng": "2"}, {"TERMINAL_NAME": "T", "LATITUDE": "3", "LONGITUDE": "4"}, {"name": "B", "type": "medium", "restriction": "public", "lat": "5", "lon": "6"}, {"name": "Nowhere", "lat": "x", "lng": "2"},
]


@query(f"""SELECT p_partkey, {_sql(["A", None, "P (Port)", None, "T", "B", None])}[k] AS name, {_sql(["air", None, "port", None, "rail", "air", None])}[k] AS kind, [50.5, NULL, 1.5, NULL, 3, 5, NULL][k]::DOUBLE AS lat, {_sql(["large", None, None, None, None, "medium", None])}[k] AS size
FROM (SELECT p_partkey, (1 + p_partkey % 7)::INT AS k FROM part) WHERE k IN (1, 3, 5, 6)""")
def facility_exports(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", facilities.facility(_maps(_EXPORTS, "p_partkey")).alias("x")).where("x is not null")
    return rows.select("p_partkey", "x.name", "x.kind", "x.lat", "x.size")


@query("SELECT s_suppkey, s_suppkey::DOUBLE AS west, 1.0::DOUBLE AS south, (s_suppkey + CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 9 END)::DOUBLE AS east, CASE WHEN s_suppkey % 2 = 0 THEN 3.0 ELSE 8.0 END::DOUBLE AS north, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS n_polygons FROM supplier")
def region_boxes(t: Tables) -> DataFrame:
    ring = lambda a, b, c, d: F.format_string("[[[%d,%d],[%d,%d],[%d,%d]]]", F.col("s_suppkey") + a, F.lit(b), F.col("s_suppkey") + c, F.lit(b), F.col("s_suppkey") + c, F.lit(d))
    one = F.concat(F.lit('{"type":"Polygon","coordinates":'), ring(0, 1, 2, 3), F.lit("}"))
    two = F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), ring(0, 1, 2, 3), F.lit(","), ring(5, 6, 9, 8), F.lit("]}"))
    b = t.supplier.select("s_suppkey", facilities.boundary(F.when(F.col("s_suppkey") % 2 == 0, one).otherwise(two)).alias("b"))
    return b.select("s_suppkey", *[F.col("b.box")[i].alias(n) for i, n in enumerate(("west", "south", "east", "north"))], F.size("b.polygons").alias("n_polygons"))


_REGIONS = [("East_Midlands", "eastmidlands"), ("Łódź - Płn.", "łodzpłn"), ("São  Paulo", "saopaulo"), ("Straße 7", "strasse7")]


@query(f"SELECT c_custkey, {_sql([x for _, x in _REGIONS])}[(1 + c_custkey % 4)::INT] AS loose, {_sql(['east midlands', 'odz p n', 'sao paulo', 'stra e 7'])}[(1 + c_custkey % 4)::INT] AS said FROM customer")
def separator_free_keys(t: Tables) -> DataFrame:
    name = _pick([x for x, _ in _REGIONS], "c_custkey")
    key = facilities.region_label_key(name, F.lit("pl"), F.lit("x"))
    return t.customer.select("c_custkey", facilities.loose_key(name).alias("loose"), F.split(key, r"\|")[0].alias("said"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'sub/' || l_orderkey ELSE l_orderkey::VARCHAR END AS source, CASE WHEN l_linenumber = 2 OR l_returnflag = 'A' THEN 'Medium' ELSE 'High' END AS confidence FROM lineitem")
def ledger_sources(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    name = F.col("l_orderkey").cast("string")
    return t.lineitem.select("l_orderkey", n, facilities.source_identity(F.when(n % 3 == 0, F.concat(F.lit("sub/"), name)).otherwise(""), name).alias("source"), facilities.ledger_confidence(F.when(n == 2, "page 1 (Vision transcription)"), F.when(F.col("l_returnflag") == "A", "web").otherwise("pdf")).alias("confidence"))


@query("SELECT c_custkey, CASE WHEN c_nationkey <> 0 THEN c_nationkey::VARCHAR END AS known, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS lat, CASE WHEN c_custkey % 2 = 0 THEN 'hgv|' ELSE '' END || c_custkey || ',' || c_nationkey || ';1,2' AS route FROM customer")
def points_and_routes(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    point = facilities.street_point(F.col("c_acctbal"), F.lit(1.0), F.when(k % 3 == 0, "rooftop").otherwise("city"))
    route = facilities.route_key(k % 2 == 0, k, F.col("c_nationkey"), F.lit(1), F.lit(2))
    return t.customer.select("c_custkey", facilities.zero_as_unknown(F.col("c_nationkey").cast("string")).alias("known"), point["lat"].alias("lat"), route.alias("route"))


_RAW = [("a/b: c?.pdf", "a-b- c-.pdf"), ("plan", "plan.jpeg"), ("....", "attachment.jpeg"), ("Unit  1 .docx", "Unit 1.docx")]


@query(f"SELECT s_suppkey, {_sql([x for _, x in _RAW])}[(1 + s_suppkey % 4)::INT] AS file, lpad((s_suppkey % 90)::VARCHAR, 2, '0') || ' - ' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' - AB1' ELSE '' END AS folder FROM supplier")
def safe_names(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select("s_suppkey", facilities.safe_filename(_pick([x for x, _ in _RAW], "s_suppkey"), F.lit("image/jpeg; x=1")).alias("file"), facilities.property_folder(k % 90, F.col("s_name"), F.when(k % 2 == 0, "AB1").otherwise("")).alias("folder"))


@query(f"SELECT s_suppkey, {_sql(['Big Shed', 'Unit 2, Premier Park', 'Unit A, Premier Park', 'tbd', 'Premier Park'])}[(1 + s_suppkey % 5)::INT] AS title FROM supplier")
def display_names(t: Tables) -> DataFrame:
    title = facilities.display_name(_pick(["Big Shed", "Unit 2", "", "", None], "s_suppkey"), _pick(["x", "Premier Park", "Unit A, Premier Park", "", "Premier Park"], "s_suppkey"), F.lit(" "))
    return t.supplier.select("s_suppkey", title.alias("title"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'pass with notes' WHEN o_orderkey % 3 = 0 THEN 'fail' END AS verdict, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 7)::INT END AS rank, o_orderpriority AS title FROM orders")
def verdicts_and_items(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 2 == 0, "VERDICT: FAIL\nmore\n**Verdict:** Pass with notes\nend").when(k % 3 == 0, "said VERDICT: pass\nVERDICT: fail").otherwise("no word")
    item = F.when(k % 5 > 0, F.concat(F.lit("### "), k % 7, F.lit(". "), "o_orderpriority", F.lit(" \nTrigger: x"))).otherwise(F.concat(F.lit("## "), "o_orderpriority", F.lit("\nx")))
    return t.orders.select("o_orderkey", facilities.last_verdict(text).alias("verdict"), facilities.ranked_item(item).alias("i")).select("o_orderkey", "verdict", "i.rank", "i.title")


@query("""WITH r AS (SELECT c_custkey AS id, c_mktsegment AS city, CASE WHEN c_custkey % 3 = 0 THEN '??' ELSE c_nationkey::VARCHAR END AS cc FROM customer), k AS (SELECT c_mktsegment AS city, c_nationkey::VARCHAR AS cc, min(c_custkey) AS seq, arg_min(c_acctbal, c_custkey) AS lat FROM customer WHERE c_custkey % 5 = 0 AND c_nationkey % 2 = 0 GROUP BY 1, 2),
f AS (SELECT city, arg_min(lat, seq) AS lat FROM k GROUP BY 1) SELECT r.id, coalesce(k.lat, CASE WHEN r.cc = '??' THEN f.lat END) AS lat FROM r LEFT JOIN k USING (city, cc) LEFT JOIN f USING (city)""")
def cached_places(t: Tables) -> DataFrame:
    c = t.customer
    records = c.select(F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("town"), F.when(F.col("c_custkey") % 3 == 0, "??").otherwise(F.col("c_nationkey").cast("string")).alias("cc"))
    cache = c.where("c_custkey % 5 = 0 and c_nationkey % 2 = 0").select(F.col("c_mktsegment").alias("city"), F.col("c_nationkey").cast("string").alias("country"), F.col("c_custkey").alias("seq"), F.col("c_acctbal").alias("lat"))
    return review.cached_places(records, "town", "cc", cache, ["lat"]).select("id", "lat")


@query("SELECT 'good' AS side, count(*) AS n FROM nation UNION ALL SELECT 'stale', 0")
def all_or_nothing_labels(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_name").alias("stem"), F.concat(F.lit("R"), "n_regionkey").alias("region"))
    stale = n.withColumn("region", F.when(F.col("stem") == "NATION_3", "misc").otherwise(F.col("region")))
    count = lambda side, df: review.all_or_nothing(df, "stem", "region", ["misc", "final"], n.select("stem")).agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return count("good", n).unionByName(count("stale", stale))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 7 <> 0 AND NOT (l_orderkey % 5 = 0 AND l_linenumber = 2)")
def pages_not_rejected(t: Tables) -> DataFrame:
    deck = lambda c: F.concat(F.lit("Deck "), c, F.lit(".pdf"))
    pages = t.lineitem.select("l_orderkey", "l_linenumber", deck("l_orderkey").alias("file"))
    k = t.orders.select("o_orderkey")
    rejects = k.where("o_orderkey % 7 = 0").select(F.concat(F.lit("in/"), deck("o_orderkey")).alias("entry")).unionByName(k.where("o_orderkey % 5 = 0").select(F.concat(F.upper(deck("o_orderkey")), F.lit("#2")).alias("entry")))
    return review.not_rejected(pages, "file", "l_linenumber", rejects).select("l_orderkey", "l_linenumber")


@query("SELECT user_id AS gate, max(event_id) AS round, arg_max(event_type, event_id) AS text FROM events WHERE event_id <= 500 GROUP BY 1")
def newest_reviews(t: Tables) -> DataFrame:
    return review.newest_review(t.events.select(F.col("user_id").alias("gate"), F.col("event_id").alias("round"), F.col("event_type").alias("text")), "gate", "round", "text", F.lit(500))


@query("SELECT l_suppkey AS source, avg((l_discount < 0.05)::INT) AS poor_share FROM lineitem GROUP BY 1 HAVING avg((l_discount < 0.05)::INT) > 0.45")
def poor_sources(t: Tables) -> DataFrame:
    return review.poor_sources(t.lineitem.withColumnRenamed("l_suppkey", "source"), "source", F.col("l_discount") < 0.05, 0.45)


@query("""WITH a AS (SELECT p_partkey AS col, lower(p_brand) AS field, CASE WHEN p_size > 25 THEN 'gia' END AS basis FROM part), b AS (SELECT p_partkey AS col, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'other' END AS field, CASE WHEN p_size > 30 THEN 'GIA' END AS basis FROM part WHERE p_partkey % 4 > 0),
l AS (SELECT col, 'field' AS key, a.field AS pass1, b.field AS pass2 FROM a LEFT JOIN b USING (col) UNION ALL SELECT col, 'basis', a.basis, b.basis FROM a LEFT JOIN b USING (col)) SELECT * FROM l WHERE lower(pass1) IS DISTINCT FROM lower(pass2)""")
def map_disagreements(t: Tables) -> DataFrame:
    p, size = t.part, F.col("p_size")
    one = p.select(F.col("p_partkey").alias("col"), F.lower("p_brand").alias("field"), F.when(size > 25, "gia").alias("basis"))
    two = p.where("p_partkey % 4 > 0").select(F.col("p_partkey").alias("col"), F.when(size % 2 == 0, F.col("p_brand")).otherwise("other").alias("field"), F.when(size > 30, "GIA").otherwise(" ").alias("basis"))
    return review.map_disagreements(one, two, "col", ["field", "basis"])


@query("""WITH c AS (SELECT l_suppkey AS sheet, l_linenumber AS col, count(*) FILTER (WHERE l_returnflag = 'A') AS pdf, count(*) FILTER (WHERE l_returnflag <> 'R') AS links FROM lineitem GROUP BY 1, 2)
SELECT sheet, CASE WHEN sheet % 3 = 0 THEN 2 WHEN sum(pdf) > 0 THEN arg_max(col, pdf * 100 - col) WHEN sum(links) > 0 THEN arg_max(col, links * 100 - col) END AS col, CASE WHEN sheet % 3 = 0 THEN 'header name' WHEN sum(pdf) > 0 THEN 'most documents' WHEN sum(links) > 0 THEN 'most links' ELSE 'not found' END AS how FROM c GROUP BY 1""")
def brochure_columns(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", "pdf").when(flag == "R", "map").otherwise("other")
    body = t.lineitem.select(F.col("l_suppkey").alias("sheet"), F.lit(5).alias("row"), F.col("l_linenumber").cast("int").alias("col"), F.lit("see").alias("text"), kind.alias("kind"))
    heads = t.supplier.select(F.col("s_suppkey").alias("sheet"), F.lit(1).alias("row"), F.lit(2).alias("col"), F.when(F.col("s_suppkey") % 3 == 0, F.when(F.col("s_suppkey") % 2 == 0, " Brochure ").otherwise("PDF (link)")).otherwise("Area").alias("text"), F.lit(None).cast("string").alias("kind"))
    sheets = body.select("sheet").distinct()
    return review.link_column(body.unionByName(heads.join(sheets, "sheet", "left_semi")), "sheet", ["brochure", "pdf"], 1)


@query("SELECT DISTINCT lower(c_mktsegment) || '|N' || c_nationkey || '|' AS key FROM customer WHERE c_custkey % 4 <> 0 AND c_mktsegment <> 'BUILDING'")
def unresolved_labels(t: Tables) -> DataFrame:
    records = t.customer.select(F.col("c_mktsegment").alias("label"), F.lit("").alias("city"), F.concat(F.lit("n"), "c_nationkey").alias("cc"), (F.col("c_custkey") % 4 == 0).alias("placed"))
    names = t.customer.where("c_mktsegment = 'BUILDING'").select(F.lower("c_mktsegment").alias("name"))
    return review.unresolved_labels(records, "label", "city", "cc", names, F.col("placed")).select("key")


@query("""SELECT source, n::INT AS page FROM (SELECT source, min(doc_id % 12) FILTER (WHERE doc_id % 12 % 3 = 1) AS n FROM documents GROUP BY 1) WHERE n IS NOT NULL""")
def best_blocks(t: Tables) -> DataFrame:
    page = (F.col("doc_id") % 12).cast("int")
    good = F.concat(F.lit("The scheme is located near the port and offers good access. "), F.repeat(F.lit("it has many small doors and a wide yard "), F.lit(3)))
    text = F.when(page % 3 == 1, good).when(page % 3 == 2, F.concat(F.lit("Subject to contract. "), good)).otherwise(F.upper(good))
    return review.best_block(t.documents.select("source", page.alias("page"), text.alias("text")), "source", "page", "text").select("source", "page")


@query("SELECT source, CASE WHEN avg((doc_id % 3 > 0)::INT) >= 0.5 THEN 'text' ELSE 'raster' END AS mode FROM documents GROUP BY 1")
def deck_modes(t: Tables) -> DataFrame:
    return review.deck_modes(t.documents.select("source", F.when(F.col("doc_id") % 3 > 0, F.repeat(F.lit("word "), F.lit(20))).otherwise("short").alias("page")), "source", "page")


@query("SELECT c_custkey, f.field, f.value, 'round trip' AS note, 'Medium' AS confidence FROM (SELECT c_custkey, unnest(CASE WHEN c_custkey % 2 = 0 THEN [{'field': 'city', 'value': c_mktsegment}, {'field': 'status', 'value': 'x'}] ELSE [{'field': 'status', 'value': 'x'}] END) AS f FROM customer)")
def repair_rows(t: Tables) -> DataFrame:
    changed = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("city"), "c_mktsegment", F.lit("status"), F.lit("x"))).otherwise(F.create_map(F.lit("status"), F.lit("x")))
    return review.repair_rows(t.customer.select("c_custkey", changed.alias("set"), F.lit("round trip").alias("why")), "c_custkey", "set", "why")


@query("""WITH c AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS said, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT n_name AS answer, 'missing' AS problem FROM nation WHERE n_name NOT IN (SELECT said FROM c) UNION ALL SELECT DISTINCT x, 'unknown' FROM (SELECT said AS x FROM c UNION ALL SELECT c_mktsegment FROM c) WHERE x NOT IN (SELECT n_name FROM nation)""")
def answer_gaps(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_name").alias("answer"))
    said = F.when(F.col("n_nationkey") % 3 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    cells = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.array(said, "c_mktsegment").alias("answers"))
    return review.answer_gaps(cells, "answers", n)


@query("""WITH c AS (SELECT l_orderkey AS slide, l_linenumber % 3 AS k, l_quantity > 25 AS long, l_returnflag = 'N' AS claimed FROM lineitem)
SELECT slide, 'short prose' AS problem FROM c WHERE k = 0 AND NOT long UNION ALL SELECT slide, 'no claim' FROM c WHERE k IN (0, 1) AND NOT claimed UNION ALL SELECT slide, 'no content' FROM c GROUP BY 1 HAVING max((k < 2)::INT) = 0""")
def cell_defects(t: Tables) -> DataFrame:
    k = F.col("l_linenumber") % 3
    text = F.when(F.col("l_quantity") > 25, F.repeat(F.lit("whole words "), F.lit(8))).otherwise("too short")
    cells = t.lineitem.select(F.col("l_orderkey").alias("slide"), F.when(k == 0, "prose").when(k == 1, "stat").otherwise("table").alias("kind"), F.when(k < 2, text).otherwise(" ").alias("text"), F.when(F.col("l_returnflag") == "N", F.array(F.lit("c1"))).alias("claims"))
    return review.cell_defects(cells, "slide", "kind", "text", "claims")


@query("SELECT l_orderkey AS sheet, count(*) AS n_cells, sha1(string_agg('001:' || lpad(l_linenumber::VARCHAR, 4, '0') || ':' || l_linestatus, chr(10) ORDER BY l_linenumber, l_linestatus)) AS structure FROM lineitem WHERE l_linenumber < 7 GROUP BY 1")
def sheet_structures(t: Tables) -> DataFrame:
    row = F.when(F.col("l_linenumber") < 7, 1).otherwise(40)
    return review.sheet_structure(t.lineitem.select(F.col("l_orderkey").alias("sheet"), row.alias("row"), F.col("l_linenumber").alias("col"), F.col("l_linestatus").alias("text")), "sheet")


@query("""WITH f AS (SELECT 'f' || s_nationkey || '.pdf' AS name, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'd' || (s_suppkey % 10) || '/' END || 'f' || s_nationkey || '.pdf' AS relpath FROM supplier)
SELECT name, coalesce(min(relpath) FILTER (WHERE NOT contains(relpath, '/')), min(relpath)) AS relpath, count(*) AS n FROM f WHERE name IN (SELECT 'f' || n_nationkey || '.pdf' FROM nation WHERE n_regionkey < 3) GROUP BY 1""")
def resolve_names(t: Tables) -> DataFrame:
    name = lambda c: F.concat(F.lit("f"), c, F.lit(".pdf"))
    k = F.col("s_suppkey")
    files = t.supplier.select(F.concat(F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("d"), k % 10, F.lit("/"))), name("s_nationkey")).alias("relpath"))
    return review.resolve_names(files, t.nation.where("n_regionkey < 3").select(name("n_nationkey").alias("name")))


@query("SELECT bool_or(c_acctbal < 0 OR c_custkey <= 3) AS chase FROM customer")
def anything_to_chase(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("core", F.when(F.col("c_custkey") > 3, F.col("c_name")))
    return review.anything_to_chase(rows, F.col("c_acctbal") < 0, F.lit(False), ["core"])
