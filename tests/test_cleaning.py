import datetime

from pyspark.sql import functions as F

from ledgerloom.functions import cleaning, numbers, text, unknown

SCHEMA = "a string, b string"


def each(spark, f, rows, schema=SCHEMA):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).repartition(2)
    out = d.select("i", f(*[F.col(c) for c in d.columns[1:]]).alias("x")).orderBy("i").collect()
    return [tuple(r.x) if isinstance(r.x, tuple) else r.x for r in out]


def test_certificates(spark):
    rows = [("Excellent", "A+"), ("EPC B", "tbd"), ("EPC B", "C"), ("tbd", "BREEAM Very Good"), ("Good", "Excellent"), (None, None)]
    assert each(spark, cleaning.route_certificates, rows) == [("Excellent", "A+", None), (None, "B", None), (None, "C", "B"), ("BREEAM Very Good", None, None), ("Good", None, "Excellent"), (None, None, None)]
    assert each(spark, lambda a, b: cleaning.grade_core(a).isin(cleaning.GRADES), [("Very Good (2018)", ""), ("B", ""), (None, "")]) == [True, False, False]


def test_small_repairs(spark):
    assert each(spark, cleaning.extract_postcode, [("Unit 1, Corby nn17 4xd", "United Kingdom"), ("Str. 5, 12345 Berlin", "Germany"), ("ul. X 00-950", "Poland"), (None, None)]) == ["NN174XD", "12345", "00-950", ""]
    assert each(spark, lambda a, b: cleaning.normalize_lang(a), [("Deutsch", ""), ("en-GB", ""), ("xx", "")]) == ["de", "en", "xx"]
    assert each(spark, cleaning.pair_id, [("x", "y"), ("y", "x")])[0] == each(spark, cleaning.pair_id, [("y", "x")])[0]
    assert each(spark, cleaning.filetime, [(133_500_000_000_000_000,)], "a long") == [datetime.datetime(2024, 1, 17, 21, 20)]
    assert each(spark, lambda a, b: cleaning.listed_rent(a.try_cast("double"), b), [("8.5", "x"), (None, "POA"), (None, "offers")]) == ["£8.50 psf", None, "offers"]
    ladder = each(spark, lambda a, b: cleaning.query_ladder(a, F.lit("1234"), b, F.lit("")), [("S 1", "Town"), (None, "town")])
    assert [[tuple(x) for x in r] for r in ladder] == [[("S 1, 1234, Town", "street"), ("1234, Town", "city"), ("Town", "city")], [("1234, town", "city"), ("town", "city")]]


def test_headers(spark):
    aliases = {"warehouseArea": ["area", "warehouse area", "gla"], "officeArea": ["office area"], "city": ["city", "town"]}
    pick = lambda a, b: cleaning.header_field(a, aliases, {"warehouseArea": "office|plot"})
    assert each(spark, pick, [(" Warehouse  Area", ""), ("Office area (sq m)", ""), ("Total GLA, sq ft", ""), ("Plot area", ""), ("Nearest town", "")]) == ["warehouseArea", "officeArea", "warehouseArea", None, "city"]


def test_extra_keys(spark):
    d = spark.createDataFrame([({"odd": "[1]", "note": "text", "ref": "page 3 (map)", "city": "x"},)], "e map<string,string>")
    x = d.select(cleaning.quarantine(F.col("e"), ["city"]).alias("x")).first().x
    assert x.kept == {"note": "text"} and x.offspec == {"odd": "[1]", "ref": "page 3 (map)"}


def test_listing(spark):
    raw = '{"folder": "01-Raven Park", "address": {"line1": "Road 1", "town": "", "postcode": "X1"}, "rent": {"string": "ROA"}, "stations": [{"name": "B", "miles": 2}, {"name": "A", "miles": 0.5}, {"name": "C", "miles": 3}, {"name": "D", "miles": 9}], "files": [{"url": "u"}, {"url": "u"}], "agents": [{"name": "N", "mobile": "1"}]}'
    x = each(spark, lambda a, b: cleaning.listing(a), [(raw, "")])[0]
    assert x == ("Raven Park", "Road 1, X1", None, ["A (0.5 miles)", "B (2.0 miles)", "C (3.0 miles)"], ["u"], ["N 1"])


def test_prose_and_claims(spark):
    assert each(spark, lambda a, b: text.prose(a), [("under construction until spring", ""), ("12.5 m", ""), ("https://x.y", ""), ("AB-12", ""), (None, "")]) == [True, False, False, False, False]
    claim = lambda a, b: text.saturation_claim(a, "(?i)saturated|full", "(?i)\\bnot\\b|never")
    assert each(spark, claim, [("The market is saturated.", ""), ("It is not full. Fine.", ""), ("Never. It is full!", "")]) == [True, False, True]
    own = lambda a, b: cleaning.names_other_scheme(text.figures(a), text.figures(b))
    assert each(spark, own, [("45,000 sq m", "40,000"), ("40 000 and 45,000", "40,000"), ("9,000,000", "40,000")]) == [True, False, False]
    bags = lambda a, b: cleaning.overlap(cleaning.token_bag(a), cleaning.token_bag(b))
    assert each(spark, bags, [("Large halls 2024", "large halls"), ("", "x")]) == [2 / 3, 1.0]


def test_unknown_spellings(spark):
    rows = [("TBD.", ""), ("  à consulter ", ""), ("??", ""), (None, ""), ("ok", "")]
    assert each(spark, lambda a, b: unknown.looks_unknown(a), rows) == [True, True, False, True, False]
    assert each(spark, lambda a, b: unknown.is_absent(a), rows) == [False, False, True, True, False]


def test_numbers_in_text(spark):
    rows = [("1.234,56", ""), ("1,234.56", ""), ("12,5", ""), ("12,500", ""), ("1.234.567", ""), ("1.234", ""), ("12.34", ""), ("25,000 - 50,000", ""), ("425 621 sq ft", ""), ("none", ""), (None, "")]
    assert each(spark, lambda a, b: numbers.normalize_number(a), rows) == [1234.56, 1.23456, 12.5, 12500.0, 1234567.0, 1234.0, 12.34, None, 425621.0, None, None]
    sizes = [("42.000,5 m2", ""), ("452,000 sq ft", ""), ("12,000 pallet positions", ""), ("45000", ""), ("500", "")]
    assert each(spark, lambda a, b: numbers.parse_size(a), sizes) == [(42000.0, "sqm"), (41992.0, "sqft"), (None, None), (45000.0, "sqm?"), (None, None)]
    assert each(spark, lambda a, b: numbers.measured(a), [("12", ""), ("12.5 m", ""), ("about 12", "")]) == ["bare", "measured", "other"]
