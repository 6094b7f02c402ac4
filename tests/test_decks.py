import random
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import decks, enrich, readback, selection
from ledgerloom.sources.slides import read_slides


@pytest.mark.parametrize("cells,few", [(1024, 4096), (4, 3), (2, 1)])
def test_medians_are_exact(spark, cells, few):
    r = random.Random(3)
    columns = [[r.gauss(0, 1e6) for _ in range(401)], [r.choice([1.5, 1.5, 2.5, -7.0]) for _ in range(401)], [5.0] * 401, [1e300 * r.random() for _ in range(401)], [r.random() if i % 2 else None for i in range(401)], [None] * 401, [float("nan")] * 400 + [3.0]]
    df = spark.createDataFrame(list(zip(*columns)), ", ".join(f"c{i} double" for i in range(len(columns)))).repartition(5)

    def plain(values):
        v = sorted(x for x in values if x is not None and x == x)
        return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else None

    assert selection.medians(df, df.columns, cells, few) == [plain(c) for c in columns]
    assert selection.medians(df.limit(0), ["c0"]) == [None]
    assert selection.nth_values(df, F.col("c0"), [0, 400], cells, few) == [min(columns[0]), max(columns[0])]


def test_dominant_country_of_nothing(spark):
    places = spark.createDataFrame([], "cc string, seq int, lat double, lng double")
    assert enrich.dominant_country(places, "cc", "seq").first().dominant is None


SCHEMA = "deck string, record int, page int, image_pages array<int>, plan_page int, plan_stated boolean, hero int, excluded map<int,array<int>>, source string, rent double, rent_unit string, area double, plot_area double, area_unit string, lat double, lng double, note string, unreadable boolean"


def findings(spark, rows, known, values=()):
    base = dict.fromkeys(x.split()[0] for x in SCHEMA.split(", "))
    records = spark.createDataFrame([tuple((base | {"plan_stated": True, "image_pages": [], "unreadable": False} | r).values()) for r in rows], SCHEMA)
    out = readback.record_findings(records, spark.createDataFrame(known, "deck string, source string, pages array<int>"), spark.createDataFrame(list(values), "deck string, values array<double>"))
    return {(r.deck, r.record, r.rule, r.detail, r.severity) for r in out.collect()}


def test_pages_and_claims(spark):
    rows = [
        {"deck": "d", "record": 1, "page": 0, "image_pages": [1, 2]},
        {"deck": "d", "record": 2, "page": 2, "image_pages": [1, 2, 9, -1], "plan_page": 7},
        {"deck": "d", "record": 3, "page": 8, "image_pages": None, "plan_stated": False},
        {"deck": "d", "record": 4, "page": None, "plan_page": 3, "hero": 1, "excluded": {4: [1], 0: [1]}},
        {"deck": "d", "record": 5, "page": 3, "plan_page": 3, "hero": 1, "excluded": {3: [1]}, "source": "other"},
        {"deck": "d", "record": 6, "page": 77, "unreadable": True},
        {"deck": "unknown", "record": 1, "page": 50, "image_pages": [3]},
    ]
    got = findings(spark, rows, [("d", "deck.pdf", [0, 1, 2, 3]), ("unread", "x", [0, 1])])
    assert got == {
        ("d", 2, "page claimed twice", "1", "warning"), ("d", 2, "page claimed twice, anchored", "2", "warning"), ("d", 2, "image page out of deck", "9", "error"), ("d", 2, "image page out of deck", "-1", "error"), ("d", 2, "plan out of deck", "7", "error"),
        ("d", 3, "page out of deck", "8", "error"), ("d", 3, "keys not stated", None, "warning"), ("d", 4, "no page", None, "error"), ("d", 4, "excluded page out of deck", "4", "error"),
        ("d", 5, "hero on the plan page", "3", "warning"), ("d", 5, "hero excluded", "1", "error"), ("d", 5, "other source", "other", "warning"), ("d", None, "pages without a record", "1", "warning"),
    }


def test_figures_against_the_text(spark):
    rows = [
        {"deck": "d", "record": 1, "page": 0, "rent": 66.0, "rent_unit": "€/sq m/yr", "area": 10040.0, "plot_area": 777.0},
        {"deck": "d", "record": 2, "page": 0, "rent": 6.0, "rent_unit": "£/sq ft/yr", "area": 70000.0, "lat": 91.0, "lng": 0.0},
        {"deck": "d", "record": 3, "page": 0, "rent": 5.5, "rent_unit": "€/sq m/yr"},
        {"deck": "d", "record": 4, "page": 0, "rent": 5.5, "rent_unit": "€/sq m/yr", "note": "x 12"},
        {"deck": "d", "record": 5, "page": 0, "rent": 900.0},
        {"deck": "bare", "record": 1, "page": 0, "area": 5000.0},
    ]
    got = findings(spark, rows, [("d", "", [0]), ("bare", "", [0])], [("d", [5.5, 10000.0]), ("bare", [3.0])])
    assert got == {
        ("d", 1, "plot_area not in text", "777.0", "warning"), ("d", 2, "area of the other unit", "70000.0", "warning"), ("d", 2, "area not in text", "70000.0", "warning"), ("d", 2, "rent not in text", "6.0", "warning"), ("d", 2, "place out of range", None, "error"),
        ("d", 3, "rent of a month", "5.5", "warning"), ("d", 5, "rent out of band", "900.0", "error"),
    }


def test_large_figures_have_no_exponent(spark):
    rows = [{"deck": "d", "record": n, "page": 0, "area": a} for n, a in enumerate((9_999_950.0, 10_000_000.0, 123_456_789.25, 1e300))]
    got = findings(spark, rows, [("d", "", [0])])
    assert [x[3] for x in sorted(got) if x[2] == "area out of band"] == ["9999950.0", "10000000.0", "123456789.25", "1.0E300"]


def test_records_of_decks(spark):
    pages = [
        ("a", 0, "Contents\nAlpha Park ..... 2\nBeta Park\t3\nGamma   4\nfurther text"), ("a", 1, "Intro"), ("a", 2, "City\r\nBrno\nWarehouse area:\n10,000 sq m\nRent: 5"), ("a", 3, ""), ("a", 4, "Status\nOwner\nGLA\ntbd"), ("a", 5, None),
        ("b", 0, "City\nWarehouse area\nOffice\n5"), ("b", 1, "Developer\nX\nStatus\nbuilt"), ("b", 2, "Developer\nX\nCity\nOstrava\nLocation\nelsewhere"),
        ("c", 0, "Owner: ACME\nSite area : 5 ha\nno label here: x"), ("c", 1, "Owner: ACME\nStatus: tbd"),
        ("d", 0, "nothing"),
    ]
    df = spark.createDataFrame(pages + pages[:3], "deck string, page int, text string")
    got = {(r.deck, r.page): (r.park, dict(r.fields)) for r in decks.deck_records(df).collect()}
    assert got == {
        ("a", 2): ("Alpha Park", {"city": "Brno", "warehouseArea": "10,000 sq m", "warehouseRent": "5"}),
        ("a", 4): ("Beta Park", {}),
        ("b", 0): (None, {"warehouseArea": "Office"}),
        ("b", 2): (None, {"developer": "X", "city": "Ostrava"}),
        ("c", 0): (None, {"landlord": "ACME", "plotArea": "5 ha"}),
    }
    assert decks.deck_records(df.limit(0)).count() == 0


def test_slides(spark, tmp_path):
    a, r = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "d.pptx", "w") as z:
        z.writestr("ppt/presentation.xml", f'<p xmlns="http://schemas.openxmlformats.org/presentationml/2006/main" {r}><sldIdLst><sldId r:id="b"/><sldId r:id="a"/><sldId r:id="c"/></sldIdLst></p>')
        z.writestr("ppt/_rels/presentation.xml.rels", '<R><Relationship Id="a" Target="slides/s1.xml"/><Relationship Id="b" Target="/ppt/slides/s2.xml"/><Relationship Id="c" Target="slides/none.xml"/></R>')
        z.writestr("ppt/slides/s1.xml", f"<s {a}><a:p><a:r><a:t>Ci</a:t></a:r><a:r><a:t>ty</a:t></a:r></a:p><a:p/><a:p><a:r><a:t>Brno</a:t></a:r><a:br/><a:r><a:t>CZ</a:t></a:r></a:p></s>")
        z.writestr("ppt/slides/s2.xml", f"<s {a}><a:p><a:r><a:t>First</a:t></a:r></a:p></s>")
    (tmp_path / "x.pptx").write_bytes(b"no zip")
    got = {(r.path.rsplit("/", 1)[1], r.slide): (r.text, r.error is None) for r in read_slides(spark, str(tmp_path)).collect()}
    assert got == {("d.pptx", 1): ("First", True), ("d.pptx", 2): ("City\nBrno\nCZ", True), ("d.pptx", 3): (None, False), ("x.pptx", None): (None, False)}
