import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.functions.text import name_variants
from ledgerloom.operators import headers
from ledgerloom.sources import files, sinks
from ledgerloom.sources.workbooks import read_workbooks


def test_discovery(spark, tmp_path):
    for name, content in {"a/x.pdf": "1", "b/x.pdf": "2", "b/copy.pdf": "1", "c/~$lock.xlsx": "3", "c/notes.txt": "4", "c/.hidden": "5", "longlist_final.xlsx": "6"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    found = files.discover(spark, str(tmp_path))
    got = {r.path.split(str(tmp_path))[1]: (r.kind, r.duplicate_of and r.duplicate_of.split(str(tmp_path))[1]) for r in found.collect()}
    assert got == {"/a/x.pdf": ("decks", None), "/b/x.pdf": ("decks", None), "/b/copy.pdf": ("decks", "/a/x.pdf"), "/c/notes.txt": ("unclassified", None)}
    assert [(r.name, r.n_paths) for r in files.basename_collisions(found).collect()] == [("x.pdf", 2)]


def test_text_formats(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes('﻿property_id,value\n1,"a ""q"", b\nc"\n2,\n'.encode())
    assert [tuple(r) for r in files.read_ledger(spark, str(tmp_path / "l.csv")).collect()] == [("1", 'a "q", b\nc'), ("2", None)]
    schema = StructType().add("park", "string").add("area", "double")
    (tmp_path / "r1.json").write_text('[{"park": "A", "area": 1, "odd": {}}, {"park": "B"}]')
    (tmp_path / "r2.json").write_text('{"records": [{"park": "C", "area": 2.5}]}')
    assert [tuple(r) for r in files.read_records(spark, str(tmp_path / "r1.json"), schema).collect()] == [("A", 1.0), ("B", None)]
    assert [tuple(r) for r in files.read_records(spark, str(tmp_path / "r2.json"), schema).collect()] == [("C", 2.5)]
    (tmp_path / "f.jsonl").write_text('{"park": "A", "area": 1}\n{broken\n{"park": "B", "area": 2}\n')
    assert [r.park for r in files.read_log(spark, str(tmp_path / "f.jsonl"), schema).collect()] == ["A", "B"]


def test_mail(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"Subject: Offer\nFrom: a@example.com\nDate: Tue, 05 Mar 2024 10:00:00 +0100\nContent-Type: text/html\n\n<style>x</style><p>Hello <b>you</b></p>")
    r = files.read_mail(spark, str(tmp_path)).withColumn("day", files.iso_date(F.col("date"))).first()
    assert (r.subject, r.sender, r.body, r.ok, r.day) == ("Offer", "a@example.com", "Hello you", True, "2024-03-05")


def test_sheets(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rel = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships {rel}><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Park</t></si><si><r><t>Ci</t></r><r><t>ty</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>12</v></c><c r="B3"><f>HYPERLINK("http://x/a.pdf","a")</f><v>a</v></c></row></sheetData><hyperlinks><hyperlink ref="A3:A4" r:id="rId9"/></hyperlinks></worksheet>')
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", f'<Relationships {rel}><Relationship Id="rId9" Target="http://x/b"/></Relationships>')
    (tmp_path / "broken.xlsx").write_bytes(b"not a zip")
    cells = files.read_cells(spark, str(tmp_path))
    assert {(r.row, r.col, r.text, r.url) for r in cells.collect()} == {(0, 0, "Title", None), (1, 0, "Park", None), (1, 1, "City", None), (2, 0, "12", "http://x/b"), (2, 1, "a", "http://x/a.pdf"), (3, 0, None, "http://x/b")}
    assert files.find_header_row(cells).first().header_row == 1


def _book(path, sheets, rels="", strings=""):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rel = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships {rel}>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{strings}</sst>")
        for i, (_, body) in enumerate(sheets):
            if body is not None:
                z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}>{body}</worksheet>")
                z.writestr(f"xl/worksheets/_rels/s{i}.xml.rels", f"<Relationships {rel}>{rels}</Relationships>")


def test_odd_workbooks_are_rows_of_errors(spark, tmp_path):
    link = '<Relationship Id="h" Target="http://x/a"/>'
    one = '<sheetData><row r="1"><c r="A1"><v>1</v></c><c r="B1"><v>2</v></c></row><row><c><v>3</v></c><c t="inlineStr"><is><t>x</t><rPh><t>hint</t></rPh></is></c></row></sheetData>'
    _book(tmp_path / "column.xlsx", [("A", one + '<hyperlinks><hyperlink ref="A:A" r:id="h"/></hyperlinks>'), ("B", one + '<hyperlinks><hyperlink ref="$B$2:D4" location="here"/><hyperlink ref="A1:XFD1048576" r:id="h"/></hyperlinks>')], link)
    _book(tmp_path / "odd.xlsx", [("gone", None), ("bad", "<sheetData><row r='1'><c r='A1'><v>5</v></c></row><row r='2'><c r='?!'><v>1</v></c></row></sheetData>"), ("cut", "<sheetData><row r='1'><c r='A1'><v>6</v></c></row>" + "</x>"), ("fine", one), ("string", "<sheetData><row r='1'><c r='A1' t='s'><v>9</v></c></row></sheetData>")])
    (tmp_path / "old.xlsx").write_bytes(b"\xd0\xcf\x11\xe0" + b"0" * 600)
    (tmp_path / "broken.xlsx").write_bytes(b"PK not a zip")
    (tmp_path / "empty.xlsx").write_bytes(b"")
    (tmp_path / "~$lock.xlsx").write_bytes(b"")
    rows = read_workbooks(spark, str(tmp_path)).collect()
    at = lambda r: r.path.rsplit("/", 1)[1]
    cells = {(at(r), r.sheet, r.row, r.col, r.text, r.url) for r in rows if r.error is None}
    plain = [(0, 0, "1"), (0, 1, "2"), (1, 0, "3"), (1, 1, "x")]
    want = {("column.xlsx", "A", r, c, t, "http://x/a" if c == 0 else None) for r, c, t in plain} | {("odd.xlsx", "fine", r, c, t, None) for r, c, t in plain}
    want |= {("column.xlsx", "B", r, c, t, "here" if (r, c) == (1, 1) else "http://x/a") for r, c, t in plain}
    want |= {("column.xlsx", "B", r, c, None, "here") for r in (1, 2, 3) for c in (1, 2, 3) if (r, c) != (1, 1)}
    assert cells == want | {("odd.xlsx", "bad", 0, 0, "5", None)}
    errors = {(at(r), r.sheet): r.error for r in rows if r.error}
    assert set(errors) == {("odd.xlsx", "gone"), ("odd.xlsx", "bad"), ("odd.xlsx", "cut"), ("odd.xlsx", "string"), ("old.xlsx", None), ("broken.xlsx", None), ("empty.xlsx", None)}
    assert "missing" in errors["odd.xlsx", "gone"] and "encrypted" in errors["old.xlsx", None]
    assert read_workbooks(spark, "file://" + str(tmp_path / "column.xlsx")).count() == len([w for w in want if w[0] == "column.xlsx"])
    assert files.read_cells(spark, str(tmp_path)).where("row is null").count() == 0


def test_one_task_a_sheet(spark, tmp_path):
    body = "<sheetData>" + "".join(f"<row r='{i}'><c r='A{i}'><v>{i}</v></c></row>" for i in range(1, 400)) + "</sheetData>"
    for n in range(2):
        _book(tmp_path / f"{n}.xlsx", [("A", body), ("B", body)])
    df = read_workbooks(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 4 and df.count() == 4 * 399


def test_trackers_from_cells(spark):
    said = [["Our longlist", None], ["Scheme", "Promoter", "Developer", "GLA (sq m)", "Rent EUR / month", "Coordinates", "Contact"], ["Alpha", "Old", "", "10,000", "5.50", "50.1234, 14.5678", "x"], ["Beta", "P", "D", "0", "tbd", "", "y"], ["Total", "", "z", "10,000", "", "", ""]]
    cells = spark.createDataFrame([("b", "s", r, c, t) for r, row in enumerate(said) for c, t in enumerate(row)], "path string, sheet string, row int, col int, text string")
    got = {(r.row, r.field): (r.value, r.number) for r in headers.read_trackers(cells).collect()}
    assert got == {(2, "park"): ("Alpha", None), (2, "developer"): ("Old", None), (2, "warehouseArea"): ("10,000", 10000.0), (2, "warehouseRentVal"): ("5.50", 66.0), (2, "lat"): ("50.1234", None), (2, "lng"): ("14.5678", None), (3, "park"): ("Beta", None), (3, "developer"): ("D", None)}
    report = headers.header_report(cells).first()
    assert (report.populated, report.mapped, report.rich, report.unmapped) == (7, 6, False, ["Contact"])
    told = spark.createDataFrame([("b", "s", 6, "landlord"), ("b", "s", 0, "epc"), ("b", "s", 3, "plotArea")], "path string, sheet string, col int, field string")
    bound = {(r.col): (r.field, r.by, r.rank) for r in headers.bind_columns(cells.where("row = 1").withColumnRenamed("text", "header"), told).collect()}
    assert bound[6] == ("landlord", "outer", 1) and bound[0] == ("epc", "outer", 1) and bound[2] == ("developer", "name", 1) and bound[1] == ("developer", "name", 2)


def test_references_and_names(spark):
    d = spark.createDataFrame([("A", "Z2:AA3"), ("AA", "B1")], "letters string, ref string")
    got = [(r.i, [tuple(x) for x in r.cells]) for r in d.select(files.col_to_index(F.col("letters")).alias("i"), files.expand_ref(F.col("ref")).alias("cells")).collect()]
    assert got == [(0, [(1, 25), (1, 26), (2, 25), (2, 26)]), (26, [(0, 1)])]
    names = spark.createDataFrame([("X1", "Bozen / Bolzano"), ("X2", "Trento (Trient)"), ("X3", "Bolzano")], "code string, name string")
    assert {(r.variant, r.code) for r in files.name_index(names, "code", name_variants(F.col("name"))).collect()} == {("Bozen", "X1"), ("Trento", "X2"), ("Trient", "X2")}


def test_sinks(spark):
    d = spark.createDataFrame([(1, "Alpha", None, "x"), (2, "n/a", "5", None)], "id int, park string, landPrice string, photo string")
    assert [tuple(r) for r in sinks.flat_export(sinks.without_blobs(d, ["photo"]), {"park": "Park", "landPrice": "Land price"}, [F.col("id")]).collect()] == [("Alpha", "—"), ("tbd", "5")]
    o = spark.createDataFrame([(1, "park", "Beta")], "id int, field string, value string")
    assert sorted(r.park for r in sinks.with_overrides(d, "id", ["park"], o).collect()) == ["Beta", "n/a"]
    assert {tuple(r) for r in sinks.gaps_report(d, "id", ["landPrice"], ["photo"]).collect()} == {(1, "core", "landPrice"), (2, "other", "photo")}
    assert sinks.payload(d, "id", ["park"]).where("id = 1").first().document == '{"n":1,"items":[{"park":"Alpha"}]}'


def test_cells_of_trackers_are_made_once(spark):
    """F16: cells that take work to make are made once, however often they are read; own coordinates are kept."""
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(c: pd.Series) -> pd.Series:
        made.add(len(c))
        return c

    table = [["Park", "City", "Lat, Long", "Latitude", "Rent"], ["Raven", "Brno", "49.1234, 16.5678", None, "5"], ["Vltava", "tbd", "50.1234, 14.5678", "50.5", None], ["Total", "Brno", None, None, "5"], ["Lone", None, None, None, None]]
    cells = [("book", "s", i, j, c) for i, row in enumerate(table) for j, c in enumerate(row) if c is not None]
    rows = spark.createDataFrame(cells, "path string, sheet string, row int, col int, text string").withColumn("text", counted("text"))
    got = {(r.row, r.field): r.value for r in headers.read_trackers(rows).collect()}
    assert got == {(1, "park"): "Raven", (1, "city"): "Brno", (1, "lat"): "49.1234", (1, "lng"): "16.5678", (1, "warehouseRentVal"): "5", (2, "park"): "Vltava", (2, "lat"): "50.5", (2, "lng"): "14.5678"}
    assert made.value == len(cells)
    assert headers.header_report(rows).first().populated == 5 and made.value == 2 * len(cells)
