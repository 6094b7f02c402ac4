"""Workbooks (.xlsx) as a data source: one task for each sheet, which reads its part of the file cell by cell."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: A linked range of more cells than this links only the cells that have text.
LINKED = 10_000
_OLD = b"\xd0\xcf\x11\xe0"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


@dataclass
class Sheet(InputPartition):
    path: str
    name: str | None
    part: str | None
    error: str | None = None


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path within it; plain paths are local ones."""
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _problem(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:300]


def _each(z: zipfile.ZipFile, part: str, *names: str) -> Iterator[ElementTree.Element]:
    """The elements of these names, one by one; what has been read is dropped, so the part is never held whole."""
    with z.open(part) as f:
        inside = 0
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if _tag(e) in names:
                inside += 1 if event == "start" else -1
                if event == "end":
                    yield e
            if event == "end" and not inside:
                e.clear()


def _sheets(path: str) -> list[Sheet]:
    """The sheets of one file, or one entry with what is wrong with it."""
    store, at = _open(path)
    try:
        with store.open_input_file(at) as f:
            head = f.read(4)
            if head == _OLD:
                return [Sheet(path, None, None, "encrypted, or a workbook of the old format")]
            f.seek(0)
            z = zipfile.ZipFile(f)
            targets = {r.get("Id"): r.get("Target") or "" for r in _each(z, "xl/_rels/workbook.xml.rels", "Relationship")}
            found = []
            for s in _each(z, "xl/workbook.xml", "sheet"):
                target = targets.get(s.get(_RELATION))
                part = target and (target.lstrip("/") if target.startswith("/") else "xl/" + target)
                found.append(Sheet(path, s.get("name"), part) if part in z.namelist() else Sheet(path, s.get("name"), None, "the sheet's part is missing"))
            return found or [Sheet(path, None, None, "no sheets")]
    except Exception as e:  # the error is the row
        return [Sheet(path, None, None, _problem(e))]


def _place(ref: str) -> tuple[int | None, int | None]:
    """Zero-based row and column of A1; a whole column has no row and a whole row no column."""
    m = re.fullmatch(r"\$?([A-Za-z]{0,3})\$?(\d*)", ref.strip())
    if not m or not (m[1] or m[2]):
        raise ValueError(f"no reference: {ref[:40]}")
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    return (int(m[2]) - 1 if m[2] else None), (col - 1 if m[1] else None)


def _text(e: ElementTree.Element) -> str:
    """The text of a string item, phonetic hints left out."""
    return "".join(t.text or "" for c in e for t in ([c] if _tag(c) == "t" else c.iter() if _tag(c) == "r" else []) if _tag(t) == "t")


def _cells(sheet: Sheet) -> Iterator[tuple]:
    store, at = _open(sheet.path)
    with store.open_input_file(at) as f:
        z = zipfile.ZipFile(f)
        names = set(z.namelist())
        shared = [_text(e) for e in _each(z, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
        folder, _, own = sheet.part.rpartition("/")
        rels = f"{folder}/_rels/{own}.rels"
        urls = {r.get("Id"): r.get("Target") for r in _each(z, rels, "Relationship")} if rels in names else {}
        single: dict[tuple[int, int], str] = {}
        areas: list[tuple[int | None, int | None, int | None, int | None, str]] = []
        for h in _each(z, sheet.part, "hyperlink"):
            url = urls.get(h.get(_RELATION)) or h.get("location")
            first, _, last = (h.get("ref") or "").partition(":")
            (r0, c0), (r1, c1) = _place(first), _place(last or first)
            if None not in (r0, c0, r1, c1) and (r1 - r0 + 1) * (c1 - c0 + 1) <= LINKED:
                single |= {(r, c): url for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)}
            else:
                areas.append((r0, r1, c0, c1, url))
        row = -1
        for e in _each(z, sheet.part, "row"):
            row, col = int(e.get("r")) - 1 if e.get("r") else row + 1, -1
            for c in (c for c in e if _tag(c) == "c"):
                r, col = _place(c.get("r")) if c.get("r") else (row, col + 1)
                value = next((v.text for v in c if _tag(v) == "v"), None)
                kind = c.get("t")
                text = shared[int(value)] if kind == "s" and value else "".join(_text(v) for v in c if _tag(v) == "is") if kind == "inlineStr" else value
                said = re.match(r'(?i)HYPERLINK\("([^"]+)"', next((x.text or "" for x in c if _tag(x) == "f"), ""))
                link = single.pop((r, col), None)
                over = next((u for a, b, x, y, u in areas if (a is None or a <= r <= b) and (x is None or x <= col <= y)), None) if text else None
                url = link or over or (said[1] if said else None)
                if text or url:
                    yield sheet.path, sheet.name, r, col, text or None, url, None
        for (r, c), url in sorted(single.items()):
            yield sheet.path, sheet.name, r, c, None, url, None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def partitions(self) -> list[InputPartition]:
        store, at = _open(self.folder)
        info = store.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
        prefix = self.folder[: len(self.folder) - len(at)] if self.folder.endswith(at) else ""
        paths = sorted(prefix + x.path for x in found if x.type == fs.FileType.File and x.path.lower().endswith((".xlsx", ".xlsm")) and not x.base_name.startswith(("~$", ".")))
        with ThreadPoolExecutor(16) as pool:
            return [s for sheets in pool.map(_sheets, paths) for s in sheets]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        if partition.error:
            yield partition.path, partition.name, None, None, None, None, partition.error
            return
        try:
            yield from _cells(partition)
        except Exception as e:  # the error is the row, after the cells before it
            yield partition.path, partition.name, None, None, None, None, _problem(e)


class Workbooks(DataSource):
    """spark.read.format("workbooks").load(folder or file): path, sheet, row, col, text, url, error.

    Rows and columns count from zero. A file or sheet that can't be read (broken, encrypted, of the old format, a part
    missing) is a row with its error; a cell that can't be read ends its sheet after the cells before it. Other files and
    sheets are read. A link over a whole column, or over more
    than LINKED cells, links the cells that have text.
    """

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return "path string, sheet string, row int, col int, text string, url string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """All cells and errors of the workbooks below a folder, or of one file."""
    spark.dataSource.register(Workbooks)
    return spark.read.format("workbooks").load(folder)
