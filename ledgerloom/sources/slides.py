"""Slide decks (.pptx) as a data source: one task for each file, one row for each slide."""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .workbooks import _RELATION, _each, _open, _problem, _tag


@dataclass
class Deck(InputPartition):
    path: str


def _slide_text(z: zipfile.ZipFile, part: str) -> str:
    """Paragraphs as lines in the order of the file: text runs, and breaks as line ends."""
    lines = []
    for p in _each(z, part, "p"):
        if _tag(p) == "p" and p.tag.startswith("{http://schemas.openxmlformats.org/drawingml"):
            lines.append("".join("\n" if _tag(e) == "br" else e.text or "" for e in p.iter() if _tag(e) in ("t", "br")))
    return "\n".join(x for x in lines if x.strip())


def _slides(path: str) -> Iterator[tuple]:
    try:
        store, at = _open(path)
        with store.open_input_file(at) as f:
            z = zipfile.ZipFile(f)
            rels = {r.get("Id"): r.get("Target") or "" for r in _each(z, "ppt/_rels/presentation.xml.rels", "Relationship")}
            order = [posixpath.normpath(t.lstrip("/") if t.startswith("/") else "ppt/" + t) for s in _each(z, "ppt/presentation.xml", "sldId") if (t := rels.get(s.get(_RELATION)))]
            for n, part in enumerate(order, 1):
                try:
                    yield path, n, _slide_text(z, part), None
                except Exception as e:  # one bad slide is a row, the others are read
                    yield path, n, None, _problem(e)
    except Exception as e:  # the error is the row
        yield path, None, None, _problem(e)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def partitions(self) -> list[InputPartition]:
        store, at = _open(self.folder)
        info = store.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
        prefix = self.folder[: len(self.folder) - len(at)] if self.folder.endswith(at) else ""
        return [Deck(prefix + x.path) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and re.search(r"(?i)\.pptx$", x.path) and not x.base_name.startswith(("~$", "."))]

    def read(self, partition: Deck) -> Iterator[tuple]:
        yield from _slides(partition.path)


class Slides(DataSource):
    """spark.read.format("slides").load(folder or file): path, slide (from 1, in the order of the show), text, error."""

    @classmethod
    def name(cls) -> str:
        return "slides"

    def schema(self) -> str:
        return "path string, slide int, text string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_slides(spark: SparkSession, folder: str) -> DataFrame:
    """The text of all slides of the decks below a folder; files and slides that can't be read are rows with their error."""
    spark.dataSource.register(Slides)
    return spark.read.format("slides").load(folder)
