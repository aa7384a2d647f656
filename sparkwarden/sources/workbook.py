"""Workbooks (zipped XML sheets) as a Spark data source, with equality filters pushed into the scan.

``spark.read.format("workbook").schema(...).load(folder)`` reads every ``.xlsx`` of a folder, or one file: the first row of a sheet
names its columns.  A partition is a stretch of one sheet's rows (option ``rows``).  Filters ``column = value`` and ``column IS NOT NULL`` are taken by the
reader, which builds no row that they drop; the plan shows what is left of them.  A sheet's XML is read as a stream, so a
partition's memory does not grow with the sheet, apart from its table of shared texts.

Cases: a missing column, an empty cell, or one that is no number where one is wanted is null; numbers are read as texts where the
schema says string; rows without cells are passed over; a file that is no workbook is an error.  The folder must be one that all
executors can open (a mount), as a zip is read by its directory at the end.
"""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, IsNotNull
from pyspark.sql.types import DoubleType, LongType, StructType

from sparkwarden.plans.registry import query
from sparkwarden.sources.shared import shared_path
from sparkwarden.sources.tables import table

#: The XML names of sheets, of the workbook and of its relations.
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows of a partition, and of a workbook that ``write_workbooks`` makes.
PART, BOOK = 20_000, 50_000


def local(path: str) -> str:
    """The path as ``open`` takes it; only files that are mounted can be read."""
    if "://" in path or path.startswith("file:"):
        if not path.startswith("file:"):
            raise ValueError(f"workbooks must lie in a folder that executors can open: {path}")
        return "/" + path[5:].lstrip("/")
    return path


def column_of(reference: str) -> int:
    """The place of a cell's column: A1 is 0, AA7 is 26."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(book: zipfile.ZipFile) -> list[str]:
    """Where the sheets of a workbook lie in it, in order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = [targets[s.get(f"{_REL}id")] for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")]
    return [t.lstrip("/") if t.startswith("/") else f"xl/{t}" for t in found]


def shared_texts(book: zipfile.ZipFile) -> list[str]:
    """The table of texts that cells point to."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in item.iter(f"{_NS}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]


def rows(book: zipfile.ZipFile, sheet: str, texts: list[str], first: int = 0, last: int | None = None) -> Iterator[dict[int, str]]:
    """The rows from ``first`` to before ``last`` of a sheet, counted from 0: place of the column to text."""
    at = 0
    with book.open(sheet) as stream:
        data = None
        for event, e in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                data = e if e.tag == f"{_NS}sheetData" else data
                continue
            if e.tag != f"{_NS}row":
                continue
            if at >= first:
                cells = {}
                for k, c in enumerate(e):
                    value = c.find(f"{_NS}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else None if value is None else value.text
                    if text is not None:
                        cells[column_of(c.get("r")) if c.get("r") else k] = texts[int(text)] if c.get("t") == "s" else text
                yield cells
            at += 1
            data.clear()  # what was read goes
            if last is not None and at >= last:
                return


class Stretch(InputPartition):
    """Rows from ``first`` on of one sheet of one file."""

    def __init__(self, path: str, sheet: str, first: int):
        self.path, self.sheet, self.first = path, sheet, first


def typed(text: str | None, kind):
    """A cell's text as a value of the schema's type."""
    if text is None or isinstance(kind, str):
        return text
    try:
        return int(float(text)) if kind is int else float(text) if kind is float else text
    except ValueError:
        return None


class WorkbookReader(DataSourceReader):
    """Stretches of sheets, and the filters that their rows must pass."""

    def __init__(self, schema: StructType, path: str, size: int = PART):
        self.fields = [(f.name, int if isinstance(f.dataType, LongType) else float if isinstance(f.dataType, DoubleType) else str) for f in schema.fields]
        self.path, self.size, self.equal, self.present = path, size, [], []

    def pushFilters(self, filters):  # noqa: N802  the interface's name
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1:
                self.equal.append((f.attribute[0], f.value))
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1:
                self.present.append(f.attribute[0])
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        folder, out = local(self.path), []
        files = [folder] if os.path.isfile(folder) else sorted(os.path.join(folder, n) for n in os.listdir(folder) if n.endswith(".xlsx"))
        for path in files:
            with zipfile.ZipFile(path) as book:
                for sheet in sheets(book):
                    with book.open(sheet) as stream:
                        stated = re.search(rb'<dimension ref="[A-Z]+\d+:[A-Z]+(\d+)"', stream.read(4096))
                    out += [Stretch(path, sheet, first) for first in range(1, max(2, int(stated[1]) if stated else 2), self.size)]
                    if not stated:  # of unknown length: one stretch reads to the end
                        out[-1].first = -1
        return out

    def read(self, partition: Stretch):
        with zipfile.ZipFile(partition.path) as book:
            texts, whole = shared_texts(book), partition.first < 0
            head = next(rows(book, partition.sheet, texts, 0, 1), {})
            place = {name: k for k, name in head.items()}
            begin = 1 if whole else partition.first
            for cells in rows(book, partition.sheet, texts, begin, None if whole else begin + self.size):
                if not cells:
                    continue
                row = {name: typed(cells.get(place.get(name, -1)), kind) for name, kind in self.fields}
                if all(row[n] == v for n, v in self.equal) and all(row[n] is not None for n in self.present):
                    yield tuple(row[name] for name, _ in self.fields)


class WorkbookSource(DataSource):
    """The format ``workbook``; a schema of strings, longs and doubles has to be given."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self):
        raise ValueError("the format workbook needs a schema")

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(schema, self.options["path"], int(self.options.get("rows", PART)))


def write_workbooks(df: DataFrame, folder: str) -> int:
    """df as workbooks of ``BOOK`` rows at most, each written by the task that has the rows; how many there are.

    A task's files have the task's number in their names, so that one that runs again writes the same files.
    """
    names, target = df.columns, local(folder)

    def run(parts):
        from pyspark import TaskContext

        os.makedirs(target, exist_ok=True)
        number, n = TaskContext.get().partitionId(), 0
        for frame in parts:
            for lo in range(0, len(frame), BOOK):
                some = frame.iloc[lo : lo + BOOK]
                cell = lambda v: "<c/>" if v is None or v != v else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
                lines = ["".join(map(cell, names)), *("".join(map(cell, r)) for r in some.astype(object).itertuples(index=False))]
                width = (chr(64 + (len(names) - 1) // 26) if len(names) > 26 else "") + chr(65 + (len(names) - 1) % 26)
                sheet = f'<worksheet xmlns="{_NS[1:-1]}"><dimension ref="A1:{width}{len(lines)}"/><sheetData>{"".join(f"<row>{x}</row>" for x in lines)}</sheetData></worksheet>'
                path = os.path.join(target, f"part-{number:05d}-{n:05d}.xlsx")
                with zipfile.ZipFile(f"{path}.tmp", "w", zipfile.ZIP_DEFLATED) as book:
                    book.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>')
                    book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
                    book.writestr("xl/worksheets/sheet1.xml", sheet)
                os.replace(f"{path}.tmp", path)
                n += 1
        import pandas as pd

        yield pd.DataFrame({"n": [n]})

    return df.mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def read_workbooks(spark: SparkSession, folder: str, schema: str, size: int = PART) -> DataFrame:
    """The rows of all workbooks of a folder; filters on single columns go into the scan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").schema(schema).option("rows", size).load(folder)


@query("src9_workbook_product", "SELECT p_partkey AS id, p_name AS product_name, p_type AS kind, p_size AS size, round(p_retailprice, 2) AS price FROM part WHERE p_brand = 'Brand#2'")
def workbook_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed workbooks of parts, filtered by product within the scan (SRC9)."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_brand").alias("product"), F.col("p_name").alias("product_name"), F.col("p_type").alias("kind"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").cast("double").alias("price"))
    folder = shared_path(spark, "workbooks")
    write_workbooks(parts, folder)
    landed = read_workbooks(spark, folder, "id bigint, product string, product_name string, kind string, size bigint, price double")
    return landed.where("product = 'Brand#2'").select("id", "product_name", "kind", F.col("size").cast("int").alias("size"), F.round("price", 2).alias("price"))
