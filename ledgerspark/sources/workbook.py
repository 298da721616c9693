"""Workbooks (.xlsx) without a library: zip and XML read in executors, a row for each sheet's row.

Files come through Spark's reader, so from any store. A first step takes a workbook apart: one record for each sheet, with
its XML and what it refers to. Sheets are then dealt out, so that those of one workbook are parsed side by side, and each is
parsed as a stream. The driver sees names, headers and kinds of columns only.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import cleaning
from ledgerspark.shipping import ship

#: Bytes of a part of a workbook, unpacked, that are read at most; more is refused.
MOST = 1 << 30
#: The built-in number formats that show dates or times.
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
PARTS = "path string, sheet int, name string, xml binary, strings binary, styles binary, from_1904 boolean"
ROWS = "path string, sheet int, name string, row int, cells array<struct<kind:string,value:string>>"
BATCH = 4096


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _part(book: zipfile.ZipFile, name: str) -> bytes:
    if name not in book.namelist():
        return b""
    if book.getinfo(name).file_size > MOST:
        raise ValueError(f"{name} has more than {MOST} bytes")
    return book.read(name)


def taken_apart(content: bytes) -> Iterator[tuple[int, str, bytes, bytes, bytes, bool]]:
    """Number, name, XML, shared strings, styles and calendar of each sheet, in order. A workbook's own folder is the one
    that its `workbook.xml` lies in."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        main = next((n for n in book.namelist() if n.endswith("workbook.xml")), None)
        if main is None:
            raise ValueError("not a workbook")
        folder = posixpath.dirname(main)
        links = _part(book, f"{folder}/_rels/workbook.xml.rels")
        targets = {e.get("Id"): (e.get("Type") or "", posixpath.normpath(posixpath.join("/" + folder, e.get("Target"))).lstrip("/")) for e in ElementTree.fromstring(links)} if links else {}
        of_kind = lambda end: next((_part(book, t) for kind, t in targets.values() if kind.endswith(end)), b"")
        strings, styles = of_kind("/sharedStrings"), of_kind("/styles")
        root = ElementTree.fromstring(_part(book, main))
        old = any(_tag(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root.iter())
        sheets = [e for e in root.iter() if _tag(e) == "sheet"]
        for i, e in enumerate(sheets):
            kind, target = targets.get(next((v for k, v in e.attrib.items() if k.endswith("}id")), None), ("", ""))
            if kind.endswith("/worksheet"):
                yield i, e.get("name") or f"Sheet{i + 1}", _part(book, target), strings, styles, old


def text_of(element) -> str:
    """All text of a string, without what only says how it's read aloud."""
    return "".join(t.text or "" for part in element if _tag(part) != "rPh" for t in ([part] if _tag(part) == "t" else part) if _tag(t) == "t")


def date_styles(styles: bytes) -> set[int]:
    """The numbers of the cell styles that show dates or times."""
    if not styles:
        return set()
    root = ElementTree.fromstring(styles)
    own = {int(e.get("numFmtId")): e.get("formatCode") or "" for e in root.iter() if _tag(e) == "numFmt" and e.get("numFmtId")}
    shows = lambda code: bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|general', "", code, flags=re.I), re.I))
    cells = next((e for e in root if _tag(e) == "cellXfs"), ())
    return {i for i, e in enumerate(cells) if (n := int(e.get("numFmtId") or 0)) in DATES or (n in own and shows(own[n]))}


def date_of(days: float, from_1904: bool) -> str:
    """A cell's number as a date, with the time if there is one. Day 60 of the older calendar was no day."""
    start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30 if days >= 60 else 31)
    at = start + datetime.timedelta(seconds=round(days * 86400))
    return at.isoformat(sep=" ") if at.time() != datetime.time() else at.date().isoformat()


def column_of(reference: str) -> int:
    """From 0: A, B, ..., Z, AA."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def parsed(xml: bytes, strings: bytes, styles: bytes, from_1904: bool) -> Iterator[tuple[int, list[tuple[str, str] | None]]]:
    """Row number and cells (kind: number, text, bool, date or error; value) of the rows that hold something."""
    shared = [text_of(e) for e in ElementTree.fromstring(strings) if _tag(e) == "si"] if strings else []
    dates, at = date_styles(styles), 0
    for _, e in ElementTree.iterparse(io.BytesIO(xml), ("end",)):
        if _tag(e) != "row":
            continue
        at = int(e.get("r") or at + 1)
        cells: list[tuple[str, str] | None] = []
        for c in e:
            if _tag(c) != "c":
                continue
            place = column_of(c.get("r")) if c.get("r") else len(cells)
            cells += [None] * (place + 1 - len(cells))
            kind, value = c.get("t") or "n", next((v.text for v in c if _tag(v) == "v"), None)
            if kind == "inlineStr":
                value = next((text_of(v) for v in c if _tag(v) == "is"), None)
            if value is None:
                continue
            if kind == "s":
                cells[place] = ("text", shared[int(value)])
            elif kind == "n" and int(c.get("s") or 0) in dates:
                cells[place] = ("date", date_of(float(value), from_1904))
            elif kind == "b":
                cells[place] = ("bool", "true" if value == "1" else "false")
            else:
                cells[place] = ({"n": "number", "d": "date", "e": "error"}.get(kind, "text"), value)
        e.clear()
        if any(c is not None and c[1] != "" for c in cells):
            yield at, cells


def rows(spark: SparkSession, path: str, sheets: list[int] | None = None) -> DataFrame:
    """path, sheet (from 0), name, row (from 1), cells of all workbooks at path, or of some of their sheets."""
    ship(spark)

    def apart(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in taken_apart(content):
                    if sheets is None or part[0] in sheets:
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((at, *part), (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], [f.split()[0] for f in PARTS.split(", ")])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                held: list[tuple] = []
                for at, cells in parsed(part["xml"], part["strings"], part["styles"], part["from_1904"]):
                    held.append((at, [None if c is None else {"kind": c[0], "value": c[1]} for c in cells]))
                    if len(held) == BATCH:
                        yield made(part, held)
                        held = []
                if held:
                    yield made(part, held)

    def made(part: dict, held: list[tuple]) -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array([part["path"]] * n), pa.array([part["sheet"]] * n, pa.int32()), pa.array([part["name"]] * n), pa.array([h[0] for h in held], pa.int32()), pa.array([h[1] for h in held], kind)], ["path", "sheet", "name", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.mapInArrow(apart, PARTS).repartition(n, "path", "sheet").mapInArrow(parse, ROWS)


def frame(one: DataFrame, header: list[str | None], numeric: list[bool], first: int) -> DataFrame:
    """The rows of one sheet below its first one as a frame, numbers where a column holds nothing else, cleaned."""
    value = lambda i: F.get("cells", F.lit(i))["value"]
    names = [h if h else f"Unnamed: {i}" for i, h in enumerate(header)]
    columns = [F.nullif(value(i), F.lit("")).cast("double" if number else "string").alias(f"c{i}") for i, number in enumerate(numeric)]
    return cleaning.from_sheet(one.where(F.col("row") > first).select(*columns).toDF(*names))


def overview(all_rows: DataFrame) -> DataFrame:
    """path, sheet, name, n (rows), first, header, numeric of each sheet: one row for each, from all cells."""
    wide = all_rows.groupBy("path", "sheet", "name").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.max(F.size("cells")).alias("width"), F.min_by("cells", "row").alias("top"))
    cells = all_rows.select("path", "sheet", "row", F.posexplode("cells").alias("at", "cell")).where("cell is not null and cell.value <> ''")
    below = cells.join(wide.select("path", "sheet", "first"), ["path", "sheet"]).where("row > first")
    kinds = below.groupBy("path", "sheet", "at").agg(F.bool_and(F.col("cell.kind") == "number").alias("number"))
    numbers = kinds.where("number").groupBy("path", "sheet").agg(F.collect_set("at").alias("numbers"))
    found = wide.join(numbers, ["path", "sheet"], "left")
    place = F.sequence(F.lit(0), F.col("width") - 1)
    return found.select("path", "sheet", "name", "n", "first", F.transform(place, lambda i: F.get("top", i)["value"]).alias("header"), F.transform(place, lambda i: F.coalesce(F.array_contains("numbers", i), F.lit(False))).alias("numeric"))


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of two rows or more by name, cleaned, in their order; each frame parses its own sheet only."""
    told = overview(rows(spark, path)).orderBy("path", "sheet").collect()  # a row for each sheet
    many = len({r.path for r in told}) > 1
    out = {}
    for r in told:
        if r.n >= 3:  # the header, and two more
            name = f"{posixpath.basename(r.path)}:{r.name}" if many else r.name
            out[name] = frame(rows(spark, r.path, [r.sheet]), list(r.header), list(r.numeric), r.first)
    return out
