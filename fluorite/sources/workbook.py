"""Tables in workbooks (XLSX): a zip archive of XML."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

# Namespaces of the format.
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(reference: str) -> int:
    """A1 is 0, B7 is 1, AA3 is 26."""
    n = 0
    for c in re.match("[A-Z]*", reference).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    """Plain or rich text; reading aids are left out."""
    return "".join(t.text or "" for part in [node, *node.findall(f"{SHEET}r")] for t in part.findall(f"{SHEET}t"))


def first_sheet_cells(content: bytes) -> list[tuple[int, int, str]]:
    """(row, column, text) of the first sheet's cells that aren't empty; rows from 1, columns from 0."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        wanted = book.find(f"{SHEET}sheets/{SHEET}sheet").get(RELATION)
        target = next(link.get("Target") for link in links if link.get("Id") == wanted)
        sheet = ElementTree.fromstring(z.read(posixpath.normpath(posixpath.join("/xl", target)).lstrip("/")))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{SHEET}si")]
    out, at_row = [], 0
    for row in sheet.iterfind(f"{SHEET}sheetData/{SHEET}row"):
        at_row, at = int(row.get("r", at_row + 1)), -1
        for cell in row.findall(f"{SHEET}c"):
            at = column_number(cell.get("r")) if cell.get("r") else at + 1
            value, inline = cell.find(f"{SHEET}v"), cell.find(f"{SHEET}is")
            if inline is not None:
                text = _text(inline)
            else:
                text = (value.text or "") if value is not None else ""
                if cell.get("t") == "s" and text:
                    text = shared[int(text)]
            if text:
                out.append((at_row, at, text))
    return out


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of one workbook: columns named by its first row, cells as strings, null where empty."""
    ship(spark)

    def cells(batches):
        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame(first_sheet_cells(content), columns=["row", "at", "value"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(cells, "row long, at int, value string")
    first = found.agg(F.min("row")).first()[0]
    if first is None:
        raise ValueError(f"the first sheet of {path} is empty")
    heads = found.where(F.col("row") == first).orderBy("at").collect()  # one row of a sheet
    rows = found.where(F.col("row") > first).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("cells"))
    return rows.select(*[F.try_element_at("cells", F.lit(h["at"])).alias(h["value"]) for h in heads])
