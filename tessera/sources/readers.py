"""Readers of office documents, source trees and reports: binary files in, rows out.

Files are listed and read by Spark, so any store that it reads will do; a task parses one file
at a time. A file that can't be read is a row with an ``error`` instead of cells.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The ceilings for office files.
MOST_FILE_BYTES = 50 * 1024 * 1024
MOST_ENTRIES = 10_000
MOST_UNZIPPED_BYTES = 200 * 1024 * 1024

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, content)`` of the files below ``path`` whose names fit the glob."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "content")


def _parsed(files: DataFrame, parse: Callable[[bytes], Iterator[dict]], fields: dict[str, str]) -> DataFrame:
    """Rows of ``parse`` for each file, with its ``path`` and an ``error`` (null if it was read)."""
    names = list(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [{"path": path, **r, "error": None} for r in parse(content)]
                except (ValueError, KeyError, SyntaxError, zipfile.BadZipFile) as failed:
                    rows = [{"path": path, "error": f"{type(failed).__name__}: {failed}"}]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", *names, "error"]).astype(object)

    schema = ", ".join(["path string", *[f"`{n}` {t}" for n, t in fields.items()], "error string"])
    return files.mapInPandas(run, schema)


def _opened(content: bytes) -> zipfile.ZipFile:
    if len(content) > MOST_FILE_BYTES:
        raise ValueError("the file is too large")
    archive = zipfile.ZipFile(io.BytesIO(content))
    entries = archive.infolist()
    if len(entries) > MOST_ENTRIES or sum(e.file_size for e in entries) > MOST_UNZIPPED_BYTES:
        raise ValueError("the archive is too large when unzipped")
    if any(e.flag_bits & 1 for e in entries):
        raise ValueError("the archive is encrypted")
    if any(e.filename.startswith("/") or "\\" in e.filename or ".." in e.filename.split("/") for e in entries):
        raise ValueError("an entry of the archive leaves it")
    return archive


def _column(reference: str) -> int:
    number = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        number = number * 26 + ord(c) - 64
    return number


def _sheet_cells(content: bytes) -> Iterator[dict]:
    archive = _opened(content)
    names = set(archive.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
        shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in root.iter(f"{_SHEET}si")]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
        target = targets[sheet.get(f"{_REL}id")].lstrip("/")
        root = ElementTree.fromstring(archive.read(target if target.startswith("xl/") else f"xl/{target}"))
        for cell in root.iter(f"{_SHEET}c"):
            kind, value = cell.get("t"), cell.findtext(f"{_SHEET}v")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
            elif kind == "s" and value is not None:
                value = shared[int(value)]
            elif kind == "b" and value is not None:
                value = "true" if value == "1" else "false"
            elif value is not None and re.fullmatch(r"-?\d+\.0+", value):
                value = value.split(".")[0]
            if value is not None:
                reference = cell.get("r")
                yield {"sheet": sheet.get("name"), "row": int(re.search(r"\d+", reference)[0]), "col": _column(reference), "ref": reference, "value": value}


def read_xlsx_cells(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sheet, row, col, ref, value, error)`` of every cell with a value."""
    return _parsed(binary_files(spark, path, "*.xlsx"), _sheet_cells, {"sheet": "string", "row": "int", "col": "int", "ref": "string", "value": "string"})


def sheet_records(cells: DataFrame, header_row: int = 1) -> DataFrame:
    """``(path, sheet, row, name, value, source_ref)``: cells below a header, named by it."""
    good = cells.filter("error is null")
    header = good.filter(F.col("row") == header_row).select("path", "sheet", "col", F.trim("value").alias("name"))
    body = good.filter(F.col("row") > header_row).join(header, ["path", "sheet", "col"])
    name = F.element_at(F.split("path", "/"), -1)
    return body.select("path", "sheet", "row", "name", "value", F.concat(name, F.lit("#"), "sheet", F.lit("!"), "ref").alias("source_ref"))


def _paragraphs(content: bytes) -> Iterator[dict]:
    root = ElementTree.fromstring(_opened(content).read("word/document.xml"))
    for ordinal, p in enumerate(root.iter(f"{_WORD}p")):
        style = p.find(f"{_WORD}pPr/{_WORD}pStyle")
        text = "".join((t.text or "") if t.tag == f"{_WORD}t" else "\t" for t in p.iter() if t.tag in (f"{_WORD}t", f"{_WORD}tab"))
        if text.strip():
            yield {"ordinal": ordinal, "style": None if style is None else style.get(f"{_WORD}val"), "text": text}


def read_docx_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """``(path, ordinal, style, text, error)`` of every paragraph with text."""
    return _parsed(binary_files(spark, path, "*.docx"), _paragraphs, {"ordinal": "int", "style": "string", "text": "string"})


def _table_cells(content: bytes) -> Iterator[dict]:
    root = ElementTree.fromstring(_opened(content).read("word/document.xml"))
    for table, element in enumerate(root.iter(f"{_WORD}tbl"), 1):
        for row, tr in enumerate(element.findall(f"{_WORD}tr"), 1):
            for col, tc in enumerate(tr.findall(f"{_WORD}tc"), 1):
                text = "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in tc.findall(f"{_WORD}p")).strip()
                if text:
                    yield {"sheet": f"table {table}", "row": row, "col": col, "ref": f"R{row}C{col}", "value": text}


def read_docx_tables(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sheet, row, col, ref, value, error)`` of every table cell with text, as sheets named after the table's place."""
    return _parsed(binary_files(spark, path, "*.docx"), _table_cells, {"sheet": "string", "row": "int", "col": "int", "ref": "string", "value": "string"})


#: Readers of cells by file ending.
CELL_READERS = {".xlsx": read_xlsx_cells, ".docx": read_docx_tables}


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all documents below ``path`` whose ending has a reader, with that ``ending``."""
    rows = None
    for ending, read in sorted(CELL_READERS.items()):
        part = read(spark, path).withColumn("ending", F.lit(ending))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def sheet_signals(cells: DataFrame, most_rows: int = 500, most_columns: int = 100) -> DataFrame:
    """``(path, sheet, file_name, first_row, terms)``: what tells a document's kind, from the first rows and columns of each sheet.

    The bounds are those of the signal, not of the records; ``terms`` are the different values, in order.
    """
    some = cells.filter((F.col("row") <= most_rows) & (F.col("col") <= most_columns) & (F.trim(F.coalesce("value", F.lit(""))) != ""))
    name = F.element_at(F.split("path", "/"), -1)
    first = F.min("row").over(Window.partitionBy("path", "sheet"))
    rows = some.withColumn("_first", first)
    head = F.array_sort(F.collect_list(F.when(F.col("row") == F.col("_first"), F.struct("col", F.trim("value").alias("v")))))
    out = rows.groupBy("path", "sheet").agg(head.alias("h"), F.array_sort(F.collect_set(F.trim("value"))).alias("terms"))
    return out.select("path", "sheet", name.alias("file_name"), F.transform("h", lambda x: x["v"]).alias("first_row"), "terms")


def read_coverage_json(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, covered)`` of JSON coverage reports with executed and missing lines by file."""
    kind = "files map<string, struct<executed_lines:array<int>, missing_lines:array<int>>>"
    files = binary_files(spark, path, "*.json").select(F.from_json(F.col("content").cast("string"), kind).alias("r")).select(F.explode("r.files").alias("file", "f"))
    each = lambda lines, covered: F.transform(F.coalesce(lines, F.array().cast("array<int>")), lambda n: F.struct(n.alias("line"), F.lit(covered).alias("covered")))
    lines = files.select("file", F.inline(F.concat(each(F.col("f.executed_lines"), True), each(F.col("f.missing_lines"), False))))
    return lines.groupBy("file", "line").agg(F.bool_or("covered").alias("covered"))


def coverage_lines(lcov: DataFrame | None = None, jacoco: DataFrame | None = None, coverage_json: DataFrame | None = None) -> DataFrame:
    """``(file, line, covered)`` of reports of any kind: a line is executable if one names it, covered if one ran it."""
    parts = []
    if lcov is not None:
        parts.append(lcov.select("file", "line", (F.col("hits") > 0).alias("covered")))
    if jacoco is not None:
        parts.append(jacoco.filter("error is null").select("file", "line", (F.col("covered") > 0).alias("covered")))
    if coverage_json is not None:
        parts.append(coverage_json.select("file", "line", "covered"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("file", "line").agg(F.bool_or("covered").alias("covered"))


def read_lcov(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, hits)`` of LCOV tracefiles; a line reported more than once has its hits summed."""
    lines = binary_files(spark, path, "*.info").select(F.posexplode(F.split(F.col("content").cast("string"), r"\r?\n")).alias("pos", "text"), "path")
    tagged = lines.withColumn("file", F.when(F.col("text").startswith("SF:"), F.substring("text", 4, 1 << 20)))
    upto = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    found = tagged.withColumn("file", F.last("file", ignorenulls=True).over(upto)).filter(F.col("text").startswith("DA:"))
    parts = F.split(F.substring("text", 4, 64), ",")
    return found.select("file", parts[0].cast("int").alias("line"), parts[1].cast("long").alias("hits")).groupBy("file", "line").agg(F.sum("hits").alias("hits"))


def _jacoco_lines(content: bytes) -> Iterator[dict]:
    text = re.sub(rb"<!DOCTYPE[^>]*>", b"", content)
    for package in ElementTree.fromstring(text).iter("package"):
        for source in package.iter("sourcefile"):
            for line in source.iter("line"):
                yield {"file": f"{package.get('name')}/{source.get('name')}", "line": int(line.get("nr")), "missed": int(line.get("mi")), "covered": int(line.get("ci"))}


def read_jacoco(spark: SparkSession, path: str) -> DataFrame:
    """``(path, file, line, missed, covered, error)`` of XML coverage reports."""
    return _parsed(binary_files(spark, path, "*.xml"), _jacoco_lines, {"file": "string", "line": "int", "missed": "int", "covered": "int"})


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """``(path, name, value, line)`` of ``.properties`` files: comments go, continued lines are joined, later values win. ``line``: where it begins."""
    content = F.regexp_replace(F.col("content").cast("string"), r"\\\r?\n[ \t]*", "\u0001")
    lines = binary_files(spark, path, "*.properties").select("path", F.posexplode(F.split(content, r"\r?\n")).alias("pos", "line"))
    joined = F.length("line") - F.length(F.replace("line", F.lit("\u0001"), F.lit("")))
    before = F.sum(joined).over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("at", (F.col("pos") + 1 + F.coalesce(before, F.lit(0))).cast("int")).withColumn("line", F.replace("line", F.lit("\u0001"), F.lit("")))
    wanted = lines.filter(~F.col("line").rlike(r"^\s*([#!]|$)"))
    name, value = (F.regexp_extract("line", r"^\s*([^=:\s]+)\s*[=:\s]\s*(.*?)\s*$", g) for g in (1, 2))
    return wanted.filter(name != "").groupBy("path", name.alias("name")).agg(F.max_by(value, F.col("pos")).alias("value"), F.max_by("at", "pos").alias("line"))


#: Languages by file ending.
LANGUAGES = {"java": "java", "kt": "kotlin", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "sql": "sql", "xml": "xml", "jsp": "jsp"}


def read_source_tree(spark: SparkSession, path: str) -> DataFrame:
    """``(path, language, role, content_hash, text)`` of source files; tests are told from their path."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    language = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.when(ending.isin(*LANGUAGES), ending))
    role = F.when(F.lower("path").rlike(r"(^|/)(tests?|__tests__|spec)/|[._-](test|spec)\.[a-z]+$|test\.java$"), "test").otherwise("source")
    files = binary_files(spark, path).withColumn("language", language).filter("language is not null")
    return files.select("path", "language", role.alias("role"), F.sha2("content", 256).alias("content_hash"), F.col("content").cast("string").alias("text"))


def tree_digest(files: DataFrame, parts: int = 64) -> DataFrame:
    """One row: a digest of sorted paths and content hashes, folded in ``parts`` ranges of the path hash."""
    rows = files.select(F.pmod(F.xxhash64("path"), F.lit(parts)).alias("part"), F.struct("path", "content_hash").alias("f"))
    per = rows.groupBy("part").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("f"))), 256).alias("d"))
    return per.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("part", "d")))), 256).alias("digest"), F.count("*").alias("parts"))
