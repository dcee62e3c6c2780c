"""Other inputs: tables in workbooks and Markdown, CSV with a byte-order mark, JSON that may be broken, rule books, folders."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sizelake.rules.evaluate import STORAGE, SUBSYSTEM, SYSTEM, Input, Rule


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; a byte-order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_json_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): objects of the schema, and the texts of what is none; nothing is dropped unseen. Files are read whole."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("raw"))
    parsed = raw.withColumn("v", F.from_json("raw", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    bad = F.col("v").isNull() | F.col("v._broken").isNotNull()
    return parsed.where(~bad).select("v.*").drop("_broken"), parsed.where(bad).select("raw")


#: A file of settings is small; what is longer is refused.
MOST_SETTINGS = 16_000_000


def read_whole(spark: SparkSession, path: str) -> str | None:
    """The text of one small file of any file system, without a byte-order mark; None if it is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    if fs.getFileStatus(p).getLen() > MOST_SETTINGS:
        raise ValueError(f"{path} is too long for a file of settings")
    return bytes(spark.read.format("binaryFile").load(path).first()["content"]).decode("utf-8-sig")


def read_overrides(spark: SparkSession, path: str) -> tuple[dict, str]:
    """A small override file as (values, error): an absent or broken file is an error text, never silently empty."""
    text = read_whole(spark, path)
    if text is None:
        return {}, f"{path} is not there"
    try:
        got = json.loads(text)
    except ValueError as e:
        return {}, f"{path}: {e}"
    return (got, "") if isinstance(got, dict) else ({}, f"{path} holds no object")


def read_markdown_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, cells) of the pipe tables in Markdown files, rule lines left out."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    t = t.where(F.trim("text").startswith("|") & ~F.col("text").rlike(r"^[|\s:\-]+$"))
    return t.select("file", "line", F.transform(F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)).alias("cells"))


def read_markdown_sections(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, section, subsection, item): list items under their second- and third-level headings. A file is small, so
    that its lines are folded as one array, without a window."""
    one = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("lines"))
    start = F.struct(F.lit("").alias("h2"), F.lit("").alias("h3"), F.array().cast("array<struct<line:int,section:string,subsection:string,item:string>>").alias("out"), F.lit(0).alias("n"))

    def step(a, line):
        h2, h3, item = F.regexp_extract(line, r"^##\s+(.+)$", 1), F.regexp_extract(line, r"^###\s+(.+)$", 1), F.regexp_extract(line, r"^\s*[-*]\s+(.+)$", 1)
        row = F.struct(a["n"].alias("line"), a["h2"].alias("section"), a["h3"].alias("subsection"), F.trim(item).alias("item"))
        return F.struct(
            F.when(h2 != "", F.trim(h2)).otherwise(a["h2"]).alias("h2"),
            F.when(h2 != "", "").when(h3 != "", F.trim(h3)).otherwise(a["h3"]).alias("h3"),
            F.when(item != "", F.concat(a["out"], F.array(row))).otherwise(a["out"]).alias("out"),
            (a["n"] + 1).alias("n"))

    return one.select("file", F.explode(F.aggregate("lines", start, step)["out"]).alias("r")).select("file", "r.*")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def read_workbooks(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """(file, row, cells) of a sheet of every workbook below a folder of any file system; what can't be read has no rows."""

    def read(batches):
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out += [(p, k, cells) for k, cells in enumerate(read_xlsx(io.BytesIO(content), sheet))]
                except (zipfile.BadZipFile, KeyError, ET.ParseError):
                    continue
            yield pd.DataFrame(out, columns=["file", "row", "cells"], dtype=object)

    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return f.where(~F.substring_index("path", "/", -1).startswith("~$")).mapInPandas(read, "file string, row int, cells array<string>")


def read_xlsx(source, sheet: int = 1) -> list[list[str]]:
    """The cells of a sheet (of a path or a file of bytes) as text, row by row; strings from the shared table, gaps as ''."""
    with zipfile.ZipFile(source) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        root = ET.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    out = []
    for row in root.iter(f"{{{_NS['m']}}}row"):
        cells: dict[int, str] = {}
        for c in row.findall("m:c", _NS):
            col = 0
            for ch in re.match(r"[A-Z]+", c.get("r") or "A")[0]:
                col = col * 26 + ord(ch) - 64
            v, inline = c.find("m:v", _NS), c.find("m:is", _NS)
            text = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else (v.text if v is not None else "") or ""
            cells[col - 1] = shared[int(text)] if c.get("t") == "s" and text else text
        out.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    return out


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """A rule book from YAML (where the library is there) or JSON: a list of objects, or an object with a list `rules`."""
    text = read_whole(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    try:
        book = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("a YAML rule book needs the yaml library; JSON is read without it") from e
        book = yaml.safe_load(text)
    rows = book["rules"] if isinstance(book, dict) else book
    scopes = {"system": SYSTEM, "subsystem": SUBSYSTEM, "subsystem_storage": STORAGE}
    strip = lambda x: x.strip() if isinstance(x, str) and x.strip() else None
    return [
        Rule(
            rule_id=r["id"], scope=scopes[r.get("scope", "system")], severity=r.get("severity", "major"), check=strip(r.get("check")), formula=strip(r.get("formula")), compare_with=strip(r.get("compare_with")),
            tolerance=float(r.get("tolerance") or 0), applies_when=strip(r.get("applies_when")), enabled=bool(r.get("enabled", True)), lookup_missing=bool(r.get("lookup_missing", False)), round=int(r.get("round", 2)),
            inputs=tuple(Input(i["name"], bool(i.get("required", True)), i.get("default")) for i in r.get("inputs") or ()),
        )
        for r in rows
    ]


def list_files(spark: SparkSession, folder: str, glob: str, exclude: str) -> DataFrame:
    """Files of a folder tree by name, without temporary ones and those whose name matches `exclude`."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return f.where(~name.startswith("~$") & ~F.lower(name).rlike(exclude)).select("path", name.alias("name"), "length", "modificationTime")
