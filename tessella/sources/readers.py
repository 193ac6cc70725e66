"""Documents from files, and bundles of replicas: readers and writers."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import html_text

TEXT = ("md", "markdown", "txt", "rst", "log", "yaml", "yml", "toml", "ini", "cfg", "json", "jsonl", "csv", "tsv", "xml", "html", "htm", "py", "js", "ts", "java", "go", "rs", "c", "h", "cpp", "rb", "sh", "sql")
ZIPPED = ("docx", "odt", "pptx", "odp", "xlsx", "ods", "epub")
#: Files above this size are listed but not parsed (kind ``large``).
MOST_BYTES = 64 << 20


def _zip_text(data: bytes, kind: str) -> str:
    """Text of the XML parts of an office document or book, in the order of their names."""
    want = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "xlsx": r"xl/(?:sharedStrings|worksheets/sheet\d+)\.xml", "epub": r".*\.x?html?"}.get(kind, r"content\.xml")
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sorted(z.namelist(), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]):
            if re.fullmatch(want, name):
                try:
                    root = ElementTree.fromstring(z.read(name))
                except ElementTree.ParseError:
                    continue
                out.append(" ".join(t.strip() for t in root.itertext() if t.strip()))
    return "\n".join(out)


def _rtf_text(raw: str) -> str:
    raw = re.sub(r"\{\\\*[^{}]*\}", "", raw)
    raw = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), raw)
    raw = re.sub(r"\\(?:par|line)\b ?", "\n", raw).replace("\\~", " ")
    return re.sub(r"[{}]", "", re.sub(r"\\[a-z]+-?\d* ?", "", raw)).strip()


def parse_file(path: str, data: bytes) -> tuple[str, str]:
    """kind and text of one file; what cannot be read gives the kind ``unreadable``."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    try:
        if kind in ZIPPED:
            return kind, _zip_text(data, kind)
        raw = data.decode("utf-8", "replace")
        if kind == "rtf":
            return kind, _rtf_text(raw)
        if kind == "json":
            return kind, json.dumps(json.loads(raw), ensure_ascii=False, indent=1)
        return (kind, raw) if kind in TEXT else ("other", "")
    except (zipfile.BadZipFile, ValueError, KeyError, RecursionError):
        return "unreadable", ""


def scan_tree(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, kind, size, sha256 and text of every file below a folder; markup of pages is removed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parsed = [parse_file(p, c) if n <= MOST_BYTES else ("large", "") for p, c, n in zip(f["path"], f["content"], f["length"], strict=True)]
            yield pd.DataFrame({"path": f["path"], "kind": [k for k, _ in parsed], "size": f["length"], "sha256": f["sha256"], "text": [t for _, t in parsed]})

    rows = files.select("path", "length", F.sha2("content", 256).alias("sha256"), "content").mapInPandas(run, "path string, kind string, size long, sha256 string, text string")
    return rows.withColumn("text", F.when(F.col("kind").isin("html", "htm"), html_text(F.col("text"))).otherwise(F.col("text")))


def notes(files: DataFrame) -> DataFrame:
    """Front matter, links, tags and attachments of Markdown notes, by expressions alone."""
    t = F.col("text")
    front = F.regexp_extract(t, "(?s)^---\\n(.*?)\\n---\\n", 1)
    body = F.regexp_replace(t, "(?s)^---\\n.*?\\n---\\n", "")
    return files.filter(F.col("kind").isin("md", "markdown")).select(
        "path", front.alias("front_matter"), body.alias("body"),
        F.regexp_extract_all(body, F.lit("(?<!!)\\[\\[([^\\]|#]+)"), F.lit(1)).alias("links"),
        F.regexp_extract_all(body, F.lit("!\\[\\[([^\\]|]+)"), F.lit(1)).alias("attachments"),
        F.regexp_extract_all(body, F.lit("(?:^|\\s)#([\\p{L}\\p{N}_/-]+)"), F.lit(1)).alias("tags"),
    )


SYMBOL = r"(?m)^[ \t]*(?:export\s+)?(?:public\s+|private\s+|static\s+|async\s+)*(def|class|function|func|fn|interface|struct)\s+([A-Za-z_]\w*)"


def symbols(files: DataFrame) -> DataFrame:
    """path, kind and name of the symbols that source files define, and calls (name followed by a bracket)."""
    kinds, names = (F.regexp_extract_all("text", F.lit(SYMBOL), F.lit(i)) for i in (1, 2))
    return files.select("path", F.inline(F.arrays_zip(kinds.alias("kind"), names.alias("name"))))


def calls(files: DataFrame, defined: DataFrame) -> DataFrame:
    """path, name: which file calls which defined symbol; tokens meet by an equi-join."""
    used = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z_]\\w*)\\s*\\("), F.lit(1)))).alias("name"))
    return used.join(defined.select("name").distinct(), "name", "left_semi")


def write_bundle(rows: DataFrame, path: str, device: str) -> None:
    """A replica's rows as JSON lines in its own folder of the shared one."""
    rows.write.mode("overwrite").json(f"{path.rstrip('/')}/device={device}")


def read_bundles(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all replicas, with their device."""
    return spark.read.schema(schema).json(path)
