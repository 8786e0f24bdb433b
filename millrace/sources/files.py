"""File sources: routing by extension, recursive scans, text of each format; errors are data, not exceptions."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
from html import unescape
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.chunk import split_json
from millrace.functions.html import read_html
from millrace.functions.office import mht_to_text
from millrace.functions.tables import DOCUMENTS, CODE_LANGUAGES, IMAGES
from millrace.session import share_code


def extension(path: Column) -> Column:
    """Lower-case extension with no dot; empty where the name has none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def route(path: Column) -> Column:
    """image, code, the document's own kind, or null for what no parser takes."""
    ext = extension(path)
    code = [x[1:] for x in CODE_LANGUAGES]
    return F.when(ext.isin(*IMAGES), "image").when(ext.isin(*code), "code").when(ext.isin(*DOCUMENTS), ext)


def scan(spark, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of all files below ``path`` whose names have a dot."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.*").load(path)


def decode(raw: bytes) -> str:
    for name in ("utf-8-sig", "utf-8", "gbk"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def markdown_table(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    wide = max(map(len, rows))
    line = lambda r: "| " + " | ".join([*map(str, r), *[""] * (wide - len(r))]) + " |"
    return "\n".join([line(rows[0]), "|" + "---|" * wide, *map(line, rows[1:])])


def _parts(raw: bytes, pattern: str) -> list[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
        return [(n, z.read(n)) for n in names]


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def docx_text(raw: bytes) -> str:
    def paragraphs(xml: bytes) -> list[str]:
        out = []
        for p in ElementTree.fromstring(xml).iter():
            if _local(p) == "p":
                text = "".join("\t" if _local(t) == "tab" else "\n" if _local(t) == "br" else t.text or "" for t in p.iter() if _local(t) in ("t", "tab", "br"))
                if text.strip():
                    out.append(text)
        return out

    # Whole pages put into a document stand in parts of their own; then the body has little else.
    inside = [mht_to_text(x) for _, x in _parts(raw, r"word/.*\.(mht|mhtml|html?)")]
    body = [x for _, xml in _parts(raw, "word/document.xml") for x in paragraphs(xml)] + [x for x in inside if x]
    edges = list(dict.fromkeys(x for _, xml in _parts(raw, r"word/(header|footer)\d*\.xml") for x in paragraphs(xml)))
    notes = [x for _, xml in _parts(raw, r"word/comments\.xml") for x in paragraphs(xml)]
    found = [("", body), ("[Header/Footer]\n", edges), ("[Comments]\n", notes)]
    found = [(mark, x) for mark, x in found if x]
    return "\n\n".join((mark if len(found) > 1 else "") + "\n".join(x) for mark, x in found)


def pptx_text(raw: bytes) -> str:
    slides = []
    for _, xml in _parts(raw, r"ppt/slides/slide\d+\.xml"):
        slides.append("\n".join("".join(t.text or "" for t in p.iter() if _local(t) == "t") for p in ElementTree.fromstring(xml).iter() if _local(p) == "p"))
    return "\n".join(slides)


def xlsx_text(raw: bytes) -> str:
    shared = [["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in ElementTree.fromstring(x) if _local(si) == "si"] for _, x in _parts(raw, r"xl/sharedStrings\.xml")]
    strings = shared[0] if shared else []
    names = [e.get("name") for _, x in _parts(raw, r"xl/workbook\.xml") for e in ElementTree.fromstring(x).iter() if _local(e) == "sheet"]
    out = []
    for k, (_, xml) in enumerate(_parts(raw, r"xl/worksheets/sheet\d+\.xml")):
        rows = []
        for row in (e for e in ElementTree.fromstring(xml).iter() if _local(e) == "row"):
            cells: dict[int, str] = {}
            for n, c in enumerate(e for e in row if _local(e) == "c"):
                letters = re.match(r"[A-Z]*", c.get("r") or "")[0]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                value = "".join(t.text or "" for t in c.iter() if _local(t) in ("v", "t"))
                cells[at - 1 if at else n] = strings[int(value)] if c.get("t") == "s" and value else value
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        rows = [r for r in rows if any(r)]
        wide = max(map(len, rows), default=0)
        rows = [r + [""] * (wide - len(r)) for r in rows]
        used = [i for i in range(wide) if any(r[i] for r in rows)]
        name = names[k] if k < len(names) else f"Sheet{k + 1}"
        out.append(f"## Worksheet: {name}\n\n" + (markdown_table([[r[i] for i in used] for r in rows]) or "*This worksheet is empty*"))
    return "\n\n".join(out)


def _spine(z: zipfile.ZipFile) -> list[str]:
    """Names of a book's documents in reading order; all, by name, where the package doesn't say."""
    names = set(z.namelist())
    try:
        package = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if _local(e) == "rootfile")
        root, folder = ElementTree.fromstring(z.read(package)), posixpath.dirname(package)
        of = {e.get("id"): posixpath.normpath(posixpath.join(folder, unquote(e.get("href") or ""))) for e in root.iter() if _local(e) == "item"}
        found = [of[e.get("idref")] for e in root.iter() if _local(e) == "itemref" and of.get(e.get("idref")) in names]
    except (KeyError, StopIteration, ElementTree.ParseError):
        found = []
    return found or sorted(n for n in names if re.fullmatch(r".*\.x?html?", n))


def epub_text(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return "".join(read_html(decode(z.read(n)))["text"] for n in _spine(z)).replace("　", " ")


def html_markdown(raw: bytes) -> str:
    out = []
    for s in read_html(decode(raw))["sections"]:
        out += ["#" * max(1, s["level"]) + " " + s["header"]] * bool(s["header"]) + [s["body"], ""]
    return "\n".join(out).strip()


def json_text(raw: bytes) -> str:
    value = json.loads(decode(raw))
    try:
        return "\n".join(split_json(value))
    except RecursionError:
        return json.dumps(value, ensure_ascii=False, indent=2)


def csv_text(raw: bytes) -> str:
    return markdown_table([r for r in csv.reader(io.StringIO(decode(raw))) if r])


READERS = {"docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_text, "epub": epub_text, "html": html_markdown, "json": json_text, "csv": csv_text, "txt": decode, "md": decode, "code": decode}


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def read_content(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
    out = []
    for k, raw in zip(kind, content):
        try:
            out.append((READERS[k](bytes(raw)), None) if k in READERS else (None, f"no decoder for {k}"))
        except Exception as e:
            out.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(out, columns=["text", "error"])


def parse(files: DataFrame, run_time: str, domain: str = "Technology", purpose: str = "") -> DataFrame:
    """(path, extension, content, error, lifecycle) of files that some parser takes."""
    share_code(files.sparkSession)
    routed = files.withColumn("kind", route(F.col("path"))).where("kind is not null")
    read = routed.select("path", "length", extension(F.col("path")).alias("extension"), read_content("kind", "content").alias("r"))
    done = F.when(F.col("r.error").isNull(), F.array(F.lit("DATA_PROCESSING"), F.lit("DATA_PROCESSED"))).otherwise(F.array(F.lit("DATA_PROCESSING"), F.lit("DATA_PROCESS_FAILED")))
    entry = F.struct(
        F.lit(run_time).cast("timestamp").alias("update_time"), done.alias("life_type"),
        F.struct(F.col("length").alias("storage_size"), F.col("path").alias("source_file"), F.lit(domain).alias("domain"), F.lit(purpose).alias("usage_purpose")).alias("life_metadata"),
    )
    return read.select("path", "extension", F.col("r.text").alias("content"), F.col("r.error").alias("error"), F.array(entry).alias("lifecycle"))


def get_data(spark, source: str | list[str], run_time: str, domain: str = "Technology", purpose: str = "") -> DataFrame:
    """What ``parse`` gives of a file, a folder or a list of both, on any store that Spark reads; empty texts are dropped.

    In a list or a folder, files without a route are left out; a single file without
    one is an error. Paths keep their full names, so files of one name don't meet.
    """
    alone = isinstance(source, str) and re.search(r"[^/]\.[A-Za-z0-9]+$", source) is not None
    if alone and spark.createDataFrame([(source,)], "p string").where(route(F.col("p")).isNotNull()).isEmpty():
        raise ValueError(f"no parser for {source}")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.*").load(source)
    got = parse(found, run_time, domain, purpose)
    return got.where("error is not null or trim(content) <> ''")


def plain_entities(c: Column) -> Column:
    """The five common entities."""
    for name in ("&lt;", "&gt;", "&quot;", "&#39;", "&amp;"):
        c = F.replace(c, F.lit(name), F.lit(unescape(name)))
    return c
