"""Scans (S*): listings, texts, envelopes, reports, resume lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 10 * 1024 * 1024


def listing(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("pdf", "txt", "md"), recursive: bool = True) -> DataFrame:
    """Path, length, modificationTime of files by extension (any case); contents are not read."""
    glob = "*.{" + ",".join(x for e in extensions for x in {e, e.upper()}) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).load(folder)
    return files.select("path", "length", "modificationTime").dropDuplicates(["path"])


def texts(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("txt", "md", "mmd"), limit: int | None = None) -> DataFrame:
    """Path and text of text files; malformed bytes are replaced; at most `limit` characters."""
    glob = "*.{" + ",".join(extensions) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    if not limit:
        return files.select("path", decoded_text(F.col("content")).alias("text"))
    # so many characters have at most four times as many bytes, and only a character after them can be cut there
    return files.select("path", F.substring(decoded_text(F.substring("content", 1, 4 * limit)), 1, limit).alias("text"))


def decoded_text(content: Column) -> Column:
    """UTF-8 with replacement of malformed input (the built-in decoder fails on it)."""
    return F.make_valid_utf8(content.cast("string"))


def is_valid_file(path: Column, length: Column, extensions: tuple[str, ...] = (".txt", ".pdf"), most: int = MAX_BYTES) -> Column:
    """S06."""
    low = F.lower(path)
    named = F.lit(False)
    for e in extensions:
        named = named | low.endswith(e)
    return named & (length <= most)


def verdict(content: Column) -> Column:
    """Empty, too small (under 100 bytes), bad header, or ok."""
    n = F.octet_length(content)
    return F.when(n == 0, "empty").when(n < 100, "too small").when(F.substring(content, 1, 5) != F.encode(F.lit("%PDF-"), "UTF-8"), "bad header").otherwise("ok")


def pdf_texts(files: DataFrame) -> DataFrame:
    """Path, text and pages of PDF files, where a reader is installed (none is required)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages] if PdfReader else []
                    error = None if PdfReader else "no reader"
                except Exception as e:
                    pages, error = [], type(e).__name__
                rows.append((path, "\n\n".join(p for p in pages if p.strip()) or None, len(pages), error))
            yield pd.DataFrame(rows, columns=["path", "text", "pages", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, pages int, error string")


def read_question_sets(spark: SparkSession, paths: list[str], schema: str = "question string, answer string, text string, type string") -> DataFrame:
    """JSON lists of several files as one table; files that hold no list are left out."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return read_lists(raw, schema)


def read_lists(raw: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON arrays (value), with their place; texts that are no array give none."""
    rows = F.from_json(F.when(F.trim("value").startswith("["), F.col("value")), f"array<struct<{_fields(schema)}>>")
    keep = [c for c in raw.columns if c != "value"]
    return raw.select(*keep, F.posexplode(rows).alias("pos", "row_")).select(*keep, "pos", "row_.*")


def read_envelopes(raw: DataFrame, schema: str, field: str = "results", required: bool = False) -> DataFrame:
    """Rows of ``{..., field: [...]}`` or of a plain list; with `required`, only of envelopes."""
    inner = f"array<struct<{_fields(schema)}>>"
    value = F.trim("value")
    rows = F.from_json(value, f"struct<{field}:{inner}>")[field]
    if not required:
        rows = F.coalesce(rows, F.from_json(F.when(value.startswith("["), value), inner))
    keep = [c for c in raw.columns if c != "value"]
    return raw.select(*keep, F.posexplode(rows).alias("pos", "row_")).select(*keep, "pos", "row_.*")


def _fields(schema: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ", 1) for x in schema.split(",")))


def repaired_objects(value: Column) -> Column:
    """Objects written one after another become a JSON array."""
    body = F.regexp_replace(F.trim(value), r"\}\s*,?\s*\{", "},{")
    body = F.regexp_replace(F.regexp_replace(body, r"^\[|\]$", ""), r",\s*$", "")
    return F.concat(F.lit("["), body, F.lit("]"))


def report_fields(reports: DataFrame, name: str, text: str, keys: tuple[str, ...]) -> DataFrame:
    """One column per key of ``KEY: value`` lines; the last line of a key counts."""
    lines = reports.select(name, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    found = lines.select(name, "pos", F.trim(F.regexp_extract("line", r"^\s*([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract("line", r"^[^:]+:\s*(.*)$", 1)).alias("v")).where(F.col("k").isin(*keys))
    return found.groupBy(name).agg(*(F.max_by(F.when(F.col("k") == k, F.col("v")), F.when(F.col("k") == k, F.col("pos"))).alias(k) for k in keys))


def unprocessed(df: DataFrame, key: str, resume: DataFrame) -> DataFrame:
    """Rows whose key is in no line of a resume list."""
    return df.join(resume.select(F.trim("value").alias(key)).distinct(), key, "left_anti")


def cached(df: DataFrame, key: str, text: str, model: str, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their cached value (by key, text hash and model), and rows without."""
    named = df.withColumns({"text_hash": F.sha2(text, 256), "model": F.lit(model)})
    on = [key, "text_hash", "model"]
    return named.join(cache, on), named.join(cache, on, "left_anti")


def pdf_structure(files: DataFrame) -> DataFrame:
    """Path, valid, encrypted, scanned, parsable, pages and error of PDF files, from the bytes: header, end mark,
    /Encrypt in a trailer, page objects, and text-showing operators in plain or deflated streams (a scan has none). What a
    PDF library finds beyond that is pdf_texts()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *structure(bytes(c) if c is not None else b"")) for p, c in zip(b["path"], b["content"], strict=True)], columns=["path", "valid", "encrypted", "scanned", "parsable", "pages", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, valid boolean, encrypted boolean, scanned boolean, parsable boolean, pages int, error string")


def structure(data: bytes) -> tuple[bool, bool, bool, bool, int, str | None]:
    """valid, encrypted, scanned, parsable (neither), pages, error of one file's bytes."""
    import re
    import zlib

    if not data.startswith(b"%PDF-"):
        return False, False, False, False, 0, "bad header"
    pages = len(re.findall(rb"/Type\s*/Page\b(?!s)", data))
    encrypted = b"/Encrypt" in data
    if b"%%EOF" not in data[-2048:]:
        return False, encrypted, False, False, pages, "no end mark"
    shown = re.compile(rb"\)\s*Tj|\]\s*TJ|>\s*Tj")
    text = bool(shown.search(data))
    for m in re.finditer(rb"stream\r?\n(.*?)endstream", data, re.DOTALL) if not (text or encrypted) else ():
        try:
            text = text or bool(shown.search(zlib.decompressobj().decompress(m.group(1))))
        except zlib.error:
            continue
    scanned = not encrypted and not text
    return pages > 0, encrypted, scanned, pages > 0 and not encrypted and not scanned, pages, None if pages else "no pages"


def validated(files: DataFrame, mode: str = "full") -> DataFrame:
    """Path and state of files: ``quick`` looks at the basic checks alone, ``full`` at the structure of those that
    pass them. States: the basic verdict, invalid, encrypted, scanned or good; K23 sorts files by it."""
    basic = files.withColumn("basic", verdict(F.col("content")))
    if mode == "quick":
        return basic.select("path", F.when(F.col("basic") == "ok", "good").otherwise(F.col("basic")).alias("state"))
    deep = pdf_structure(basic.where("basic = 'ok'"))
    state = F.when(~F.col("valid"), "invalid").when(F.col("encrypted"), "encrypted").when(F.col("scanned"), "scanned").otherwise("good")
    return deep.select("path", state.alias("state")).union(basic.where("basic <> 'ok'").select("path", F.col("basic").alias("state")))


def registry(text: str, environment: dict[str, str]) -> list[dict[str, str]]:
    """Models of a YAML list of flat maps (``- shortname: x`` and indented ``key: value`` lines); ${NAME} takes the
    value of the environment, and a model whose name is unset there keeps the text as it stands."""
    import re

    out: list[dict[str, str]] = []
    for line in text.splitlines():
        m = re.match(r"^\s*(-\s+)?([A-Za-z_][\w-]*):\s*(.*?)\s*$", line)
        if not m or line.lstrip().startswith("#") or not m.group(3):
            continue
        if m.group(1):
            out.append({})
        if out:
            value = m.group(3).strip("\"'")
            out[-1][m.group(2)] = re.sub(r"^\$\{(\w+)\}$", lambda x: environment.get(x.group(1), x.group(0)), value)
    return out


def guidance(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """Texts by name; a file that is missing is an empty text."""
    out = {}
    for name, path in paths.items():
        rows = texts_or_none(spark, path)
        out[name] = rows or ""
    return out


def texts_or_none(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    return rows[0]["value"] if rows else None


def downloads(urls: DataFrame, fetch, least: int = 100) -> DataFrame:
    """Url, content, state of a column of URLs: fetch(url) gives bytes; a fetch that fails gives its error, and bytes
    that are no PDF are not kept. Contents land in a table, which a sink moves as a whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url in b["url"]:
                try:
                    data = fetch(url)
                    ok = len(data) >= least and data.startswith(b"%PDF-")
                    rows.append((url, data if ok else None, "ok" if ok else "no pdf"))
                except Exception as e:
                    rows.append((url, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["url", "content", "state"])

    return urls.select("url").mapInPandas(run, "url string, content binary, state string")
