"""Sources. Paths are opened by Spark unless a format has no Spark reader; those files are small reference files."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..operators.relations import GateError

#: Texts that a raw scan reads as null.
NULL_TOKENS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "#N/A")


def _strings(columns: list[str]) -> Ty.StructType:
    return Ty.StructType([Ty.StructField(c, Ty.StringType()) for c in columns])


def csv(spark: SparkSession, path: str, columns: list[str], null_tokens: tuple[str, ...] = ()) -> DataFrame:
    """All-string CSV with a byte order mark, quoted newlines and doubled quotes; null_tokens become null."""
    df = spark.read.schema(_strings(columns)).csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    return df.select(*[F.when(~F.trim(c).isin(*null_tokens), F.col(c)).alias(c) for c in columns]) if null_tokens else df


def csv_exact(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """CSV whose header must be exactly this list, in order."""
    found = spark.read.csv(path, header=True, multiLine=True, escape='"').columns
    if found != header:
        raise GateError(f"header {found}, expected {header}")
    return csv(spark, path, header)


def facets(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """Facet CSV; a missing file or key gives an empty frame of the same columns; repeated keys keep one row."""
    try:
        found = spark.read.csv(path, header=True, multiLine=True, escape='"')
    except Exception as e:  # noqa: BLE001  a missing path is an expected state
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = None
    if found is None or key not in found.columns:
        return spark.createDataFrame([], _strings([key, *columns]))
    have = [c for c in columns if c in found.columns]
    rows = found.groupBy(key).agg(*[F.min_by(c, F.struct(*[F.coalesce(x, F.lit("")) for x in found.columns])).alias(c) for c in have]) if have else found.select(key).distinct()
    return rows.select(key, *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])


def snapshot_path(manifest: dict, reference: str) -> str:
    """Path of a snapshot named by id, either hash, or a pointer such as 'current'; unknown names raise."""
    name = manifest.get("pointers", {}).get(reference, reference)
    name = name.get("snapshot_id") if isinstance(name, dict) else name
    hits = [s for s in manifest.get("content_snapshots", []) if name in (s.get("snapshot_id"), s.get("raw_sha256"), s.get("csv_sha256"))]
    if len(hits) != 1:
        raise GateError(f"{len(hits)} snapshots for {reference!r}")
    return hits[0]["path"]


def canonical_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files with line ends made LF before hashing."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2(text, 256).alias("sha256"))


def xlsx(spark: SparkSession, data: bytes, sheet_words: tuple[str, ...] = ()) -> DataFrame:
    """A worksheet as strings: the first sheet named by a keyword, else the first; header = first row with three texts.

    Read from the package's XML; empty rows and columns are dropped, columns without a name are numbered.
    """
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheets = ET.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", ns)
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        chosen = next((s for s in sheets if any(w in s.get("name", "").lower() for w in sheet_words)), sheets[0])
        target = links[chosen.get(f"{{{ns['r']}}}id")].lstrip("/")
        root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    grid = []
    for row in root.iter(f"{{{ns['m']}}}row"):
        cells: dict[int, str] = {}
        for c in row.findall("m:c", ns):
            n = 0
            for ch in re.match("[A-Z]+", c.get("r"))[0]:
                n = n * 26 + ord(ch) - 64
            value = c.find("m:v", ns)
            text = shared[int(value.text)] if c.get("t") == "s" else "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else value.text if value is not None else None
            if text not in (None, ""):
                cells[n - 1] = text
        grid.append(cells)
    head = next((i for i, r in enumerate(grid) if len(r) >= 3), 0)
    body = [r for r in grid[head + 1 :] if r]
    used = sorted({c for r in body for c in r} | set(grid[head])) if grid else []
    used = [c for c in used if any(c in r for r in body)] if body else used
    names = [grid[head].get(c, f"Column_{c + 1}") for c in used]
    return spark.createDataFrame([tuple(r.get(c) for c in used) for r in body], _strings(names))


def pages(fetch: Callable[[str], dict], first: str, limit: int = 100_000) -> Iterator[dict]:
    """Pages of a JSON service that name the next one; loops, repeated pages and changing totals raise."""
    url, seen, total, bodies, got = first, set(), None, set(), 0
    while url and len(seen) < limit:
        if url in seen:
            raise GateError(f"page loop at {url}")
        seen.add(url)
        page = fetch(url)
        meta = page.get("meta", {}).get("pagination", {})
        if total is None:
            total = meta.get("total")
        elif meta.get("total") != total:
            raise GateError("the total changes between pages")
        body = json.dumps(page.get("data"), sort_keys=True)
        if body in bodies and page.get("data"):
            raise GateError(f"repeated page at {url}")
        bodies.add(body)
        got += len(page.get("data", []))
        yield page
        url = meta.get("links", {}).get("next")
    if total is not None and got != total:
        raise GateError(f"{got} records of {total}")


def json_cache(spark: SparkSession, path: str, meta: dict[str, str], entry: str) -> DataFrame:
    """(id, entry fields) of a result cache; an unreadable file or other metadata gives an empty frame."""
    empty = spark.createDataFrame([], f"id string, {entry}")
    try:
        fields = ", ".join(f"{k}: string" for k in meta)
        raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"__meta__ struct<{fields}>, entries map<string, struct<{entry}>>").alias("c")).first()
    except Exception as e:  # noqa: BLE001  a missing cache is an expected state
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty
    c = raw["c"] if raw else None
    if c is None or c["__meta__"] is None or any(c["__meta__"][k] != v for k, v in meta.items()) or c["entries"] is None:
        return empty
    return spark.createDataFrame([(k, *tuple(v)) for k, v in sorted(c["entries"].items())], f"id string, {entry}")


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """One row of telemetry of a text log: summed token counters, retries, errors, and whether it has a traceback."""
    lines = spark.read.text(path)
    number = lambda p: F.coalesce(F.sum(F.try_to_number(F.nullif(F.regexp_extract("value", p, 1), F.lit("")), F.lit("999999999999"))), F.lit(0)).cast("long")
    return lines.agg(number(r"input_tokens[=: ]+(\d+)").alias("input_tokens"), number(r"output_tokens[=: ]+(\d+)").alias("output_tokens"), number(r"cache_read[a-z_]*[=: ]+(\d+)").alias("cache_read"), number(r"cache_creat[a-z_]*[=: ]+(\d+)").alias("cache_created"), F.count_if(F.col("value").rlike("(?i)retry")).alias("retries"), F.count_if(F.col("value").rlike(r"\bERROR\b")).alias("errors"), (F.count_if(F.col("value").startswith("Traceback")) > 0).alias("traceback"))


def dimension(spark: SparkSession, rows: list[dict], schema: str, key: str) -> DataFrame:
    """A reference list (as loaded from YAML or JSON) as a table; a row without its key raises."""
    if any(r.get(key) in (None, "") for r in rows):
        raise GateError(f"a row without {key}")
    fields = spark.createDataFrame([], schema).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields)


def with_defaults(defaults: dict[str, str], found: dict | None) -> dict[str, str]:
    """Settings: non-blank strings of found over defaults."""
    return defaults | {k: v for k, v in (found or {}).items() if isinstance(v, str) and v.strip()}


def dated(names: list[str], word: str = "project") -> str:
    """The file of the latest date in its name: DD-MM-YYYY, else month and year, else an upload path /YYYY/MM/."""
    months = "january february march april may june july august september october november december".split()

    def date(n: str) -> tuple | None:
        low = n.lower()
        if m := re.search(r"(\d{2})[-_.](\d{2})[-_.](\d{4})", low):
            return int(m[3]), int(m[2]), int(m[1])
        if m := re.search(rf"({'|'.join(months)})[-_ ]*(\d{{4}})", low):
            return int(m[2]), months.index(m[1]) + 1, 1
        if m := re.search(r"/(\d{4})/(\d{2})/", low):
            return int(m[1]), int(m[2]), 1
        return None

    kept = [n for n in dict.fromkeys(names) if word in n.lower()]
    if len(kept) == 1:
        return kept[0]
    if not kept or any(date(n) is None for n in kept):
        raise GateError("no name, or several of which some have no date")
    return max(kept, key=date)


def bundle(spark: SparkSession, folder: str, tables: dict[str, list[str]]) -> dict[str, tuple[DataFrame, bool]]:
    """Name -> (rows, available) of the CSV files of a folder; a missing file or column gives no rows and False."""
    out = {}
    for name, columns in tables.items():
        try:
            found = spark.read.csv(f"{folder}/{name}.csv", header=True, multiLine=True, escape='"')
        except Exception as e:  # noqa: BLE001  a missing path is an expected state
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = None
        ok = found is not None and set(columns) <= set(found.columns)
        out[name] = (found.select(*columns) if ok else spark.createDataFrame([], _strings(columns)), ok)
    return out
