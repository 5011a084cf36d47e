"""Sinks: flat CSV, content hashes, write-once and atomic files, reports."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relations import GateError


def flat(df: DataFrame, joiner: str = "; ") -> DataFrame:
    """Arrays joined to text, so that rows can be written as CSV."""
    return df.select(*[F.array_join(F.col(c).cast("array<string>"), joiner).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def csv_folder(df: DataFrame, path: str) -> None:
    """Distributed CSV: a folder of parts with header, quotes doubled."""
    flat(df).write.csv(path, header=True, escape='"')


def csv_bytes(df: DataFrame, order: list[str], limit: int = 1_000_000, bom: bool = True) -> bytes:
    """One deterministic CSV of a bounded table: ordered rows, LF line ends."""
    rows = flat(df).orderBy(*order).limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: use csv_folder")
    return (b"\xef\xbb\xbf" if bom else b"") + rows.to_csv(index=False, lineterminator="\n").encode()


def content_hash(df: DataFrame) -> DataFrame:
    """Order-free hash of all rows and their number, in one aggregate: equal tables have equal hashes."""
    row = F.xxhash64(*[F.to_json(F.struct(*df.columns))])
    return df.agg(F.count("*").alias("rows"), F.bit_xor(row).alias("xor"), F.sum(F.pmod(row, F.lit(2**31 - 1))).alias("sum"))


def write_once(path: str | Path, data: bytes) -> bool:
    """Writes a file that must not change: True if written, False if the same bytes are there; other bytes raise."""
    path = Path(path)
    if path.exists():
        if hashlib.sha256(path.read_bytes()).digest() != hashlib.sha256(data).digest():
            raise GateError(f"{path} has other content")
        return False
    replace(path, data)
    return True


def replace(path: str | Path, data: bytes) -> None:
    """Atomic: temporary file beside it, synced, renamed."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(fd, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)


def one_hot(df: DataFrame, key: str, sets: dict[str, list[str]]) -> DataFrame:
    """A 0/1 column for each label of each set column."""
    return df.select(key, *[F.array_contains(c, v).cast("int").alias(f"{c}: {v}") for c, labels in sets.items() for v in labels])


def markdown(df: DataFrame, order: list[str], limit: int = 200) -> str:
    """A bounded table as Markdown."""
    rows = df.orderBy(*order).limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def run_manifest(path: str | Path, **facts) -> None:
    replace(path, (json.dumps(facts, indent=2, sort_keys=True, default=str) + "\n").encode())


def header_only(df: DataFrame, columns: list[str]) -> None:
    """An output template has exactly these columns and no rows."""
    if df.columns != columns or not df.isEmpty():
        raise GateError("not an empty table of the expected columns")
