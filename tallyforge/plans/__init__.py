"""Queries over the driver's tables, each with the SQL that it must equal."""

from . import agreements, checking, counting, naming, relating, streamed, texts
from .bind import Tables

_ALL = [*counting.QUERIES, *relating.QUERIES, *agreements.QUERIES, *texts.QUERIES, *streamed.QUERIES, *checking.QUERIES, *naming.QUERIES]
QUERIES = {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, f, _ in _ALL}
ORACLE_SQL = {name: sql for name, _, sql in _ALL if sql}
