"""All queries of the bill audit by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files, prices, rates, rules, tables, text
from .bindings import Tables

_ALL = {**rates.QUERIES, **rules.QUERIES, **prices.QUERIES, **text.QUERIES, **tables.QUERIES, **files.QUERIES}


def _on_folder(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(Tables(spark, folder))


QUERIES = {name: _on_folder(build) for name, (build, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
