"""The registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clausework.corpus import Corpus
from clausework.jobs import graphs, lists, profiles, readings, rules, shapes, terms, vocab, wording

AREAS = [rules, terms, readings, vocab, lists, profiles, shapes, wording, graphs]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for area in AREAS:
        for name, f in area.QUERIES.items():
            found[name] = lambda spark, sf_dir, f=f: f(Corpus(spark, sf_dir))
    return found


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.ORACLES.items()}
