"""Registration of queries: a function on (spark, folder) and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions.columns import tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = _no_negative_zero(sql)
        return fn

    return register


def _no_negative_zero(sql: str) -> str:
    """Adds 0 to every rounded value, as tidy() does."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j = 0, i
        while True:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
            if sql[j - 1] == ")" and not depth:
                break
        out += sql[at:j] + " + 0e0"
        at = j
    return out + sql[at:]


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: tidy(F.col(n), digits) for n in names})
