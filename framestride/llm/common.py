"""Shared pieces of the training-data operators: column picking, scratch tables, text columns.

Every operator takes its input columns by exact name and position, so further
columns of any name (``Text`` beside ``text``, a column called ``size``, two
columns of one name) neither reach the result nor make a reference ambiguous.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framestride.storage import BROADCAST_ROWS, Scratch, shared_dir, small

__all__ = ["BROADCAST_ROWS", "NONWORD", "WS", "WS_CHARS", "Scratch", "guarded", "is_stored", "let", "lower_ascii", "pick", "shared_dir", "small", "table", "with_row_ids"]

#: White space that separates words: U+0020 and U+0009 to U+000D.
WS = "\\x20\\x09-\\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"
#: What stands between words of the letters-and-digits kind (all of ASCII but 0-9, a-z).
NONWORD = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"

#: ``file:///a`` and ``file:/a`` are one path.
NO_HOST = "^([A-Za-z][A-Za-z0-9+.-]*):///"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name (the first of equal ones)."""
    have = df.columns
    lost = [n for n in names if n not in have]
    if lost:
        raise ValueError(f"columns missing: {lost}; there are {have}")
    plain = df.toDF(*[f"_c{i}" for i in range(len(have))])
    return plain.select(*[F.col(f"_c{have.index(n)}").alias(n) for n in names])


def guarded(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """All columns as ``_c0, _c1, ...`` plus ``_<name>`` for each name; and the kept columns."""
    have = df.columns
    lost = [n for n in names if n not in have]
    if lost:
        raise ValueError(f"columns missing: {lost}; there are {have}")
    kept = [f"_c{i}" for i in range(len(have))]
    out = df.toDF(*kept).select("*", *[F.col(f"_c{have.index(n)}").alias(f"_{n}") for n in names])
    return out, kept


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """Text with A-Z lower-cased for matching ASCII words.

    ``lower`` changes other letters too, never into ASCII but for the Kelvin
    sign (U+212A), which is replaced first; word bounds stay where they were.
    """
    return F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))


def is_stored(docs: DataFrame) -> bool:
    """Whether ``docs`` is one Parquet table just as it is read: then file and place name each row once.

    Anything computed on top (which may repeat rows), a cached table, several paths and
    other formats are not.
    """
    if docs.is_cached:
        return False
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().location().rootPaths().length() == 1 and plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def with_row_ids(docs: DataFrame, scratch: Scratch, stored: bool, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` as ``guarded`` gives it, with ``_node``: a number of its own for each row.

    ``stored``: ``docs`` is a Parquet table as read (``is_stored``), whose rows keep their
    file and place; then nothing is written. Otherwise the numbered rows are saved first,
    so that later reads see the same numbers.
    """
    if stored and is_stored(docs):
        place = docs.metadataColumn("_metadata")
        # the files the driver has listed to plan the scan, one row for each
        files = sorted({re.sub(NO_HOST, r"\1:/", f) for f in docs.inputFiles()})
        number = docs.sparkSession.createDataFrame(list(enumerate(files)), "_no long, _file string") if files else docs.sparkSession.createDataFrame([], "_no long, _file string")
        have = docs.columns
        kept = [f"_c{i}" for i in range(len(have))]
        # by position, so no column of the table can be taken for the place
        rows = docs.select("*", place["file_path"], place["row_index"]).toDF(*kept, "_path", "_place")
        rows = rows.join(F.broadcast(number) if len(files) <= BROADCAST_ROWS else number, F.regexp_replace("_path", NO_HOST, "$1:/") == F.col("_file"), "left")
        node = F.shiftleft(F.coalesce("_no", F.raise_error(F.lit("a file that was not listed"))), 36) + F.col("_place")
        return rows.select(*kept, *[F.col(f"_c{have.index(n)}").alias(f"_{n}") for n in names], node.alias("_node")), kept
    rows, kept = guarded(docs, *names)
    rows = scratch.save(rows.select(*kept, F.monotonically_increasing_id().alias("_node")))
    return rows.select(*kept, *[F.col(f"_c{docs.columns.index(n)}").alias(f"_{n}") for n in names], "_node"), kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
