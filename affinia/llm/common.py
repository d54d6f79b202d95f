"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from affinia.sources.shared import free, mark, scratch, written

__all__ = ["ARROW_ROWS", "Memo", "documents", "free", "mark", "release", "releases", "scratch", "table", "tokenizer_path", "wide_rows", "written"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in a batch between Spark and Python: whole texts and shingle sets are wide.
ARROW_ROWS = 1000


def wide_rows(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches are held to ARROW_ROWS rows: batches are buffered off-heap on
    one side and in the worker on the other, so their size bounds memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= ARROW_ROWS:
        df.sparkSession.conf.set(key, str(ARROW_ROWS))
    return df


#: What drops the memory that a worker process holds beyond its tasks.
_RELEASES: list[Callable] = []


def releases(drop: Callable) -> None:
    """Name a function for ``release``."""
    _RELEASES.append(drop)


def release() -> None:
    """Drop what earlier tasks left in this process for tasks of their kind. Workers serve all stages of a session,
    so a stage that has no use for it calls this first; results don't change."""
    for drop in _RELEASES:
        drop()


class Memo(dict):
    """A dict that computes what it lacks and starts anew beyond a number of entries.

    Keys longer than ``longest`` are computed each time, so that memory stays bounded.
    """

    def __init__(self, compute: Callable, entries: int = 300_000, longest: int = 64):
        super().__init__()
        self.compute, self.entries, self.longest = compute, entries, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


def tokenizer_path(name: str) -> str:
    """Path of a vocabulary file among the installed public tokenizers."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
