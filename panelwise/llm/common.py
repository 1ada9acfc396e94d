"""Helpers that several operators share: words, row keys, stored intermediate tables, checked broadcasts."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelwise.sources.storage import remove, shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# What stands between words: every ASCII character but letters and digits.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A broadcast side may have so many rows of at most some 50 bytes each.
BROADCAST_ROWS = 200_000


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, lower-cased in A-Z; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def text_key(text: Column) -> Column:
    """Hash that tells rows apart which share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


# Folders written since the innermost ``condensed`` began.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def stored(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: a lost executor re-reads files, and nothing is computed twice."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def condensed(build: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of ``build``. The tables it stored on its way are deleted once the result is written."""
    token = _WRITTEN.set([])
    try:
        rows = build()
        own = _WRITTEN.get()
    finally:
        _WRITTEN.reset(token)
    out = stored(rows)
    for path in own:
        remove(rows.sparkSession, path)
    return out


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of a Python task; what it has freed goes back to the system at its end, as idle workers would keep it."""
    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            give_back(0)

    return whole


def broadcast_checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side of narrow, fixed-width rows if a count shows that it is small; else Spark picks a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    """Join condition on equal columns, nulls being equal to nulls."""
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out
