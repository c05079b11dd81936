"""Helpers the operators share: the shared folder, written intermediates, checked broadcasts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.sources.shared import BROADCAST_ROWS, cleared, few, new_folder, null_safe_join, run_folder, running, small, written

__all__ = ["BROADCAST_ROWS", "LONG", "WORD", "cleared", "few", "lowered", "new_folder", "null_safe_join", "partitions", "run_folder", "running", "sliced", "small", "spaced", "store", "text_or_empty", "words_of", "written"]

#: A word: a run of anything but the ASCII space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(rb"[^ \t-\r]+")
#: Bytes from which a text is no longer held word by word.
LONG = 1_000_000


def lowered(text: str | None) -> bytes:
    """A text's UTF-8 with A-Z lower-cased; a null text is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def words_of(raw: bytes) -> Iterable[bytes]:
    """The words of some bytes: as a list, or of a long text one after another."""
    return raw.split() if len(raw) < LONG else (m[0] for m in _WORDS.finditer(raw))


def spaced(text: str | None) -> bytes:
    """The words of a text, with A-Z lower-cased, between single spaces.  Words end at ASCII white space only."""
    raw = lowered(text)
    if len(raw) < LONG:
        return b" ".join(raw.split())
    letters = np.frombuffer(raw, np.uint8)
    blank = (letters == 32) | ((letters >= 9) & (letters <= 13))
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    return np.where(blank, np.uint8(32), letters)[keep].tobytes().strip(b" ")


@cache
def store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder and the folder's path in it, for workers that read or write files of their own."""
    return pyarrow.fs.FileSystem.from_uri(folder) if ":/" in folder else (pyarrow.fs.LocalFileSystem(), folder)


def sliced(batches: Iterator[pa.Array] | Iterator[pa.RecordBatch], rows: int = 128) -> Iterator:
    """Each batch in slices of at most `rows` rows: a worker turns so many into objects of its own at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def partitions(df: DataFrame) -> int:
    """The number of partitions that the session gives a shuffle."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))
