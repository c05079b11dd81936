"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gyre.llm.common import sliced

#: Texts of more characters than this are cut into pieces of about this size.
LONG = 65_536

#: Before a space between two letters no match of the pattern goes on: a match that has reached the left
#: letter takes letters only, and the space belongs to the word on its right.
SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")


#: A run of white space of this length is too long for the library's matcher.
LONG_SPACE = 100_000
LONG_RUN = regex.compile(rf"\s{{{LONG_SPACE}}}")


@cache
def matcher(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


@cache
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (a base64 token and its rank on each line), once in each worker."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(ranks_path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = LONG) -> Iterator[str]:
    """text, cut at safe boundaries into pieces of `size` characters or a little more.

    A text without a safe boundary stays whole: the ids count, not the pieces.
    """
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def ids_of(piece: str, own: tiktoken.Encoding) -> list[int]:
    """The ids of a piece.

    The library's matcher steps back through runs of white space and gives up on very long ones, so the matches of a
    piece with such a run are found here, and each is merged by the library by itself, which is what it does anyway.
    """
    if len(piece) < LONG_SPACE or not LONG_RUN.search(piece):
        return own.encode_ordinary(piece)
    ids: list[int] = []
    for match in matcher(own._pat_str).finditer(piece):
        ids += own._core_bpe.encode_single_piece(match[0].encode())
    return ids


def _encoded(texts: pa.Array, own: tiktoken.Encoding, size: int) -> pa.ListArray:
    rows = []
    for text in texts:
        parts = [np.array(ids_of(piece, own), np.int32) for piece in pieces(text.as_py() or "", size)]
        rows.append(np.concatenate(parts))
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *rows]))


def _decoded(rows: pa.ListArray, own: tiktoken.Encoding) -> pa.Array:
    return pa.array((None if (ids := row.as_py()) is None else own.decode_bytes(ids) for row in rows), pa.binary())


def _encoder(ranks_path: str, pattern: str, size: int):
    @arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoding(ranks_path, pattern)
        for texts in sliced(batches):
            yield _encoded(texts, own, size)

    return encode


def _decoder(ranks_path: str, pattern: str):
    @arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoding(ranks_path, pattern)
        for rows in sliced(batches):
            yield _decoded(rows, own)

    return decode


def _round_trip(ranks_path: str, pattern: str, size: int = LONG):
    """Ids and what they decode to from one worker, as two functions in a row would hold two workers a task."""

    @arrow_udf("ids array<int>, decoded binary")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoding(ranks_path, pattern)
        for texts in sliced(batches):
            ids = _encoded(texts, own, size)
            yield pa.StructArray.from_arrays([ids, _decoded(ids, own)], ["ids", "decoded"])

    return both


def encode(text: Column, ranks_path: str, pattern: str, size: int = LONG) -> Column:
    """Ids of each text, as array<int>: each match of `pattern` is merged by itself, and no special token is known.

    A null text counts as empty and has no ids.  Text is only cut where no match can cross, so the ids
    do not depend on `size`.
    """
    return _encoder(ranks_path, pattern, size)(text)


def decode(ids: Column, ranks_path: str, pattern: str) -> Column:
    """The raw bytes of ids.  They need not be UTF-8, as ids may begin or end within a character.  Null ids give null."""
    return _decoder(ranks_path, pattern)(ids)


def with_ids(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with a column of ids and, if named, a column of the bytes decoded from them.

    A null text counts as empty: no ids, and no bytes.  A text of any length is encoded whole: long ones go piece by
    piece (see pieces), and runs of white space of any length are known (see ids_of).  Repeated rows and ties do not
    matter; an empty table stays empty.  Rows are never dropped or joined; columns of these names that df already has
    are replaced.
    """
    if decoded is None:
        return df.withColumn(ids, encode(F.col(text), ranks_path, pattern))
    out = df.withColumn("_coded", _round_trip(ranks_path, pattern)(F.col(text)))
    return out.withColumns({ids: F.col("_coded.ids"), decoded: F.col("_coded.decoded")}).drop("_coded")
