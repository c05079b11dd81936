"""Token ids in raw binary shards, with a minimal perfect hash index from document keys to places.

Folder: shards/<n>.ids holds the ids of the n-th range of keys, little-endian, nothing else.
index/<p>.npz holds one part of the index: a minimal perfect hash of its keys, and for each slot a fingerprint of
the key, the shard, the first id and the number of ids.  A key is found by hashing it to a part and a slot.
Files are written under a temporary name and renamed, so a task that runs again replaces its file whole.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyre.llm.common import partitions, small, store, written

#: Documents of a shard and keys of an index part at most, about.
SHARD_DOCS = 65_536
PART_KEYS = 1_000_000
#: Words whose ids a worker remembers, and their longest length.
WORDS_KEPT, WORD_CHARS = 300_000, 48
#: Characters that are encoded at a time; longer texts are cut.
SLICE_CHARS = 2_000_000
#: Ids that are read at a time, at most.
READ_IDS = 4_000_000
#: New words that the library gets as one text.
JOINED = 64

#: A space after which a word cache may not cut: white space or the end follows.
UNSAFE = re.compile(r" (?:\s|\Z)")
#: A space between two letters: no match of a byte-level tokenizer goes on before it.
SAFE = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


class Encoder:
    """The tokenizers library's ids of whole texts, as raw little-endian bytes.

    A byte-level tokenizer without a normaliser splits every text between a non-space and ` x`, x no white space,
    so words keep their ids wherever they stand.  Their ids come from the library once and are then remembered.  Texts
    with other white space after a space, texts that name an added token, and other tokenizers go to the library whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.model = self.own.model
        config = json.loads(self.own.to_str())
        split, added = config["pre_tokenizer"] or {}, config["added_tokens"]
        self.added = [token["content"] for token in added]
        simple = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
        self.by_word = simple and config["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        self.code = id_code(self.own.get_vocab_size())
        self.words: dict[str, bytes] = {}
        #: Whether an id's token begins with a space, which a byte-level vocabulary writes as one letter.
        self.begins = np.zeros(self.own.get_vocab_size(), bool)
        self.begins[[i for token, i in self.own.get_vocab().items() if token.startswith("\u0120")]] = True

    def library(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def new_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each of some words after a space.

        Plain letters after a space are one match of a byte-level tokenizer, so the library's model gets them alone.
        Of the others, JOINED are one text, whose ids are cut where tokens begin with a space.
        """
        code, tokenize, width = self.code, self.model.tokenize, array(self.code).itemsize
        found, others = {}, []
        for word in words:
            if word.isascii() and word.isalpha():
                found[word] = array(code, [t.id for t in tokenize("\u0120" + word)]).tobytes()
            else:
                others.append(word)
        groups = [others[at : at + JOINED] for at in range(0, len(others), JOINED)]
        for group, raw in zip(groups, self.library([" " + " ".join(group) for group in groups])):
            at = np.flatnonzero(self.begins[np.frombuffer(raw, f"u{width}")]) * width
            found.update(zip(group, map(raw.__getitem__, map(slice, at.tolist(), [*at[1:].tolist(), len(raw)]))))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        words, rows, whole, new = self.words, [], [], {}
        for at, text in enumerate(texts):
            if self.by_word and not UNSAFE.search(text) and not any(token in text for token in self.added):
                first, *rest = text.split(" ")
                ids = list(map(words.get, rest))
                gaps = [] if all(ids) else [i for i, known in enumerate(ids) if known is None]
                new.update((rest[i], None) for i in gaps)
                rows.append((at, first, rest, ids, gaps))
            else:
                whole.append(at)
        new = self.new_words(list(new))
        out: list[bytes] = [b""] * len(texts)
        starts = self.library([row[1] for row in rows])
        for (at, _, rest, ids, gaps), start in zip(rows, starts):
            for i in gaps:
                ids[i] = new[rest[i]]
            out[at] = start + b"".join(ids)
        for at, ids in zip(whole, self.library([texts[at] for at in whole])):
            out[at] = ids
        if len(words) < WORDS_KEPT:
            words.update((word, ids) for word, ids in new.items() if len(word) <= WORD_CHARS)
        return out

    def pieces(self, text: str, size: int = SLICE_CHARS) -> Iterator[str]:
        """text in pieces of `size` characters or more, cut before spaces between two letters; whole if it has none, or may not be cut."""
        start = 0
        while self.by_word and len(text) - start > size and (cut := SAFE.search(text, start + size)):
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encode_all(self, texts: Iterable[str | None], size: int = SLICE_CHARS) -> Iterator[bytes]:
        """The ids of many texts, in slices of some characters at a time; a null text counts as empty."""
        part: list[str] = []
        held = 0
        for text in texts:
            if text is not None and len(text) > size:
                yield from self.encode(part)
                part, held = [], 0
                yield b"".join([self.encode([piece])[0] for piece in self.pieces(text, size)])
                continue
            part.append(text or "")
            held += len(part[-1])
            if held >= size:
                yield from self.encode(part)
                part, held = [], 0
        yield from self.encode(part)


def id_code(vocab: int) -> str:
    """The array code of an id: two bytes where the vocabulary allows it, else four."""
    return "H" if vocab <= 1 << 16 else "I"


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _new(folder: str, name: str):
    """An output stream, and what puts its file in place."""
    fs, root = store(folder)
    fs.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
    temporary = f"{root}/{name}.{uuid.uuid4().hex}.tmp"
    return fs.open_output_stream(temporary), lambda: fs.move(temporary, f"{root}/{name}")


def _key(doc: np.ndarray, is_null: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each key: the document's id, whether it is null, and the row's number among equal ids."""
    x = doc.astype(np.int64).view(np.uint64) + copy.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + is_null.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash: keys that are alone in their slot of a level's bit array stay there, others go down a level.

    A key's value is its bit's rank over all levels, so n keys have the values 0 to n - 1.
    """

    GAMMA = 1.5

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        sizes = [int(bits.sum()) for bits in levels]
        self.ranks = [before + np.cumsum(bits) - 1 for bits, before in zip(levels, np.cumsum([0, *sizes[:-1]] if sizes else []))]

    @staticmethod
    def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys must be distinct."""
        levels: list[np.ndarray] = []
        while len(keys):
            size = int(len(keys) * cls.GAMMA) + 1
            slots = cls.slots(keys, len(levels), size)
            alone = np.bincount(slots, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[slots]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Each key's value; -1 for a key that falls through all levels, which is none of the index's."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            slots = self.slots(keys[left], level, len(bits))
            hit = bits[slots]
            out[left[hit]] = ranks[slots[hit]]
            left = left[~hit]
        return out


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes docs into shards of rising keys and returns their places: (doc_id, copy, shard, first, n_ids).

    A null text counts as empty and has the end id only.  Null keys come first.  Rows with equal keys are all
    written, in the order of their texts, and numbered by copy.
    """
    n = docs.count()
    shards = max(partitions(docs), -(-n // SHARD_DOCS), 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end, width = array(own.code, [end_id]).tobytes(), array(own.code).itemsize
        out = place = None
        at, last, copy = 0, object(), 0
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                out, place = _new(folder, f"shards/{shard:06d}.ids")
            copies, firsts, sizes = [], [], []
            for key, ids in zip(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None), own.encode_all(batch["text"])):
                copy = copy + 1 if key == last else 0
                last = key
                out.write(ids + end)
                copies.append(copy)
                firsts.append(at)
                sizes.append(len(ids) // width + 1)
                at += sizes[-1]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "copy": copies, "shard": shard, "first": firsts, "n_ids": sizes})
        if out is not None:
            out.close()
            place()

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInPandas(run, "doc_id long, copy long, shard long, first long, n_ids long"), "places")


def _hashed(pdf: pd.DataFrame) -> np.ndarray:
    return _key(pdf["doc_id"].fillna(0).to_numpy(np.int64), pdf["doc_id"].isna().to_numpy(), pdf["copy"].to_numpy(np.int64))


def index_parts(n: int) -> int:
    return max(-(-n // PART_KEYS), min(64, -(-n // 512)), 1)


def _part(parts: int):
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(parts)).alias("part")


def write_index(places: DataFrame, folder: str, parts: int) -> None:
    """Writes the index of places in parts, one file each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = _hashed(pdf)
        slots = (found := PerfectHash.build(keys))(keys)
        order = np.argsort(slots)
        columns = {name: pdf[name].to_numpy(np.int64)[order] for name in ("shard", "first", "n_ids")}
        buffer = io.BytesIO()
        np.savez(buffer, print=(keys >> np.uint64(32)).astype(np.uint32)[order], sizes=np.array([len(b) for b in found.levels]), bits=np.packbits(np.concatenate(found.levels)), **columns)
        out, place = _new(folder, f"index/{pdf['part'].iat[0]:06d}.npz")
        out.write(buffer.getvalue())
        out.close()
        place()
        return pd.DataFrame({"keys": [len(pdf)]})

    places.select("*", _part(parts)).groupBy("part").applyInPandas(run, "keys long").agg(F.sum("keys")).collect()


def look_up(keys: DataFrame, folder: str, parts: int) -> DataFrame:
    """(doc_id, copy, shard, first, n_ids) of keys (doc_id, copy), from the index files; keys that are not there are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fs, root = store(folder)
        with fs.open_input_stream(f"{root}/index/{pdf['part'].iat[0]:06d}.npz") as raw:
            part = np.load(io.BytesIO(raw.read()))
        sizes = part["sizes"]
        bits = np.unpackbits(part["bits"], count=int(sizes.sum())).astype(bool)
        own = PerfectHash(np.split(bits, np.cumsum(sizes)[:-1]))
        wanted = _hashed(pdf)
        slots = own(wanted)
        good = (slots >= 0) & (part["print"][slots] == (wanted >> np.uint64(32)).astype(np.uint32))
        out = pdf.loc[good, ["doc_id", "copy"]].astype({"doc_id": "Int64"})
        return out.assign(**{name: part[name][slots[good]] for name in ("shard", "first", "n_ids")})

    return keys.select("doc_id", "copy", _part(parts)).groupBy("part").applyInPandas(run, "doc_id long, copy long, shard long, first long, n_ids long")


def _adjacent(first: np.ndarray, n: np.ndarray) -> Iterator[slice]:
    """Runs of rows, sorted by first, that lie side by side in a shard, READ_IDS ids or a single row more each."""
    at = 0
    while at < len(first):
        apart = np.flatnonzero(first[at + 1 :] != first[at:-1] + n[at:-1])
        end = at + 1 + (int(apart[0]) if len(apart) else len(first) - at - 1)
        end = max(at + 1, min(end, at + int(np.searchsorted(first[at:end] + n[at:end] - first[at], READ_IDS, "right"))))
        yield slice(at, end)
        at = end


def read_ids(found: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """found (doc_id, copy, shard, first, n_ids) with ids_crc32 of the ids in the shard files, as unsigned 32-bit integers.

    Rows that lie side by side are read at once and told apart by their places.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fs, root = store(folder)
        code = np.dtype("<u2" if encoder(tokenizer).code == "H" else "<u4")
        pdf = pdf.sort_values("first", kind="stable")
        first, n = pdf["first"].to_numpy(np.int64), pdf["n_ids"].to_numpy(np.int64)
        sums: list[int] = []
        with fs.open_input_file(f"{root}/shards/{pdf['shard'].iat[0]:06d}.ids") as raw:
            for run in _adjacent(first, n):
                start, size = first[run.start], int(n[run].sum())
                ids = memoryview(np.frombuffer(raw.read_at(size * code.itemsize, int(start) * code.itemsize), code).astype("<u4")).cast("B")
                places = ((first[run] - start) * 4).tolist()
                sums += [zlib.crc32(ids[at : at + 4 * k]) for at, k in zip(places, n[run].tolist())]
        return pdf.astype({"doc_id": "Int64"}).assign(ids_crc32=sums)

    return found.groupBy("shard").applyInPandas(run, "doc_id long, copy long, shard long, first long, n_ids long, ids_crc32 long")


def shard_starts(totals: DataFrame) -> DataFrame:
    """(shard, before): the ids of all earlier shards, from totals (shard, n), one row for each shard."""
    return totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))


def written_and_read(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of docs, read back from the files by key.

    start counts the ids of all rows before it, in rising doc_id order, null keys first.  An empty table writes no files.
    """
    places = write_shards(docs, folder, tokenizer, end_id, doc, text)
    totals = written(places.groupBy("shard").agg(F.sum("n_ids").alias("n"), F.count("*").alias("docs")), "totals")
    parts = index_parts(totals.agg(F.sum("docs")).first()[0] or 0)
    write_index(places, folder, parts)
    found = read_ids(look_up(places.select("doc_id", "copy"), folder, parts), folder, tokenizer)
    starts = written(shard_starts(totals), "starts")
    return found.join(small(starts), "shard").select("doc_id", (F.col("before") + F.col("first")).alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32")
