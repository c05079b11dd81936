"""op1, op5, op10: whole results on sf0.001 and odd inputs, against plain Python."""

from __future__ import annotations

import base64
import hashlib
import unicodedata
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from gyre.llm import bpe, fingerprint, queries, tokenbin
from gyre.llm.common import new_folder
from pyspark.sql import functions as F
from tokenizers import Tokenizer

ODD = [None, "", " ", "a", "ab  c\n\n d", "x \n y", "Ünïcode  ﬁne　x", "tail ", "don't <|endoftext|> stop", "\n\n  lead", "a" * 500, "word " * 30_000, "日本語 テスト", "é é"]


def odd_docs(spark, extra=()):
    rows = [(i, t) for i, t in enumerate([*ODD, *extra])]
    return spark.createDataFrame([*rows, (3, "a"), (3, "b"), (None, "null key")], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("part", F.lit(1))


def docs_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def edit(text, after):
    cut = len(text) // 3
    return text[: len(text) - cut] + after[:cut]


def canon(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def check_fingerprints(rows, pairs):
    pairs = sorted(pairs, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    got = sorted(map(tuple, rows), key=str)
    want, prints = [], {}
    for k, (doc, text) in enumerate(pairs):
        after = pairs[(k + 1) % len(pairs)][1]
        want.append((doc, len(text), hashlib.sha256(edit(text, after).encode()).hexdigest(), float(canon(text) == canon(edit(text, after))), float(canon(text) == canon(after)), canon(text)))
    assert sorted([(r[0], r[1], r[2], r[5], r[6]) for r in got], key=str) == sorted([w[:5] for w in want], key=str)
    by = {}
    for w in want:
        by.setdefault((w[0], w[1], w[2]), set()).add(w[5])
    for r in got:
        (c,) = by[r[0], r[1], r[2]]
        prints.setdefault(c, set()).add(r[3])
    assert all(len(p) == 1 for p in prints.values())
    assert len(set().union(*prints.values())) == len(prints)


def test_fingerprints_of_the_table(spark, sf_dir):
    rows = queries.op1_fingerprint(spark, sf_dir).collect()
    check_fingerprints(rows, [tuple(r) for r in docs_of(spark, sf_dir).collect()])


@pytest.mark.parametrize("bits", [64, 1])
def test_fingerprints_of_odd_texts_and_of_colliding_hashes(spark, bits, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 3)
    docs = odd_docs(spark, ["Same  Text", "same text", "A", "ab C d", "Stra\u00dfe", "STRASSE", "strasse", "\u039f\u0394\u039f\u03a3", "\u03bf\u03b4\u03bf\u03c2", "\u03bf\u03b4\u03bf\u03c3", "\ufb03", "FFI", "\u0130", "i\u0307"])
    monkeypatch.setattr(fingerprint, "few", lambda several: bits == 64)
    rows = fingerprint.probed(docs, bits=bits).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    check_fingerprints(rows, [(r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()])
    assert fingerprint.probed(docs.limit(0)).count() == 0


def test_parts_of_rows_without_an_id_and_of_one_id(spark, monkeypatch):
    """Half of the ids are missing and one stands a thousand times: no part is large, and the parts follow each other."""
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 64)
    rows = [(None, f"null {i}") for i in range(3_000)] + [(1_500, f"same {i}") for i in range(1_000)] + [(i, f"own {i}") for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes = [r["count"] for r in fingerprint.parted(docs).groupBy("part").count().collect()]
    assert sum(sizes) == 6_000 and max(sizes) < 64 * 4
    after = {(r["doc_id"], r["text"]): r["next_text"] for r in fingerprint.with_next(docs).collect()}
    assert len(after) == 6_000 and sorted(after.values()) == sorted(t for _, t in rows)
    of = {t: i for i, t in rows}
    order, text = [], rows[-1][1]  # the largest id comes first
    for _ in range(6_000):
        order.append(text)
        text = after[of[text], text]
    assert text == order[0] and len(set(order)) == 6_000
    ids = [of[t] for t in order]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i, reverse=True)


def test_bpe_round_trip(spark):
    path = queries.BPE_RANKS
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.with_ids(odd_docs(spark), path, P.PATTERN, decoded="raw").collect():
        assert list(r["ids"]) == own.encode_ordinary(r["text"] or "")
        assert bytes(r["raw"]) == (r["text"] or "").encode()
    text = ODD[11]
    assert "".join(bpe.pieces(text)) == text and len(list(bpe.pieces(text))) > 1
    assert sum((own.encode_ordinary(p) for p in bpe.pieces(text, 100)), []) == own.encode_ordinary(text)


def test_bpe_of_very_long_white_space(spark):
    """Runs of 2,000,000 against the bare library on runs that it can take, whose ids are merged alike."""
    own = bpe.encoding(queries.BPE_RANKS, P.PATTERN)
    for run in (" ", "\n", " \n", "\t\u3000\r\n"):
        for before, after in (("", ""), ("", "end"), ("a start", ""), ("it's", "12 x"), ("a", "\u00e9")):
            short = before + (run * 200_000)[:200_000] + after
            assert bpe.ids_of(short, own) == own.encode_ordinary(short)
    texts = [before + (run * 2_000_000)[:2_000_000] + after for run in (" ", "\n", " \n\t") for before, after in (("a b", ""), ("", "c"), ("a", "b c"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.with_ids(docs, queries.BPE_RANKS, P.PATTERN, decoded="raw").select("doc_id", "raw", F.size("ids").alias("n")).collect():
        assert bytes(r["raw"]) == texts[r["doc_id"]].encode() and r["n"] > 0


def test_bpe_query(spark, sf_dir):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.BPE_RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for doc, text in docs_of(spark, sf_dir).collect():
        ids = own.encode_ordinary(text)
        want[doc] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in queries.op5_bpe(spark, sf_dir).collect()} == want


def brute_ids(rows):
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(want, key=str)


def test_token_shards_of_the_table(spark, sf_dir):
    rows = queries.op10_token_binary(spark, sf_dir).collect()
    assert sorted(map(tuple, rows), key=str) == brute_ids(map(tuple, docs_of(spark, sf_dir).collect()))


def test_token_shards_of_odd_texts(spark):
    docs = odd_docs(spark)
    out = tokenbin.written_and_read(docs, new_folder(spark, "test"), P.path("byte_bpe_50k.json"), 2)
    assert sorted(map(tuple, out.collect()), key=str) == brute_ids([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])
    assert tokenbin.written_and_read(docs.limit(0), new_folder(spark, "test"), P.path("byte_bpe_50k.json"), 2).count() == 0


def test_encoder_gives_the_ids_of_the_bare_library():
    own, got = Tokenizer.from_file(P.path("byte_bpe_50k.json")), tokenbin.Encoder(P.path("byte_bpe_50k.json"))
    texts = [t or "" for t in ODD] + ["a <|endoftext|> b", "x<|endoftext|>", "one\ntwo three\n four\t five", " lead", "a  b", "wörter straße " * 9, "it's 12,5 % #tag", "x" * 60 + " y" * 90]
    want = [np.array(e.ids, np.uint16).tobytes() for e in own.encode_batch(texts, add_special_tokens=False)]
    for size in (2_000_000, 50, 7):
        assert list(got.encode_all(texts, size)) == want
    assert 50256 in np.frombuffer(want[len(ODD)], np.uint16) and len(list(got.pieces(ODD[11], 1_000))) > 9


def test_adjacent_rows_are_read_together(monkeypatch):
    first, n = np.array([0, 3, 5, 9, 12]), np.array([3, 2, 3, 3, 1])
    assert list(tokenbin._adjacent(first, n)) == [slice(0, 3), slice(3, 5)]
    monkeypatch.setattr(tokenbin, "READ_IDS", 5)
    assert list(tokenbin._adjacent(first, n)) == [slice(0, 2), slice(2, 3), slice(3, 5)]


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    assert sorted(tokenbin.PerfectHash.build(keys)(keys)) == list(range(len(keys)))
