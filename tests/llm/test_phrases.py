"""Phrase collocations against plain counts of all phrases, and against SQL."""

from __future__ import annotations

import os
import random
import re
from collections import Counter

import duckdb
import pytest
from gyre.llm import phrases, queries


def plain(rows, least, top):
    """collocations() of (lang, text), phrase by phrase."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    gone = {(lang, w[i:j]) for (lang, w), a in candidates.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * a >= 100 * f[lang, w[i:j]]}
    out = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def text_of(rng, words):
    return "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", ", ", "\n", " ", " ", " "]) for _ in range(rng.randrange(80)))


ODD = [("x", None), (None, "Null lang, NULL lang, null LANG"), ("x", ""), ("x", " \t\n.,"), ("é", "Ä b Ä b Ä b ä b"), ("x", "z.z z.z z;z\x0bz\x0cz \x01 z z z z z z z"), ("", "no name no name no name")]


@pytest.mark.parametrize(("share", "size", "bucket"), [(200, 8_000_000, 1_500_000), (3, 300, 40)])
def test_counts(spark, monkeypatch, share, size, bucket):
    """Whole slices and buckets, and tiny ones with hot words, pairs and longer prefixes."""
    monkeypatch.setattr(phrases, "SHARE", share)
    monkeypatch.setattr(phrases, "SLICE", size)
    monkeypatch.setattr(phrases, "BUCKET", bucket)
    rng = random.Random(11)
    words = ["the", "The", "of", "a", "b'c", "ünder", "long-word", "q"]
    rows = [(rng.choice(["en", "de", None]), text_of(rng, words)) for _ in range(60)] + ODD
    rows += [("hot", "again and again it goes on, " * 30)] * 3 + [("hot", "again and again it " + w) for w in "uvwxyz" * 4]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "lang string, text string, n int, phrase int").repartition(4)
    for least, top in ((3, 2000), (2, 10)):
        assert sorted(map(tuple, phrases.collocations(docs, least, top).collect())) == plain(rows, least, top)


def test_hot_prefixes_are_few_and_found(spark, monkeypatch):
    rows = [("l", f"the same w{i} v{i} u{i}") for i in range(400)] + [("l", f"s{i} t{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("text", phrases.F.col("text").cast("binary"))
    langs, total, hot = phrases.sizes_and_hot(docs)
    assert (langs.collect()[0]["n"], total) == (2_600, 2_600)
    assert len(hot) == 3  # the, same, the same


def test_exact_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits."""
    rows = [(10**10 - 1, 10**11 + 7, 10**10 + 3, 3 * 10**10), (7, 10**11, 7, 7)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long").select("a", "n", "l", "r", phrases.score().alias("score"))
    assert [r["score"] for r in df.collect()] == [1000 * a * n // (l * r) for a, n, l, r in rows]


def test_very_long_text(spark):
    rng = random.Random(2)
    rows = [("l", " ".join(rng.choice(["a", "b", "c", "d.", "e"]) for _ in range(300_000))), ("l", "a b c " * 100_000)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == plain(rows, 100, 2000)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf_dir, folder):
    sf_dir = os.path.join(os.path.dirname(sf_dir), folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    want = con.execute(queries.OP11_SQL).fetchall()
    df = queries.op11_phrases(spark, sf_dir)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert len(want) > 30 and sorted(map(tuple, df.collect())) == sorted(want)
