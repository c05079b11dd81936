"""SimHash near-duplicates against all pairs in plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from gyre.llm import queries, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """The least id reachable over all pairs of (id, fingerprint)."""
    reach = {i: i for i, _ in rows}

    def root(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for n, (i, x) in enumerate(rows):
        for j, y in rows[:n]:
            if (x ^ y).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                reach[b] = a
    return {i: root(i) for i, _ in rows}


def test_query(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(d["doc_id"], plain_fingerprint(d["text"])) for d in docs]
    component = plain_components(rows)
    df = queries.op12_simhash(spark, sf_dir)
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, df.collect())) == sorted((i, f"{x:016x}", component[i]) for i, x in rows)


@pytest.mark.parametrize("longest", [5, 1024])
def test_links_equal_all_pairs(spark, longest):
    """Chains, clusters around one value, values that share bytes without linking, and lone values, read by short and by long lists."""
    rng = random.Random(longest)
    values = {rng.getrandbits(64) for _ in range(150)}
    for centre in list(values)[:12]:
        for _ in range(20):
            values.add(centre)
            centre ^= sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 5))})
    base = rng.getrandbits(64)
    values |= {base ^ rng.getrandbits(24) << 8 * rng.randrange(6) for _ in range(150)}
    values |= {base ^ sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(100)} | {0, (1 << 64) - 1, 1 << 63}
    rows = list(enumerate(sorted(values)))
    want = plain_components(rows)
    signed = {i: x - (1 << 64) if x >> 63 else x for i, x in rows}
    nodes = spark.createDataFrame([(x,) for x in signed.values()], "fp long")
    got = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes, longest)).collect()}
    groups = lambda name: sorted(sorted(i for i in signed if name(i) == c) for c in {name(i) for i in signed})
    assert groups(lambda i: got.get(signed[i], signed[i])) == groups(want.get)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 991}" for i in range(400_000))
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (None, "One two three four", 1), (5, "one  TWO\nthree four", 1), (6, "one two", 2), (7, "ONE two", 3), (8, long, 4), (9, long + " end", 4), (None, "alone here now", 5), (6, "other words here instead", 6), (11, "other words here instead", 6), (12, "É one", 7)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component_id int, fp int").select("doc_id", "text", "component_id", "fp")
    out = simhash.near_duplicates(df).collect()
    assert sorted(r["fingerprint"] for r in out) == sorted(f"{plain_fingerprint(t):016x}" for _, t, _ in rows)
    found = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in out}
    by_id = {i: c for (i, _), c in found.items()}
    assert (by_id[1], by_id[2], by_id[3], by_id[5], by_id[6], by_id[7], by_id[8], by_id[9], by_id[11], by_id[12]) == (1, 1, 1, 5, 6, 7, 8, 8, 6, 12)
    assert found[None, f"{plain_fingerprint('one two three four'):016x}"] == 5
    assert found[None, f"{plain_fingerprint('alone here now'):016x}"] is None
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_space_of_24_bits_equals_pairs():
    rng = np.random.default_rng(5)
    for five in simhash.FIVES[::7]:
        free = sum(0xFF << 8 * p for p in range(8) if p not in five)
        fp = np.unique((rng.integers(0, 1 << 62, 3_000, np.uint64) | np.uint64(1 << 63)) & np.uint64(free) & ~np.uint64(0x4444444444444444)).view(np.int64)
        pairs = lambda ways: {(int(x), int(y)) for a, b in ways for x, y in zip(a, b)}
        want = pairs(simhash.pairs_of_lists(np.zeros(len(fp), np.int64), fp))
        assert want and pairs(simhash.pairs_of_space(simhash.squeezed(fp, five))) == want


def test_many_variants_make_few_rows(spark):
    """A cluster of n fingerprints gives a forest of fewer than n links, not its pairs."""
    values = [((i * 2654435761) % (1 << 24)) << 20 for i in range(30_000)]
    n = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long").distinct(), 256)
    assert n.count() < 60 * len(values)
