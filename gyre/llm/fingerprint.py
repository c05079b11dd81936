"""Canonical exact fingerprints of documents, in DataFrame expressions only.

A text is brought to a canonical form (Unicode NFKC, case folding, runs of white space as one space, trimmed) and
hashed by two seeded 64-bit xxhashes.  Texts in one 128-bit bucket are then compared byte by byte: a bucket that
holds different canonical texts gives each its number, which is part of the fingerprint.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.llm.common import few, written

SEEDS = (17, 40_961)
#: Rows of an id range, about, and ranges at most: beyond RANGES * RANGE_ROWS rows the ranges grow with the table, and are
#: sorted by spilling; their bounds, one number a range, are all that the driver holds.
RANGE_ROWS = 512
RANGES = 1 << 16
#: Ways in which the rows of a bucket are spread where buckets are joined by a shuffle.
SALTS = 32


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC again, each run of Unicode white space as one space, none at the ends; null counts as empty.

    Normaliser and folding are ICU's, which Spark ships; plain ASCII needs only lower case.  Folding makes equal what
    differs in case alone, such as a sharp s and SS, or the two small sigmas.
    """
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    folded = _composed(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _composed(text), F.lit(True)))
    return F.trim(F.regexp_replace(F.when(ascii_only, F.lower(text)).otherwise(folded), r"[\s\x{85}\p{Z}]+", " "))


def _composed(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def wide_hash(canon: Column, bits: int = 64) -> Column:
    """Two seeded xxhashes of a canonical text, as a struct (a, b); fewer bits are for tests of what a collision does."""
    a, b = (F.xxhash64(F.lit(seed), canon) for seed in SEEDS)
    if bits < 64:
        a, b = F.pmod(a, F.lit(1 << bits)), F.lit(0).cast("long")
    return F.struct(a.alias("a"), b.alias("b"))


def label(hashed: Column, number: Column) -> Column:
    """The fingerprint: 32 hexadecimal digits, and after a point the number of a text that is not its bucket's first."""
    digits = F.concat(F.lpad(F.lower(F.hex(hashed["a"])), 16, "0"), F.lpad(F.lower(F.hex(hashed["b"])), 16, "0"))
    return F.concat(digits, F.when(number > 0, F.concat(F.lit("."), number.cast("string"))).otherwise(F.lit("")))


def collisions(docs: DataFrame, text: str = "text", bits: int = 64) -> DataFrame:
    """(hash, canon, number) of canonical texts that share their bucket with another and are not its first, by byte order.

    Buckets are counted by hash; only texts of buckets with several rows are compared, each distinct text once in
    each task before the shuffle.  Where such buckets are too many to broadcast, rows meet them under SALTS salts, so
    that a text with very many copies is spread.  As a rule the result is empty; so it is for an empty table.
    """
    hashed = docs.select(canonical(F.col(text)).alias("canon")).withColumn("hash", wide_hash(F.col("canon"), bits))
    several = written(hashed.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "several")
    if few(several):
        texts = hashed.join(F.broadcast(several), "hash")
    else:
        spread = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        texts = hashed.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(spread, ["hash", "salt"])
    texts = texts.select("hash", "canon").distinct()
    number = F.dense_rank().over(Window.partitionBy("hash").orderBy("canon")) - 1
    return texts.withColumn("number", number).filter("number > 0")


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", bits: int = 64, clashes: DataFrame | None = None) -> DataFrame:
    """docs with a fingerprint of each text.  Equal canonical texts, and only those, have equal fingerprints.

    clashes: the collisions() of another table, by which these texts are to be numbered too.
    A null text counts as empty.  No row is dropped or joined; a column of this name is replaced.
    """
    clashes = written(collisions(docs, text, bits), "clashes") if clashes is None else clashes
    return _numbered(docs.withColumn("_canon", canonical(F.col(text))), "_canon", name, bits, clashes)


def _numbered(rows: DataFrame, canon: str, name: str, bits: int, clashes: DataFrame) -> DataFrame:
    """rows with the fingerprint of a canonical text, in place of that text."""
    out = rows.withColumn("_hash", wide_hash(F.col(canon), bits))
    if clashes.isEmpty():
        return out.withColumn(name, label(F.col("_hash"), F.lit(0))).drop(canon, "_hash")
    clashes = clashes.select(F.col("hash").alias("_h"), F.col("canon").alias("_c"), F.col("number").alias("_number"))
    out = out.join(clashes, (F.col("_hash") == F.col("_h")) & (F.col(canon) == F.col("_c")), "left")
    return out.withColumn(name, label(F.col("_hash"), F.coalesce("_number", F.lit(0)))).drop(canon, "_hash", "_h", "_c", "_number")


def id_range(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds a key is above, by binary search; null keys are below all."""
    if not bounds:
        return F.lit(0)
    top = 1 << (len(bounds).bit_length() - 1)
    steps = F.array(*[F.lit(top >> k) for k in range(top.bit_length())])
    values = F.lit(bounds)
    n = F.lit(len(bounds))
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda acc, s: F.when((acc + s <= n) & (F.get(values, F.least(acc + s, n) - 1) < key), acc + s).otherwise(acc)), F.lit(0))


def parted(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with `tie` and `part`: falling (doc_id, tie, text) is their order, and parts follow each other in it.

    The ids are cut into ranges of about RANGE_ROWS rows by approximate quantiles.  An id on which several quantiles fall has rows for several
    ranges; these, and rows without an id, are ordered by a hash of their texts first, and cut by it.
    """
    n, known = rows.agg(F.count("*"), F.count("doc_id")).first()
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    points: list[int] = []
    if ranges > 1 and known:
        points = rows.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], max(10_000, 4 * ranges))).first()[0] or []
    often = [(None, (n - known) * ranges // n)] if n else []
    often += list(Counter(points).items())
    hot = rows.sparkSession.createDataFrame([(key, k) for key, k in often if k > 1], "_id long, _parts long")  # a row for two ranges at most
    rows = rows.join(F.broadcast(hot), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    tie = F.when(F.col("_parts").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    share = F.shiftright((F.shiftright("tie", 32) + (1 << 31)) * F.col("_parts"), 32)
    at = F.when(F.col("doc_id").isNull(), -1).otherwise(id_range(F.col("doc_id"), sorted(set(points))))
    # One number, range first: the join after the window goes by the window's own shuffle.
    part = F.shiftleft((at + 1).cast("long"), 40) + F.coalesce(F.when(F.col("_parts").isNotNull(), share + 1), F.lit(0))
    return rows.withColumn("tie", tie).withColumn("part", part).select("doc_id", "text", "tie", "part")


def with_next(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, next_text): each text (null: empty) and that of the next row by falling doc_id; after the last, the first.

    Rows without an id come last, and rows that share one follow each other: by their texts, or where they are very many by a hash of these.
    Each part (see parted) is sorted by itself, and the first row of each, one short row a part, is found beforehand, so the texts are
    shuffled once and no task holds more than a part.
    """
    rows = parted(docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc(), F.col("text").desc()]
    # The first row of each part, for the row before it: the last of the next higher part, or of the lowest part for the highest.
    lead = [F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.col("tie")]
    heads = written(rows.groupBy("part").agg(F.max(F.struct(*lead)).alias("head")).select("part", "head"), "heads")
    places = heads.select("part", "head", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("to"))
    places = written(places.select("part", "head", "to"), "places")
    marks = F.broadcast(places.withColumnRenamed("part", "_part"))  # some RANGES rows at most
    sent = rows.join(marks, (F.col("part") == F.col("_part")) & F.struct(*lead).eqNullSafe(F.col("head")))
    sent = sent.groupBy("to").agg(F.max(F.struct(*lead, "text")).alias("_head")).select(F.col("to").alias("_to"), F.col("_head.text").alias("_after"))
    follow = F.lead("text").over(Window.partitionBy("part").orderBy(*order))
    out = rows.withColumn("_next", follow).withColumn("_end", F.col("_next").isNull())
    ends = written(sent, "heads")  # a row for each part; the other side is dealt by part already
    return out.join(ends, (F.col("part") == F.col("_to")) & F.col("_end"), "left").select("doc_id", "text", F.coalesce("_next", "_after").alias("next_text"))


def probed(docs: DataFrame, doc: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """Fingerprints of all texts and of their edited texts (see edited), and whether they agree.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  The digest is
    exact, so a likeness is 1 where canonical texts are equal, byte by byte, and else 0.  An edited text that shares a
    bucket with texts of docs bears the number of that which it equals.

    One row for each row of docs: a null text counts as empty, rows that share a doc_id follow each other, rows without one
    come last (see with_next).  Other columns are left out, so that none can clash; an empty table gives no rows.
    """
    clashes = written(collisions(docs, text, bits), "clashes")
    rows = with_next(docs, doc, text).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumns({f"c_{name}": canonical(F.col(name)) for name in ("text", "edited", "next_text")})
    near = [(F.col("c_text") == F.col(f"c_{other}")).cast("double").alias(name) for name, other in (("near_edited", "edited"), ("near_next", "next_text"))]
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "c_text", "c_edited", *near)
    rows = _numbered(rows, "c_text", "fingerprint", bits, clashes)
    return _numbered(rows, "c_edited", "edited_fingerprint", bits, clashes)


def edited(text: Column, next_text: Column) -> Column:
    """text with its last third (floor of n / 3 code points) replaced by as many of the first of next_text, or all of them."""
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(next_text, F.lit(1), cut))
