"""The queries of the numbered operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.llm import bpe, chat, fingerprint, langid, lmscore, mixing, neardup, phrases, quality, repair, simhash, tokenbin, urlfilter
from gyre.llm.common import new_folder
from gyre.sources.tables import table

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.probed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.url_verdicts(pages).select("page_id", "host", "path", "rule", "verdict")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = lmscore.with_target(docs, table(spark, sf_dir, "labels"))
    return lmscore.scored(docs).select("doc_id", "n_tokens", "target_loss", "background_loss", "score")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.with_ids(docs, BPE_RANKS, public_tokenizers.PATTERN, decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"),
        quality.passes(quality.FULL).alias("kept"),
        "failed_bits",
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), neardup.NEAR_85)


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return out.select("conv_id", "chunk", "perspective", "text", F.array_join(spans, ",").alias("spans"), "n_turns", "n_target_turns")


#: Documents with this remainder of crc32(doc_id) by 4 are held out from learning languages.
HELD_OUT = "crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2"


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(F.expr(HELD_OUT), F.lit(False)))
    model = langid.fit(docs, ~F.col("held_out"))
    return langid.predicted(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenbin.written_and_read(docs, new_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.reports(repair.damaged(table(spark, sf_dir, "conversations")))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
pos AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
win AS (
  SELECT doc_id, i, word, lead(word) OVER p AS second, lead(word, 2) OVER p AS third FROM pos WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, second, third) AS n FROM win WHERE third IS NOT NULL),
rep AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, coalesce(dup.n_lines, 0) AS n_lines,
    length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS n_letters
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
b AS (
  SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (100 * n_dup_lines > 40 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 14 * n_words)::INT
    + 32 * (2 * n_letters < word_chars)::INT AS bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS failed_bits
FROM b
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
pos AS (SELECT doc_id, len(words) AS n_words, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
win AS (
  SELECT doc_id, n_words, i, concat_ws(' ', word, lead(word) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p, lead(word, 4) OVER p) AS shingle
  FROM pos WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, shingle FROM win WHERE i <= greatest(n_words - 4, 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents AS d JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) AS m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), replace(coalesce(text, ''), '<|', '< |')) - 1 AS k,
    count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
c AS (SELECT DISTINCT conv_id, k // 64 AS chunk FROM t),
named AS (
  SELECT *, k // 64 AS of, row_number() OVER (PARTITION BY conv_id, k // 64 ORDER BY k DESC) AS back FROM t WHERE role = 'system'),
force AS (
  SELECT c.conv_id, c.chunk, max(named.of) AS of FROM c JOIN named ON c.conv_id IS NOT DISTINCT FROM named.conv_id AND named.of < c.chunk
  GROUP BY c.conv_id, c.chunk),
shown AS (
  SELECT conv_id, k // 64 AS chunk, k, role, text, true AS own FROM t
  UNION ALL SELECT conv_id, k // 64 + 1, k, role, text, false FROM t WHERE k % 64 >= 56 AND (k // 64 + 1) * 64 < n
  UNION ALL SELECT force.conv_id, force.chunk, k, role, text, false FROM force
    JOIN named ON force.conv_id IS NOT DISTINCT FROM named.conv_id AND named.of = force.of AND back <= 8 AND k < chunk * 64 - 8),
s AS (
  SELECT shown.conv_id, chunk, perspective, k, own, own AND shown.role = perspective AS target,
    CASE WHEN shown.role = perspective THEN '<|assistant|>' WHEN shown.role = 'system' THEN '<|system|>'
      ELSE '<|user ' || regexp_replace(shown.role, '[<|>\s]', '_', 'g') || '|>' END || chr(10) AS head,
    text || '<|end|>' || chr(10) AS body
  FROM shown JOIN p ON shown.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, chunk, perspective ORDER BY k) AS stop FROM s)
SELECT conv_id, chunk, perspective, string_agg(head || body, '' ORDER BY k) AS text,
  coalesce(string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY k) FILTER (target), '') AS spans,
  count(*) FILTER (own) AS n_turns, count(*) FILTER (target) AS n_target_turns
FROM o GROUP BY conv_id, chunk, perspective
"""

OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
  FROM w, range(1, 6) AS t(k) WHERE len(words) >= k),
every AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM every WHERE k = 1 GROUP BY lang),
f AS (SELECT * FROM every WHERE f >= 100),
inside AS (
  SELECT lang, array_to_string(words[i:i + size - 1], ' ') AS phrase, max(f) AS within
  FROM (SELECT lang, k, f, string_split(phrase, ' ') AS words FROM f WHERE k > 2), range(2, 5) AS s(size), range(1, 5) AS a(i)
  WHERE size < k AND i + size - 1 <= k GROUP BY ALL),
c AS (
  SELECT f.lang, f.phrase, f.f AS a, k, string_split(f.phrase, ' ') AS words FROM f LEFT JOIN inside USING (lang, phrase)
  WHERE k > 1 AND (within IS NULL OR 100 * within < 100 * f.f)),
cut AS (
  SELECT c.lang, c.phrase, a, i, x.f AS l, y.f AS r, n.n, ((1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c JOIN range(1, 5) AS t(i) ON i < k JOIN n USING (lang)
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(words[1:i], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(words[i + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""


def _more(state: str, cost: str, edit: str) -> str:
    """A state (nine digits of cost, then the audit) after an edit of this cost."""
    return f"lpad((left({state}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{edit}'"


def _any(states: tuple[str, ...], cost: str, edit: str) -> str:
    return f"least({', '.join(_more(s, cost, edit) for s in states)})" if len(states) > 1 else _more(states[0], cost, edit)


_U = ("s0", "s1", "s3")
OP13_SQL = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384::BIGINT * (c & 1)))), 4294967295::BIGINT) % 20 AS kind FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, coalesce(nullif(left(role, 1), ''), '-') AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
r AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM o),
e AS (SELECT conv_id, i, initial, fault IN ('none', 'truncated') AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS cut FROM r),
c AS (SELECT DISTINCT conv_id FROM conversations),
n AS (
  SELECT c.conv_id, count(r.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM c LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
v AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, '000000005I' AS s2, '000000010II' AS s3 FROM c
  UNION ALL
  SELECT conv_id, i, t0, t1, u, least(t3, {_more("u", "5", "I")}) FROM (
    SELECT *, least(t2, {_more("t0", "5", "I")}, {_more("t1", "5", "I")}, {_more("t3", "5", "I")}) AS u FROM (
      SELECT v.conv_id, e.i, {_more("s0", "2", "D")} AS t0,
        least({_more("s1", "2", "D")}, CASE WHEN stays AND initial = 's' THEN {_more("s0", "cut", "K")} END) AS t1,
        least({_more("s2", "2", "D")}, CASE WHEN stays AND initial = 'u' THEN {_any(_U, "cut", "K")} END, CASE WHEN stays THEN {_any(_U, "cut + 1", "R")} END) AS t2,
        least({_more("s3", "2", "D")}, CASE WHEN stays AND initial = 'a' THEN {_more("s2", "cut", "K")} END, CASE WHEN stays THEN {_more("s2", "cut + 1", "R")} END) AS t3
      FROM v JOIN e ON e.conv_id IS NOT DISTINCT FROM v.conv_id AND e.i = v.i + 1))),
w AS (SELECT n.*, left(least(s0, s3), 9)::BIGINT AS cost, substr(least(s0, s3), 10) AS audit FROM n JOIN v ON v.conv_id IS NOT DISTINCT FROM n.conv_id AND v.i = n.n),
a AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, length(audit) + 1)) AS p FROM w WHERE audit <> ''),
b AS (SELECT *, sum((edit <> 'I')::INT) OVER z AS row, sum((edit <> 'D')::INT) OVER z AS j FROM a WINDOW z AS (PARTITION BY conv_id ORDER BY p)),
f AS (SELECT b.*, r.role, r.text, max((j = 1 AND edit = 'K' AND initial = 's')::INT) OVER (PARTITION BY b.conv_id) AS led FROM b LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.row AND edit <> 'I' WHERE edit <> 'D'),
g AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - coalesce(led, 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS digest FROM f GROUP BY conv_id)
SELECT w.conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM w LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprint": op1_fingerprint,
        "op2_mix": op2_mix,
        "op3_url_filter": op3_url_filter,
        "op4_lm_score": op4_lm_score,
        "op5_bpe": op5_bpe,
        "op6_quality_rules": op6_quality_rules,
        "op7_minhash": op7_minhash,
        "op8_chat_perspectives": op8_chat_perspectives,
        "op9_language_id": op9_language_id,
        "op10_token_binary": op10_token_binary,
        "op11_phrases": op11_phrases,
        "op12_simhash": op12_simhash,
        "op13_repair": op13_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": OP6_SQL, "op7_minhash": OP7_SQL, "op8_chat_perspectives": OP8_SQL, "op11_phrases": OP11_SQL, "op13_repair": OP13_SQL}
