"""The pipeline on sf0.001, stage by stage, each against plain Python or SQL over its own input."""

from __future__ import annotations

import base64
from collections import Counter

import corpus_pipeline
import duckdb
import public_tokenizers as P
import tiktoken
from gyre.llm import mixing, queries
from gyre.llm.common import written
from test_models import WORD, plain_ppm, plain_taken


def near_sql(percent: int) -> str:
    return queries.OP7_SQL.replace("85 *", f"{percent} *")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(900, None, "en", "src1", 0), (901, "1 2 3 " * 60, "en", "src1", 0), (902, "", None, None, None)], docs.schema))
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, before, sf_dir), "test")
        old, new = {r["doc_id"]: r for r in before.collect()}, out.collect()
        if name != "encode_bpe":
            assert out.columns == columns
            kept = Counter(r["doc_id"] for r in new)
            assert all(r["text"] == old[r["doc_id"]]["text"] for r in new)
        if name == "quality_rules":
            documents = before.toPandas()  # noqa: F841
            good = {doc for doc, is_kept in duckdb.sql(f"SELECT doc_id, kept FROM ({queries.OP6_SQL})").fetchall() if is_kept}
            assert set(kept) == good and not good & {900, 902} and len(good) > 100
        elif name == "language_id":
            learnt = {}
            for r in old.values():
                if r["lang"] is not None:
                    learnt.setdefault(r["lang"], set()).add(r["text"])
            models = [plain_ppm(texts) for texts in learnt.values()]

            def known(text):
                """Whether the text has a letter and some language codes it in few bits a byte, by plain counts of contexts."""
                raw = b"\n\n\n" + text.encode()
                return any(map(str.isalpha, text)) and min(sum(m(raw[i - 3 : i], raw[i]) for i in range(3, len(raw))) for m in models) <= corpus_pipeline.FOREIGN_BITS * (len(raw) - 3)

            assert set(kept) == {d for d, r in old.items() if known(r["text"])}
            assert len(kept) >= len([d for d in old if d < 900])
        elif name == "near_duplicates":
            documents = before.toPandas()  # noqa: F841
            want = {r[0] for r in duckdb.sql(near_sql(80)).fetchall() if r[3]}
            assert set(kept) == want and set(kept.values()) == {1} and len(want) < len(old)
        elif name == "mix_sources":
            rows = before.select("doc_id", "text", "source").collect()
            want = {r["doc_id"]: int(n / len(WORD.findall(r["text"])) + 0.5) for r, n in zip(rows, plain_taken(spark, rows, mixing.Mix()))}
            assert kept == Counter({d: n for d, n in want.items() if n}) and max(want.values()) == 2
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.BPE_RANKS, "rb"))}
            own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
            assert len(new) == before.count()
            for r in new:
                assert r["round_trip"] and list(r["ids"]) == own.encode_ordinary(old[r["doc_id"]]["text"]) and r["n_tokens"] == len(r["ids"])
        before = out


def test_run_and_empty_documents(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 50
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
