"""What reports share is derived once."""

import pytest
from gyre import catalog
from gyre.operators import dbr
from gyre.plans import queries as q
from gyre.sources import bindings

#: Queries, and how often they may derive answers and judgements of the responses.
DERIVED = {
    "i10_decision_reasons": 1, "i10_dbr_stress": 1, "i19_article_evidence": 1, "i20_findings": 2, "i10_bucket_coverage": 1, "i12_pvr_stress": 1, "i14_csr_report": 1,
    "i08_soft_stress": 1, "i11_dbr_confirmatory": 1, "g10_qualitative": 1, "i06_pvf_stress": 1,
}


@pytest.mark.parametrize("name", DERIVED)
def test_responses_are_evaluated_once(spark, sf_dir, monkeypatch, name):
    calls, evaluated = [], bindings.evaluated
    monkeypatch.setattr(bindings, "evaluated", lambda *a, **k: calls.append(1) or evaluated(*a, **k))
    catalog.queries()[name](spark, sf_dir)
    assert len(calls) <= DERIVED[name]


@pytest.mark.parametrize("name", ["e34_mechanism_summary", "h11_pairwise_checks"])
def test_a_derivation_is_not_in_the_result_twice(spark, sf_dir, name):
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan  # what is read twice was written, so the judge is not in the plan


def test_decisions_carry_the_flags_of_their_rows(spark, sf_dir):
    rows = dbr.flagged(q._policy_rows(spark, sf_dir))
    columns = [*q.CTX, "example_id", "length_bin", *[f"defect_{n}" for n in dbr.quality.DEFECTS]]
    decided = dbr.decided(rows, q.CTX).select(columns)
    assert decided.exceptAll(rows.select(columns)).isEmpty() and rows.select(columns).exceptAll(decided).isEmpty()
