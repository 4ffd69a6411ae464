"""Bars that several parts of a query need are folded once: the plan of the rest has no scan of their table."""

import pytest

from marlstone.operators import retrieval as R
from marlstone.plans import market, sectors


@pytest.mark.parametrize("build", [sectors.sector_features, market.ag_robust_z])
def test_bars_are_read_once(spark, sf, build):
    assert "l_suppkey" not in build(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_token_numbers_make_no_tokens(spark):
    text = [None, "", " \t", "ab c", "Éa b", "x", "a" * 5]
    got = {r.doc_id: tuple(r)[1:] for r in R.token_numbers(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")).collect()}
    for k, t in enumerate(text):
        plain, three, n = R.tokens((t or "").lower())
        assert got[k] == (n, len((t or "").split()), three.total()) and plain.total() == n
