"""The lines are matched once, whatever a query then asks of them."""

import pytest

from versicle import plans, staging
from versicle.operators import cooccurrence, scoring


@pytest.fixture
def staged(monkeypatch):
    """Plans of what is staged while a query is made."""
    found = []

    def kept(df, name):
        found.append(df._jdf.queryExecution().executedPlan().toString())
        return staging.stage(df, name)

    for module in (scoring, cooccurrence):
        monkeypatch.setattr(module, "stage", kept, raising=False)
    return found


def scans(df, staged):
    return sum(p.count("ArrowEvalPython") for p in [*staged, df._jdf.queryExecution().executedPlan().toString()])


@pytest.mark.parametrize("name", ["sigmoid_scores", "sensitivity_variants", "threshold_sweep"])
def test_lines_are_matched_once(spark, staged, name):
    assert scans(plans.queries()[name](spark, "/root/testdata/sf0.001"), staged) == 1
