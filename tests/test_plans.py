"""What the plans of the heavier queries read and shuffle, counted after they ran."""
import re

import pytest

import __spark_entry__ as E
from tests.tables import SF_SMALL


def executed(df):
    """The plan that ran, adaptive stages unfolded, reused exchanges by name only."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("+- == Initial Plan ==")[0]


def shuffles(plan):
    return len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (?:hashpartitioning|rangepartitioning|SinglePartition)", plan))


def scans(plan):
    return len(re.findall(r"FileScan parquet", plan))


@pytest.mark.parametrize("name,most_shuffles,most_scans", [
    ("meteor_pair", 6, 4), ("legal_actions", 10, 4), ("bundle_state", 10, 4), ("split_conversations", 8, 4), ("validation_report", 24, 12)])
def test_bounded_plans(spark, name, most_shuffles, most_scans):
    plan = executed(E.queries()[name](spark, SF_SMALL))
    assert shuffles(plan) <= most_shuffles and scans(plan) <= most_scans, (shuffles(plan), scans(plan))


def test_prompt_build_has_no_nested_loop(spark):
    assert "NestedLoop" not in executed(E.queries()["prompt_build"](spark, SF_SMALL))
