"""How many rows the joins of a plan make."""

import re


def _below(plan):
    """The plan's nodes; of adaptive parts what ran in the end."""
    name = plan.nodeName()
    inner = plan.executedPlan() if name == "AdaptiveSparkPlan" else plan.plan() if re.search("QueryStage$", name) else None
    yield plan
    children = plan.children()
    for x in [inner] if inner is not None else [children.apply(i) for i in range(children.size())]:
        yield from _below(x)


def rows_of_joins(df) -> int:
    """Rows that the largest join makes when the rows of df are collected."""
    execution = df._jdf.queryExecution()
    df._jdf.collectToPython()
    return max((x.metrics().apply("numOutputRows").value() for x in _below(execution.executedPlan()) if "Join" in x.nodeName()), default=0)
