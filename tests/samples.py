"""Where the shared test tables lie."""

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


def shuffled_records(df):
    """Rows that the exchanges of ``df`` write when it is collected."""
    df.collect()
    found, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            if node.metrics().contains("shuffleRecordsWritten"):
                found += node.metrics().apply("shuffleRecordsWritten").value()
            children = node.children()
            left += [children.apply(i) for i in range(children.size())]
    return found
