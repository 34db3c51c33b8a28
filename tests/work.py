"""What a query did when it ran, from Spark's own metrics."""

import re
from collections import Counter


def _number(text):
    return int(re.sub(r"[^\d]", "", text.split("(")[0]) or 0)


def work_done(df):
    """Rows read by scans and rows written by shuffles, as executed."""
    store = df.sparkSession._jsparkSession.sharedState().statusStore()
    df.write.format("noop").mode("overwrite").save()
    df.sparkSession.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    run = store.executionsList().last().executionId()
    values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
    out = Counter()
    for i in range(nodes.size()):
        node = nodes.apply(i)
        for j in range(node.metrics().size()):
            metric = node.metrics().apply(j)
            found = values.get(metric.accumulatorId())
            if found.isEmpty():
                continue
            if node.name().startswith("Scan") and metric.name() == "number of output rows":
                out["read"] += _number(found.get())
            if node.name().startswith("Exchange") and metric.name() == "shuffle records written":
                out["shuffled"] += _number(found.get())
    return out
