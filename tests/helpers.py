"""What several tests import. A module of its own: each test folder has a ``conftest``, so that name is not unique."""

SMALL = "/root/testdata/sf0.001"


def values(df, *columns):
    """Rows as a sorted list of tuples."""
    rows = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in rows), key=str)


def nodes(df):
    """Nodes of the plan of ``df`` as it ran."""
    df.collect()
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        yield node
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]


def joined_rows(df):
    """Rows that each join of ``df`` puts out."""
    counts = [(n.nodeName(), n.metrics().get("numOutputRows")) for n in nodes(df)]
    return [m.get().value() for name, m in counts if "Join" in name and m.isDefined()]
