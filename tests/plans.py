"""What executed plans move."""


def moved_columns(df):
    """What stands in the output of every exchange of the executed plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = set(), [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        if name.endswith("Exchange"):
            found |= {a.name() for a in _list(node.output())}
        todo += _list(node.children())
    return found


def _list(seq):
    return [seq.apply(i) for i in range(seq.size())]
