import random
import re

from hashwood.llm.components import components


def brute(edges):
    label = {x: x for e in edges for x in e}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        label[high] = low
    return {x: root(x) for x in label}


def joined_rows(spark, since):
    """Rows that joins by b made in executions from since on, and the number of the next one."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    total, listed = 0, store.executionsList()
    for i in range(listed.size()):
        number = listed.apply(i).executionId()
        if number < since:
            continue
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            if re.match(r"\w+Join \[b#\d+L?\], \[b#\d+L?\], Inner", node.desc()):
                metrics = node.metrics()
                for k in range(metrics.size()):
                    if metrics.apply(k).name() == "number of output rows" and (found := values.get(metrics.apply(k).accumulatorId())).isDefined():
                        total += int(found.get().replace(",", ""))
    return total, max((listed.apply(i).executionId() + 1 for i in range(listed.size())), default=0)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    for n, m in ((1, 1), (30, 20), (300, 200), (300, 320)):
        edges = [(rng.randrange(n) * 7 - 50, rng.randrange(n) * 7 - 50) for _ in range(m)]
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        linked = [e for e in edges if e[0] != e[1]]
        assert got == brute(linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_settled_edges_are_not_joined_again(spark):
    rng = random.Random(5)
    # A large group whose members know several centres, beside a long path that takes some more rounds.
    dense = {(rng.randrange(40), x) for x in range(40, 1000) for _ in range(10)} | {(0, x) for x in range(1, 40)}
    path = [*range(2000, 2040)]
    rng.shuffle(path)
    edges = sorted(dense | set(zip(path, path[1:], strict=False)))
    since = joined_rows(spark, 0)[1]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)
    made = joined_rows(spark, since)[0]
    assert 0 < made < 2.5 * 2 * len(edges)
