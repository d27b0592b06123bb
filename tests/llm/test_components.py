import random

import pytest

from tracegrain.llm import near_dedup


def components(nodes, edges):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "shuffled chain"])
def test_labels_are_the_least_node_of_each_component(spark, kind):
    rng = random.Random(1)
    nodes = list(range(60))
    if kind == "chain":
        edges = [(i, i + 1) for i in range(45)]
    elif kind == "star":
        edges = [(59, i) for i in range(40)]
    elif kind == "random":
        edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    else:
        order = rng.sample(nodes, 50)
        edges = list(zip(order, order[1:]))
    labels = spark.createDataFrame([(n, n) for n in nodes], "node long, root long")
    got = near_dedup.merge_labels(labels, spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == components(nodes, edges)


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace as Fake

    import pytest

    from tracegrain.llm import workspace

    context = Fake(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_folder(Fake(sparkContext=context, conf=Fake(get=lambda key, other: other)))
