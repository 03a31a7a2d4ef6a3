import random

from pyspark.sql import functions as F

from foliograph.operators import graph


def cliques():
    rows = [(f"p{i:02}", f"p{j:02}", 1.0) for base in (0, 8) for i in range(base, base + 8) for j in range(i + 1, base + 8)]
    return rows + [("p07", "p08", 0.02)]


def test_two_cliques():
    assert graph.modularity_groups(cliques()) == [[f"p{i:02}" for i in range(8)], [f"p{i:02}" for i in range(8, 16)]]


def test_order_does_not_matter():
    rows = cliques()
    random.Random(784).shuffle(rows)
    assert graph.modularity_groups([(b, a, w) for a, b, w in rows]) == graph.modularity_groups(cliques())


def test_components_and_incremental(spark):
    rng = random.Random(784)
    rows = {(min(a, b), max(a, b)): 0.1 + rng.random() for k in range(4) for a in range(20 * k, 20 * k + 20) for b in range(20 * k, 20 * k + 20) if a != b and rng.random() < 0.25}
    df = lambda r: spark.createDataFrame([(a, b, w) for (a, b), w in r.items()], "a bigint, b bigint, weight double")
    comp = {r["node"]: r["component"] for r in graph.components(df(rows)).collect()}
    assert set(comp.values()) == {0, 20, 40, 60}
    before = graph.communities(df(rows)).cache()
    changed = dict(rows)
    e = next(iter(changed))
    other = next(k for k in changed if k[0] >= 40)
    changed[e], changed[other] = changed[e] + 0.05, changed[other] - 0.05  # the whole graph's weight stays
    full = {(r["node"], r["community"]) for r in graph.communities(df(changed)).collect()}
    inc = {(r["node"], r["community"]) for r in graph.communities_incremental(df(changed), df(rows), before).collect()}
    assert inc == full


def test_coauthor_strength(spark):
    p = spark.createDataFrame([(1, [(1,), (2,), (3,)]), (2, [(1,), (2,)]), (3, []), (4, None)], "item_id bigint, creators array<struct<name_id:bigint>>")
    e = {(r["a"], r["b"]): (r["strength"], r["papers"]) for r in graph.coauthor_edges(p).collect()}
    assert e == {(1, 2): (1.5, 2), (1, 3): (0.5, 1), (2, 3): (0.5, 1)}
    assert graph.strongest(graph.coauthor_edges(p), 1).where(F.col("a") == 1).first()["b"] == 2
