"""Coauthor and citation graphs: edges, neighbourhoods, relations, components, communities."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliograph.session import cut


def authorship(papers: DataFrame) -> DataFrame:
    """(item_id, author, team): distinct authors of each paper and how many they are."""
    pairs = papers.select("item_id", F.explode("creators.name_id").alias("author")).where("author IS NOT NULL").distinct()
    return pairs.join(pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("team")), "item_id")


def coauthor_edges(papers: DataFrame) -> DataFrame:
    """(a, b, strength, papers), a < b: strength sums 1 / (team - 1) over common papers."""
    x = authorship(papers)
    a, b = x.select("item_id", "team", F.col("author").alias("a")), x.select("item_id", F.col("author").alias("b"))
    both = a.join(b, "item_id").where("a < b")
    return both.groupBy("a", "b").agg(F.round(F.sum(1.0 / F.greatest(F.col("team") - 1, F.lit(1))), 6).alias("strength"), F.count(F.lit(1)).alias("papers"))


def both_ways(edges: DataFrame) -> DataFrame:
    swapped = edges.select(*[F.col({"a": "b", "b": "a"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(swapped)


def strongest(edges: DataFrame, k: int = 12) -> DataFrame:
    """The k strongest edges of each author, with their rank."""
    w = W.partitionBy("a").orderBy(F.col("strength").desc(), F.col("papers").desc(), "b")
    return both_ways(edges).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def author_nodes(papers: DataFrame) -> DataFrame:
    """(author, papers, any_local, title): the title is the longest, the least of equals."""
    p = papers.select("item_id", "title", "local", F.explode("creators.name_id").alias("author")).where("author IS NOT NULL").distinct()
    best = F.min_by("title", F.struct(-F.length("title"), F.col("title")))
    return p.groupBy("author").agg(F.countDistinct("item_id").alias("papers"), F.bool_or("local").alias("any_local"), best.alias("title"))


def busiest_author(papers: DataFrame) -> DataFrame:
    """One row (author): the one of most papers, the least of equals."""
    n = papers.select("item_id", F.explode("creators.name_id").alias("author")).where("author IS NOT NULL").distinct().groupBy("author").count()
    return n.orderBy(F.col("count").desc(), "author").limit(1).select("author")


def neighbourhood(edges: DataFrame, centre: DataFrame, depth: int = 1, limit: int = 600) -> DataFrame:
    """(author, depth, evidence): direct coauthors of the centre and, at depth 2, theirs, by common papers; the best `limit`."""
    both = both_ways(edges)
    first = both.join(F.broadcast(centre.select(F.col("author").alias("a"))), "a").select(F.col("b").alias("author"), F.lit(1).alias("depth"), F.col("papers").alias("evidence"))
    out = first
    if depth > 1:
        second = both.join(first.select(F.col("author").alias("a")), "a").groupBy(F.col("b").alias("author")).agg(F.sum("papers").alias("evidence"))
        known = first.select("author").unionByName(centre.select("author"))
        out = first.unionByName(second.join(known, "author", "left_anti").select("author", F.lit(2).alias("depth"), "evidence"))
    return out.orderBy("depth", F.col("evidence").desc(), "author").limit(limit)


def group_relations(members: DataFrame) -> DataFrame:
    """(a, b, papers, affinity), a < b, of groups given as (group, item_id): common papers against the groups' sizes."""
    m = members.select("group", "item_id").distinct()
    size = m.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    a, b = m.select("item_id", F.col("group").alias("a")), m.select("item_id", F.col("group").alias("b"))
    pair = a.join(b, "item_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("papers"))
    pair = pair.join(size.select(F.col("group").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("group").alias("b"), F.col("n").alias("nb")), "b")
    relative = F.col("papers") / F.sqrt(F.col("na") * F.col("nb"))
    return pair.select("a", "b", "papers", F.round(1 - F.exp(-0.45 * F.log2(1 + F.col("papers")) - 0.55 * relative), 6).alias("affinity"))


def link_relations(links: DataFrame) -> DataFrame:
    """(a, b, weight, affinity, gap), a < b, of groups linked by (ga, gb, weight): share of each group's volume that crosses."""
    w = links.where("ga IS NOT NULL AND gb IS NOT NULL")
    volume = w.select(F.col("ga").alias("g"), "weight").unionByName(w.select(F.col("gb").alias("g"), "weight")).groupBy("g").agg(F.sum("weight").alias("v"))
    cross = w.where("ga <> gb").groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.sum("weight").alias("weight"))
    cross = cross.join(volume.select(F.col("g").alias("a"), F.col("v").alias("va")), "a").join(volume.select(F.col("g").alias("b"), F.col("v").alias("vb")), "b")
    affinity = 1 - F.exp(-6 * F.sqrt(F.col("weight") / F.col("va") * (F.col("weight") / F.col("vb"))))
    return cross.select("a", "b", "weight", F.round(affinity, 6).alias("affinity"), F.round(48 + 250 * F.pow(1 - affinity, 2), 4).alias("gap"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, signals): distinct neighbours, and rows counted for them."""
    return both_ways(edges.select("a", "b", "n")).groupBy(F.col("a").alias("node")).agg(F.countDistinct("b").alias("degree"), F.sum("n").alias("signals"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each node's component; minima over neighbours and pointer jumps, until nothing moves."""
    both = cut(both_ways(edges.select("a", "b")).distinct())
    labels = cut(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "c").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        step = cut(step.join(jump, "component").select("node", "was", F.col("root").alias("component")))
        labels = step.select("node", "component")
        if step.where("was <> component").isEmpty():
            return labels


# --- communities --------------------------------------------------------------------------------------------------
def modularity_groups(edges: Iterable[tuple], total: float | None = None, resolution: float = 1.05, levels: int = 8, passes: int = 24) -> list[list]:
    """Groups of nodes by multilevel modularity; `total` is the weight of the whole graph where edges are one component of it."""
    links: dict = {}
    for a, b, w in edges:
        if a != b and w > 0:
            links.setdefault(a, {})[b] = links.setdefault(a, {}).get(b, 0.0) + w
            links.setdefault(b, {})[a] = links.setdefault(b, {}).get(a, 0.0) + w
    groups = {n: [n] for n in links}
    whole = 2 * total if total is not None else sum(sum(v.values()) for v in links.values())
    loops = dict.fromkeys(links, 0.0)
    for level in range(levels):
        if not links or whole <= 0:
            break
        gamma = resolution if level == 0 else max(2.0, resolution)
        nodes = sorted(links)
        label = {n: i for i, n in enumerate(nodes)}
        degree = {n: loops[n] + sum(links[n].values()) for n in nodes}
        volume = {label[n]: degree[n] for n in nodes}
        for _ in range(passes):
            moved = False
            for n in nodes:
                home = label[n]
                volume[home] -= degree[n]
                pull: dict[int, float] = {home: 0.0}
                for m, w in links[n].items():
                    pull[label[m]] = pull.get(label[m], 0.0) + w
                best, gain = home, pull[home] - gamma * degree[n] * volume[home] / whole
                for c in sorted(pull):
                    value = pull[c] - gamma * degree[n] * volume[c] / whole
                    if value > gain + 1e-10:
                        best, gain = c, value
                volume[best] += degree[n]
                if best != home:
                    label[n], moved = best, True
            if not moved:
                break
        # a label whose nodes hang together only through others falls apart
        part: dict = {}
        for n in nodes:
            if n in part:
                continue
            part[n] = n
            stack = [n]
            while stack:
                x = stack.pop()
                for m in links[x]:
                    if m not in part and label[m] == label[n]:
                        part[m] = n
                        stack.append(m)
        if len(set(part.values())) == len(nodes):
            break
        merged: dict = {}
        new_links: dict = {}
        new_loops: dict = {}
        for n in nodes:
            merged.setdefault(part[n], []).extend(groups[n])
            new_loops[part[n]] = new_loops.get(part[n], 0.0) + loops[n]
            new_links.setdefault(part[n], {})
            for m, w in links[n].items():
                if part[m] == part[n]:
                    new_loops[part[n]] += w
                else:
                    new_links[part[n]][part[m]] = new_links[part[n]].get(part[m], 0.0) + w
        groups, links, loops = merged, new_links, new_loops
    return sorted((sorted(g) for g in groups.values()), key=lambda g: (-len(g), g[0]))


def communities(edges: DataFrame, resolution: float = 1.05) -> DataFrame:
    """(node, community, component): modularity communities, solved per connected component with the weight of the whole graph.

    The method visits nodes one after another, so a component is one task's
    work; components are independent. A community is named by its least node.
    """
    comp = components(edges)
    total = edges.agg(F.sum("weight")).first()[0] or 0.0
    placed = edges.select("a", "b", "weight").join(comp.select(F.col("node").alias("a"), "component"), "a")

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["a", "b"])
        groups = modularity_groups(zip(rows["a"], rows["b"], rows["weight"]), total, resolution)
        return pd.DataFrame([(n, g[0], key[0]) for g in groups for n in g], columns=["node", "community", "component"])

    kind = dict(edges.dtypes)["a"]
    return placed.groupBy("component").applyInPandas(solve, f"node {kind}, community {kind}, component {kind}")


def signatures(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """(component, signature): a digest of each component's edges, the same in whatever order they come."""
    rows = edges.join(comp.select(F.col("node").alias("a"), "component"), "a").select("component", F.xxhash64("a", "b", "weight").alias("h"), F.xxhash64("b", "weight", "a").alias("g"))
    return rows.groupBy("component").agg(F.concat_ws(":", F.count(F.lit(1)), F.bit_xor("h"), F.bit_xor("g")).alias("signature"))


def communities_incremental(edges: DataFrame, before_edges: DataFrame, before: DataFrame, resolution: float = 1.05) -> DataFrame:
    """As communities(edges), reusing `before` (of before_edges) for components that did not change.

    A component is reused where its edges and the weight of the whole graph
    are as they were; then its communities are the same, being a function of both.
    """
    comp = components(edges)
    now, then = signatures(edges, comp), signatures(before_edges, before.select("node", "component").distinct())
    same_total = abs((edges.agg(F.sum("weight")).first()[0] or 0.0) - (before_edges.agg(F.sum("weight")).first()[0] or 0.0)) < 1e-9
    kept = now.join(then, ["component", "signature"], "left_semi").select("component") if same_total else now.select("component").limit(0)
    reused = before.join(kept, "component", "left_semi").select("node", "community", "component")
    changed = comp.join(kept, "component", "left_anti")
    total = edges.agg(F.sum("weight")).first()[0] or 0.0
    placed = edges.select("a", "b", "weight").join(changed.select(F.col("node").alias("a"), "component"), "a")

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["a", "b"])
        groups = modularity_groups(zip(rows["a"], rows["b"], rows["weight"]), total, resolution)
        return pd.DataFrame([(n, g[0], key[0]) for g in groups for n in g], columns=["node", "community", "component"])

    kind = dict(edges.dtypes)["a"]
    fresh = placed.groupBy("component").applyInPandas(solve, f"node {kind}, community {kind}, component {kind}")
    return reused.unionByName(fresh)


def overview(groups: DataFrame, edges: DataFrame, papers: DataFrame) -> DataFrame:
    """(community, members, papers, representative): the representative has most papers, then most neighbours, then the least id."""
    deg = both_ways(edges.select("a", "b")).groupBy(F.col("a").alias("node")).agg(F.countDistinct("b").alias("degree"))
    own = papers.select("item_id", F.explode("creators.name_id").alias("node")).where("node IS NOT NULL").distinct()
    n = own.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    m = groups.join(deg, "node", "left").join(n, "node", "left")
    whole = groups.join(own, "node").groupBy("community").agg(F.countDistinct("item_id").alias("papers"))
    best = F.max_by("node", F.struct(F.coalesce("n", F.lit(0)), F.coalesce("degree", F.lit(0)), -F.col("node")))
    return m.groupBy("community").agg(F.count(F.lit(1)).alias("members"), best.alias("representative")).join(whole, "community", "left")
