"""Knowledge graphs as two tables: nodes (id, label, kind) and edges (src, dst, weight, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rounds import settled


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both ends of which are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").select(*edges.columns)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Out-, in- and weighted out-degree of every node."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"), F.round(F.sum("weight"), 6).alias("out_weight"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    x = nodes.select("id").join(out, "id", "left").join(into, "id", "left")
    return x.select("id", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("out_degree", "in_degree")), F.coalesce("out_weight", F.lit(0.0)).alias("out_weight"))


def neighbours(edges: DataFrame, start: str) -> DataFrame:
    """Distinct neighbours of a node, whichever way the edge points."""
    return edges.where(F.col("src") == start).select(F.col("dst").alias("id")).union(edges.where(F.col("dst") == start).select("src")).distinct()


def page_rank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6, preferred: list[str] | None = None, standard: bool = False) -> DataFrame:
    """Scores once they change by less than the tolerance in sum, after so many rounds at most.

    base / n + (1 - base) * what the neighbours give by weight, where base is
    the damping itself (what the engine's users know), or one less it for the
    standard form. preferred: nodes that share the base among them.
    """
    n, base = nodes.count(), (1 - damping if standard else damping)
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    flows = settled(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("degree")).alias("part")))
    share = F.when(F.col("id").isin(*preferred), 1.0 / len(preferred)).otherwise(0.0) if preferred else F.lit(1.0 / max(n, 1))
    scores = settled(nodes.select("id", share.alias("base"), F.lit(1.0 / max(n, 1)).alias("score")))
    for _ in range(rounds):
        given = flows.join(scores, flows["src"] == scores["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("part")).alias("given"))
        new = base * F.col("base") + (1 - base) * F.coalesce("given", F.lit(0.0))
        scores = settled(scores.join(given, "id", "left").select("id", "base", new.alias("score"), F.abs(new - F.col("score")).alias("change")))
        if (scores.agg(F.sum("change")).first()[0] or 0.0) < tolerance:
            break
        scores = scores.drop("change")
    return scores.select("id", F.round("score", 9).alias("score"))


def reachable(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """Nodes within so many steps along edges, with the least number of steps."""
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, steps int")
    for step in range(1, depth + 1):
        front = seen.where(F.col("steps") == step - 1)
        new = edges.join(front, edges["src"] == front["id"]).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        new = settled(new.select("id", F.lit(step).alias("steps")))
        if new.isEmpty():
            break
        seen = seen.union(new)
    return seen


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Numbers of nodes and edges, density, mean and greatest out-degree."""
    d = degrees(nodes, edges)
    x = d.agg(F.count(F.lit(1)).alias("nodes"), F.sum("out_degree").alias("edges"), F.max("out_degree").alias("max_degree"))
    n = F.col("nodes")
    return x.select("nodes", "edges", F.round(F.col("edges") / (n * (n - 1)), 9).alias("density"), F.round(F.col("edges") / n, 6).alias("mean_degree"), "max_degree")


def cheapest(edges: DataFrame, start: str, rounds: int) -> DataFrame:
    """Least cost (1 / weight an edge), hops and nodes of the way to each node within so many edges; ties by the way's text."""
    costs = edges.groupBy("src", "dst").agg(F.min(1 / F.greatest("weight", F.lit(0.001))).alias("cost"))
    best = edges.sparkSession.createDataFrame([(start, 0.0, [start])], "id string, total double, way array<string>")
    for _ in range(rounds):
        more = costs.join(best, costs["src"] == best["id"]).select(F.col("dst").alias("id"), (F.col("total") + F.col("cost")).alias("total"), F.concat("way", F.array("dst")).alias("way"))
        new = settled(best.union(more).groupBy("id").agg(F.min(F.struct("total", "way")).alias("b")).select("id", "b.total", "b.way"))
        if new.exceptAll(best).isEmpty():
            break
        best = new
    return best.select("id", F.round("total", 6).alias("cost"), (F.size("way") - 1).alias("hops"), F.array_join("way", ">").alias("way"))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least node that each can reach, whichever way edges point."""
    both = settled(edges.select("src", "dst").union(edges.select("dst", "src")).toDF("a", "b").distinct())
    label = nodes.select("id", F.col("id").alias("component"))
    while True:
        near = both.join(label, both["b"] == label["id"]).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        new = label.join(near, "id", "left").select("id", F.least("component", F.coalesce("near", "component")).alias("new"), F.col("component").alias("old"))
        # a label's own label is nearer still: paths halve in each round
        shorter = new.select(F.col("id").alias("l_id"), F.col("new").alias("l_new"))
        new = settled(new.join(shorter, new["new"] == shorter["l_id"], "left").select("id", F.least("new", F.coalesce("l_new", "new")).alias("component"), "old"))
        done = new.where("component <> old").isEmpty()
        label = new.select("id", "component")
        if done:
            return label


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least node of those that each can reach and be reached from.

    In turns over what has no component yet: nodes without a way in or out are
    alone; the others take the least label of what reaches them, and of these
    labels' nodes, those that reach the label's own node form its component.
    """
    left, live = settled(nodes.select("id").distinct()), settled(edges.select("src", "dst").where("src <> dst").distinct())
    found = None

    def closed(rows: DataFrame, way: DataFrame) -> DataFrame:
        """Least label that reaches each node along (a, b)."""
        while True:
            come = way.join(rows, way["a"] == rows["id"]).groupBy(F.col("b").alias("id")).agg(F.min("label").alias("come"))
            new = settled(rows.join(come, "id", "left").select("id", F.least("label", F.coalesce("come", "label")).alias("label"), F.col("label").alias("old")))
            done = new.where("label <> old").isEmpty()
            rows = new.drop("old")
            if done:
                return rows

    while not left.isEmpty():
        color = closed(left.select("id", F.col("id").alias("label")), live.toDF("a", "b"))
        same = live.join(color.toDF("src", "ls"), "src").join(color.toDF("dst", "ld"), "dst").where("ls = ld")
        back = settled(same.select(F.col("dst").alias("a"), F.col("src").alias("b")))
        seeds = color.select("id", F.when(F.col("id") == F.col("label"), F.col("label")).alias("label"))
        reach = closed(seeds.select("id", F.coalesce("label", F.lit("\U0010ffff")).alias("label")), back)
        part = settled(reach.where(F.col("label") != "\U0010ffff").select("id", F.col("label").alias("component")))
        found = part if found is None else found.union(part)
        left = settled(left.join(part, "id", "left_anti"))
        live = settled(live.join(left.toDF("src"), "src", "left_semi").join(left.toDF("dst"), "dst", "left_semi"))
    least = found.groupBy("component").agg(F.min("id").alias("least")) if found is not None else None
    return found.join(least, "component").select("id", F.col("least").alias("component")) if found is not None else left.select("id", F.col("id").alias("component"))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, neighbours, closed, coefficient): the share of pairs of a node's out-neighbours with an edge between them, either way."""
    out = edges.select("src", "dst").where("src <> dst").distinct()
    degree = out.groupBy("src").agg(F.count(F.lit(1)).alias("neighbours"))
    rises = F.col("src") < F.col("dst")
    link = settled(out.groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(F.bool_or(rises).alias("xy"), F.bool_or(~rises).alias("yx")))
    # each link leaves its end with fewer links, so that a node leaves at most the square root of twice all links, hubs included
    links = link.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    ends = link.join(links.toDF("x", "nx"), "x").join(links.toDF("y", "ny"), "y")
    first = F.struct("nx", "x") < F.struct("ny", "y")
    leave = settled(ends.select(
        F.when(first, F.col("x")).otherwise(F.col("y")).alias("u"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("v"),
        F.when(first, F.col("xy")).otherwise(F.col("yx")).alias("uv"), F.when(first, F.col("yx")).otherwise(F.col("xy")).alias("vu"),
    ))
    wedges = leave.toDF("u", "x", "ux", "xu").join(leave.toDF("u", "y", "uy", "yu"), "u").where("x < y")
    corner = lambda way, node: F.when(way, F.col(node))
    ways = F.array(corner(F.col("ux") & F.col("uy"), "u"), corner(F.col("xu") & F.col("xy"), "x"), corner(F.col("yu") & F.col("yx"), "y"))
    triangles = wedges.join(link, ["x", "y"]).select(F.explode(F.array_compact(ways)).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("closed"))
    x = degree.withColumnRenamed("src", "id").join(triangles, "id", "left").withColumn("closed", F.coalesce("closed", F.lit(0)))
    pairs = F.col("neighbours") * (F.col("neighbours") - 1) / 2
    return x.select("id", "neighbours", "closed", F.round(F.when(F.col("neighbours") > 1, F.col("closed") / pairs).otherwise(0.0), 6).alias("coefficient"))


def simple_paths(edges: DataFrame, start: str, goal: str, depth: int, type_weights: dict[str, float], least: float = 0.1, most: int = 10) -> DataFrame:
    """Ways without repeats from start to goal by the sum of confidence * weight * type weight; steps under `least` are pruned. The `most` best: the operator's own bound."""
    weight = F.coalesce(*(F.when(F.col("kind") == k, F.lit(float(v))) for k, v in type_weights.items()), F.lit(1.0))
    steps = settled(edges.select("src", "dst", (F.col("confidence") * F.col("weight") * weight).alias("gain")).where(F.col("gain") >= least))
    front = edges.sparkSession.createDataFrame([(start, 0.0, [start])], "id string, score double, way array<string>")
    found = None
    for _ in range(depth):
        front = steps.join(front, steps["src"] == front["id"]).where(~F.array_contains("way", F.col("dst"))).select(F.col("dst").alias("id"), (F.col("score") + F.col("gain")).alias("score"), F.concat("way", F.array("dst")).alias("way"))
        front = settled(front)
        done = front.where(F.col("id") == goal)
        found = done if found is None else found.union(done)
        front = front.where(F.col("id") != goal)
    return found.select(F.array_join("way", ">").alias("way"), F.round("score", 6).alias("score"), F.size("way").alias("nodes")).orderBy(F.desc("score"), "way").limit(most)


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without these nodes (id) and the edges that touch them."""
    ids = gone.select("id")
    return nodes.join(ids, "id", "left_anti"), edges.join(ids.toDF("src"), "src", "left_anti").join(ids.toDF("dst"), "dst", "left_anti").select(*edges.columns)


def query_nodes(nodes: DataFrame, kinds: list[str], least_confidence: float, offset: int, limit: int) -> DataFrame:
    """A page of the nodes of these kinds and at least such confidence, by id."""
    return nodes.where(F.col("kind").isin(*kinds) & (F.col("confidence") >= least_confidence)).orderBy("id").offset(offset).limit(limit)


def query_edges(edges: DataFrame, sources: list[str], kinds: list[str], low: float, high: float) -> DataFrame:
    """Edges from these nodes, of these kinds, with a weight between the bounds."""
    return edges.where(F.col("src").isin(*sources) & F.col("kind").isin(*kinds) & F.col("weight").between(low, high))


def expand(nodes: DataFrame, edges: DataFrame, seeds: list[str], strategies: dict[str, float], least: float = 0.3, most: int = 20, focus: list[str] | None = None) -> DataFrame:
    """Terms near the seeds: neighbours either way over edges of each strategy's kind, confidence times its weight, `least` or more.

    A term keeps its best row; terms next to a focus node count half as much again. The `most` best terms: the operator's own bound.
    """
    both = edges.select("src", "dst", "kind", "confidence").union(edges.select("dst", "src", "kind", "confidence"))
    weight = F.coalesce(*(F.when(F.col("kind") == k, F.lit(float(v))) for k, v in strategies.items()))
    near = both.where(F.col("src").isin(*seeds) & ~F.col("dst").isin(*seeds) & F.col("kind").isin(*strategies)).withColumn("score", F.col("confidence") * weight).where(F.col("score") >= least)
    boost = F.when(F.col("src").isin(*(focus or [])), 1.5).otherwise(1.0) if focus else F.lit(1.0)
    rows = near.join(nodes.select(F.col("id").alias("dst"), F.lower("label").alias("term")), "dst").select("term", "kind", F.round(F.col("score") * boost, 6).alias("score"))
    best = rows.groupBy("term").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "term").limit(most)


def text_search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose label has all those words of the query that any label has."""
    wanted = sorted(set(query.lower().split()))
    tokens = nodes.select("id", F.explode(F.array_distinct(F.filter(F.transform(F.split(F.lower("label"), "\\s+"), lambda w: F.regexp_replace(w, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")), lambda w: w != ""))).alias("word")).where(F.col("word").isin(*wanted))
    known = tokens.agg(F.countDistinct("word").alias("known"))
    return tokens.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(known)).where("n = known").select("id")  # known is one row


def merge_nodes(mine: DataFrame, other: DataFrame) -> DataFrame:
    """Both sets of nodes by id; where both have one, mine stays."""
    return mine.unionByName(other.join(mine.select("id"), "id", "left_anti").select(*mine.columns))


def kinds(nodes: DataFrame, edges: DataFrame, bytes_each: int = 1000) -> DataFrame:
    """(item, kind, n, bytes): nodes and edges by kind, at a set size each."""
    count = lambda x, item: x.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(item).alias("item"), "kind", "n", (F.col("n") * bytes_each).alias("bytes"))
    return count(nodes, "node").union(count(edges, "edge"))


BATCH_ROWS = 20_000_000  # (source, node) pairs that a batch of betweenness() aims at
TWIN_LINKS = 32  # links of a source that is looked for twins


def _sources(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, weight): the nodes, but of those that nothing links to and that link to the same nodes only the least, with their number."""
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= TWIN_LINKS).select("src")
    roots = out.join(links.select(F.col("dst").alias("src")), "src", "left_anti")
    near = links.join(roots, "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("near"))
    twins = near.join(ids, "id", "left_semi").groupBy("near").agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("double").alias("weight"))
    others = ids.join(near.select("id"), "id", "left_anti")
    return twins.select("id", "weight").unionByName(others.withColumn("weight", F.lit(1.0)))


def betweenness(nodes: DataFrame, edges: DataFrame, batch: int = 256) -> DataFrame:
    """(id, betweenness): the share of shortest ways between two others that pass each node, summed over these, over (n - 1)(n - 2).

    Sources go in batches. From each source, ways are counted level by level;
    then what nodes owe to those behind them flows back, one level at a time. A
    level is a table of (source, node, ways), so that a batch of `batch` sources
    holds that many times the nodes at most. Batches grow while sources reach few
    nodes, up to BATCH_ROWS pairs or so. Sources that no way can pass or end at
    and that link to the same nodes owe them the same: one stands for all.
    Edges that repeat count once, loops not at all.
    """
    ids = settled(nodes.select("id").distinct())
    links = settled(edges.select("src", "dst").where("src <> dst").distinct())
    n = ids.count()
    every = settled(_sources(ids, links))
    m = max(every.count(), 1)
    place = F.pmod(F.xxhash64("id"), F.lit(m))
    owed, at, size = None, 0, batch
    while at < m:
        sources = every.where((place >= at) & (place < at + size))
        levels = [settled(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("ways"), "weight"))]
        seen = levels[0].select("s", "v")
        pairs = 0
        while True:
            ahead = links.join(levels[-1], links["src"] == levels[-1]["v"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum("ways").alias("ways"), F.max("weight").alias("weight"))
            level = settled(ahead.join(seen, ["s", "v"], "left_anti"))
            if not (rows := level.count()):
                break
            pairs += rows
            levels.append(level)
            seen = seen.union(level.select("s", "v"))
        back = None
        for level, before in zip(levels[:0:-1], levels[-2::-1], strict=True):
            here = level.withColumn("owed", F.lit(0.0)) if back is None else level.join(back.select("s", "v", "owed"), ["s", "v"], "left").select("s", "v", "ways", "weight", F.coalesce("owed", F.lit(0.0)).alias("owed"))
            each = links.join(here.select("s", F.col("v").alias("dst"), ((F.col("weight") + F.col("owed")) / F.col("ways")).alias("part")), "dst").select("s", F.col("src").alias("v"), "part")
            back = settled(before.join(each, ["s", "v"]).groupBy("s", "v").agg((F.first("ways") * F.sum("part")).alias("owed")))
            middle = back.where("s <> v").groupBy("v").agg(F.sum("owed").alias("owed"))
            owed = middle if owed is None else owed.union(middle)
        owed = owed and settled(owed.groupBy("v").agg(F.sum("owed").alias("owed")))
        at, size = at + size, max(batch, min(16 * size, BATCH_ROWS * size // max(pairs, 1)))
    scale = float((n - 1) * (n - 2)) if n > 2 else 1.0
    if owed is None:
        return ids.select("id", F.lit(0.0).alias("betweenness"))
    return ids.join(owed.withColumnRenamed("v", "id"), "id", "left").select("id", F.round(F.coalesce("owed", F.lit(0.0)) / scale, 9).alias("betweenness"))
