"""Graphs of explicit links: edges, hops from a seed, degrees, missing nodes, paths, cycles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EDGE_COLUMNS = ["src", "dst", "relation", "source_type", "source_file", "detail", "node_id", "at"]


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with a checkpoint in the shared folder (spark.checkpoint.dir); where none is set and all runs
    in this one process, in a folder made for it. On a cluster it must be set."""
    sc = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        import tempfile

        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")

        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strataprobe-"))
    return df.checkpoint()


def edge_set(edges: DataFrame, order: list) -> DataFrame:
    """One row for each (src, dst, relation), the first by order; empty ends are no edges."""
    real = edges.where("coalesce(src, '') <> '' and coalesce(dst, '') <> ''")
    w = Window.partitionBy("src", "dst", "relation").orderBy(*order)
    return real.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def allocation_edges(allocs: DataFrame) -> DataFrame:
    """allocs(id, previous_allocation, next_allocation, reschedule_tracker, sources) -> edges."""
    where_from = F.array_join(F.slice("sources", 1, 3), ", ")
    base = allocs.select("id", "previous_allocation", "next_allocation", "reschedule_tracker", where_from.alias("source_file"))
    none = F.lit(None).cast("string")
    def edge(df, src, dst, relation, node=none, at=none, detail=""):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), F.lit("allocation_field").alias("source_type"), "source_file", F.lit(detail).alias("detail"), node.alias("node_id"), at.alias("at"))
    events = base.select("id", "source_file", F.explode(F.from_json(F.get_json_object("reschedule_tracker", "$.Events"), "array<struct<PrevAllocID:string,PrevNodeID:string,RescheduleTime:string>>")).alias("e"))
    return edge_set(
        edge(base, F.col("previous_allocation"), F.col("id"), "previous_allocation", detail="PreviousAllocation")
        .unionByName(edge(base, F.col("id"), F.col("next_allocation"), "next_allocation", detail="NextAllocation"))
        .unionByName(edge(events, F.col("e.PrevAllocID"), F.col("id"), "reschedule_tracker", F.col("e.PrevNodeID"), F.col("e.RescheduleTime"), "RescheduleTracker.Events")),
        ["source_file", "at"],
    )


def evaluation_edges(evals: DataFrame) -> DataFrame:
    where_from = F.array_join(F.slice("sources", 1, 3), ", ")
    base = evals.select("id", "previous_eval", "next_eval", "blocked_eval", where_from.alias("source_file"))
    none = F.lit(None).cast("string")
    def edge(src, dst, relation, detail):
        return base.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(relation).alias("relation"), F.lit("evaluation_field").alias("source_type"), "source_file", F.lit(detail).alias("detail"), none.alias("node_id"), none.alias("at"))
    return edge_set(
        edge("previous_eval", "id", "previous_eval", "PreviousEval").unionByName(edge("id", "next_eval", "next_eval", "NextEval")).unionByName(edge("id", "blocked_eval", "blocked_eval", "BlockedEval")),
        ["source_file"],
    )


def hops_from(edges: DataFrame, seeds: DataFrame, max_depth: int = 50) -> DataFrame:
    """edges(src, dst), seeds(node) -> node, depth: least number of edges, in either direction, up to
    max_depth. Neighbours of a hop's nodes lie in it, in the one before or in the next, so a hop is a join and two anti-joins
    on frontiers alone; each is cut."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct()
    both = cut(both)
    before, frontier = None, cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    seen = [frontier]
    for depth in range(1, max_depth + 1):
        step = frontier.join(both, frontier["node"] == both["a"]).select(F.col("b").alias("node")).distinct().join(frontier, "node", "left_anti")
        if before is not None:
            step = step.join(before, "node", "left_anti")
        before, frontier = frontier, cut(step.withColumn("depth", F.lit(depth)))
        if not frontier.take(1):
            break
        seen.append(frontier)
    return _union(seen)


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among nodes(node)."""
    n = nodes.select("node")
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, n_in, n_out, kind: root, leaf, branch, or through. Multiple edges between two nodes count once."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    if nodes is not None:
        ends = ends.unionByName(nodes.select("node", F.lit(0).alias("o"), F.lit(0).alias("i")))
    d = ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    kind = F.when(F.col("n_out") > 1, "branch").when(F.col("n_in") == 0, "root").when(F.col("n_out") == 0, "leaf").otherwise("through")
    return d.withColumn("kind", kind)


def missing_nodes(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edge ends that no entity(id) stands for."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return ends.join(entities.select(F.col("id").alias("node")), "node", "left_anti")


class SubgraphTooLarge(RuntimeError):
    """The part of the graph that was to be walked on the driver is over its bound."""


def collect_subgraph(edges: DataFrame, most: int = 200_000) -> dict[str, list[str]]:
    """Successors by node, sorted; for a depth-bounded part of a graph only, and checked: more than `most`
    edges are refused."""
    rows = edges.select("src", "dst").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise SubgraphTooLarge(f"more than {most} edges")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["src"], []).append(r["dst"])
        out.setdefault(r["dst"], [])
    return {n: sorted(s) for n, s in sorted(out.items())}


def cycles(successors: dict[str, list[str]]) -> list[list[str]]:
    """Cycles closed by back edges of a depth-first walk in sorted order, each from its least node on."""
    found: dict[tuple[str, ...], None] = {}
    done: set[str] = set()
    for top in successors:
        if top in done:
            continue
        path, at, stack = [top], {top: 0}, [iter(successors[top])]
        while stack:
            nxt = next(stack[-1], None)
            if nxt is None:
                stack.pop()
                node = path.pop()
                del at[node]
                done.add(node)
            elif nxt in at:
                ring = path[at[nxt] :]
                k = ring.index(min(ring))
                found[tuple(ring[k:] + ring[:k])] = None
            elif nxt not in done:
                at[nxt] = len(path)
                path.append(nxt)
                stack.append(iter(successors[nxt]))
    return [list(r) + [r[0]] for r in found]


def root_paths(successors: dict[str, list[str]], most: int = 50) -> list[list[str]]:
    """Root-to-leaf paths in sorted order, at most `most`; without a root every node starts one. A node met again ends
    its path, repeated."""
    heads = {d for s in successors.values() for d in s}
    roots = [n for n in successors if n not in heads] or list(successors)
    out: list[list[str]] = []
    stack = [[r] for r in reversed(roots)]
    while stack and len(out) < most:
        path = stack.pop()
        nexts = successors.get(path[-1], [])
        if path[-1] in path[:-1] or not nexts:
            out.append(path)
        else:
            stack.extend([*path, n] for n in reversed(nexts))
    return out


def walked_parts(edges: DataFrame, most: int = 200_000) -> DataFrame:
    """edges(part, src, dst) -> part, kind (cycle or path), no, nodes: cycles() and root_paths() of each part of a graph, such as a
    component or what lies near a seed, each walked in one task. A part of over `most` edges is refused."""
    kind = edges.schema["part"].dataType.simpleString()

    def walk(frame):
        if len(frame) > most:
            raise SubgraphTooLarge(f"more than {most} edges")
        successors: dict[str, list[str]] = {}
        for a, b in sorted(set(zip(frame["src"], frame["dst"]))):
            successors.setdefault(a, []).append(b)
            successors.setdefault(b, [])
        successors = dict(sorted(successors.items()))
        found = [("cycle", i, x) for i, x in enumerate(cycles(successors))] + [("path", i, x) for i, x in enumerate(root_paths(successors))]
        out = pd.DataFrame(found, columns=["kind", "no", "nodes"])
        out.insert(0, "part", frame["part"].iloc[0])
        return out

    return edges.select("part", "src", "dst").groupBy("part").applyInPandas(walk, f"part {kind}, kind string, no long, nodes array<string>")


def frame_of_paths(spark: SparkSession, paths: list[list[str]]) -> DataFrame:
    return spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "path_no int, nodes array<string>")


def _ranked(nodes: DataFrame, prev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(node), prev(node, before), at most one before a node -> (node, top, dist) of the nodes whose line begins at
    a top, and (node, least) of those on a ring, with the ring's least node. Pointers double, so the rounds grow
    with the logarithm of a line, and a round keeps one row a node."""
    known = F.col("before").isNotNull()
    state = nodes.join(prev, "node", "left").select(
        "node", F.coalesce("before", "node").alias("top"), F.when(known, 1).otherwise(0).cast("long").alias("dist"), (~known).alias("done"), F.least("node", F.coalesce("before", "node")).alias("least"), F.lit(False).alias("moved")
    )
    state, open_before = cut(state), -1
    while True:
        n_open, moved = state.agg(F.count_if(~F.col("done")), F.count_if("moved")).first()
        # a line that isn't ranked to its end ends for some node in every round; a ring that isn't seen whole moves
        if not n_open or (n_open == open_before and not moved):
            break
        t = state.select(F.col("node").alias("t_node"), F.col("top").alias("t_top"), F.col("dist").alias("t_dist"), F.col("done").alias("t_done"), F.col("least").alias("t_least"))
        least = F.least("least", "t_least")
        step = state.where(~F.col("done")).join(t, F.col("top") == F.col("t_node")).select(
            "node", F.col("t_top").alias("top"), (F.col("dist") + F.col("t_dist")).alias("dist"), F.col("t_done").alias("done"), least.alias("least"), (least < F.col("least")).alias("moved")
        )
        state, open_before = cut(state.where("done").withColumn("moved", F.lit(False)).unionByName(step)), n_open
    return state.where("done").select("node", "top", "dist"), state.where(~F.col("done")).select("node", "least")


def stretches(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """edges(src, dst), nodes(node) that may have none -> (id, nodes, closed) and (a, b): nodes joined to unbranched stretches
    that are named by their first node, closed for a ring beside the rest, and the edges from stretch to stretch."""
    e = cut(edges.select("src", "dst").where("coalesce(src, '') <> '' and coalesce(dst, '') <> ''").distinct())
    all_nodes = e.select(F.col("src").alias("node")).union(e.select("dst"))
    if nodes is not None:
        all_nodes = all_nodes.union(nodes.select("node").where("coalesce(node, '') <> ''"))
    outs, ins = e.groupBy("src").agg(F.count("*").alias("n_out")), e.groupBy("dst").agg(F.count("*").alias("n_in"))
    e = cut(e.join(outs, "src").join(ins, "dst").select("src", "dst", ((F.col("n_out") == 1) & (F.col("n_in") == 1)).alias("single")))
    prev = e.where("single").select(F.col("dst").alias("node"), F.col("src").alias("before"))
    lines, rings = _ranked(all_nodes.distinct(), prev)
    opened = prev.join(rings, "node").where("node <> least").select("node", "before")
    around, _ = _ranked(rings.select("node"), opened)
    placed = cut(lines.withColumn("closed", F.lit(False)).unionByName(around.withColumn("closed", F.lit(True))))
    parts = placed.groupBy("top", "closed").agg(F.array_sort(F.collect_list(F.struct("dist", "node"))).alias("n"))
    links = e.where(~F.col("single")).join(placed, e["src"] == placed["node"]).select(F.col("top").alias("a"), F.col("dst").alias("b"))
    return cut(parts.select(F.col("top").alias("id"), F.col("n.node").alias("nodes"), "closed")), cut(links)


def all_root_paths(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(nodes): what root_paths gives without its bound, walked on the executors, one join a branching. nodes(node) adds nodes
    without edges, each a path of its own."""
    parts, links = stretches(edges, nodes)
    starts = parts.where(~F.col("closed")).join(links.select(F.col("b").alias("id")), "id", "left_anti")
    if not starts.take(1):
        # every node starts a path, also inside a stretch
        links = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("coalesce(a, '') <> '' and coalesce(b, '') <> ''").distinct()
        parts = parts.select(F.explode("nodes").alias("id")).select("id", F.array("id").alias("nodes"))
        starts = parts
    onward = parts.select(F.col("id").alias("b"), F.col("nodes").alias("more"))
    frontier, found = cut(starts.select("nodes", F.col("id").alias("a"))), []
    while True:
        step = cut(frontier.join(links, "a", "left").join(onward, "b", "left").withColumn("again", F.coalesce(F.array_contains("nodes", F.col("b")), F.lit(False))))
        ended = F.col("b").isNull() | F.col("again")
        found.append(step.where(ended).select(F.when(F.col("again"), F.concat("nodes", F.array("b"))).otherwise(F.col("nodes")).alias("nodes")))
        frontier = step.where(~ended).select(F.concat("nodes", "more").alias("nodes"), F.col("b").alias("a"))
        if not frontier.take(1):
            break
    return _union(found)


def all_cycles(edges: DataFrame) -> DataFrame:
    """(nodes): every cycle that meets no node twice, from its least node on and closed with it, walked on the executors.
    cycles() gives those of them that back edges close."""
    parts, links = stretches(edges)
    found = [parts.where("closed").select("nodes")]
    n = links.count()
    while n:  # what has no way in or no way out is on no cycle
        kept = links.join(links.select(F.col("b").alias("a")), "a", "left_semi").join(links.select(F.col("a").alias("b")), "b", "left_semi")
        before, links = n, cut(kept.select("a", "b"))
        n = links.count()
        if n == before:
            break
    onward = parts.select(F.col("id").alias("b"), F.col("nodes").alias("more"))
    frontier = parts.select(F.col("id").alias("start"), F.array("id").alias("ids"), "nodes", F.col("id").alias("a")).join(links.select("a"), "a", "left_semi")
    while n:
        step = cut(frontier.join(links, "a").where((F.col("b") >= F.col("start")) & ((F.col("b") == F.col("start")) | ~F.array_contains("ids", F.col("b")))).join(onward, "b"))
        found.append(step.where("b = start").select("nodes"))
        frontier = step.where("b > start").select("start", F.concat("ids", F.array("b")).alias("ids"), F.concat("nodes", "more").alias("nodes"), F.col("b").alias("a"))
        if not frontier.take(1):
            break
    k = F.array_position("nodes", F.array_min("nodes")).cast("int")
    turned = F.concat(F.slice("nodes", k, F.size("nodes")), F.slice("nodes", F.lit(1), k - 1), F.array(F.array_min("nodes")))
    return _union(found).select(turned.alias("nodes"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
