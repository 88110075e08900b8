"""Property graphs: ``vertices(id, label, props)`` and ``edges(src, dst, label, weight, directed...)``.

Properties are columns of their own or fields of a JSON text ``props``. Traversals
advance a frontier by joins and go on until nothing changes; a bound on depth or
steps is a parameter. Every round is written to the shared folder, so plans do not
grow and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.predicates import Path, document_filter, from_json_text
from strataweave.sources.storage import discard, materialize

#: Arcs that a round of shortest paths follows, and rounds after which all that was found is written as one table.
HOPS = 3
ROUNDS_PER_WRITE = 8


def arcs(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``src, dst, weight`` in both directions for undirected edges; weight 1 where it is absent or null."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    out = edges.select("src", "dst", w.alias("weight"))
    if "directed" in edges.columns:
        back = edges.where(~F.coalesce("directed", F.lit(True))).select(F.col("dst").alias("src"), F.col("src").alias("dst"), w.alias("weight"))
        out = out.unionByName(back)
    return out.where("src is not null and dst is not null")


def add_vertices(vertices: DataFrame, new: DataFrame) -> DataFrame:
    """Vertices added; an id that is there already keeps its vertex."""
    return vertices.unionByName(new.join(vertices.select("id"), "id", "left_anti").select(*vertices.columns))


def add_edges(edges: DataFrame, new: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges added whose two ends exist."""
    ids = vertices.select(F.col("id").alias("v_"))
    ok = new.join(ids, F.col("src") == F.col("v_"), "left_semi").join(ids, F.col("dst") == F.col("v_"), "left_semi")
    return edges.unionByName(ok.select(*edges.columns))


def _at(df: DataFrame) -> Path:
    """A property: a column, or a field of ``props``."""
    inner = from_json_text(F.col("props")) if "props" in df.columns else (lambda _: F.lit(None).cast("string"))
    return lambda path: F.col(f"`{path}`") if path in df.columns else inner(path)


def find_vertices(vertices: DataFrame, label: str | None = None, where: Mapping[str, Any] | None = None) -> DataFrame:
    """Vertices of a label whose properties pass a document filter such as ``{"age": {"$gte": 30}}``; without arguments all."""
    found = vertices if label is None else vertices.where(F.col("label") == label)
    return found.where(document_filter(dict(where or {}), _at(vertices)))


def find_edges(edges: DataFrame, label: str | None = None, where: Mapping[str, Any] | None = None, src: object = None, dst: object = None) -> DataFrame:
    """Edges of a label, from or to a vertex, whose properties pass a document filter; without arguments all."""
    found = edges if label is None else edges.where(F.col("label") == label)
    for c, v in (("src", src), ("dst", dst)):
        found = found if v is None else found.where(F.col(c) == F.lit(v))
    return found.where(document_filter(dict(where or {}), _at(edges)))


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, vertex_ok: DataFrame | None = None) -> DataFrame:
    """``id, depth``: what is reached from ``starts`` (column ``id``) and in how few steps, up to ``max_depth``.

    ``edges`` as from :func:`arcs`, filtered as wished; ``vertex_ok`` (column ``id``)
    limits which vertices are entered. Starts have depth 0 even without edges.
    """
    arc = edges.select("src", "dst")
    if vertex_ok is not None:
        arc = arc.join(vertex_ok.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    arc = materialize(arc.where("src <> dst").distinct(), "arcs")
    seen = materialize(starts.select("id").where("id is not null").distinct().withColumn("depth", F.lit(0)), "bfs")
    frontier = seen
    for d in count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(arc, frontier["id"] == arc["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = materialize(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if d % ROUNDS_PER_WRITE == 0:
            seen = materialize(seen, "bfs")
    discard(arc)
    return seen


def shortest_paths(edges: DataFrame, starts: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``id, distance``: least sum of weights from the nearest start; weights must not be negative.

    A round follows ``HOPS`` arcs from the vertices whose distance has fallen in the
    last one and writes those that fall again; all distances are written anew only
    every ``ROUNDS_PER_WRITE`` rounds. It ends when none falls. ``max_rounds`` bounds
    the arcs that are followed one after the other; if distances still fall then, it is an error.
    """
    weight = edges.select("src", "dst", "weight").where("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    arc = materialize(weight, "arcs")
    best = materialize(starts.select("id").where("id is not null").distinct().withColumn("distance", F.lit(0.0)), "paths")
    changed, fallen, followed = best, [], 0
    while True:
        hops = HOPS if max_rounds is None else min(HOPS, max_rounds - followed)
        if hops <= 0:
            raise RuntimeError(f"distances still fall after {max_rounds} rounds")
        followed += hops
        found, at = [], changed
        for _ in range(hops):
            ahead = at.join(arc, at["id"] == arc["src"]).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("distance"))
            found.append(ahead)
            at = ahead
        least = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.min("distance").alias("found"))
        known = _least(best, fallen)
        lower = F.col("distance").isNull() | (F.col("found") < F.col("distance"))
        changed = materialize(least.join(known, "id", "left").where(lower).select("id", F.col("found").alias("distance")), "paths")
        if changed.isEmpty():
            break
        fallen.append(changed)
        if len(fallen) >= ROUNDS_PER_WRITE:
            last, best, fallen = [best, *fallen[:-1]], materialize(_least(best, fallen), "paths"), []
            for t in last:
                discard(t)
    discard(arc)
    return _least(best, fallen)


def _least(best: DataFrame, fallen: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, fallen, best).groupBy("id").agg(F.min("distance").alias("distance")) if fallen else best


def path_to(edges: DataFrame, distances: DataFrame, target: object, max_steps: int | None = None) -> list:
    """Vertices of one shortest path to ``target``, from its start; empty if it is not reached.

    One small query a step, backwards from the target; more than ``max_steps`` are an error.
    """
    known = {r["id"]: r["distance"] for r in distances.where(F.col("id") == F.lit(target)).collect()}
    if target not in known:
        return []
    path, at, left = [target], target, known[target]
    while left > 0:
        if max_steps is not None and len(path) > max_steps:
            raise RuntimeError(f"the path to {target} has more than {max_steps} steps")
        before = edges.where(F.col("dst") == F.lit(at)).join(distances, edges["src"] == distances["id"])
        step = before.where((F.abs(F.col("distance") + F.col("weight") - F.lit(left)) < 1e-9) & (F.col("distance") < F.lit(left))).orderBy("distance", "id").first()
        if step is None:
            raise RuntimeError(f"no arc leads to {at} at its distance")
        at, left = step["id"], step["distance"]
        path.append(at)
    return path[::-1]


def path_within(edges: DataFrame, start: object, target: object, max_hops: int) -> list:
    """Vertices of a path of least weight among those of up to ``max_hops`` arcs; empty if there is none. Of equal ones the smallest vertices win."""
    arc = materialize(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "arcs")
    spark = edges.sparkSession
    levels = [materialize(spark.createDataFrame([(start,)], ["at"]).select(F.col("at").cast(arc.schema["src"].dataType).alias("id"), F.lit(0.0).alias("distance")), "hops")]
    for _ in range(max_hops):
        last = levels[-1]
        ahead = last.join(arc, last["id"] == arc["src"]).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("distance"))
        levels.append(materialize(ahead, "hops"))  # the least weight with exactly so many arcs
    ends = [(r["distance"], k) for k, level in enumerate(levels) for r in level.where(F.col("id") == F.lit(target)).collect()]
    if not ends:
        return []
    left, k = min(ends)
    path = [target]
    for level in reversed(levels[:k]):
        before = arc.where(F.col("dst") == F.lit(path[-1])).join(level, arc["src"] == level["id"])
        step = before.where(F.abs(F.col("distance") + F.col("weight") - F.lit(left)) < 1e-9).orderBy("id").first()
        left = step["distance"]
        path.append(step["id"])
    return path[::-1]


def simple_paths(edges: DataFrame, start: object, end: object, max_hops: int) -> DataFrame:
    """``path, hops``: paths from ``start`` to ``end`` without a repeated vertex, of up to ``max_hops`` edges."""
    arc = edges.select("src", "dst").distinct()
    paths = arc.where(F.col("src") == F.lit(start)).select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    out = paths.where(F.col("at") == F.lit(end))
    for _ in range(max_hops - 1):
        going = paths.where(F.col("at") != F.lit(end))
        paths = going.join(arc, (going["at"] == arc["src"]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        out = out.unionByName(paths.where(F.col("at") == F.lit(end)))
    return out.select("path", (F.size("path") - 1).alias("hops"))


def dfs_order(edges: DataFrame, start: object, max_depth: int | None = None, max_edges: int = 1_000_000) -> list:
    """Vertices in depth-first pre-order, neighbours in sorted order.

    The order is sequential by nature: the arcs of the reached part are collected, and
    more than ``max_edges`` of them are an error; :func:`bfs` reaches the same vertices.
    ``max_depth`` limits the depth at which a vertex is first met.
    """
    reached = bfs(edges, edges.sparkSession.createDataFrame([(start,)], ["id"]), max_depth)
    part = edges.select("src", "dst").distinct().join(reached.select(F.col("id").alias("src")), "src", "left_semi")
    if part.count() > max_edges:
        raise ValueError("the reached part is too large for an order; use bfs")
    out: dict[object, list] = {}
    for r in part.collect():
        out.setdefault(r["src"], []).append(r["dst"])
    order, stack, seen = [], [(start, 0)], set()
    while stack:
        v, d = stack.pop()
        if v in seen:
            continue
        seen.add(v)
        order.append(v)
        if max_depth is None or d < max_depth:
            stack += [(u, d + 1) for u in sorted(out.get(v, []), reverse=True) if u not in seen]
    return order


def match(
    vertices: DataFrame,
    edges: DataFrame,
    hops: Sequence[str | None],
    labels: Sequence[str | None] = (),
    where: Mapping[int, Mapping[str, Any]] | None = None,
    edge_where: Mapping[int, Mapping[str, Any]] | None = None,
    returns: Mapping[str, tuple[int, str]] | None = None,
) -> DataFrame:
    """``v0, v1, ...``: chains of vertices joined by edges with the given labels (null: any).

    ``labels`` and ``where`` say what the vertices by their place must be: a label, and a
    document filter on properties; ``edge_where`` the same for the edges. Vertices are
    filtered before the chain is joined. ``returns`` adds columns: name to (place, property).
    """
    out = None
    wanted = {i: (labels[i] if i < len(labels) else None, (where or {}).get(i)) for i in range(len(hops) + 1)}
    for i, label in enumerate(hops):
        e = find_edges(edges, label, (edge_where or {}).get(i)).select(F.col("src").alias(f"v{i}"), F.col("dst").alias(f"v{i + 1}"))
        for k in (i, i + 1):
            if any(x is not None for x in wanted[k]) and (k > i or i == 0):
                e = e.join(find_vertices(vertices, *wanted[k]).select(F.col("id").alias(f"v{k}")), f"v{k}", "left_semi")
        out = e if out is None else out.join(e, f"v{i}")
    names = [f"v{i}" for i in range(len(hops) + 1)]
    for name, (place, prop) in (returns or {}).items():
        value = vertices.select(F.col("id").alias(f"v{place}"), _at(vertices)(prop).alias(name))
        out = out.join(value, f"v{place}", "left")
        names.append(name)
    return out.select(*names)


def degrees(edges: DataFrame) -> DataFrame:
    """``id, out_degree, in_degree`` of every vertex with an edge."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """``id, rank``, adding up to 1. Repeated edges count; the rank of vertices without an outgoing edge is spread evenly."""
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    n = ids.count()
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))
    links = materialize(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")).join(out, "src").select("src", "dst", (F.col("k") / F.col("n_out")).alias("part")), "links")
    ranks = materialize(ids.join(out.select(F.col("src").alias("id"), F.lit(True).alias("linked")), "id", "left").withColumn("rank", F.lit(1.0 / max(n, 1))), "ranks")
    for _ in range(iterations):
        loose = ranks.where("linked is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = ranks.join(links, ranks["id"] == links["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("part")).alias("got"))
        new = F.lit((1 - damping + damping * loose) / n) + damping * F.coalesce("got", F.lit(0.0))
        last, ranks = ranks, materialize(ranks.join(given, ranks["id"] == given["dst"], "left").select("id", "linked", new.alias("rank")), "ranks")
        discard(last)
    return ranks.select("id", "rank")


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id that a vertex is joined to, edges taken in both directions.

    Alternates large-star and small-star steps, which need a logarithmic number of
    rounds even for long chains, and pre-aggregates a hub's neighbours to their minimum.
    """
    links = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a is not null and b is not null")
    ids = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    links = materialize(links.where("a < b").distinct(), "stars")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), "a", "b")
        new = small.select(F.col("x").alias("a"), "b").unionByName(small.where("a > x").select(F.col("x").alias("a"), F.col("a").alias("b"))).distinct()
        new = materialize(new, "stars")
        same = new.count() == links.count() and new.join(links, ["a", "b"], "left_anti").isEmpty()
        discard(links)
        links = new
        if same:
            break
    found = links.groupBy("b").agg(F.min("a").alias("m"))
    return ids.join(found, ids["id"] == found["b"], "left").select("id", F.coalesce("m", "id").alias("component"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``id, community``: each vertex takes the most frequent label of its neighbours, the smallest of ties, for some rounds."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    both = materialize(both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")), "links")
    labels = materialize(both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")), "labels")
    best = Window.partitionBy("src").orderBy(F.col("n").desc(), F.col("community"))
    for _ in range(rounds):
        votes = both.join(labels, both["dst"] == labels["id"]).groupBy("src", "community").agg(F.sum("k").alias("n"))
        last, labels = labels, materialize(votes.withColumn("r", F.row_number().over(best)).where("r = 1").select(F.col("src").alias("id"), "community"), "labels")
        discard(last)
    return labels


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """How much of the edge weight (column ``weight``, else 1) lies within communities beyond chance, from -0.5 to 1; edges are taken as undirected."""
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    a, b = (communities.select(F.col("id").alias(c), F.col("community").alias(f"{c}_in")) for c in ("src", "dst"))
    linked = edges.select("src", "dst", w.cast("double").alias("w")).join(a, "src").join(b, "dst")
    total, inside = linked.agg(F.sum("w"), F.sum(F.when(F.col("src_in") == F.col("dst_in"), F.col("w")).otherwise(0.0))).first()
    if not total:
        return 0.0
    ends = linked.select(F.col("src_in").alias("c"), "w").unionByName(linked.select(F.col("dst_in").alias("c"), "w"))
    expected = ends.groupBy("c").agg(F.sum("w").alias("k")).agg(F.sum(F.pow(F.col("k") / (2 * total), 2))).first()[0]
    return inside / total - expected


def modularity_communities(edges: DataFrame, rounds: int = 5, levels: int = 10) -> DataFrame:
    """``id, community``: communities of high modularity, by local moves and merging, level by level (Louvain).

    In a round every other vertex, by a hash that changes with the round, moves to the
    neighbouring community with the largest gain, the smallest of ties. When fewer than one
    in 200 moves, or after ``rounds``, communities become vertices; it ends when a level merges
    nothing, or after ``levels``. A community is named after its smallest vertex. Edges are undirected and add up.
    """
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    links = edges.where("src is not null and dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("b"), w.cast("double").alias("w"))
    ids = links.select("a").unionByName(links.select(F.col("b").alias("a"))).distinct()
    member = materialize(ids.select(F.col("a").alias("id"), F.col("a").alias("community")), "members")
    total = links.agg(F.sum("w")).first()[0]
    if not total:
        return member
    for level in range(levels):
        both = links.where("a <> b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        both = materialize(both.groupBy("a", "b").agg(F.sum("w").alias("w")), "links")
        loops = links.where("a = b").select("a", (2 * F.col("w")).alias("w"))
        degree = materialize(both.select("a", "w").unionByName(loops).groupBy("a").agg(F.sum("w").alias("k")), "degrees")
        at = materialize(degree.select("a", "k", F.col("a").alias("c")), "places")
        idle = 0
        for r in range(2 * rounds):
            moved = _moved(both, at, total, level * 1000 + r)
            new = materialize(moved, "places")
            n, all_ = new.agg(F.count_if("moved"), F.count(F.lit(1))).first()
            discard(at)
            at = new.select("a", "k", "c")
            idle = idle + 1 if n * 200 < all_ else 0
            if idle == 2:  # neither half has moved
                break
        names = at.groupBy("c").agg(F.min("a").alias("name"))
        place = materialize(at.join(names, "c").select("a", F.col("name").alias("c")), "places")
        merged = place.where("a <> c").limit(1).count()
        if not merged:
            break
        up = place.select(F.col("a").alias("community"), F.col("c").alias("up"))
        member = materialize(member.join(up, "community").select("id", F.col("up").alias("community")), "members")
        to = lambda side: place.select(F.col("a").alias(side), F.col("c").alias(f"{side}_"))
        joined = links.join(to("a"), "a").join(to("b"), "b")
        ordered = joined.select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"), "w")
        links = materialize(ordered.groupBy("a", "b").agg(F.sum("w").alias("w")), "links")
    return member


def _moved(both: DataFrame, at: DataFrame, total: float, salt: int) -> DataFrame:
    """``a, k, c, moved`` after one half of the vertices has moved where the gain is largest."""
    size = at.groupBy("c").agg(F.sum("k").alias("size"))
    mover = at.where(F.pmod(F.xxhash64("a", F.lit(salt)), F.lit(2)) == 0)
    near = both.join(at.select(F.col("a").alias("b"), F.col("c").alias("near")), "b").groupBy("a", "near").agg(F.sum("w").alias("w_in"))
    stay = mover.select("a", F.col("c").alias("near"), F.lit(0.0).alias("w_in"))
    options = near.unionByName(stay).groupBy("a", "near").agg(F.sum("w_in").alias("w_in")).join(mover, "a").join(size.withColumnRenamed("c", "near"), "near")
    here = F.col("near") == F.col("c")
    gain = F.col("w_in") - F.col("k") * (F.col("size") - F.when(here, F.col("k")).otherwise(0.0)) / (2 * total)
    # A little for staying, so that rounding moves nothing.
    ranked = options.withColumn("gain", gain + F.when(here, 1e-9 * F.lit(total)).otherwise(0.0))
    best = ranked.groupBy("a").agg(F.min_by("near", F.struct(-F.col("gain"), F.col("near"))).alias("to"))
    return at.join(best, "a", "left").select("a", "k", F.coalesce("to", "c").alias("c"), F.coalesce(F.col("to") != F.col("c"), F.lit(False)).alias("moved"))


def closeness(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``id, reached, closeness`` of each source (column ``id``): vertices reached over the sum of their depths."""
    arc = edges.select("src", "dst").distinct()
    seen = materialize(sources.select(F.col("id").alias("source"), "id").distinct().withColumn("depth", F.lit(0)), "close")
    frontier = seen
    for d in count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(arc, frontier["id"] == arc["src"]).select("source", F.col("dst").alias("id")).distinct()
        frontier = materialize(step.join(seen.select("source", "id"), ["source", "id"], "left_anti").withColumn("depth", F.lit(d)), "close")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    far = seen.groupBy("source").agg((F.count(F.lit(1)) - 1).alias("reached"), F.sum("depth").alias("total"))
    return far.select(F.col("source").alias("id"), "reached", F.when(F.col("total") > 0, F.col("reached") / F.col("total")).otherwise(F.lit(0.0)).alias("closeness"))


def betweenness(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``id, score``: shares of shortest paths (in steps) from the ``sources`` that pass through a vertex.

    With every vertex as a source this is betweenness; with a sample, its estimate
    times the sampled share. Paths are counted outwards by depth and their shares
    added up on the way back. Repeated edges count once.
    """
    arc = edges.select("src", "dst").where("src <> dst").distinct()
    levels = [materialize(sources.select(F.col("id").alias("source"), "id").distinct().withColumn("paths", F.lit(1.0)), "between")]
    seen = levels[0].select("source", "id")
    for _ in count() if max_depth is None else range(max_depth):
        step = levels[-1].join(arc, levels[-1]["id"] == arc["src"]).groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        new = materialize(step.join(seen, ["source", "id"], "left_anti"), "between")
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionByName(new.select("source", "id"))
    total, below = None, None
    for level in reversed(levels[1:]):
        here = level.withColumn("share", F.lit(0.0))
        if below is not None:
            on = below.join(arc, below["id"] == arc["dst"]).select("source", F.col("src").alias("id"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
            got = on.groupBy("source", "id").agg(F.sum("part").alias("got"))
            here = level.join(got, ["source", "id"], "left").withColumn("share", F.col("paths") * F.coalesce("got", F.lit(0.0))).drop("got")
        below = materialize(here, "between")
        total = below if total is None else total.unionByName(below)
    if total is None:
        return sources.select("id", F.lit(0.0).alias("score")).limit(0)
    return total.groupBy("id").agg(F.sum("share").alias("score"))


def edge_filter(edges: DataFrame, label: str | None = None, props: dict[str, object] | None = None) -> DataFrame:
    """Edges of a label and with given columns; null arguments match everything."""
    cond: Column = F.lit(True)
    if label is not None:
        cond = cond & (F.col("label") == label)
    for k, v in (props or {}).items():
        cond = cond & (F.col(k) == F.lit(v))
    return edges.where(cond)
