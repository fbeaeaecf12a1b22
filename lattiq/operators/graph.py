"""Graph iterations over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.shared import materialize


def undirected(edges: DataFrame) -> DataFrame:
    """(x, y, w) both ways from (d, p, w), endpoints as strings."""
    d, p = F.col("d").cast("string"), F.col("p").cast("string")
    return edges.select(d.alias("x"), p.alias("y"), "w").union(edges.select(p.alias("x"), d.alias("y"), "w")).groupBy("x", "y").agg(F.sum("w").alias("w"))


def with_cooccurrence(edges: DataFrame, pairs: DataFrame, factor: float) -> DataFrame:
    """(x, y, w) with the pairs (a, b, n) added both ways, at ``factor`` times their count."""
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    w = (F.col("n") * factor).cast("double").alias("w")
    more = pairs.select(a.alias("x"), b.alias("y"), w).union(pairs.select(b.alias("x"), a.alias("y"), w))
    return edges.unionByName(more).groupBy("x", "y").agg(F.sum("w").alias("w"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, rounds: int = 15, every: int = 5) -> DataFrame:
    """(case, x, mass) of all cases at once: mass flows along (x, y, w) by weight share, alpha restarts at seeds (case, x)."""
    out = edges.groupBy("x").agg(F.sum("w").alias("total"))
    step = materialize(edges.join(out, "x").select("x", "y", (F.col("w") / F.col("total")).alias("share")), "transitions")
    n = seeds.groupBy("case").agg(F.count("*").alias("n"))
    restart = materialize(seeds.join(n, "case").select("case", "x", (1 / F.col("n")).alias("mass")), "restart")
    mass = restart
    for i in range(rounds):
        moved = mass.join(step, "x").groupBy("case", "y").agg(F.sum(F.col("mass") * F.col("share")).alias("mass")).withColumnRenamed("y", "x")
        both = moved.withColumn("mass", F.col("mass") * (1 - alpha)).unionByName(restart.withColumn("mass", F.col("mass") * alpha))
        mass = both.groupBy("case", "x").agg(F.sum("mass").alias("mass"))
        if (i + 1) % every == 0:
            mass = materialize(mass, f"mass{i}")
    return mass


def link_prediction(edges: DataFrame) -> DataFrame:
    """(a, b, cn, aa, ra) of node pairs with shared neighbours: 1, 1/ln(degree + 2), 1/degree summed."""
    e = edges.select("x", "y").distinct()
    deg = e.groupBy("y").agg(F.count("*").alias("k"))
    n = e.join(deg, "y")
    pairs = n.select(F.col("x").alias("a"), "y", "k").join(e.withColumnRenamed("x", "b"), "y").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("cn"), F.sum(1 / F.log(F.col("k") + 2.0)).alias("aa"), F.sum(1 / F.col("k")).alias("ra"))


def fast_projection(edges: DataFrame, dim: int = 16, weights: tuple[float, ...] = (0.0, 1.0, 1.0, 1.0), seed: int = 7) -> DataFrame:
    """(x, vec): sparse random projection by hash (+1, -1 one in six each), averaged over neighbours hop by hop and summed."""
    out = edges.groupBy("x").agg(F.sum("w").alias("total"))
    step = edges.join(out, "x").select("x", "y", (F.col("w") / F.col("total")).alias("share"))
    h = F.pmod(F.xxhash64("x", "i", F.lit(seed)), F.lit(6))
    base = edges.select("x").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(dim - 1)))).withColumn("v", F.when(h == 0, 1.0).when(h == 1, -1.0).otherwise(0.0))
    layer, total = base, base.withColumn("v", F.col("v") * weights[0])
    for k, w in enumerate(weights[1:]):
        moved = step.join(layer.where("v <> 0").withColumnRenamed("x", "y"), "y").groupBy("x", "i").agg(F.sum(F.col("v") * F.col("share")).alias("v"))
        layer = materialize(moved, f"hop{k}")
        total = total.unionByName(layer.withColumn("v", F.col("v") * w))
    return total.groupBy("x", "i").agg(F.sum("v").alias("v")).groupBy("x").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("vec"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int = 3, beam: int | None = None) -> DataFrame:
    """(root, x, depth): nodes within ``depth`` of seeds (root), each at its first depth; the beam keeps, for each
    root and depth, the nodes that most frontier edges reach. Ends early when nothing new turns up."""
    from pyspark.sql import Window

    e = edges.select("x", "y").distinct()
    front = seeds.select("root", F.col("root").alias("x"), F.lit(0).alias("depth"))
    seen = materialize(front, "seen")
    front = seen
    for k in range(1, depth + 1):
        new = front.join(e, "x").groupBy("root", "y").agg(F.count("*").alias("n")).withColumnRenamed("y", "x").join(seen.select("root", "x"), ["root", "x"], "left_anti")
        if beam:
            new = new.withColumn("_r", F.row_number().over(Window.partitionBy("root").orderBy(F.col("n").desc(), "x"))).where(F.col("_r") <= beam)
        front = materialize(new.select("root", "x", F.lit(k).alias("depth")), f"front{k}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def depth_weight(n, depth, idf):
    """ln(1 + n) / sqrt(depth + 1) idf."""
    return F.log1p(n) / F.sqrt(depth + 1) * idf


def closure(parents: DataFrame, depth: int = 3) -> DataFrame:
    """(x, ancestor, dist) up to ``depth`` from (x, parent); a node is its own ancestor at 0; cycles end by the least distance."""
    p = parents.where("x <> parent").distinct()
    nodes = p.select("x").union(p.select("parent")).distinct()
    level = nodes.select("x", F.col("x").alias("ancestor"), F.lit(0).alias("dist"))
    every = level
    for k in range(1, depth + 1):
        level = level.join(p.toDF("ancestor", "up"), "ancestor").select("x", F.col("up").alias("ancestor"), F.lit(k).alias("dist")).distinct()
        every = every.unionByName(level)
    return every.groupBy("x", "ancestor").agg(F.min("dist").alias("dist"))


def common_ancestor(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """Pairs (a, b) that are equal or share an ancestor of the closure, with the least sum of distances."""
    x = pairs.join(up.select(F.col("x").alias("a"), "ancestor", F.col("dist").alias("da")), "a").join(up.select(F.col("x").alias("b"), "ancestor", F.col("dist").alias("db")), ["b", "ancestor"])
    return x.groupBy("a", "b").agg(F.min(F.col("da") + F.col("db")).alias("dist"))


#: Weights of relation kinds (fixed values).
RELATION_WEIGHTS = {"SY": 1.0, "PAR": 0.6, "CHD": 0.6, "RB": 0.6, "RN": 0.6}


def hierarchy(relations: DataFrame) -> DataFrame:
    """(x, y, w, rels) from (x, y, rel): the largest weight of a pair's relations; others weigh 0.4; no self loops."""
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in RELATION_WEIGHTS.items() for v in kv]), F.col("rel")), F.lit(0.4))
    return relations.where("x <> y").groupBy("x", "y").agg(F.max(w).alias("w"), F.array_sort(F.collect_set("rel")).alias("rels"))


def propagate(edges: DataFrame, links: DataFrame, decay: float = 0.7) -> DataFrame:
    """w(q) += decay w(p) h(p, q) from the original weights only, so the order of edges has no effect."""
    more = edges.join(links.select(F.col("x").alias("p"), F.col("y").alias("q"), F.col("w").alias("h")), "p").select("d", F.col("q").alias("p"), (decay * F.col("w") * F.col("h")).alias("w"))
    return edges.select("d", "p", "w").unionByName(more).groupBy("d", "p").agg(F.sum("w").alias("w"))


def audit(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, degrees."""
    e = edges.select("d", "p").distinct()
    d = e.groupBy("d").agg(F.count("*").alias("k")).agg(F.count("*").alias("n_d"), F.min("k").alias("min_k"), F.max("k").alias("max_k"), F.avg("k").alias("avg_k"))
    p = e.groupBy("p").agg(F.count("*").alias("k")).agg(F.count("*").alias("n_p"), F.count_if(F.col("k") == 1).alias("n_leaf"))
    return d.crossJoin(p).crossJoin(e.agg(F.count("*").alias("n_e")))


def expand_until_saturated(edges: DataFrame, seeds: DataFrame, depth: int, beam: int = 100, since: int = 5, few: int = 2) -> tuple[DataFrame, DataFrame]:
    """Expansion of every seed (root) along (x, y) until it brings no more: (root, x, depth) found, (root, depth, found, reason).

    All new nodes of a step are found, but only the ``beam`` that most edges of the frontier reach are expanded. A root
    ends when a step brings nothing (``nothing new``), or from depth ``since`` at most ``few`` nodes, which are left out
    (``saturated``), or at the limit (``depth``). Its depth is that of the last step that counted."""
    from pyspark.sql import Window

    e = materialize(edges.select("x", "y").distinct(), "edges")
    roots = seeds.select("root").distinct()
    seen = materialize(roots.select("root", F.col("root").alias("x"), F.lit(0).alias("depth")), "seen")
    front, ends = seen.select("root", "x"), None
    best = Window.partitionBy("root").orderBy(F.col("n").desc(), "x")
    for k in range(1, depth + 1):
        reached = front.join(e, "x").groupBy("root", F.col("y").alias("_y")).agg(F.count("*").alias("n")).withColumnRenamed("_y", "x")
        new = materialize(reached.join(seen.select("root", "x"), ["root", "x"], "left_anti"), f"new{k}")
        brought = front.select("root").distinct().join(new.groupBy("root").agg(F.count("*").alias("c")), "root", "left").na.fill(0, ["c"])
        stop = F.when(F.col("c") == 0, "nothing new").when((F.lit(k) >= since) & (F.col("c") <= few), "saturated")
        state = materialize(brought.select("root", stop.alias("reason")), f"state{k}")
        ended = state.where("reason IS NOT NULL").select("root", F.lit(k - 1).alias("depth"), "reason")
        ends = ended if ends is None else ends.unionByName(ended)
        kept = new.join(state.where("reason IS NULL").select("root"), "root", "left_semi")
        seen = seen.unionByName(kept.select("root", "x", F.lit(k).alias("depth")))
        front = materialize(kept.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= beam).select("root", "x"), f"front{k}")
        if front.isEmpty():
            break
    left = front.select("root").distinct().select("root", F.lit(depth).alias("depth"), F.lit("depth").alias("reason"))
    ends = left if ends is None else ends.unionByName(left)
    found = seen.where("depth > 0")
    return found, ends.join(found.groupBy("root").agg(F.count("*").alias("found")), "root", "left").na.fill(0, ["found"]).select("root", "depth", "found", "reason")
