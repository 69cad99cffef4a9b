"""Risk along river networks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake.operators.lineage import cut, settle


def assert_acyclic(edges: DataFrame) -> None:
    """Peel nodes without incoming edges until none is left; raise if some always are."""
    now, left = edges.select("src", "dst").distinct(), -1
    while True:
        now = cut(now)
        n = now.count()
        if n in (0, left):
            break
        left = n
        now = now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
    if n:
        raise ValueError("the network has a cycle")


def _ends(links: DataFrame) -> DataFrame:
    """Links (node, next, km), of which no two share a node or a next, to each node's last `next` that has no link itself, and the way there, by pointer doubling.

    The rounds are the logarithm of the longest chain; chains that never end are cycles. A node that has reached its
    end is not joined on any more, so the many nodes with one end never meet in a task.
    """
    has = links.select(F.col("node").alias("next"), F.lit(True).alias("open"))
    now = settle(links.join(has, "next", "left").select("node", "next", "km", F.coalesce("open", F.lit(False)).alias("open")))
    n = now.count()
    # Each round has as many rows as the first, so this many tasks do for all.
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, n >> 16)
    for _ in range(n.bit_length() + 1):
        if now.filter("open").isEmpty():
            return now.drop("open")
        ahead = now.select(F.col("node").alias("next"), F.col("next").alias("__next"), F.col("km").alias("__km"), F.col("open").alias("__open"))
        step = now.filter("open").join(ahead, "next").select("node", F.col("__next").alias("next"), (F.col("km") + F.col("__km")).alias("km"), F.col("__open").alias("open"))
        now = settle(step.unionByName(now.filter("NOT open")).coalesce(tasks))
    raise ValueError("the network has a cycle")


def contracted(edges: DataFrame, source) -> tuple[DataFrame, DataFrame]:
    """(edges between junctions, nodes within chains): a chain is a run of nodes with one way in and one out, but for `source`.

    Its edges become one, as long as all of them. Nodes within (node, head, km) have the junction before their chain
    and the way from there.
    """
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
    through = cut(into.join(out, "node").filter("i = 1 AND o = 1").filter(F.col("node") != F.lit(source)).select("node"))
    if through.isEmpty():
        return edges, through.withColumns({"head": F.col("node"), "km": F.lit(0.0)})
    up = _ends(edges.join(through, edges["dst"] == through["node"]).select("node", F.col("src").alias("next"), "km"))
    # The edge out of a chain's last node carries the whole chain; edges into its nodes are held by it.
    last = edges.join(through.select(F.col("node").alias("dst")), "dst", "left_anti")
    jumps = up.select(F.col("node").alias("src"), F.col("next").alias("__head"), F.col("km").alias("__km"))
    joined = last.join(jumps, "src", "left").select(F.coalesce("__head", "src").alias("src"), "dst", (F.coalesce("__km", F.lit(0.0)) + F.col("km")).alias("km"))
    return joined.groupBy("src", "dst").agg(F.min("km").alias("km")), up.select("node", F.col("next").alias("head"), "km")


def river_risk(edges: DataFrame, source, initial: float, decay_per_km: float) -> DataFrame:
    """(node, km, risk): risk falls with the shortest way downstream from `source`; 0 where no way leads.

    Edges are (src, dst, km). Chains are contracted first, so rounds grow with the junctions on a way and not with its
    nodes. Then relaxation to a fixed point: only nodes whose way got shorter go on, and each round's state is
    written to the shared checkpoint folder. Nodes within chains follow from the junction before them.
    """
    if not 0 <= initial <= 1 or decay_per_km < 0:
        raise ValueError("the risk lies in 0 to 1 and the decay is not negative")
    edges = cut(edges.groupBy("src", "dst").agg(F.min("km").alias("km"), F.min(F.col("km") > 0).alias("ok")))
    if not edges.filter(~F.coalesce("ok", F.lit(False)) | F.col("src").isNull() | F.col("dst").isNull()).isEmpty():
        raise ValueError("distances are positive and ends are named")
    edges = edges.select("src", "dst", F.col("km").cast("double").alias("km"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    best = cut(nodes.filter(F.col("node") == F.lit(source)).select("node", F.lit(0.0).alias("km")))
    if best.isEmpty():
        raise ValueError("the source is not in the network")
    own, within = contracted(edges, source)
    own = cut(own)
    assert_acyclic(own)
    front = best
    while True:
        step = front.withColumnRenamed("km", "so_far").join(own, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("so_far") + F.col("km")).alias("new"))
        front = settle(step.join(best, "node", "left").filter("km IS NULL OR new < km - 1e-12").select("node", F.col("new").alias("km")))
        if front.isEmpty():
            break
        best = settle(best.unionByName(front).groupBy("node").agg(F.min("km").alias("km")))
    inner = within.join(best.select(F.col("node").alias("head"), F.col("km").alias("__km")), "head").select("node", (F.col("km") + F.col("__km")).alias("km"))
    found = best.unionByName(inner)
    return nodes.join(found, "node", "left").select("node", "km", F.coalesce(F.lit(initial) * F.exp(-decay_per_km * F.col("km")), F.lit(0.0)).alias("risk"))
