"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precepta.llm.common import cut, forget, in_python


def _spanning(batches):
    """Union-find over a partition's edges: a star (x, root) for each of its trees, roots being the smallest ids."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while (up := parent[x]) != root:
            parent[x], x = root, up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    rows = [(x, find(x)) for x in list(parent)]
    rows = [r for r in rows if r[0] != r[1]]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["u", "v"])


def _nearest(star: DataFrame) -> DataFrame:
    """(u, low, high): the smallest and the largest neighbour of each id."""
    return star.union(star.select("v", "u")).toDF("u", "v").groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component) of every id of edges (a long, b long); component is the smallest id that can be reached.

    Each partition first reduces its edges to spanning stars by union-find, so that no more edges than ids are left. Then
    rounds of two steps, each a join with minima that are aggregated before they are shuffled: an edge's smaller end is
    replaced by that end's smallest neighbour (large star), then all of an id's edges by ones to its smallest (small
    star). It is done once every id is a root, smaller than its neighbours, or has a single neighbour that is smaller.
    Edges that meet at one root are moved by those roots only that have a smaller neighbour, few after the first round.
    Each round is cut off from its lineage and the one before is deleted. Nothing is gathered in one task or on the
    driver. Self-edges and repeated edges are allowed; an empty table gives none.
    """
    edges = edges.toDF("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    star = cut(in_python(edges, _spanning, "u long, v long"))
    for _ in range(rounds):
        near = cut(_nearest(star).where("low < u AND low != high"))
        if near.isEmpty():
            forget(near)
            break
        moved = near.where("high > u").select(F.col("u").alias("v"), "low")  # ends of larger ids that aren't smallest themselves
        large = star.join(moved, "v", "left").select("u", F.coalesce("low", "v").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lowest, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(lowest.select("u", "low"))
        before, star = star, cut(in_python(small, _spanning, "u long, v long"))
        forget(before, near)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = star.select(F.col("u").alias("id"), F.col("v").alias("component")).union(star.select("v", "v"))
    out = cut(ends.distinct())
    forget(star)
    return out
