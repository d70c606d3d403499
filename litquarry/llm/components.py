"""Consolidating pairwise matches into groups: connected components of a link table.

1. Links become distinct undirected edges; rows with a null end and self-links drop out.
2. The likely giant component is peeled: breadth-first search from the highest-degree vertex, one join of the frontier
   with the edges and one anti-join against what was seen per round, then an anti-join takes the component's edges away.
   The search goes on, however deep, while its frontier holds at least ``PEEL_SHARE`` of all vertices. What is left of a
   search below that is the tail of a giant, or no giant at all, and would cost a round per step: the part seen is
   contracted to its smallest vertex instead and step 3 finishes it, which keeps the result exact.
3. The small components are labelled by minimum propagation in its star form: every vertex sends the least vertex it
   knows to its larger neighbours (large star), then to its smaller ones (small star), until all edges point at the
   least vertex of their component. Paths shrink by a constant factor a round, so long chains need few rounds.

Nothing of the graph comes to the driver but one vertex id, counts and a yes/no per round. A vertex that holds a third
of all edges costs one partially aggregated minimum and a join AQE may split. Each round is a written table.

Defined results: an empty table, or only nulls and self-links, gives an empty result; repeated and reversed links count
once; a vertex that occurs only in self-links belongs to no group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litquarry.session import drop_path, materialise

MAX_ROUNDS = 60  # rounds of step 3 grow with the logarithm of a path's length; more are an error, never a wrong result
PEEL_SHARE = 0.001


def _edges(links: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct edges with u > v."""
    a, b = F.col(left), F.col(right)
    pairs = links.filter(a.isNotNull() & b.isNotNull() & (a != b))
    return pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _path_of(df: DataFrame) -> str:
    return df.inputFiles()[0].rpartition("/")[0] if df.inputFiles() else ""


def _replace(old: DataFrame | None, new: DataFrame, label: str) -> DataFrame:
    """Materialise the next round and delete the last one's files."""
    done = materialise(new, label)
    if old is not None and (path := _path_of(old)):
        drop_path(old.sparkSession, path)
    return done


def peel_giant(edges: DataFrame, peel_share: float) -> tuple[DataFrame, DataFrame]:
    """(vertices seen from the highest-degree vertex with their least label, the edges that remain)."""
    both = _both_ways(edges)
    degrees = both.groupBy("u").agg(F.count("*").alias("n"))
    top = degrees.agg(F.count("*").alias("vertices"), F.max_by("u", F.struct("n", -F.col("u"))).alias("u")).first()
    if not top.vertices:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).limit(0), edges
    start = edges.sparkSession.createDataFrame([(top.u,)], edges.select("u").schema)
    seen = frontier = materialise(start, "frontier")
    size = 1
    while size:
        reached = both.join(frontier, "u", "left_semi").select(F.col("v").alias("u")).distinct()
        frontier = materialise(reached.join(seen, "u", "left_anti"), "frontier")
        size = frontier.count()
        seen = seen.unionAll(frontier)
        if size < peel_share * top.vertices:
            break
    complete = not size
    least = seen.agg(F.min("u")).first()[0]
    component = seen.select(F.col("u").alias("id"), F.lit(least).cast(edges.schema["u"].dataType).alias("label"))
    if complete:
        return component, edges.join(seen, "u", "left_anti")
    mark = seen.select(F.col("u").alias("s"))
    into = lambda e, c: e.join(mark, e[c] == mark["s"], "left").withColumn(c, F.when(F.col("s").isNull(), F.col(c)).otherwise(F.lit(least))).drop("s")
    return component, _edges(into(into(edges, "u"), "v"), "u", "v")


def _star_round(edges: DataFrame) -> DataFrame:
    """One large star and one small star."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    own = large.groupBy("u").agg(F.min("v").alias("m"))
    down = large.join(own, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionAll(own.select("u", F.col("m").alias("v"))).distinct()


def _unfinished(edges: DataFrame) -> bool:
    """Whether some vertex has two labels or its label has a label."""
    two = edges.groupBy("u").count().filter("count > 1").select("u")
    chained = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return not two.unionAll(chained).limit(1).isEmpty()


def connected_groups(
    links: DataFrame, left: str, right: str, *, id_col: str = "id", group_col: str = "group_id", peel_share: float = PEEL_SHARE
) -> DataFrame:
    """One row (id, group) for every vertex with a link to another; the group is the least id in it."""
    edges = materialise(_edges(links, left, right), "edges")
    giant, rest = peel_giant(edges, peel_share)
    stars = _replace(None, rest, "stars")
    for _ in range(MAX_ROUNDS):
        if not _unfinished(stars):
            break
        stars = _replace(stars, _star_round(stars), "stars")
    else:
        raise RuntimeError(f"no convergence in {MAX_ROUNDS} rounds")
    labels = stars.select(F.col("u").alias("id"), F.col("v").alias("label"))
    # a contracted giant may itself have been pulled to a smaller vertex
    moved = giant.join(labels.select(F.col("id").alias("label"), F.col("label").alias("root")), "label", "left").select(
        "id", F.coalesce("root", "label").alias("label"))
    # roots label themselves; the giant's least vertex may be among them
    roots = labels.select(F.col("label").alias("id"), "label")
    return moved.unionAll(labels).unionAll(roots).groupBy("id").agg(F.min("label").alias("label")).select(
        F.col("id").alias(id_col), F.col("label").alias(group_col))
