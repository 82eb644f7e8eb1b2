"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.session import materialise


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its least node.

    Each round hooks every component to its least neighbour, shortens the hooks to their
    roots, and contracts the edges; edges inside a component vanish. Every component with
    an edge takes part in a merge, so the number of components at least halves per round.
    Minima are aggregated before the shuffle, so a node with very many neighbours is no
    single task's load. Intermediate tables are written to the scratch folder.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    live = materialise(
        edges.where(a != b)
        .select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    labels = None
    while not live.isEmpty():
        parent = _roots(live)
        if labels is None:
            labels = parent.select(F.col("c").alias("node"), F.col("p").alias("component"))
        else:
            labels = labels.join(parent, labels.component == parent.c, "left").select(
                "node", F.coalesce("p", "component").alias("component")
            )
        labels = materialise(labels, "labels")
        live = materialise(_contract(live, parent), "edges")
    if labels is None:
        return live.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels


def _contract(live: DataFrame, parent: DataFrame) -> DataFrame:
    pu = parent.select(F.col("c").alias("u"), F.col("p").alias("pu"))
    pv = parent.select(F.col("c").alias("v"), F.col("p").alias("pv"))
    return (
        live.join(pu, "u")
        .join(pv, "v")
        .where("pu <> pv")
        .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
        .distinct()
    )


def _roots(live: DataFrame) -> DataFrame:
    """(c, p): every component and the root it reaches through least neighbours."""
    both = live.select(F.col("u").alias("c"), F.col("v").alias("o")).union(
        live.select(F.col("v").alias("c"), F.col("u").alias("o"))
    )
    parent = materialise(
        both.groupBy("c").agg(F.min("o").alias("_o")).select("c", F.least("c", "_o").alias("p")),
        "parents",
    )
    while True:
        up = parent.select(F.col("c").alias("_c"), F.col("p").alias("_p"))
        jumped = materialise(
            parent.join(up, parent.p == up._c).select(
                "c", F.col("_p").alias("p"), (F.col("p") != F.col("_p")).alias("moved")
            ),
            "parents",
        )
        parent = jumped.select("c", "p")
        if jumped.where("moved").isEmpty():
            return parent
