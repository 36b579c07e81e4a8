"""Connected components of an edge list, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, label) for each vertex of ``edges`` (a, b: long); label is the smallest vertex of its component.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    the number of rounds grows with the logarithm of the longest shortest path in practice. A hub's
    rows are pre-aggregated and its joins can be split at run time. Without edges the result is empty.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).where("u <> v").distinct()
    both = materialize(both, "cc-edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("label")), "cc-labels")
    while True:
        heard = both.join(labels, "v").groupBy("u").agg(F.min("label").alias("heard"))
        hooked = labels.join(heard, labels.v == heard.u, "left").select("v", F.col("label").alias("was"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        hooked = materialize(hooked, "cc-hooked")
        jump = hooked.select(F.col("v").alias("root"), F.col("label").alias("above"))
        new = hooked.join(jump, hooked.label == jump.root, "left").select("v", "was", F.least("label", F.coalesce("above", "label")).alias("label"))
        new = materialize(new, "cc-labels")
        done = new.where("label < was").limit(1).count() == 0
        labels = new.select("v", "label")
        if done:
            return labels
