"""Connected components of a graph given as a DataFrame of links, by minimum labels and pointer jumping.

Each round every vertex takes the smallest label among itself and its neighbours (pre-aggregated before the shuffle),
then the label of its label. Rounds are written to shared storage, so lineage stays short and a lost executor costs one
round at most. Only the number of changed labels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(links: DataFrame) -> DataFrame:
    """(id, label) for the vertices of links (a, b): label is the smallest id of the vertex's component.

    Each round reads the links again, so they should be a stored table; the result is one.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(links.select(F.col("b"), F.col("a")))
    labels, last = both.groupBy("id").agg(F.least("id", F.min("other")).alias("label")), None
    while True:
        told = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("told"))
        lower = labels.join(told, "id", "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("told", "label")).alias("now"))
        up = labels.select(F.col("id").alias("now"), F.col("label").alias("above"))
        jumped = lower.join(up, "now", "left").select("id", "was", F.least("now", F.coalesce("above", "now")).alias("label"))
        new = stored(jumped, "labels")
        changed = new.filter("label <> was").limit(1).count()
        if last is not None:
            drop_stored(last)
        last, labels = new, new.select("id", "label")
        if not changed:
            return labels
