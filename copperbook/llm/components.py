"""Connected components of a link table, by alternating stars.

Large star: every node hands its larger neighbours to its smallest neighbour.
Small star: every node hands its smaller neighbours to the smallest of them.
Both keep the components; in the end each node is linked to the least of its
component. Each round is written to the shared folder; nothing but a count and
a checksum of the links reaches the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperbook.llm.common import stored


def _star(links: DataFrame) -> DataFrame:
    """links(a, b) with a > b; one round."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    large = (
        both.where("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("low").alias("b"))
        .where("a > b")
        .distinct()
    )
    least = large.groupBy("a").agg(F.min("b").alias("low"))
    small = large.join(least, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return small.unionByName(least.withColumnRenamed("low", "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """From links(a, b) of long ids to (a, b): each linked node that is not the
    least of its component, and the least. Loops and repeats are allowed; nulls
    link nothing."""
    links = (
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    links = stored(links, "links")
    before = None
    while True:
        row = links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(row) == before or not row[0]:
            return links
        before = tuple(row)
        links = stored(_star(links), "links")
