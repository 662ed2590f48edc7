"""Connected components as DataFrame jobs."""

from pyspark.sql import functions as F

from answerloom.session import cut_lineage, ship_package


def _forest(batches):
    """Union-find over the links of one partition: every node with its root."""
    import pyarrow as pa

    parent = {}

    def root(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at:at + 50_000]
        yield pa.RecordBatch.from_pydict({
            "a": pa.array([root(x) for x in part], pa.int64()), "b": pa.array(part, pa.int64()),
        })


def components(links):
    """``(id, component_id)`` for every linked id; the component is its smallest id.

    ``links`` has two long columns (a, b) in any order. Each partition first
    reduces its links to a union-find forest (its memory is bounded by the
    partition, and several smaller partitions do as well). Then large-star and
    small-star rounds let every node point at the smallest id it can see until
    nothing changes. Rounds are cut by tables in the shared folder; no link
    passes through the driver, and hot nodes only meet in min-aggregates and in
    joins that Spark may split.
    """
    spark = links.sparkSession
    ship_package(spark)
    pairs = links.toDF("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long")
    pairs = cut_lineage(pairs, "links")
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
            .where("a <> b").distinct()
        )
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(low, "b").select(F.explode(F.array(
                F.struct(F.col("m").alias("a"), F.col("b").alias("b")),
                F.struct(F.col("m").alias("a"), F.col("a").alias("b")),
            )).alias("x")).select("x.*").where("a <> b").distinct()
        )
        pairs = cut_lineage(small, "links")
        # Done once every node has one parent and no parent has a parent itself.
        counts = pairs.agg(F.count("*").alias("n"), F.countDistinct("b").alias("k")).first()
        if counts["n"] == counts["k"]:
            deep = pairs.select(F.col("a").alias("x")).distinct().join(
                pairs.select(F.col("b").alias("x")), "x", "left_semi")
            if deep.isEmpty():
                break
    return (
        pairs.select(F.col("b").alias("id"), F.col("a").alias("component_id"))
        .unionByName(pairs.select(F.col("a").alias("id"), F.col("a").alias("component_id")).distinct())
    )
