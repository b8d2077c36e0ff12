"""Merkle fixity audit of web archive records.

Every stored page is one WARC record at a byte offset of the collection.
Records are hashed; the records that start in an ordered range of offsets are
hashed together, ranges into ranges of ranges, up to one root.  Two replicas
with equal roots are equal.  Otherwise the audit descends level by level and
looks only below nodes that differ, so what is read falls with the damage, and
ends at the records themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialise

RANGE_BYTES = 1 << 16
FANOUT = 16
# Repeats of one record that are placed together.
RUN = 4096
HEAD = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"


def warc_record(page_id: Column, url: Column, body: Column) -> Column:
    """The bytes of a record; a null id or url is left out, a null body is empty."""
    content = F.encode(F.coalesce(body, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit(HEAD), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.length(content).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), content, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def lay_out(rows: DataFrame, order: list[str], length: str) -> DataFrame:
    """Adds ``offset``: the bytes in front of each row when rows stand in order, without gaps.

    ``order`` must name all columns but ``length`` that tell rows apart.
    Equal rows are counted, ranged over partitions and placed as runs, so one
    row may be repeated any number of times; only sums of partitions meet in
    one place.
    """
    columns = [*order, length]
    counted = rows.groupBy(*columns).agg(F.count("*").alias("copies"))
    counted = materialise(counted, "fixity-counted")
    ranged = counted.repartitionByRange(*[F.col(c) for c in columns]).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "fixity-ranged")
    size = F.col(length) * F.col("copies")
    sums = ranged.groupBy("part").agg(F.sum(size).alias("bytes"))
    before = F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(bases), "part").withColumn(
        "offset", F.col("base") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    )
    # a run of copies becomes rows in two steps, so that one task never makes a whole long run
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / RUN))))
    long_runs = runs.where(F.col("copies") > RUN).repartition("offset", "run")
    runs = runs.where(F.col("copies") <= RUN).unionByName(long_runs)
    last = F.least(F.col("copies") - F.col("run") * RUN, F.lit(RUN)) - 1
    each = runs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    at = F.col("offset") + (F.col("run") * RUN + F.col("k")) * F.col(length)
    return each.withColumn("offset", at).select(*columns, "offset")


@dataclass
class Tree:
    """``records``: (offset, length, digest); ``levels[k]``: (node, hash), the last one row."""

    records: DataFrame
    levels: list[DataFrame]


def build(records: DataFrame, depth: int, range_bytes: int = RANGE_BYTES) -> Tree:
    """The tree over ``(offset, length, digest)``; node n of level k covers the offsets
    from n to n + 1 times ``range_bytes`` times ``FANOUT`` to the k.

    A range holds few records, as each takes a hundred bytes and more; a node
    of a higher level has at most ``FANOUT`` children.
    """

    def hashed(rows: DataFrame, place: str, node: Column, value: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct(place, value)))
        text = F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p[place], p[value])), "\n")
        return rows.groupBy(node.alias("node")).agg(F.sha2(text, 256).alias("hash"))

    leaf = records.withColumn("said", F.concat_ws("-", "length", "digest"))
    levels = [
        materialise(hashed(leaf, "offset", F.floor(F.col("offset") / range_bytes), "said"), "fixity-level")
    ]
    for _ in range(depth):
        up = F.floor(F.col("node") / FANOUT)
        levels.append(materialise(hashed(levels[-1], "node", up, "hash"), "fixity-level"))
    return Tree(records, levels)


def depth_for(records: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    """Levels above the ranges until one node covers all offsets."""
    last = records.agg(F.max("offset")).first()[0] or 0
    ranges, depth = last // range_bytes, 0
    while ranges:
        ranges //= FANOUT
        depth += 1
    return depth


def audit(primary: Tree, replica: Tree, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(offset, length, expected, found, fault)`` of every record that differs.

    ``fault`` is ``damaged`` (other bytes), ``missing`` or ``extra``.  Equal
    roots end the audit at once; two empty collections are equal.
    """

    def differing(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnRenamed("hash", "other")
        return a.join(b, "node", "full").where("NOT hash <=> other").select("node")

    level = len(primary.levels) - 1
    bad = materialise(differing(primary.levels[level], replica.levels[level]), "fixity-differing")
    while level and not bad.isEmpty():
        level -= 1
        parents = bad.withColumnRenamed("node", "parent")

        def below(tree: Tree, level: int = level, parents: DataFrame = parents) -> DataFrame:
            up = F.floor(F.col("node") / FANOUT)
            rows = tree.levels[level].withColumn("parent", up)
            return rows.join(parents, "parent", "left_semi").drop("parent")

        bad = materialise(differing(below(primary), below(replica)), "fixity-differing")

    def held(tree: Tree, name: str) -> DataFrame:
        rows = tree.records.withColumn("node", F.floor(F.col("offset") / range_bytes))
        return rows.join(bad, "node", "left_semi").select("offset", "length", F.col("digest").alias(name))

    both = held(primary, "expected").join(held(replica, "found"), ["offset", "length"], "full")
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("damaged")
    return both.where("NOT expected <=> found").withColumn("fault", fault)


def audit_replicas(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Builds both trees over ``(offset, length, digest)`` to one depth and compares them."""
    depth = max(depth_for(primary, range_bytes), depth_for(replica, range_bytes))
    return audit(build(primary, depth, range_bytes), build(replica, depth, range_bytes), range_bytes)
