"""Sharding of documents by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadweave.llm.common import stored

#: A group of at least 1/FINE of a shard is an item of its own; smaller ones are bundled
#: by hash into FINE bundles for each shard. So at most 2 * FINE * shards items are differenced.
FINE = 1000
#: Runs that a shard's rows are numbered in, each by one window group.
RUNS = 512


def differencing(sizes: list[int], ways: int) -> list[int]:
    """The way of each item: the two partial partitions with the largest spread are
    combined, the one in falling, the other in rising order, until one is left."""
    if not sizes:
        return []
    nodes: list[tuple] = []
    heap = []
    for i, size in enumerate(sizes):
        # sums in falling order, and the slot each sum belongs to
        nodes.append(([size] + [0] * (ways - 1), list(range(ways)), None))
        heap.append((-size, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (x, xs, _), (y, ys, _) = nodes[a], nodes[b]
        sums = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(ways), key=sums.__getitem__, reverse=True)
        low = sums[order[-1]]
        top = [sums[i] - low for i in order]
        # slot i of the new partial holds slot xs[i] of a and slot ys[-1 - i] of b
        nodes.append((top, order, (a, b, xs, ys[::-1])))
        heapq.heappush(heap, (-(top[0] - top[-1]), len(nodes) - 1))
    way = [0] * len(sizes)
    stack = [(heap[0][1], list(range(ways)))]
    while stack:
        node, places = stack.pop()  # places: the final way of each own slot
        made = nodes[node][2]
        if made is None:
            way[node] = places[0]
            continue
        a, b, left, right = made
        at, bt = [0] * ways, [0] * ways
        for i, place in enumerate(places):
            at[left[i]], bt[right[i]] = place, place
        stack += [(a, at), (b, bt)]
    return way


def shards(docs: DataFrame, key: str = "doc_id", text: str = "text", count: int = 24, fine: int = FINE) -> DataFrame:
    """Rows (key, size, text_crc32, shard, slot): equal texts stay together, bytes are even.

    Size is the text's UTF-8 bytes plus 8; rows without text have size 8, no checksum, and
    form one group. Empty texts, repeated rows and ties are ordinary members of their group.
    A group above a shard's share makes its shard larger, since groups are not divided.
    Slots count from 0 in each shard without gaps. An empty table gives no rows. Other
    columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    rows = stored(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
            F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.xxhash64(text)).alias("_group"),
        ),
        "shard-rows",
    )
    groups = stored(rows.groupBy("_group").agg(F.sum("size").alias("_bytes")), "shard-groups")
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    unit = total / (count * fine)
    bundle = F.pmod(F.xxhash64("_group", F.lit(1)), F.lit(count * fine))
    large = groups.filter(F.col("_bytes") >= unit)  # at most count * fine of them, by their sum
    small = groups.filter(F.col("_bytes") < unit).groupBy(bundle.alias("_bundle")).agg(F.sum("_bytes").alias("_bytes"))
    items = [(g, None, n) for g, n in large.collect()] + [(None, b, n) for b, n in small.collect()]
    items.sort(key=lambda x: (-x[2], x[0] is None, x[0] or 0, x[1] or 0))
    way = differencing([x[2] for x in items], count)

    def lookup(at: int, name: str) -> DataFrame:
        found = [(x[at], w) for x, w in zip(items, way, strict=True) if x[at] is not None]
        frame = pd.DataFrame({name: [x for x, _ in found], f"{name}_way": [w for _, w in found]}, dtype="int64")
        return F.broadcast(spark.createDataFrame(frame, f"{name} long, {name}_way int"))

    placed = (
        rows.join(lookup(0, "_group"), "_group", "left")
        .withColumn("_bundle", bundle)
        .join(lookup(1, "_bundle"), "_bundle", "left")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.coalesce("_group_way", "_bundle_way").alias("shard"),
            F.pmod(F.xxhash64("doc_id", "_group"), F.lit(RUNS)).cast("int").alias("_run"),
        )
    )
    before = W.partitionBy("shard").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "_run")
        .agg(F.count("*").alias("_rows"))
        .select("shard", "_run", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    inside = W.partitionBy("shard", "_run").orderBy("doc_id", "size", "text_crc32")
    return (
        placed.withColumn("_place", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", "_run"])  # at most count * RUNS rows
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_place")).alias("slot"))
    )
