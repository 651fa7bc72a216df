"""Sharding with balanced bytes by Karmarkar-Karp differencing over indivisible groups.

Partial partitions start with one group each; the two with the largest spread are combined, the largest part of one with
the smallest of the other, until one is left. That is done in two steps, each of bounded size. Groups above a
fixed share of all bytes, of which there can only be so many, are partitioned first. All others are dealt by hash into
leaves; each leaf's differencing includes, as one more partial partition, its share of what the large groups have put
into the shards. So the leaves fill up what the large groups left uneven, and no task or driver sees more than a leaf.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, counted_join, lookup

SHARDS = 8
#: Expected groups in a leaf.
LEAF = 2048
#: A group is large if it holds more than one in LARGE of all bytes; so there are fewer than LARGE of them.
LARGE = 8192
#: Rows of a shard that are numbered together.
RUN = 4096


def differencing(parts: list[list[int]]) -> list[list[int]]:
    """Partial partitions (k sums each) -> for each, the final part of each of its sums."""
    k = len(parts[0])
    nodes: list[tuple] = []
    heap = []
    for i, sums in enumerate(parts):
        order = sorted(range(k), key=lambda j: -sums[j])
        nodes.append((None, i, order))
        heap.append((sums[order[-1]] - sums[order[0]], i, [sums[j] for j in order]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        sums = [x[j] + y[k - 1 - j] for j in range(k)]
        order = sorted(range(k), key=lambda j: -sums[j])
        nodes.append((a, b, order))
        heapq.heappush(heap, (sums[order[-1]] - sums[order[0]], len(nodes) - 1, [sums[j] for j in order]))
    out: list[list[int]] = [[]] * len(parts)
    todo = [(len(nodes) - 1, list(range(k)))]
    while todo:
        at, labels = todo.pop()
        a, b, order = nodes[at]
        own = [0] * k
        for place, j in enumerate(order):
            own[j] = labels[place]
        if a is None:
            out[b] = own
        else:
            todo += [(a, own), (b, own[::-1])]
    return out


def _share(sums: list[int], leaf: int, leaves: int) -> list[int]:
    """A leaf's part of the sums; the leaves' parts add up to them."""
    return [x * (leaf + 1) // leaves - x * leaf // leaves for x in sums]


def _leaf(shards: int, sums: list[int], leaves: int):
    """Partitions a leaf's groups on top of its share of `sums`. Where that is even, shards are turned by the leaf's number, so that
    small remainders don't add up."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "key", "crc", "size"], ascending=[False, True, True, True], kind="stable")
        leaf = int(rows["leaf"].iloc[0])
        share = _share(sums, leaf, leaves)
        places = differencing([share] + [[b] + [0] * (shards - 1) for b in rows["bytes"].tolist()])
        turned = leaf % shards if max(share) == min(share) else 0
        shard = {place: (k + turned) % shards for k, place in enumerate(places[0])}
        return rows.assign(shard=np.array([shard[p[0]] for p in places[1:]], np.int32))[["key", "crc", "size", "n", "shard"]]

    return run


def _keys(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("key"), F.crc32(text).alias("crc"), (F.octet_length(text).cast("long") + 1).alias("size")]


def group_shards(slim: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows with key, crc, size -> a row per group: key, crc, size, shard, and n, its rows."""
    groups = slim.groupBy("key", "crc", "size").agg((F.count("*") * F.col("size")).alias("bytes"), F.count("*").alias("n"))
    groups = checkpointed(groups)
    n, total = groups.agg(F.count("*"), F.sum("bytes")).first()
    large = F.col("bytes") * LARGE > F.lit(total)
    first = sorted(groups.filter(large).collect(), key=lambda r: (-r["bytes"], r["key"], r["crc"], r["size"]))  # fewer than LARGE rows
    places = differencing([[r["bytes"]] + [0] * (shards - 1) for r in first]) if first else []
    sums = [0] * shards
    for r, p in zip(first, places, strict=True):
        sums[p[0]] += r["bytes"]
    placed = [(r["key"], r["crc"], r["size"], r["n"], p[0]) for r, p in zip(first, places, strict=True)]
    placed = groups.sparkSession.createDataFrame(placed, "key long, crc long, size long, n long, shard int")
    leaves = max(1, -(-(n - len(first)) // LEAF))
    rest = groups.filter(~large).withColumn("leaf", F.pmod(F.xxhash64("key", "crc"), F.lit(leaves)).cast("long"))
    return rest.groupBy("leaf").applyInPandas(_leaf(shards, sums, leaves), "key long, crc long, size long, n long, shard int").union(placed)


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of `docs`: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard.

    Rows with equal texts are one group and share a shard; null texts are empty. The sizes of shards are near
    equal unless one group exceeds a shard's share. Slots count from 0 in each shard without gaps; repeated rows
    have slots of their own. An empty table gives an empty result. Extra columns aren't read.
    """
    slim = checkpointed(docs.select(F.col(id_col).alias("doc_id"), *_keys(F.col(text_col))))
    n = slim.count()
    found = checkpointed(group_shards(slim, shards)) if n else slim.select("key", "crc", "size", F.lit(1).cast("long").alias("n"), F.lit(0).alias("shard"))
    runs = max(1, -(-n // (shards * RUN)))
    rows = counted_join(slim, found, ["key", "crc", "size"], "n", n)
    rows = rows.select("doc_id", "key", "crc", "size", "shard", F.pmod(F.xxhash64("doc_id", "key"), F.lit(runs)).cast("int").alias("run"))
    rows = checkpointed(rows)
    starts = rows.groupBy("shard", "run").count()
    before = W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    starts = checkpointed(starts.select("shard", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")))
    order = W.partitionBy("shard", "run").orderBy("doc_id", "key", "crc")
    rows = rows.withColumn("at", F.row_number().over(order) - 1)
    rows = lookup(rows, starts, ["shard", "run"], F.col("at"))
    return rows.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
