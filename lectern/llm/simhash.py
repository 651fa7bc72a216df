"""SimHash near-duplicates with deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits, cut into two segments of 32 bits, have one
segment that differs in at most one. So each fingerprint is indexed under both whole segments and under
every segment with one bit deleted (66 keys); fingerprints under a common key are compared exactly.

Under a key, fingerprints are linked into trees rather than into all pairs, which keeps the components. A key with
many fingerprints isn't compared as a whole. Its members are indexed again by the
halves of the other segment: that one must then differ in at most one bit in one half. Such a second
key leaves at most 18 of the 64 bits open, which bounds a bucket by the code, not by the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from lectern.llm.common import BROADCAST_ROWS, checkpointed, counted_join, packed
from lectern.llm.components import components

SHINGLE = 3
SEED = 42
MOST_BITS = 3
#: Buckets up to this size are linked at once; larger ones are indexed again.
PAIRED = 64
#: Fingerprints that a task indexes.
INDEXED = 8192
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLOCK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The signed 64-bit SimHash of a text; 0 if it has no words or is null."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        raw = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[i : i + _BLOCK], stops[i : i + _BLOCK], strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _variants(value: Column, bits: int, tag: Column) -> Column:
    """Keys of a `bits`-bit value: the whole and, for each bit, the value without it. tag goes into each key."""

    def one(i):
        whole = i == bits
        bit = F.when(whole, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i))
        return F.struct(
            (tag * (1 << 40) + i.cast("long") * (1 << 33) + value.bitwiseAND(F.bitwise_not(bit))).alias("key"),
            F.when(whole, F.lit(None)).otherwise(value.bitwiseAND(bit) != 0).alias("side"),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(bits)), one)


def _segment(fp: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))


def _split(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows under keys with up to PAIRED rows, and the others, if there are any. Keys are counted before anything else, and rows of crowded ones
    aren't brought together: while these keys are few they are broadcast."""
    crowded = checkpointed(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(f"n > {PAIRED}").select(*keys))
    n = crowded.count()
    if not n:
        return rows, None
    crowded = F.broadcast(crowded) if n <= BROADCAST_ROWS else crowded
    return rows.join(crowded, list(keys), "left_anti"), rows.join(crowded, list(keys), "left_semi")


def _forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all links among different fingerprints connect: fewer than there are fingerprints."""
    if len(fp) == 2:
        a, b = fp.tolist()
        return [(a, b)] if ((a ^ b) & (1 << 64) - 1).bit_count() <= MOST_BITS else []
    bits, loose, out = fp.view(np.uint64), np.arange(len(fp)), []
    while len(loose):
        reached, loose = loose[:1], loose[1:]
        while len(reached) and len(loose):
            grown = []
            for i in reached:
                near = np.bitwise_count(bits[loose] ^ bits[i]) <= MOST_BITS
                out += [(int(fp[i]), int(fp[j])) for j in loose[near]]
                grown.append(loose[near])
                loose = loose[~near]
                if not len(loose):
                    break
            reached = np.concatenate(grown)
    return out


def _links_in(rows: DataFrame, *keys: str) -> DataFrame:
    """A forest of links for each bucket of at most PAIRED fingerprints. A bucket in which the deleted bit is the same for
    all holds what the whole segment's bucket holds, and is left to that."""
    members = rows.groupBy(*keys).agg(F.collect_list("fp").alias("m"), F.min("side").alias("low"), F.max("side").alias("high"))
    forest = F.pandas_udf(lambda found: pd.Series([[{"a": a, "b": b} for a, b in _forest(np.asarray(m, np.int64))] for m in found]), "array<struct<a:long,b:long>>")
    return members.filter("size(m) > 1 AND (low IS NULL OR low <> high)").select(F.explode(forest("m")).alias("p")).select("p.a", "p.b")


def _trees(members: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(_forest(np.unique(members["fp"].to_numpy(np.int64))), columns=["a", "b"], dtype="int64")


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints fp -> edges a, b of at most MOST_BITS differing bits, with the same
    components as all such pairs."""
    segments = F.concat(*[_variants(_segment(F.col("fp"), low, 32), 32, F.lit(k).cast("long")) for k, low in enumerate((0, 32))])
    dealt = fps.select("fp").repartition(max(1, -(-fps.count() // INDEXED)))
    rows = dealt.select("fp", F.explode(segments).alias("v")).select("v.key", "v.side", "fp")
    cold, hot = _split(rows, "key")
    out = _links_in(cold, "key")
    if hot is not None:
        other = F.when(F.shiftrightunsigned("key", 40) == 0, _segment(F.col("fp"), 32, 32)).otherwise(_segment(F.col("fp"), 0, 32))
        halves = F.concat(*[_variants(_segment(other, low, 16), 16, F.lit(k).cast("long")) for k, low in enumerate((0, 16))])
        again = hot.select("key", "fp", F.explode(halves).alias("h")).select("key", F.col("h.key").alias("key2"), "fp", F.lit(None).cast("boolean").alias("side"))
        cold, hot = _split(again, "key", "key2")
        out = out.union(_links_in(cold, "key", "key2"))
        if hot is not None:
            out = out.union(hot.select("key", "key2", "fp").groupBy("key", "key2").applyInPandas(lambda k: _trees(k), "a long, b long"))
    return out.distinct()


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of near_duplicates, and root: a fingerprint that names the component, never null."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), fingerprints(F.col(text_col)).alias("fp"))
    slim = checkpointed(slim)
    fps = checkpointed(slim.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    total = fps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    roots = checkpointed(components(links(fps.select("fp"))))
    linked = roots.join(fps, roots["node"] == fps["fp"]).select("node", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "r")
    linked = linked.join(least, linked["root"] == least["r"]).select("node", "root", "component")
    labels = fps.join(linked, fps["fp"] == linked["node"], "left")
    labels = checkpointed(labels.select("fp", "n", F.coalesce("component", "least").alias("component_id"), F.coalesce("root", "fp").alias("root")))
    return counted_join(slim, labels, ["fp"], "n", total).select("doc_id", "text_hash", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of `docs`: doc_id, text_hash, fp and component_id, the smallest doc_id reachable over links.

    Null and empty texts have fingerprint 0 and are linked like others. Equal texts share a fingerprint.
    Null ids are kept and count as larger than any other; a component of null ids has a null id.
    An empty table gives an empty result. Extra columns aren't read.
    """
    return _labelled(docs, id_col, text_col).drop("root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each component: that with the smallest id, nulls last (of repeated rows, one). Ids may repeat across components. Texts without words,
    null and empty ones among them, are one component. An empty table stays empty; extra columns stay."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k")
    kept = _labelled(docs, id_col, text_col).groupBy("root").agg(first).select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_hash").alias("kept_hash"))
    rows = packed(docs, own_id=docs[id_col], own_hash=F.xxhash64(docs[text_col]))
    rows = rows.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_hash") == F.col("kept_hash")), "left_semi")
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("own_id", "own_hash").orderBy("own_hash")))
    return rows.filter("n = 1").select("row.*")
