"""Vectors (V-*): normalizing, exact cosine search, incremental embedding."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.storage import apart

BATCH, ATTEMPTS, LONGEST_WAIT = 64, 6, 60.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """K-08: length one; a zero vector stays."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: (x / norm(a)).cast("float"))).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """V-09: 0 if either has no length or their sizes differ."""
    usable = (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(usable, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


#: Vectors of a block of rows and of queries, at most and, of rows, at least; rows and queries that are multiplied at once within.
BLOCK, LEAST_BLOCK, ROWS_AT_ONCE, QUERIES_AT_ONCE = 1 << 16, 1 << 10, 8192, 1024


def nearest(rows: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, digits: int = 6) -> DataFrame:
    """V-08: exact cosine top-k. rows: id, v; queries: query, q (ids are whole numbers). Rows equal to the query's own id, and those of another size than the
    query, are left out; a vector of length zero scores 0.

    A product by blocks: both tables are dealt to blocks by hash, each block of rows meets each block of queries in a task of its own, which gives the best k of each of its
    queries, and these are merged by query. Both tables stay distributed, and a task holds two blocks, however many rows or queries there are. Ties go by id."""
    left = rows.select(F.size("v").alias("n"), F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v")).filter("n > 0")
    right = queries.select(F.size("q").alias("n"), F.col("query").cast("long").alias("query"), F.col("q").cast("array<double>").alias("q")).filter("n > 0")
    asked = {r["n"]: r["c"] for r in right.groupBy("n").agg(F.count("*").alias("c")).collect()}  # a row for each size of vector
    held = {r["n"]: r["c"] for r in left.groupBy("n").agg(F.count("*").alias("c")).collect() if r["n"] in asked}
    cores, out = rows.sparkSession.sparkContext.defaultParallelism, None
    for n, count in held.items():
        across, down = -(-asked[n] // block), max(-(-count // block), min(cores, -(-count // LEAST_BLOCK)))
        dealt = lambda key, parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        x = left.filter(F.col("n") == n).select("id", "v", dealt("id", down).alias("r"), each(across).alias("c"))
        y = right.filter(F.col("n") == n).select("query", "q", dealt("query", across).alias("c"), each(down).alias("r"))
        best = x.groupBy("r", "c").cogroup(y.groupBy("r", "c")).applyInPandas(_closest(k, digits), "query long, id long, score double")
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = right.select("query", F.col("query").alias("id"), F.lit(0.0).alias("score")).filter("false")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return out.withColumn("rank", place).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_list()).astype(np.float64)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _closest(k: int, digits: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The best k rows of each query of two blocks, as (query, id, score)."""

    def best(names: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        last = np.partition(scores, -k, axis=1)[:, -k] if k < scores.shape[1] else np.full(len(names), -2.0)
        q, r = np.nonzero((scores >= last[:, None]) & (scores > -2))
        order = np.lexsort((ids[r], -scores[q, r], q))
        q, r = q[order], r[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < k
        return names[q[kept]], ids[r[kept]], scores[q[kept], r[kept]]

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(queries):
            ids, names, vectors, units = rows["id"].to_numpy(np.int64), queries["query"].to_numpy(np.int64), _unit(rows["v"]), _unit(queries["q"])
            for a in range(0, len(names), QUERIES_AT_ONCE):
                for b in range(0, len(ids), ROWS_AT_ONCE):
                    own, theirs = names[a : a + QUERIES_AT_ONCE], ids[b : b + ROWS_AT_ONCE]
                    scores = np.round(units[a : a + QUERIES_AT_ONCE] @ vectors[b : b + ROWS_AT_ONCE].T, digits) + 0.0
                    scores[own[:, None] == theirs[None, :]] = -np.inf
                    found.append(best(own, theirs, scores))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query", "id", "score"), columns, strict=True)))

    return run


def best_per_group(rows: DataFrame, group: str, query: Column) -> DataFrame:
    """V-10: of each group (id, v) the member closest to a query vector; ties go to the smallest id."""
    scored = rows.withColumn("score", F.round(cosine(F.col("v"), query), 6))
    return scored.groupBy(group).agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("b")).select(group, "b.id", "b.score")


def hashed_words(dim: int = 64) -> Callable[[str], list[float]]:
    """A stand-in for a model: words counted in buckets of their MD5."""

    def embed(text: str) -> list[float]:
        out = [0.0] * dim
        for w in re.findall(r"\w+", text.lower()):
            out[int(hashlib.md5(w.encode()).hexdigest(), 16) % dim] += 1.0
        return out

    return embed


class TooLarge(Exception):
    """The request must be cut in two."""


class Retry(Exception):
    """The request may work later; after is what the service asked for, in seconds."""

    def __init__(self, after: float | None = None):
        super().__init__("retry")
        self.after = after


def embed_batch(texts: list[str], call: Callable[[list[str]], list[list[float]]], wait: Callable[[float], None] = time.sleep) -> list[list[float] | None]:
    """V-01, V-03: halves a batch that is too large, waits and tries again where that may help; a text that is too large alone has none."""
    for attempt in range(ATTEMPTS):
        try:
            return list(call(texts))
        except TooLarge:
            if len(texts) == 1:
                return [None]
            half = len(texts) // 2
            return embed_batch(texts[:half], call, wait) + embed_batch(texts[half:], call, wait)
        except Retry as e:
            if attempt == ATTEMPTS - 1:
                raise
            wait(min(LONGEST_WAIT, e.after if e.after is not None else 2.0**attempt))
    return [None] * len(texts)


def embed_pending(pieces: DataFrame, vectors: DataFrame, call: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """V-01, V-07, S-36: vectors for the hashes that have none, each different text once. pieces: hash, text -> hash, vector.
    Written by the caller; what is written isn't asked for again."""
    todo = apart(pieces.select("hash", "text"), "hash").join(vectors.select("hash"), "hash", "left_anti").groupBy("hash").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(0, rows.num_rows, BATCH):  # only these texts become Python's
                part = rows.slice(i, BATCH)
                found = zip(part["hash"].to_pylist(), embed_batch(part["text"].to_pylist(), call), strict=True)
                kept = [(h, [x / (math.sqrt(sum(y * y for y in v)) or 1.0) for x in v]) for h, v in found if v is not None]
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in kept], pa.string()), pa.array([v for _, v in kept], pa.list_(pa.float32()))], ["hash", "vector"])

    return todo.mapInArrow(run, "hash string, vector array<float>")


def model_print(model: Column, dimensions: Column, template_version: Column) -> Column:
    """V-05, V-06: names a vector space; vectors of another are not read."""
    return F.concat_ws(":", F.regexp_replace(F.lower(F.trim(model)), r":latest$", ""), dimensions.cast("string"), template_version.cast("string"))


def formatted(templates: DataFrame, models: DataFrame) -> DataFrame:
    """V-05: each model's template: that of the first pattern, in order, which its name contains. templates: place, pattern, document, query."""
    if (n := templates.limit(1001).count()) > 1000:
        raise ValueError(f"{n} templates or more: a model's name is compared with each of them")
    hit = models.crossJoin(F.broadcast(templates)).filter(F.contains(F.lower("model"), F.col("pattern")))
    return hit.groupBy("model").agg(F.min_by(F.struct("document", "query"), "place").alias("t")).select("model", "t.*")
