"""Removal of lines that many documents share, by minimal perfect hashes over line hashes.

1. Each task counts, in its own documents, how many hold a line: a document counts a line once. Lines are
   known by 128 bits of a hash of their key. Counts meet by hash and are added.
2. Hashes that reach the index's least count are dealt to shards by their first bits. A shard is a minimal perfect hash:
   levels of bits, in which a key that no other meets at its place has a set bit, and the rest goes on to the next
   level; the number of bits set before a key's bit is its place in two arrays, of fingerprints and of counts.
3. Documents probe the arrays: a line is found where its fingerprint is. As long as all arrays together are small
   (`resident` bytes), every task has them; the texts aren't shuffled and lines aren't joined. Beyond that, the
   line hashes of a document go to their shards, which answer with the numbers of its common lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import partitions, written

#: Keys in a shard, on average.
SHARD = 1 << 17
#: Bytes of arrays that every task may hold.
RESIDENT = 64 << 20
#: Bits of a level for each key that it is asked for.
ROOM = 2
#: Lines of a task that are counted before they are handed on.
AT_ONCE = 1 << 19
#: Parts that a text's copies are dealt to where the answers are joined.
COPIES = 8
_NONE = b"\0" * 16


def keys_of(text: str | None) -> list[bytes]:
    """The key of each line: without white space (U+0020, U+0009 to U+000D) at both ends, A-Z in lower case. Null is one empty line."""
    return [line.strip().lower() for line in (text or "").encode("utf-8", "replace").split(b"\n")]


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _long_enough(key: bytes, shortest: int) -> bool:
    return len(key) >= shortest and (shortest <= 1 or len(key.decode("utf-8", "replace")) >= shortest)


def _mixed(x: np.ndarray) -> np.ndarray:
    """All bits of each number depend on all others (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    return (_mixed(high + low * np.uint64(2 * level + 1)) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """A minimal perfect hash over different pairs of 64-bit numbers, with a fingerprint and a count at each key's place."""

    sizes: np.ndarray
    bits: np.ndarray
    prints: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> PerfectHash:
        sizes, levels, order, left = [], [], [], np.arange(len(high))
        while len(left):
            size = max(64, -(-ROOM * len(left) // 64) * 64)
            at = _place(high[left], low[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            own = alone[at]
            order.append(left[own][np.argsort(at[own])])
            left = left[~own]
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little"))
        order = np.concatenate(order) if order else left
        bits = np.concatenate(levels) if levels else np.zeros(0, np.uint8)
        return cls(np.array(sizes, np.int64), bits, low[order], np.minimum(counts[order], 0xFFFF).astype(np.uint16))

    def __post_init__(self) -> None:
        words = self.bits.view(np.uint64)
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1]

    def count(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The count of each pair, 0 where it is no key."""
        out, left, first = np.zeros(len(high), np.int64), np.arange(len(high)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _place(high[left], low[left], level, size) + first
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            there = (word >> bit) & np.uint64(1) == 1
            own, inside = left[there], np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slot = self.before[at[there] >> 6] + inside[there]
            out[own] = np.where(self.prints[slot] == low[own], self.counts[slot], 0)
            left, first = left[~there], first + size
        return out

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.sizes.tobytes(), self.bits.tobytes(), self.prints.tobytes(), self.counts.tobytes()

    @classmethod
    def unpacked(cls, sizes: bytes, bits: bytes, prints: bytes, counts: bytes) -> PerfectHash:
        return cls(np.frombuffer(sizes, np.int64), np.frombuffer(bits, np.uint8), np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.uint16))


def _pairs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    """By the first 32 bits, so that shards are even."""
    return ((high >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def line_counts(docs: DataFrame, text_col: str = "text", shortest: int = 1) -> DataFrame:
    """high, low (the two halves of a line's hash), n: how many rows of `docs` hold a line whose key has at least `shortest` code points.

    Tasks add up what they see, AT_ONCE lines at a time, so a line that all documents have is sent once by a task and round. Null and empty texts
    have one empty line; repeated rows count each; an empty table gives an empty result; extra columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[bytes] = []

        def told() -> pa.RecordBatch:
            digests, counts = np.unique(np.frombuffer(b"".join(seen), "V16"), return_counts=True) if seen else (np.zeros(0, "V16"), np.zeros(0, np.int64))
            both = digests.view(">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(counts.astype(np.int64))], names=["high", "low", "n"])

        for batch in batches:
            for text in batch.column(0):
                own = {k for k in keys_of(text.as_py()) if _long_enough(k, shortest)}
                seen.extend(map(_hash, own))
                if len(seen) >= AT_ONCE:
                    yield told()
        yield told()

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "high long, low long, n long")
    return found.groupBy("high", "low").agg(F.sum("n").alias("n"))


def line_index(counts: DataFrame, least: int = 1, shard: int = SHARD) -> tuple[DataFrame, int, int]:
    """The index over line hashes (rows of line_counts) with a count of `least` or more: a row per shard with its arrays, written; how many shards;
    how many bytes. Lines that are rarer take no place: the fingerprint, all of the hash's second half, turns them away. Counts stop at 65535."""
    kept = written(counts.filter(F.col("n") >= least))
    shards = max(1, -(-kept.count() // shard))
    number = F.shiftright(F.shiftrightunsigned("high", 32) * shards, 32).cast("int")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = PerfectHash.build(rows["high"].to_numpy(np.int64).view(np.uint64), rows["low"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64))
        return pd.DataFrame([(int(rows["shard"].iloc[0]), *made.packed())], columns=["shard", "sizes", "bits", "prints", "counts"])

    made = kept.withColumn("shard", number).groupBy("shard").applyInPandas(build, "shard int, sizes binary, bits binary, prints binary, counts binary")
    index = written(made)
    size = index.agg(F.sum(sum(F.length(c) for c in ("sizes", "bits", "prints", "counts")))).first()[0]
    return index, shards, int(size or 0)


class Arrays:
    """All shards, in a task."""

    def __init__(self, rows: list[tuple], shards: int) -> None:
        self.shards = shards
        self.own = {shard: PerfectHash.unpacked(*arrays) for shard, *arrays in rows}

    def counts(self, digests: list[bytes]) -> np.ndarray:
        out = np.zeros(len(digests), np.int64)
        if digests and self.own:
            high, low = _pairs(digests)
            number = _shard_of(high, self.shards)
            order = np.argsort(number, kind="stable")
            edges = np.searchsorted(number[order], np.arange(self.shards + 1))
            for shard, arrays in self.own.items():
                rows = order[edges[shard] : edges[shard + 1]]
                if len(rows):
                    out[rows] = arrays.count(high[rows], low[rows])
        return out


def _kept(text: str | None, dropped: np.ndarray) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    return len(lines), int(dropped.sum()), "\n".join(line for line, out in zip(lines, dropped.tolist(), strict=True) if not out)


def _resident(docs: DataFrame, index: DataFrame, shards: int, least: int, shortest: int, kind: str) -> DataFrame:
    """The arrays, of a counted size, are sent to all tasks once."""
    arrays = docs.sparkSession.sparkContext.broadcast([(r[0], *map(bytes, r[1:])) for r in index.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Arrays(arrays.value, shards)
        for batch in batches:
            texts, start = batch.column("text").to_pylist(), 0
            while start < len(texts):  # so many texts as have AT_ONCE lines together
                digests, ends = [], [0]
                while start + len(ends) <= len(texts) and ends[-1] < AT_ONCE:
                    digests += [_hash(k) if _long_enough(k, shortest) else _NONE for k in keys_of(texts[start + len(ends) - 1])]
                    ends.append(len(digests))
                out = index.counts(digests) >= least
                rows = [_kept(t, out[a:b]) for t, a, b in zip(texts[start:], ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(rows)), *(pa.array(c) for c in zip(*rows, strict=True))], names=["doc_id", "n_lines", "n_dropped", "text"])
                start += len(rows)

    return docs.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, text string")


def _routed(docs: DataFrame, index: DataFrame, shards: int, least: int, shortest: int, kind: str) -> DataFrame:
    """The hashes of a text's lines go to their shards, in blocks, each with those of its task's texts; what the shards have found comes back by
    the text's hash. Equal texts have equal common lines, so they are asked for once; only their answer, of a few bytes a line, is joined."""
    tasks = partitions(docs.sparkSession)
    named = docs.withColumn("name", F.sha2(F.coalesce("text", F.lit("")), 256))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("name"), batch.column("text"), strict=True):
                own: dict[bytes, list[int]] = {}
                for i, key in enumerate(keys_of(text.as_py())):
                    if _long_enough(key, shortest):
                        own.setdefault(_hash(key), []).append(i)
                if own:
                    high, low = _pairs(list(own))
                    number = _shard_of(high, shards)
                    order = np.argsort(number, kind="stable")
                    lines = list(own.values())
                    cut = np.flatnonzero(np.diff(number[order])) + 1
                    for rows in np.split(order, cut):
                        held = np.concatenate([lines[r] for r in rows]).astype(np.int32)
                        of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(lines[r]) for r in rows])
                        body = high[rows].tobytes() + low[rows].tobytes()
                        yield pa.RecordBatch.from_pydict({"shard": pa.array([int(number[rows[0]])], pa.int32()), "name": [name.as_py()], "body": [body], "lines": [held.tobytes()], "of": [of.tobytes()]})

    questions = named.select("name", "text").mapInArrow(asked, "shard int, name string, body binary, lines binary, of binary").dropDuplicates(["shard", "name"])

    # A shard's questions are dealt to many tasks, each of which has the shard's arrays for them.
    salted = questions.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(tasks)).cast("int"))
    arrays = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def answered(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["name", "lines"], dtype=object)
        own = PerfectHash.unpacked(*(bytes(right[c].iloc[0]) for c in ("sizes", "bits", "prints", "counts")))
        out = []
        for name, body, lines, of in zip(left["name"], left["body"], left["lines"], left["of"], strict=True):
            high, low = np.frombuffer(body, np.uint64).reshape(2, -1)
            common = (own.count(high, low) >= least)[np.frombuffer(of, np.int32)]
            if common.any():
                out.append((name, np.frombuffer(lines, np.int32)[common].tolist()))
        return pd.DataFrame(out, columns=["name", "lines"], dtype=object)

    found = salted.groupBy("shard", "salt").cogroup(arrays.groupBy("shard", "salt")).applyInPandas(answered, "name string, lines array<int>")
    common = found.groupBy("name").agg(F.flatten(F.collect_list("lines")).alias("lines"))
    dealt = named.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(COPIES)).cast("int"))
    out = dealt.join(common.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))), ["name", "part"], "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<int>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, lines in zip(batch.column("text"), batch.column("lines"), strict=True):
                dropped = np.zeros((text.as_py() or "").count("\n") + 1, bool)
                dropped[np.array(lines.as_py(), np.int64)] = True
                rows.append(_kept(text.as_py(), dropped))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_lines", "n_dropped", "text"])

    return out.select("doc_id", "text", "lines").mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, text string")


def drop_common_lines(docs: DataFrame, least: int = 10, shortest: int = 1, id_col: str = "doc_id", text_col: str = "text", resident: int = RESIDENT, shard: int = SHARD) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: each text without the lines whose key has `shortest` code points or more and is found in `least` rows or more.

    A null or empty text is one empty line. Repeated rows are documents of their own, null ids stay, an empty table gives an empty result, and a
    text from which all lines go is empty. Extra columns aren't read. Texts of any length are taken whole, one after another."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    index, shards, size = line_index(line_counts(own, shortest=shortest), least, shard)
    kind = docs.schema[id_col].dataType.simpleString()
    return (_resident if size <= resident else _routed)(own, index, shards, least, shortest, kind)
