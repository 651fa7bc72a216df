"""The trie of conversations' beginnings, as a Cartesian tree over the common prefixes of the sorted conversations.

1. A conversation is a key of WIDTH bytes a turn, a hash of role and text. Keys are sorted, with ids among equal ones, over range partitions that are
   cut into blocks of about BLOCK turns. What a conversation has in common with the one before (LCP) and its own length, in turn, are one array:
   a node of the trie is an interval of it, between the nearest smaller values on both sides, and equal values in an interval are one node.
2. A stack finds both neighbours within a block. Nodes closed there are finished there, with all depths of their edges. What stays open is nested, so
   it's a short chain on either side: prefixes of the block's first and of its last conversation. Each chain entry knows the sums of all that lies
   between it and the block's edge.
3. The smallest value of each block tells in which block an open entry's smaller neighbour lies. Entries with the same two neighbours and the same value are one
   node; its sums are those behind the left neighbour, of whole blocks between, and before the right one.

Sums over an interval give everything but the smallest member: with P(i, d) for the bytes of a conversation's first d turns, the tokens that a node at
depth d saves are the sum of P(i, LCP(i)) over its members but the first, less P(d - 1) for each of these.

The driver gets nine numbers a block. A conversation is one row of its turns' hashes, and hashing the ids of equal conversations is sequential: they're
streamed through one task, as texts of a block's ids each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import partitions, written

#: Bytes that stand for a turn: half of a SHA-256.
WIDTH = 16
#: Turns and conversations in a block, and most range partitions.
BLOCK = 1 << 16
PARTS = 20_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
_MOST = (1 << 63) - 1


def sequences(chats: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, key (WIDTH bytes a turn), sizes (UTF-8 bytes of each text), a row per conversation.

    Turns are ordered by turn, null first; those of one number by role, then by their hash. Null roles and texts are empty. Rows without a conv_id belong to
    no conversation and are left out; repeated rows are turns of their own. Texts aren't shuffled. Extra columns aren't read."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    turns = chats.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", role.alias("role"), named.alias("hash"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("l"))
    return listed.select("conv_id", F.unhex(F.array_join(F.transform("l", lambda t: t["hash"]), "")).alias("key"), F.transform("l", lambda t: t["size"]).alias("sizes"))


def rebuilt(seqs: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c with its first h turns replaced by the first h of conversation c - c % group (all if it has fewer, none if there is none);
    h is the CRC-32 of c's decimal digits modulo `most`."""
    own = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    base = seqs.select(F.col("conv_id").alias("base"), F.substring("key", 1, WIDTH * (most - 1)).alias("head"), F.slice("sizes", 1, most - 1).alias("head_sizes"))
    both = own.join(base.filter(F.col("base") % group == 0), "base", "left")
    key = F.expr(f"concat(coalesce(substring(head, 1, {WIDTH} * h), X''), substring(key, {WIDTH} * h + 1))")
    return both.select("conv_id", key.alias("key"), F.expr("concat(coalesce(slice(head_sizes, 1, h), array()), slice(sizes, h + 1, size(sizes)))").alias("sizes"))


def lcp(a: bytes, b: bytes) -> int:
    """How many turns two keys have in common from the start."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    if a[: high * WIDTH] == b[: high * WIDTH]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid
    return low


class _Node:
    """An interval that is still open on the right: its value (depth), sums of its members, separators (LCP values equal to its own), members that
    end here, and the rows that wait for its smallest member."""

    __slots__ = ("depth", "n", "least", "saved", "leaves", "separators", "ends", "waiting")

    def __init__(self, depth: int) -> None:
        self.depth, self.n, self.least, self.saved, self.leaves, self.separators, self.ends, self.waiting = depth, 0, _MOST, 0, 0, 0, [], []

    def add(self, other: _Node) -> None:
        self.n, self.least, self.saved, self.leaves = self.n + other.n, min(self.least, other.least), self.saved + other.saved, self.leaves + other.leaves

    def sums(self) -> tuple[int, int, int, int]:
        return self.n, self.least, self.saved, self.leaves


def _edge(above: int, depth: int, n: int, least: int, saved: int, leaves: int, children: int, ends: str, sizes: list[int]) -> list[list]:
    """Rows of a node and of the depths between it and its parent, which have the same members; sizes: bytes of a member's first 0, 1, ... turns."""
    rows = [[least, d, least, n, 1, leaves, saved - (n - 1) * sizes[max(d - 1, 0)], NO_ENDS] for d in range(above + 1, depth + 1)]
    rows[-1][4], rows[-1][7] = children, ends
    rows[0][2] = None
    return rows


class Block:
    """Consecutive sorted conversations: nodes that are closed within, and the chains of those that aren't."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.stack: list[_Node] = []
        self.left: list[tuple[_Node, tuple[int, int, int, int]]] = []
        self.first: tuple[bytes, list[int]] | None = None
        self.key, self.sizes, self.units = b"", [0], 0

    def add(self, conv: int, key: bytes, sizes: list[int]) -> None:
        prefix, length = [0, *accumulate(sizes)], len(sizes)
        self.units += length + 1
        if self.first is None:
            self.first = key, prefix
            self.stack.append(_Node(length))
            self.left.append((self.stack[0], (0, _MOST, 0, 0)))
        else:
            shared = lcp(self.key, key)
            self._separate(shared)
            top = self.stack[-1]
            top.separators += 1
            top.saved += prefix[shared]
            if length > shared:
                self.stack.append(_Node(length))
        top = self.stack[-1]
        top.n, top.least = top.n + 1, min(top.least, conv)
        top.ends.append(conv)
        self.key, self.sizes = key, prefix

    def _separate(self, shared: int) -> None:
        """Closes what is deeper than the prefix that the next conversation shares."""
        stack = self.stack
        if stack[-1].depth > shared:
            stack[-1].leaves += 1
        while stack[-1].depth > shared:
            node = stack.pop()
            if not stack:  # open on the left
                stack.append(_Node(shared))
                self.left.append((stack[0], node.sums()))
            else:
                if stack[-1].depth < shared:
                    stack.append(_Node(shared))
                stack[-1].waiting.append(len(self.rows))
                self._close(node, stack[-1].depth)
            stack[-1].add(node)

    def _close(self, node: _Node, above: int) -> None:
        for i in node.waiting:
            self.rows[i][2] = node.least
        ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if node.ends else NO_ENDS
        self.rows += [[*row, None, None] for row in _edge(above, node.depth, *node.sums(), node.separators + 1 - len(node.ends), ends, self.sizes)]

    def done(self, block: int) -> Iterator[pa.RecordBatch]:
        """Its rows and its summary."""
        chain, after = [], (0, _MOST, 0, 0)
        for node in reversed(self.stack):
            chain.append((node, after))
            n, least, saved, leaves = after
            after = n + node.n, min(least, node.least), saved + node.saved, leaves + node.leaves
        open_ = [("left", node) for node, _ in self.left[:-1]] + [("right", node) for node in self.stack]
        for side, node in open_:
            for i in node.waiting:
                self.rows[i][8:] = [side, node.depth]
        if self.rows:
            columns = dict(zip(_NODE, map(list, zip(*self.rows, strict=True)), strict=True))
            yield _batch({"block": [block] * len(self.rows), **columns})
        sides = {}
        for side, entries in (("left", self.left), ("right", chain[::-1])):
            own = [{"depth": node.depth, "n": s[0], "least": s[1], "saved": s[2], "leaves": s[3], "separators": node.separators, "ends": len(node.ends), "ids": ",".join(map(str, node.ends))} for node, s in entries]
            sides[side] = [own if side == "right" else [*own[:-1], own[-1] | {"ids": ""}]]
        n, least, saved, leaves = after
        last = {"last_key": [self.key], "last_sizes": [self.sizes], "last_len": [len(self.sizes) - 1]}
        yield _batch({"block": [block], "members": [n], "least": [least], "saved_inside": [saved], "leaves_inside": [leaves], "lowest": [self.stack[0].depth], "first_key": [self.first[0]], "first_sizes": [self.first[1]], **last, **sides})


_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "side", "parent_depth")
_ENTRY = "array<struct<depth: long, n: long, least: long, saved: long, leaves: long, separators: long, ends: long, ids: string>>"
_FOUND = (
    "block long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, side string, parent_depth long, "
    "members long, least long, saved_inside long, leaves_inside long, lowest long, first_key binary, last_key binary, first_sizes array<long>, last_sizes array<long>, last_len long, "
    f"left {_ENTRY}, right {_ENTRY}"
)
_WORDS = pa.list_(pa.struct([*((n, pa.int64()) for n in ("depth", "n", "least", "saved", "leaves", "separators", "ends")), ("ids", pa.string())]))
_TYPES = {"ends_sha256": pa.string(), "side": pa.string(), "first_key": pa.binary(), "last_key": pa.binary(), "first_sizes": pa.list_(pa.int64()), "last_sizes": pa.list_(pa.int64()), "left": _WORDS, "right": _WORDS}
_SCHEMA = pa.schema([(n, _TYPES.get(n, pa.int64())) for n in (c.split()[0] for c in _FOUND.replace(_ENTRY, "x").split(", "))])


def _batch(columns: dict) -> pa.RecordBatch:
    size = len(columns["block"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _SCHEMA], schema=_SCHEMA)


class Minima:
    """Numbers with the minima of each `width` of them: nearest smaller ones, and least ones of a stretch."""

    def __init__(self, values: np.ndarray, width: int = 1024) -> None:
        self.values, self.width = values, width
        self.coarse = np.minimum.reduceat(values, np.arange(0, len(values), width)) if len(values) else values

    def left(self, i: int, below: int) -> int:
        """The last place up to i with a number below; -1 if there is none."""
        if i < 0:
            return -1
        group = i // self.width
        for start, end in ((group * self.width, i + 1), (None, None)):
            if start is None:
                groups = np.flatnonzero(self.coarse[:group] < below)
                if not len(groups):
                    return -1
                start = int(groups[-1]) * self.width
                end = start + self.width
            there = np.flatnonzero(self.values[start:end] < below)
            if len(there):
                return start + int(there[-1])
        return -1

    def right(self, i: int, below: int) -> int:
        """The first place from i with a number below; their number if there is none."""
        group = i // self.width
        there = np.flatnonzero(self.values[i : (group + 1) * self.width] < below)
        if len(there):
            return i + int(there[0])
        groups = np.flatnonzero(self.coarse[group + 1 :] < below)
        if not len(groups):
            return len(self.values)
        start = (group + 1 + int(groups[0])) * self.width
        return start + int(np.flatnonzero(self.values[start : start + self.width] < below)[0])

    def least(self, i: int, j: int) -> int:
        """Of places i to j - 1."""
        first, last = -(-i // self.width), j // self.width
        if first >= last:
            return int(self.values[i:j].min(initial=_MOST))
        return int(min(self.values[i : first * self.width].min(initial=_MOST), self.coarse[first:last].min(initial=_MOST), self.values[last * self.width : j].min(initial=_MOST)))


class Blocks:
    """What every task knows of all blocks: nine numbers each."""

    def __init__(self, table: pd.DataFrame) -> None:
        get = lambda c: table[c].to_numpy(np.int64)
        self.border, self.lowest = get("border"), get("lowest")
        self.minima, self.ids = Minima(np.minimum(self.border, self.lowest)), Minima(get("least"))
        self.last_is_leaf = (np.append(self.border[1:], -1) < get("last_len")).astype(np.int64)
        total = lambda values: np.concatenate(([0], np.cumsum(values)))
        self.members, self.leaves, self.saved = total(get("members")), total(get("leaves_inside") + self.last_is_leaf), total(get("saved_inside") + get("border_saved"))
        self.border_saved = get("border_saved")

    def neighbours(self, b: int, side: str, depth: int) -> tuple[int, int]:
        """The blocks with the nearest smaller values of an open entry of block b; the number of blocks if there is none on the right."""
        if side == "border":
            return self.minima.left(b - 1, depth), b if self.lowest[b] < depth else self.minima.right(b + 1, depth)
        if side == "left":
            return b if self.border[b] < depth else self.minima.left(b - 1, depth), b
        return self.minima.left(b, depth), self.minima.right(b + 1, depth)

    def parent(self, a: int, c: int, left_depth: int, depth: int, above: int) -> tuple[int, int]:
        """Where the nearest values smaller than `above` lie, for the parent of a node between blocks a and c: only what stands before the left neighbour or after the right one counts."""
        left = self.minima.left(a, above) if a < c or left_depth < above else self.minima.left(a - 1, above)
        if a < c and (c == len(self.border) or self.border[c] < depth):  # the right neighbour is a border
            return left, self.minima.right(c, above)
        return left, c if self.lowest[c] < above else self.minima.right(c + 1, above)


def _blocks_of(seqs: DataFrame, parts: int, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number = Block(), None
        for batch in batches:
            for part, conv, key, sizes in zip(*(batch.column(c).to_pylist() for c in ("part", "conv_id", "key", "sizes")), strict=True):
                number = part << 32 if number is None else number
                now.add(conv, key, sizes)
                if now.units >= block:
                    yield from now.done(number)
                    now, number = Block(), number + 1
        if now.units:
            yield from now.done(number)

    dealt = seqs.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return dealt.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "key", "sizes").mapInArrow(run, _FOUND)


def _bordered(found: DataFrame) -> tuple[DataFrame, Blocks]:
    """The blocks, numbered from 0 in order (at), and the numbers that all tasks need: `border` is what a block's first conversation has in common with the one before."""
    spark = found.sparkSession
    blocks = found.filter("members IS NOT NULL")
    ids = np.sort(blocks.select("block").toPandas()["block"].to_numpy(np.int64))
    order = spark.createDataFrame(pd.DataFrame({"block": ids, "before": np.append(-1, ids[:-1]), "at": np.arange(len(ids))}))
    shared = F.pandas_udf(lambda a, b: pd.Series([-1 if x is None else lcp(bytes(x), bytes(y)) for x, y in zip(a, b, strict=True)]), "long")
    both = blocks.join(order, "block").join(blocks.select(F.col("block").alias("before"), F.col("last_key").alias("before_key")), "before", "left")
    both = both.withColumn("border", shared("before_key", "first_key")).withColumn("border_saved", F.when(F.col("border") >= 0, F.element_at("first_sizes", F.col("border").cast("int") + 1)).otherwise(0))
    kept = written(both.select("block", "at", "border", "border_saved", "members", "least", "saved_inside", "leaves_inside", "lowest", "last_len", "first_sizes", "last_sizes", "left", "right"))
    table = kept.select("at", "border", "border_saved", "members", "least", "saved_inside", "leaves_inside", "lowest", "last_len").toPandas().sort_values("at")
    return kept, Blocks(table)


def _grouped(rows: DataFrame, chains: DataFrame, on: str, run, schema: str) -> DataFrame:
    return rows.groupBy(on).cogroup(chains.groupBy(on)).applyInPandas(run, schema)


_OPEN = "a long, depth long, c long, separators long, ends long"
_BEFORE = "right_depth long, n long, least long, saved long, leaves long"


def _open_nodes(blocks: DataFrame, known) -> tuple[DataFrame, DataFrame]:
    """Entries of chains with the node that each belongs to (block, side, depth, a, c), and rows of all depths of these nodes."""

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_blocks, out = known.value, []
        for frame in frames:
            for block, at, border, left, right in zip(*(frame[c] for c in ("block", "at", "border", "left", "right")), strict=True):
                own = [(block, "border", int(border), 1, 0)] if border >= 0 else []
                own += [(block, side, x["depth"], x["separators"], x["ends"]) for side, part in (("left", list(left)[:-1]), ("right", list(right))) for x in part]
                out += [(*x, *all_blocks.neighbours(at, x[1], x[2])) for x in own]
        yield pd.DataFrame(out, columns=["block", "side", "depth", "separators", "ends", "a", "c"])

    slim = blocks.select("block", "at", "border", *[F.transform(side, lambda x: F.struct(x["depth"].alias("depth"), x["separators"].alias("separators"), x["ends"].alias("ends"))).alias(side) for side in ("left", "right")])
    chain = written(slim.mapInPandas(entries, "block long, side string, depth long, separators long, ends long, a long, c long"))
    nodes = chain.groupBy("a", "depth", "c").agg(F.sum("separators").alias("separators"), F.sum("ends").alias("ends"))

    def before(rows: pd.DataFrame, chains: pd.DataFrame) -> pd.DataFrame:
        """The right neighbour: its value, and the sums of what its block has before it (without what its border adds)."""
        out = []
        border = int(chains["border"].iloc[0]) if len(chains) else -1
        left = list(chains["left"].iloc[0]) if len(chains) else []
        for r in rows.itertuples(index=False):
            x = {"depth": border, "n": 0, "least": _MOST, "saved": 0, "leaves": 0} if border < r.depth and r.a < r.c else next(x for x in left if x["depth"] < r.depth)
            out.append((r.a, r.depth, r.c, r.separators, r.ends, *(x[c] for c in ("depth", "n", "least", "saved", "leaves"))))
        return pd.DataFrame(out, columns=["a", "depth", "c", "separators", "ends", "right_depth", "n", "least", "saved", "leaves"])

    chains = blocks.select(F.col("at").alias("c"), "border", "left")
    half = _grouped(nodes, chains, "c", before, f"{_OPEN}, {_BEFORE}")

    def after(rows: pd.DataFrame, chains: pd.DataFrame) -> pd.DataFrame:
        """The left neighbour, all sums, and rows of the node's edge; the parent is known by its own neighbours."""
        out, know = [], known.value
        chain = chains.iloc[0]
        right = list(chain["right"]) if len(rows) else []
        for r in rows.itertuples(index=False):
            a, c = r.a, r.c
            below = [x for x in right if x["depth"] < r.depth]
            left_depth = below[-1]["depth"] if below and a < c else int(know.border[a])
            sums = r.n, r.least, r.saved, r.leaves
            if a < c:  # else all of it stands between the border of a block and an entry of its left chain
                x = below[-1] if below else {"n": know.members[a + 1] - know.members[a], "least": know.ids.least(a, a + 1), "saved": know.saved[a + 1] - know.saved[a] - know.border_saved[a], "leaves": know.leaves[a + 1] - know.leaves[a] - know.last_is_leaf[a]}
                into = int(know.border_saved[c]) if c < len(know.border) and know.border[c] >= r.depth else 0
                whole = [int(t[c] - t[a + 1]) for t in (know.members, know.saved, know.leaves)]
                sums = sums[0] + x["n"] + whole[0], min(sums[1], x["least"], know.ids.least(a + 1, c)), sums[2] + x["saved"] + whole[1] + into, sums[3] + x["leaves"] + int(know.last_is_leaf[a]) + whole[2]
            above = max(left_depth, r.right_depth)
            up = know.parent(a, c, left_depth, r.depth, above)
            sizes = [int(s) for s in chain["last_sizes" if a < c else "first_sizes"][: r.depth + 1]]
            for row in _edge(above, r.depth, *map(int, sums), r.separators + 1 - r.ends, NO_ENDS, sizes):
                top = row[1] == above + 1
                out.append((a, r.depth, c, *row[:7], row[1] == r.depth and r.ends > 0, *((up[0], above, up[1]) if top and above >= 0 else (None, None, None))))
        names = ["a", "node", "c", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ended", "up_a", "up", "up_c"]
        return pd.DataFrame(out, columns=names).astype({k: "Int64" for k in ("parent_conv_id", "up_a", "up", "up_c")})

    sizes = blocks.select(F.col("at").alias("a"), "right", "first_sizes", "last_sizes")
    schema = "a long, node long, c long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ended boolean, up_a long, up long, up_c long"
    made = _grouped(half, sizes.join(half.select("a").distinct(), "a", "left_semi"), "a", after, schema)
    return chain, written(made)


def _hashed(pieces: DataFrame) -> DataFrame:
    """a, node, c, block, ids -> the hash of all ids of a node, joined by commas in the order of blocks; streamed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        for frame in frames:
            out = []
            for *node, ids in zip(frame["a"], frame["node"], frame["c"], frame["ids"], strict=True):
                if node != now:
                    if now is not None:
                        out.append((*now, total.hexdigest()))
                    now, total = node, hashlib.sha256(ids.encode())
                else:
                    total.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["a", "node", "c", "sha"])
        if now is not None:
            yield pd.DataFrame([(*now, total.hexdigest())], columns=["a", "node", "c", "sha"])

    dealt = pieces.repartition(partitions(pieces.sparkSession), "a", "node", "c").sortWithinPartitions("a", "node", "c", "block")
    return dealt.select("a", "node", "c", "ids").mapInPandas(run, "a long, node long, c long, sha string")


def prefix_trie(seqs: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, key, sizes (rows of `sequences`, no id twice) -> a row per node, a distinct beginning of `depth` turns, from the empty one:

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Conversations without turns
    are members of the root. No conversations give no rows."""
    kept = written(seqs.select("conv_id", "key", "sizes"))
    units = kept.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = written(_blocks_of(kept, min(PARTS, max(1, -(-units // block))), block))
    closed = found.filter("members IS NULL")
    if not units:
        return closed.select(*columns)
    blocks, table = _bordered(found)
    known = seqs.sparkSession.sparkContext.broadcast(table)
    chain, rows = _open_nodes(blocks, known)
    smallest = rows.filter("depth = node").select(F.col("a").alias("up_a"), F.col("node").alias("up"), F.col("c").alias("up_c"), F.col("conv_id").alias("up_conv"))

    side = lambda name: blocks.select("block", F.lit(name).alias("side"), F.explode(name).alias("x")).filter("x.ends > 0 AND x.ids <> ''").select("block", "side", F.col("x.depth").alias("depth"), F.col("x.ids").alias("ids"))
    pieces = side("left").unionByName(side("right")).join(chain.select("block", "side", "depth", "a", "c"), ["block", "side", "depth"])
    hashes = _hashed(pieces.select("a", F.col("depth").alias("node"), "c", "block", "ids"))

    opened = rows.join(smallest, ["up_a", "up", "up_c"], "left").join(hashes, ["a", "node", "c"], "left")
    opened = opened.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up_conv")).withColumn("ends_sha256", F.when(F.col("ended"), F.col("sha")).otherwise(NO_ENDS))
    waiting = closed.filter("side IS NOT NULL").select("block", "side", F.col("parent_depth").alias("up"), *[c for c in columns if c != "parent_conv_id"])
    owner = chain.filter("side <> 'border'").select("block", "side", F.col("depth").alias("up"), F.col("a").alias("up_a"), F.col("c").alias("up_c")).join(smallest, ["up_a", "up", "up_c"])
    met = waiting.join(owner.select("block", "side", "up", F.col("up_conv").alias("parent_conv_id")), ["block", "side", "up"])
    return closed.filter("side IS NULL").select(*columns).unionByName(met.select(*columns)).unionByName(opened.select(*columns))
