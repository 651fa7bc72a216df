"""Removal of repeated byte strings, by bucket-pointer refinement of suffixes.

A byte is removed if a string of LENGTH bytes that covers it also starts in a document with a smaller id.

1. Every window of LENGTH bytes is assigned to the q-grams in it whose hash is smallest, its anchors. Equal
   windows have the same anchors at the same places, so windows can only be equal below equal anchors, and
   one position in about eighteen stands for all. Documents are dealt into parts; each part sends its
   distinct anchor hashes, eight bytes each, to hash buckets, which answer with a bit: found in another part.
2. For such anchors, parts send the text around them that their windows span, each distinct text once with
   its smallest document. In its bucket, the suffixes that start there are refined: buckets of 8-grams are sorted
   on pairs of bucket identifiers, the own and that of a later offset, giving buckets of 16, 32 and LENGTH bytes
   (bucket-pointer refinement; each round uses the last one's identifiers). A bucket of LENGTH bytes
   holds equal windows; it answers with a bit for each: a smaller document has it.
3. Parts mark the bytes that such windows cover.

The texts are shuffled once; all three steps read the same exchange. No step compares pairs, and a string that
all documents share is sent once by each part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 50
GRAM = 16
#: Gram positions in a window.
SPAN = LENGTH - GRAM + 1
#: Bytes of text in a part, of text that is scanned at once, and of contexts that are refined at once.
PART = 2 << 20
SCAN = 1 << 17
REFINED = 1 << 20
#: Expected anchors in a bucket, and bytes for one anchor.
BUCKET = 1 << 17
DENSITY = 18
#: Parts or buckets in a task, so that tasks grow in number with the input and not in size.
TOGETHER = 4
_WIDE = LENGTH + SPAN - 1
_MAX = (1 << 63) - 1


def _slide(x: np.ndarray, pick) -> np.ndarray:
    """pick over windows of SPAN values."""
    width = 1
    while 2 * width <= SPAN:
        x, width = pick(x[:-width], x[width:]), 2 * width
    return pick(x[: len(x) - (SPAN - width)], x[SPAN - width :]) if width < SPAN else x


def _hashes(data: np.ndarray) -> np.ndarray:
    eight = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view("<u8")[:, 0]
    x = eight[:-8] * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x += eight[8:]
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x | np.uint64(1)


def _scan(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of documents lying one after another: positions, hashes, and the smallest hash of each window (0 if
    the window leaves its document)."""
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = _hashes(data)
    least = _slide(h, np.minimum)
    edges = np.zeros(len(data) + 1, np.int32)
    starts = np.concatenate(([0], ends[:-1]))
    np.add.at(edges, np.maximum(starts, ends - LENGTH + 1), 1)
    np.add.at(edges, ends, -1)
    least[np.cumsum(edges[: len(least)]) > 0] = 0
    most = _slide(np.concatenate((np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64))), np.maximum)
    at = np.flatnonzero(most == h)
    return at, h[at], least


class _Part:
    """The documents of a part, by id and key, scanned in chunks."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["oid", "row_key"], kind="stable")
        self.oid = rows["oid"].to_numpy(np.int64)
        self.row_key = rows["row_key"].to_numpy(np.int64)
        self.known = rows["known"].to_numpy(bool)
        self.texts = [bytes(x) for x in rows["data"]]
        self.chunks = []  # first document, data, ends, and what _scan gives
        i, found = 0, []
        while i < len(self.texts):
            j, size = i, 0
            while j < len(self.texts) and (j == i or size + len(self.texts[j]) <= SCAN):
                size += len(self.texts[j])
                j += 1
            data = np.frombuffer(b"".join(self.texts[i:j]), np.uint8)
            ends = np.cumsum([len(x) for x in self.texts[i:j]])
            at, h, least = _scan(data, ends)
            doc = i + np.searchsorted(ends, at, "right")
            self.chunks.append((i, data, ends, at, h, least, doc))
            found.append(h)
            i = j
        every = np.concatenate(found) if found else np.empty(0, np.uint64)
        self.hashes, self.place = np.unique(every, return_inverse=True)

    def local(self) -> np.ndarray:
        """Which of the distinct hashes stand in several documents of the part."""
        doc = np.concatenate([c[6] for c in self.chunks]) if self.chunks else np.empty(0, np.int64)
        low, high = np.full(len(self.hashes), _MAX), np.full(len(self.hashes), -1)
        np.minimum.at(low, self.place, doc)
        np.maximum.at(high, self.place, doc)
        return high > low

    def contexts(self, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """Anchors whose hash is marked: document, position of the first window, contexts (padded bytes, then anchor's
        place and number of windows)."""
        docs, starts, rows, first = [], [], [], 0
        for _i, data, _ends, at, h, least, doc in self.chunks:
            mark = shared[self.place[first : first + len(at)]]
            first += len(at)
            at, h, doc = at[mark], h[mark], doc[mark]
            if not len(at):
                continue
            padded = np.concatenate((np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN, np.uint64)))
            lead, n = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for back in range(SPAN):  # windows that start `back` bytes before the anchor
                own = padded[at - back + SPAN - 1] == h
                lead[own] = back
                n += own
            wide = np.concatenate((data, np.zeros(_WIDE, np.uint8)))
            row = np.empty((len(at), _WIDE + 2), np.uint8)
            row[:, :_WIDE] = np.lib.stride_tricks.sliding_window_view(wide, _WIDE)[at - lead]
            row[:, :_WIDE][np.arange(_WIDE) >= (n + LENGTH - 1)[:, None]] = 0
            row[:, _WIDE], row[:, _WIDE + 1] = lead, n
            docs.append(doc)
            starts.append(at - lead)
            rows.append(row)
        if not docs:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, _WIDE + 2), np.uint8)
        return np.concatenate(docs), np.concatenate(starts), np.concatenate(rows)


def _void(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"V{rows.shape[1]}")[:, 0]


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of distinct rows, and for each row the number of its distinct one."""
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pad = -rows.shape[1] % 8
    wide = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8")
    order = np.lexsort(wide.T[::-1])
    new = np.concatenate(([True], (wide[order[1:]] != wide[order[:-1]]).any(axis=1)))
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _deal(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(11)) % np.uint64(buckets)).astype(np.int64)


def _anchor_hash(rows: np.ndarray) -> np.ndarray:
    at = rows[:, _WIDE].astype(np.int64)[:, None] + np.arange(GRAM)
    grams = np.take_along_axis(rows, at, axis=1)
    return _hashes(np.pad(grams, ((0, 0), (0, 0))).reshape(-1))[::GRAM] if len(rows) else np.empty(0, np.uint64)


def _announce(buckets: int):
    """Step 1: each distinct anchor hash of a part, to its bucket."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        h = _Part(rows).hashes
        to = _deal(h, buckets)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order])) + 1
        out = [(int(to[x[0]]), part, h[x].tobytes()) for x in np.split(order, cuts) if len(x)]
        return pd.DataFrame(out, columns=["bucket", "part", "data"])

    return run


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Step 1, in a bucket: which hashes came from several parts."""
    sent = [np.frombuffer(x, np.uint64) for x in rows["data"]]
    _, place, n = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    several, out, at = n[place] > 1, [], 0
    for x in sent:
        out.append(np.packbits(several[at : at + len(x)]).tobytes())
        at += len(x)
    return pd.DataFrame({"part": rows["part"], "bucket": rows["bucket"], "data": out})


def _shared(part: _Part, buckets: int, answers: list[tuple[int, bytes]]) -> np.ndarray:
    """The bits of step 1 for a part's distinct hashes, with those that its own documents share."""
    to = _deal(part.hashes, buckets)
    order = np.argsort(to, kind="stable")
    out = part.local()
    first = np.searchsorted(to[order], np.arange(buckets + 1)) if answers else []
    for bucket, bits in answers:
        own = order[first[bucket] : first[bucket + 1]]
        out[own] |= np.unpackbits(np.frombuffer(bits, np.uint8))[: len(own)].astype(bool)
    return out


def _send(buckets: int):
    """Step 2: the distinct contexts of shared anchors with the smallest document of each, to the anchors' buckets."""

    def run(key, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own = _Part(rows)
        shared = _shared(own, buckets, list(zip(answers["bucket"].tolist(), answers["data"], strict=True)))
        part = int(key[-1])
        out = [(part % buckets, part, 0, np.packbits(shared).tobytes())]
        doc, _, contexts = own.contexts(shared)
        first, number = _distinct(contexts)
        least = np.full(len(first), _MAX)
        np.minimum.at(least, number, own.oid[doc])
        distinct = contexts[first]
        for bucket, x in _by_bucket(distinct, buckets):
            lengths = distinct[x, _WIDE + 1].astype(np.int64) + LENGTH - 1
            body = distinct[x, :_WIDE][np.arange(_WIDE) < lengths[:, None]]
            out.append((bucket, part, len(x), least[x].tobytes() + distinct[x, _WIDE:].tobytes() + body.tobytes()))
        return pd.DataFrame(out, columns=["bucket", "part", "n", "data"])

    return run


def _by_bucket(distinct: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    to = _deal(_anchor_hash(distinct), buckets)
    order = np.argsort(to, kind="stable")
    return [(int(to[x[0]]), x) for x in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(x)]


def _unpack(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    least = np.frombuffer(data, np.int64, n)
    tail = np.frombuffer(data, np.uint8, 2 * n, 8 * n).reshape(n, 2)
    lengths = tail[:, 1].astype(np.int64) + LENGTH - 1
    rows = np.zeros((n, _WIDE + 2), np.uint8)
    rows[:, :_WIDE][np.arange(_WIDE) < lengths[:, None]] = np.frombuffer(data, np.uint8, int(lengths.sum()), 10 * n)
    rows[:, _WIDE:] = tail
    return least, rows


def buckets_of(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket identifiers of the strings of `length` bytes at starts, equal where the strings are.

    8-grams first; then each bucket is refined by the identifiers at later offsets of the same round.
    """
    need, sizes = [starts], [length]
    while sizes[-1] > 8:
        sizes.append(max(8, 1 << (sizes[-1] - 1).bit_length() - 1))
        need.append(np.unique(np.concatenate((need[-1], need[-1] + (sizes[-2] - sizes[-1])))))
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)[need[-1]].copy().view("<u8")[:, 0]
    ids = np.unique(eight, return_inverse=True)[1]
    for k in range(len(sizes) - 2, -1, -1):
        shift = sizes[k] - sizes[k + 1]
        here, later = (np.searchsorted(need[k + 1], need[k] + x) for x in (0, shift))
        ids = np.unique(ids[here].astype(np.int64) << 32 | ids[later], return_inverse=True)[1]
    return ids


def _least_by_window(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For distinct contexts, a matrix: the smallest document with the window's bytes."""
    out = np.repeat(least[:, None], SPAN, axis=1)
    gram = _anchor_hash(rows)
    _, place, n = np.unique(gram, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(n[place] > 1)
    mixed = mixed[np.argsort(place[mixed], kind="stable")]
    firsts = np.flatnonzero(np.concatenate(([True], np.diff(place[mixed]) > 0))) if len(mixed) else np.empty(0, np.int64)
    cut, begin = [], 0
    for x in firsts.tolist()[1:]:
        if (x - begin) * _WIDE >= REFINED:
            cut.append(x)
            begin = x
    for some in np.split(mixed, cut) if len(mixed) else []:
        windows = rows[some, _WIDE + 1].astype(np.int64)
        data = rows[some, :_WIDE].reshape(-1)
        row = np.repeat(np.arange(len(some)), windows)
        window = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        ids = buckets_of(data, row * _WIDE + window)
        best = np.full(int(ids.max()) + 1, _MAX)
        np.minimum.at(best, ids, least[some][row])
        out[some[row], window] = best[ids]
    return out


def _refine(rows: pd.DataFrame) -> pd.DataFrame:
    """Step 2, in a bucket: for each context sent, a bit for each window that a smaller document has."""
    passed = rows[rows["n"] == 0]
    sent = rows[rows["n"] > 0]
    out = [(p, -1, d) for p, d in zip(passed["part"], passed["data"], strict=True)]
    if len(sent):
        parts = [_unpack(n, d) for n, d in zip(sent["n"], sent["data"], strict=True)]
        own = np.concatenate([x for x, _ in parts])
        every = np.concatenate([x for _, x in parts])
        first, number = _distinct(every)
        least = np.full(len(first), _MAX)
        np.minimum.at(least, number, own)
        windows = every[:, _WIDE + 1].astype(np.int64)
        smaller = (_least_by_window(every[first], least)[number] < own[:, None])[np.arange(SPAN) < windows[:, None]]
        ends = np.concatenate(([0], np.cumsum(windows)))
        at = 0
        for part, bucket, n in zip(sent["part"], sent["bucket"], sent["n"], strict=True):
            out.append((part, bucket, np.packbits(smaller[ends[at] : ends[at + n]]).tobytes()))
            at += n
    return pd.DataFrame(out, columns=["part", "bucket", "data"])


def _mark(buckets: int, with_text: bool):
    """Step 3: marks what is removed, and reads off the result."""

    def run(key, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own = _Part(rows)
        gone = [np.zeros(len(x) + 1, np.int32) for x in own.texts]
        bits = {b: np.unpackbits(np.frombuffer(d, np.uint8)).astype(bool) for b, d in zip(answers["bucket"].tolist(), answers["data"], strict=True)}
        if -1 in bits:
            doc, start, contexts = own.contexts(bits[-1][: len(own.hashes)])
            first, number = _distinct(contexts)
            distinct = contexts[first]
            least = np.full(len(first), _MAX)
            np.minimum.at(least, number, own.oid[doc])
            removed = np.zeros((len(first), SPAN), bool)
            for bucket, x in _by_bucket(distinct, buckets):
                mask = np.arange(SPAN) < distinct[x, _WIDE + 1][:, None]
                block = np.zeros((len(x), SPAN), bool)
                block[mask] = bits[bucket][: int(mask.sum())]
                removed[x] = block
            hit = removed[number] | (own.oid[doc] > least[number])[:, None]
            hit &= np.arange(SPAN) < contexts[:, _WIDE + 1].astype(np.int64)[:, None]
            base = np.concatenate([np.concatenate(([0], c[2][:-1])) for c in own.chunks])
            which, window = np.nonzero(hit)
            at = start[which] + window - base[doc[which]]
            order = np.argsort(doc[which], kind="stable")
            ds, at = doc[which][order], at[order]
            for x in np.split(np.arange(len(ds)), np.flatnonzero(np.diff(ds)) + 1):
                if len(x):
                    mark = gone[ds[x[0]]]
                    places = np.unique(at[x])
                    mark[places] += 1
                    np.add.at(mark, places + LENGTH, -1)
        out = []
        for i, text in enumerate(own.texts):
            drop = np.cumsum(gone[i][: len(text)]) > 0
            n = int(drop.sum())
            spans = int(np.count_nonzero(np.diff(np.concatenate(([0], drop.view(np.int8)))) == 1)) if n else 0
            kept = np.frombuffer(text, np.uint8)[~drop].tobytes() if n else text
            row = (own.oid[i], own.row_key[i], own.known[i], len(text), n, spans, hashlib.sha256(kept).hexdigest())
            out.append((*row, kept) if with_text else row)
        return pd.DataFrame(out, columns=["oid", "row_key", "known", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    return run


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """A row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with `with_text` the bytes kept.

    Strings are judged on the input as it is. Matches never cross documents; texts of less than LENGTH bytes lose
    nothing; null texts are empty. A null id counts as larger than any other. Rows with the same id take nothing from
    each other, so repeated rows stay alike. An empty table gives an empty result. Extra columns aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.select(F.sum(F.octet_length(text).cast("long")).alias("n")).first()["n"] or 0
    parts, buckets = max(1, -(-total // PART)), max(1, -(-total // (DENSITY * BUCKET)))
    key = F.xxhash64(F.col(id_col), text)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_MAX)).alias("oid"), key.alias("row_key"), F.col(id_col).isNotNull().alias("known"), F.pmod(key, F.lit(parts)).alias("part"), text.cast("binary").alias("data")
    )
    cores = docs.sparkSession.sparkContext.defaultParallelism

    def dealt(df: DataFrame, by: str, n: int) -> DataFrame:
        """Parts or buckets dealt to tasks in turn, the same number to each."""
        tasks = max(-(-n // TOGETHER), min(n, 3 * cores))
        return df.withColumn("task", F.pmod(F.col(by), F.lit(tasks)).cast("int")).repartitionById(tasks, "task")

    rows = dealt(rows, "part", parts)
    own = rows.groupBy("task", "part")
    answers = dealt(own.applyInPandas(_announce(buckets), "bucket long, part long, data binary"), "bucket", buckets)
    answers = answers.groupBy("task", "bucket").applyInPandas(_answer, "part long, bucket long, data binary")
    answers = dealt(answers, "part", parts).groupBy("task", "part")
    contexts = own.cogroup(answers).applyInPandas(_send(buckets), "bucket long, part long, n long, data binary")
    refined = dealt(contexts, "bucket", buckets).groupBy("task", "bucket").applyInPandas(_refine, "part long, bucket long, data binary")
    refined = dealt(refined, "part", parts).groupBy("task", "part")
    more = ", kept binary" if with_text else ""
    found = own.cogroup(refined).applyInPandas(
        _mark(buckets, with_text), f"oid long, row_key long, known boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}"
    )
    return found.select(F.when(F.col("known"), F.col("oid")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text)
