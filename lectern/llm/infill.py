"""Fill-in-middle transformation by a numpy kernel over the UTF-8 buffers of whole Arrow batches.

A text is cut at two places into prefix, middle and suffix, which are written in another order between marks.
The kernel never makes a string of a single text to find its cuts: a table gives each byte its class, a pair of
neighbouring classes tells whether a unit begins between them, a running sum counts the units, less what had
been counted where the document began, and one binary search over that sum finds the cuts of all rows together.
What is drawn for a document depends on its id and the seed alone, so that runs repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that the kernel takes at once; a longer text is taken alone.
AT_ONCE = 4 << 20

# Classes of bytes: 0 goes on with a character, 1 begins one, 2 is white space, 3 is a line's end.
CLASSES = np.ones(256, np.uint8)
CLASSES[0x80:0xC0] = 0
CLASSES[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 2
CLASSES[0x0A] = 3


def _pairs(begins) -> np.ndarray:
    """begins(class before, class) for all pairs of classes, at 4 * before + own."""
    return np.array([begins(before, own) for before in range(4) for own in range(4)])


#: Whether a unit begins between two bytes of these classes. Words take the white space that follows them, lines their end.
UNITS = {
    "char": _pairs(lambda before, own: own != 0),
    "word": _pairs(lambda before, own: own < 2 <= before),
    "line": _pairs(lambda before, own: before == 3),
}


@dataclass(frozen=True)
class Infill:
    """How texts are rewritten: the unit that cuts fall between, marks, and shares in hundredths of plain texts and, of the others, of suffix first."""

    seed: int = 1
    unit: str = "char"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain: int = 10
    suffix_first: int = 20

    def __post_init__(self) -> None:
        """Marks can't arise where pieces meet if they begin with a sign that none of them has elsewhere."""
        if len({*self.marks}) < 3 or any(not m or m[:1] != self.marks[0][:1] or m[0] in m[1:] for m in self.marks):
            raise ValueError("marks must be different, begin with the same sign and not hold it elsewhere")

    @property
    def marks(self) -> list[bytes]:
        return [m.encode() for m in (self.prefix, self.suffix, self.middle)]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (nulls are empty) and where each begins; the last entry is the end."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return body, at - at[0]


def counted(body: np.ndarray, at: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """For each byte how many units began up to it, counting on over all texts, and how many had before each text. A text's first byte begins one."""
    own = CLASSES[body]
    codes = own.copy()
    codes[1:] += 4 * own[:-1]
    begins = UNITS[unit][codes]
    begins[at[:-1][at[:-1] < at[1:]]] = True
    total = np.cumsum(begins, dtype=np.int64)
    return total, np.concatenate(([0], total))[at]


def cuts(total: np.ndarray, before: np.ndarray, at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Byte offsets in the buffer of each text's cut after `places` units, for all texts at once."""
    return np.minimum(np.searchsorted(total, before[:-1] + places + 1), at[1:])


def found(body: np.ndarray, at: np.ndarray, mark: bytes) -> np.ndarray:
    """Where `mark` stands in the buffer, and not across two texts."""
    n = len(body) - len(mark) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    places = np.flatnonzero(body[:n] == mark[0])
    for i, b in enumerate(mark[1:], 1):
        places = places[body[places + i] == b]
    return places[places + len(mark) <= at[1:][np.searchsorted(at, places, "right") - 1]]


def _having(body: np.ndarray, at: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Which texts hold any of the marks."""
    held = np.zeros(len(at) - 1, bool)
    for mark in marks:
        held[np.searchsorted(at, found(body, at, mark), "right") - 1] = True
    return held


def _gathered(pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> pa.Array:
    """n texts, each put together from pieces in order: (buffer, from, to) of every text."""
    sizes = np.stack([to - start for _, start, to in pieces], 1)
    ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, (body, start, to) in enumerate(pieces):
        size = to - start
        there = np.repeat(ends[:, k] - size, size) + _within(size)
        out[there] = body[np.repeat(start, size) + _within(size)]
    offsets = np.concatenate(([0], ends[:, -1] if n else [])).astype(np.int64)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most AT_ONCE bytes of `column`, one row at least; nothing is copied."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            least = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, least + AT_ONCE, "right")))
            yield batch.slice(start, end - start)
            start = end


def fill_in_middle(docs: DataFrame, how: Infill = Infill(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_units, middle_units (null if plain), output: each text rewritten.

    The text is plain, and stays as it is, if it is empty, if it holds a mark, or by draw. Null texts are empty; null ids stay and draw as an
    empty id; repeated rows give equal rows; an empty table gives an empty result. Extra columns aren't read. A text of any length is taken whole."""
    key = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), key.alias("h")).select("doc_id", "text", *drawn)
    marks = how.marks
    tables = [np.frombuffer(m, np.uint8) for m in marks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "text"):
            body, at = buffers(batch.column("text"))
            total, before = counted(body, at, how.unit)
            n, size = np.diff(before), batch.num_rows
            h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4))
            first, second = h1 % (n + 1), h2 % (n + 1)
            low, high = np.minimum(first, second), np.maximum(first, second)
            plain = (n == 0) | _having(body, at, marks) | (h3 % 100 >= 100 - how.plain)
            turned = ~plain & (h4 % 100 < how.suffix_first)
            start, end = at[:-1], at[1:]
            a, b = cuts(total, before, at, low), cuts(total, before, at, high)
            straight, changed, none = ~plain & ~turned, ~plain, np.zeros(size, np.int64)
            piece = lambda which, source, x, y: (source, x, np.where(which, y, x))
            mark = lambda i, which: piece(which, tables[i], none, none + len(tables[i]))
            prefix = lambda which: piece(which, body, start, a)
            pieces = [piece(plain, body, start, end), mark(0, straight), prefix(straight), mark(1, changed), piece(changed, body, b, end)]
            pieces += [mark(0, turned), prefix(turned), mark(2, changed), piece(changed, body, a, b)]
            form = np.where(plain, "plain", np.where(turned, "spm", "psm"))
            out = _gathered(pieces, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(form, pa.string()), pa.array(low, pa.int64(), mask=plain), pa.array(high - low, pa.int64(), mask=plain), out.cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_units", "middle_units", "output"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_units long, middle_units long, output string")


def restored(made: DataFrame, how: Infill = Infill(), output: str = "output", form: str = "form") -> DataFrame:
    """The rows with `restored`, the text as it was, read from `output` and `form` alone: marks are looked for in the buffer, and as no text that
    is rewritten holds one, each stands there once. Null outputs are empty."""
    marks = how.marks
    kept = [f for f in made.schema.fields if f.name != "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, output):
            body, at = buffers(batch.column(output))
            kind = np.array(batch.column(form).to_pylist(), dtype=object)
            plain, turned = (kind != "psm") & (kind != "spm"), kind == "spm"
            start, end = at[:-1], at[1:]
            place = []
            for mark in marks:
                where = found(body, at, mark)
                own = start.copy()
                of = np.searchsorted(at, where, "right") - 1
                own[of[::-1]] = where[::-1]
                place.append(np.where(plain, start, own))
            p, s, m = place
            lp, ls, lm = (len(x) for x in marks)
            prefix = (body, p + np.where(plain, 0, lp), np.where(plain, start, np.where(turned, m, s)))
            suffix = (body, s + np.where(plain, 0, ls), np.where(plain, start, np.where(turned, p, m)))
            middle = (body, m + np.where(plain, 0, lm), end)
            text = _gathered([prefix, middle, suffix], batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), text.cast(pa.string())], names=[*(f.name for f in kept), "restored"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return made.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, f"{types}, restored string")
