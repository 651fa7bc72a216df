"""Exact token counts at every prefix, by dynamic programming over the parts that a merge can't cross.

In a SentencePiece BPE vocabulary whose pieces hold the space sign only at their front, no merge crosses
from a word into the space before the next one, and none touches a line break that isn't in any piece. So the
count of a prefix that ends with a part is that of the prefix before it plus the part's own, and parts, which
repeat, are encoded once and remembered. Inside a part, the counts of its own prefixes come from a second
table over characters: a prefix's last token is the one token that follows a shorter prefix's last token
in a way that the encoder itself would choose.

A vocabulary that lacks this property is noticed, and whole texts are then encoded.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
LIMIT = 4096
#: Remembered parts of a worker process; when full, all are forgotten.
REMEMBERED = 400_000
_PART = re.compile(r" +[^ \n]*|\n[^ \n]*")


class Counter:
    """Counts tokens of texts as the library does, without begin, end or added tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
        plain = self.sp.encode(" a  b ", out_type=str)
        self.splits = not inner and not any("\n" in p for p in pieces) and "".join(plain) == f"{SPACE * 2}a{SPACE * 2}b{SPACE}"
        self.known: dict[str, int] = {" ": 1}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.within: dict[str, list[int]] = {}

    def parts(self, text: str) -> list[str]:
        """The text, with the sign before its first word that the library adds, cut where no merge can reach."""
        return _PART.findall(" " + text.replace(SPACE, " ")) if text else []

    def learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {" ": 1}
            new = [p for p in parts if p != " "]
        # A part that starts with a space loses it to the sign that the library adds; after a line break, that sign is a token of its own.
        codes = self.sp.encode([p[1:] if p[0] == " " else p for p in new], num_threads=1)
        self.known.update((p, len(c) - (p[0] == "\n")) for p, c in zip(new, codes, strict=True))

    def tables(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Of each text the exact counts of the prefixes that end with a part, in order; the last is that of the whole text."""
        if not self.splits:
            yield from (np.array([len(c)]) for c in self.sp.encode(texts, num_threads=1))
            return
        cut = [self.parts(t) for t in texts]
        i = 0
        while i < len(cut):  # as many texts as keep the new parts within what is remembered
            j, some = i, set()
            while j < len(cut) and (j == i or len(some) < REMEMBERED // 4):
                some.update(cut[j])
                j += 1
            self.learn(some)
            known = self.known
            yield from (np.cumsum(np.fromiter(map(known.__getitem__, c), np.int64, len(c))) for c in cut[i:j])
            i = j

    def totals(self, texts: list[str]) -> list[int]:
        return [int(t[-1]) if len(t) else 0 for t in self.tables(texts)]

    def prefixes(self, text: str) -> tuple[list[int], list[int]]:
        """Ends of prefixes (characters) that end with a part, and their exact counts; the last is the whole text."""
        if not self.splits:
            return [len(text)], [len(self.sp.encode(text))]
        parts = self.parts(text)
        self.learn(set(parts))
        ends, counts, at, n = [], [], -1, 0
        for p in parts:
            at, n = at + len(p), n + self.known[p]
            ends.append(at)
            counts.append(n)
        return ends, counts

    def every(self, text: str) -> list[int]:
        """Exact counts of all prefixes (of 1, 2, ... characters). A vocabulary without the property costs an encoding for each."""
        if not self.splits:
            return [len(c) for c in self.sp.encode([text[:i] for i in range(1, len(text) + 1)], num_threads=1)]
        counts, n = [], 0
        parts = self.parts(text)
        self.learn(set(parts))
        for p in parts:
            if p not in self.within:
                if len(self.within) >= REMEMBERED // 8:
                    self.within = {}
                self.within[p] = self.inside(p)
            counts += [n + c for c in self.within[p]]
            n += self.known[p]
        return counts[1:]  # the first is that of the sign which the library adds

    def _follows(self, last: int, token: int) -> bool:
        """Whether the encoder cuts the two tokens' joint text into just these."""
        key = (last, token)
        if key not in self.pairs:
            text = self.sp.id_to_piece(last) + self.sp.id_to_piece(token)
            self.pairs[key] = self._codes(text) == [last, token]
        return self.pairs[key]

    def _codes(self, surface: str) -> list[int]:
        """Codes of a text given with space signs, without the sign that the library adds."""
        if surface.startswith(SPACE):
            return self.sp.encode(surface[1:].replace(SPACE, " ")) if surface != SPACE else [self.sp.piece_to_id(SPACE)]
        return self.sp.encode("\n" + surface.replace(SPACE, " "))[2:]

    def inside(self, part: str) -> list[int]:
        """Exact counts of all prefixes of a part (of 1, 2, ... characters), by their last tokens."""
        surface = part.replace(" ", SPACE)
        count, last = [0], [None]
        longest = 16
        for end in range(1, len(surface) + 1):
            found = None
            for start in range(max(0, end - longest), end):
                token = self.sp.piece_to_id(surface[start:end])
                if token == self.sp.unk_id() or last[start] is False:
                    continue
                if start == 0 and self._codes(surface[:end]) == [token] or start and last[start] is not None and self._follows(last[start], token):
                    found = (count[start] + 1, token)
                    break
            if found is None:  # characters outside the vocabulary give several byte tokens
                found = (len(self._codes(surface[:end])), False)
            count.append(found[0])
            last.append(found[1])
        return count[1:]

    def cut(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens that ends with a part or inside the next one."""
        ends, counts = self.prefixes(text)
        k = next((i for i, n in enumerate(counts) if n > budget), None)
        if k is None:
            return len(text)
        before, start = (counts[k - 1], ends[k - 1]) if k else (0, 0)
        part = self.parts(text)[k] if self.splits else None
        if part is None:
            return 0
        own = self.inside(part)
        fit = max((i + 1 for i, n in enumerate(own) if before + n <= budget), default=0)
        return start + fit - (0 if k else 1) if fit else start


def counter(path: str) -> Counter:
    """One for each worker process and vocabulary."""
    kept = sys.modules.setdefault("_lectern_counters", type(sys)("_lectern_counters")).__dict__
    if path not in kept:
        kept[path] = Counter(path)
    return kept[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row, both read off the text's table of prefix counts.

    Null texts are empty and have no tokens; texts are whole, however long. Ids may repeat or be null. `path` is the
    vocabulary's file, which every executor has. Extra columns aren't read.
    """

    def run(texts: pd.Series) -> pd.DataFrame:
        found = [(int(t[-1]) if len(t) else 0, int(np.searchsorted(t, limit, "right")) < len(t)) for t in counter(path).tables([x or "" for x in texts])]
        return pd.DataFrame(found, columns=["n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.pandas_udf(run, "n_tokens long, over_limit boolean")(text).alias("t")
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), found).select("doc_id", "n_bytes", "t.n_tokens", "t.over_limit")


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts: the stored table of each text. The tokens of its first i characters are counts[i - 1],
    so truncation and budgets are answered by a search in it. A null or empty text has an empty table; null ids stay; an empty table of documents gives no rows."""
    found = F.pandas_udf(lambda texts: pd.Series([counter(path).every(x or "") for x in texts]), "array<int>")
    return docs.select(F.col(id_col).alias("doc_id"), found(F.col(text_col)).alias("counts"))


def fitting(table: DataFrame, budget: int) -> DataFrame:
    """Rows of prefix_counts -> doc_id, fits, cut, tokens: whether the text fits, and the longest prefix that does. A longer prefix
    may have fewer tokens, so the last that fits is looked for. Of an empty text nothing is cut: cut and tokens are 0."""
    cut = F.coalesce(F.array_max(F.transform("counts", lambda c, i: F.when(c <= budget, i + 1))), F.lit(0))
    rows = table.withColumn("cut", cut)
    return rows.select("doc_id", (F.col("cut") == F.size("counts")).alias("fits"), "cut", F.when(F.col("cut") > 0, F.get("counts", F.col("cut") - 1)).otherwise(0).alias("tokens"))
