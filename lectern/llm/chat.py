"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a template.

A conversation's rows meet in one partition, sorted, and are streamed: the machine keeps its state between
rows, so a conversation of any length takes the memory of one turn. Each turn gives three segments (opening,
text, closing); the flag says which are trained on. Control strings inside texts are broken up by an escape
sign, so that the output can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import partitions

ESCAPE = "\\"


@dataclass(frozen=True)
class Part:
    """How a role is written, and whether its text is trained on."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles, the form of any other role ({role} is its name), control strings and allowed turns.

    `after` maps a state (the role before, None at the start) to the roles that may follow; `final` are the
    states that a conversation may end in.
    """

    parts: dict[str, Part]
    other: Part
    controls: tuple[str, ...]
    after: dict[str | None, tuple[str, ...]]
    final: tuple[str | None, ...]

    def escape(self, text: str) -> str:
        found = "|".join(map(re.escape, (ESCAPE, *sorted(self.controls, key=len, reverse=True))))
        return re.sub(found, lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str) -> tuple[str, str, str, bool]:
        part = self.parts.get(role)
        if part is None:
            name = self.escape(role).replace("\n", ESCAPE + "\n")
            return self.other.opening.format(role=name), self.escape(text), self.other.closing, self.other.loss
        return part.opening, self.escape(text), part.closing, part.loss

    def parse(self, turn: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        for role, part in self.parts.items():
            if turn.startswith(part.opening) and turn.endswith(part.closing) and len(turn) >= len(part.opening) + len(part.closing):
                return role, self.unescape(turn[len(part.opening) : len(turn) - len(part.closing)])
        before, _, after = self.other.opening.partition("{role}")
        m = re.compile(re.escape(before) + r"((?:[^\\\n]|\\.)*)" + re.escape(after) + "(.*)" + re.escape(self.other.closing), re.S).fullmatch(turn)
        if not m:
            raise ValueError(f"not a turn: {turn[:80]!r}")
        return self.unescape(m[1]), self.unescape(m[2])


INSTRUCT = Template(
    parts={
        "system": Part("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Part("[INST] ", " [/INST]"),
        "assistant": Part(" ", " </s>", loss=True),
    },
    other=Part("<s>{role}\n", "</s>"),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"),
    after={None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
)

_SEGMENTS = "conv_id string, turn_no long, segment int, text string, loss boolean, allowed boolean"


def format_chats(chats: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, turn, role, text -> a row per segment: conv_id, turn_no (from 0), segment (0 to 2), text, loss, allowed.

    Turns are ordered by turn, then role and text. Null texts and roles are empty; null turns come first;
    rows without a conv_id are one conversation; repeated rows are turns of their own. `allowed` tells whether
    the machine allows the turn where it stands; nothing is dropped. Segments of a conversation stay in order
    within a partition. Extra columns aren't read.
    """
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, n = object(), None, 0
        for batch in batches:
            out = []
            for conv, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
                if conv != now:
                    now, state, n = conv, None, 0
                allowed = role in template.after.get(state, ())
                opening, body, closing, loss = template.segments(role, text)
                out += [(conv, n, 0, opening, False, allowed), (conv, n, 1, body, loss, allowed), (conv, n, 2, closing, False, allowed)]
                state, n = role, n + 1
            yield pd.DataFrame(out, columns=["conv_id", "turn_no", "segment", "text", "loss", "allowed"])

    dealt = rows.repartition(partitions(chats.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select(F.col("conv_id").cast("string"), "role", "text").mapInPandas(run, _SEGMENTS)


def digest_chats(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Reads the segments back, in the order they come: a row per conversation with its turns and the loss text,
    counted and hashed, and whether the machine accepts it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = lambda: {"n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0, "valid": True, "last": None}
        now, kept, turn, started = None, empty(), "", False

        def done():
            ended = kept["valid"] and kept["last"] in template.final
            return (now, kept["n"], kept["turns"].hexdigest(), kept["loss_n"], kept["loss"].hexdigest(), kept["chars"], ended)

        def frame(rows):
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
            return pd.DataFrame(rows, columns=names)

        for batch in batches:
            out = []
            for conv, k, text, loss, allowed in zip(batch["conv_id"], batch["segment"], batch["text"], batch["loss"], batch["allowed"], strict=True):
                if not started or conv != now:
                    if started:
                        out.append(done())
                    now, kept, turn, started = conv, empty(), "", True
                kept["chars"] += len(text)
                kept["valid"] &= bool(allowed)
                turn += text
                if loss:
                    own = template.unescape(text)
                    kept["loss_n"] += len(own)
                    kept["loss"].update(own.encode("utf-8", "replace"))
                if k == 2:
                    role, own = template.parse(turn)
                    kept["turns"].update(f"{role}\n{own}\n".encode("utf-8", "replace"))
                    kept["n"], kept["last"], turn = kept["n"] + 1, role, ""
            if out:
                yield frame(out)
        if started:
            yield frame([done()])

    found = segments.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
    return found.withColumn("conv_id", F.col("conv_id").cast("long"))
