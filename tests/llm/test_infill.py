"""Every text is cut and put together as a plain version does it, and is read back."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import infill

TEXTS = st.lists(st.text(st.sampled_from(list("ab \n\t<PSM>é€𝄞 ")), max_size=12), max_size=9)


def units(text, unit):
    """The units of a text, sign by sign."""
    out, white = [], " \t\v\f\r\n"
    for i, c in enumerate(text):
        new = {"char": True, "word": c not in white and i and text[i - 1] in white, "line": i and text[i - 1] == "\n"}[unit]
        if new or not out:
            out.append("")
        out[-1] += c
    return out


def plain_version(doc_id, text, unit="char", seed=1):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    text = text or ""
    parts = units(text, unit)
    n = len(parts)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from(["char", "word", "line"]), st.integers(0, 3))
def test_units_and_cuts(texts, unit, skip):
    array = pa.array(texts + [None], pa.string())[min(skip, len(texts)) :]
    body, at = infill.buffers(array)
    total, before = infill.counted(body, at, unit)
    own = [units(t or "", unit) for t in array.to_pylist()]
    assert np.diff(before).tolist() == [len(u) for u in own]
    for k in (0, 1, 2):
        places = np.array([min(k, len(u)) for u in own])
        there = infill.cuts(total, before, at, places)
        assert [bytes(body[x:y]).decode() for x, y in zip(at, there, strict=False)] == ["".join(u[:p]) for u, p in zip(own, places, strict=True)]
    for mark in (b"<P>", b"<S>"):
        of = np.searchsorted(at, infill.found(body, at, mark), "right") - 1
        assert np.bincount(of, minlength=len(own)).tolist() == [(t or "").count(mark.decode()) for t in array.to_pylist()]


ODD = [(1, ""), (2, None), (3, "a"), (3, "a"), (None, "no id €"), (None, "no id €"), (5, "has <P> inside"), (6, "<S>"), (7, "x<M>y"), (8, "퟿\U0010ffff é"), (-9, "<P"), (10, "a b\tc\n d" * 50), (11, ("𝄞é" * 999 + "\n x") * 700)]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_rewriting(spark, unit):
    rows = ODD + [(i, "päx <S y\n" * (i % 7) + "z" * (i % 3)) for i in range(100, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("h"), F.lit("x").alias("h1"), F.lit(0).alias("restored"), F.lit(0).alias("output")).repartition(3)
    how = infill.Infill(unit=unit)
    made = infill.restored(infill.fill_in_middle(docs, how), how).collect()
    assert sorted((tuple(r)[:6] for r in made), key=repr) == sorted((plain_version(i, t, unit) for i, t in rows), key=repr)
    assert sorted((r.doc_id, r.restored) for r in made if r.doc_id is not None) == sorted((i, t or "") for i, t in rows if i is not None)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_empty_table_and_marks(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert infill.restored(infill.fill_in_middle(docs)).collect() == []
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "[S]", "<M>"), ("<<", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.Infill(prefix=marks[0], suffix=marks[1], middle=marks[2])
    other = infill.Infill(seed=7, prefix="<|fim_p|>", suffix="<|fim_s|>", middle="<|fim_m|>", plain=0, suffix_first=50)
    docs = spark.createDataFrame([(i, f"text {i} of some words") for i in range(50)], "doc_id long, text string")
    made = infill.restored(infill.fill_in_middle(docs, other), other).collect()
    assert {r.form for r in made} == {"psm", "spm"} and all(r.restored == f"text {r.doc_id} of some words" and r.output.count("<|fim_m|>") == 1 for r in made)
