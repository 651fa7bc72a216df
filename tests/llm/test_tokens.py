"""Counts against the library itself."""

import random

import pytest

P = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from lectern.llm import tokens  # noqa: E402

PATH = P.path("piece_bpe_32k.model")
BITS = [" ", "  ", "\n", "\t", "a", "the ", " of", "▁", "é", "ａ", "</s>", "<s>", "<unk>", "\x00", "日本", "x1", "　", "\xa0", "…", "it's ", "<0x0A>", "naïve", "ing "]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 15))) for _ in range(n)]


def test_totals(sp):
    own = tokens.Counter(PATH)
    assert own.splits
    some = texts(5000, 1)
    assert own.totals(some) == [len(c) for c in sp.encode(some)]


def test_prefixes_are_exact(sp):
    own = tokens.Counter(PATH)
    for t in texts(300, 2):
        ends, counts = own.prefixes(t)
        assert [len(sp.encode(t[:e])) for e in ends if e] == [c for e, c in zip(ends, counts, strict=True) if e]


@pytest.mark.parametrize("part", [" hello", " antidisestablishment", "\nworldwide", " überéa1日x", "   gap"])
def test_inside_a_part(part):
    own = tokens.Counter(PATH)
    surface = part.replace(" ", "▁")
    assert own.inside(part) == [len(own._codes(surface[:i])) for i in range(1, len(part) + 1)]


def test_cut_stays_within_budget(sp):
    own = tokens.Counter(PATH)
    for t in texts(200, 3):
        for budget in (0, 1, 4):
            assert len(sp.encode(t[: own.cut(t, budget)])) <= budget


def test_forgetting(sp, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    some = texts(300, 4)
    assert tokens.Counter(PATH).totals(some) == [len(c) for c in sp.encode(some)]


def test_rows(spark, sp):
    some = ["", None, "a b", "word " * 5000, "a b"]
    df = spark.createDataFrame([(None if i == 2 else i, t, 1) for i, t in enumerate(some)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r for r in tokens.token_counts(df, PATH).collect()}
    assert [got[i]["n_tokens"] for i in (0, 1, None, 3, 4)] == [len(sp.encode(t or "")) for t in some]
    assert got[3]["over_limit"] and not got[4]["over_limit"] and got[3]["n_bytes"] == 25000
    fit = {r["doc_id"]: r for r in tokens.fitting(tokens.prefix_counts(df, PATH), 3).collect()}
    assert fit[4]["fits"] and not fit[3]["fits"] and len(sp.encode(some[3][: fit[3]["cut"]])) == fit[3]["tokens"] <= 3
    assert tokens.token_counts(df.limit(0), PATH).count() == 0


UNSPACED = ["日本語の長い文章はここで切れます。", "aGVsbG8gd29ybGQhIQ==" * 6, "x\n\nantidisestablishmentarianism", "\nabc", "é" * 20 + "ａ😀b龘c" * 3]


def test_budgets_inside_unspaced_text(spark, sp):
    some = UNSPACED + texts(40, 9)
    table = tokens.prefix_counts(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), PATH).cache()
    for budget in (0, 1, 2, 5, 9):
        for r in tokens.fitting(table, budget).collect():
            t = some[r["doc_id"]]
            counts = [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
            cut = max(i for i, n in enumerate(counts) if n <= budget)
            assert (r["fits"], r["cut"], r["tokens"]) == (counts[-1] <= budget, cut, counts[cut]), (t, budget)


def test_tables_are_those_of_single_texts():
    own = tokens.Counter(PATH)
    some = ["", "a b", "日本語" * 40, " x\n"]
    assert [t.tolist() for t in own.tables(some)] == [own.prefixes(t)[1] for t in some]
