"""Each kind of damage that a scan does to verse numbers."""

import random

import pytest

from lectern.operators import scanned as N


def verses(paragraphs, chapters=None):
    return [(v["chapter"], v["verse"], v["text"]) for v in N.scanned_verses(paragraphs, chapters)[0]]


def chapter(n, count, skip=(), form="{v} {t}"):
    return [f"CHAPTER {'I II III IV V VI'.split()[n - 1]}.", *(form.format(v=v, t=text(n, v)) for v in range(1, count + 1) if v not in skip)]


def text(n, v):
    return f"Words of chapter {'one two three four five six'.split()[n - 1]}, verse {'abcdefghijklmnopqrstuvwxyz'[v % 26]}."


def whole(*counts):
    return [(n, v, text(n, v)) for n, count in enumerate(counts, 1) for v in range(1, count + 1)]


def test_clean():
    assert verses(["GENESIS", "The first book", *chapter(1, 9), *chapter(2, 5)]) == whole(9, 5)


def test_headings_pages_and_running_text():
    got, log = N.scanned_verses(["Title page", "CHAPTER I.", "1 In the beginning. 2 And it was so,", "83", "and more. 4 Four came; 5 Five.", "CHAFTER II", "No number here", "2 Two."])
    assert [(v["chapter"], v["verse"], v["text"]) for v in got] == [(1, 1, "In the beginning."), (1, 2, "And it was so, and more."), (1, 4, "Four came;"), (1, 5, "Five."), (2, 1, "No number here"), (2, 2, "Two.")]
    assert any("3 to 3 missing" in x for x in log) and any("CHAFTER" in x for x in log)


def test_missing_number():
    want = [(1, v, text(1, v)) for v in range(1, 10) if v not in (4, 5)]
    want[2] = (1, 3, f"{text(1, 3)} Text without number. More of it.")
    book = chapter(1, 9, skip=(4, 5))
    book[4:4] = ["Text without number.", "More of it."]
    assert verses(book) == want


def test_fused():
    one = chapter(1, 9)
    assert verses([one[0], " ".join(one[1:])]) == whole(9)
    assert verses([one[0], *one[1:4], " ".join(one[4:7]), *one[7:]]) == whole(9)
    assert verses(["CHAPTER I.", "1 He had 40 sheep, 12 and more. 2 And 7 men came. 3 The end."]) == [(1, 1, "He had 40 sheep, 12 and more."), (1, 2, "And 7 men came."), (1, 3, "The end.")]


def test_misread():
    book = chapter(1, 12)
    book[1], book[10], book[11] = "l " + text(1, 1), "lO " + text(1, 10), "I1. " + text(1, 11)
    got, log = N.scanned_verses(book)
    assert [(v["chapter"], v["verse"], v["text"]) for v in got] == whole(12)
    assert sum("read as" in x for x in log) == 3


def test_out_of_order_columns():
    book = chapter(1, 20)
    swapped = book[:8] + book[14:] + book[8:14]  # 1-7, 14-20, 8-13
    got, log = N.scanned_verses([*swapped, *chapter(2, 4)])
    assert [(v["chapter"], v["verse"], v["text"]) for v in got] == whole(20, 4)
    assert log == ["chapter 1: 8 out of order"]
    hole = book[:4] + book[7:] + book[4:7]  # 1-3, 7-20, 4-6
    assert verses([*hole, *chapter(2, 4)]) == whole(20, 4)


def test_running_heads():
    book = chapter(1, 9)
    for head in (["CHAPTER I."], ["CHAPTER I. 829 which went on"], ["GENESIS", "CHAPTER II."], ["12", "CHAPTER I"]):
        got = verses([*book[:6], *head, *book[6:], *chapter(2, 5)])
        if "which" in head[0]:
            assert [g[:2] for g in got] == [w[:2] for w in whole(9, 5)]
        else:
            assert [g for g in got if g[1] != 5] == [w for w in whole(9, 5) if w[1] != 5] and len(got) == 14


def test_lost_heading():
    two = [f"AND it came to pass. {text(2, 1)}", *chapter(2, 6, skip=(1,))[1:]]
    got, log = N.scanned_verses([*chapter(1, 8), *two, *chapter(3, 3)])
    assert [(v["chapter"], v["verse"], v["text"]) for v in got] == [*whole(8), (2, 1, f"AND it came to pass. {text(2, 1)}"), *whole(0, 6)[1:], *whole(0, 0, 3)]
    assert "chapter 2: found by its numbers" in log
    assert verses([*chapter(1, 8), *chapter(2, 6)[1:]]) == whole(8, 6)


def test_missing_page():
    assert verses([*chapter(1, 30), *chapter(2, 40)[26:], *chapter(3, 3)]) == [*whole(30), *[w for w in whole(0, 40) if w[1] > 25], *whole(0, 0, 3)]


def test_titles_and_drop_caps():
    book = ["CHAPTER I. God creates—Light appears. NOW it was dark.", "2 And it was light.", "CHAPTER II. The garden—The tree.", "3 Third.", "4 Fourth.", "CHAPTER III.", "The flood—The ark.", "AND it rained.", "2 It stopped."]
    assert verses(book) == [(1, 1, "NOW it was dark."), (1, 2, "And it was light."), (2, 3, "Third."), (2, 4, "Fourth."), (3, 1, "AND it rained."), (3, 2, "It stopped.")]


def test_bound_elsewhere():
    ahead = chapter(1, 20)
    strays = ahead[13:]
    assert verses([*strays, *ahead[:13], *chapter(2, 5)], 2) == whole(20, 5)
    assert verses([*chapter(1, 6), *chapter(2, 5), *chapter(3, 30)[21:]], 2) == whole(6, 5)


def test_nothing():
    assert N.scanned_verses([]) == ([], []) and N.scanned_verses([None, "", " 12 ", "a"]) == ([], [])
    assert verses(["words only", "more"]) == [] and verses(["CHAPTER I.", "words only", "more"]) == [(1, 1, "words only more")]


@pytest.mark.parametrize("seed", range(5))
def test_random_damage_keeps_most(seed):
    rng = random.Random(seed)
    counts = [rng.randint(8, 40) for _ in range(6)]
    book, want = [], set()
    for n, count in enumerate(counts, 1):
        own = chapter(n, count)
        for v in range(1, count + 1):
            if 1 < v < count and rng.random() < 0.05:
                own[v] = own[v].partition(" ")[2]
            elif rng.random() < 0.05:
                own[v] = own[v].translate({ord("1"): "l", ord("0"): "O"})
                want.add((n, v))
            else:
                want.add((n, v))
        for _ in range(3):
            own.insert(rng.randint(2, len(own)), rng.choice(["83", str(rng.randint(300, 900)), f"CHAPTER {'I II III IV V VI'.split()[n - 1]}."]))
        book += own
    got = {(v["chapter"], v["verse"]) for v in N.scanned_verses(book)[0]}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 2


@pytest.mark.parametrize("short", [1, 2, 3])
def test_short_chapter_before_one_without_heading(short):
    bare = ["NOW " + text(2, 1), *(f"{v} {text(2, v)}" for v in range(2, 13))]
    want = [(c, v, "NOW " * ((c, v) == (2, 1)) + t) for c, v, t in whole(short, 12, 4)]
    assert verses([*chapter(1, short), *bare, *chapter(3, 4)]) == want


def test_second_verse_goes_on_without_drop_cap():
    assert verses([*chapter(1, 1), "More of it.", *(f"{v} {text(1, v)}" for v in range(2, 13))]) == [(1, 1, text(1, 1) + " More of it."), *whole(12)[1:]]


def test_books(spark):
    rows = [("a", i, t) for i, t in enumerate(chapter(1, 5))] + [("b", i, t) for i, t in enumerate([*chapter(1, 3), *chapter(2, 30)[21:]])] + [(None, 0, "CHAPTER I."), (None, 1, "1 One."), ("c", 0, None)]
    p = spark.createDataFrame(rows, "book string, pos int, text string")
    n = spark.createDataFrame([("b", 1)], "book string, n int")
    found = lambda *more: sorted(((r["book"] or "", r["chapter"], r["verse"]) for r in N.scanned_books(p, *more).collect()))
    assert found(n) == [("", 1, 1), *(("a", 1, v) for v in range(1, 6)), *(("b", 1, v) for v in range(1, 4))]
    assert len(found()) == 1 + 5 + 3 + 10
    assert N.scanned_books(p.filter("pos < 0")).collect() == []
