"""Planted passages: lengths about the limit, faults, breaks, interruptions."""

import random

import pytest

from nestwork.llm import leaks
from nestwork.llm.leaks import Item, leaked_passages, longest_run

PAGES = "doc_id long, text string, boxes array<struct<x: int, y: int, w: int, h: int, conf: int>>"


def words(rng, n):
    return ["".join(rng.choice(["ba", "tu", "ko", "mi", "sel", "ran", "dor", "vi", "zak", "ple"]) for _ in range(rng.choice([1, 2, 2, 3, 4]))) for _ in range(n)]


def setting(lines, x=80, advert=None):
    """Lines with boxes; ``advert`` lines go in after the third one."""
    rows = [(x, t) for t in lines]
    if advert:
        rows[3:3] = [(x + 25, t) for t in advert]
    text = "\n".join(t for _, t in rows)
    return text, [(x, 20 * i, 300, 18, 90) for i, (x, _) in enumerate(rows)]


def lines_of(ws, per=6):
    return [" ".join(ws[i : i + per]) for i in range(0, len(ws), per)]


def brute(page, item, run):
    """Exact runs of words, for faultless pages."""
    p, q = page.lower().split(), item.lower().split()
    windows = {tuple(p[i : i + run]) for i in range(len(p) - run + 1)}
    return any(tuple(q[i : i + run]) in windows for i in range(len(q) - run + 1))


@pytest.fixture(scope="module")
def items():
    r = random.Random(1)
    return [(100 + i, " ".join(words(r, 60))) for i in range(12)] + [(900, "too short"), (901, None), (902, "")]


def found(spark, pages, items, run=20):
    df = spark.createDataFrame(pages, PAGES)
    own = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in leaked_passages(df, own, run).collect())


def test_lengths(spark, items):
    r = random.Random(2)
    pages, want = [], []
    for i, n in enumerate([5, 12, 16, 19, 20, 21, 24, 40, 60]):
        passage = items[i][1].split()[: n]
        text, boxes = setting(lines_of(words(r, 80) + passage + words(r, 80)))
        pages.append((i, text, boxes))
        want += [(i, item) for item, t in items if t and brute(text, t, 20)]
    assert found(spark, pages, items) == want
    assert [d for d, _ in want] == [4, 5, 6, 7, 8]


def faulty(ws, rng):
    """Misread letters, broken words, words broken at line ends by various marks or none."""
    out, line = [], []
    for i, w in enumerate(ws):
        w = "".join(rng.choice("acehnos") if rng.random() < 0.01 else c for c in w)
        if i % 6 == 5 and len(w) > 4:
            line.append(w[:2] + rng.choice(["-", "=", "¬", ""]))
            out.append(" ".join(line))
            line = [w[2:]]
        elif i % 11 == 7 and len(w) > 4:
            line.append(w[:3] + " " + w[3:].upper() + ",")
        else:
            line.append(w)
    return [*out, " ".join(line)]


def test_faults_adverts_and_columns(spark, items):
    r = random.Random(3)
    pages, want = [], []
    for d in range(24):
        item, text = items[d % 12]
        start = r.randrange(0, 30)
        passage = text.split()[start : start + 28]
        lines = faulty(words(r, 10) + passage + words(r, 10), r)
        page, boxes = setting(lines, advert=["BUY NOW", "at " + " ".join(words(r, 3))] if d % 3 == 0 else None)
        if d % 2:  # a second column, read row by row
            a, b = list(zip(page.split("\n"), boxes)), list(zip(*(lambda p: (p[0].split("\n"), p[1]))(setting(lines_of(words(r, 60)), x=480))))
            rows = sorted(a + b, key=lambda z: (z[1][1], z[1][0]))
            page, boxes = "\n".join(t for t, _ in rows), [z for _, z in rows]
        pages.append((d, page, boxes))
        want.append((d, item))
    assert found(spark, pages, items) == want


def test_blocks_of_items(spark, items, monkeypatch):
    r = random.Random(4)
    pages = [(i, *setting(lines_of(words(r, 20) + items[i][1].split()[10:40]))) for i in range(8)]
    whole = found(spark, pages, items)
    monkeypatch.setattr(leaks, "MOST_SHINGLES", 700)
    assert found(spark, pages, items) == whole == [(i, 100 + i) for i in range(8)]


def test_edges(spark, items):
    pages = [(1, None, None), (2, "", []), (3, items[0][1], None), (3, items[0][1], None), (4, "   \n ", [(0, 0, 0, 0, -1), None])]
    twins = items + [(100_000, items[0][1])]
    assert found(spark, pages, twins) == [(3, 100), (3, 100), (3, 100_000), (3, 100_000)]
    assert found(spark, pages[:2], items) == [] and found(spark, [], items) == [] and found(spark, pages, []) == []


def test_a_very_long_page(spark, items):
    r = random.Random(5)
    text = " ".join(words(r, 40_000) + items[3][1].split()[:30] + words(r, 40_000) + items[4][1].split()[:12])
    assert found(spark, [(1, text, None)], items) == [(1, 103)]


@pytest.mark.parametrize("far", [0, 500, 1000, 4500, 8000, 20_000])
def test_long_interruptions(spark, items, far):
    """A passage in two or three parts with so many letters of other lines between them, on pages read as they stand."""
    r = random.Random(6)
    pages = []
    for d, cuts in enumerate([(12,), (8, 16)]):
        passage, lines = items[d][1].split()[4:26], []
        for a, b in zip((0, *cuts), (*cuts, 22)):
            fill, letters = [], 0
            while letters < far:
                fill.append(r.choice(["zyx", "wqvu", "yyqxj"]) + r.choice(["jj", "kq"]))
                letters += len(fill[-1])
            lines += [*lines_of(fill), *lines_of(passage[a:b])]
        pages.append((d, "\n".join(lines), None))
    assert found(spark, pages, items) == [(0, 100), (1, 101)]


def test_words_at_the_ends_of_a_run(spark):
    """19 words beside one- and two-letter words of the item, parts of longer words, and words that lack letters are no 20."""
    r = random.Random(9)
    mid = words(r, 19)
    item = " ".join(["i", *mid, "a"])
    text = lambda first, last, n=19: " ".join([*words(r, 30), *first, *mid[:n], *last, *words(r, 30)])
    pages = [
        (1, text([], []), None), (2, text([], ["apple"]), None), (3, text(["taxi"], []), None), (4, text(["i"], [], 18), None),
        (5, text(["i"], []), None), (6, text([], ["a"]), None), (7, text(["I,"], ["-a."]), None),
    ]
    assert found(spark, pages, [(1, item)]) == [(5, 1), (6, 1), (7, 1)]
    of, by = words(r, 18), "house"
    item = " ".join(["bright", *of, by])
    pages = [
        (1, " ".join(["xx", "right", *of, "hous", "yy"]), None),  # both words lack a letter at the outside
        (2, " ".join(["xx", "bright", *of, by, "yy"]), None),
        (3, " ".join(["xx", "brighl", *of, "honse", "yy"]), None),  # a misread letter each
        (4, " ".join(["xx", "brooch", *of, "mouth", "yy"]), None),
        (5, " ".join(["xx", "bright", *of[:9], "\n", *of[9:], "house", "yy"]), None),
        (6, " ".join(["xx", "br", "ight", *of, "ho\nuse", "yy"]), None),
    ]
    assert found(spark, pages, [(1, item)]) == [(2, 1), (3, 1), (5, 1), (6, 1)]


def test_extra_columns(spark, items):
    df = spark.createDataFrame([(1, items[0][1], None, "x", 5)], PAGES + ", ids string, item_id long")
    own = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, letters string")
    assert [(r.doc_id, r.item_id) for r in leaked_passages(df, own).collect()] == [(1, 100)]


def test_longest_run_counts_words():
    item = Item("alpha beta gamma delta epsilon zeta")
    assert longest_run(item, "xxbetagammadeltaxx", [0, 18]) == 3
    # an interruption between line ends doesn't break a run, one within a line does
    page = "alphabetagamma" + "q" * 30 + "deltaepsilonzeta"
    assert longest_run(item, page, [0, 14, 44, 60]) == 6
    assert longest_run(item, page, [0, 60]) == 3
