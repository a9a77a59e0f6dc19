"""The share of a page's words that repeat what already stood on it, and cutoffs with a controlled risk.

``repeated_share`` reads a page down its columns and finds stretches of at least four words that stood
earlier on the same page: equal words by a lookup of all fours, and copies with scanning faults on the
stream of letters, where misread letters and broken words don't end a stretch. The measured share differs a little from the true one, because of scanning faults.

So the cutoff on the measured share is chosen per stratum on labelled holdouts: all pages of the
corpus that repeat next to nothing, into which repeats of a known true share and scanning faults are
planted, once below the asked share and once above (which no cutoff depends on). A page is read once
for its share and its trials; of the trials only the number that reach each cutoff is kept. Exact
copies of a row make one trial. A rejection is false if the true share is below the asked one. Cutoffs
are tested from the strictest down, each passing if the exact (Clopper-Pearson) upper bound of its rate
of false rejections is at most ``risk``; testing stops at the first failure, so the sequence needs no
correction, and the error ``DELTA`` is divided by the number of strata (Bonferroni). With probability
1 - ``DELTA`` no stratum's rate exceeds ``risk``. The rate is that of pages whose true share is uniform
below the asked one, one independent trial per page; a corpus, most of whose pages repeat nothing,
has fewer that are near the cutoff, so its rate is lower.

All pages together are a stratum of their own, ``POOLED``. A stratum whose holdout certifies no cutoff
takes the pooled one; where that isn't certified either, nothing is rejected.

Defined results: a null, empty or wordless text has no words and the share 0; strata with fewer than
1 % of the pages, and null ones, are together ``other``; an empty corpus gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import isqrt, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .pages import BREAK_MARKS, fold, grams, page_columns, read_pages

SEED, NOISE, SHIFT, WORDS = 8, 14, 2, 4
DELTA, RISK, POOLED = 0.05, 0.05, "*"
MISREAD, STRAY, BROKEN = 0.01, 0.01, 0.25  # faults planted: per letter, per word, per line
CUTOFFS = [c / 100 for c in range(45, 9, -1)]


def page_words(lines: list[str]) -> list[str]:
    """The page's words, folded; a word broken with a mark at a line's end is one."""
    words: list[str] = []
    open_ = False
    for line, folded in zip(lines, fold("\n".join(lines)).split("\n")):
        found = folded.split()
        if open_ and found:
            words[-1] += found[0]
            del found[0]
        words += found
        end = line.rstrip()
        open_ = bool(words) and len(end) > 1 and end[-1] in BREAK_MARKS and end[-2].isalnum()
    return words


def exact_repeats(words: list[str]) -> np.ndarray:
    """Words in stretches of ``WORDS`` or more that stood earlier, letter for letter."""
    marked = bytearray(len(words))
    seen: set[tuple[str, ...]] = set()
    for i, key in enumerate(zip(*(words[k:] for k in range(WORDS)))):
        if key in seen:
            marked[i : i + WORDS] = b"\1" * WORDS
        else:
            seen.add(key)
    return np.frombuffer(marked, bool)


def repeated_words(lines: list[str]) -> tuple[int, int]:
    """Words of the page, and how many lie in stretches of ``WORDS`` or more that stood earlier."""
    words = page_words(lines)
    n = len(words)
    stream = "".join(words)
    h = grams(stream, SEED)
    if n <= WORDS or len(h) < 2:
        return n, int(exact_repeats(words).sum())
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return n, int(exact_repeats(words).sum())
    later, newest = order[1:][same], order[:-1][same]
    heads = np.flatnonzero(np.concatenate(([True], ~same)))
    oldest = order[heads[np.cumsum(np.concatenate(([True], ~same)))[1:][same] - 1]]
    by = np.argsort(later)
    # a stretch may continue its newest copy, or an older one where newer copies are shorter
    chains = _chains(later[by], newest[by])
    if (newest != oldest).any():
        chains += _chains(later[by], oldest[by])
    bounds = [0, *accumulate(map(len, words))]
    begins = bounds[:-1]
    marked = exact_repeats(words).copy()
    for start, end in chains:
        i, j = bisect_left(begins, start + 1) - 1, bisect_left(begins, end)
        i = max(i, 0)
        if 3 * (start - begins[i]) > bounds[i + 1] - begins[i]:
            i += 1
        if j > i and 3 * (bounds[j] - end) > bounds[j] - begins[j - 1]:
            j -= 1
        if j - i >= WORDS:
            marked[i:j] = True
    return n, int(marked.sum())


def _chains(later: np.ndarray, earlier: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of the page (start, end) whose seeds continue one earlier copy, over faults."""
    gap = later - earlier
    cut = np.flatnonzero((np.diff(later) != 1) | (np.diff(gap) != 0)) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [len(later)])) - 1
    open_: list[list[int]] = []  # start on the page, end, end of the earlier copy
    done: list[list[int]] = []
    for p, q, e in zip(later[first].tolist(), earlier[first].tolist(), (later[last] + SEED).tolist()):
        done += [c for c in open_ if c[1] + NOISE < p]
        open_ = [c for c in open_ if c[1] + NOISE >= p]
        fit = [c for c in open_ if abs((p - c[1]) - (q - c[2])) <= SHIFT and q - c[2] > -SEED]
        if fit:
            best = min(fit, key=lambda c: c[0])
            best[1], best[2] = max(best[1], e), q + e - p
        else:
            open_.append([p, e, q + e - p])
    return [(c[0], c[1]) for c in done + open_]


def repeated_share(
    pages: DataFrame, *, text: str = "text", boxes: str | None = "boxes", doc_id: str = "doc_id", stratum: str = "lang"
) -> DataFrame:
    """One row per page: ``doc_id``, ``stratum`` (as written), ``n_words``, ``n_repeated``, ``share``."""
    kind = pages.schema[doc_id].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [repeated_words(lines) for lines in read_pages(batch)]
            n, r = (pa.array([x[i] for x in found], pa.int64()) for i in (0, 1))
            share = pa.array([x[1] / x[0] if x[0] else 0.0 for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("stratum"), n, r, share], ["doc_id", "stratum", "n_words", "n_repeated", "share"]
            )

    have = pages.select(F.col(doc_id).alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), *page_columns(pages, text, boxes))
    return have.mapInArrow(measure, f"doc_id {kind}, stratum string, n_words long, n_repeated long, share double")


def upper_bound(bad: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the rate at which ``bad`` or fewer of ``n`` have probability ``delta``."""
    if bad >= n:
        return 1.0
    lo, hi = bad / n, 1.0
    # the terms fall away from ``bad`` at least like exp(-d * d / (2 * bad)), so those far below it add nothing
    k = np.arange(max(0, bad - 10 * isqrt(bad) - 50), bad + 1)
    ways = np.array([lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) for i in k.tolist()])
    for _ in range(60):
        p = (lo + hi) / 2
        if p <= 0 or p >= 1:
            break
        tail = np.exp(ways + k * log(p) + (n - k) * log1p(-p)).sum()
        lo, hi = (p, hi) if tail > delta else (lo, p)
    return hi


def true_share(words: list[str]) -> float:
    """By definition, on faultless words."""
    return float(exact_repeats(words).mean()) if words else 0.0


def planted(words: list[str], goal: float, rng: random.Random) -> list[str]:
    """``words`` with phrases, sentences and paragraphs of it repeated until about ``goal`` of it is repeated."""
    out = list(words)
    source = len(out)
    while len(out) - source < goal * len(out):
        size = min(rng.choice((rng.randint(4, 8), rng.randint(8, 20), rng.randint(20, 60))), source, max(4, round(source / 4)))
        left = int((goal * source / max(0.05, 1 - goal)) - (len(out) - source))
        size = max(WORDS, min(size, left)) if left > 0 else WORDS
        start = rng.randrange(source - size + 1)
        out += out[start : start + size]
    return out


def _well_read(rng: random.Random) -> int:
    """Letters before the next misread one, each misread by itself with the chance ``MISREAD``."""
    return int(log(1 - rng.random()) / log1p(-MISREAD))


def faulty_lines(words: list[str], rng: random.Random) -> list[str]:
    """``words`` set in lines, with misread letters, stray blanks and words broken at line ends."""
    lines, line, room = [], [], rng.randint(28, 42)
    used = 0
    ahead = _well_read(rng)
    for word in words:
        while ahead < len(word):
            word = word[:ahead] + rng.choice("acehnorstu") + word[ahead + 1 :]
            ahead += 1 + _well_read(rng)
        ahead -= len(word)
        if len(word) > 5 and rng.random() < STRAY:
            cut = rng.randrange(2, len(word) - 1)
            word = f"{word[:cut]} {word[cut:]}"
        if used + len(word) > room:
            if len(word) > 5 and rng.random() < BROKEN:
                cut = rng.randrange(2, len(word) - 2)
                line.append(word[:cut] + rng.choice(("-", "¬", "=", "")))
                word = word[cut:]
            lines.append(" ".join(line))
            line, used = [], 0
        line.append(word)
        used += len(word) + 1
    return [*lines, " ".join(line)]


def certified_cutoff(measured: list[float], true: list[float], at_least: float, risk: float, delta: float) -> float | None:
    """The lowest cutoff certified by testing from the strictest down; None if none is."""
    good = sorted(m for m, t in zip(measured, true) if t < at_least)
    return _lowest([len(good) - bisect_left(good, cutoff) for cutoff in CUTOFFS], len(good), risk, delta)


def _lowest(bad: list[int], n: int, risk: float, delta: float) -> float | None:
    """The same from how many of ``n`` trials reach each of ``CUTOFFS``."""
    best = None
    for cutoff, reach in zip(CUTOFFS, bad):
        if not n or upper_bound(reach, n, delta) > risk:
            break
        best = cutoff
    return best


def _levels(at_least: float) -> list[float]:
    """What measured shares are compared with, ascending."""
    return sorted({*CUTOFFS, at_least})


def _with_trials(
    pages: DataFrame, at_least: float, above: bool, *, text: str = "text", boxes: str | None = "boxes", doc_id: str = "doc_id", stratum: str = "lang"
) -> DataFrame:
    """:func:`repeated_share` with a hash ``h`` of the page and, for its trials ``below`` and (if asked for) ``above``, how many levels each reached.

    Null: the page is no holdout, as it is short or repeats itself. -1: what was to be below came out above, or
    the other way round, so it is no trial.
    """
    kind = pages.schema[doc_id].dataType.simpleString()
    levels = _levels(at_least)

    def trial(words: list[str], goal: float, below: bool, rng: random.Random) -> int:
        made = planted(words, goal, rng)
        n, again = repeated_words(faulty_lines(made, rng))
        return bisect_right(levels, again / n) if (true_share(made) < at_least) == below else -1

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, lines in zip(batch.column("h").to_pylist(), read_pages(batch)):
                n, again = repeated_words(lines)
                low = high = None
                if n >= 40 and again <= 0.05 * n:
                    rng = random.Random(key)
                    words = fold(" ".join(lines)).split()
                    goals = rng.uniform(0, at_least), rng.uniform(at_least, 0.8)
                    low = trial(words, goals[0], True, rng)
                    high = trial(words, goals[1], False, rng) if above else None
                found.append((n, again, again / n if n else 0.0, low, high))
            made = zip((pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), zip(*found) if found else [()] * 5)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "stratum", "h")), *(pa.array(values, t) for t, values in made)],
                ["doc_id", "stratum", "h", "n_words", "n_repeated", "share", "below", "above"],
            )

    have = pages.select(F.col(doc_id).alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), *page_columns(pages, text, boxes))
    return have.withColumn("h", F.xxhash64("doc_id", "text", "xs", "ys")).mapInArrow(
        measure, f"doc_id {kind}, stratum string, h long, n_words long, n_repeated long, share double, below int, above int"
    )


def _certify(at_least: float, risk: float, delta: float):
    levels = _levels(at_least)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        def trials(kind: str) -> int:
            return int(rows["n"][rows[kind] >= 0].sum())

        def reach(kind: str, level: float) -> int:
            return int(rows["n"][rows[kind] > levels.index(level)].sum())

        n, n_above = trials("below"), trials("above")
        cutoff = _lowest([reach("below", c) for c in CUTOFFS], n, risk, delta)
        at = at_least if cutoff is None else cutoff
        bad = reach("below", at)
        return pd.DataFrame(
            {
                "stratum": [rows["stratum"].iloc[0]],
                "cutoff": pd.array([cutoff], "Float64"),
                "n_below": [n],
                "n_false": [bad],
                "bound": [upper_bound(bad, n, delta) if n else 1.0],
                "n_above": [n_above],
                "n_missed": [n_above - reach("above", at)],
            }
        )

    return one


def _certified(measured: DataFrame, at_least: float, risk: float) -> tuple[DataFrame, list[str]]:
    """:func:`cutoffs` from the written rows of :func:`_with_trials`."""
    name = F.lower(F.trim("stratum"))
    counts = measured.groupBy(name.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    large = counts.filter(F.col("s").isNotNull() & (F.col("s") != POOLED) & (F.col("n") * 100 >= total))
    own = [r["s"] for r in large.select("s").collect()]  # 100 at most
    mine = F.when(name.isin(own), name).otherwise(F.lit("other"))
    trials = measured.filter("below is not null").select("h", F.explode(F.array(mine, F.lit(POOLED))).alias("stratum"), "below", "above")
    reached = trials.distinct().groupBy("stratum", "below", "above").agg(F.count(F.lit(1)).alias("n"))  # levels squared per stratum at most
    found = reached.groupBy("stratum").applyInPandas(
        _certify(at_least, risk, DELTA / (len(own) + 2)),
        "stratum string, cutoff double, n_below long, n_false long, bound double, n_above long, n_missed long",
    )
    return materialize(found, "cutoffs"), own


def cutoffs(
    pages: DataFrame,
    at_least: float = 0.25,
    risk: float = RISK,
    *,
    text: str = "text",
    boxes: str | None = "boxes",
    doc_id: str = "doc_id",
    stratum: str = "lang",
) -> tuple[DataFrame, list[str]]:
    """Per stratum the certified cutoff (null if there is none) with the holdout's counts, and the strata that stand alone."""
    columns = {"text": text, "boxes": boxes, "doc_id": doc_id, "stratum": stratum}
    trials = _with_trials(pages, at_least, True, **columns).select("stratum", "h", "below", "above")
    return _certified(materialize(trials, "trials"), at_least, risk)


def repetitive_pages(pages: DataFrame, at_least: float = 0.25, risk: float = RISK, **columns: str) -> DataFrame:
    """Pages whose measured share reaches their stratum's cutoff: the columns of :func:`repeated_share` and ``cutoff``."""
    measured = materialize(_with_trials(pages, at_least, False, **columns), "trials")
    chosen, own = _certified(measured, at_least, risk)
    shares = measured.select("doc_id", "stratum", "n_words", "n_repeated", "share")
    name = F.lower(F.trim("stratum"))
    key = F.when(name.isin(own), name).otherwise(F.lit("other"))
    few = chosen.filter(F.col("cutoff").isNotNull()).select(F.col("stratum").alias("_s"), "cutoff")  # 102 rows at most
    pooled = few.filter(F.col("_s") == POOLED).select(F.col("cutoff").alias("_all"))
    joined = shares.withColumn("_s", key).join(F.broadcast(few), "_s", "left").join(F.broadcast(pooled), how="left", on=F.lit(True))
    joined = joined.withColumn("cutoff", F.coalesce("cutoff", "_all")).drop("_s", "_all")
    return joined.filter(F.col("share") >= F.col("cutoff"))
