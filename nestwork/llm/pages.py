"""Scanned pages read down their columns, and their letters as one stream.

A page's lines have boxes. Columns are found from the left edges of the lines; a line that runs over
several columns, its parts held apart by blanks, is cut; lines set in from their column's edge are
adverts and are read after the running text. Without usable boxes (null, not one per line, null
coordinates) lines are read as they stand.

Comparisons use letters and digits only, in lower case and without accents: blanks and breaks inside
words don't show in such a stream.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMN_GAP = 60  # left edges farther apart belong to different columns, in pixels
INDENT = 14  # lines set in farther than this are adverts
BREAK_MARKS = "-¬=—–­~"
_parted = re.compile(r" {2,}")


class _Fold(dict):
    """Code point to its folded form, for str.translate; blanks and line breaks stay apart."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        folded = " " if c.isspace() else "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if x.isalnum())
        self[code] = folded
        return folded


_fold = _Fold({10: "\n"})


def fold(text: str) -> str:
    """Lower-case letters and digits without accents; white space is kept, line breaks as such."""
    return text.translate(_fold)


def letters(text: str) -> str:
    return "".join(fold(text).split())


def ordered_lines(text: str, xs: np.ndarray | None, ys: np.ndarray | None) -> list[str]:
    """The lines of a page (or parts of lines) in reading order."""
    lines = text.split("\n")
    if xs is None or len(xs) != len(lines):
        return [part for line in lines for part in _parted.split(line.strip())] if "  " in text else lines
    joined: dict[int, list[tuple[int, str]]] = {}
    if "  " in text:
        for i, line in enumerate(lines):
            if "  " in line:
                parts = [(m.start(), m.group()) for m in re.finditer(r"\S+(?: \S+)*", line)]
                if len(parts) > 1:
                    joined[i] = parts
    left = np.sort(xs if not joined else np.delete(xs, list(joined)))
    if not len(left):
        left = np.sort(xs)
    starts = left[np.concatenate(([True], np.diff(left) > COLUMN_GAP))]
    if len(starts) == 1 and not joined:
        column = np.zeros(len(lines), np.int64)
        key = np.lexsort((ys, xs - starts[0] > INDENT))
        return [lines[i] for i in key]
    column = np.abs(xs[:, None] - starts[None, :]).argmin(1)
    rows: list[tuple[bool, int, int, int, str]] = []
    advert = xs - starts[column] > INDENT
    for i, line in enumerate(lines):
        if i not in joined:
            rows.append((bool(advert[i]), int(column[i]), int(ys[i]), i, line))
            continue
        # the parts' edges are not known; each goes to the next column at or after where it begins
        at, width = int(column[i]), (starts[-1] - starts[0]) / max(1, joined[i][-1][0])
        for k, (offset, part) in enumerate(joined[i]):
            if k:
                near = int(np.abs(starts - (xs[i] + offset * width)).argmin()) if len(starts) > len(joined[i]) else at + 1
                at = min(max(at + 1, near), len(starts) - 1)
            rows.append((False, at, int(ys[i]), i, part))
    rows.sort(key=lambda r: r[:4])
    return [r[4] for r in rows]


def page_columns(pages: DataFrame, text: str, boxes: str | None) -> list[Column]:
    """``text``, ``xs``, ``ys``; of the boxes only those two fields are read."""
    if boxes is None:
        none = F.lit(None).cast("array<int>")
        return [F.col(text).alias("text"), none.alias("xs"), none.alias("ys")]
    return [F.col(text).alias("text"), F.col(f"{boxes}.x").alias("xs"), F.col(f"{boxes}.y").alias("ys")]


def _slices(array: pa.Array) -> list[np.ndarray | None]:
    values, offsets = array.values, array.offsets.to_numpy()
    if isinstance(values, pa.Array) and values.null_count:
        known = np.asarray(values.is_valid())
        flat = values.fill_null(0).to_numpy(zero_copy_only=False)
    else:
        known, flat = None, values.to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = []
    for i, there in enumerate(np.asarray(array.is_valid())):
        lo, hi = offsets[i], offsets[i + 1]
        usable = there and (known is None or known[lo:hi].all())
        out.append(flat[lo:hi].astype(np.int64) if usable else None)
    return out


def read_pages(batch: pa.RecordBatch) -> Iterator[list[str]]:
    """The ordered lines of every row; none for a null or empty text."""
    xs, ys = _slices(batch.column("xs")), _slices(batch.column("ys"))
    for text, x, y in zip(batch.column("text").to_pylist(), xs, ys):
        if not text:
            yield []
        elif x is None or y is None or len(x) != len(y):
            yield ordered_lines(text, None, None)
        else:
            yield ordered_lines(text, x, y)


def grams(stream: str, k: int) -> np.ndarray:
    """64-bit hashes of all ``k`` letters in a row."""
    codes = np.frombuffer(stream.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h
