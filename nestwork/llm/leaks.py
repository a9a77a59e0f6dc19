"""Held-out texts in a corpus: which pages contain a run of consecutive words of an item.

A prefix-filtered set join on shingles of ``SHINGLE`` letters of the folded stream (letters, not
words, so that broken words don't matter). An item-sized window is ``run`` consecutive words of an
item; a page that contains it keeps at least ``KEPT`` of the window's shingles through misread
letters. Per window the shingles are ordered by rarity over all pages; a containing page must hold at
least ``l`` of the rarest ``n - kept + l``, so only these tokens are joined, with ``l`` a third of the
kept. A bound on the number of the hits precedes the join; every candidate is verified by aligning
item and page letter by letter. The hits may lie anywhere on the page, however long the
interruptions between them; the first and last word of a run must stand as words on the page.

The items' shingles go to the executors in blocks of at most ``MOST_SHINGLES`` (a size that is
checked); each block is held against all pages, which are read and folded once, so there may be any number of
items.

Defined results: null or empty texts contain nothing; an item of fewer than ``run`` words is
contained nowhere; equal items are all reported; repeated rows give repeated results. Other columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .pages import fold, grams, page_columns, read_pages

SHINGLE, SEED, KEPT, MOST_SHINGLES = 12, 5, 0.5, 2_000_000
NOISE, SHIFT, AT_EDGE = 14, 2, 6  # letters: bridged as misread, length change, slack at a line's end


class Item:
    """An item's letters, word bounds, and where its seeds are."""

    def __init__(self, text: str):
        words = fold(text or "").split()
        self.letters = "".join(words)
        self.ends = np.cumsum([len(w) for w in words]).tolist() if words else []
        self.begins = [0, *self.ends[:-1]] if words else []
        self.seeds: dict[str, list[int]] = {}
        for i in range(len(self.letters) - SEED + 1):
            self.seeds.setdefault(self.letters[i : i + SEED], []).append(i)
        self.shingles = np.sort(grams(self.letters, SHINGLE))

    def windows(self, run: int) -> list[tuple[int, int]]:
        """First and one past the last shingle of every window of ``run`` words."""
        n = len(self.letters) - SHINGLE + 1
        found = [(self.begins[i], min(n, self.ends[i + run - 1] - SHINGLE + 1)) for i in range(len(self.ends) - run + 1)]
        return [(a, b) for a, b in found if b > a]

    def least(self, run: int) -> int:
        """The fewest shingles that a page keeps of a window."""
        return kept(min((b - a for a, b in self.windows(run)), default=1 << 30))


def kept(n: int) -> int:
    return max(1, int(np.ceil(KEPT * n)))


def longest_run(item: Item, page: str, edges: list[int], bounds: list[int] | None = None) -> int:
    """Most consecutive words of ``item`` that ``page`` holds one after the other.

    Equal stretches are chained: over misread letters, where both sides advance alike, and over
    interruptions of any length that begin and end at line ends (``edges``), where only the page
    advances. The words at both ends of a run must stand between blanks or line ends (``bounds``; all
    are taken to be if it is None) with most of their letters in place.
    """
    open_: dict[int, list[int]] = {}
    blocks: list[list[int]] = []
    seeds = item.seeds
    for p in range(len(page) - SEED + 1):
        for s in seeds.get(page[p : p + SEED], ()):
            block = open_.get(p - s)
            if block is not None and block[1] + block[2] - SEED + 1 == p:
                block[2] += 1
            else:
                open_[p - s] = block = [s, p, SEED]
                blocks.append(block)

    def near(sorted_: list[int], p: int, slack: int) -> bool:
        i = bisect_left(sorted_, p - slack)
        return i < len(sorted_) and sorted_[i] <= p + slack

    def in_place(word: int, shift: int) -> bool:
        """Whether the word stands at its place moved by ``shift``, whole but for a misread letter in three."""
        lo, hi = item.begins[word], item.ends[word]
        if bounds is not None and not (near(bounds, lo + shift, 0) and near(bounds, hi + shift, 0)):
            return False
        wrong = sum(not 0 <= i + shift < len(page) or page[i + shift] != item.letters[i] for i in range(lo, hi))
        return 3 * wrong <= hi - lo

    best, longest = 0, max((b[2] for b in blocks), default=0)
    until: dict[int, list[tuple]] = {}  # the blocks so far by their end in the item
    ended: list[tuple] = []  # the same at line ends, by their end on the page, while that is still ahead
    bridged: dict[int, tuple[int, int]] = {}  # the earliest start of what ended at a line end, by its end in the item
    reach = longest + NOISE + SHIFT
    for s, p, n in blocks:
        at_edge = near(edges, p, AT_EDGE)
        while ended and ended[0][0] < p:
            _, end, start0 = heappop(ended)
            bridged[end] = min(bridged.get(end, start0), start0)
        start = (s, p - s)
        for end in range(s - NOISE, s + SEED):
            for s0, p0, n0, start0 in reversed(until.get(end, ())):
                if p0 + reach < p:
                    break
                gap_s, gap_p = s - end, p - p0 - n0
                if start0 < start and s0 < s and gap_p > -SEED and abs(gap_s - gap_p) <= SHIFT:
                    start = start0
            if at_edge and end >= s - AT_EDGE and end in bridged:
                start = min(start, bridged[end])
        until.setdefault(s + n, []).append((s, p, n, start))
        if near(edges, p + n, AT_EDGE):
            heappush(ended, (p + n, s + n, start))
        first, last = bisect_left(item.begins, start[0]), bisect_left(item.ends, s + n + 1)
        if last - first + 2 <= best:
            continue
        if first < last and not in_place(first, start[1]):
            first += 1
        elif first and in_place(first - 1, start[1]):
            first -= 1
        if first < last and not in_place(last - 1, p - s):
            last -= 1
        elif last < len(item.ends) and in_place(last, p - s):
            last += 1
        best = max(best, last - first)
    return best


def _item_shingles(run: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(batch.column("item_id"), batch.column("text").to_pylist()):
                item = Item(text)
                if item.windows(run):
                    g = grams(item.letters, SHINGLE)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item_id.as_py()] * len(g), batch.schema.field("item_id").type), pa.array(g.view(np.int64))],
                        ["item_id", "gram"],
                    )

    return make


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page with any text: its lines in reading order, folded."""
    for batch in batches:
        found = [fold("\n".join(lines)) if lines else None for lines in read_pages(batch)]
        out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "folded"])
        yield out.filter(out.column("folded").is_valid())


def _hits(known, least: int):
    """Per page: ids of the known shingles on it; its letters, line ends and words' bounds where it holds ``least`` or more."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            ids, who, streams, edges, bounds = batch.column("doc_id"), [], [], [], []
            all_ids: list[np.ndarray] = []
            for i, folded in enumerate(batch.column("folded").to_pylist()):
                parts = [x.replace(" ", "") for x in folded.split("\n")]
                stream = "".join(parts)
                g = grams(stream, SHINGLE)
                at = np.searchsorted(table, g)
                at[at == len(table)] = 0
                place = np.flatnonzero(table[at] == g)
                if not len(place):
                    continue
                who.append(i)
                all_ids.append(np.unique(at[place]).astype(np.int32))
                enough = len(place) >= least
                streams.append(stream if enough else None)
                edges.append(np.cumsum([0, *map(len, parts)]).astype(np.int32) if enough else None)
                bounds.append(np.cumsum([0, *map(len, folded.split())]).astype(np.int32) if enough else None)
            sizes = np.cumsum([0, *map(len, all_ids)]).astype(np.int32)
            flat = np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(who, pa.int64())),
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)),
                    pa.array(streams, pa.string()),
                    pa.array(edges, pa.list_(pa.int32())),
                    pa.array(bounds, pa.list_(pa.int32())),
                ],
                ["doc_id", "ids", "letters", "edges", "bounds"],
            )

    return find


def _tokens(run: int):
    """Of one item's shingles with their page counts: those that containing pages must partly hold, and how many."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        item = Item(rows["text"].iloc[0])
        g = grams(item.letters, SHINGLE).view(np.int64)
        count = dict(zip(rows["gram"], rows["n_docs"]))
        ids = dict(zip(rows["gram"], rows["gid"]))
        rarity = np.array([count[x] for x in g])
        take = np.zeros(len(g), bool)
        need = 1 << 30
        for a, b in item.windows(run):
            own, first = np.unique(g[a:b], return_index=True)
            n = len(own)
            keep = kept(n)
            many = -(-keep // 3)
            order = np.lexsort((own, rarity[a + first]))[: n - keep + many]
            take[np.isin(g, own[order])] = True
            need = min(need, many)
        chosen = sorted({ids[x] for x in g[take]})
        return pd.DataFrame({"item_id": rows["item_id"].iloc[0], "gid": np.array(chosen, np.int32), "need": need})

    return choose


def _verify(run: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: OrderedDict = OrderedDict()
        for batch in batches:
            length = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("item_id", "item_text", "letters", "edges", "bounds")))
            for item_id, text, stream, edges, bounds in rows:
                item = items.get(item_id) or items.setdefault(item_id, Item(text))
                if len(items) > 5000:
                    items.popitem(last=False)
                enough = np.isin(grams(stream, SHINGLE), item.shingles).sum() >= item.least(run)
                length.append(longest_run(item, stream, edges, bounds) if enough else 0)
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("item_id"), pa.array(length, pa.int64())], ["doc_id", "item_id", "n_words"]
            )
            yield out.filter(pa.array([n >= run for n in length]))

    return check


def leaked_passages(
    pages: DataFrame, items: DataFrame, run: int = 20, *, text: str = "text", boxes: str | None = "boxes", doc_id: str = "doc_id"
) -> DataFrame:
    """``doc_id, item_id, n_words`` of pages with at least ``run`` consecutive words of an item."""
    spark = pages.sparkSession
    items = items.select("item_id", "text")
    shingles = materialize(
        items.mapInArrow(_item_shingles(run), f"item_id {items.schema['item_id'].dataType.simpleString()}, gram long"), "item-shingles"
    )
    blocks = max(1, -(-shingles.count() // MOST_SHINGLES))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    kind = pages.schema[doc_id].dataType.simpleString()
    raw = pages.select(F.col(doc_id).alias("doc_id"), *page_columns(pages, text, boxes))
    read = _folded
    if blocks > 1:
        raw = materialize(raw.mapInArrow(_folded, f"doc_id {kind}, folded string"), "folded-pages")
        read = iter
    parts = [_block(spark, raw, read, kind, items.filter(block == i), shingles.filter(block == i), run) for i in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def _block(spark, raw: DataFrame, read: Callable, key_type: str, items: DataFrame, shingles: DataFrame, run: int) -> DataFrame:
    # at most about MOST_SHINGLES numbers: the block's size
    known = np.sort(shingles.select("gram").distinct().toPandas()["gram"].to_numpy().astype(np.int64).view(np.uint64))
    if not len(known):
        return spark.createDataFrame([], f"doc_id {key_type}, item_id {items.schema['item_id'].dataType.simpleString()}, n_words long")
    least = items.mapInArrow(_window_sizes(run), "least int").agg(F.min("least")).first()[0]
    find = _hits(spark.sparkContext.broadcast(known), least)
    hits = raw.mapInArrow(lambda batches: find(read(batches)), f"doc_id {key_type}, ids array<int>, letters string, edges array<int>, bounds array<int>")
    hits = materialize(hits, "page-hits")
    n_docs = hits.select(F.explode("ids").alias("gid")).groupBy("gid").agg(F.count(F.lit(1)).alias("n_docs"))
    gids = spark.createDataFrame(pd.DataFrame({"gram": known.view(np.int64), "gid": np.arange(len(known), dtype=np.int32)}), "gram long, gid int")
    counted = gids.join(n_docs, "gid", "left").select("gram", "gid", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
    tokens = (
        shingles.distinct()
        .join(counted, "gram")
        .join(items, "item_id")
        .groupBy("item_id", "text")
        .applyInPandas(_tokens(run), f"item_id {items.schema['item_id'].dataType.simpleString()}, gid int, need int")
    )
    tokens = materialize(tokens.distinct(), "item-tokens")
    passed = hits.filter(F.col("letters").isNotNull())
    met = passed.select("doc_id", F.explode("ids").alias("gid")).join(tokens, "gid")
    candidates = met.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).filter("n >= need")
    rows = candidates.select("doc_id", "item_id").join(passed.select("doc_id", "letters", "edges", "bounds"), "doc_id")
    rows = rows.join(items.select("item_id", F.col("text").alias("item_text")), "item_id")
    found = rows.mapInArrow(_verify(run), f"doc_id {key_type}, item_id {items.schema['item_id'].dataType.simpleString()}, n_words long")
    return found


def _window_sizes(run: int):
    """The bound of every item that has a window."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.least(run) for x in map(Item, batch.column("text").to_pylist()) if x.windows(run)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], ["least"])

    return make
