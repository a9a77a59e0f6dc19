"""Mixing sources to target weights by pivotal dependent rounding.

A source with target share ``weight`` of a mix of size T uses each of its pages
``f = min(max_repeat, weight * T / size of the source)`` times: ``floor(f)`` times for certain, and once
more with the fractional probability. The fractions are rounded by pivotal sampling: two pages at a
time, one takes mass from the other by chance until one of them is 0 or 1, so the number of copies of
a source varies by less than one. Each task rounds its own pages, in order of size, and leaves at most
one fraction per source; these residuals are combined by a reduction tree of fan-in ``FAN_IN``.

Every duel has a random number of its own, a hash of the seed, both pages and the duel's place; a
fraction that is left alone is decided by yet another one. So a task that runs again decides alike,
and every page is used ``f`` times in expectation. Which pages meet depends on how the input is
divided into tasks: other files with the same rows give another draw of the same law.

Defined results: sources compare ignoring case and outer blanks; pages whose source has no target (or
is null) count in T but are not drawn; a target without pages has size 0; a null size counts as 0; a
null ``max_repeat`` or weight is 0; a page id that occurs twice is two pages; targets that compare
equal are filled one by one from the same pages. Sources are few
(``mix_target`` is a fixed table), so their statistics are broadcast after a check of their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

FAN_IN, FEW = 64, 100_000


def word_count(text: str) -> Column:
    """Pieces between blanks and line breaks; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes, pattern: str):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(pages: DataFrame, text: str, path: str, pattern: str, out: str = "size") -> DataFrame:
    """``pages`` with the number of tokens of ``text`` under the byte-level BPE ranks in ``path``; ``text`` is dropped.

    The vocabulary is read by the driver and sent to the executors; it is a megabyte or two.
    """
    pages = pages.select(*(c for c in pages.columns if c != out or c == text))  # an older column of that name gives way
    schema = f"{pages.drop(text).schema.toDDL()}, `{out}` bigint" if len(pages.columns) > 1 else f"`{out}` bigint"
    with open(path, "rb") as f:
        vocabulary = pages.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary.value, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(text).to_pylist()]
            kept = [i for i, c in enumerate(batch.schema.names) if c != text]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(n, pa.int64())], [*(batch.schema.names[i] for i in kept), out]
            )

    return pages.mapInArrow(count, schema)


def source_plan(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target, as written: ``source, key, weight, max_repeat, size, n_pages, total, wanted, copies, short``.

    ``copies`` is the expected number of times each page is used; ``short`` says that even
    ``max_repeat`` times all pages are less than ``wanted = weight * total``. ``pages`` has ``source``
    and ``size``.
    """
    sizes = pages.groupBy(F.lower(F.trim("source")).alias("key")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_pages")
    )
    sizes = materialize(sizes, "source-sizes")
    total = int(sizes.agg(F.sum("size")).first()[0] or 0)
    want = targets.select(
        "source",
        F.lower(F.trim("source")).alias("key"),
        F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight"),
        F.greatest(F.coalesce("max_repeat", F.lit(0)), F.lit(0)).cast("int").alias("max_repeat"),
    )
    known = want.join(sizes, "key", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("size", "n_pages")})
    wanted = F.col("weight") * F.lit(total).cast("double")
    return known.select(
        "source",
        "key",
        "weight",
        "max_repeat",
        "size",
        "n_pages",
        F.lit(total).cast("long").alias("total"),
        wanted.alias("wanted"),
        F.when(F.col("size") > 0, F.least(F.col("max_repeat").cast("double"), wanted / F.col("size"))).otherwise(0.0).alias("copies"),
        (F.col("max_repeat") * F.col("size") < wanted).alias("short"),
    )


_MASK = 2**64 - 1


def chance(*parts: int) -> float:
    """A number in [0, 1) that the given ones decide."""
    x = 0x9E3779B97F4A7C15
    for part in parts:
        x = (x ^ (part & _MASK)) * 0xBF58476D1CE4E5B9 & _MASK
        x = (x ^ (x >> 29)) * 0x94D049BB133111EB & _MASK
        x ^= x >> 32
    return (x >> 11) / 2.0**53


def _pivot(rows: list[tuple[int, float, int]], place: int) -> tuple[list[tuple[int, int]], tuple[int, float] | None]:
    """``(index, probability, hash)`` in order to decisions ``(index, 0 or 1)`` and what stays fractional.

    ``place`` tells the calls of one draw apart.
    """
    out: list[tuple[int, int]] = []
    left: tuple[int, float, int] | None = None
    for duel, (i, p, h) in enumerate(rows):
        if p <= 1e-12 or p >= 1 - 1e-12:
            out.append((i, int(p > 0.5)))
            continue
        if left is None:
            left = (i, p, h)
            continue
        j, q, g = left
        u = chance(h, g, place, duel)
        if p + q < 1:
            (keep, k), drop = ((i, h), j) if u * (p + q) < p else ((j, g), i)
            out.append((drop, 0))
            left = (keep, p + q, k)
        else:
            # one becomes 1, the other keeps p + q - 1
            one, (other, k) = (i, (j, g)) if u * (2 - p - q) < 1 - q else (j, (i, h))
            out.append((one, 1))
            left = (other, p + q - 1, k)
        if left[1] <= 1e-12 or left[1] >= 1 - 1e-12:
            out.append((left[0], int(left[1] > 0.5)))
            left = None
    return out, left[:2] if left else None


def _round(rows: pd.DataFrame, place: int) -> pd.DataFrame:
    """Rounds ``p`` within each source; at most one row of a source keeps a fraction."""
    rows = rows.sort_values(["source", "size", "doc_id"], kind="stable").reset_index(drop=True)
    p = rows["p"].to_numpy(copy=True)
    hashes = rows["h"].to_numpy()
    for places in rows.groupby("source", sort=False).indices.values():
        done, left = _pivot([(i, p[i], h) for i, h in zip(places.tolist(), hashes[places].tolist())], place)
        for i, v in done:
            p[i] = v
        if left:
            p[left[0]] = left[1]
    return rows.assign(p=p)


def _round_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rounds batch by batch; a source's fraction waits for the source's next batch, or is the task's residual."""
    left: dict[str, pd.DataFrame] = {}
    for place, frame in enumerate(frames):
        met = [left.pop(x) for x in frame["source"].unique().tolist() if x in left]
        both = _round(pd.concat([*met, frame], ignore_index=True) if met else frame, place)
        open_ = (both["p"] > 0) & (both["p"] < 1)
        yield both[~open_]
        left |= {row["source"].iloc[0]: row for row in (both.iloc[[i]] for i in open_.to_numpy().nonzero()[0])}
    if left:
        yield pd.concat(left.values(), ignore_index=True)


def mixed_pages(pages: DataFrame, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The draw and its report, from ``pages`` (``doc_id, source, size``) and ``targets``.

    The draw: ``doc_id, source`` (as in the target), ``size, copies`` of every page used at least once. The report, one row
    per target: ``source, weight, n_drawn`` (pages drawn, with their repeats), ``drawn`` (size drawn), ``share`` (of all that
    was drawn), ``wanted, short``: every page of the source was drawn ``max_repeat`` times, and that is less than wanted.
    """
    plan = source_plan(pages, targets)
    few = plan.filter("copies > 0").select("key", F.col("source").alias("target"), F.col("copies").alias("f"), "max_repeat")
    if few.count() > FEW:
        raise ValueError(f"more than {FEW} sources have a target")
    base = pages.select(
        "doc_id", F.lower(F.trim("source")).alias("key"), F.coalesce("size", F.lit(0)).cast("long").alias("size")
    ).join(F.broadcast(few), "key")
    low = F.floor("f")
    base = base.select(
        "doc_id",
        F.col("target").alias("source"),
        "size",
        "max_repeat",
        low.alias("low"),
        (F.col("f") - low).alias("p"),
        F.xxhash64(F.lit(seed), "doc_id", "size", "target").alias("h"),
    )
    schema = base.schema.toDDL()

    level = materialize(base.mapInPandas(_round_task, schema), "mix-level")
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    done, rest = level.filter(~open_), level.filter(open_)
    depth = 0
    while True:
        per = rest.groupBy("source").agg(F.count(F.lit(1)).alias("n"))  # FEW rows at most
        most = per.agg(F.max("n")).first()[0]
        depth += 1
        again = F.xxhash64(F.lit(seed), F.lit(depth), "h")
        if (most or 0) <= 1:  # one fraction per source: decided by its own chance
            own = F.shiftrightunsigned(again, 11) / float(2**53)
            done = done.unionByName(rest.withColumn("p", (own < F.col("p")).cast("double")))
            break
        node = F.pmod(again, F.ceil(F.col("n") / FAN_IN)).alias("node")
        nodes = rest.join(F.broadcast(per), "source").groupBy("source", node).applyInPandas(_tree_node(-depth), schema)
        level = materialize(nodes, "mix-level")
        done, rest = done.unionByName(level.filter(~open_)), level.filter(open_)
    copies = (F.col("low") + F.round("p")).cast("long")
    drawn = done.select("doc_id", "source", "size", "max_repeat", copies.alias("copies")).filter("copies > 0")
    used = drawn.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("drawn"),
        F.sum("copies").alias("n_drawn"),
        F.count_if(F.col("copies") >= F.col("max_repeat")).alias("n_full"),
    )
    used = materialize(used, "mix-used")
    whole = int(used.agg(F.sum("drawn")).first()[0] or 0)
    report = plan.join(F.broadcast(used), "source", "left")
    report = report.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("drawn", "n_drawn", "n_full")})
    every = (F.col("max_repeat") == 0) | (F.col("n_full") == F.col("n_pages"))
    return drawn.drop("max_repeat"), report.select(
        "source",
        "weight",
        "n_drawn",
        "drawn",
        (F.col("drawn") / F.lit(float(max(1, whole)))).alias("share"),
        "wanted",
        (every & (F.col("drawn") < F.col("wanted"))).alias("short"),
    )


def _tree_node(place: int):
    return lambda rows: _round(rows.drop(columns="n"), place)
