"""Queries for problems 1 and 5 to 8; and the same in SQL where SQL can say it."""

from __future__ import annotations

import os
from fractions import Fraction
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changelog import current_state
from ..sources.tables import reader
from ..storage import materialize, side_by_side
from .cooccurrence import cooccurring_pairs
from .leaks import leaked_passages
from .mixing import mixed_pages, source_plan, with_token_counts, word_count
from .repetition import cutoffs, repeated_share, repetitive_pages
from .set_joins import expand, link_counts, similar_sets

MIN_TOGETHER, MIN_LIFT = 6, 5
TOKENIZER = os.environ.get("NESTWORK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")  # a byte-level BPE of 50,256 tokens
TOKEN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # the vocabulary's own
SIMILAR, MIN_SET = Fraction(3, 5), 5


def _media_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_state(reader(spark, sf_dir)("playlist_media"), ["id"], ["playlist_id", "media_id"])
    return rows.filter("media_id >= 1").select("playlist_id", "media_id")


def _tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_state(reader(spark, sf_dir)("playlist_tag"), ["playlist_id", "user_tag_id"], [])
    return rows.filter("user_tag_id >= 1").select("playlist_id", "user_tag_id")


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cooccurring_pairs(_media_sets(spark, sf_dir), "playlist_id", "media_id", MIN_TOGETHER, MIN_LIFT)
    return found.withColumnsRenamed({"item_a": "media_a", "item_b": "media_b"})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_scores(spark, sf_dir).select("media_a", "media_b")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(kind: str, rows: DataFrame, item: str) -> DataFrame:
        links, members = similar_sets(rows, "playlist_id", item, SIMILAR, MIN_SET)
        found = expand(links, members)
        return found.select(F.lit(kind).alias("kind"), F.col("rec_a").alias("playlist_a"), F.col("rec_b").alias("playlist_b"))

    kinds = (("media", _media_sets(spark, sf_dir), "media_id"), ("tags", _tag_sets(spark, sf_dir), "user_tag_id"))
    media, tags = side_by_side(partial(one, *k) for k in kinds)
    return media.unionByName(tags)


def p5_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per playlist with media: the smallest playlist of the same set, and how many other sets it is like."""
    rows = materialize(_media_sets(spark, sf_dir), "media-sets")
    links, members = similar_sets(rows, "playlist_id", "media_id", SIMILAR, MIN_SET)
    out = link_counts(rows, links, members, "playlist_id")
    return out.select(F.col("rec").alias("playlist_id"), F.col("id").alias("set_id"), "n_links")


def p6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = reader(spark, sf_dir)
    return leaked_passages(get("documents"), get("eval_item"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_runs(spark, sf_dir).select("doc_id", "item_id")


def _item_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.col("text"), r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    return reader(spark, sf_dir)("eval_item").select("item_id", "text", words.alias("ws"))


def p6_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made of the items, whole and with a foreign word after every 19 of theirs: only the whole ones hold a run."""
    items = _item_words(spark, sf_dir)
    broken = F.array_join(F.flatten(F.transform("ws", lambda w, i: F.when(i % 19 == 18, F.array(w, F.lit("q" * 24))).otherwise(F.array(w)))), " ")
    whole = items.select((F.col("item_id") * 2).alias("doc_id"), "text")
    pages = whole.unionByName(items.select((F.col("item_id") * 2 + 1).alias("doc_id"), broken.alias("text")))
    return leaked_passages(pages, reader(spark, sf_dir)("eval_item"), boxes=None).select("doc_id", "item_id")


def p8_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made of the items, once and twice in a row: only the latter repeat themselves."""
    items = reader(spark, sf_dir)("eval_item")
    page = lambda odd, text: items.select((F.col("item_id") * 2 + odd).alias("doc_id"), text.alias("text"), "lang")
    pages = page(0, F.col("text")).unionByName(page(1, F.concat_ws("\n", "text", "text")))
    return repetitive_pages(pages, boxes=None).select("doc_id")


def _sized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader(spark, sf_dir)("documents").select("doc_id", "source", word_count("text").alias("size"))


def p7_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = source_plan(_sized_pages(spark, sf_dir), reader(spark, sf_dir)("mix_target"))
    return plan.select("source", "size", "total", "wanted", "short")


def p7_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn pages, sized in tokens of a public tokenizer."""
    get = reader(spark, sf_dir)
    pages = with_token_counts(get("documents").select("doc_id", "source", "text"), "text", TOKENIZER, TOKEN_PATTERN)
    return mixed_pages(materialize(pages, "token-counts"), get("mix_target"))[0]


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixed_pages(materialize(_sized_pages(spark, sf_dir), "page-sizes"), reader(spark, sf_dir)("mix_target"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p7_drawn_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: whether the mix falls short, and whether the pages drawn are as many as are expected, but for less than one."""
    expected = source_plan(_sized_pages(spark, sf_dir), reader(spark, sf_dir)("mix_target"))
    expected = expected.select("source", (F.col("copies") * F.col("n_pages")).alias("n"))
    found = p7_report(spark, sf_dir).join(expected, "source")
    return found.select("source", "weight", "wanted", "short", (F.abs(F.col("n_drawn") - F.col("n")) < 1 + 1e-9).alias("held"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that the mix, drawn in words, did not fill although it used all their pages as often as allowed."""
    return p7_report(spark, sf_dir).filter("short").select("source")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_share(reader(spark, sf_dir)("documents"))


def p8_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoffs(reader(spark, sf_dir)("documents"))[0]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetitive_pages(reader(spark, sf_dir)("documents")).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_scores": p1_scores,
    "p5_found": p5_found,
    "p5_link_counts": p5_link_counts,
    "p6_found": p6_found,
    "p6_runs": p6_runs,
    "p6_planted": p6_planted,
    "p7_found": p7_found,
    "p7_plan": p7_plan,
    "p7_draw": p7_draw,
    "p7_report": p7_report,
    "p7_drawn_counts": p7_drawn_counts,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
    "p8_cutoffs": p8_cutoffs,
    "p8_planted": p8_planted,
}

_STATE = """select {cols} from (select *, row_number() over (partition by {keys} order by change_seq desc, arrived_at) as rn
  from {table}) where rn = 1 and not (op is null or lower(trim(op)) like 'd%')"""
_MEDIA = _STATE.format(cols="playlist_id as p, media_id as m", keys="id", table="playlist_media")
_MEDIA = f"select distinct p, m from ({_MEDIA}) where p is not null and m >= 1"
_TAGS = _STATE.format(cols="playlist_id as p, user_tag_id as m", keys="playlist_id, user_tag_id", table="playlist_tag")
_TAGS = f"select distinct p, m from ({_TAGS}) where p is not null and m >= 1"

_P1 = f"""with b as materialized ({_MEDIA}), f as (select m, count(*) as n from b group by m),
  pr as (select x.m as a, y.m as b, count(*) as n_ab from b x join b y on x.p = y.p and x.m < y.m group by all having count(*) >= {MIN_TOGETHER}),
  t as (select count(distinct p) as n from b)
  select pr.a as media_a, pr.b as media_b, n_ab, fa.n as n_a, fb.n as n_b, t.n as n_baskets,
    n_ab::double * t.n / (fa.n::double * fb.n) as lift,
    case when fa.n > n_ab then (t.n::double - fb.n) * fa.n / (t.n::double * (fa.n - n_ab)) end as conviction
  from pr join f fa on fa.m = pr.a join f fb on fb.m = pr.b cross join t where n_ab * t.n >= {MIN_LIFT} * fa.n * fb.n"""


def _p5_pairs(sets: str) -> str:
    return f"""select x.p as pa, y.p as pb, any_value(x.n) as na, any_value(y.n) as nb, count(*) as both_ from
      (select p, m, count(*) over (partition by p) as n from ({sets})) x join
      (select p, m, count(*) over (partition by p) as n from ({sets})) y on x.m = y.m and x.p < y.p
      where x.n >= {MIN_SET} and y.n >= {MIN_SET} group by x.p, y.p
      having 5 * count(*) >= 3 * (any_value(x.n) + any_value(y.n) - count(*))"""


_P7 = """select source, size, total, weight * total::double as wanted, max_repeat * size < weight * total::double as short from
  (select m.source, m.weight, m.max_repeat, coalesce(d.size, 0)::bigint as size, t.total
   from mix_target m cross join (select sum(len(regexp_extract_all(text, '\\S+')))::bigint as total from documents) t
   left join (select lower(trim(source)) as k, sum(len(regexp_extract_all(text, '\\S+')))::bigint as size from documents group by 1) d
     on d.k = lower(trim(m.source)))"""

SQL = {
    "p1_found": f"select media_a, media_b from ({_P1})",
    "p1_scores": _P1,
    "p5_found": " union all ".join(
        f"select '{k}' as kind, pa as playlist_a, pb as playlist_b from ({_p5_pairs(s)})" for k, s in (("media", _MEDIA), ("tags", _TAGS))
    ),
    "p5_link_counts": f"""with s as materialized (select p, list_sort(list(m)) as a from ({_MEDIA}) group by p),
      c as (select p, case when len(a) >= {MIN_SET} then min(p) over (partition by a) else p end as id from s),
      l as (select distinct ca.id as ida, cb.id as idb from ({_p5_pairs(_MEDIA)}) r join c ca on ca.p = r.pa join c cb on cb.p = r.pb where ca.id <> cb.id),
      e as (select ida as id, idb as o from l union select idb, ida from l),
      k as (select id, count(*) as n from e group by id)
      select c.p as playlist_id, c.id as set_id, coalesce(k.n, 0) as n_links from c left join k on c.id = k.id""",
    "p6_planted": r"""select item_id * 2 as doc_id, item_id from eval_item
      where len([w for w in regexp_split_to_array(text, '\s+') if regexp_matches(w, '[\p{L}\p{N}]')]) >= 20""",
    "p8_planted": "select item_id * 2 + 1 as doc_id from eval_item where trim(text) <> ''",
    "p7_found": f"select source from ({_P7}) where short",
    "p7_plan": _P7,
    "p7_drawn_counts": f"select source, weight, wanted, short, true as held from ({_P7.replace('select source,', 'select source, weight,', 1)})",
}
