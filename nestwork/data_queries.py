"""Queries for problems 2 to 4: references, change application, heavy keys; and the same in SQL."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.lsm import from_log
from .operators.orphans import Reference, orphan_references, orphan_totals
from .operators.skew import eager_join_aggregate, key_counts
from .operators.changelog import current_state
from .sources.tables import reader
from .storage import side_by_side

REFERENCES = [
    Reference("playlist", ("id",), "id", "user_id", "users", "user_id"),
    Reference("playlist_media", ("id",), "id", "media_id", "media", "id", "lower(trim(status)) = 'deleted'"),
    Reference("playlist_tag", ("playlist_id", "user_tag_id"), "playlist_id", "user_tag_id", "user_tag", "id"),
]
LOG_KEYS = {"playlist": "id", "playlist_media": "id", "users": "user_id"}
LOG_FIELDS = {
    "playlist": ["active", "user_id", "type", "title"],
    "playlist_media": ["playlist_id", "pos", "media_id"],
    "users": ["user_name", "email", "usage_type"],
}
HEAVY_SHARE = 0.02


def _p2_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    get = reader(spark, sf_dir)
    return {t: get(t) for r in REFERENCES for t in (r.table, r.target)}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(_p2_tables(spark, sf_dir), REFERENCES)


def p2_orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_totals(_p2_tables(spark, sf_dir), REFERENCES)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole records are rebuilt in the merge tables; keys and deciding changes of the live ones are reported."""
    get = reader(spark, sf_dir)

    def one(t: str, k: str) -> DataFrame:
        state = from_log(get(t), [k], LOG_FIELDS[t]).read()
        return state.select(F.lit(t).alias("tab"), F.col(k).cast("long").alias("rec_id"), F.col("change_seq").cast("long").alias("change_seq"))

    return reduce(DataFrame.unionByName, side_by_side(partial(one, t, k) for t, k in LOG_KEYS.items()))


def p3_playlist_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole current records of ``playlist``, delivered by time of arrival, with compactions between the batches."""
    log = reader(spark, sf_dir)("playlist")
    return from_log(log, ["id"], LOG_FIELDS["playlist"], runs=8, max_runs=3).read()


def p3_entry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole current entries, in the order of arrival in ten batches, compacted after every other one."""
    log = reader(spark, sf_dir)("playlist_media")
    return from_log(log, ["id"], LOG_FIELDS["playlist_media"], runs=10, max_runs=2).read()


def _p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = reader(spark, sf_dir)
    one = lambda t, c: get(t).select(F.lit(t).alias("tab"), F.col(c).cast("long").alias("key_id"))
    return one("playlist", "user_id").unionByName(one("playlist_media", "media_id"))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_counts(_p4_rows(spark, sf_dir), "tab", "key_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        p4_counts(spark, sf_dir)
        .filter(F.col("n") * round(1 / HEAVY_SHARE) >= F.col("total"))
        .select("tab", "key_id")
    )


def p4_owner_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per owner: playlists with entries, entries, and the sum of their positions, by eager aggregation."""
    get = reader(spark, sf_dir)
    lists = current_state(get("playlist"), ["id"], ["user_id"]).select(F.col("id").alias("playlist_id"), "user_id")
    entries = current_state(get("playlist_media"), ["id"], ["playlist_id", "pos"]).select("playlist_id", "pos")
    out = eager_join_aggregate(
        lists, entries, ["playlist_id"], left_by=["user_id"], right_sums={"sum_pos": F.col("pos").cast("long")}
    )
    return out.select(
        "user_id", F.col("n_left").alias("n_playlists"), F.col("n_pairs").cast("long").alias("n_entries"), "sum_pos"
    )


QUERIES = {
    "p2_found": p2_found,
    "p2_orphan_counts": p2_orphan_counts,
    "p3_found": p3_found,
    "p3_playlist_state": p3_playlist_state,
    "p3_entry_state": p3_entry_state,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p4_owner_rollup": p4_owner_rollup,
}


def state_sql(table: str, keys: str, values: str, dead: bool = False) -> str:
    """SQL for the deciding changes of a log; only the live ones unless ``dead``."""
    every = f"""select * from (select {keys}, {values}, change_seq, ts,
        (op is null or lower(trim(op)) like 'd%') as is_deleted,
        row_number() over (partition by {keys} order by change_seq desc, arrived_at) as rn,
        min(case when not (op is null or lower(trim(op)) like 'd%') then arrived_at end) over (partition by {keys}) as first_seen,
        arrived_at as first_arrival
      from {table}) where rn = 1"""
    return every if dead else f"select * from ({every}) where not is_deleted"


def _p2_sql() -> str:
    parts = []
    for r in REFERENCES:
        gone = f"coalesce({r.gone}, false)" if r.gone else "false"
        values = ", ".join(c for c in (r.rec_id, r.ref) if c not in r.keys) or "op"
        target = "status" if r.gone else "op"
        parts.append(f"""select '{r.table}' as tab, s.{r.rec_id} as rec_id, s.{r.ref} as ref_id,
          case when t.{r.target_key} is null then 'missing' when t.is_deleted or {gone} then 'deleted'
               when t.first_seen > s.first_arrival then 'late' end as fault,
          coalesce(strftime(s.ts at time zone 'UTC', '%Y-%m'), 'unknown') as period
        from ({state_sql(r.table, ", ".join(r.keys), values)}) s
        left join ({state_sql(r.target, r.target_key, target, dead=True)}) t on s.{r.ref} = t.{r.target_key}
        where s.{r.ref} is not null""")
    return f"select * from ({' union all '.join(parts)}) where fault is not null"


_P4 = """select tab, key_id, count(*) as n, sum(count(*)) over (partition by tab)::bigint as total from (
  select 'playlist' as tab, user_id as key_id from playlist union all
  select 'playlist_media', media_id from playlist_media) where key_id is not null group by tab, key_id"""

SQL = {
    "p2_found": _p2_sql(),
    "p2_orphan_counts": f"""select tab, period, fault, count(*) as n, count(distinct ref_id) as n_keys
      from ({_p2_sql()}) group by all""",
    "p3_found": " union all ".join(
        f"select '{t}' as tab, {k} as rec_id, change_seq from ({state_sql(t, k, 'op')})" for t, k in LOG_KEYS.items()
    ),
    "p3_playlist_state": f"select id, change_seq, active, user_id, type, title from ({state_sql('playlist', 'id', 'active, user_id, type, title')})",
    "p3_entry_state": f"select id, change_seq, playlist_id, pos, media_id from ({state_sql('playlist_media', 'id', 'playlist_id, pos, media_id')})",
    "p4_found": f"select tab, key_id from ({_P4}) where n * 50 >= total",
    "p4_counts": _P4,
    "p4_owner_rollup": f"""select p.user_id, count(distinct p.id) as n_playlists, count(*) as n_entries, sum(m.pos)::bigint as sum_pos
      from ({state_sql('playlist', 'id', 'user_id')}) p join ({state_sql('playlist_media', 'id', 'playlist_id, pos')}) m
        on p.id = m.playlist_id group by p.user_id""",
}
