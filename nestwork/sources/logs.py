"""Change-logs as sources: parsed keys and values, positions, lag.

A raw log has ``key`` and ``value`` (JSON text), ``part`` and ``pos`` (partition and offset). All
changes of a key are in one partition, so its ``pos`` orders them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import encode_composite

RAW = "key string, value string, part int, pos bigint"
MEMORY_PARTITIONS = 3


def parse_record(text: Column, schema: T.StructType) -> Column:
    """JSON text as a struct. Null, blank, ``null`` and ``{}`` are null (a tombstone); text that is no
    JSON object raises when the query runs."""
    bare = F.trim(text)
    none = text.isNull() | bare.isin("", "null") | bare.rlike(r"^\{\s*\}$")
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    whole = F.try_parse_json(text).isNotNull() & bare.startswith("{")
    bad = F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring(bare, 1, 100)))
    return F.when(none, F.lit(None).cast(schema)).when(whole, parsed).otherwise(bad.cast(schema))


def key_schema(schema: T.StructType, keys: Sequence[str]) -> T.StructType:
    return T.StructType([schema[k] for k in keys])


def parse_log(raw: DataFrame, keys: Sequence[str], schema: T.StructType) -> DataFrame:
    """A raw log as changes ``pk, seq, key, value``."""
    ks = key_schema(schema, keys)
    parsed = raw.select(parse_record(F.col("key"), ks).alias("key"), parse_record(F.col("value"), schema).alias("value"), "pos")
    pk = encode_composite([(f.name, F.col("key")[f.name], f.dataType) for f in ks.fields])
    return parsed.select(pk.alias("pk"), F.col("pos").cast("long").alias("seq"), "key", "value")


def memory_log(spark: SparkSession, records: Iterable[tuple[str | None, str | None]], first: int = 0) -> DataFrame:
    """Key and value texts in order as a raw log of ``MEMORY_PARTITIONS`` hash partitions.

    Positions rise over the whole log and so in every partition.
    """
    rows = [(k, v, i + first) for i, (k, v) in enumerate(records)]
    df = spark.createDataFrame(rows, "key string, value string, pos bigint")
    return df.select("key", "value", F.pmod(F.hash("key"), F.lit(MEMORY_PARTITIONS)).alias("part"), "pos")


def as_raw_log(df: DataFrame, keys: Sequence[str], values: Sequence[str], pos: Column, deleted: Column) -> DataFrame:
    """Rows of a table as a raw log of ``MEMORY_PARTITIONS`` hash partitions, null values where ``deleted``."""
    key = F.to_json(F.struct(*keys))
    value = F.when(~F.coalesce(deleted, F.lit(False)), F.to_json(F.struct(*keys, *values)))
    return df.select(key.alias("key"), value.alias("value"), F.pmod(F.hash(key), F.lit(MEMORY_PARTITIONS)).alias("part"), pos.cast("long").alias("pos"))


def pairs_file(lines: Iterable[str]) -> list[tuple[str | None, str | None]]:
    """Alternating key and value lines; a blank value line is a tombstone."""
    texts = [x.rstrip("\n") for x in lines]
    if len(texts) % 2:
        texts.append("")
    return [(k, v if v.strip() else None) for k, v in zip(texts[::2], texts[1::2])]


def by_key(records: DataFrame, pks: DataFrame) -> DataFrame:
    """Point lookups: the records of the given keys (``pk``)."""
    return records.join(pks.select("pk").distinct(), "pk", "left_semi")


def lag(raw: DataFrame, positions: Mapping[int, int]) -> DataFrame:
    """Unread rows per partition: ``part, n``; ``positions`` holds the next position to read of each."""
    if not positions:
        return raw.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    nxt = F.create_map(*(F.lit(x) for p in positions.items() for x in p))
    unread = F.col("pos") >= F.coalesce(nxt[F.col("part")], F.lit(0))
    return raw.groupBy("part").agg(F.count_if(unread).alias("n"))


def next_positions(raw: DataFrame) -> DataFrame:
    """The position after the last row of every partition: ``part, next``."""
    return raw.groupBy("part").agg((F.max("pos") + 1).alias("next"))


# -- streams

IGNORED = {"auto.offset.reset", "enable.auto.commit"}
OWN = {"topic.class", "topic.name", "filter.class", "key.serde.class", "value.serde.class", "jackson.serde.class", "poll.timeout", "keys", "schema", "path", "key.avro.schema", "value.avro.schema"}


def kafka_options(config: Mapping[str, object]) -> dict[str, str]:
    """Options of Spark's Kafka source for a topic's configuration; positions are the checkpoint's affair."""
    client = {k: v for k, v in config.items() if k not in OWN | IGNORED and not k.startswith("schema.registry")}
    servers = str(client.pop("bootstrap.servers"))
    out = {f"kafka.{k}": str(v) for k, v in client.items() if k not in ("client.id", "group.id", "acks")}
    for name in ("topic.lag.trigger", "records.per.trigger"):  # in a topic's section either bounds what a batch reads of it
        out.pop(f"kafka.{name}", None)
        if name in config:
            out["maxOffsetsPerTrigger"] = str(config[name])
    return out | {"kafka.bootstrap.servers": servers, "subscribe": str(config["topic.name"]), "startingOffsets": "earliest"}


def kafka_stream(spark: SparkSession, config: Mapping[str, object]) -> DataFrame:
    """A topic as a streaming raw log; needs Spark's Kafka package on the class path."""
    df = spark.readStream.format("kafka").options(**kafka_options(config)).load()
    return df.select(*(record_text(F.col(x), config, x).alias(x) for x in ("key", "value")), F.col("partition").alias("part"), F.col("offset").alias("pos"))


def record_text(col: Column, config: Mapping[str, object], side: str) -> Column:
    """Bytes of a topic's ``key`` or ``value`` as JSON text. Where its serde class is one of Avro, they are read by
    ``key.avro.schema`` or ``value.avro.schema`` (the text of the schema); all others hold JSON."""
    if "avro" not in str(config.get(f"{side}.serde.class", "")).lower():
        return col.cast("string")
    name = f"{side}.avro.schema"
    if not config.get(name):
        raise ValueError(f"{name} must be given for Avro records")
    return F.to_json(avro_record(col, str(config[name])))


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """JSON-lines files of raw rows, as they appear in a folder."""
    options = {"maxFilesPerTrigger": str(files_per_trigger)} if files_per_trigger else {}
    return spark.readStream.schema(RAW).options(**options).json(path)


def avro_record(col: Column, schema: str, registry_header: bool = True) -> Column:
    """Avro bytes as a struct; with ``registry_header`` the five bytes that name a registered schema are cut.

    Needs Spark's Avro package on the class path.
    """
    from pyspark.sql.avro.functions import from_avro

    return from_avro(F.substring(col, 6, 2**31 - 1) if registry_header else col, schema)


def avro_bytes(col: Column, schema: str, registry_id: int | None = None) -> Column:
    """A struct as Avro bytes, with the header that names a registered schema if its number is given.

    Needs Spark's Avro package on the class path.
    """
    from pyspark.sql.avro.functions import to_avro

    data = to_avro(col, schema)
    return data if registry_id is None else F.concat(F.lit(bytearray(b"\0" + registry_id.to_bytes(4, "big"))), data)
