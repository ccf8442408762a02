"""JSON messages of the form ``{"data": {...}}``, as batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

HIT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("domain", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("screen_x", T.LongType()),
        T.StructField("screen_y", T.LongType()),
        T.StructField("os", T.StringType()),
        T.StructField("browser", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("is_page_view", T.BooleanType()),
    ]
)

HIT_KEYS = ("domain", "session_id", "ts")

# Messages carry microseconds; the default form would cut them to milliseconds.
_TIME_FORMAT = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}


def to_envelope(df: DataFrame, *, name: str = "value") -> DataFrame:
    """One message per row; works on a stream as on a table."""
    return df.select(F.to_json(F.struct(F.struct(*df.columns).alias("data")), _TIME_FORMAT).alias(name))


def open_envelope(messages: DataFrame, schema: T.StructType, *, name: str = "value") -> DataFrame:
    """Parsed fields beside the raw text; a message that is no JSON gives null fields."""
    body = T.StructType([T.StructField("data", schema)])
    # unfolding a one-element array keeps filters on the fields above the parser, which
    # would otherwise run once per filter and once more for the output
    message = F.explode(F.array(F.from_json(name, body, _TIME_FORMAT)["data"]))
    parsed = messages.select(F.col(name).alias("_raw"), message.alias("_m"))
    return parsed.select("_raw", *[F.col(f"_m.{f.name}").alias(f.name) for f in schema.fields])


def split_bad_records(
    messages: DataFrame, schema: T.StructType = HIT_SCHEMA, keys: tuple[str, ...] = HIT_KEYS, *, name: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the raw text of messages without a usable key (the dead letters).

    A store outage is no bad record: the task fails, Spark retries it, and a stopped
    stream replays the batch from its checkpoint.
    """
    opened = open_envelope(messages, schema, name=name)
    usable = F.lit(True)
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    good = opened.where(usable).drop("_raw")
    dead = opened.where(~usable).select(F.col("_raw").alias("message"))
    return good, dead


def read_messages(spark: SparkSession, path: str, *, max_files: int | None = None) -> DataFrame:
    """Stream of message texts from a folder of line files."""
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def read_hits(
    spark: SparkSession, path: str, schema: T.StructType = HIT_SCHEMA, *, max_files: int | None = None
) -> DataFrame:
    """Stream of parsed hits from a folder of message files; dead letters are left out."""
    good, _ = split_bad_records(read_messages(spark, path, max_files=max_files), schema)
    return good


def write_messages(stream: DataFrame, path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """A stream of rows as message files under ``path``.

    The sink lists the files of each finished batch in a manifest of its own, which every reader of the
    folder goes by, ``read_messages`` included: what a failed batch left is not seen, and a batch that
    is replayed after it was listed is not written again.
    """
    writer = to_envelope(stream).writeStream.format("text").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
