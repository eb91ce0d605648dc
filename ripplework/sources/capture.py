"""Trade-message capture: JSON lines ``{"recv_ts": .., "msg": {..}}`` into typed rows and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRADE_TYPE = "last_trade_price"

MESSAGE_FIELDS = (
    "event_type",
    "asset_id",
    "timestamp",
    "price",
    "market",
    "size",
    "fee_rate_bps",
    "side",
    "transaction_hash",
)

CAPTURE_SCHEMA = T.StructType(
    [
        T.StructField("recv_ts", T.DoubleType()),
        T.StructField("msg", T.StructType([T.StructField(f, T.StringType()) for f in MESSAGE_FIELDS])),
    ]
)


def read_capture_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with a sortable position; a text split is read by one task in file order."""
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("pos"),
    )


def parse_capture(lines: DataFrame, line: str = "line") -> DataFrame:
    """Classify every non-blank line as ``trade``, ``skipped`` or ``bad`` and extract trade fields.

    A line is bad when it is not a JSON object with a ``msg`` key, or when a trade message has an
    unusable timestamp or an ``asset_id`` that is not a string. Other message types are skipped.
    """
    text = F.trim(F.regexp_replace(F.col(line), r"[\r\n\t]+", " "))
    # as generated rows these are worked out once a line; as columns a filter on a field would parse the line for every mention
    kept = lines.select("*", F.explode(F.array(text)).alias("_text")).where("_text != ''")
    doc = kept.select("*", F.explode(F.array(F.try_parse_json("_text"))).alias("_doc")).drop("_text")
    doc = doc.select("*", F.explode(F.array(F.expr("try_variant_get(_doc, '$.msg', 'variant')"))).alias("_msg"))

    def field(name: str, kind: str) -> str:
        return f"try_variant_get(_msg, '$.{name}', '{kind}')"

    def type_of(expr: str) -> str:
        return f"schema_of_variant({expr})"

    is_object = f"coalesce({type_of('_msg')} LIKE 'OBJECT%', false)"
    is_trade = (
        f"{is_object} AND coalesce({type_of(field('event_type', 'variant'))} = 'STRING', false) "
        f"AND {field('event_type', 'string')} = '{TRADE_TYPE}'"
    )
    ts_ms = f"try_cast({field('timestamp', 'double')} AS BIGINT)"
    asset_ok = f"coalesce({type_of(field('asset_id', 'variant'))} = 'STRING', false)"
    typed = doc.withColumns(
        {
            "ts_ms": F.expr(ts_ms),
            "status": F.expr(
                f"CASE WHEN _msg IS NULL THEN 'bad' WHEN NOT ({is_trade}) THEN 'skipped' "
                f"WHEN {ts_ms} IS NULL OR NOT {asset_ok} THEN 'bad' ELSE 'trade' END"
            ),
            "recv_ts": F.expr("try_variant_get(_doc, '$.recv_ts', 'double')"),
            **{
                f: F.expr(field(f, "string"))
                for f in MESSAGE_FIELDS
                if f not in ("event_type", "timestamp")
            },
        }
    )
    return typed.drop("_doc", "_msg")


def trades(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("status") == "trade").drop("status")


def line_report(parsed: DataFrame) -> DataFrame:
    """Number of lines per status."""
    return parsed.groupBy("status").agg(F.count(F.lit(1)).alias("n_lines"))


def write_capture(messages: DataFrame, path: str) -> None:
    """Append messages in capture form; ``messages`` carries ``recv_ts`` and ``msg``."""
    messages.select("recv_ts", "msg").write.mode("append").json(path)
