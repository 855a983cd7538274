"""The fill journal and quotes as streams of files.

Checks are by row and joins are to a table, so any number of micro-batches gives the batch result; a batch that is
replayed after a failure replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from asofspark.operators.quality import quote_guard
from asofspark.sources.sinks import FILL_SCHEMA

QUOTE_SCHEMA = "symbol string, quote double"


def stream_fills(spark: SparkSession, path: str) -> DataFrame:
    """New fills as their files arrive; rows with a bad side are left to rejected_fills()."""
    return spark.readStream.schema(FILL_SCHEMA).json(path).where("side in ('BUY', 'SELL')")


def rejected_fills(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(FILL_SCHEMA).json(path).where("side not in ('BUY', 'SELL') or side is null")


def land(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to Parquet and ends; the checkpoint makes a restart go on where it stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def land_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """As land(), each micro-batch in a folder of its own number: written again, it replaces itself, so a replay adds nothing."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_quotes(spark: SparkSession, path: str) -> DataFrame:
    """New quotes (symbol, quote) as their files arrive."""
    return spark.readStream.schema(QUOTE_SCHEMA).json(path)


def guarded_quotes(quotes: DataFrame, closes: DataFrame) -> DataFrame:
    """quote_guard() of a stream against a table (symbol, close, intraday), one row a symbol; a symbol that isn't in it keeps its quote."""
    return quote_guard(quotes.join(closes, "symbol", "left"))
