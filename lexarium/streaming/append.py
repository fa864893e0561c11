"""Indices that grow: new documents arrive as a stream and are appended with their positions and lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexarium.operators.index import length_index
from lexarium.sources.corpus import corpus_sentences, document_sentences

OFFSETS = "batch bigint, sentences bigint, tokens bigint"


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string", files_per_batch: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_index(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Length indices of arriving documents, written once each; stops when what is there has been read."""
    index = length_index(document_sentences(docs))
    return index.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def committed(spark: SparkSession, out: str) -> DataFrame:
    """OFFSETS: where each committed batch ends, in sentences and tokens; no rows before the first."""
    try:
        return spark.read.schema("sentences bigint, tokens bigint, batch bigint").parquet(f"{out}/offsets").select("batch", "sentences", "tokens")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], OFFSETS)


def append_batch(docs: DataFrame, batch: int, out: str) -> None:
    """Append a batch of documents (doc_id, text): sentences with spos and cpos that go on from the batches before, and their lengths.

    Rows are written first, under the batch's number, then the offsets that commit them. A batch that is played again,
    committed or half written, starts from the same offsets and replaces what it wrote before.
    """
    spark = docs.sparkSession
    last = committed(spark, out).where(F.col("batch") < batch).orderBy(F.desc("batch")).head(1)
    sentences, tokens = (last[0]["sentences"], last[0]["tokens"]) if last else (0, 0)
    rows = corpus_sentences(docs).select("doc_id", "line", (F.col("spos") + sentences).alias("spos"), (F.col("cpos") + tokens).alias("cpos"), F.size("words").alias("count"), "words")
    length_index(rows).write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")
    ends = spark.read.parquet(f"{out}/rows/batch={batch}").agg((F.count("*") + sentences).alias("sentences"), (F.coalesce(F.sum("count"), F.lit(0)) + tokens).alias("tokens"))
    ends.coalesce(1).write.mode("overwrite").parquet(f"{out}/offsets/batch={batch}")


def append_positions(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """append_batch() for each micro-batch of a stream of documents; stops when what is there has been read. Positions follow the order of arrival, and doc_id inside a batch."""
    return docs.writeStream.foreachBatch(lambda df, k: append_batch(df, k, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grown_index(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, line, spos, cpos, count, words, char_len, byte_len of all committed batches; a batch whose writing was cut off isn't seen."""
    batches = [r["batch"] for r in committed(spark, out).select("batch").collect()]  # one number a batch
    if not batches:
        raise ValueError(f"{out} holds no committed batch")
    return spark.read.parquet(f"{out}/rows").where(F.col("batch").isin(batches)).drop("batch")


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts; events later than the watermark are dropped by Spark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
