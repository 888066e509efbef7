"""Score arriving rows with a saved model (Structured Streaming).

The original's "real-time inference" was a one-row form; here a fitted
``PipelineModel`` is applied to a file stream and every input row is
logged together with its prediction (and class probability) to a Parquet
sink.  The query is stateless — no watermark, no aggregation — so each
micro-batch is a narrow map; exactly-once output comes from the file sink
plus the checkpoint in the shared checkpoint folder, which also lets a
restarted query resume after executor or driver loss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.session import scratch_dir


def scored_stream(model: PipelineModel, stream: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """The streaming DataFrame of inputs + ``prediction`` (+ decoded label,
    ``confidence``) — usable with any sink."""
    out = model.transform(stream)
    cols = list(keep) if keep is not None else list(stream.columns)
    cols.append("prediction")
    if "predicted_label" in out.columns:
        cols.append("predicted_label")
    if "probability" in out.columns:
        out = out.withColumn("confidence", F.array_max(vector_to_array("probability")))
        cols.append("confidence")
    return out.select(*cols).withColumn("scored_at", F.current_timestamp())


def start_score_stream(spark: SparkSession, model: PipelineModel, source_path: str, schema: T.StructType,
                       sink_path: str, checkpoint_path: str | None = None, keep: Sequence[str] | None = None,
                       max_files_per_trigger: int | None = None, available_now: bool = True,
                       processing_time: str | None = None) -> StreamingQuery:
    """Start the scoring query: Parquet files arriving under
    ``source_path`` → model → Parquet files under ``sink_path``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_path)
    w = (scored_stream(model, stream, keep).writeStream.format("parquet")
         .option("path", sink_path)
         .option("checkpointLocation", checkpoint_path or scratch_dir(spark, "score-stream-ckpt"))
         .outputMode("append"))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def score_stream(spark: SparkSession, model: PipelineModel, source_path: str, schema: T.StructType,
                 sink_path: str | None = None, keep: Sequence[str] | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Run the scoring stream over everything that has arrived
    (``availableNow``) and return the sink as a batch DataFrame.  A micro-batch
    takes four files for each task slot unless told otherwise: with fewer files
    than slots most of the cluster would wait for the batch to end."""
    max_files_per_trigger = max_files_per_trigger or 4 * spark.sparkContext.defaultParallelism
    sink = sink_path or scratch_dir(spark, "score-stream-out")
    q = start_score_stream(spark, model, source_path, schema, sink, keep=keep,
                           max_files_per_trigger=max_files_per_trigger)
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(sink)
