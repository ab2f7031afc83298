"""Run a streaming query over the files there are and give its output as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans import durable, shared_dir
from millrace.streaming import operators


def files_as_stream(spark: SparkSession, location: str) -> DataFrame:
    """The Parquet files at a place as a stream, times as instants in UTC."""
    schema = spark.read.parquet(location).schema
    folder, _, name = location.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, location) else spark.readStream.schema(schema).parquet(location)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def flushed(stream: DataFrame, location: str, *, time: str = "ts") -> DataFrame:
    """The stream with one more row, far later and null but for its time: it moves the watermark past all that there is.

    So windows and sessions that would wait for later rows come out; the row's own stays open.
    """
    spark = stream.sparkSession
    last = spark.read.parquet(location).agg(F.max(F.col(time).cast("timestamp")).alias("last"))
    columns = [(F.col("last") + F.expr("interval 366 days")).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    place = f"{shared_dir(spark).rstrip('/')}/last-{uuid.uuid4().hex}"
    last.filter("last is not null").select(*columns).write.parquet(place)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(place))


def _is_folder(spark: SparkSession, location: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All batches that the files make; state and output lie in the shared folder."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        job = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        job.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{place}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{place}/out")

    job = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{place}/out")


def tumbling(spark: SparkSession, location: str) -> DataFrame:
    events = flushed(files_as_stream(spark, location), location)
    return run(operators.windowed(events, time="ts", by="user_id", size="6 hours", aggregates={"n": "count(*)", "top": "max(value)"}, delay="1 hour"))


def sessions(spark: SparkSession, location: str) -> DataFrame:
    events = flushed(files_as_stream(spark, location), location)
    return run(operators.sessions(events, time="ts", by="user_id", timeout="2 hours", aggregates={"n": "count(*)", "top": "max(value)"}, delay="1 hour"))


def interval_join(spark: SparkSession, location: str) -> DataFrame:
    events = files_as_stream(spark, location).withColumnRenamed("event_id", "id")
    left, right = events.filter("event_type = 'purchase'"), events.filter("event_type = 'view'")
    return run(operators.interval_join(left, right, time="ts", by="user_id", before="1 hour", delay="1 hour", names=("purchase_id", "view_id")))


def distinct_pairs(spark: SparkSession, location: str) -> DataFrame:
    """All pairs of a bounded stream; ``operators.distinct`` with a time and a delay keeps a bounded state where a stream has no end."""
    return run(operators.distinct(files_as_stream(spark, location), ["user_id", "event_type"]))


def running_state(spark: SparkSession, location: str) -> DataFrame:
    updates = run(operators.running_maximum(files_as_stream(spark, location), by="user_id", value="value"), mode="update")
    latest = Window.partitionBy("user_id").orderBy(F.desc("batch"))
    return durable(updates.withColumn("r", F.row_number().over(latest)).filter("r = 1").drop("r", "batch"))
