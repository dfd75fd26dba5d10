"""Ingest replies as a stream into the graded log."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tollgate.operators.answers import answer_key, grade, parse_answers
from tollgate.session import folders

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NOW, FIRST, LAST, REPLY = "__now", "__first", "__last", "__reply"


def unknown_path(log_path: str) -> str:
    """Where replies to ids without a question are kept, beside the log."""
    return f"{log_path.rstrip('/')}-unknown"


def first_replies(stream: DataFrame) -> DataFrame:
    """(id, model, the earliest reply of the batch in which the key came first, FIRST, LAST). The state holds a row for
    each key; a batch gets the keys that it touches, and those are new whose first and last batch are one."""
    rest = F.struct(*[c for c in stream.columns if c not in ("id", "model")])
    timed = stream.withColumn(NOW, F.current_timestamp())  # the same for a whole batch, also when it is replayed
    return timed.groupBy("id", "model").agg(
        F.min_by(rest, "seq").alias(REPLY), F.min(NOW).alias(FIRST), F.max(NOW).alias(LAST)
    )


def _query_id(spark: SparkSession, checkpoint: str) -> str | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return json.loads(spark.read.text(path.toString(), wholetext=True).first()[0])["id"]


def ingest_stream(
    stream: DataFrame,
    questions: DataFrame,
    log_path: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Parse, grade and append replies; repeats of (id, model) are dropped, the first wins.

    Which keys have come is keyed state, kept in RocksDB, so no batch reads the log. A batch writes a folder of its
    own, named by query and batch, and overwrites it when it is replayed after a failure. Replies whose id no question has
    go to ``unknown_path`` in the same way. Only where the log has folders of another query, because the
    checkpoint was lost, are new keys compared with those.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own = _query_id(spark, checkpoint)
    others = [f for f in folders(spark, log_path) if f.startswith("query=") and f != f"query={own}"]
    earlier = None
    if others:
        places = [f"{p}/{f}" for p in (log_path, unknown_path(log_path)) for f in folders(spark, p) if f in others]
        earlier = spark.read.schema("id bigint, model string").option("recursiveFileLookup", True).parquet(*places)
    started, name = threading.Event(), []

    def append(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        new = batch.where(F.col(FIRST) == F.col(LAST)).select("id", "model", f"{REPLY}.*")
        if earlier is not None:
            new = new.join(earlier.distinct(), ["id", "model"], "left_anti")
        key = answer_key(questions).withColumn("__known", F.lit(True))
        new = new.join(key, "id", "left").persist()
        place = f"query={name[0]}/batch={batch_id}"
        known, unknown = new.where("__known").drop("__known"), new.where("__known IS NULL")
        grade(parse_answers(known)).write.mode("overwrite").parquet(f"{log_path}/{place}")
        unknown = unknown.drop("__known", "answer", "n_options")
        unknown.write.mode("overwrite").parquet(f"{unknown_path(log_path)}/{place}")
        new.unpersist()

    writer = first_replies(stream).writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    query = writer.start()
    name.append(query.id)
    started.set()
    return query
