"""Written tables read back, and the two streams."""

import numpy as np
from pyspark.sql import functions as F

from checks import views as v
from checks.on_metrics import curve_sql, gains_sql
from checks.on_routers import LENGTH_SHARE, PLACES, ROUTED, TRAINED, _scores, length_bundle
from checks.registry import check
from tollgate.operators import metrics
from tollgate.routers import RandomRouter
from tollgate.session import new_path
from tollgate.sources import tables
from tollgate.sources.bundle import Bundle
from tollgate.sources.vectors import upsert_embeddings
from tollgate.streaming.ingest import ingest_stream, unknown_path
from tollgate.streaming.route import route_stream


@check("routing_table_csv", f"WITH {v.LABELLED} SELECT * FROM labelled")
def routing_table_csv(spark, sf):
    path = new_path(spark, "table")
    tables.write_routing_table(v.labelled(spark, sf), path, "csv")
    return tables.read_routing_table(spark, path, "csv")


@check("routing_table_parquet", f"WITH {v.LABELLED} SELECT * FROM labelled")
def routing_table_parquet(spark, sf):
    path = new_path(spark, "table")
    tables.write_routing_table(v.labelled(spark, sf), path)
    return tables.read_routing_table(spark, path)


@check("write_scores", f"WITH RECURSIVE {v.LABELLED}, {PLACES} SELECT * FROM scores")
def write_scores(spark, sf):
    path = new_path(spark, "scores")
    tables.write_scores(_scores(spark, sf), path)
    return tables.read_scores(spark, path)


RESULT = "subject string, n_test bigint, weak_acc double, strong_acc double, auc double, apgr double, pct_strong_for_90 double, pct_strong_for_95 double"


@check(
    "write_result",
    f"""
WITH {v.orders_sql()}, {gains_sql('scored', 'subject')}, {curve_sql('subject')}
SELECT subject, n_test, round_even(weak_acc, 4) AS weak_acc, round_even(strong_acc, 4) AS strong_acc, round_even(auc, 4) AS auc, round_even(apgr, 4) AS apgr,
       round_even(pct_strong_for_90, 4) AS pct_strong_for_90, round_even(pct_strong_for_95, 4) AS pct_strong_for_95 FROM metric
""",
)
def write_result(spark, sf):
    path = new_path(spark, "result")
    tables.write_result(metrics.evaluate(v.orders_scored(spark, sf), ["subject"]), path)
    return tables.read_result(spark, path, RESULT)


def letter_profile():
    """Stands in for a sentence encoder: how often four characters occur, plus the length."""
    return lambda texts: np.array([[len(t), *[t.count(c) for c in "aet "]] for t in texts], dtype=float)


# First the labelled documents, then all of them: the second call encodes only the rest.
@check(
    "upsert_embeddings",
    """
WITH counted AS (SELECT doc_id AS id, 'query: ' || text AS t FROM documents),
raw AS (SELECT id, unnest([length(t), length(t) - length(replace(t, 'a', '')), length(t) - length(replace(t, 'e', '')),
                           length(t) - length(replace(t, 't', '')), length(t) - length(replace(t, ' ', ''))])::DOUBLE AS x, generate_subscripts([1, 2, 3, 4, 5], 1) AS position FROM counted)
SELECT id, position::BIGINT AS position, round_even((x / sqrt(sum(x * x) OVER (PARTITION BY id)))::FLOAT::DOUBLE, 6) AS value FROM raw
""",
)
def upsert(spark, sf):
    path = new_path(spark, "store")
    upsert_embeddings(path, v.labelled(spark, sf), letter_profile)
    documents = v.table(spark, sf, "documents").selectExpr("doc_id AS id", "text AS prompt")
    store = upsert_embeddings(path, documents, letter_profile)
    rows = store.select("id", F.posexplode("embedding").alias("p", "x"))
    return rows.select("id", (F.col("p") + 1).cast("bigint").alias("position"), F.bround(F.col("x").cast("double"), 6).alias("value"))


@check(
    "route_stream",
    f"WITH {v.SPLIT_TEXTS} SELECT id, CASE WHEN {v.draw('id')} >= 0.4::DOUBLE THEN 'strong' ELSE 'weak' END AS role FROM split_texts WHERE len(options) >= 2",
)
def route_streamed(spark, sf):
    incoming, out = new_path(spark, "texts"), new_path(spark, "routed")
    v.free_texts(spark, sf).write.parquet(incoming)
    stream = spark.readStream.schema("id bigint, text string").parquet(incoming)
    bundle = Bundle(RandomRouter(), 0.4, 60.0, 0)
    route_stream(stream, bundle, out, new_path(spark, "offsets"), available_now=True).awaitTermination()
    return spark.read.parquet(out).select("id", "role")


@check(
    "route_stream_length",
    f"""
WITH {ROUTED}, {TRAINED}, asked_scores AS (SELECT id, prompt, {LENGTH_SHARE} AS score FROM asked r)
SELECT id, prompt, score, CASE WHEN score >= (SELECT threshold FROM cutoff) THEN 'strong' ELSE 'weak' END AS role FROM asked_scores
""",
)
def route_streamed_by_length(spark, sf):
    """The trained length router, saved and loaded, over texts that arrive in two files."""
    incoming, out = new_path(spark, "texts"), new_path(spark, "routed")
    texts = v.free_texts(spark, sf)
    for part in (F.col("id") % 2 == 0, F.col("id") % 2 == 1):
        texts.where(part).write.mode("append").parquet(incoming)
    stream = spark.readStream.schema("id bigint, text string").parquet(incoming)
    route_stream(stream, length_bundle(spark, sf), out, new_path(spark, "offsets"), available_now=True).awaitTermination()
    return spark.read.parquet(out).select("id", "prompt", "score", "role")


# The replies arrive as two files; the first reply per question and model is kept.
FIRSTS = "firsts AS (SELECT id, model, min(seq) AS seq FROM replies GROUP BY id, model)"


def _ingested(spark, sf, questions):
    incoming, out = new_path(spark, "replies"), new_path(spark, "log")
    replies = v.replies(spark, sf)
    half = replies.agg(F.avg("seq")).first()[0]
    for part in (F.col("seq") < half, F.col("seq") >= half):
        replies.where(part).coalesce(1).write.mode("append").parquet(incoming)
    stream = spark.readStream.schema(replies.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    ingest_stream(stream, questions, out, new_path(spark, "offsets"), available_now=True).awaitTermination()
    return out


@check(
    "ingest_stream",
    f"""
WITH {v.PARSE}, {FIRSTS}
SELECT r.id, r.model, r.seq, r.raw, r.parsed, r.correct, r.parse_failed FROM responses r JOIN firsts USING (id, model, seq)
""",
)
def ingest_streamed(spark, sf):
    columns = ["id", "model", "seq", "raw", "parsed", "correct", "parse_failed"]
    return spark.read.option("recursiveFileLookup", True).parquet(_ingested(spark, sf, v.questions(spark, sf))).select(*columns)


@check(
    "ingest_stream_unknown",
    f"WITH {v.PARSE}, {FIRSTS} SELECT id, model, seq, raw FROM replies JOIN firsts USING (id, model, seq) WHERE id NOT IN (SELECT id FROM questions WHERE subject NOT LIKE '% (es)')",
)
def ingest_streamed_unknown(spark, sf):
    """Graded by the questions of the test split: replies to those of the other one are kept aside."""
    test = v.questions(spark, sf).where("subject NOT LIKE '% (es)'")
    rows = spark.read.option("recursiveFileLookup", True).parquet(unknown_path(_ingested(spark, sf, test)))
    return rows.select("id", "model", "seq", "raw")
