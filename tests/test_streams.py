import pytest

from checks.on_routers import letter_encoder
from tollgate.plans.route import train_router
from tollgate.routers import EmbeddingRouter, LengthRouter, TfidfRouter
from tollgate.session import folders
from tollgate.streaming.ingest import first_replies, ingest_stream, unknown_path
from tollgate.streaming.route import route_stream


@pytest.mark.parametrize("router", [LengthRouter(), TfidfRouter(), EmbeddingRouter(make_encoder=letter_encoder)])
def test_texts_are_routed_as_they_arrive(spark, tmp_path, router):
    train = spark.createDataFrame([(i, "long winded " * (i % 2 * 9) + "q", i % 2 == 1) for i in range(20)], "id long, prompt string, need_strong boolean")
    bundle = train_router(train, router, 50.0)
    source, out, offsets = (str(tmp_path / d) for d in ("in", "out", "offsets"))
    schema = "id long, text string"
    long, short = "long winded " * 20, "q"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        route_stream(stream, bundle, out, offsets, available_now=True).awaitTermination()
        return {r.id: r.role for r in spark.read.parquet(out).collect()}

    assert arrive((1, f"{long}\nA. x\nB. y"), (2, "no options")) == {1: "strong"}
    roles = arrive((3, f"{short}\nA. x\nB. y"), (4, f"{long}\nA. x\nB. y"))
    assert roles[1] == roles[4] == "strong" and set(roles) == {1, 3, 4}


REPLY = "id long, model string, seq long, seconds double, raw string"


@pytest.fixture
def arrive(spark, tmp_path):
    questions = spark.createDataFrame([(1, ["x", "y"], "B"), (2, ["x", "y"], "A")], "id long, options array<string>, answer_letter string")
    source, log = str(tmp_path / "in"), str(tmp_path / "log")

    def run(offsets, *rows):
        if rows:
            spark.createDataFrame(rows, REPLY).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(REPLY).option("maxFilesPerTrigger", 1).parquet(source)
        query = ingest_stream(stream, questions, log, str(tmp_path / offsets), available_now=True)
        query.awaitTermination()
        return sorted((r.id, r.model, r.seq, r.parsed or "", r.correct) for r in spark.read.option("recursiveFileLookup", True).parquet(log).collect())

    return run


def test_first_reply_per_key_is_logged_once(spark, tmp_path, arrive):
    first = arrive("o", (1, "w", 2, 1.0, "A"), (1, "w", 1, 1.0, "B"), (2, "w", 3, 1.0, "A or B"))
    assert first == [(1, "w", 1, "B", True), (2, "w", 3, "", False)]
    second = arrive("o", (1, "w", 0, 1.0, "A"), (2, "s", 5, 1.0, "(A)"))
    assert second == sorted([*first, (2, "s", 5, "A", True)])
    # A batch that was not committed is run again, into the same folder.
    (tmp_path / "o" / "commits" / "1").unlink()
    (tmp_path / "o" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert arrive("o") == second
    # A lost checkpoint replays every file; nothing is logged twice.
    assert arrive("fresh") == second
    third = arrive("fresh", (1, "s", 9, 1.0, "B"), (1, "w", 10, 1.0, "B"))
    assert third == sorted([*second, (1, "s", 9, "B", True)])


def test_replies_to_unknown_ids_are_kept_aside(spark, tmp_path, arrive):
    assert arrive("o", (1, "w", 1, 1.0, "B"), (7, "w", 2, 1.0, "A")) == [(1, "w", 1, "B", True)]
    arrive("o", (7, "w", 3, 1.0, "B"))
    rows = spark.read.option("recursiveFileLookup", True).parquet(unknown_path(str(tmp_path / "log"))).collect()
    assert [(r.id, r.seq, r.raw) for r in rows] == [(7, 2, "A")]


def test_a_batch_does_not_read_the_log(spark, tmp_path, arrive):
    arrive("o", (1, "w", 1, 1.0, "B"))
    stream = first_replies(spark.readStream.schema(REPLY).parquet(str(tmp_path / "in")))
    assert "log" not in stream._jdf.queryExecution().analyzed().toString()
    assert folders(spark, str(tmp_path / "log"))[0].startswith("query=")
