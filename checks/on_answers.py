"""The reply log: parsing, grading, pending work, pivot, letter bias."""

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from tollgate.defaults import NO_LETTER
from tollgate.functions.letters import to_latin
from tollgate.functions.questions import answer_text
from tollgate.operators import answers, quality
from tollgate.plans.collect import collect_answers
from tollgate.session import new_path, written
from tollgate.sources import responses as log


@check("parse_answers", f"WITH {v.PARSE} SELECT id, model, seq, raw, parsed FROM responses")
def parse_answers(spark, sf):
    return v.responses(spark, sf).select("id", "model", "seq", "raw", "parsed")


@check("grade", f"WITH {v.PARSE} SELECT id, seq, answer, correct, parse_failed FROM responses")
def grade(spark, sf):
    return v.responses(spark, sf).select("id", "seq", "answer", "correct", "parse_failed")


@check(
    "to_latin",
    f"""
WITH {v.REPLIES} SELECT seq, coalesce(CASE trim(raw) WHEN 'أ' THEN 'A' WHEN 'ب' THEN 'B' WHEN 'ج' THEN 'C' WHEN 'د' THEN 'D'
       WHEN 'ه' THEN 'E' END, upper(trim(raw))) AS label FROM replies
""",
)
def latin_labels(spark, sf):
    return v.replies(spark, sf).select("seq", to_latin(F.col("raw")).alias("label"))


@check(
    "answer_text",
    f"""
WITH {v.PARSE} SELECT r.id, r.seq, coalesce(q.options[instr('ABCDE', r.parsed)], '{NO_LETTER}') AS answer_text
FROM responses r JOIN questions q USING (id)
""",
)
def answer_texts(spark, sf):
    rows = v.responses(spark, sf).join(v.questions(spark, sf).select("id", "options"), "id")
    return rows.select("id", "seq", answer_text(F.col("options"), F.col("parsed")).alias("answer_text"))


@check(
    "pending",
    f"""
WITH {v.QUESTIONS}, {v.REPLIES}
SELECT id, subject FROM questions WHERE id NOT IN (SELECT id FROM replies WHERE model = 'small-v1')
""",
)
def pending(spark, sf):
    return answers.pending(v.questions(spark, sf), v.replies(spark, sf), "small-v1").select("id", "subject")


def _current(spark, sf):
    return answers.current_responses(v.responses(spark, sf), v.questions(spark, sf), v.PAIR)


@check("current_responses", f"WITH {v.CURRENT} SELECT id, seq, model, role FROM current")
def current_responses(spark, sf):
    return _current(spark, sf).select("id", "seq", "model", "role")


@check(
    "response_summary",
    f"""
WITH {v.CURRENT} SELECT role, model, count(*) AS answered, avg(correct::INT) AS accuracy,
       count(*) FILTER (parse_failed) AS parse_failures, avg(parse_failed::INT) AS parse_failure_rate,
       round_even(quantile_cont(seconds, 0.5), 6) AS median_seconds
FROM current GROUP BY role, model
""",
)
def response_summary(spark, sf):
    return answers.response_summary(_current(spark, sf)).withColumn("median_seconds", F.bround("median_seconds", 6))


@check("last_answers", f"WITH {v.CURRENT} SELECT id, weak_correct, strong_correct FROM last_answers")
def last_answers(spark, sf):
    return answers.last_answers(_current(spark, sf))


@check(
    "build_routing_table",
    f"""
WITH {v.CURRENT}, {v.PROMPTS.split(v.QUESTIONS + ",")[1]}
SELECT p.id, p.subject, p.prompt, a.weak_correct, a.strong_correct FROM prompts p JOIN last_answers a USING (id)
WHERE a.weak_correct IS NOT NULL AND a.strong_correct IS NOT NULL
""",
)
def build_routing_table(spark, sf):
    sample = quality.with_prompts(v.questions(spark, sf))
    return answers.build_routing_table(sample, v.responses(spark, sf), v.PAIR)


@check(
    "coverage",
    f"""
WITH {v.CURRENT}, sides AS (SELECT q.id, weak_correct, strong_correct FROM questions q LEFT JOIN last_answers USING (id))
SELECT count(weak_correct) > 0 AS has_weak, count(strong_correct) > 0 AS has_strong,
       count(*) FILTER (weak_correct IS NOT NULL AND strong_correct IS NOT NULL) AS complete,
       count(*) FILTER (weak_correct IS NULL OR strong_correct IS NULL) AS missing
FROM sides
""",
)
def coverage(spark, sf):
    return answers.coverage(v.questions(spark, sf), v.responses(spark, sf), v.PAIR)


LETTERS = v.CURRENT + """,
sides AS (SELECT id, answer, arg_max({'p': parsed}, seq) FILTER (role = 'weak') AS w, arg_max({'p': parsed}, seq) FILTER (role = 'strong') AS s,
                 arg_max(correct, seq) FILTER (role = 'weak') AS weak_correct, arg_max(correct, seq) FILTER (role = 'strong') AS strong_correct
          FROM current GROUP BY id, answer),
letters AS (SELECT id, answer, w.p AS weak_letter, s.p AS strong_letter, weak_correct, strong_correct
            FROM sides WHERE weak_correct IS NOT NULL AND strong_correct IS NOT NULL)
"""


def _letters(spark, sf):
    return answers.answer_letters(_current(spark, sf))


@check("answer_letters", f"WITH {LETTERS} SELECT * FROM letters")
def answer_letters(spark, sf):
    return _letters(spark, sf)


@check(
    "letter_shares",
    f"""
WITH {LETTERS} SELECT l.letter, (SELECT count(*) FROM letters WHERE answer = l.letter) / (SELECT count(*) FROM letters) AS true_share,
       (SELECT count(*) FROM letters WHERE weak_letter = l.letter) / (SELECT count(*) FROM letters) AS weak_share,
       (SELECT count(*) FROM letters WHERE strong_letter = l.letter) / (SELECT count(*) FROM letters) AS strong_share
FROM (SELECT DISTINCT unnest([answer, weak_letter, strong_letter]) AS letter FROM letters) l WHERE l.letter IS NOT NULL
""",
)
def letter_shares(spark, sf):
    return answers.letter_shares(_letters(spark, sf))


@check(
    "letter_bias",
    f"""
WITH {LETTERS} SELECT coalesce(true_letter, 'all') AS true_letter, count(*) AS n, avg(weak_correct::INT) AS weak_acc,
       avg(strong_correct::INT) AS strong_acc, avg((NOT weak_correct AND strong_correct)::INT) AS need_strong_rate
FROM (SELECT *, CASE WHEN answer = 'A' THEN 'A' ELSE 'other' END AS true_letter FROM letters) t
GROUP BY ROLLUP (true_letter)
""",
)
def letter_bias(spark, sf):
    return answers.letter_bias(_letters(spark, sf))


@check(
    "agreement",
    f"WITH {LETTERS} SELECT count(*) AS n, count(*) FILTER (weak_letter = strong_letter) / count(*) AS same_letter FROM letters",
)
def agreement(spark, sf):
    return answers.agreement(_letters(spark, sf))


# Row numbers of an exported run map back to question ids; every first reply is imported.
@check(
    "import_replies",
    f"""
WITH {v.PARSE} SELECT id, 'weak' AS role, 'imported' AS model, raw, parsed, correct, parse_failed FROM responses
""",
)
def import_replies(spark, sf):
    rows = v.replies(spark, sf).selectExpr("seq * 2 + 1 AS row", "id", "raw AS reply")
    imported = log.import_replies(rows.select("row", "reply"), rows.select("row", "id"), v.questions(spark, sf), "weak", "imported")
    return imported.select("id", "role", "model", "raw", "parsed", "correct", "parse_failed")


@check("read_response_log", f"WITH {v.PARSE} SELECT id, model, raw, parsed, answer, correct, parse_failed, seconds, seq FROM responses")
def read_response_log(spark, sf):
    path = new_path(spark, "log-json")
    columns = ["id", "model", "raw", "parsed", "answer", "correct", "parse_failed", "seconds", "seq"]
    v.responses(spark, sf).select(*columns).write.json(path)
    return log.read_responses(spark, path).select(*columns)


def letter_by_length():
    """Stands in for a model: the letter follows from the prompt's length; some calls fail."""

    def answer(prompt: str) -> str:
        if len(prompt) % 11 == 0:
            raise ConnectionError("no reply")
        return f"Answer: {'ABCDE'[len(prompt) % 5]}"

    return answer


ANSWERED = v.PROMPTS + """,
asked AS (SELECT id, answer_letter AS answer, 'Answer: ' || substring('ABCDE', (1 + length(prompt) % 5)::INT, 1) AS raw,
                 substring('ABCDE', (1 + length(prompt) % 5)::INT, 1) AS letter, len(options) AS n_options
          FROM prompts WHERE length(prompt) % 11 <> 0)
"""


@check("answer_pending", f"WITH {v.PROMPTS} SELECT id, length(prompt) % 11 = 0 AS failed, CASE WHEN length(prompt) % 11 <> 0 THEN 'Answer: ' || substring('ABCDE', (1 + length(prompt) % 5)::INT, 1) END AS raw FROM prompts")
def answer_pending(spark, sf):
    todo = quality.with_prompts(v.questions(spark, sf))
    asked = answers.answer_pending(todo, letter_by_length, "small-v1", attempts=2, wait_seconds=0.0)
    return asked.select("id", F.col("error").isNotNull().alias("failed"), "raw")


# The second run finds nothing to do but the failed calls, which fail again.
@check(
    "append_responses",
    f"""
WITH {ANSWERED} SELECT id, 'weak' AS role, 'small-v1' AS model, raw,
       CASE WHEN instr(substring('ABCDE', 1, n_options::INT), letter) > 0 THEN letter END AS parsed,
       answer, coalesce(CASE WHEN instr(substring('ABCDE', 1, n_options::INT), letter) > 0 THEN letter END = answer, false) AS correct, 1 AS seq
FROM asked
""",
)
def append_responses(spark, sf):
    path, sample = new_path(spark, "log"), written(v.questions(spark, sf), "sample")
    for run in (1, 2):
        collect_answers(sample, path, "weak", v.PAIR, letter_by_length, seq=run, attempts=1)
    columns = ["id", "role", "model", "raw", "parsed", "answer", "correct", F.col("seq").cast("int").alias("seq")]
    return log.read_responses(spark, path, "parquet").select(*columns)
