"""Question tables: cleaning, gate, prompts, free text, profile."""

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from tollgate.functions.letters import index_letter, letter_index
from tollgate.operators import quality
from tollgate.session import new_path
from tollgate.sources import questions as source
from tollgate.operators.sampling import stratified_sample

UNIT = "\x1f"  # joins a list into one comparable text


def joined(col: str = "options"):
    return F.array_join(col, UNIT)


CLEAN = f"""
SELECT id, concat(subject, coalesce(' (' || level || ')', '')) AS subject, trim(question) AS question, context,
       array_to_string(options, chr(31)) AS options, answer_letter FROM raw
"""


@check("clean_questions", f"WITH {v.RAW} {CLEAN}")
def clean_questions(spark, sf):
    return quality.clean_questions(v.raw_questions(spark, sf)).withColumn("options", joined())


def _reread(spark, sf, fmt):
    path = new_path(spark, f"raw-{fmt}")
    writer = v.raw_questions(spark, sf).write.format(fmt)
    if fmt == "csv":
        # Keep the surrounding blanks that cleaning has to remove.
        writer = writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.save(path)
    return source.read_questions(spark, path, fmt).withColumn("options", joined())


for fmt in ("parquet", "csv", "json"):
    check(f"read_questions_{fmt}", f"WITH {v.RAW} {CLEAN} WHERE split = 'test'")(
        lambda spark, sf, fmt=fmt: _reread(spark, sf, fmt)
    )


OPTIONS = ", ".join(f"{{'name': 'Option {i}', 'val': options[{i}]}}" for i in range(1, 6))


@check(
    "profile_splits",
    f"""
WITH {v.RAW}, cells AS (
  SELECT split, unnest([
    {{'name': 'ID', 'val': id::VARCHAR}}, {{'name': 'Subject', 'val': subject}}, {{'name': 'Level', 'val': level}},
    {{'name': 'Question', 'val': ' ' || question || '  '}}, {{'name': 'Context', 'val': context}}, {{'name': 'Answer Key', 'val': answer_letter || ' '}}, {OPTIONS}]) AS c
  FROM raw)
SELECT split, c.name AS "column", count(*) AS n, count(*) - count(c.val) AS nulls, count(DISTINCT c.val) AS distinct_values
FROM cells GROUP BY ALL
""",
)
def profile_splits(spark, sf):
    return quality.profile_splits(v.raw_questions(spark, sf), "split", exact=True)


@check("profile_splits_sketch")
def profile_splits_sketch(spark, sf):
    """The profiles of two halves, merged."""
    raw = v.raw_questions(spark, sf)
    halves = [quality.profile_sketches(raw.where(F.col("ID") % 2 == i), "split") for i in (0, 1)]
    return quality.sketched_profile(halves[0].unionByName(halves[1]), "split")


@check(
    "letters",
    f"""
WITH {v.QUESTIONS}
SELECT id, instr('ABCDE', answer_letter)::BIGINT AS position, substring('ABCDE', len(options)::INT, 1) AS last_letter FROM questions
""",
)
def letters(spark, sf):
    return v.questions(spark, sf).select(
        "id",
        letter_index(F.col("answer_letter")).cast("bigint").alias("position"),
        index_letter(F.size("options")).alias("last_letter"),
    )


RIGHT = "options[instr('ABCDE', answer_letter)]"
AMBIGUOUS = f"len(list_filter(options, lambda o: o = {RIGHT})) > 1"


@check(
    "drop_ambiguous",
    f"WITH {v.QUESTIONS} SELECT id, subject, array_to_string(options, chr(31)) AS options FROM questions WHERE NOT {AMBIGUOUS}",
)
def drop_ambiguous(spark, sf):
    return quality.drop_ambiguous(v.questions(spark, sf)).select("id", "subject", joined().alias("options"))


@check(
    "ambiguity",
    f"WITH {v.QUESTIONS} SELECT count(*) FILTER (NOT {AMBIGUOUS}) AS kept, count(*) FILTER ({AMBIGUOUS}) AS dropped FROM questions",
)
def ambiguity(spark, sf):
    return quality.ambiguity(v.questions(spark, sf))


# A table with every kind of violation: document ids repeat, letters and options are off.
def _unsound(spark, sf):
    return v.questions(spark, sf).selectExpr(
        "id % 700 AS id", "substring('ABCDEFG', 1 + CAST(length(question) % 7 AS INT), 1) AS answer_letter",
        "slice(options, 1, 1 + CAST(length(question) % 3 AS INT)) AS options",
    )


@check(
    "quality_gate",
    f"""
WITH {v.QUESTIONS}, unsound AS (
  SELECT id % 700 AS id, substring('ABCDEFG', (1 + length(question) % 7)::INT, 1) AS answer_letter,
         options[1:1 + length(question) % 3] AS options FROM questions)
SELECT count(*) AS n, count(*) - count(DISTINCT id) AS repeated_id,
       count(*) FILTER (instr('ABCDE', answer_letter) = 0) AS bad_letter,
       count(*) FILTER (len(options) < 2) AS too_few_options, count(*) FILTER (len(options) > 5) AS too_many_options,
       count(*) FILTER (instr('ABCDE', answer_letter) > len(options)) AS answer_without_option
FROM unsound
""",
)
def quality_gate(spark, sf):
    return quality.quality_gate(_unsound(spark, sf))


@check("with_prompts", f"WITH {v.PROMPTS} SELECT id, prompt FROM prompts")
def with_prompts(spark, sf):
    return quality.with_prompts(v.questions(spark, sf)).select("id", "prompt")


@check(
    "question_features",
    f"""
WITH {v.PROMPTS} SELECT id, len(options)::BIGINT AS n_options, context IS NOT NULL AS has_context,
       length(prompt)::BIGINT AS prompt_chars FROM prompts
""",
)
def question_features(spark, sf):
    rows = quality.question_features(quality.with_prompts(v.questions(spark, sf)))
    return rows.select("id", "n_options", "has_context", "prompt_chars")


@check(
    "split_questions",
    f"WITH {v.SPLIT_TEXTS} SELECT id, question, array_to_string(options, chr(31)) AS options FROM split_texts",
)
def split_questions(spark, sf):
    return quality.split_questions(v.free_texts(spark, sf)).select("id", "question", joined().alias("options"))


@check("subject_counts", f"WITH {v.QUESTIONS} SELECT subject, count(*) AS n FROM questions GROUP BY subject")
def subject_counts(spark, sf):
    return quality.value_counts(v.questions(spark, sf), "subject")


@check("answer_counts", f"WITH {v.QUESTIONS} SELECT answer_letter, count(*) AS n FROM questions GROUP BY answer_letter")
def answer_counts(spark, sf):
    return quality.value_counts(v.questions(spark, sf), "answer_letter")


@check(
    "sample_summary",
    f"WITH {v.QUESTIONS} SELECT count(*) AS n, count(DISTINCT subject) AS subjects, count(context) AS with_context FROM questions",
)
def sample_summary(spark, sf):
    return quality.sample_summary(v.questions(spark, sf))
