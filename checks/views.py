"""The tables the queries work on, derived from the given ones in Spark and in SQL.

The given data hold no multiple-choice questions, so lines of documents stand in for
questions and options, labels for graded answers, and events for the reply log.
Each view comes twice: a function for Spark and the body of a CTE for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAIR = {"weak": "small-v1", "strong": "large-v1"}


# Tables whose rows take work; the others are joined to them.
WORKED_ON = ("documents", "events", "orders")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    # The given tables are single files; a table in many files already fills the cores.
    return df.repartition(cores) if name in WORKED_ON and len(df.inputFiles()) < cores else df


# --- questions -------------------------------------------------------------------------

# Every non-blank line of a document is used: six lines make a question with five options, the last question of a
# document has the rest (further lines belong to its last option). A text of fewer lines is taken word by
# word, with all words from the third on as the second option; one of two words has one option, and one of a single word has it as
# question and option. The first question of a document has its id.
NEXT_ID = 1 << 40

BLOCKS = rf"""
d AS (SELECT doc_id, source, lang, filter(split(text, '\\n'), x -> trim(x) <> '') AS l,
             filter(split(replace(text, '\n', ' '), ' '), x -> x <> '') AS w FROM {{documents}}),
u AS (SELECT doc_id, source, lang, CASE WHEN size(l) >= 3 THEN l
             WHEN size(w) >= 3 THEN array(w[0], w[1], array_join(slice(w, 3, size(w)), ' '))
             WHEN size(w) >= 1 THEN array(w[0], w[size(w) - 1]) END AS l FROM d),
k AS (SELECT *, explode(sequence(0, CAST(greatest(1, size(l) div 6) AS INT) - 1)) AS k FROM u WHERE l IS NOT NULL),
b AS (SELECT doc_id + k * {NEXT_ID} AS id, doc_id, source, lang,
             CASE WHEN k < size(l) div 6 - 1 THEN slice(l, 6 * k + 1, 6) ELSE slice(l, 6 * k + 1, size(l)) END AS l FROM k),
lines AS (SELECT id, doc_id, source, lang, l[0] AS question, CASE WHEN size(l) <= 6 THEN slice(l, 2, 5)
             ELSE concat(slice(l, 2, 4), array(array_join(slice(l, 6, size(l)), ' '))) END AS options FROM b)
"""

BLOCKS_SQL = rf"""
block_d AS (SELECT doc_id, source, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l,
                   list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS w FROM documents),
block_u AS (SELECT doc_id, source, lang, CASE WHEN len(l) >= 3 THEN l
                   WHEN len(w) >= 3 THEN [w[1], w[2], array_to_string(w[3:], ' ')]
                   WHEN len(w) >= 1 THEN [w[1], w[len(w)]] END AS l FROM block_d),
block_k AS (SELECT *, unnest(range(0, greatest(1, len(l) // 6))) AS k FROM block_u WHERE l IS NOT NULL),
block_b AS (SELECT doc_id + k * {NEXT_ID} AS id, doc_id, source, lang,
                   CASE WHEN k < len(l) // 6 - 1 THEN l[6 * k + 1:6 * k + 6] ELSE l[6 * k + 1:] END AS l FROM block_k),
blocks AS (SELECT id, doc_id, source, lang, l[1] AS question, CASE WHEN len(l) <= 6 THEN l[2:6]
                   ELSE list_concat(l[2:5], [array_to_string(l[6:], ' ')]) END AS options FROM block_b)
"""


def raw_questions(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(
        "WITH " + BLOCKS + r"""
        SELECT d.id AS ID, source AS Subject, CASE WHEN lang <> 'en' THEN lang END AS Level,
               concat(' ', question, '  ') AS Question, p.url AS Context,
               concat(substring('ABCDE', 1 + CAST(d.id % size(options) AS INT), 1), ' ') AS `Answer Key`,
               get(options, 0) AS `Option 1`, get(options, 1) AS `Option 2`, get(options, 2) AS `Option 3`,
               get(options, 3) AS `Option 4`, get(options, 4) AS `Option 5`,
               CASE WHEN lang = 'es' THEN 'dev' ELSE 'test' END AS split
        FROM lines d LEFT JOIN {pages} p ON p.page_id = d.doc_id
        """,
        documents=table(spark, sf, "documents"),
        pages=table(spark, sf, "pages"),
    )


RAW = BLOCKS_SQL + r""",
raw AS (SELECT d.id, source AS subject, CASE WHEN lang <> 'en' THEN lang END AS level, question,
               p.url AS context, substring('ABCDE', (1 + d.id % len(options))::INT, 1) AS answer_letter,
               options, CASE WHEN lang = 'es' THEN 'dev' ELSE 'test' END AS split
        FROM blocks d LEFT JOIN pages p ON p.page_id = d.doc_id)
"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(
        "WITH " + BLOCKS + r""",
        q AS (SELECT d.id, concat(source, ' (', lang, ')') AS subject, question, p.url AS context, options
              FROM lines d LEFT JOIN {pages} p ON p.page_id = d.doc_id)
        SELECT *, substring('ABCDE', 1 + CAST(id % size(options) AS INT), 1) AS answer_letter FROM q
        """,
        documents=table(spark, sf, "documents"),
        pages=table(spark, sf, "pages"),
    )


QUESTIONS = BLOCKS_SQL + r""",
question_q AS (SELECT d.id, concat(source, ' (', lang, ')') AS subject, question, p.url AS context, options
               FROM blocks d LEFT JOIN pages p ON p.page_id = d.doc_id),
questions AS (SELECT *, substring('ABCDE', (1 + id % len(options))::INT, 1) AS answer_letter FROM question_q)
"""

# The prompt of each question.
PROMPTS = QUESTIONS + r""",
prompts AS (SELECT *, concat(
    CASE WHEN trim(coalesce(context, '')) <> '' THEN concat(trim(context), chr(10)) ELSE '' END,
    trim(question), chr(10),
    array_to_string(list_transform(options, lambda o, i: concat(substring('ABCDE', i::INT, 1), '. ', trim(o))), chr(10)), chr(10),
    'Answer with one letter only.') AS prompt FROM questions)
"""


def free_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Questions as free text: one option per line, or all on one line."""
    return spark.sql(
        r"""
        SELECT id, concat(question, gap, array_join(transform(options, (o, i) ->
               concat(substring('ABCDE', i + 1, 1), substring('.):', 1 + CAST(id % 3 AS INT), 1), ' ', o)), gap)) AS text
        FROM (SELECT *, CASE WHEN size(options) = 3 THEN ' ' ELSE '\n' END AS gap FROM {questions})
        """,
        questions=questions(spark, sf),
    )


FREE_TEXTS = QUESTIONS + r""",
free_texts AS (
    SELECT id, CASE WHEN len(options) = 3 THEN replace(by_line, chr(10), ' ') ELSE by_line END AS text
    FROM (SELECT id, options, concat(question, chr(10), array_to_string(list_transform(options, lambda o, i:
          concat(substring('ABCDE', i::INT, 1), substring('.):', (1 + id % 3)::INT, 1), ' ', o)), chr(10))) AS by_line FROM questions))
"""

# Fixed value: an option line, as its label and its text.
OPTION_LINE = r"^\s*[\(\[]?([A-Ea-eأابجده]ـ?)\s*[\)\].:\-]\s*(.+)$"

# The free texts taken apart again.
SPLIT_TEXTS = FREE_TEXTS + r""",
text_lines AS (SELECT id, list_filter(string_split(trim(text), chr(10)), lambda x: trim(x) <> '') AS l FROM free_texts),
text_parts AS (SELECT id, CASE WHEN len(l) = 1
        THEN string_split(regexp_replace(l[1], '\s+([\(\[]?[A-E]\s*[\)\].:]\s)', chr(1) || '\1', 'g'), chr(1))
        ELSE l END AS l FROM text_lines),
text_marked AS (SELECT id, l[1] AS first_line,
        list_filter(l[2:], lambda x: NOT regexp_matches(x, '{OPTION_LINE}')) AS stem,
        list_filter(l[2:], lambda x: regexp_matches(x, '{OPTION_LINE}')) AS marked
        FROM text_parts),
split_texts AS (SELECT id,
        array_to_string(list_transform(list_concat([first_line], stem), lambda x: trim(x)), ' ') AS question,
        list_transform(marked, lambda x: trim(regexp_extract(x, '{OPTION_LINE}', 2)))[1:5] AS options
        FROM text_marked)
""".replace("{OPTION_LINE}", OPTION_LINE)


# --- routing table -----------------------------------------------------------------------

def labelled(spark: SparkSession, sf: str, score: str | None = None) -> DataFrame:
    """(id, subject, prompt, weak_correct, strong_correct, need_strong), and a ``score`` of the text, which is computed
    before the join, so that texts which are needed for nothing else are not shuffled."""
    from tollgate.operators.labels import add_label

    own, name = (f", {score} AS score", ", score") if score else ("", "")
    rows = spark.sql(
        f"""
        SELECT doc_id AS id, subject, prompt, toxic = 1 AS weak_correct, quality = 1 AS strong_correct{name}
        FROM (SELECT doc_id, concat(source, ' (', lang, ')') AS subject, text AS prompt{own} FROM {{documents}}) JOIN {{labels}} USING (doc_id)
        """,
        documents=table(spark, sf, "documents"),
        labels=table(spark, sf, "labels"),
    )
    return add_label(rows)


LABELLED = """
labelled AS (SELECT doc_id AS id, concat(source, ' (', lang, ')') AS subject, text AS prompt,
                    toxic = 1 AS weak_correct, quality = 1 AS strong_correct,
                    NOT toxic = 1 AND quality = 1 AS need_strong
             FROM documents JOIN labels USING (doc_id))
"""


def orders_scored(spark: SparkSession, sf: str, ties: bool = False) -> DataFrame:
    """A larger scored table; with ``ties`` only a few distinct scores."""
    from tollgate.operators.labels import add_label

    rows = spark.sql(
        """
        SELECT o_orderkey AS id, n_name AS subject, o_orderstatus = 'F' AS weak_correct,
               o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AS strong_correct, o_totalprice AS score
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
        """,
        orders=table(spark, sf, "orders"),
        customer=table(spark, sf, "customer"),
        nation=table(spark, sf, "nation"),
    )
    rows = add_label(rows)
    return rows.selectExpr("* EXCEPT (score)", "CAST(floor(score / 100000) AS DOUBLE) AS score") if ties else rows


def orders_sql(ties: bool = False) -> str:
    score = "floor(o_totalprice / 100000)" if ties else "o_totalprice"
    return f"""
scored AS (SELECT *, NOT weak_correct AND strong_correct AS need_strong FROM (
    SELECT o_orderkey AS id, n_name AS subject, o_orderstatus = 'F' AS weak_correct,
           o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AS strong_correct, {score} AS score
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))
"""


# --- reply log ---------------------------------------------------------------------------

REPLY_BODY = """
SELECT user_id AS id, model, seq, seconds,
  CASE k % 12 WHEN 0 THEN L WHEN 1 THEN concat('(', L, ')') WHEN 2 THEN concat('Answer: ', L)
    WHEN 3 THEN concat('The answer is (', L, ').') WHEN 4 THEN concat('**', L, '**') WHEN 5 THEN concat('الإجابة: ', A)
    WHEN 6 THEN concat('الجواب هو ', A) WHEN 7 THEN A WHEN 8 THEN 'A or B' WHEN 9 THEN 'ABCD'
    WHEN 10 THEN concat('  ', lower(L), '  ') ELSE '' END AS raw
FROM (SELECT user_id, event_id AS seq, value AS seconds, k, substring('ABCDE', 1 + k % 5, 1) AS L,
        substring('أبجده', 1 + k % 5, 1) AS A,
        CASE event_type WHEN 'click' THEN 'small-v1' WHEN 'purchase' THEN 'large-v1'
             WHEN 'view' THEN 'small-v0' WHEN 'signup' THEN 'large-v0' WHEN 'error' THEN 'other-v0' END AS model
      FROM (SELECT *, CAST({k} AS INT) AS k FROM {events}) e0) e1
"""


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """(id, model, seq, seconds, raw): several answers per question, current and older models."""
    body = REPLY_BODY.replace("{k}", "get_json_object(props, '$.k')")
    return spark.sql(body, events=table(spark, sf, "events"))


REPLIES = (
    "replies AS ("
    + REPLY_BODY.replace("{k}", "json_extract_string(props, '$.k')").replace("{events}", "events")
    + ")"
)


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """The graded log over the replies whose question is known."""
    from tollgate.operators.answers import grade_replies

    return grade_replies(replies(spark, sf), questions(spark, sf))


# The reply rules without look-around: a neighbour is consumed instead, and the distinct
# capitals are tested one by one.
PARSE = QUESTIONS + "," + REPLIES + r""",
reply_text AS (SELECT r.*, q.answer_letter AS answer, len(q.options) AS n_options, trim(raw) AS t
               FROM replies r JOIN questions q USING (id)),
reply_labels AS (SELECT *,
    regexp_extract(t, '(?i)(?:answer(?:\s+is)?|الإجابة(?:\s+الصحيحة)?(?:\s+هي)?|الاجابة(?:\s+هي)?|الجواب(?:\s+هو)?)\s*[:：\-]?\s*[\(\[]?\s*([A-Ea-eأابجده]ـ?)(?:[^A-Za-z\x{0600}-\x{06FF}]|$)', 1) AS stated0,
    regexp_extract(ltrim(t, '([*"'' '), '^([A-Ea-eأابجده]ـ?)(?:[^A-Za-z\x{0600}-\x{06FF}]|$)', 1) AS first0,
    list_filter(['A', 'B', 'C', 'D', 'E'][1:n_options], lambda x: regexp_matches(t, '(?:^|[^A-Za-z])' || x || '(?:[^A-Za-z]|$)')) AS named
    FROM reply_text),
reply_latin AS (SELECT * EXCLUDE (stated0, first0),
    coalesce(latin[rtrim(stated0, 'ـ')], upper(stated0)) AS stated, coalesce(latin[rtrim(first0, 'ـ')], upper(first0)) AS first_label
    FROM (SELECT *, MAP {'أ': 'A', 'ا': 'A', 'ب': 'B', 'ج': 'C', 'د': 'D', 'ه': 'E'} AS latin FROM reply_labels)),
responses AS (SELECT *, coalesce(parsed = answer, false) AS correct, parsed IS NULL AS parse_failed FROM (
    SELECT id, model, seq, seconds, raw, answer, n_options, CASE
        WHEN stated <> '' AND instr(substring('ABCDE', 1, n_options::INT), stated) > 0 THEN stated
        WHEN len(named) > 1 THEN NULL
        WHEN first_label <> '' AND instr(substring('ABCDE', 1, n_options::INT), first_label) > 0 THEN first_label
        ELSE named[1] END AS parsed
    FROM reply_latin))
"""

# Replies of the current pair with their role, and the last answer of each role.
CURRENT = PARSE + r""",
current AS (SELECT *, CASE model WHEN 'small-v1' THEN 'weak' ELSE 'strong' END AS role
            FROM responses WHERE model IN ('small-v1', 'large-v1')),
last_answers AS (SELECT id, arg_max(correct, seq) FILTER (role = 'weak') AS weak_correct,
                        arg_max(correct, seq) FILTER (role = 'strong') AS strong_correct FROM current GROUP BY id)
"""


# --- vectors -----------------------------------------------------------------------------

def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr("vec_id AS id", "embedding", "label")


def labelled_with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled rows that have a vector, without it."""
    return labelled(spark, sf).join(vectors(spark, sf).select("id"), "id", "left_semi")


def draw(key: str, seed: object = 42) -> str:
    """The stable uniform as SQL."""
    return f"('0x' || substr(md5(concat({key}, ':{seed}')), 1, 13))::UBIGINT::DOUBLE / 4503599627370496::DOUBLE"


def rank_order(by: str = "") -> str:
    return f"{f'PARTITION BY {by} ' if by else ''}ORDER BY score DESC, id"
