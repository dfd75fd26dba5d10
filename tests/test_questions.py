import pytest
from pyspark.sql import functions as F

from tollgate.functions.letters import index_letter, letter_index, to_latin
from tollgate.functions.text import strip
from tollgate.operators import quality

SCHEMA = "id long, subject string, question string, context string, options array<string>, answer_letter string"


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_strip_removes_unicode_blanks(spark):
    assert one(spark, "  \t a b 　\n", strip) == "a b"


@pytest.mark.parametrize("letter, index", [("A", 1), ("E", 5), ("F", None), ("", None), ("AB", None), (None, None)])
def test_letter_index(spark, letter, index):
    assert one(spark, letter, letter_index) == index


def test_index_letter(spark):
    assert [one(spark, i, index_letter, "int") for i in (1, 5, 6, 0)][:3] == ["A", "E", None]


@pytest.mark.parametrize("label, latin", [("ب", "B"), ("بـ", "B"), ("هـ", "E"), (" د ", "D"), ("c", "C"), ("Aـ", "Aـ"), ("x", "X")])
def test_to_latin(spark, label, latin):
    assert one(spark, label, to_latin) == latin


def table(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_prompt_has_context_only_when_it_holds_text(spark):
    rows = [(1, "s", " q ", " read this ", ["x ", "y"], "A"), (2, "s", "q", "  ", ["x", "y"], "A"), (3, "s", "q", None, ["x"], "A")]
    prompts = [r.prompt for r in quality.with_prompts(table(spark, *rows)).orderBy("id").collect()]
    end = "Answer with one letter only."
    assert prompts == [f"read this\nq\nA. x\nB. y\n{end}", f"q\nA. x\nB. y\n{end}", f"q\nA. x\n{end}"]


def test_features_count_code_points_and_keep_blank_context_apart(spark):
    rows = quality.with_prompts(table(spark, (1, "s", "سؤال 😀", " ", ["x", "y"], "A")))
    f = quality.question_features(rows).first()
    assert (f.n_options, f.has_context, f.prompt_chars) == (2, True, len(f.prompt))


def test_ambiguous_questions_are_dropped(spark):
    rows = [(1, "s", "q", None, ["x", "y", "x"], "A"), (2, "s", "q", None, ["x", "y", "x"], "B"), (3, "s", "q", None, ["x", "X"], "A")]
    kept = quality.drop_ambiguous(table(spark, *rows))
    assert sorted(r.id for r in kept.collect()) == [2, 3]
    assert quality.ambiguity(table(spark, *rows)).first() == (2, 1)


def test_gate_names_each_violation(spark):
    good = (1, "s", "q", None, ["x", "y"], "B")
    assert quality.assert_quality(table(spark, good)).count() == 1
    bad = [good, good, (2, "s", "q", None, ["x"], "A"), (3, "s", "q", None, ["x", "y"], "C"), (4, "s", "q", None, ["x", "y"], "Z")]
    assert quality.quality_gate(table(spark, *bad)).first()[1:] == (1, 1, 1, 0, 1)
    with pytest.raises(ValueError, match="bad_letter"):
        quality.assert_quality(table(spark, *bad))


@pytest.mark.parametrize(
    "text, question, options",
    [
        ("Name a metal\n\n[a] iron\n  (b) - salt \nC: oak\nD) gold", "Name a metal", ["iron", "- salt", "oak", "gold"]),
        ("ما لون الثلج\nد. أبيض\nهـ: أسود\nج) أحمر", "ما لون الثلج", ["أبيض", "أسود", "أحمر"]),
        ("Sum of 2 and 3 (A) 4 [B] 5 C: 6 D. 7", "Sum of 2 and 3", ["4", "5", "6", "7"]),
        ("Two lines\nof question\n\nA: one\nB- two", "Two lines of question", ["one", "two"]),
        ("A. starts with a label\nB. one", "A. starts with a label", ["one"]),
        ("q\r\nA. 1\rB. 2 C. 3\nD. 4\nE. 5\na. 6", "q", ["1", "2", "3", "4", "5"]),
        ("no options here", "no options here", []),
        ("  ", "", []),
    ],
)
def test_split_questions(spark, text, question, options):
    row = quality.split_questions(spark.createDataFrame([(1, text)], "id long, text string")).first()
    assert (row.question, row.options) == (question, options)


def test_whole_long_texts_are_processed(spark):
    text = "word " * 60_000 + "\nA. " + "x" * 50_000 + "\nB. y"
    row = quality.split_questions(spark.createDataFrame([(1, text)], "id long, text string")).first()
    assert len(row.question) == 299_999 and [len(o) for o in row.options] == [50_000, 1]


def test_a_sixth_option_is_an_error_and_counted(spark):
    six = table(spark, (1, "s", "q", None, list("uvwxyz"), "A"))
    assert quality.quality_gate(six).first().too_many_options == 1
    with pytest.raises(Exception, match="more than 5 options"):
        quality.with_prompts(six).collect()


def test_a_damaged_table_is_not_a_missing_one(spark, tmp_path):
    from tollgate.sources.questions import path_exists

    assert not path_exists(spark, str(tmp_path / "none"))
    (tmp_path / "part.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception, match="parquet|Parquet|footer"):
        path_exists(spark, str(tmp_path))


def test_clean_removes_what_was_written(spark):
    from tollgate.session import clean, written
    from tollgate.sources.questions import path_exists

    held = written(spark.range(5).toDF("id"), "numbers")
    path = held.inputFiles()[0].rsplit("/", 1)[0]
    assert held.count() == 5 and path_exists(spark, path)
    clean(spark)
    assert not path_exists(spark, path)


def test_sketches_merge_and_stay_within_their_bound(spark):
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("split"),
        F.col("id").alias("all"),
        (F.col("id") % 977).alias("Option 1"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 50).alias("some"),
        F.lit(None).cast("string").alias("none"),
    )
    exact = {(r.split, r.column): r for r in quality.profile_splits(rows, "split", exact=True).collect()}
    halves = [quality.profile_sketches(rows.where(F.col("id") % 2 == i), "split") for i in (0, 1)]
    for profile in (quality.profile_splits(rows, "split"), quality.sketched_profile(halves[0].unionByName(halves[1]), "split")):
        got = {(r.split, r.column): r for r in profile.collect()}
        assert got.keys() == exact.keys() and len(got) == 8
        for key, r in got.items():
            assert (r.n, r.nulls) == (exact[key].n, exact[key].nulls)
            bound = 3 * 1.04 / (1 << quality.SKETCH_BITS) ** 0.5  # three standard errors
            assert abs(r.distinct_values - exact[key].distinct_values) <= bound * exact[key].distinct_values + 0.5
