import pytest

from tollgate.operators.answers import grade, parse_answers

# Built from the rules: a phrase, a gap, a label, and what may follow a label.
PHRASES = ("Answer", "my answer is", "الجواب هو", "الاجابة", "الإجابة الصحيحة")
GAPS = (": ", " (", "： [", " - ")
LABELS = (("D", "D"), ("e", "E"), ("ج", "C"), ("هـ", "E"))
AFTER = ("", ".", ") because of B", "]\nnothing else")
STATED = [(p + g + x + after, want) for p in PHRASES for g, after in zip(GAPS, AFTER, strict=True) for x, want in LABELS]
LEADING = [(f"{mark}{x}{after}", want) for mark in ("", "* ", "(", "'") for x, want in LABELS for after in ("", ") so it is", "\n")]
ONLY_CAPITAL = [(f"{before}E{after}", "E") for before in ("I pick ", "it must be: ", "السؤال ") for after in ("", "!", " , surely")]
VALID = STATED + LEADING + ONLY_CAPITAL
GLUED = ["Cz", "answer Dz", "zE", "جر", "الجواب در"]  # a letter right beside a label
HEDGED = [f"{x} {word} {y}" for x, y in (("B", "E"), ("C", "D")) for word in ("or", "maybe", "/")]
INVALID = ["", None, " \n ", "no letter at all", "12", "ABE"] + GLUED + [f"either {h}" for h in HEDGED]


def parsed(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, n_options int")
    return [r.parsed for r in parse_answers(df).orderBy("i").collect()]


def test_replies(spark):
    rows = [(r, 5) for r, _ in VALID] + [(r, 5) for r in INVALID]
    assert parsed(spark, rows) == [x for _, x in VALID] + [None] * len(INVALID)


def test_letters_beyond_the_options_do_not_count(spark):
    # Of two letters only the first is possible with two options; without a count all five are.
    rows = [("D", 2), ("B", 2), ("either B or C", 2), ("answer: C, else A", 2), ("answer is D", 3), ("E", None)]
    assert parsed(spark, rows) == [None, "B", "B", "A", None, "E"]


@pytest.mark.parametrize("letter, answer, expected", [("B", "B", (True, False)), ("A", "B", (False, False)), (None, "B", (False, True))])
def test_grade(spark, letter, answer, expected):
    row = grade(spark.createDataFrame([(letter, answer)], "parsed string, answer string")).first()
    assert (row.correct, row.parse_failed) == expected
