"""Secret scan with DataFrame functions only.

Base kinds are found by pattern. The method adds tokens that pass as random: a token's encoding is inferred
from its characters, and three tests of randomness over that alphabet (chi-squared uniformity, runs above and
below the middle, lag-one serial correlation) are combined by Fisher's rule into one p-value. Random strings have
uniform p-values; words, paths and names pile up near zero.

Which p-values count is found over all documents, for each class of length, since short tokens say less. Twice the
tokens with p over one half estimates how many are random; the others among those from a bar on are false discoveries. The bar is the
lowest one that holds their share at ``MAX_FALSE``. The table behind it has a row for each class and hundredth.

Spans count code points, end exclusive. Null text is empty. Documents are scanned one by one, so repeated rows and ids get
a row each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.arrays import in_lists
from tollgate.session import written

# The base kinds with their patterns, in order.
NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = "AKIA[A-Z0-9]{14,}"  # greedy, so the same matches as with + and 18 characters or more
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
CLASSES = (24, 32, 48, 64)  # lengths at which a class begins, after the first
MAX_FALSE = 0.1
BINS = 100
#: Encodings as (pattern, alphabet), the first that fits is taken.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("^[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    ("^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
# A published polynomial for the tail of the normal distribution.
TAIL_SCALE, TAIL = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
SPAN = "array<struct<start:int,end:int,text:string>>"
#: Values of a run, see ``running``; spans beyond which a text is taken apart into characters once.
RUN, MANY = 256, 64


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Values merged with all before them. Runs of values are folded by themselves, then shifted by the runs
    before, so the work grows with their number and not with its square."""

    def fold(xs: Column, first: Column) -> Column:
        last = lambda done: F.get(done, F.size(done) - 1)
        return F.aggregate(xs, F.array(first), lambda done, x: F.concat(done, F.array(merge(last(done), x))))

    local = F.transform(in_lists(values, RUN), lambda run: F.slice(fold(run, F.lit(0)), 2, RUN))
    before = lambda runs: fold(F.transform(runs, lambda run: F.get(run, F.size(run) - 1)), F.lit(0))
    shifted = lambda runs: F.flatten(F.zip_with(runs, F.slice(before(runs), 1, F.size(runs)), lambda run, base: F.transform(run, lambda x: merge(base, x))))
    return F.when(F.size(values) > 0, _let(local, shifted)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, text): lengths of gaps and matches summed up along the text."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def spans(found: Column) -> Column:
        items = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda t, g: F.struct(t.alias("text"), F.length(t).alias("length"), g.alias("gap")))
        ends = lambda items: running(F.transform(items, lambda x: x["gap"] + x["length"]), lambda a, b: a + b)
        placed = lambda x, end: F.struct((end - x["length"]).alias("start"), end.alias("end"), x["text"].alias("text"))
        return _let(items, lambda items: F.zip_with(items, ends(items), placed))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.rlike(text, F.lit(pattern)), _let(found, spans)).otherwise(F.array().cast(SPAN))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def two_sided(z: Column) -> Column:
    """Probability that a standard normal value lies further out than z."""

    def tail(z: Column, t: Column) -> Column:
        poly = F.lit(0.0)
        for c in reversed(TAIL):
            poly = (poly + c) * t
        return F.greatest(2 * 0.3989422804014327 * F.exp(-z * z / 2) * poly, F.lit(1e-300))

    return _let(F.least(F.abs(z), F.lit(30.0)), lambda z: _let(1 / (1 + TAIL_SCALE * z), lambda t: tail(z, t)))


def upper(z: Column) -> Column:
    """Probability that a standard normal value is greater than z."""
    return _let(z, lambda z: _let(two_sided(z) / 2, lambda half: F.when(z > 0, half).otherwise(1 - half)))


def alphabet(body: Column) -> Column:
    """The characters of the first encoding that fits, in order; null if none does."""
    out = F.lit(None).cast("string")
    for pattern, letters in reversed(ENCODINGS):
        out = F.when(F.rlike(body, F.lit(pattern)), F.lit(letters)).otherwise(out)
    return out


def p_random(token: Column) -> Column:
    """The combined p-value of a token under randomness in its inferred encoding; null if it has no
    encoding, or no digit or no letter, as words and numbers do."""

    def judged(body: Column) -> Column:
        codes = lambda a: F.transform(F.split(body, ""), lambda c: (F.instr(a, c) - 1).cast("double"))
        both = F.rlike(body, F.lit("[0-9]")) & F.rlike(body, F.lit("[A-Za-z]"))
        tested = _let(alphabet(body), lambda a: _let(F.length(a).cast("double"), lambda size: _let(codes(a), lambda c: _battery(c, size))))
        return F.when(both, tested)

    return _let(F.regexp_replace(token, "=+$", ""), judged)


def _battery(codes: Column, size: Column) -> Column:
    """Three tests of codes 0 ... size - 1 for randomness, as one p-value."""
    add = lambda s, x: s + x
    total = lambda xs: F.aggregate(xs, F.lit(0.0), add)
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def uniform(n: Column) -> Column:
        times = F.transform(F.array_distinct(codes), lambda c: F.size(F.filter(codes, lambda x: x == c)).cast("double"))
        chi = total(F.transform(times, lambda t: t * t)) * size / n - n
        spread = 2 / (9 * (size - 1))
        return upper((F.pow(F.greatest(chi, F.lit(0.0)) / (size - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))

    def runs(n: Column) -> Column:
        above = F.size(F.filter(codes, lambda x: x >= size / 2)).cast("double")
        changes = F.size(F.filter(pairs, lambda x: (x["a"] >= size / 2) != (x["b"] >= size / 2))).cast("double")
        mean = _let(above, lambda k: 2 * k * (n - k) / n)
        return two_sided(_let(mean, lambda m: (changes - m) / F.sqrt(F.greatest(m * (m - 1) / (n - 1), F.lit(1e-9)))))

    def serial(n: Column) -> Column:
        def z(m: Column) -> Column:
            spread = total(F.transform(codes, lambda x: (x - m) * (x - m)))
            cross = total(F.transform(pairs, lambda x: (x["a"] - m) * (x["b"] - m)))
            return (cross / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n)

        return two_sided(_let(total(codes) / n, z))

    def combined(n: Column) -> Column:
        logs = F.ln(F.greatest(uniform(n), F.lit(1e-300))) + F.ln(runs(n)) + F.ln(serial(n))
        return _let(-logs, lambda half: F.exp(-half) * (1 + half + half * half / 2))

    return _let(F.size(codes).cast("double"), combined)


def length_class(length: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(CLASSES):
        out = F.when(length >= least, i + 1).otherwise(out)
    return out


def bars(tokens: DataFrame, max_false: float = MAX_FALSE) -> dict[int, int]:
    """For each class of length the first hundredth of p that counts, from (length, p) of all tokens."""
    bin_ = F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int")
    counts = tokens.select(length_class(F.col("length")).alias("class"), bin_.alias("bin")).groupBy("class", "bin").count()
    table: dict[int, list[int]] = {}
    for row in counts.collect():  # classes times bins at most
        table.setdefault(row["class"], [0] * BINS)[row["bin"]] = row["count"]
    out = {}
    for number, by_bin in table.items():
        random = 2 * sum(by_bin[BINS // 2 :])
        for bar in range(BINS // 2 + 1):
            found = sum(by_bin[bar:])
            if found - random * (BINS - bar) / BINS <= max_false * found:
                break
        out[number] = bar
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_false: float = MAX_FALSE, carry: str | None = None) -> DataFrame:
    """One row per document: doc_id, ``base`` and ``spans``, arrays of (start, kind_no, end) in order, where
    ``spans`` has the base ones and the tokens found random that overlap none of them. ``carry`` names a struct in which the input row comes along.
    What the patterns find is written to the shared folder once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(carry)] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("scanned"), *row)
    assign = F.filter(matches(F.col("scanned"), ASSIGN), lambda s: F.length(F.regexp_extract(s["text"], f"^(?:{ASSIGN})", 2)) >= ASSIGN_LEAST)
    numbered = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind_no"), s["end"].alias("end")))
    base = F.array_sort(F.concat(numbered(assign, 0), numbered(matches(F.col("scanned"), ACCESS), 1), numbered(matches(F.col("scanned"), HEX), 2)))
    judged = F.transform(
        matches(F.col("scanned"), TOKEN), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), p_random(s["text"]).alias("p"))
    )
    rows = rows.withColumn("base", base).withColumn("tokens", judged)
    alone = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    rows = rows.withColumn("tokens", F.filter("tokens", lambda t: t["p"].isNotNull() & alone(t)))
    rows = written(rows.drop("scanned"), "secrets")
    each = rows.select(F.explode("tokens").alias("t")).select((F.col("t.end") - F.col("t.start")).alias("length"), F.col("t.p").alias("p"))
    lowest = bars(each, max_false)

    def counts(t: Column) -> Column:
        bar = F.lit(BINS)
        for number, least in lowest.items():
            bar = F.when(length_class(t["end"] - t["start"]) == number, F.lit(least)).otherwise(bar)
        return t["p"] * BINS >= bar

    random = F.transform(F.filter("tokens", counts), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind_no"), t["end"].alias("end")))
    out = rows.withColumn("spans", F.array_sort(F.concat("base", random)))
    return out.select("doc_id", "base", "spans", *[carry] * bool(carry))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind_no"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced; spans that overlap are replaced as one."""
    tops = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))

    def joined(part: Callable[[Column, Column], Column]) -> Column:
        """``part`` is the text from one place to another; a span adds what stands between it and the spans before."""

        def pieces(tops: Column) -> Column:
            from_ = F.concat(F.array(F.lit(0)), F.slice(tops, 1, F.size(tops) - 1))
            each = F.zip_with(spans, from_, lambda s, at: F.when(s["start"] >= at, F.concat(part(at, s["start"]), F.lit(mark))).otherwise(""))
            return F.concat(F.array_join(each, ""), part(F.get(tops, F.size(tops) - 1), F.length(text)))

        return _let(tops, pieces)

    few = joined(lambda a, b: F.substring(text, a + 1, b - a))
    many = _let(F.split(text, ""), lambda chars: joined(lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), "")))
    return F.when(F.size(spans) > MANY, many).when(F.size(spans) > 0, few).otherwise(text)
