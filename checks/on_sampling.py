"""Quotas, samples and splits."""

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from tollgate.operators import sampling
from tollgate.session import new_path
from tollgate.sources import questions as source, tables


def allocate_sql(sizes: str, n: str) -> str:
    """The rule step by step: floors, at least one, leftovers by remainder, then take back
    from the largest one at a time. ``sizes`` is (key, size); gives CTE ``quotas``."""
    return f"""
sz AS ({sizes}),
alloc_raw AS (SELECT key, size, size / (SELECT sum(size) FROM sz)::BIGINT * least({n}, (SELECT sum(size) FROM sz))::BIGINT AS raw,
                     least({n}, (SELECT sum(size) FROM sz))::BIGINT AS want, (SELECT count(*) FROM sz) AS groups FROM sz),
alloc_base AS (SELECT *, least(size, CASE WHEN want >= groups THEN greatest(floor(raw), 1) ELSE floor(raw) END)::BIGINT AS base FROM alloc_raw),
alloc_left AS (SELECT *, want - (SELECT sum(base) FROM alloc_base) AS gap,
                      row_number() OVER (ORDER BY raw - base DESC, size DESC, key) AS turn FROM alloc_base),
alloc_topped AS (SELECT key, size, want, base + CASE WHEN gap > 0 AND turn <= gap THEN 1 ELSE 0 END AS q FROM alloc_left),
alloc_steps AS (
  SELECT list(key ORDER BY size DESC, key) AS keys, list(q ORDER BY size DESC, key) AS qs, max(want) AS want FROM alloc_topped
  UNION ALL
  SELECT keys, list_transform(qs, lambda q, i: CASE WHEN i = list_position(qs, list_max(qs)) THEN q - 1 ELSE q END), want
  FROM alloc_steps WHERE list_sum(qs) > want),
alloc_done AS (SELECT keys, qs FROM alloc_steps WHERE list_sum(qs) <= want),
quotas AS (SELECT key, quota::BIGINT AS quota FROM (SELECT unnest(keys) AS key, unnest(qs) AS quota FROM alloc_done))
"""


SUBJECT_SIZES = "SELECT subject AS key, count(*) AS size FROM questions GROUP BY subject"


# One sample smaller than the number of groups, one where small groups are lifted to a
# row each, one of ordinary size, one larger than the table.
for n in (30, 90, 300, 10_000_000):
    check(f"allocate_{n}", f"WITH RECURSIVE {v.QUESTIONS}, {allocate_sql(SUBJECT_SIZES, str(n))} SELECT key AS subject, quota FROM quotas")(
        lambda spark, sf, n=n: sampling.allocate(
            sampling.group_sizes(v.questions(spark, sf), ["subject"]), ["subject"], n
        ).select("subject", "quota")
    )


def sample_sql(rows: str, n: int, seed: int = 42) -> str:
    sizes = f"SELECT subject AS key, count(*) AS size FROM {rows} GROUP BY subject"
    return f"""
{allocate_sql(sizes, str(n))},
drawn AS (SELECT r.*, row_number() OVER (PARTITION BY subject ORDER BY {v.draw('id', seed)}, id) AS pick FROM {rows} r),
picked AS (SELECT d.* EXCLUDE (pick) FROM drawn d JOIN quotas ON key = subject WHERE pick <= quota),
sample AS (SELECT *, row_number() OVER (ORDER BY {v.draw('id', f'{seed}:order')}, id) AS sample_rank FROM picked)
"""


@check("stratified_sample", f"WITH RECURSIVE {v.QUESTIONS}, {sample_sql('questions', 300)} SELECT id, subject, sample_rank FROM sample")
def stratified_sample(spark, sf):
    return sampling.stratified_sample(v.questions(spark, sf), "subject", 300).select("id", "subject", "sample_rank")


# The same operator with strata cut into many slots and buckets.
@check("stratified_sample_cut", f"WITH RECURSIVE {v.orders_sql()}, {sample_sql('scored', 5000, 7)} SELECT id, subject, sample_rank FROM sample")
def stratified_sample_cut(spark, sf):
    rows = v.orders_scored(spark, sf)
    sample = sampling.stratified_sample(rows, "subject", 5000, seed=7, rows_per_slot=40, rows_per_bucket=700)
    return sample.select("id", "subject", "sample_rank")


@check("materialize_sample", f"WITH RECURSIVE {v.QUESTIONS}, {sample_sql('questions', 300)} SELECT id, subject, sample_rank FROM sample")
def materialize_sample(spark, sf):
    path = new_path(spark, "sample")
    source.materialize_sample(v.questions(spark, sf), path, 300)
    # The second call asks for another sample but finds the stored one.
    return source.materialize_sample(v.questions(spark, sf), path, 100, seed=1).select("id", "subject", "sample_rank")


def random_split_sql(rows: str) -> str:
    """Class quotas for the training side by largest remainder; the test side is the rest."""
    return f"""
class_size AS (SELECT need_strong AS c, count(*) AS size, (SELECT count(*) FROM {rows}) AS n FROM {rows} GROUP BY need_strong),
class_raw AS (SELECT *, n - ceil(0.3::DOUBLE * n)::BIGINT AS want, size / n * (n - ceil(0.3::DOUBLE * n)::BIGINT) AS raw FROM class_size),
class_train AS (SELECT *, floor(raw) + CASE WHEN row_number() OVER (ORDER BY raw - floor(raw) DESC, size DESC, c) <= want - sum(floor(raw)) OVER ()
                                            THEN 1 ELSE 0 END AS train FROM class_raw),
random_parts AS (SELECT id, CASE WHEN pick <= size - train THEN 'test' ELSE 'train' END AS part FROM (
    SELECT id, need_strong, row_number() OVER (PARTITION BY need_strong ORDER BY {v.draw('id')}, id) AS pick FROM {rows}) p
    JOIN class_train ON c = need_strong)
"""


@check("random_split", f"WITH {v.LABELLED}, {random_split_sql('labelled')} SELECT id, part FROM random_parts")
def random_split(spark, sf):
    return sampling.random_split(v.labelled(spark, sf)).select("id", "part")


@check("random_split_cut", f"WITH {v.orders_sql()}, {random_split_sql('scored')} SELECT id, part FROM random_parts")
def random_split_cut(spark, sf):
    return sampling.random_split(v.orders_scored(spark, sf), rows_per_slot=200).select("id", "part")


def folds_sql(rows: str, k: int = 5) -> str:
    """Largest group first, each to the lightest fold, one step per group. CTE ``folds``."""
    zeros = ", ".join(["0::BIGINT"] * k)
    return f"""
fold_groups AS (SELECT subject, size, row_number() OVER (ORDER BY size DESC, subject) AS turn
                FROM (SELECT subject, count(*) AS size FROM {rows} GROUP BY subject)),
fold_steps AS (
  SELECT 0::BIGINT AS turn, NULL::VARCHAR AS subject, NULL::INT AS fold, [{zeros}] AS load
  UNION ALL
  SELECT g.turn, g.subject, list_position(s.load, list_min(s.load))::INT - 1,
         list_transform(s.load, lambda w, i: CASE WHEN i = list_position(s.load, list_min(s.load)) THEN w + g.size ELSE w END)
  FROM fold_steps s JOIN fold_groups g ON g.turn = s.turn + 1),
folds AS (SELECT r.id, s.fold FROM {rows} r JOIN fold_steps s USING (subject))
"""


@check("group_folds", f"WITH RECURSIVE {v.LABELLED}, {folds_sql('labelled')} SELECT id, fold FROM folds")
def group_folds(spark, sf):
    return sampling.group_folds(v.labelled(spark, sf)).select("id", "fold")


@check("group_folds_orders", f"WITH RECURSIVE {v.orders_sql()}, {folds_sql('scored', 3)} SELECT id, fold FROM folds")
def group_folds_orders(spark, sf):
    return sampling.group_folds(v.orders_scored(spark, sf), k=3).select("id", "fold")


SPLITS = f"""
{random_split_sql('labelled')}, {folds_sql('labelled')},
splits AS (SELECT 'random' AS setup, id, 0 AS fold, part FROM random_parts
           UNION ALL SELECT 'unseen_subjects', id, fold, 'test' FROM folds)
"""


@check("make_splits", f"WITH RECURSIVE {v.LABELLED}, {SPLITS} SELECT setup, id, fold, part FROM splits")
def make_splits(spark, sf):
    path = new_path(spark, "splits")
    tables.write_splits(sampling.make_splits(v.labelled(spark, sf)), path)
    return tables.read_splits(spark, path)


@check(
    "split_balance",
    f"""
WITH RECURSIVE {v.LABELLED}, {SPLITS}, sides AS (
  SELECT setup, id, fold, part FROM splits
  UNION ALL SELECT s.setup, s.id, f.fold, 'train' FROM splits s JOIN (SELECT DISTINCT fold FROM folds) f ON s.fold <> f.fold
  WHERE s.setup = 'unseen_subjects')
SELECT setup, fold, part, count(*) AS n, count(*) FILTER (need_strong) AS positives, count(DISTINCT subject) AS subjects,
       count(*) FILTER (need_strong) / count(*) AS positive_rate
FROM sides JOIN labelled USING (id) GROUP BY setup, fold, part
""",
)
def split_balance(spark, sf):
    table = v.labelled(spark, sf)
    return sampling.split_balance(table, sampling.make_splits(table))
