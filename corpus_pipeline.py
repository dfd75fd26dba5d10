"""From raw documents to token ids: the stages in order, each written as Parquet and read by the next one.

quality    rejects documents by the quality rules
near       keeps one document, the one with the smallest id, of each group of near copies
secrets    replaces every secret in the texts
mix        repeats and drops documents so that sources meet their target weights; its files are in training order, but a stage
           that reads them again need not keep it, so the order ends with this stage
pieces     encodes each copy with merge-dropout, varied from copy to copy

All but the last return the columns of ``documents``, further ones included. Null texts and texts without words go with
the quality rules. In the near stage rows are told apart by id and text: of rows that have both in common one stays, and rows with one
id but unlike texts are documents of their own. Of a group the smallest id stays, null last. An empty table passes through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollgate.llm import jaccard_join, mixing, pieces, quality, secrets
from tollgate.llm.queries import table, vocabulary
from tollgate.session import remove, scratch, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Ids made from texts begin here.
MADE_IDS = 1 << 62
#: Folders with the intermediate tables of the latest stage.
LEFT: list[str] = []


def tidy(stage: Stage) -> Stage:
    """When a stage begins, the result of the one before has been stored, so its intermediate tables can go."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while LEFT:
            remove(spark, LEFT.pop())
        with scratch(spark) as folder:
            LEFT.append(folder)
            return stage(spark, docs, sf_dir)

    return run


@tidy
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def new_name() -> str:
    """A column name that no table has."""
    return f"c_{uuid.uuid4().hex}"


@tidy
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, seen, n = new_name(), new_name(), new_name()
    id_ = F.col("doc_id").cast("long")
    # Rows whose id does not name them alone get a key of their own, made from id and text, beyond all given ones.
    repeated = written(docs.groupBy(id_.alias(seen)).agg(F.count("*").alias(n)).where((F.col(n) > 1) | F.col(seen).isNull()).select(seen), "repeated")
    made = F.lit(MADE_IDS) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(MADE_IDS))
    named = docs.join(repeated, id_.eqNullSafe(F.col(seen)), "left")
    named = named.withColumn(key, F.when(F.col(seen).isNotNull() | F.col("doc_id").isNull(), made).otherwise(id_)).drop(seen)
    with scratch(spark) as folder:
        joined = jaccard_join.join(named, id_col=key)
    if not repeated.limit(1).count():  # every key is an id
        first = written(joined.where("doc_id = component_id").select(F.col("doc_id").alias(key)), "first")
        remove(spark, folder)
        return named.join(first, key, "left_semi").select(docs.columns)
    members = joined.select(F.col("doc_id").alias(key), "component_id").join(named.select(key, id_.alias(seen)).distinct(), key)
    smallest = F.min(F.struct(F.col(seen).isNull(), F.col(seen), F.col(key).alias("key")))
    first = members.groupBy("component_id").agg(smallest.alias("first"))
    first = written(first.select(F.col("first.key").alias(key)), "first")
    remove(spark, folder)
    kept = named.join(first, key, "left_semi")
    if first.where(F.col(key) >= MADE_IDS).limit(1).count():  # such a key stands for all rows with one id and text
        is_made = F.col(key) >= MADE_IDS
        kept = kept.where(~is_made).unionByName(kept.where(is_made).dropDuplicates([key]))
    return kept.select(docs.columns)


@tidy
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row, clean = new_name(), new_name()
    found = secrets.scan(docs, carry=row)
    found = found.select(row, secrets.redacted(F.col(f"{row}.text"), F.col("spans")).alias(clean))
    size = F.when(F.col(clean) != F.col(f"{row}.text"), F.length(clean)).otherwise(F.col(f"{row}.n_chars")).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col(clean), "n_chars": size}
    return found.select(*[new.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in docs.columns])


@tidy
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = new_name()
    return mixing.curriculum(mixing.plan(docs, carry=row)).select(f"{row}.*")


@tidy
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copy = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("text")) - 1
    numbered = docs.select("doc_id", "text", copy.alias("copy"))
    return pieces.encode_pieces(numbered, vocabulary("piece_bpe_32k.model"), copy=F.col("copy"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("near", one_of_each),
    ("secrets", without_secrets),
    ("mix", mixed),
    ("pieces", encoded),
]
#: Seeded encoding has no SQL form; the tests hold the rows against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
