"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm import (
    jaccard_join,
    mixing,
    packing,
    pieces,
    quality,
    secrets,
    substring_dedup,
    suffix_dedup,
    token_files,
    topk,
    url_filter,
    vector_codes,
    whitening,
)
from tollgate.session import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The rules of the url filter (verdict, host, path).
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    "op1_substring_dedup",
    rf"""
    WITH split AS (SELECT doc_id, {WORDS} AS w FROM documents),
    windows AS (SELECT doc_id, unnest(range(1, len(w) - {substring_dedup.WINDOW - 2})) AS i,
                       unnest([array_to_string(w[j:j + {substring_dedup.WINDOW - 1}], ' ') FOR j IN range(1, len(w) - {substring_dedup.WINDOW - 2})]) AS g
                FROM split WHERE len(w) >= {substring_dedup.WINDOW}),
    seen AS (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM windows),
    gone AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM seen, range({substring_dedup.WINDOW}) t(k) WHERE n > 1 GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
           sha256(array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT coalesce(list_contains(places, i), false)], ' ')) AS kept_sha256
    FROM split LEFT JOIN gone USING (doc_id)
    """,
)
def op1_substring_dedup(spark, sf):
    return substring_dedup.remove_repeats(table(spark, sf, "documents")).drop("n_spans")


RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)


@query(
    "op2_url_filter",
    rf"""
    WITH rules(verdict, host, path) AS (VALUES {RULE_ROWS}),
    rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
    split AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, r FROM rest),
    judged AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM split)
    SELECT j.page_id, j.host, j.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
           coalesce(arg_max(r.verdict, length(r.host || r.path)), '{url_filter.DEFAULT}') AS verdict
    FROM judged j LEFT JOIN rules r ON (j.host = r.host OR suffix(j.host, '.' || r.host)) AND starts_with(j.path, r.path)
    GROUP BY ALL
    """,
)
def op2_url_filter(spark, sf):
    return url_filter.filter_urls(table(spark, sf, "pages"), URL_RULES)


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf):
    return pieces.encode_pieces(table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"))


@query(
    "op4_top_k",
    f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (SELECT q.vec_id AS query_id, c.vec_id,
                     list_sum([q.e[i] * c.e[i] FOR i IN range(1, least(len(q.e), len(c.e)) + 1)])::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
    ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs)
    SELECT * FROM ranked WHERE rank <= {topk.K}
    """,
)
def op4_top_k(spark, sf):
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op5_secrets")
def op5_secrets(spark, sf):
    return secrets.report(secrets.scan(table(spark, sf, "documents")))


def _due_sql(share: str, slot: str) -> str:
    """The inverse of the curves' integrals, piece by piece."""
    out = "NULL"
    for number, knots in enumerate(mixing.CURVES):
        pieces = list(zip(knots, knots[1:], strict=False))
        areas = [(t2 - t1) * (a + b) / 2 for (t1, a), (t2, b) in pieces]
        for i, ((t1, a), (t2, b)) in enumerate(pieces):
            at, height, slope = sum(areas[:i]) / sum(areas), a / sum(areas), (b - a) / (t2 - t1) / sum(areas)
            rest = f"greatest({share} - {at!r}::DOUBLE, 0)"
            root = f"sqrt(greatest({height * height!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest}, 0))"
            time = f"{t1!r}::DOUBLE + coalesce(2.0::DOUBLE * {rest} / nullif({height!r}::DOUBLE + {root}, 0), 0)"
            out = f"CASE WHEN {slot} = {number} AND {share} >= {at!r}::DOUBLE THEN {time} ELSE {out} END"
    return out


@query(
    "op6_source_mix",
    rf"""
    WITH sized AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size,
                          md5('{mixing.SEED}-' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
    sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    numbered AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS source_no FROM sizes),
    weighted AS (SELECT *, {list(mixing.WEIGHTS)}[((source_no - 1) % {len(mixing.WEIGHTS)} + 1)::INT] AS weight, source_size * {mixing.MAX_EPOCHS} AS most FROM numbered),
    levels AS (SELECT *, most::DOUBLE / weight AS reach, row_number() OVER o AS place,
                      (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                      / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
               FROM weighted WINDOW o AS (ORDER BY most::DOUBLE / weight, source_no)),
    first AS (SELECT place AS from_place, level AS top FROM levels WHERE level <= reach ORDER BY place LIMIT 1),
    targets AS (SELECT source, source_no, source_size, CASE WHEN place >= from_place THEN top * weight ELSE most::DOUBLE END AS target FROM levels, first),
    rows AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.source_no, sum(s.size) OVER (PARTITION BY t.source_no ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
             FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
    copies AS (SELECT *, list_filter([2 * (e * source_size + upto) - size FOR e IN range({mixing.MAX_EPOCHS})], lambda m: m < 2 * target AND size > 0) AS middle FROM rows)
    SELECT doc_id, size, source_size, target, len(middle) * size AS taken,
           round({_due_sql("(middle[1] / (2 * target))", f"((source_no - 1) % {len(mixing.CURVES)})")}, 6) AS first_position
    FROM copies
    """,
)
def op6_source_mix(spark, sf):
    """The mix's copies in training order, summed up for each document."""
    planned = mixing.plan(table(spark, sf, "documents"))
    first = F.round(F.get("positions", 0), 6).alias("first_position")
    return planned.select("doc_id", "size", "source_size", "target", "taken", first).orderBy("first_position", "doc_id")


@query("op9_token_files")
def op9_token_files(spark, sf):
    """Written to the shared folder, then read back from the files."""
    folder = new_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf, "documents"), folder, vocabulary("word_bpe_49k.json"))
    return token_files.read_tokens(spark, folder)


@query(
    "op7_jaccard_join",
    rf"""
    WITH RECURSIVE split AS (SELECT doc_id, {WORDS.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE
                    list_distinct([array_to_string(w[j:j + {jaccard_join.SHINGLE - 1}], ' ') FOR j IN range(1, greatest(len(w) - {jaccard_join.SHINGLE - 2}, 2))]) END AS s FROM split),
    tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b USING (t) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
              HAVING 100 * count(*) >= {jaccard_join.PERCENT} * (a.n + b.n - count(*))),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
    SELECT doc_id, len(s)::BIGINT AS n_shingles, min(b) AS component_id FROM sets JOIN reach ON doc_id = a GROUP BY ALL
    """,
)
def op7_jaccard_join(spark, sf):
    return jaccard_join.join(table(spark, sf, "documents"))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark, sf):
    return suffix_dedup.remove_repeats(table(spark, sf, "documents"))


def _covered_sql(name: str, m: int) -> str:
    """Words in m-word windows found twice or more in their text."""
    return f"""
    {name}_at AS (SELECT doc_id, unnest(range(1, len(w) - {m - 2})) AS i,
                         unnest([array_to_string(w[j:j + {m - 1}], ' ') FOR j IN range(1, len(w) - {m - 2})]) AS g FROM split WHERE len(w) >= {m}),
    {name}_seen AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM {name}_at),
    {name} AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM {name}_seen, range({m}) t(k) WHERE n > 1 GROUP BY doc_id)"""


@query(
    "op10_quality",
    rf"""
    WITH split AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
    {_covered_sql("windows", quality.WINDOW)}, {_covered_sql("repeats", quality.MIN_REPEAT)}, {_covered_sql("longest", quality.LONGEST_REPEAT + 1)},
    lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM split),
    counts AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(windows.n, 0) AS n_repeat_words,
                      coalesce(repeats.n, 0) AS repeat_words, coalesce(longest.n, 0) > 0 AS too_long
               FROM split JOIN lines USING (doc_id) LEFT JOIN windows USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN longest USING (doc_id)),
    judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_WINDOW_SHARE} * n_words AS base_failed FROM counts)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_words, base_failed,
           NOT base_failed AND NOT too_long AND 100 * repeat_words <= {quality.MAX_SHARE} * n_words AS kept
    FROM judged
    """,
)
def op10_quality(spark, sf):
    return quality.quality(table(spark, sf, "documents")).drop("longest_repeat")


@query("op11_whitening")
def op11_whitening(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))[0]


@query("op12_packing")
def op12_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))


def _codes_sql() -> str:
    """Rounds of assignment and update as views, one after the other."""
    out = []
    for i in range(vector_codes.ROUNDS + 1):
        near = f"(SELECT r, p, min([list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, k]) AS best FROM parts JOIN book{i} USING (p) GROUP BY r, p)"
        out.append(f"near{i} AS MATERIALIZED (SELECT r, p, best[1] AS d, best[2] AS k, part FROM {near} JOIN parts USING (r, p))")
        if i < vector_codes.ROUNDS:
            sums = f"(SELECT p, k, j, floor(sum(part[j])::DOUBLE / count(*))::BIGINT AS m FROM near{i}, dims GROUP BY p, k, j)"
            out.append(
                f"book{i + 1} AS MATERIALIZED (SELECT p, k, coalesce(means, entry) AS entry FROM book{i} LEFT JOIN (SELECT p, k, list(m ORDER BY j) AS means FROM {sums} GROUP BY p, k) USING (p, k))"
            )
    return ",\n    ".join(out)


SQL["op13_vector_codes"] = f"""
    WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label,
                      list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS e, len(embedding) // {vector_codes.PARTS} AS w
                  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    dims AS MATERIALIZED (SELECT unnest(range(1, (SELECT max(w) FROM kept) + 1)) AS j),
    parts AS MATERIALIZED (SELECT r, p, e[p * w + 1:(p + 1) * w] AS part FROM kept, range({vector_codes.PARTS}) t(p)),
    book0 AS MATERIALIZED (SELECT p, r - 1 AS k, part AS entry FROM parts WHERE r <= {vector_codes.ENTRIES}),
    {_codes_sql()},
    coded AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{vector_codes.ROUNDS} GROUP BY r),
    digest AS (SELECT sha256(string_agg(entry[j]::VARCHAR, ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM book{vector_codes.ROUNDS}, dims)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM coded JOIN kept USING (r), digest
    """


@query("op13_vector_codes")
def op13_vector_codes(spark, sf):
    return vector_codes.compress(table(spark, sf, "embeddings"))
