"""Passages, strings, near copies and quality rules against plain versions."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import plain
from tollgate.llm import census, graph, jaccard_join, quality, substring_dedup, suffix_dedup
from tollgate.llm.words import Texts


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("part_bytes", [1500, 1 << 20])
def test_passages_are_removed(table_of, part_bytes):
    docs = plain.texts_with_repeats(1)
    got = substring_dedup.remove_repeats(table_of(docs), 12, part_bytes=part_bytes, with_text=True)
    assert rows(got.drop("n_spans", "kept")) == plain.without_passages(docs, 12)
    assert all(plain.sha(r.kept) == r.kept_sha256 for r in got.collect())


def test_sketch_may_overcount_only(table_of, monkeypatch):
    """With far too few cells most windows pass the estimate; the second pass sets it right."""
    monkeypatch.setattr(substring_dedup, "CELLS_PER_BYTE", 0)
    docs = plain.texts_with_repeats(2, 60)
    assert rows(substring_dedup.remove_repeats(table_of(docs), 9, rows=1).drop("n_spans")) == plain.without_passages(docs, 9)


@pytest.mark.parametrize(("length", "gap_bits", "part_bytes"), [(40, 2, 2000), (90, 4, 1 << 20), (400, 6, 1 << 20)])
def test_strings_are_removed(table_of, length, gap_bits, part_bytes):
    docs = plain.texts_with_repeats(3)
    got = suffix_dedup.remove_repeats(table_of(docs), length, gap_bits, part_bytes=part_bytes)
    assert rows(got) == plain.without_strings(docs, length)


def test_kept_bytes(table_of):
    docs = plain.texts_with_repeats(4, 30)
    got = suffix_dedup.remove_repeats(table_of(docs), 60, 3, with_bytes=True).collect()
    assert all(plain.sha(bytes(r.kept)) == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


def test_edges_of_a_passage_in_many_documents(table_of, monkeypatch):
    """No task gets more rows of a key than are put in order, though all documents hold the passage, some with the same beside it."""
    rnd, ordered = random.Random(5), suffix_dedup.ordered
    own = lambda: "".join(rnd.choice("abcdef ") for _ in range(rnd.randint(60, 120)))
    passage, some = own() + own() + own(), [own() for _ in range(4)]
    docs = [(i, (own() + rnd.choice(some))[-rnd.randint(3, 150) :] + passage + (rnd.choice(some) + own())[: rnd.randint(3, 150)]) for i in range(150)]
    docs += [docs[0], (500, own()), (None, passage)]

    def few(table):
        if max(Counter(table.column("key").to_pylist()).values()) > 20:
            raise ValueError("all rows of a key in one task")
        return ordered(table)

    monkeypatch.setattr(suffix_dedup, "ordered", few)
    monkeypatch.setattr(suffix_dedup, "SHARD_ROWS", 20)
    monkeypatch.setattr(suffix_dedup, "KEY_ROWS", 20, raising=False)
    got = suffix_dedup.remove_repeats(table_of(docs), 90, 4, part_bytes=4000)
    assert rows(got) == plain.without_strings(docs, 90)


def test_corpus_order_finds_partners_on_both_sides():
    """Rows of one core: the first two share four bytes left and two right, the third shares only its right side."""
    found = suffix_dedup.corpus_order([b"k"] * 3 + [b"other"], [b"abcd", b"abcd", b"xxcd", b"abcd"], [b"efgh", b"efzz", b"efgh", b"efgh"], np.full(4, 6), np.zeros(4, bool))
    assert [x.tolist() for x in found] == [[True, False, True], [False, False, True], [True, False, False], [False, False, False]]


@pytest.mark.parametrize(("group", "part_bytes"), [(256, 1 << 20), (3, 2500)])
def test_near_copies_form_groups(table_of, group, part_bytes):
    docs = plain.texts_with_repeats(5, 200)
    assert rows(jaccard_join.join(table_of(docs), group=group, part_bytes=part_bytes)) == plain.near_groups(docs)


def test_threshold_is_exact(table_of):
    """Twelve shared shingles of sixteen: 75 percent links, and one word more does not."""
    base = [f"w{i}" for i in range(20)]
    docs = [(1, " ".join(base)), (2, " ".join(base[:16])), (3, " ".join(base[:15]))]
    assert rows(jaccard_join.join(table_of(docs))) == Counter({(1, 16, 1): 1, (2, 12, 1): 1, (3, 11, 1): 1}) == plain.near_groups(docs)
    assert rows(jaccard_join.join(table_of([docs[0], docs[2]]))) == Counter({(1, 16, 1): 1, (3, 11, 3): 1})


def test_large_group_of_near_copies(table_of):
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(base[: i % 100] + [f"own{i}"] + base[i % 100 + 1 :])) for i in range(400)]
    assert {r.component_id for r in jaccard_join.join(table_of(docs), group=16).collect()} == {0}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 60), (7, 7)], "a long, b long")
    assert {(r.node, r.component) for r in graph.components(links).collect()} == {(i, 0) for i in range(41)} | {(50, 50), (60, 50)}


def test_quality_counts_and_limits(table_of):
    docs = plain.texts_with_repeats(6) + [(900, "a b\n\n a b\nc #|\n" * 9), (901, " ".join(f"u{i}" for i in range(60)))]
    got = quality.quality(table_of(docs)).collect()
    want = Counter()
    for i, t in docs:
        n, chars, symbols, lines, repeated, inside = plain.quality(t)
        failed = n < 20 or 100 * repeated > 30 * n
        bad = 100 * inside(quality.MIN_REPEAT) > quality.MAX_SHARE * n or inside(quality.LONGEST_REPEAT + 1) > 0
        want[i, n, chars, symbols, lines, repeated, failed, not failed and not bad] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want
    kept = quality.keep_good(table_of(docs))
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_longest_repeat_of_a_period():
    texts = Texts(pa.array(["a b " * 10, "a b c", None]))
    texts.find_words()
    assert quality.repeats(texts, 1).tolist() == [18, 17, *range(18, 0, -1), 0, 0, 0]


@pytest.mark.parametrize("run", [substring_dedup.remove_repeats, suffix_dedup.remove_repeats, jaccard_join.join, quality.quality, quality.keep_good])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_census_counts_across_parts():
    lists = [list(census.Keys(np.array(x, dtype=np.uint64)).lists(p, 1)) for p, x in enumerate(([1, 1, 5], [5, 9], [5]))]
    table = census.list_table([r for x in lists for r in x])
    answers = census._merge(table)
    assert {p: census.unpack_counts(f).tolist() for p, f in zip(answers["part"].to_pylist(), answers["flags"].to_pylist(), strict=True)} == {0: [2, 3], 1: [3, 1], 2: [3]}


def test_one_shared_hash_half_is_no_repeat():
    keys = census.Keys(np.array([4, 4, 4], dtype=np.uint64), np.array([1, 2, 1], dtype=np.uint32))
    assert keys.counts.tolist() == [2, 1] and keys.which.tolist() == [0, 1, 0]
