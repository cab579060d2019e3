"""Rows that share an id, have none or repeat; work that must grow with the input only."""

from __future__ import annotations

import random
import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from candex.llm.exact import DigestIndex, drop_copies
from candex.llm.lines import drop_repeated_lines
from candex.llm.minhash import drop_near_duplicates, near_duplicates
from candex.llm.packing import best_fit
from candex.llm.tokens import read_tokens, write_tokens

WORDS = [f"w{i}" for i in range(400)]


def text(seed, n=60):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def test_links_of_rows_that_share_an_id(spark):
    a, b = text(1), text(2)
    rows = [(5, a), (5, b), (7, a + " tail"), (9, b + " tail"), (11, text(3))]
    found = {(r.doc_id, r.n_shingles): r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(k[0], r.component_id) for k, r in found.items()} == {(5, 5), (7, 5), (9, 5), (11, 11)}
    assert {k[0] for k, r in found.items() if r.kept} == {5, 11}


def test_near_copies_without_an_id_are_linked(spark):
    a = text(4)
    rows = [(None, a), (None, a + " tail"), (3, a + " other"), (None, text(5)), (None, None)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {3, None} and [r.doc_id for r in found if r.component_id and r.kept] == [3]
    assert sum(r.component_id == 3 for r in found) == 3


def test_one_row_of_each_group_stays(spark):
    a = text(6)
    rows = [(None, a, 1), (None, a, 2), (None, a + " tail", 3), (8, text(7), 4), (8, text(7), 5), (8, text(8), 6), (9, None, 7), (9, "", 8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, kept0 long")
    left = drop_near_duplicates(table)
    assert left.columns == table.columns
    kept = [r.kept0 for r in left.collect()]
    assert len(kept) == 4 and len({1, 2, 3} & set(kept)) == 1 and len({4, 5} & set(kept)) == 1 and 6 in kept and len({7, 8} & set(kept)) == 1
    assert sorted(r.kept0 for r in drop_near_duplicates(table).collect()) == sorted(kept)


def test_exact_copies_that_share_an_id_or_have_none(spark):
    rows = [(None, "same", 1), (None, "sa me", 2), (3, "q", 3), (3, "q", 4), (4, "x y", 5), (4, "xy", 6), (None, "alone", 7), (3, "other", 8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, digest long")
    left = drop_copies(table, DigestIndex.open(spark))
    kept = sorted(r.digest for r in left.collect())
    assert left.columns == table.columns
    assert len(kept) == 5 and {2, 5, 7, 8} <= set(kept) and len({3, 4} & set(kept)) == 1
    assert drop_copies(table.limit(0), DigestIndex.open(spark)).collect() == []


def test_a_third_of_all_rows_without_an_id(spark):
    rows = [(None, "hot text") for _ in range(3000)] + [(i, f"text {i}") for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert drop_copies(table, DigestIndex.open(spark)).count() == 6001
    found = DigestIndex.open(spark).admit(table)
    assert found.where("kept").count() == 6001 and found.where("doc_id IS NULL").agg(F.max("group_size")).first()[0] == 3000
    files = write_tokens(table)
    assert sum(files.tokens) == read_tokens(spark, files).agg(F.sum("n_tokens")).first()[0]


def test_an_index_with_a_batch_of_the_same_name(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc_id long, text string")
    verdicts = lambda index, docs, batch: sorted((r.doc_id, r.keep_id, r.kept) for r in index.admit(docs, batch=batch).collect())
    first = verdicts(DigestIndex.open(spark, path, 2), rows, "one")
    assert first == [(1, 1, True), (2, 2, True), (3, 2, False)]
    again = DigestIndex.open(spark, path, 2)
    assert verdicts(again, rows, "one") == first and spark.table(again.table).count() == 2
    more = spark.createDataFrame([(9, "b"), (10, "c")], "doc_id long, text string")
    assert verdicts(again, more, "two") == [(9, 2, False), (10, 10, True)]
    # Another writer appended a text that is there: it is one text all the same.
    spark.table(again.table).where("keep_id = 2").withColumns({"batch": F.lit("x"), "keep_id": F.lit(7).cast("long")}).write.insertInto(again.table)
    assert verdicts(again, more, "three") == [(9, 2, False), (10, 10, False)]
    again.close()


def test_documents_stay_where_nothing_is_labelled(spark):
    docs = spark.createDataFrame([(1, "some text", None, "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in corpus_pipeline.languages(spark, docs, "").collect()) == [1, 2]


@pytest.mark.parametrize("clusters", [lambda i: None, lambda i: i % 3, lambda i: 0 if i % 2 else i])
@pytest.mark.parametrize("sources", [lambda i: "one", lambda i: i % 5, lambda i: "hot" if i % 3 else f"s{i}"])
def test_bins_looked_at_grow_with_the_documents(sources, clusters):
    def looked(n):
        seen = []
        best_fit([5] * n, [sources(i) for i in range(n)], [clusters(i) for i in range(n)], 2048, 2, seen)
        return seen[0].looked

    assert looked(4000) <= 6 * max(looked(1000), 1000)


def test_lines_of_one_long_document(spark):
    def seconds(n):
        lines = [f"line {i} of many" for i in range(n)]
        body = "\n".join(lines + lines[10:20])
        table = spark.createDataFrame([(1, body), (2, None)], "doc_id long, text string")
        start = time.monotonic()
        found = {r.doc_id: r for r in drop_repeated_lines(table).collect()}
        assert (found[1].n_lines, found[1].n_removed, found[1].text) == (n + 10, 10, "\n".join(lines)) and found[2].text is None
        return time.monotonic() - start

    seconds(2000)
    # A split for every line would take 64 times as long.
    assert seconds(64_000) < 16 * max(seconds(8000), 0.5)
