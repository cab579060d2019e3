"""The queries and the pipeline on the given tables, against SQL or plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from candex.llm.mixing import CURRICULUM
from candex.llm.queries import ORACLES, QUERIES

from tests.llm.test_small import brute_components

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SPACES = re.compile(r"[\x20\x09-\x0D]")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    df = QUERIES[name](spark, FOLDER)
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got = Counter(tuple(r[c] for c in names) for r in df.collect())
    assert got == Counter(map(tuple, cursor.fetchall())) and got


def test_near_dedup_query(spark, texts):
    expected = brute_components({i: r.text for i, r in texts.items()}, 4, 80)
    found = QUERIES["op3_minhash_near_dedup"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_token_query(spark, texts):
    from candex.llm.tokens import public_vocabulary
    from tokenizers import Tokenizer

    tokenizer, start, expected = Tokenizer.from_file(public_vocabulary()), 0, []
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i].text or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op1_token_files"](spark, FOLDER).collect())) == expected


def test_language_query_on_held_out_documents(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    found = QUERIES["op7_language_id"](spark, LARGER).collect()
    assert len(found) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_model_query(spark):
    docs = {r.doc_id: words(r.text.lower() if r.text else "") for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    count = Counter(w for i, ws in docs.items() if i not in held for w in [*ws, b"\n"])
    total, kinds = sum(count.values()), len(count)
    found = QUERIES["op6_kneser_ney"](spark, LARGER).collect()
    gain = []
    for r in found:
        seq = [*docs[r.doc_id], b"\n"]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (r.doc_id in held, len(seq), total)
        if docs[r.doc_id] == [w.lower() for w in docs[r.doc_id]] and all(w.isascii() for w in seq):
            assert r.n_known == sum(count[w] > 0 for w in seq)
            assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in seq), rel=1e-3)
        if r.held_out:
            gain.append((r.score, r.base_score))
    assert sum(s for s, _ in gain) > sum(b for _, b in gain)


def packed_rightly(rows, sizes, facts, capacity=2048, per_source=2):
    """Every word is placed once, bins are filled without gaps, and conflicts are kept apart."""
    placed, bins = Counter(), defaultdict(list)
    for r in rows:
        placed[r.doc_id] += r.n_words
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    assert placed == sizes
    for parts in bins.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0, *(r.n_words for r in parts)])[:-1])
        assert sum(r.n_words for r in parts) <= capacity
        sources, clusters = (Counter(facts[r.doc_id][i] for r in parts) for i in (0, 1))
        assert max(clusters.values()) == 1 and max(n for s, n in sources.items()) <= per_source
    return len(bins)


def test_packing_query(spark, texts):
    sizes = Counter({i: len(words(r.text)) for i, r in texts.items()})
    facts = {i: (r.source, SPACES.sub("", r.text or "")) for i, r in texts.items()}
    bins = packed_rightly(QUERIES["op8_conflict_packing"](spark, FOLDER).collect(), sizes, facts)
    assert sum(sizes.values()) / 2048 / bins > 0.85


def brute_mixture(docs):
    """How often each document is taken: targets by weight with a cap, then the line of the source in MD5 order."""
    size = {i: len(words(r.text)) for i, r in docs.items()}
    per = Counter()
    for i, r in docs.items():
        per[r.source] += size[i]
    ranked = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: k % len(CURRICULUM) + 1 for k, s in enumerate(ranked)}
    target, free = {}, set(per)
    while True:
        left = sum(per.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > 3 * per[s]}
        if not over:
            break
        target |= {s: 3 * per[s] for s in over}
        free -= over
    target |= share
    takes = {}
    for s in per:
        at = 0
        for i in sorted((i for i in docs if docs[i].source == s), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
            takes[i] = sum(at + size[i] / 2 + k * per[s] < target[s] for k in range(3))
            at += size[i]
    return takes, size


def test_pipeline_stage_by_stage(spark, texts):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    df, results = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    columns = df.columns
    for _, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.pin(stage(spark, df, FOLDER))
        results.append((df.columns, df.collect()))
    assert all(c == columns for c, _ in results[:-1])
    told, exact, near, mixed = ({r.doc_id: r for r in rows} for _, rows in results[:-1])
    # All documents here are in known languages.
    assert set(told) == {i for i, r in texts.items() if any(map(str.isalpha, r.text or ""))}
    best = {}
    for i, r in told.items():
        key = SPACES.sub("", r.text)
        best[key] = min(best.get(key, (0, math.inf)), (-len(r.text), i))
    assert set(exact) == {i for _, i in best.values()}
    top = brute_components({i: r.text for i, r in exact.items()}, 5, 80)
    assert set(near) == {i for i, (_, t) in top.items() if t == i}
    takes, size = brute_mixture(near)
    assert Counter(r.doc_id for r in results[3][1]) == Counter({i: n for i, n in takes.items() if n})
    assert all(mixed[i].text == texts[i].text for i in mixed)
    facts = {i: (r.source, i) for i, r in near.items()}
    packed_rightly(results[4][1], Counter({i: n * size[i] for i, n in takes.items() if n}), facts)
    assert sorted(map(str, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(str, results[4][1]))
