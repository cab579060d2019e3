"""Every operator on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from candex.llm import language, lines, minhash, mixing, ngrams, packing, tokens, urls, vectors
from candex.llm.exact import DigestIndex, drop_copies
from candex.llm.rangecoder import decode_blocks, encode_blocks
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog and then runs far away from the old red barn near the river bank"
ROWS = [
    (1, PROSE, "en", "a"), (2, PROSE + " again", "en", "a"), (3, PROSE.upper(), "en", "b"), (4, None, None, None), (5, "", "en", "a"),
    (6, " \n\t ", "de", "b"), (7, LONG, "en", "c"), (8, LONG + " tail", "en", None), (9, "one two", "fr", "c"), (10, "One TWO", "fr", "c"),
    (11, "one  two\n", "fr", "c"), (12, "!!! 123 ...", "en", "b"), (None, "no id here at all", "en", "b"), (13, "äÖ ß ÄÖ", "de", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
EXTRA = "n long, key string, component string, rep long, vec_id long, digest string, size long, target double, _gone long, n_lines string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(spark, docs):
    names = [x.split() for x in EXTRA.split(", ")]
    return docs.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in names])


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def words(text):
    return (text or "").encode().lower().split()


# Exact dedup


def test_exact_dedup_keeps_the_longest_then_the_first(spark, docs, clashing, nothing):
    found = {r.doc_id: r for r in DigestIndex.open(spark).admit(clashing).collect()}
    assert {found[i].keep_id for i in (4, 5, 6)} == {6} and found[4].group_size == 3
    assert found[9].keep_id == 11 and found[11].kept and not found[9].kept
    assert found[10].keep_id == 10 and found[None].kept
    assert DigestIndex.open(spark).admit(nothing).count() == 0
    assert rows(DigestIndex.open(spark).admit(docs)) == rows(DigestIndex.open(spark).admit(clashing))
    left = drop_copies(clashing, DigestIndex.open(spark))
    assert left.columns == clashing.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 3, 6, 7, 8, 10, 11, 12, 13]


#: Null and repeated ids: some rows copy another document, others have a text of their own.
SHARED = [
    (1, PROSE), (None, PROSE), (None, "a text without id that nothing else has"), (2, "copied text of some words"),
    (5, "copied text of some words"), (5, "another text under the same id"),
]
SHARED_LEFT = sorted(SHARED[i][1] for i in (0, 2, 3, 5))


def test_exact_copies_go_row_by_row(spark):
    left = drop_copies(spark.createDataFrame(SHARED, "doc_id long, text string"), DigestIndex.open(spark))
    assert sorted(r.text for r in left.collect()) == SHARED_LEFT


def test_exact_index_lasts(spark, tmp_path):
    first = spark.createDataFrame([(7, "x y"), (8, "z")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "x   y  "), (2, "new"), (3, "n e w")], "doc_id long, text string")
    DigestIndex.open(spark, f"file://{tmp_path}/index", 4).admit(first).collect()
    again = DigestIndex.open(spark, f"file://{tmp_path}/index", 4)
    assert rows(again.admit(second).select("doc_id", "keep_id", "group_size", "kept")) == [(1, 7, 1, False), (2, 3, 2, False), (3, 3, 2, True)]
    assert [r.kept for r in DigestIndex.open(spark, f"file://{tmp_path}/index", 4).admit(second).collect()] == [False] * 3


# Near dedup


def brute_components(texts, k, percent):
    sets = {}
    for i, text in texts.items():
        w = words(text)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= percent * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                parent[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = {}
    for family in range(12):
        base = [f"f{family}w{i}" for i in range(int(rng.integers(30, 120)))]
        for _ in range(12):
            copy = list(base)
            for _ in range(int(rng.integers(0, 6))):
                copy[int(rng.integers(len(copy)))] = f"x{rng.integers(10**6)}"
            texts[len(texts)] = " ".join(copy) + ("\n" if rng.random() < 0.3 else "")
    # Chains: each text is near the next one only.
    chain = [f"c{i}" for i in range(140)]
    for at in range(0, 40, 4):
        texts[len(texts)] = " ".join(chain[at : at + 100])
    for text in (None, "", "  ", "solo", "SOLO", "two words", "a b c", "a b c d", "a b c d"):
        texts[len(texts)] = text
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    expected = brute_components(texts, 4, 80)
    found = minhash.near_duplicates(docs, words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_dedup_edges(spark, docs, clashing, nothing):
    found = {r.doc_id: r for r in minhash.near_duplicates(clashing).collect()}
    assert found[3].component_id == found[2].component_id == 1 and found[8].component_id == 7
    assert found[9].component_id == found[10].component_id == found[11].component_id == 9
    assert all(found[i].component_id == i and found[i].kept and found[i].n_shingles == 0 for i in (4, 5, 6))
    assert found[None].kept and found[None].component_id is None
    assert minhash.near_duplicates(nothing).count() == 0
    left = minhash.drop_near_duplicates(clashing)
    assert left.columns == clashing.columns and left.count() == len(ROWS) - 5


def test_near_copies_go_row_by_row(spark):
    left = minhash.drop_near_duplicates(spark.createDataFrame(SHARED, "doc_id long, text string"))
    assert sorted(r.text for r in left.collect()) == SHARED_LEFT


@given(st.lists(st.integers(0, 2**64 - 1), min_size=32, max_size=32), st.sets(st.integers(0, 31), max_size=15))
@settings(max_examples=60, deadline=None)
def test_signatures_within_the_distance_share_a_chunk(values, changed):
    a = np.array([v & 0xFFFF for v in values], np.uint16)
    b = a.copy()
    b[list(changed)] += 1
    differing = (a != b).reshape(minhash.CHUNKS, minhash.PER_CHUNK).sum(axis=1)
    assert differing.min() <= 1


def test_keys_of_near_signatures_meet(spark):
    rng = np.random.default_rng(1)
    pairs = []
    for _ in range(200):
        a = rng.integers(0, 1 << 16, 32).astype(np.uint16)
        b = a.copy()
        b[rng.choice(32, minhash.DISTANCE, replace=False)] ^= 1
        pairs.append((a.view(np.int64).tolist(), b.view(np.int64).tolist()))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    found = df.select(F.arrays_overlap(minhash._keys("a"), minhash._keys("b")).alias("meet"))
    assert {r.meet for r in found.collect()} == {True}


# Language


def test_language_edges(spark, docs, clashing, nothing):
    train = spark.createDataFrame([("the house and the tree", "en"), ("das haus und der baum ist gut", "de")] * 3, "text string, lang string")
    model = language.fit_languages(train)
    found = {r.doc_id: r for r in language.predict_language(clashing, model, ["doc_id"]).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (4, 5, 6, 12))
    assert found[1].lang_pred == "en" and found[3].lang_pred == "en" and 0.5 < found[1].score <= 1
    assert language.predict_language(nothing, model, ["doc_id"]).count() == 0
    empty = language.fit_languages(nothing)
    assert {r.lang_pred for r in language.predict_language(docs, empty, ["doc_id"]).collect()} == {"und"}


def test_languages_without_spaces_and_rare_ones_are_learned(spark):
    rng = np.random.default_rng(4)
    line = lambda letters: "".join(rng.choice(list(letters), 60))
    made = [(line("日本語文字漢学校"), "xx") for _ in range(4)] + [(line("กขคงจฉชซ"), "yy") for _ in range(4)]
    made += [(PROSE, "en")] * 50 + [(f"{PROSE} {i}", "en") for i in range(40)]
    model = language.fit_languages(spark.createDataFrame(made, "text string, lang string"), sample_docs=3)
    assert model.languages == ["en", "xx", "yy"]
    asked = spark.createDataFrame([(line("日本語文字漢学校"), "xx"), (line("กขคงจฉชซ"), "yy"), (PROSE, "en")], "text string, lang string")
    assert all(r.lang == r.lang_pred for r in language.predict_language(asked, model, ["lang"]).collect())


def brute_likelihood(word, prob):
    text, sums = "▁" + word, [1.0] + [0.0] * (len(word) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - language.LONGEST), end):
            piece = text[start:end]
            sums[end] += sums[start] * prob.get(piece, language.UNKNOWN if len(piece) == 1 else 0)
    return math.log(sums[-1])


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "bb"]
    prob = np.linspace(0.05, 0.2, len(pieces))
    model = language.LanguageModel(pieces, ["x"], np.append(prob, [language.UNKNOWN, 0])[:, None])
    known = dict(zip(pieces, prob, strict=True))
    found = model.word_scores(cases := ["a", "b", "ab", "abba", "abaab" * 4, "zab", "q", "ab" * 30])
    for word, score in zip(cases, found[:, 0], strict=True):
        assert score == pytest.approx(brute_likelihood(word, known), rel=1e-9)
    # So long that the sums must be scaled.
    assert model.word_scores(["ab" * 3000])[0, 0] == pytest.approx(100 * model.word_scores(["ab" * 30])[0, 0], rel=0.1)


# Mixing


def test_targets_share_and_stop(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 100), (None, 50)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert found["b"] == 30 and found["c"] == 300 and found[None] == 150 and found["a"] == pytest.approx(1160 - 480)


def test_mixture_takes_near_its_target(spark):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(["w"] * int(rng.integers(0, 60))), "abc"[min(2, i % 7)]) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    plan = mixing.plan_mixture(df).collect()
    assert len(plan) == 900 and rows(mixing.plan_mixture(df.repartition(7))) == sorted(map(tuple, plan))
    for source in "abc":
        mine = [r for r in plan if r.source == source]
        assert sum(r.size for r in mine) == mine[0].source_size
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 30
    assert all(r.taken <= 3 * r.size and r.taken == r.size * len(r.positions) and all(0 <= p <= 1 for p in r.positions) for r in plan)
    # The share of a growing source before the middle is that of its integral: 0.375.
    growing = [p for r in plan if r.source == "a" for p, n in [(p, r.size) for p in r.positions] for _ in range(n)]
    assert sum(p < 0.5 for p in growing) / len(growing) == pytest.approx(0.375, abs=0.01)


def test_mixture_edges(spark, docs, clashing, nothing):
    assert mixing.plan_mixture(nothing).count() == 0
    assert rows(mixing.plan_mixture(docs)) == rows(mixing.plan_mixture(clashing))
    assert {r.doc_id: r.taken for r in mixing.plan_mixture(docs).collect()}[4] == 0
    mixed = mixing.mixed(clashing)
    assert mixed.columns == clashing.columns
    plan = {r.doc_id: len(r.positions) for r in mixing.plan_mixture(docs).collect()}
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter({i: n for i, n in plan.items() if n})


def test_rows_that_share_an_id_have_their_own_takes(spark):
    # All null ids lie at one place of each line; the large source is taken to half of its words only.
    docs = [(i if i % 2 else None, " ".join(["w"] * (3 + i % 5)), "abc"[max(0, i - 158) % 3 if i >= 158 else 0]) for i in range(200)]
    docs += [(7, "seven words lie in another source too", "b"), (7, "w", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    plan, taken = Counter(), Counter()
    for r in mixing.plan_mixture(df).collect():
        plan[r.doc_id, r.source, r.size] += len(r.positions)
    for r in mixing.mixed(df).collect():
        taken[r.doc_id, r.source, len(r.text.split())] += 1
    assert +plan == taken and any(i is None for i, _, _ in taken)


# Packing


def brute_best_fit(sizes, sources, clusters, capacity, per_source):
    bins = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        fits = [
            (b["room"], i) for i, b in enumerate(bins)
            if b["room"] >= size and (cluster is None or cluster not in b["clusters"]) and (source is None or b["sources"][source] < per_source)
        ]
        if fits:
            at = min(fits)[1]
        else:
            at = len(bins)
            bins.append({"room": capacity, "clusters": set(), "sources": Counter()})
        bins[at]["room"] -= size
        bins[at]["clusters"].add(cluster)
        bins[at]["sources"][source] += 1
        out.append(at)
    return out


@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, 3, None])), max_size=60), st.integers(1, 3))
@settings(max_examples=150, deadline=None)
def test_best_fit_is_the_tightest_compatible_bin(items, per_source):
    sizes, sources, clusters = ([x[i] for x in items] for i in range(3))
    bins, offsets = packing.best_fit(sizes, sources, clusters, 20, per_source)
    assert bins == brute_best_fit(sizes, sources, clusters, 20, per_source)
    filled = defaultdict(int)
    for b, o, s in zip(bins, offsets, sizes, strict=True):
        assert o == filled[b]
        filled[b] += s


def test_packing_places_every_word(spark):
    docs = [(i, "ab"[i % 2], i % 5 or None, (i * 37) % 300) for i in range(400)] + [(1000, "a", 1, 1050), (1001, None, None, None)] * 2
    df = spark.createDataFrame(docs, "doc_id long, source string, cluster long, size long")
    found = packing.pack(df, capacity=100, shard_words=5000).collect()
    total = Counter()
    bins = defaultdict(list)
    for r in found:
        total[r.doc_id] += r.n_words
        bins[r.bin_id].append(r)
    wanted = Counter()
    for i, _, _, size in docs:
        wanted[i] += size or 0
    assert total == wanted
    facts = {d[0]: d for d in docs}
    for b, parts in bins.items():
        if b is None:
            assert all(r.n_words == 0 and r.offset is None for r in parts)
            continue
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.n_words
        assert at <= 100
        clusters = [facts[r.doc_id][2] for r in parts if facts[r.doc_id][2]]
        assert len(clusters) == len(set(clusters))
        assert all(n <= 2 for s, n in Counter(facts[r.doc_id][1] for r in parts).items() if s)
    assert packing.pack(df.limit(0)).count() == 0


# Tokens


@given(st.lists(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 9)), min_size=1, max_size=80), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_range_coder_round_trip(blocks):
    n = len(blocks[0])
    blocks = [np.array((b * n)[:n]) for b in blocks[:-1]] + [np.array(blocks[-1][:n])]
    found = decode_blocks(encode_blocks(blocks), [len(b) for b in blocks])
    assert all((a == b).all() for a, b in zip(blocks, found, strict=True))


def test_ids_of_a_run_cost_what_their_frequencies_say():
    rng = np.random.default_rng(3)
    kinds = rng.choice(49_152, 300, replace=False)
    ids = rng.choice(kinds, 64 * 512).astype(np.uint16)
    coded = list(tokens._coded(ids))
    assert sum(map(len, coded)) * 8 < 9 * len(ids)  # 8.23 bits is the entropy; 16.25 were taken before
    data = tokens.MAGIC + b"".join(coded)
    data += tokens._END.pack(len(data), 0, tokens.MAGIC)
    assert (np.concatenate(list(tokens.read_frames(np.frombuffer(data, np.uint8)))) == ids).all()


def test_order_0_adapts_in_each_block():
    rng = np.random.default_rng(6)
    kinds = rng.choice(49_152, 4000, replace=False)
    # Each block has twenty ids of its own in any order; over the run all 4000 are as frequent.
    ids = np.concatenate([rng.choice(rng.choice(kinds, 20, replace=False), 512) for _ in range(400)]).astype(np.uint16)
    coded = list(tokens._coded(ids))
    assert sum(map(len, coded)) * 8 < 11 * len(ids)  # 11.9 where the frequencies of the run stayed as they are
    data = tokens.MAGIC + b"".join(coded)
    data += tokens._END.pack(len(data), 0, tokens.MAGIC)
    assert (np.concatenate(list(tokens.read_frames(np.frombuffer(data, np.uint8)))) == ids).all()


def test_counts_of_order_0_in_long_blocks():
    from candex.llm.rangecoder import shares_of

    rng = np.random.default_rng(8)
    runs = {
        "one kind": np.full(3000, 9), "two kinds": rng.integers(0, 2, 3000) * 65_535, "few": rng.zipf(1.5, 3000) % 300,
        "many": rng.integers(0, 1 << 16, 3000), "in turn": np.arange(3000) // 700 * 9000,
    }
    for name, ids in runs.items():
        blocks = [ids[i : i + 1300].astype(np.uint16) for i in range(0, len(ids), 1300)]
        for shares in (shares_of(ids), None):
            found = decode_blocks(encode_blocks(blocks, shares), [len(b) for b in blocks], shares)
            assert all((a == b).all() for a, b in zip(blocks, found, strict=True)), name


def test_models_of_a_block_are_small():
    from candex.llm.rangecoder import _Lanes

    # A step reads the models of thousands of blocks; those of six tasks at once should stay in the cache. 2.5 KB before.
    assert sum(v.nbytes for v in vars(_Lanes(64)).values() if isinstance(v, np.ndarray)) / 64 < 1000


def test_range_coder_with_shares_of_its_ids():
    from candex.llm.rangecoder import shares_of

    rng = np.random.default_rng(4)
    runs = {
        "many kinds": rng.integers(0, 1 << 16, 40_000),  # above 4096 kinds, shares of 2**18
        "rare kinds": np.minimum(rng.zipf(1.3, 40_000) - 1, 65_535),
        "one kind": np.full(3000, 65_535),
        "one id": np.array([7]),
        "pairs": np.tile([5, 9, 5, 11], 5000),
        "mostly one": np.where(rng.random(100_000) < 0.0005, rng.integers(0, 4000, 100_000), 4000),
    }
    for name, ids in runs.items():
        blocks = [ids[i : i + 512].astype(np.uint16) for i in range(0, len(ids), 512)]
        shares = shares_of(ids)
        assert shares.sum() in (1 << 16, 1 << 18) and ((shares > 0) == (np.bincount(ids, minlength=1 << 16) > 0)).all(), name
        found = decode_blocks(encode_blocks(blocks, shares), [len(b) for b in blocks], shares)
        assert all((a == b).all() for a, b in zip(blocks, found, strict=True)), name


def test_carries_reach_every_word():
    from candex.llm.rangecoder import _Words

    words = _Words(2, 8)
    for lane, value in ((0, 7), (0, 65_535), (0, 65_535), (1, 3)):
        words.put(np.array([lane]), np.array([value << 48], np.uint64))
    words.carry(np.array([0]))
    assert [np.frombuffer(c, "<u2").tolist() for c in words.codes()] == [[8, 0, 0], [3]]


def test_damage_anywhere_in_a_run_is_noticed():
    ids = np.random.default_rng(5).integers(0, 900, 5000).astype(np.uint16)
    data = tokens.MAGIC + b"".join(tokens._coded(ids))
    end = tokens._END.pack(len(data), 0, tokens.MAGIC)
    for at in [*range(len(tokens.MAGIC), 60), *range(60, len(data), 61)]:
        broken = bytearray(data + end)
        broken[at] ^= 4
        try:
            found = np.concatenate(list(tokens.read_frames(np.frombuffer(bytes(broken), np.uint8))))
        except ValueError as error:
            assert "damaged" in str(error), at
        else:  # the last words of a code only end it
            assert (found == ids).all(), at


def test_token_files_round_trip(spark, docs, clashing, nothing):
    from tokenizers import Tokenizer

    files = tokens.write_tokens(clashing)
    found = tokens.read_tokens(spark, files).collect()
    tokenizer = Tokenizer.from_file(tokens.public_vocabulary())
    start = 0
    expected = []
    for i, text, _, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert rows(spark.createDataFrame(found)) == expected
    assert tokens.read_tokens(spark, tokens.write_tokens(nothing)).count() == 0


def test_words_alone_have_the_ids_they_have_in_a_text():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["It's 12 o'clock,\u00a0caf\u00e9 cafe\u0301 \u0301x", "<|endoftext|> a<|endoftext|>b ΟΔΟΣ İ", "\u2003wide\u3000space\x1cx\x85y", "", "'s 's'll !!"]
    ids, counts = tokens.WordTokens(tokens.public_vocabulary(), 2).encode(pa.array(texts, pa.large_string()))
    tokenizer = Tokenizer.from_file(tokens.public_vocabulary())
    wanted = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == wanted


def test_words_of_latin_letters_skip_what_leaves_them_alone():
    import pyarrow as pa

    coder = tokens.WordTokens(tokens.public_vocabulary(), 2)
    seen = []

    class Lean:
        def encode_batch_fast(self, texts, **options):
            seen.extend(" ".join(texts).split())
            return lean.encode_batch_fast(texts, **options)

    lean, coder.lean = coder.lean, Lean()
    text = "Straße, naïve CAFÉ ÿ zoo! zoo? cafe\u0301 \u017flong 12th don't ªµ ĳ ΟΔΟΣ über-all x1 ÆON"
    ids, _ = coder.encode(pa.array([text] * 3, pa.large_string()))
    assert sorted(seen) == ["naïve", "zoo", "ÿ"]
    assert ids.tolist() == [*coder.tokenizer.encode(text, add_special_tokens=False).ids, 2] * 3


def test_damage_is_noticed(spark, docs, tmp_path):
    files = tokens.write_tokens(docs, path=str(tmp_path))
    name = max(tmp_path.iterdir(), key=lambda p: p.stat().st_size)
    data = bytearray(name.read_bytes())
    data[200] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(tokens.read_frames(np.frombuffer(bytes(data), np.uint8)))


# URLs


def test_urls_against_the_plain_rule(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("Example.COM", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b", None, "block"), (None, "/", "block"), ("", "/", "block")]
    cases = [
        None, "", "no scheme", "http://x.net", "http://x.net/", "HTTP://Www.EXAMPLE.net/en/1?q#f", "http://example.net/enx", "x://net/a", "http://xnet/a",
        "http://m.example.com/de/1", "http://example.com/DE/1", "http://a.b", "http://c.a.b?x", "http://a.org/fr/", "http://a.org#/fr/", "://net/?y", "http://q/http://x.net/", "http://\nx.net/\n",
        "http://a..net/", "http://" + "x." * 3000 + "net/z",
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    built = urls.UrlRules.build(spark.createDataFrame(rules, "host string, path string, verdict string"))
    found = {r.page_id: r for r in urls.judge_urls(df, built, ["page_id"]).collect()}
    for i, url in enumerate(cases):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
            path = rest[len(host) :]
            path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        host = host.lower()
        fits = [(len(h + (p or "")), h + (p or ""), v) for h, p, v in [(h.lower(), p, v) for h, p, v in rules if h] if (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        best = max(fits, default=(0, None, "allow"))
        assert (found[i].host, found[i].path, found[i].rule, found[i].verdict) == (host, path, best[1], best[2]), url
    empty = urls.UrlRules.build(spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r.verdict for r in urls.judge_urls(df, empty, ["page_id"], default="block").collect()} == {"block"}
    assert urls.judge_urls(df.limit(0), built, ["page_id"]).count() == 0


def test_strings_with_one_key_are_told_apart(spark, tmp_path):
    built = urls.UrlRules.build(spark.createDataFrame([("a.b", "/", "block")], "host string, path string, verdict string"), f"file://{tmp_path}/r")
    probe = urls._Probe(built)
    probe.text = [np.frombuffer(b"a.c/", np.uint8)]
    assert probe.lookup(["a.b/"]) == [None]


# Vectors


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(2)
    made = []
    for label in (0, 1):
        for _ in range(40):
            centre = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 6))):
                made.append((centre + rng.standard_normal(16) * rng.choice([0.02, 0.08, 0.15]), label))
    dense = rng.standard_normal(16)
    made += [(dense + rng.standard_normal(16) * 0.01, 1) for _ in range(90)]
    data = [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(made)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3]
    for v in odd:
        data.append((len(data), v, 1))
    data.append((len(data), data[0][1], None))
    data.append((len(data), [2 * x for x in data[0][1]], 0))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(4)
    usable = [(i, np.array(v, float), label) for i, v, label in data if v and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = Counter(), {i: i for i, _, _ in data}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x, a in usable:
        for j, y, b in usable:
            if i < j and a == b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = sorted((top(i), top(j)))
                parent[q] = p
    found = vectors.near_vectors(df.withColumn("n", F.lit(1)).withColumn("component", F.lit("x"))).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == sorted((i, links[i], top(i), top(i) == i) for i, _, _ in data)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def grouped_vectors(sizes, noise):
    """``sizes[i]`` vectors around direction i of a chain, neighbours 0.985 apart, other directions below 0.98."""
    turn, rng = math.acos(0.985), np.random.default_rng(5)
    made = []
    for i, n in enumerate(sizes):
        # Pairs (0, 1), (2, 3), ... lie in planes of their own.
        centre = np.zeros(2 * len(sizes))
        centre[2 * (i // 2)], centre[2 * (i // 2) + 1] = math.cos(turn * (i % 2)), math.sin(turn * (i % 2))
        made += [(centre + noise * rng.standard_normal(len(centre)), i // 2) for _ in range(n)]
    return made


@pytest.mark.parametrize(("noise", "audited", "cell"), [(0.0, 512, 256), (1e-5, 512, 256), (1e-5, 0, 16)])
def test_vectors_link_groups_larger_than_their_lists(spark, monkeypatch, noise, audited, cell):
    monkeypatch.setattr(vectors, "CELL", cell)
    made = grouped_vectors([20, 20, 140, 0, 30, 30], noise)
    df = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, (v, _) in enumerate(made)], "vec_id long, embedding array<double>, label int")
    own = Counter(g for _, g in made)
    first = {g: next(i for i, (_, h) in enumerate(made) if h == g) for g in own}
    found = vectors.near_vectors(df.repartition(4), audited=audited).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(i, own[g] - 1, first[g]) for i, (_, g) in enumerate(made)]


def test_full_lists_are_enlarged_outside_their_component(spark):
    # Two groups that only the lists of other components can join: nothing but the first graph's links are given.
    made = [v for v, _ in grouped_vectors([20, 20], 1e-5)]
    rows = [(i, "0", 4, [float(x) for x in v], 0 if i < 20 else 20) for i, v in enumerate(made)]
    df = spark.createDataFrame(rows, "vec_id long, label string, dim int, vec array<double>, comp long")
    graph = vectors._descend(df, None, None, [0], 8, 2, 0.002, 0.98).collect()
    assert graph and all((r.v < 20) != (r.u < 20) for r in graph)
    assert {r.v for r in graph if r.link} | {r.u for r in graph if r.link} == set(range(40))


def test_forest_joins_what_all_links_join():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30):
        linked = rng.random((n, n)) < 0.04
        linked |= linked.T
        np.fill_diagonal(linked, False)
        child, parent = vectors._forest(linked)
        assert linked[child, parent].all() and len(set(child)) == len(child)
        reach = np.eye(n, dtype=bool)
        for _ in range(n):
            reach = reach @ (linked | np.eye(n, dtype=bool))
        assert n - len(child) == len({tuple(r) for r in reach})


# Language model


def test_kneser_ney_against_dictionaries(spark):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(40)]
    train = [" ".join(vocab[min(39, int(x))] for x in rng.zipf(1.5, int(n))) for n in rng.integers(0, 50, 60)] + [None, "", "W1 w2\tw3"]
    test = [*train[:5], "w1 unknown w2", "unknown", None, "", LONG]
    df = spark.createDataFrame(list(enumerate(train)), "doc_id long, text string").repartition(5)
    model = ngrams.fit_bigrams(df)
    end = b"\n"
    uni, bi = Counter(), Counter()
    for text in train:
        seq = [*words(text), end]
        uni.update(seq)
        bi.update(zip([end, *seq], seq, strict=False))
    n, v = sum(uni.values()), len(uni)
    ends, follow = Counter(b for _, b in bi), Counter()
    for (a, _), c in bi.items():
        follow[a] += c
    d = ngrams.modified_discounts([sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)])
    e = ngrams.modified_discounts([sum(c == k for c in ends.values()) for k in (1, 2, 3, 4)])
    left = sum(e[min(c, 3) - 1] for c in ends.values()) / len(bi)

    def chance(a, b):
        low = max(ends[b] - e[min(ends[b], 3) - 1], 0) / len(bi) if ends[b] else 0
        low += left / (v + 1)
        if not follow[a]:
            return low
        c = bi[a, b]
        freed = sum(d[min(x, 3) - 1] for (y, _), x in bi.items() if y == a)
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / follow[a] + freed / follow[a] * low

    found = {r.doc_id: r for r in ngrams.score_texts(spark.createDataFrame(list(enumerate(test)), "doc_id long, text string"), model, ["doc_id"]).collect()}
    for i, text in enumerate(test):
        seq = [*words(text), end]
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(seq), sum(uni[w] > 0 for w in seq), n)
        assert r.base_score == pytest.approx(sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in seq), rel=1e-9)
        if len(seq) < 1000:
            assert r.score == pytest.approx(sum(math.log10(chance(a, b)) for a, b in zip([end, *seq], seq, strict=False)), rel=1e-9)
    total = sum(chance(b"w1", w) for w in [*uni, b"unknown"])
    assert total == pytest.approx(1, rel=1e-9)


def test_language_model_of_nothing(spark, docs, nothing):
    model = ngrams.fit_bigrams(nothing)
    found = ngrams.score_texts(docs, model, ["doc_id"]).collect()
    assert len(found) == len(ROWS) and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in found)
    assert ngrams.score_texts(nothing, model, ["doc_id"]).count() == 0


# Lines


def test_lines_keep_one_copy_of_every_passage(spark, clashing, nothing):
    data = [
        (1, "a\nb\nc\nd\nend1"), (2, "x\n a \nb\n\nc\t\nd\ny"), (3, "s\ns\ns\ns\ns\ns"), (4, None), (5, ""), (6, "a\nb"), (7, "\n\n\n\n"), (8, "b\nc\nd"), (None, "a\nb\nc"),
        (9, "p\nq\nr"), (9, "p\nq\nr"),
    ]
    found = rows(lines.drop_repeated_lines(spark.createDataFrame(data, "doc_id long, text string")).select("doc_id", "text", "n_lines", "n_removed"))
    assert found == [
        (None, "", 3, 3), (1, "a\nb\nc\nd\nend1", 5, 0), (2, "x\n\ny", 7, 4), (3, "s\ns\ns", 6, 3), (4, None, 0, 0), (5, "", 1, 0),
        (6, "a\nb", 2, 0), (7, "\n\n\n\n", 5, 0), (8, "", 3, 3), (9, "p\nq\nr", 3, 0), (9, "p\nq\nr", 3, 0),
    ]
    assert lines.drop_repeated_lines(nothing).count() == 0
    out = lines.drop_repeated_lines(clashing)
    assert out.count() == len(ROWS) and {r.n_removed for r in out.collect()} == {0}
