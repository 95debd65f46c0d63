"""The numbered operators against brute force on small fixtures with odd rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from quartermill.llm import bpe, langid, neardup, neighbours, packing, quality, rules, runindex, sharding, substrings, warc

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, rid long, label string, n int, score double"


def prose(rng, n, words="the of stone river light amber quiet morning field window paper seven harbour lantern copper".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "ing", "ed", "s", "ly"]) + str(rng.randint(0, 9)) for _ in range(n))


def corpus():
    rng = random.Random(7)
    texts = [None, "", "   \n\t ", "one", "One TWO three", "a b \x1c c", "x" * 3000, "ab" * 400, "é" * 150, "日本語 テキスト " * 40]
    base = [prose(rng, 120) for _ in range(6)]
    for b in base:
        w = b.split()
        texts += [b, b, b.upper(), " ".join(w[:-4] + ["changed"] + w[-3:]), " ".join(w[:60] + prose(rng, 60).split()), "\n".join([b[:300]] * 3)]
    texts += [prose(rng, rng.randint(1, 300)) for _ in range(30)]
    texts.append(prose(rng, 9000))
    return [(i, t, rng.choice(["en", None]), "s", None, -i, "x", 1, 0.5) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), EXTRA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="module")
def repeated(spark):
    rows = corpus()[10:16]
    return spark.createDataFrame(rows + rows + [(None, rows[0][1], *rows[0][2:]), (10, "another text of this id", *rows[0][2:])], EXTRA)


TEXTS = {r[0]: r[1] for r in corpus()}


# 1 -------------------------------------------------------------------------------------


def check_packing(rows, texts, capacity):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    total = 0
    for doc, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        parts = sorted(by[doc], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            assert r.length == capacity or r.piece == 0
    for part in seq.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(seq), -(-total // capacity)


def test_packing(docs, nothing):
    path = P.path("byte_bpe_50k.json")
    used, least = check_packing(packing.pack(docs, path).collect(), TEXTS, 2048)
    assert used <= least + 1
    used, least = check_packing(packing.pack(docs, path, capacity=256, group_rows=20).collect(), TEXTS, 256)
    assert used <= least + 3
    assert packing.pack(nothing, path).count() == 0


def test_packing_of_repeated_rows_and_many_groups(spark):
    rng = random.Random(8)
    rows = [(7, prose(rng, 30))] * 400 + [(None, None)] * 3 + [(i, prose(rng, rng.randint(1, 60))) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), P.path("byte_bpe_50k.json"), capacity=512, group_rows=60).collect()
    assert sum(r.piece == 0 for r in got) == len(rows) and sum(r.doc_id is None for r in got) == 3
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    for part in seq.values():
        part.sort()
        assert [o for o, _ in part] == [sum(n for _, n in part[:k]) for k in range(len(part))] and sum(n for _, n in part) <= 512
    assert len(seq) <= -(-sum(r.length for r in got) // 512) + 3


def test_special_strings_and_odd_characters_go_through_the_library(spark):
    texts = {0: "a <|endoftext|> b", 1: "tab\x1fsep\x85next", 2: "\U0001f600 ok กำ"}
    check_packing(packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect(), texts, 2048)


def test_lower_bound_never_exceeds_the_best_packing():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.integers(1, 21, rng.integers(1, 9))
        best = min(bins(sorted(x.tolist(), reverse=True), [], 20))
        assert packing.lower_bound(x, 20) <= best <= len(packing.best_fit(sorted(x.tolist(), reverse=True), 20)[2])
    assert packing.lower_bound(np.array([11] * 5), 20) == 5


def bins(items, rooms, capacity):
    """Bin counts of all packings."""
    if not items:
        yield len(rooms)
        return
    for i, r in enumerate(rooms):
        if r >= items[0] and r not in rooms[:i]:
            yield from bins(items[1:], rooms[:i] + [r - items[0]] + rooms[i + 1 :], capacity)
    yield from bins(items[1:], [*rooms, capacity - items[0]], capacity)


# 2, 10 ---------------------------------------------------------------------------------


def test_quality(spark, nothing):
    rng = random.Random(1)
    good = [prose(rng, 80).capitalize() + "." for _ in range(300)]
    bad = [" | ".join(prose(rng, 40).split()) for _ in range(150)] + [" ".join([rng.choice(["buy", "click"])] * 50) for _ in range(50)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(1000, None), (1001, ""), (1002, "x " * 50_000)]
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(500)] + [(0, 1), (None, 1), (5, None)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i in range(500) if got[i].held_out]
    assert np.mean([got[i].predicted == int(i < 300) for i in held]) > 0.95
    assert quality.classify(nothing, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_languages(spark, nothing):
    rng = random.Random(2)
    kinds = {"aa": "kala mato sipi lunu".split(), "bb": "grosch tzwick pfahl stumb".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) + rng.choice(["", "e"]) for _ in range(rng.randint(3, 60))), k) for i in range(300) for k in [rng.choice(["aa", "bb"])]]
    odd = [(900, None, "aa"), (901, "", None), (902, "12 !? 34", "aa"), (903, "kala " * 60_000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "aa"
    held = [r for r in rows if got[r[0]].held_out]
    assert np.mean([got[i].lang_pred == k for i, _, k in held]) > 0.95
    assert langid.identify(nothing).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null")).collect()} <= {"und", ""}
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and not {900, 901, 902} & {r.doc_id for r in kept.collect()}


def test_ngrams_of_long_texts_are_those_of_the_whole(monkeypatch):
    text = "Ærøskøbing 7 straße, ".join("abcdefg hij".split()) * 20
    whole = np.sort(np.concatenate(list(langid.subwords(text))))
    for size in (2, 3, 7, 100):
        monkeypatch.setattr(langid, "SLICE", size)
        assert np.array_equal(np.sort(np.concatenate(list(langid.subwords(text)))), whole)


def test_samples_stay_bounded_whatever_ids_repeat(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda rows: seen.append(len(rows)))
    monkeypatch.setattr(quality, "train", lambda v, x, y: seen.append(len(x)))
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 and zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(one, f"text {k}", "en") for k in range(3000)] + [(i, "other words", f"l{i % 200}") for i in range(1000, 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.fit(docs)
    quality.fit(docs, spark.createDataFrame([(one, 1), (one, 1), *((i, i % 2) for i in range(1000, 1100))], "doc_id long, quality int"))
    assert seen[0] <= 64 * 10 and seen[1] <= 101


def test_filters_without_a_model_keep_their_documents(spark):
    docs = spark.createDataFrame([(1, "some words of a text", None), (2, None, None), (None, "more words", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(77, 0), (78, 1)], "doc_id long, quality int")  # of documents that are gone
    for kept in (langid.accepted(docs), quality.accepted(docs, labels), quality.accepted(docs, labels.limit(0))):
        assert kept.columns == docs.columns and sorted(kept.collect(), key=str) == sorted(docs.collect(), key=str)


# 3 -------------------------------------------------------------------------------------


def sets_of(texts, size):
    out = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").encode().lower())
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def brute_components(texts, size=4):
    sets, parent = sets_of(texts, size), {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(docs, nothing):
    want = brute_components(TEXTS)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert neardup.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_a_chain_and_of_unlike_texts_with_a_common_passage(spark):
    rng = random.Random(4)
    passage, texts = prose(rng, 60).split(), {}
    for i in range(60):  # about a half in common: many buckets, no links
        texts[i] = " ".join(passage + prose(rng, 40).split())
    chain = prose(rng, 100).split()
    for i in range(60, 80):  # neighbours are alike, ends aren't
        chain = chain[:]
        chain[(i * 13) % 90] = f"new{i}"
        texts[i] = " ".join(chain)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_components(texts)


def test_sets_of_few_shingles_match_at_their_similarity():
    rng = np.random.default_rng(5)
    for a, b in ((4, 5), (8, 10), (12, 15), (40, 50)):
        for bins in (neardup.ROWS * neardup.BANDS, neardup.SKETCH):
            same = []
            for _ in range(40):
                marks = np.unique(rng.integers(0, 1 << 63, b, np.uint64) * np.uint64(2))
                part = np.sort(rng.permutation(marks)[:a])
                same.append((neardup.signature(marks, bins) == neardup.signature(part, bins)).mean())
            assert abs(np.mean(same) - a / b) < 0.03, (a, b, bins)


def test_near_duplicates_of_short_templates(spark):
    rng, texts = random.Random(11), {}
    for t in range(12):
        base = [f"w{t}x{k}" for k in range(18)]
        for _ in range(60):  # sets of different sizes; unlike ones have smaller ids as often as not
            words = base[rng.randint(0, 6) : rng.randint(10, 18)]
            if rng.random() < 0.5:
                words[rng.choice((0, -1))] = f"v{rng.randint(0, 3)}"
            texts[len(texts)] = " ".join(words)
    ids = list(texts)
    rng.shuffle(ids)
    texts = dict(zip(ids, texts.values()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize("levels", [(400,), (300, 100)])
def test_texts_that_share_a_passage_part_in_few_turns(spark, monkeypatch, levels):
    """400 texts of 480 words, 400 of them a passage of all or of all and of ten, are unlike; a few near copies are not."""
    rng, made, turns = random.Random(13), {}, []
    word = lambda: f"u{rng.getrandbits(40)}"
    passage, groups = [f"p{k}" for k in range(levels[0])], [[f"g{g}x{k}" for k in range(sum(levels[1:]))] for g in range(40)]
    for k in range(400):
        made[k] = passage + groups[k % 40] + [word() for _ in range(80)]
    for k in range(0, 40, 4):
        made[400 + k] = made[k][:470] + [word() for _ in range(10)]
    texts = {k: " ".join(v) for k, v in made.items()}
    cut = neardup.cut
    monkeypatch.setattr(neardup, "cut", lambda df, tag: turns.append(tag) or cut(df, tag))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {k: k - 400 if k >= 400 else k for k in texts}
    assert turns.count("centres") <= 3


def test_rarest_shingles_meet_in_every_similar_pair(spark):
    rng = np.random.default_rng(6)
    sets = {k: np.unique(rng.integers(0, 60, rng.integers(1, 40)) ** 2) for k in range(150)}
    sets |= {1000 + k: np.unique(np.append(v[rng.random(len(v)) < 0.9], rng.integers(0, 60, 2))) for k, v in list(sets.items())}
    rows = [(k, len(v), v.tolist()) for k, v in sets.items()]
    for similarity in (80, 50):
        found = neardup.rare_first(spark.createDataFrame(rows, "rep long, n long, marks array<long>"), similarity).collect()
        keys, at = defaultdict(dict), defaultdict(set)
        for r in found:
            keys[r.rep][r.key] = r.at
            assert r.at not in at[r.rep] and r.key in sets[r.rep]
            at[r.rep].add(r.at)
        for a in sets:
            for b in (x for x in sets if x < a):
                common = len(np.intersect1d(sets[a], sets[b]))
                n, m = len(sets[a]), len(sets[b])
                if 100 * common >= similarity * (n + m - common):
                    meet = [k for k in keys[a] if k in keys[b]]
                    assert any((100 + similarity) * min(n - keys[a][k], m - keys[b][k]) >= similarity * (n + m) for k in meet), (a, b)


def test_near_duplicates_at_another_similarity(spark, docs):
    rng, texts = random.Random(12), {}
    for t in range(4):
        passage = prose(rng, 60).split()
        for _ in range(25):  # from a fifth to two thirds of the shingles in common
            texts[len(texts)] = " ".join(passage + prose(rng, rng.randint(14, 30)).split())
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets, want = sets_of(texts, 4), {i: i for i in texts}
    for i in texts:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j]):
                low, high = sorted((want[i], want[j]))
                want = {k: low if c == high else c for k, c in want.items()}
    assert 4 < len(set(want.values())) < 60
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(frame, similarity=60).collect()} == want
    with pytest.raises(ValueError):
        neardup.near_duplicates(docs, similarity=0)


def test_bands_of_any_similarity_miss_no_more():
    for rows, count in ((neardup.ROWS, neardup.BANDS), (14, 250)):
        if rows == neardup.ROWS:
            assert neardup.banding(80, rows, count) == (rows, count)
        for similarity in (10, 30, 60, 79, 81, 95, 99):
            r, n = neardup.banding(similarity, rows, count)
            assert r * n <= rows * count and (1 - (similarity / 100) ** r) ** n <= (1 - 0.8**rows) ** count * 1.000001


def test_near_duplicates_of_repeated_rows(repeated):
    got = neardup.near_duplicates(repeated).collect()
    rows = repeated.select("doc_id", "text").collect()
    # rows as documents of their own, null ids last: a component's id is the smallest doc_id of its rows
    order = sorted(range(len(rows)), key=lambda i: (rows[i].doc_id is None, rows[i].doc_id or 0))
    parts = brute_components({k: rows[i].text for k, i in enumerate(order)})
    want = sorted((str(rows[i].doc_id), parts[k][0], str(rows[order[parts[k][1]]].doc_id)) for k, i in enumerate(order))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert sum(r.first for r in got) == len({c for _, c in parts.values()})
    kept = neardup.one_of_each(repeated)
    assert kept.columns == repeated.columns and kept.count() == sum(r.first for r in got)


# 4 -------------------------------------------------------------------------------------


def test_sharding(docs, nothing):
    got = sharding.shard_by_bytes(docs, 6).collect()
    assert len(got) == len(TEXTS)
    sizes, slots, group = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        data = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "bytes") and r.grown_shard is None
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        group[TEXTS[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in group.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(sizes.values()) <= max(sum(sizes.values()) / 6 * 1.02, max(r.size for r in got))
    assert sharding.shard_by_bytes(nothing).count() == 0


def test_lumps_of_many_groups_and_a_heavy_one(spark):
    rng = random.Random(2)
    rows = [(5, "q" * rng.randint(1, 900) + str(i)) for i in range(1500)] + [(None, "heavy " * 40)] * 1200
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 6, items_at_once=200, lumps=20).collect()
    assert len(got) == len(rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len({r.shard for r in got if r.doc_id is None}) == 1
    heavy = sum(r.size for r in got if r.doc_id is None)
    rest = sorted(v for v in sizes.values())
    assert sum(sizes.values()) / 6 < heavy == rest[-1] or rest[-1] - rest[0] < 2000


def test_differencing_balances_better_than_greedy():
    rng = random.Random(3)
    items = [(i, rng.randint(1, 10_000)) for i in range(400)]
    got = sharding.differencing(items, 5)
    sums = Counter()
    for i, s in items:
        sums[got[i]] += s
    greedy = [0] * 5
    for _, s in sorted(items, key=lambda x: -x[1]):
        greedy[greedy.index(min(greedy))] += s
    assert len(got) == 400 and max(sums.values()) - min(sums.values()) <= max(greedy) - min(greedy)
    assert sharding.differencing([], 5) == {}


# 5 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk, overlap", [(40, 9), (64, 20), (32_768, 512)])
def test_bpe(spark, docs, nothing, chunk, overlap):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = ["a b  c\n\n\nd 'll we're  " * 20, " " * 700 + "z", "12 34\n\n" * 60, "\x1c\x85  a" * 40, "don't 'tis 're" * 30]
    texts = TEXTS | {500 + i: t for i, t in enumerate(more)}
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    for r in bpe.encode_decode(rows, path, P.PATTERN, chunk, overlap).collect():
        ids, data = library.encode_ordinary(texts[r.doc_id] or ""), (texts[r.doc_id] or "").encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(data).hexdigest()), r.doc_id
    assert bpe.encode_decode(nothing, path, P.PATTERN).count() == 0


# 6 -------------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 64)).astype(np.float32)
    x[100:160] = x[20]  # copies, and ties
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5, x[5].tolist(), 1), (700, None, 1), (701, [0.0] * 64, 1), (702, [float("nan")] * 64, 1), (703, [None] * 64, 1), (None, x[0].tolist(), 1), (720, [1.0, 2.0], 1)]
    got = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"), candidates=200, queries=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y, hits = x.astype(float), []
    for q in range(0, 600, 20):
        score = np.einsum("ij,j->i", y, y[q])
        want = sorted((-s, i) for i, s in enumerate(score) if i != q)[:20]
        hits.append(len({i for _, i in want} & {i for i, _ in got[q]}) / 20)
        assert all(score[i] == s for i, s in got[q]) and [(-s, i) for i, s in got[q]] == sorted((-s, i) for i, s in got[q])
    assert np.mean(hits) >= 0.97 and set(got) == set(range(0, 600, 20))
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, rank int")
    assert neighbours.nearest(few).count() == 2
    assert neighbours.nearest(few.limit(0)).count() == 0


# 7 -------------------------------------------------------------------------------------


def brute_base(text):
    data = (text or "").encode()
    words = WORD.findall(data)
    wins = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if wins[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(data.count(s) for s in b"#*$%&|<>".decode().encode() and [bytes([c]) for c in b"#*$%&|<>"]), dup, len(hit)


def test_rules(docs, nothing):
    got = rules.quality_rules(docs).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = brute_base(TEXTS[r.doc_id])
        assert tuple(r[c] for c in rules.BASE) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert rules.quality_rules(nothing).count() == 0


def test_adaptive_thresholds_reject_what_stands_out_of_its_source(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 80), "en", "a") for i in range(300)] + [(i, " ".join(w + "***" for w in prose(rng, 80).split()), "en", "a") for i in range(300, 310)]
    got = {r.doc_id: r.kept for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[i] for i in range(300, 310))


# 8 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("span", [1 << 25, 700])
def test_warc(spark, span):
    rng = random.Random(8)
    trap = "\x1f\u008b\x08 WARC/1.1\r\n\r\n"
    html = [None, "", "<p>x</p>", "<p>x</p>", trap * 20] + ["".join(chr(rng.randint(32, 300)) for _ in range(rng.randint(1, 3000))) for _ in range(20)] + ["<p>x</p>", "y" * 300_000]
    rows = [(i, f"http://h/{i}\r\n x", h, "r") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    got = {r.page_id: r for r in warc.warc_round_trip(pages, span).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        first[h or ""] = i
    for i, _, h, _ in rows:
        data = (h or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_payloads_and_ranges_that_begin_inside_a_record(tmp_path):
    members = [warc.record(i, "u", bytes([i]) * 50 + b"\x1f\x8b\x08", "response", None, "t") for i in range(5)]
    (tmp_path / "a").write_bytes(b"".join(members))
    size = sum(map(len, members))
    for step in (1, 37, size):
        rows = []
        for at in range(0, size, step):
            with open(tmp_path / "a", "rb") as f:
                rows += list(warc.records(f, at, min(at + step, size)))
        assert [r[0] for r in rows] == list(range(5)) and rows[3][6] == bytes([3]) * 50 + b"\x1f\x8b\x08"


# 9 -------------------------------------------------------------------------------------


def brute_repeats(texts, length=100):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int8)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = 1
            seen.add(w)
        gone = gone[: len(b)]
        kept = bytes(np.frombuffer(b, np.uint8)[gone == 0])
        out[i] = (len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [8000, 2])
def test_repeated_strings(docs, nothing, hot):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs, hot=hot).collect()}
    assert got == brute_repeats(TEXTS)
    assert substrings.remove_repeats(nothing).count() == 0


def test_repeated_rows_and_restored_columns(repeated):
    out = substrings.without_repeats(repeated)
    assert out.columns == repeated.columns and out.count() == 14
    assert sum(len(r.text) for r in out.collect()) < sum(len(r.text) for r in repeated.collect())


def test_run_length_index_finds_the_earliest_of_equal_windows():
    rng = random.Random(9)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(12, 60))) for _ in range(40)]
    index = runindex.RunLengthIndex(strings, 12)
    at = np.arange(int(index.ends[-1]) + 1)
    owner = np.searchsorted(index.starts, at, "right") - 1
    index.sampled(at + 12 <= index.ends[owner], at)
    first = {}
    for s, b in zip(index.starts.tolist(), strings):
        for o in range(len(b) - 11):
            first.setdefault(b[o : o + 12], s + o)
    n = 0
    for live, offset, earliest in index.stream():
        for i, o, e in zip(live.tolist(), offset.tolist(), earliest.tolist()):
            assert first[strings[i][o : o + 12]] == e
            n += 1
    assert n == sum(len(b) - 11 for b in strings) and len(index.run_start) < index.ends[-1]


# pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == columns, name
        texts = {r.doc_id: r.text for r in docs.collect()}
        kept = {r.doc_id: r.text for r in after.collect()}
        assert set(kept) <= set(texts)
        if name == "near_dedup":
            want = brute_components(texts, 5)
            assert set(kept) == {i for i, (_, c) in want.items() if i == c}
        if name == "suffix_array_dedup":
            want = brute_repeats(texts)
            assert set(kept) == set(texts)
            for i, (size, removed, spans, _) in want.items():
                assert 0 <= size - removed - len(kept[i].encode()) <= 6 * spans  # two letters cut in half a span, of 3 bytes at most
        docs = spark.createDataFrame(after.collect(), after.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    check_packing(packed, {r.doc_id: r.text for r in docs.collect()}, 2048)
