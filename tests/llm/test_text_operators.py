from __future__ import annotations

import hashlib
import random
import time
import re

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from geoloom.llm import byte_bpe, decontaminate, shared, simhash
from geoloom.llm.components import components
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, source string, fp string, term string"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "  \n a", "don't we'll I'ves 'tis ''s 're x'", "a\n\n b c 　　d", "éa1²½ 12a!!  !", "x" * 3000, "\U0001f600\U0001f600 z", "a'", "'s", " 's", "\t'm a'll", "tail  ", "́a"]


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_token_encodes_to_itself():
    bpe = byte_bpe.load(PATH)
    for token, rank in list(bpe.ranks.items()):
        if len(token) > 1:
            saved = bpe.ranks.pop(token)  # without the shortcut for whole tokens, by merges alone
            try:
                parts = bpe.leaf(token)
            finally:
                bpe.ranks[token] = saved
            assert b"".join(bpe.tokens[p] for p in parts) == token and len(parts) == 2, (token, rank)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abestrvlmd' \n\tA1é² !#\U0001f600"), max_size=30), st.text(max_size=12))
def test_pieces_follow_the_pattern(a, b):
    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = [a, "", b, a + b]
    raw, at = byte_bpe.text_bytes(pa.array(texts))
    got = byte_bpe.piece_starts(raw, at).tolist()
    want = [int(at[k]) + len(t[: m.start()].encode()) for k, t in enumerate(texts) for m in pattern.finditer(t)]
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=200), st.integers(1, 199))
def test_join_is_the_encoding_of_the_whole(data, at):
    bpe = byte_bpe.load(PATH)
    whole = bpe.leaf(data)
    assert bpe.join(bpe.leaf(data[:at]) if data[:at] else [], bpe.leaf(data[at:]) if data[at:] else []) == whole
    assert bpe.encode(data) == whole and bpe.decode(whole) == data


def test_byte_bpe_query_digests(spark, reference):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("th ine\nraé'") for _ in range(500)) for _ in range(20)] + [ODD[4]] * 2
    docs = spark.createDataFrame([(i if i else None, t, "s", "f", "t") for i, t in enumerate(texts)], DOCS)
    rows = byte_bpe.round_trip(docs, PATH).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        want.append((i if i else None, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    tokens = byte_bpe.encode(docs, PATH)
    back = {r.doc_id: bytes(r.data).decode() for r in byte_bpe.decode(tokens, PATH).collect()}
    assert back == {(i if i else None): t or "" for i, t in enumerate(texts)}


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def near_corpus(n, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(150)] for _ in range(n)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for _ in range(rng.randrange(6)):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(150)] = "É" + str(rng.randrange(9))
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy))
    return texts + [None, "", " \n", "one", "One", "one two", "one two three"]


@pytest.mark.parametrize("block", [2048, 2])
def test_simhash_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    texts = near_corpus(40, 5)
    docs = spark.createDataFrame([(i, t, "s", "f", "t") for i, t in enumerate(texts)], DOCS)
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [rows[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [rows[i].component_id for i in range(len(texts))] == brute_components(fps)


def test_simhash_ids_of_any_type_and_hot_fingerprints(spark):
    rows = [(f"d{i:04d}" if i % 7 else None, "same words here" if i % 2 else None) for i in range(2000)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string").withColumns({"low": F.lit(1), "n": F.lit(2)})).collect()
    assert len(out) == 2000 and {(r.fingerprint == "0" * 16, r.component_id) for r in out} == {(False, "d0001"), (True, "d0002")}


def test_simhash_links_random_close_fingerprints(spark):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps for _ in range(4)]
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    roots = {r.node: r.root for r in components(links).collect()}
    groups = brute_components(fps)
    for i, x in enumerate(signed):
        for j in range(i):
            assert (roots.get(x, x) == roots.get(signed[j], signed[j])) == (groups[i] == groups[j])


def test_components_of_a_long_chain_and_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (7, 6), (900, 901)], "u long, v long")
    got = {r.node: r.root for r in components(chain).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_contamination(texts, items, window=13):
    word = re.compile(decontaminate.WORD)
    cut = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in texts:
        words, hit, found = cut(t), set(), set()
        for name, item in items:
            w = cut(item)
            n = min(window, len(w))
            for i in range(max(1, len(w) - window + 1) if w else 0):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == w[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(name))
        out.append((len(words), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("segment, kind, wide", [(2 << 20, "long", False), (300, "string", False), (60, "long", True)])
def test_contamination_against_brute_force(spark, monkeypatch, segment, kind, wide):
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", segment)
    if wide:  # plans too large to broadcast, and rarest terms of more than two segments dealt out
        monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(shared, "LEAST_HEAVY", 2)
    rng = random.Random(2)
    words = [f"t{k}" for k in range(12)] + ["É", "the"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 13, 14, 20])))) for k in range(12)] + [(12, ""), (13, None), (2, "zz yy"), (14, "The-T1"), (14, "the t1")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(30)] + [None, "", "..."]
    texts += [f"{a} {i} {a}" for a in ("x y", "") for _, i in items]
    docs = spark.createDataFrame([(f"d{i:03d}" if kind == "string" else i, t, "s", 1, 2) for i, t in enumerate(texts)], f"doc_id {kind}, text string, term string, n_words int, segment int")
    rows = sorted(decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert [(r.n_words, r.n_hit, r["items"]) for r in rows] == brute_contamination(texts, items)


def test_items_without_an_id_count_as_hits(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d"), (2, "d"), (None, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "b c"), (7, "c")], "item_id long, text string")
    rows = sorted((r.doc_id or 0, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, items).collect())
    assert rows == [(0, 2, ["7"]), (1, 2, ["7"]), (2, 0, []), (2, 0, [])]
    left = decontaminate.remove_contaminated(docs.withColumns({"_key": F.lit("k"), "_bad": F.lit("b")}), items)
    assert sorted(map(tuple, left.collect())) == [(2, "d", "k", "b")] * 2


def test_proximity_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 150)
    rng = random.Random(5)
    texts = ["a x b y c", "c b a", "a b x x x x c", "b c", "a", "a a b c c"] + [" ".join(rng.choice("abcdx") for _ in range(rng.randrange(40))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "s", "f", "t") for i, t in enumerate(texts)], DOCS)
    items = ["a b c", "d", "b b d"]
    named, of_items = decontaminate.windows(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), 13)
    found = decontaminate.search(decontaminate.build_index(docs), named, within=5)
    ids = {(r.segment, r.place): r.doc_id for r in found.filter("wid is null").collect()}
    got = {(ids[r.segment, r.place], r.item, r.start, r.end) for r in found.filter("wid is not null").join(of_items, "wid").collect()}
    want = set()
    for i, text in enumerate(texts):
        w = text.split()
        for k, item in enumerate(items):
            terms = set(item.split())
            for end in range(len(w)):
                start = max((s for s in range(end + 1) if terms <= set(w[s : end + 1])), default=None)
                if w[end] in terms and start is not None and end - start < 5:
                    want.add((i, str(k), start, end + 1))
    assert got == want and {i for i, k, _, _ in got if k == "0"} >= {0, 1, 5}


def test_long_pieces_and_the_tree(reference):
    bpe, rng = byte_bpe.load(PATH), random.Random(1)
    for k in range(400):
        some = rng.choice([b"-", b"-=", b"ab", b"etaoin", bytes(range(97, 123)), bytes(range(256)), b" \n"])
        data = bytes(rng.choice(some) for _ in range(rng.choice([5, 17, 33, 70, 130, 300, 1000])))
        assert bpe.encode(data) == bpe.leaf(data) == reference._core_bpe.encode_single_piece(data) and bpe.decode(bpe.encode(data)) == data
    for data in (b"-" * 1_000_001, b"-=-" * 100_000, b" " * 777_777):
        begin = time.monotonic()
        assert bpe.encode(data) == reference._core_bpe.encode_single_piece(data) and time.monotonic() - begin < 10


def test_round_trip_of_very_long_texts(spark, reference):
    texts = ["-" * 500_000, "word " * 200_000, " " * 300_000 + "x"]
    rows = {r.doc_id: r for r in byte_bpe.round_trip(spark.createDataFrame(list(zip("abc", texts)), "doc_id string, text string"), PATH).collect()}
    for k, text in zip("abc", texts):
        bpe = byte_bpe.load(PATH)
        ids = [i for m in regex.finditer(public_tokenizers.PATTERN, text) for i in bpe.encode(m[0].encode())]
        assert rows[k].n_tokens == len(ids) and rows[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b", "s", "f", "t"), (1, "a b", "s", "f", "t")], DOCS)
    assert decontaminate.contamination(docs, items).count() == 0
    assert [r.n_hit for r in decontaminate.contamination(some, items).collect()] == [0, 0]
    assert simhash.near_duplicates(docs).count() == 0 and byte_bpe.round_trip(docs, PATH).count() == 0
    assert [r.component_id for r in simhash.near_duplicates(some).collect()] == [1, 1]
