"""Byte pairs, Merkle manifest and conversation trie against plain versions of them."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import re
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewitness.llm import byte_pairs, manifest, prefix_trie, queries
from llm_tables import SMOKE, against_sql, docs, folder  # noqa: F401
from test_edges import AWKWARD, prose

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# ---- byte pairs
@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return byte_pairs.Vocabulary(open(PATH, "rb").read(), public_tokenizers.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("ab =-\n'sé\U0001f600", max_size=200)), max_size=6))
def test_ids_are_those_of_the_library(known, vocabulary, texts):
    ids, n = byte_pairs.Encoder(vocabulary).stretch(texts)
    assert np.split(ids, np.cumsum(n)[:-1])[: len(texts)] is not None
    at = np.append(0, np.cumsum(n)).astype(int)
    for t, a, b in zip(texts, at, at[1:]):
        assert ids[a:b].tolist() == known.encode_ordinary(t)
    assert vocabulary.decode(ids.astype(np.int64))[0].tobytes() == "".join(texts).encode()


@pytest.mark.parametrize("letters", ["a", "ab", "abcde", "etaoinshr", "=", " ", "\U0001f600é"])
def test_long_pieces(known, vocabulary, letters):
    r = random.Random(letters)
    for n in (byte_pairs.LONG, byte_pairs.LONG + 1, 3000, 20_000):
        t = "".join(r.choice(letters) for _ in range(n))
        assert byte_pairs.Encoder(vocabulary).stretch([t])[0].tolist() == known.encode_ordinary(t)


def test_a_long_run_takes_few_rounds(vocabulary):
    merges = []
    vocabulary_merge, vocabulary._merge = vocabulary._merge, lambda *a: merges.append(1) or vocabulary_merge(*a)
    try:
        byte_pairs.Encoder(vocabulary).stretch(["a" * 3_000_000])
    finally:
        del vocabulary._merge
    assert len(merges) < 60


def test_bpe_digests(spark, known, folder, docs):
    rows = docs([None, "", " ", "one two", "don't", "x" * 5_000_000, prose(300_000, 3), "one two"])
    out = {r.doc_id: r for r in queries.QUERIES["op11_bpe_matrices"](spark, folder(extra=("ids", "decoded", "key"), documents=rows)).collect()}
    assert len(out) == len(rows)
    for k, t, *_ in rows:
        if k == 5:
            assert out[k].decoded_sha256 == sha(t) and out[k].n_tokens < 1_000_000
            continue
        ids = known.encode_ordinary(t or "")
        assert (out[k].n_tokens, out[k].ids_sha256, out[k].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t or ""))


def test_encode_keeps_columns_and_decode_refuses(spark):
    df = spark.createDataFrame([(1, "one two", "IDS")], "k int, text string, IDs string")
    out = byte_pairs.encode(df, PATH, public_tokenizers.PATTERN)
    assert out.columns == ["k", "ids"]
    assert bytes(byte_pairs.decode(out, PATH, public_tokenizers.PATTERN).first().decoded) == b"one two"
    nothing = byte_pairs.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), PATH, public_tokenizers.PATTERN)
    assert [r.decoded if r.decoded is None else bytes(r.decoded) for r in nothing.collect()] == [None, b""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_pairs.decode(spark.createDataFrame([([50256],)], "ids array<int>"), PATH, public_tokenizers.PATTERN).collect()


# ---- Merkle manifest
def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, extra=0: sha("".join(map(field, (d[0], d[3], d[2], None if d[4] is None else d[4] + extra, d[1]))))

    def reduce(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
        return levels

    def siblings(levels, p):
        for level in levels[:-1]:
            q = p ^ 1
            yield (p & 1, level[q] if q < len(level) else None)
            p >>= 1

    by_lang = defaultdict(list)
    for d in rows:
        by_lang[d[2]].append(d)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        by_lang[g].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        trees[g] = reduce([leaf(d) for d in by_lang[g]])
    top = reduce([trees[g][-1][0] for g in langs]) if langs else []
    out = []
    for k, g in enumerate(langs):
        for p, d in enumerate(by_lang[g]):
            path = [*siblings(trees[g], p), *siblings(top, k)]
            at = leaf(d, int(d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0))
            for right, h in path:
                at = sha(at if h is None else h + at if right else at + h)
            root = top[-1][0]
            out.append((d[0], leaf(d), trees[g][-1][0], root, sha("".join(h for _, h in path if h)), at, at == root))
    return out


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check_manifest(spark, path, rows):
    got = queries.QUERIES["op12_merkle_manifest"](spark, path).select(*MANIFEST).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows))


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 2500])
def test_manifest_of_many_sizes(spark, folder, n):
    r = random.Random(n)
    rows = [(k, f"t{k}", "en" if r.random() < 0.9 else None, r.choice("ab"), r.choice([None, 5])) for k in r.sample(range(-(10**6), 10**6), n)]
    check_manifest(spark, folder(documents=rows), rows)


def test_manifest_of_wide_ids_ties_and_copies(spark, folder):
    ids = [-(2**63), 2**63 - 1, 0, -1, 63, 64, 2**40, -(2**40), 2**16, 2**16 - 1, None]
    rows = [(k, f"{k} {i}", "en", "s", 2**63 - 1) for k in ids for i in range(4)] + [(7, "same", "en", "s", 1)] * 5000 + [(8, "é", "", "", 0), (8, None, "Z", None, None)]
    check_manifest(spark, folder(extra=("group", "word", "bit", "rows", "pos", "hash"), documents=rows), rows)


def test_manifest_of_awkward_rows(spark, folder):
    check_manifest(spark, folder(documents=AWKWARD), AWKWARD)


def test_manifest_of_many_languages(spark, folder):
    rows = [(k, "t", f"l{k % 1100}", "s", k) for k in range(1300)]
    check_manifest(spark, folder(documents=rows), rows)


def test_coordinates_do_not_follow_the_partitioning(spark):
    rows = [(f"g{k % 2}", k * 37 % 1000 if k % 3 else None, f"{k:064x}") for k in range(3000)]
    out = [sorted(map(tuple, manifest.coordinates(spark.createDataFrame(rows, "group string, doc_id bigint, leaf string").repartition(n)).collect()), key=repr) for n in (1, 7)]
    assert out[0] == out[1]
    want = {g: sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for g in ("g0", "g1")}
    assert all(want[r[0]][r[3]] == r[:3] and r[4] == 1500 for r in out[0])


# ---- conversation trie
def plain_trie(rows):
    """The nodes by the definition, from rows of conversations."""
    tie = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", sha(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}"))
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=tie):
        own[r[0]].append((r[2] or "", r[3] or ""))
    rem = lambda c: c - int(c / 20) * 20
    built = {c: tuple(own.get(c - rem(c), [])[: (h := zlib.crc32(str(c).encode()) % 4)] + t[h:]) for c, t in own.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), Counter()
    for c, t in built.items():
        ends[t].append(c)
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids.update(t[:-1] for t in members if t)
    leaves, saved = Counter(), Counter()
    for t, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", t[-1][1])) if t else 0
        for d in range(len(t) + 1):
            leaves[t[:d]] += not kids[t]
            saved[t[:d]] += (len(m) - 1) * words
    return sorted(
        (min(m), len(t), min(members[t[:-1]]) if t else None, len(m), kids[t], leaves[t], saved[t], sha(",".join(map(str, sorted(ends[t])))))
        for t, m in members.items()
    )


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def made_conversations(seed, n, turns=6, words=("a", "b c", "", None)):
    r = random.Random(seed)
    return [(c, r.choice([None, d, d]), r.choice(["user", "assistant", None]) if d % 2 else "user", r.choice(words)) for c in r.sample(range(-50, 200), n) for d in range(r.randint(1, turns))]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("partitions", ["1", "4", "13"])
def test_trie_against_definition(spark, folder, seed, partitions):
    rows = made_conversations(seed, 120) + [(300 + k, d, "user", "all say this") for k in range(80) for d in range(5)] + [(None, 1, "user", "x")] + made_conversations(9, 1) * 3
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = queries.QUERIES["op13_conversation_trie"](spark, folder(extra=("id", "key", "shard", "words", "conv"), conversations=rows)).select(*TRIE).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got)) == plain_trie(rows)


def test_trie_of_a_long_conversation(spark, folder):
    rows = [(c, d, "user", f"turn {d}" if d < 1400 else f"{c} {d}") for c in (20, 40, 60) for d in range(1500)] + [(c, d, "user", "x " * 100_000) for c in (80, 81) for d in range(2)]
    got = queries.QUERIES["op13_conversation_trie"](spark, folder(conversations=rows)).select(*TRIE).collect()
    assert sorted(map(tuple, got)) == plain_trie(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=70), st.data())
def test_block_minima(values, data):
    v = np.array(values, np.int64)
    at = np.arange(len(v))
    low = np.array(data.draw(st.lists(st.integers(0, len(v)), min_size=5, max_size=5)))
    high = np.maximum(low, np.array(data.draw(st.lists(st.integers(0, len(v)), min_size=5, max_size=5))))
    m = prefix_trie.Minima(v.copy())
    assert m.next_smaller(at).tolist() == [next((j for j in range(i + 1, len(v)) if v[j] < v[i]), len(v)) for i in at]
    assert m.within(low, high).tolist() == [min(values[a:b], default=np.iinfo(np.int64).max) for a, b in zip(low, high)]


def test_equal_conversations_stream_through(monkeypatch):
    import pyarrow as pa

    ids, convs = [b"a" * 16] * 7 + [b"b" * 16] * 2, [1, 2, 3, 4, 5, 6, 7, 8, 9]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 2], pa.binary()), pa.array(convs[i : i + 2])], ["id", "conv"]) for i in range(0, 9, 2)]
    out = [r for b in prefix_trie._copies(iter(batches)) for r in b.to_pylist()]
    assert [(r["copies"], r["conv"], r["ends"]) for r in out] == [(7, 1, sha("1,2,3,4,5,6,7")), (2, 8, sha("8,9"))]
