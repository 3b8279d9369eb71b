"""Importance resampling, the conversation trie and packing against brute force, with their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sonagrid.llm import conversation_trie, encoding, packing, resampling
from sonagrid.llm.common import written

LONG = "word " * 300_000 + "end"  # over a block of a megabyte
WORD_BPE = P.path("word_bpe_49k.json")


# ---- resampling ----

def draw(docs, target, share, min_words, n_buckets=10_000, runs=1):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n_buckets for k in range(1, runs + 1) for i in range(len(w) - k + 1)]
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x))
    for x in target:
        t.update(features(x))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + n_buckets) / ((s[b] + 1) * (T + n_buckets))))
    out = []
    for i, x in docs:
        f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: share(len(able))]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("runs", [1, 3])
def test_resampling(spark, runs):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("Aa bB c ünï 漢字 d2 e-f G".split()) for _ in range(rng.randrange(30)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "?!\x00"), (None, "no id " * 30), (503, LONG), (504, docs[0][1])]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, score string, rank string").repartition(5)
    target = ["a a a d2", None, "c ünï"]
    got = resampling.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), lambda n: 30 * n // 100, n_buckets=70_000 if runs > 1 else 10_000, runs=runs, min_words=10)
    assert sorted(map(tuple, got.collect()), key=repr) == draw(docs, target, lambda n: 30 * n // 100, 10, 70_000 if runs > 1 else 10_000, runs)
    none = resampling.resampled(df.limit(0), spark.createDataFrame([], "text string"))
    assert none.count() == 0 and none.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_repeated_rows_have_ranks_of_their_own(spark):
    df = spark.createDataFrame([(7, "a b c " * 10)] * 12, "doc_id long, text string")
    ranks = sorted(r["rank"] or 0 for r in resampling.resampled(df, df.select("text"), lambda n: n // 2).collect())
    assert ranks == [0] * 6 + [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("parts", [1, 9])
def test_cutoff_is_exact(spark, parts):
    rng = random.Random(4)
    rows = [(rng.randrange(-5, 5), rng.randrange(2), rng.randrange(9), i) for i in range(500)]
    keys = written(spark.createDataFrame(rows, "negative long, no_id long, id long, place long").repartition(parts), "test-keys")
    rows.sort()
    for k in (1, 2, 77, 250, 499, 500):
        assert resampling.cutoff(keys, k) == rows[k - 1]
    assert resampling.cutoff(keys, 0) is None
    with pytest.raises(ValueError):
        resampling.cutoff(keys, 501)


# ---- trie ----

def trie(rows, shared, base):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v, key=lambda v: (v[0], v[1], v[2], hashlib.sha256(f"{len(v[2])}:{v[2]}{v[3]}".encode()).digest()))] for c, v in own.items()}
    turns = {c: own.get(base(c), [])[: shared(c)] + own[c][shared(c):] for c in own}
    members, children = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        for d in range(len(turns[c]) + 1):
            members[tuple(turns[c][:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, below = [], {}
    for p in sorted(members, key=len, reverse=True):
        own_words = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below[p] = own_words + sum(below[k][0] for k in children[p]), sum(below[k][1] for k in children[p]) or 1
        ends = ",".join(str(c) for c in members[p] if len(turns[c]) == len(p))
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), below[p][1], below[p][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("vocabulary", [1, 3])
def test_trie(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(conversation_trie, "IDS_A_PIECE", 3)
    rng = random.Random(vocabulary)
    rows = []
    for c in range(60):
        n = rng.choice([1, 2, 3, 5, 9, 14])
        rows += [(c * 7 % 97, t, rng.choice(["user", None]) if vocabulary > 1 else "user", " w" * rng.randrange(vocabulary)) for t in range(n)]
    rows += [(200, t, "user", "the same words") for t in range(70)]  # one conversation of a third of all turns
    rows += [(201, t, "user", "the same words") for t in range(40)]
    rows += [(300, None, "b", "null first"), (300, 0, "a", None), (300, 0, "a", "tie"), (300, 0, "a", "tie"), (None, 1, "u", "no conversation"), (301, 1, None, LONG)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(5)
    got = conversation_trie.prefix_trie(df).collect()
    assert sorted(map(tuple, got), key=repr) == trie(rows, lambda c: 0, lambda c: c)
    h = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)).cast("int")
    got = conversation_trie.prefix_trie(df, h, lambda c: c - c % 20, 3).collect()
    assert sorted(map(tuple, got), key=repr) == trie(rows, lambda c: zlib.crc32(str(c).encode()) % 4, lambda c: c - c % 20)


def test_empty_and_turnless_tries(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.prefix_trie(none).count() == 0
    one = spark.createDataFrame([(1, 0, "u", "x")], none.schema)
    got = conversation_trie.prefix_trie(one, lambda c: F.lit(2), lambda c: c - c % 20, 2).collect()  # its head is absent, its turn is replaced
    assert [tuple(r) for r in got] == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


# ---- packing ----

def test_word_encoder_equals_library():
    t = Tokenizer.from_file(WORD_BPE)
    texts = ["", " lead  two\n\n\ttab \n", "Ünïcode ☃ 漢字 \U0001f600", "<|endoftext|> mid<|endoftext|>x", "don't it's I'LL 12,345.67 x²  ", "\x01odd\x1cmark", "İstanbul ΣΑΣ σας é ́x a b　c", "A.\nB c\nD'S", LONG]
    enc = encoding.UnitEncoder(WORD_BPE, max_units=20)
    assert enc.pattern is not None and encoding.UnitEncoder(P.path("byte_bpe_50k.json")).pattern is None
    whole = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == whole and enc.encode(texts) == whole


def test_differencing():
    assert packing.differenced([8, 7, 6, 5, 4], 2)[1] == 16  # as differencing gives it; the optimum is 15
    rng = random.Random(1)
    for k in (1, 2, 7, 40):
        sizes = [rng.randrange(1, 900) for _ in range(k * 12)]
        at, top = packing.differenced(sizes, k)
        sums = np.bincount(at, weights=sizes, minlength=k)
        assert sums.max() == top and sums.max() - sums.min() <= 0.005 * sums.mean()
    assert packing.differenced([], 3)[0].tolist() == []


def padded(n, capacity):
    return n if n & (n - 1) == 0 else capacity


def check_packed(rows, texts, capacity, t):
    """Every id in one piece, sequences without gaps and within capacity; the share of padding."""
    want = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in texts]
    by_start, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_start[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        ends = np.cumsum([0, *(r["length"] for r in s)])
        assert [r["offset"] for r in s] == ends[:-1].tolist() and ends[-1] <= capacity
    for i in {i for i, _ in want}:
        own = [ids for j, ids in want if j == i]
        if len(own) == 1:
            pieces = sorted(by_start[i], key=lambda r: r["start"])
            assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
            assert b"".join(r["ids"] for r in pieces) == np.array(own[0], "<u4").tobytes() and {r["doc_tokens"] for r in pieces} == {len(own[0])}
        else:
            assert sum(r["length"] for r in by_start[i]) == sum(map(len, own))
    n = sum(r["length"] for r in rows)
    return 1 - n / sum(padded(sum(r["length"] for r in s), capacity) for s in sequences.values())


@pytest.mark.parametrize("parts", [1, 6])
def test_packing(spark, parts):
    rng, t = random.Random(2), Tokenizer.from_file(WORD_BPE)
    texts = [(i, "word " * int(rng.expovariate(1 / 60))) for i in range(400)]
    texts += [(1000, None), (1001, ""), (1002, "word " * 5000), (None, "no id"), (1003, "twice"), (1003, "twice")]
    df = spark.createDataFrame([(*x, "a", "b") for x in texts], "doc_id long, text string, offset string, ids string").repartition(parts)
    rows = packing.packed(df, WORD_BPE, 2, capacity=256, windows=16, longest=64).collect()
    assert check_packed(rows, texts, 256, t) < 0.03
    # numbers of sequences come from the input's partitions, also when these meet in one task
    assert packing.packed(df, WORD_BPE, 2, capacity=256, windows=16).coalesce(1).select("sequence_id").distinct().count() == packing.packed(df, WORD_BPE, 2, capacity=256, windows=16).select("sequence_id").distinct().count()
    assert packing.packed(df.limit(0), WORD_BPE, 2).count() == 0


def test_equal_pieces_and_full_windows():
    docs = lambda n, size: ((i, np.zeros(size, "<u4")) for i in range(n))
    for n, size in ((500, 700), (300, 4096), (300, 4095), (100, 9000), (5000, 41), (3, 1)):
        sums = [sum(len(p.ids) for p in s) for s in packing.pack_stream(docs(n, size), 4096, 64, 4, 1024)]
        assert sum(sums) == n * size and max(sums) <= 4096
        assert sum(padded(x, 4096) for x in sums) <= 1.01 * n * size + 2 * 4096  # a window more in a group at most


def test_equal_op13(spark):
    """The query's checksums are those of the pieces' ids."""
    got = packing.op13_packing(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    t = Tokenizer.from_file(WORD_BPE)
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for i, x in docs.items()}
    assert {r["doc_id"] for r in got} == set(ids)
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
