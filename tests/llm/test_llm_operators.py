"""Each training-data operator against brute force, exact round trips, and its edge cases."""

import base64
import hashlib
import io
import itertools
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sonagrid.llm import components, encoding, line_dedup, media, mixing, multiset_hash, pieces, simhash, token_counts, token_shards, toxicity, warc
from sonagrid.llm.common import new_path
from sonagrid.llm.components import connected_components

BPE, SP = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LONG = "word " * 60_000 + "end"
#: Nulls, empties, repeats, ties, white space, other scripts, special strings, a very long text; a column of a clashing name.
ROWS = [
    (1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, " lead  two\n\n\ttab \n"), (5, "Ünïcode ☃ 漢字 \U0001f600"), (None, "no id here at all"), (6, "<|endoftext|> mid<|endoftext|>x"),
    (7, LONG), (8, "\n"), (9, "don't it's 12,345.67 x²  "), (10, "\x01odd\x1cmark"), (11, "a b c"),
]
SCHEMA = "doc_id long, text string, score string, n_tokens string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "s", "n") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def expected(f):
    return sorted((f(i, t or "") for i, t in ROWS), key=repr)


# ---- encoding, counts, shards ----

def test_encoder_equals_library():
    t = Tokenizer.from_file(BPE)
    texts = [t or "" for _, t in ROWS] + ["a\nb", "a \nb", "a\n b", "x" * 5000, "", " ", "\n\n", "  a", "a  ", "I'll we've", "a<|endoftext|> <|endoftext|>b", "A.\nB c\nD"]
    whole = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    enc = encoding.UnitEncoder(BPE, max_units=50)
    assert enc.by_units
    assert enc.encode(texts) == whole and enc.encode(texts) == whole


def test_count_tokens_and_cache(spark, docs, empty):
    t, cache = Tokenizer.from_file(BPE), new_path(spark, "cache")
    n = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    got = by_id(token_counts.count_tokens(docs, cache, BPE), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == expected(lambda i, s: (i, len(s.encode()), n(s), n(s) > 512))
    stored = spark.read.parquet(cache).count()
    assert stored == len({s or "" for _, s in ROWS})
    # a second run finds every count; planted counts prove that the cache is read
    planted = spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 1000)
    other = new_path(spark, "cache")
    planted.write.parquet(other)
    again = by_id(token_counts.count_tokens(docs, other, BPE), "doc_id", "n_tokens")
    assert again == expected(lambda i, s: (i, n(s) + 1000)) and spark.read.parquet(other).count() == stored
    assert token_counts.count_tokens(empty, new_path(spark, "cache"), BPE).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 5000))
    zero = np.zeros(len(keys), np.int64)
    h = token_shards.PerfectHash.build(keys, zero, np.arange(len(keys)), np.arange(len(keys)) + 7)
    assert sorted(h.slots(keys, zero).tolist()) == list(range(len(keys)))
    back = token_shards.PerfectHash.load(h.dump())
    stored = token_shards.StoredHash(io.BytesIO(h.dump()))
    assert [x.tolist() for x in stored.find(keys[:500], zero[:500])] == [x.tolist() for x in back.find(keys[:500], zero[:500])]
    assert stored.n_reads < 2 + 500 * 4  # about 1.7 words and one slot a key
    offsets, lengths = back.find(keys, zero)
    assert (offsets == np.arange(len(keys))).all() and (lengths == offsets + 7).all()
    foreign = rng.integers(-(1 << 62), 1 << 62, 20000)
    assert (back.find(foreign, np.zeros(20000, np.int64))[0] >= 0).mean() < 1e-3
    none = token_shards.PerfectHash.build(keys[:0], zero[:0], keys[:0], keys[:0])
    assert (none.find(keys[:3], zero[:3])[0] == -1).all()


@pytest.mark.parametrize("n_shards", [1, 5])
def test_shards(spark, docs, empty, n_shards):
    t, folder = Tokenizer.from_file(BPE), new_path(spark, "shards")
    manifest = token_shards.write_shards(docs, folder, BPE, 2, n_shards)
    rows = sorted(((i, s or "") for i, s in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for i, s in rows:
        ids = [*t.encode(s, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert by_id(token_shards.read_shards(manifest, folder), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    asked = [i for i, _ in rows[::2]] + [-77, 10**12, None, rows[0][0], rows[-1][0]]
    found = token_shards.lookup(spark.createDataFrame([(k, "x") for k in asked], "key long, shard string"), manifest, folder).collect()
    by_key = {}
    for i, s in rows:
        by_key.setdefault(i, []).append([*t.encode(s, add_special_tokens=False).ids, 2])
    assert {(r["key"], r["copy"]): r["ids"] for r in found} == {x: y for k in asked for x, y in ([((k, c), ids) for c, ids in enumerate(by_key[k])] if k in by_key else [((k, None), None)])}
    assert len(found) == sum(len(by_key.get(k, [0])) for k in set(asked))
    # with more shards than are told to tasks keys find theirs by order; keys that no shard has are dealt to all tasks
    again = token_shards.lookup(spark.createDataFrame([(k,) for k in asked], "key long"), manifest, folder, told_shards=0)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, found), key=repr)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would meet in one task
    missed = token_shards.lookup(spark.range(10**6, 10**6 + 2000).withColumnRenamed("id", "key"), manifest, folder)
    counts = [r[0] for r in missed.groupBy(F.spark_partition_id()).count().select("count").collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(counts) == 2000 and max(counts) < 1000
    folder = new_path(spark, "shards")
    assert token_shards.read_shards(token_shards.write_shards(empty, folder, BPE, 2), folder).count() == 0


# ---- media ----

def test_image_round_trips():
    rng = np.random.default_rng(2)
    for h, w in ((1, 1), (3, 5), (8, 9), (20, 13)):
        rgb, one = rng.integers(0, 256, (h, w, 3), np.uint8), rng.integers(0, 256, (h, w), np.uint8)
        assert (media.decode_image(media.write_netpbm(rgb)) == rgb).all() and (media.decode_image(media.write_netpbm(one)) == one).all()
        assert (media.decode_image(media.write_bmp(rgb)) == rgb).all()
    assert media.decode_image(b"P2 # note\n2 1\n255\n7 9 ").tolist() == [[7, 9]]
    assert media.decode_image(b"P1\n3 1\n101").tolist() == [[0, 255, 0]]
    assert media.decode_image(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode_image(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]]
    assert [media.decode_image(x) for x in (None, b"", b"GIF", b"P6\n9 9\n255\n..", b"BM123", b"P6\n")] == [None] * 6


def test_depths_and_damaged_images(spark):
    level = lambda data: media.decode_image(data).tolist()
    assert level(b"P2 2 1 15\n0 15") == level(b"P5 2 1 15\n\x00\x0f") == level(b"P2 2 1 255\n0 255") == [[0, 255]]
    assert level(b"P5 1 1 1000\n" + struct.pack(">H", 500)) == [[32768]] and media.npy_tile(media.decode_image(b"P5 1 1 65535\n\xff\xff"))[-1] == 255
    core = b"BM" + struct.pack("<IHHIIHHHH", 0, 0, 0, 26, 12, 2, 1, 1, 24) + bytes([3, 2, 1, 6, 5, 4, 0, 0])
    assert level(core) == [[[1, 2, 3], [4, 5, 6]]]
    fields = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 0, 0, 0, 66, 40, 1, -1, 1, 16, 3, 0, 0, 0, 0, 0) + struct.pack("<III", 0xF800, 0x07E0, 0x001F) + struct.pack("<HH", 0xF800 | 0x1F, 0)
    assert level(fields) == [[[255, 0, 255]]]
    bad = [b"P2 2 1 255 / 300 1", b"P2 2 1 255\n300 1", b"P5 2 1 15\n\x00\x10", b"P5 99999999999 99999999999 255\n", b"P5 2 2 0\n0000", b"P6 2 2 255\nx", b"P3 1 1 255\n1 2", b"BM", core[:20], core[:30], fields[:60], b"BM" + bytes(60), b"P4 9 9\n", b"", b"P7 x", b"\xff\xd8"]
    assert [media.decode_image(x) for x in [*bad, None]] == [None] * (len(bad) + 1)
    out = media.media_features(spark.createDataFrame([(i, x, "p") for i, x in enumerate([*bad, core])], "doc_id int, media binary, tile string")).collect()
    assert [r["feature"] is None for r in sorted(out)] == [True] * len(bad) + [False]


def test_area_resize_against_loops():
    rng = np.random.default_rng(3)
    for (h, w), (H, W) in itertools.product([(7, 5), (3, 11), (16, 16)], [(4, 3), (9, 8), (1, 1)]):
        x = rng.random((h, w))
        out = media.area_resize(x, H, W)
        for i, j in itertools.product(range(H), range(W)):
            ys = [max(0, min((i + 1) * h / H, y + 1) - max(i * h / H, y)) for y in range(h)]
            xs = [max(0, min((j + 1) * w / W, k + 1) - max(j * w / W, k)) for k in range(w)]
            assert out[i, j] == pytest.approx((np.outer(ys, xs) * x).sum() * H * W / (h * w))


def test_media_query_contract(spark, docs, empty):
    stored = media.texts_to_media(docs)
    out = media.media_features(stored)

    def want(i, s):
        p = s.encode() + b" " * (max(192, -(-len(s.encode()) // 192) * 192) - len(s.encode()))
        return i, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])

    assert by_id(out, "doc_id", "payload_bytes", "payload_sha256", "tail_crc32") == expected(want)
    assert np.load(__import__("io").BytesIO(out.first()["tile"])).shape == (8, 8, 3)
    assert media.media_features(media.texts_to_media(empty)).count() == 0
    assert media.media_features(spark.createDataFrame([(1, None), (2, bytearray(b"zz"))], "doc_id long, media binary")).filter("feature is null").count() == 2


# ---- multiset hash ----

def test_multiset_hash_is_homomorphic(spark):
    rows = [("ab", "x y z\nq r"), ("ba", "q r\nx y z"), ("a", "x y z"), ("b", "q r"), ("other", "x y z\nq s"), ("twice", "q r\nq r"), ("none", ""), ("null", None), ("space", "  \n")]
    f = {r["k"]: r for r in multiset_hash.fingerprint_of(spark.createDataFrame(rows, "k string, text string"), ["k"]).collect()}
    assert len({f[k]["fingerprint"] for k in ("ab", "ba")}) == 1 and len({r["fingerprint"] for r in f.values()}) == 7
    df = spark.createDataFrame([(f["ab"]["equal"], f["a"]["equal"], f["b"]["equal"], f["ab"]["signs"], f["a"]["signs"], f["b"]["signs"])], "eab array<long>, ea array<long>, eb array<long>, sab array<long>, sa array<long>, sb array<long>")
    same = lambda x, y, z, s: F.transform(multiset_hash.combine(F.col(x), F.col(y), s), lambda v: F.pmod(v, F.lit(1 << 32))) == F.transform(F.col(z), lambda v: F.pmod(v, F.lit(1 << 32)))
    assert df.filter(same("ea", "eb", "eab", 1) & same("sa", "sb", "sab", 1) & same("eab", "eb", "ea", -1) & same("sab", "sb", "sa", -1)).count() == 1


@pytest.mark.parametrize("n_ranges", [2, 3, 40])
def test_next_rows(spark, n_ranges):
    rng = np.random.default_rng(n_ranges)
    rows = [(None if i % 40 == 7 else int(i % 23 if i < 60 else i * 3), f"t{rng.integers(0, 9)} {i}") for i in rng.permutation(300)]
    for part in (rows, rows[:1], [(None, "x"), (None, "y")], []):
        df = spark.createDataFrame(part, "doc_id long, text string")
        got = multiset_hash.with_next(df, n_ranges)
        order = sorted(part, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        want = sorted(((*r, order[(i + 1) % len(order)][1]) for i, r in enumerate(order)), key=repr)
        found = got.collect()
        assert sorted(((r["doc_id"], r["text"], r["next_text"]) for r in found), key=repr) == want
        pos = {r["pos"]: r["text"] for r in found}
        assert len(pos) == len(part) and all(pos[r["next_pos"]] == r["next_text"] for r in found)
    expressions = lambda n: len(multiset_hash.with_next(spark.createDataFrame(rows, "doc_id long, text string"), n)._jdf.queryExecution().analyzed().toString().replace(",", " ").split("(")) if n else 0
    assert expressions(200) == expressions(20)  # the plan has no more expressions for more ranges


def brute_multiset_hash(text):
    """(equal, signs) by loops; XXH64 of several columns takes the hash before as seed."""
    import xxhash

    h = lambda *parts: __import__("functools").reduce(lambda seed, p: xxhash.xxh64_intdigest(p.encode(), seed), parts, 42)
    equal, signs = [0] * 4, [0] * 64
    for p in (p for p in (text or "").split("\n") if p):
        for lane in range(2):
            x = h(f"lane{lane}", p)
            equal[2 * lane] += x & (2**32 - 1)
            equal[2 * lane + 1] += x >> 32
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", p) if w]
        for a, b in zip(words, [*words[1:], ""], strict=True):
            x = h(a, b)
            signs = [s + (1 if x >> i & 1 else -1) for i, s in enumerate(signs)]
    return [e % 2**32 for e in equal], signs


def test_multiset_hash_against_brute_force(spark, docs):
    keyed = docs.withColumn("row", F.monotonically_increasing_id())
    texts = {r["row"]: r["text"] for r in keyed.collect()}
    got = multiset_hash.fingerprint_of(keyed, ["row"]).collect()
    assert len(got) == len(texts)
    brute = {k: brute_multiset_hash(t) for k, t in texts.items()}
    for r in got:
        equal, signs = brute[r["row"]]
        assert (list(r["equal"]), list(r["signs"])) == (equal, signs)
        assert r["fingerprint"] == "".join(f"{x % 2**32:08x}" for x in (*equal, *signs))
    pairs = list(itertools.product(sorted(brute), repeat=2))
    df = spark.createDataFrame([(a, b, brute[a][1], brute[b][1]) for a, b in pairs], "a long, b long, x array<long>, y array<long>")
    for r in df.select("a", "b", multiset_hash.likeness(F.col("x"), F.col("y")).alias("like")).collect():
        x, y = (np.array(brute[r[c]][1], float) for c in "ab")
        n = np.sqrt((x @ x) * (y @ y))
        want = (1.0 if not x.any() and not y.any() else 0.0) if n == 0 else min(1.0, max(0.0, x @ y / n))
        assert abs(r["like"] - want) < 1e-9


def test_next_documents_and_edits(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 7 + 1)) for i in range(40)] + [(5, "again"), (None, "nobody"), (41, None), (42, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["edited_sha256"]): r for r in multiset_hash.op9_multiset_hash(spark, str(tmp_path)).collect()}
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert len(got) == len(ordered)
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + n[:k]
        r = got[i, hashlib.sha256(edited.encode()).hexdigest()]
        assert r["n_chars"] == len(t) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (edited == t) <= (r["fingerprint"] == r["edited_fingerprint"])
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert multiset_hash.op9_multiset_hash(spark, f"{tmp_path}/none").count() == 0


# ---- WARC ----

def test_warc(spark, tmp_path):
    rows = [(1, "http://a/x", "same"), (2, "http://b", "same"), (7, "http://c", "same"), (3, "http://d", None), (4, "http://e", ""), (5, None, "ü\r\n\r\nWARC/1.1\r\n"), (6, "http://f", "z" * 3_000_000), (None, "http://g", "g"), (None, "http://h", "same")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha1 string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        own = (-1 if i is None else i) == best[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if own else "revisit", None if own else best[h or ""]))
    assert by_id(warc.op6_warc(spark, str(tmp_path)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    folder = new_path(spark, "warc")
    captures = warc.assemble(warc.scan_warc(warc.write_warc(warc.classify(df, min_bytes=5), folder), folder)).collect()
    assert Counter(r["response"]["record_type"] for r in captures) == {"response": 9}
    assert sorted(bytes(r["response"]["payload"]) for r in captures) == sorted((h or "").encode() for _, _, h in rows)
    assert all(r["request"]["record_id"] and r["metadata"]["record_id"] for r in captures)
    df.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert warc.op6_warc(spark, f"{tmp_path}/none").count() == 0


def test_warc_revisits_name_their_response(spark):
    rows = [(1, "http://a", "same")] * 3 + [(2, "http://b", "same")] * 2 + [(3, None, "own"), (4, "http://d", "other")] + [(i, "http://h", "hot") for i in range(10, 40)]
    folder = new_path(spark, "warc")
    captures = {r["capture_id"]: r for r in warc.assemble(warc.scan_warc(warc.write_warc(warc.classify(spark.createDataFrame(rows, "page_id long, url string, html string")), folder), folder)).collect()}
    page = lambda r: int(r["metadata"]["fields"].split(": ")[1])
    assert Counter(page(r) for r in captures.values()) == Counter(i for i, *_ in rows)
    assert Counter(page(r) for r in captures.values() if r["response"]["record_type"] == "response") == {2: 2, 3: 1, 4: 1, 39: 1}
    for r in captures.values():
        if r["response"]["record_type"] == "revisit":
            kept = captures[r["response"]["refers_to"]]
            assert kept["response"]["stored_digest"] == r["response"]["payload_digest"] and page(kept) == (2 if page(r) == 1 else 39)


def test_pages_lost_to_damage_keep_their_rows(spark, monkeypatch):
    """An archive that breaks off after it was written: its pages are rows of nulls, revisits of its responses keep their digest."""
    sf, wrote = "/root/testdata/sf0.001", warc.write_warc

    def broken(captures, folder):
        manifest = wrote(captures, folder)
        store, path = warc.open_store(folder)
        import pyarrow.fs as fs

        name = max(store.get_file_info(fs.FileSelector(path)), key=lambda f: f.size if f.base_name.endswith(".gz") else 0).path
        with store.open_input_stream(name, compression=None) as f:
            data = f.read()
        store.delete_file(name)
        with store.open_output_stream(name, compression=None) as f:
            f.write(data[: len(data) // 2])
        return manifest

    whole = {r["page_id"]: r for r in warc.op6_warc(spark, sf).collect()}
    monkeypatch.setattr(warc, "write_warc", broken)
    rows = warc.op6_warc(spark, sf).collect()
    assert sorted(r["page_id"] for r in rows if r["page_id"] is not None) == sorted(whole)
    lost = [r for r in rows if r["record_type"] is None]
    assert 0 < len(lost) < len(whole) and all(r["payload_digest"] is None for r in lost)
    assert all(r["payload_digest"] == whole[r["page_id"]]["payload_digest"] for r in rows if r["record_type"] and r["page_id"] is not None)


def test_damaged_archives(spark, tmp_path):
    good = [warc.record("response", f"urn:{i}", b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * i) for i in range(1, 4)]
    raw = b"".join(zlib.decompress(g, 31) for g in good)
    files = {"whole": b"".join(good), "plain": raw, "cut": b"".join(good)[:-20], "flipped": good[0] + good[1][:30] + b"\0\0\0\0" + good[1][34:], "no_length": raw.replace(b"Content-Length: 21", b"Content-Size: 21"), "nothing": b"", "junk": b"junk\r\n\r\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    records = warc.scan_warc(spark.createDataFrame([(n,) for n in files], "file string"), f"file://{tmp_path}").collect()
    got = Counter((r["record_type"], r["payload_bytes"]) for r in records)
    assert got == {("response", 1): 5, ("response", 2): 3, ("response", 3): 2, ("damaged", None): 4}


# ---- line dedup ----

def brute_templates(texts, similarity=0.8):
    """{masked line: template}: components of linked lines propose the tokens of more than half of their lines; rounds until none finds members."""
    n = lambda m: len(m.split(" ")) if m else 0
    leaf = lambda m: (n(m), tuple(m.split(" ")[:3]))
    agree = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) >= similarity * len(x) - 1e-9
    template, left, k = {m: ("text", m) for m in texts}, sorted(set(texts)), 0
    while left:
        k, root = k + 1, {m: m for m in left}
        for a, b in itertools.combinations(left, 2):
            if leaf(a) == leaf(b) and agree(a.split(" "), b.split(" ")):
                old, new = root[a], root[b]
                root = {m: new if t == old else t for m, t in root.items()}
        groups, left = {}, []
        for m, t in root.items():
            groups.setdefault(t, []).append(m)
        for t, ms in groups.items():
            if len(ms) > 1:
                votes = [Counter(x).most_common(1)[0] for x in zip(*(m.split(" ") for m in ms), strict=True)]
                fixed = [x if 2 * c > len(ms) else None for x, c in votes]
                members = [m for m in ms if agree(fixed, m.split(" "))]
                template.update((m, (k, t)) for m in members)
                left += [m for m in ms if m not in members] if members else []
    return template


def brute_line_dedup(rows, similarity=0.8):
    import re

    lines = [(i, p, re.sub(r"[^ ]*[0-9][^ ]*", "<*>", " ".join(re.split(r"[\x20\x09-\x0d]+", ln.strip(" \t\x0b\x0c\r"))))) for i, t in enumerate(t or "" for _, t in rows) for p, ln in enumerate(t.split("\n"))]
    n = lambda m: len(m.split(" ")) if m else 0
    lines = [x for x in lines if n(x[2]) >= 3]
    template = brute_templates([m for *_, m in lines], similarity)
    docs = {}
    for i, _, m in lines:
        docs.setdefault(template[m], set()).add(i)
    order = lambda i: (rows[i][0] is not None, rows[i][0] or 0)
    drop = set()
    for i, p, m in lines:
        k = template[m]
        if len(docs[k]) >= (2 if n(m) >= 8 else 5) and i != min(docs[k], key=order):
            drop.add((i, p))
    return [(r[0], None if r[1] is None else "\n".join(ln for p, ln in enumerate(r[1].split("\n")) if (i, p) not in drop)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("hot_lines", [1000, 10])
def test_line_dedup_against_brute_force(spark, monkeypatch, hot_lines):
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot_lines)
    rng = np.random.default_rng(4)
    words = [f"w{chr(97 + i)}" for i in range(12)]
    boiler = " ".join(words[:10])
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choice(words, rng.integers(1, 14))) for _ in range(rng.integers(0, 5))]
        lines += [boiler.replace("wi", rng.choice(words))] * (i % 3 == 0) + [f"{boiler} at {i} o'clock"] * (i % 4 == 0) + ["short line here"] * (i % 5 == 0) + ["tiny two"] * (i % 2)
        rows.append((i, "\n".join(lines)))
    rows += [(60, None), (61, ""), (62, "\n\n  \n"), (None, f"{boiler} at 99 o'clock\nown words of this one text only")]
    rows.append((70, "an own very long text of words " + " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(20_000))))
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], "doc_id long, text string, drops string, n int, hash string, RH string")
    got = by_id(line_dedup.without_recurring_lines(df), "doc_id", "text")
    assert got == sorted(brute_line_dedup(rows), key=repr)
    assert got != sorted(rows, key=repr)


def test_generalised_templates(spark):
    rows = [(1, "the job of ann ended with no error"), (2, "the job of bob ended with no error"), (3, "the job of ann 17 ended well"), (4, "another line that stands all alone here")]
    cut = line_dedup.exploded(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    found = line_dedup.generalised(line_dedup.line_templates(cut, cut.drop("masked")))
    assert [["<*>" if t is None else t for t in r["fixed"]] for r in found.collect()] == ["the job of <*> ended with no error".split()]


def test_documents_are_cut_once(spark, monkeypatch):
    """Lines of crowded leaves are read from the written table, not cut from the documents again."""
    rows = [(i, f"we saw the {x} cat {i} today\nown {i}") for i, x in enumerate(["red", "blue", "pink"])]
    plans, found = [], line_dedup.leaf_templates
    monkeypatch.setattr(line_dedup, "leaf_templates", lambda lines, s: plans.append(lines._jdf.queryExecution().optimizedPlan().toString()) or found(lines, s))
    assert line_dedup.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    assert len(plans) == 1 and "Generate" not in plans[0]


def test_masked_lines(spark):
    lines = ["", " ", "a b", "a  b", " a b", "a b ", "a\tb", "\x0ba\x0c\rb", "a 1 b", "  x2  y\t", "a1", "\t", "7", "é ☃", "a\x1cb", "a\x85 b"]
    got = line_dedup.exploded(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string"), "doc_id", "text").collect()
    words = [[w for w in __import__("re").split(r"[\x20\x09-\x0D]+", x) if w] for x in lines]
    want = [[line_dedup.FIELD if any(c in "0123456789" for c in w) else w for w in x] for x in words]
    assert [(r["masked"], r["n"]) for r in sorted(got)] == [(" ".join(x), len(x)) for x in want]


def test_line_dedup_repeats_and_empty(spark, empty):
    line = "one two three four five six seven eight nine"
    rows = [(1, line), (1, line), (2, line + "\nkept"), (3, f"{line}\n{line}")]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    assert by_id(line_dedup.without_recurring_lines(df), "doc_id", "text") == [(1, line), (1, line), (2, "kept"), (3, "")]
    out = line_dedup.without_recurring_lines(empty)
    assert out.columns == empty.columns and out.count() == 0


def test_line_dedup_of_many_families_in_a_leaf(spark):
    """Ten families of long lines and ten of short ones, each in one leaf and with a name as variable field."""
    names = [f"{a}{b}" for a in ("an", "be", "co") for b in ("ra", "li", "mo")]
    rows, want = [], []
    for d, name in enumerate(names):
        long = [" ".join(["dear", "reader", "of", *(f"f{chr(97 + f)}{chr(97 + j)}" for j in range(f % 4)), name, *(f"f{chr(97 + f)}{chr(97 + j)}" for j in range(f % 4, 8))]) for f in range(10)]
        short = [f"see also page {chr(97 + f)}x {chr(97 + f)}y {name}" for f in range(10)]
        own = [f"dear reader of {' '.join(f'o{chr(97 + d)}{chr(97 + j)}' for j in range(9))}", f"see also page {name} {name}z end"]
        rows.append((d, "\n".join([*long, *own, *short])))
        want.append((d, rows[0][1] if d == 0 else "\n".join(own)))
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    assert by_id(line_dedup.without_recurring_lines(df), "doc_id", "text") == sorted(want, key=repr)
    assert by_id(corpus_pipeline.line_dedup(spark, df, ""), "doc_id", "text") == sorted(want, key=repr)


def test_lines_that_only_a_chain_links_stay(spark):
    """Of 25 lines with two varying words none is a repeat, nor are those of a chain; what most of a chain has is a template, and what is left beside it another."""
    grid = [f"we saw the {a} {b}" for a in ("red", "pink", "blue", "grey", "dark") for b in ("cat", "dog", "fox", "owl", "hen")]
    abc = "abcdefghij"
    chain = [" ".join(["it", "goes", "on", *(f"{'x' if j < i else 'y'}{abc[j]}" for j in range(10))]) for i in range(11)]
    first = [f"one family of lines whose name is {c}{c} and no other" for c in abc]
    bridge = ["one family of words whose name is aa and no other", "one family of words whose dog is aa and no other"]
    second = [f"one family of words whose dog was {c}{c} and many other" for c in abc[:4]]
    rows = [(i, t) for i, t in enumerate([*grid, *chain, *first, *bridge, *second])]
    want = sorted(brute_line_dedup(rows), key=repr)
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    assert by_id(line_dedup.without_recurring_lines(df), "doc_id", "text") == want
    kept = [t for _, t in want if t]
    assert set(grid) | set(chain[:1]) <= set(kept) and sum(t in first for t in kept) == 1 and sum(t in second for t in kept) == 1


@pytest.mark.parametrize("similar", [0, 40])
def test_crowded_keys_are_split(spark, monkeypatch, similar):
    """1,500 lines that share a run of tokens, none alike but for some: pairs stay a bounded multiple of the lines, and no link is lost."""
    rng, seen = np.random.default_rng(6), []
    monkeypatch.setattr(line_dedup, "similar_components", lambda members, verify, *a, **k: components.similar_components(members, lambda edges: (seen.append(edges.count()), verify(edges))[1], *a, **k))
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrstuvwxyz"]
    rows = []
    for i in range(1500 - similar):
        rows.append(["so", "it", "was", *(["same"] * 4), *(str(rng.choice(words)) for _ in range(13))])
    for i in range(similar):
        w = list(rows[i % 20])
        w[9 + i % 11] = "edit"
        rows.append(w)
    df = spark.createDataFrame([(i, 7, r) for i, r in enumerate(rows)], "v long, leaf long, tokens array<string>")
    roots = {r["v"]: r["root"] for r in line_dedup.linked_lines(df, 0.8).collect()}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array([[hash(t) for t in r] for r in rows])
    for i in range(len(rows)):
        for j in np.flatnonzero((a[i] == a[i + 1 :]).sum(axis=1) >= 16) + i + 1:
            x, y = sorted((find(i), find(int(j))))
            parent[y] = x
    groups = Counter(map(find, range(len(rows))))
    assert roots == {i: find(i) for i in range(len(rows)) if groups[find(i)] > 1}
    assert sum(seen) < 64 * len(rows)


# ---- SimHash ----

def brute_fingerprint(text):
    import re

    import xxhash

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_contract(spark, docs, empty):
    prints = {i: brute_fingerprint(t or "") for i, t in enumerate(t for _, t in ROWS)}
    got = by_id(simhash.near_duplicates(docs), "doc_id", "fingerprint")
    assert got == sorted(((ROWS[k][0], f"{v:016x}") for k, v in prints.items()), key=repr)
    comp = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert comp[1, "0" * 16] == comp[2, "0" * 16] == comp[8, "0" * 16] == 1
    assert {comp[i, f"{brute_fingerprint('a b c'):016x}"] for i in (3, 11)} == {3}
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("small_group", [2, 64])
def test_links_give_exact_components(spark, small_group):
    rng = np.random.default_rng(6)
    values = set()
    for _ in range(12):
        centre = int(rng.integers(0, 1 << 63)) << 1
        for _ in range(60):
            v = centre
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                v ^= 1 << int(b)
            values.add(v - (1 << 64) if v >> 63 else v)
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "v long")
    vertices = df.select("v", F.array(F.col("v").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned("v", 32)).alias("segs"))
    root = {r["v"]: r["root"] for r in connected_components(simhash.links(vertices, 2, 32, 2, small_group)).collect()}
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert {v: root.get(v, v) for v in values} == {v: find(v) for v in values}


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 400), (400, 450)], "a long, b long")
    got = dict(map(tuple, connected_components(edges).collect()))
    assert got == {**{i: 0 for i in range(1, 201)}, 500: 400, 450: 400}


def test_one_of_each_group(spark, empty):
    rng = np.random.default_rng(7)
    make = lambda n: rng.choice([f"t{i}" for i in range(4000)], n).tolist()
    rows, groups = [], {}
    for g in range(30):
        base = make(150)
        for c in range(3 if g % 2 else 1):
            w = list(base)
            if c:
                w[int(rng.integers(10, 140))] = f"edit{g}{c}"
            rows.append((len(rows), " ".join(w)))
            groups.setdefault(g, []).append(rows[-1][0])
    rows += [(900, rows[0][1]), (0, rows[0][1]), (901, None), (902, ""), (903, "two words"), (904, "two words"), (None, "without id"), (905, "without id")]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    kept = [r[0] for r in by_id(simhash.one_of_each_group(df), "doc_id")]
    assert Counter(kept) == Counter([*(min(v) for v in groups.values()), None, 901, 903])
    out = simhash.one_of_each_group(empty)
    assert out.columns == empty.columns and out.count() == 0


def test_recall_by_similarity(spark):
    """Every pair of 0.8 or more is found, in bins of similarity, and no pair below."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(160):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(60, 200)))]
        other = list(base)
        for p in rng.choice(len(base), int(rng.integers(1, 6)), replace=False):
            other[p] = f"g{g}e{p}"
        cut = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        x, y = cut(base), cut(other)
        want[g] = len(x & y) / len(x | y)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    kept = {r["doc_id"] for r in simhash.one_of_each_group(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()}
    bins = Counter(int(j * 20 + 1e-9) / 20 for j in want.values())
    assert all(bins[b] >= 5 for b in (0.75, 0.8, 0.85, 0.9))
    assert all((2 * g + 1 in kept) == (j < 0.8) and 2 * g in kept for g, j in want.items())


def test_near_duplicates_beside_clashing_columns(spark):
    names = "sha, drop_id, drop_sha, again, v, k, root, digest, SIZE, keys, a, b, n"
    df = spark.createDataFrame([(1, "one two three four five six", *"x" * 13), (2, "one two three four five six", *"y" * 13), (3, None, *"z" * 13)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in [*names.split(", ")]))
    out = simhash.one_of_each_group(df)
    assert out.columns == df.columns and sorted(tuple(r) for r in out.collect()) == [(1, "one two three four five six", *"x" * 13), (3, None, *"z" * 13)]


def test_texts_of_two_shingles_are_verified(spark):
    import random

    words = [f"u{i}" for i in range(300)]
    rows, r = [], random.Random(11)
    for g in range(40):
        first = r.sample(words, 5)
        rows += [(3 * g, " ".join(first)), (3 * g + 1, " ".join([*first, f"x{g}"])), (3 * g + 2, " ".join([*first, f"y{g}"]))]
    df = spark.createDataFrame([(*x, "", "") for x in rows], SCHEMA)  # similar by a half and a third
    assert [x[0] for x in by_id(simhash.one_of_each_group(df), "doc_id")] == sorted((i for i, _ in rows), key=lambda i: repr((i,)))


@pytest.mark.parametrize("pairs_a_row", [0, 8, 10**9])
def test_crowded_groups_keep_every_link(spark, monkeypatch, pairs_a_row):
    """Several hundred different edits of two texts, drifting away from them, and copies near the limit, against all pairs."""
    monkeypatch.setattr("sonagrid.llm.components.PAIRS_A_ROW", pairs_a_row)
    rng = np.random.default_rng(12)
    rows = []
    for f in range(2):
        base = [f"f{f}w{i}" for i in range(60)]
        for c in range(170):
            w = list(base)
            for p in rng.choice(np.arange(c % 7, 60, 7), rng.integers(0, 4), replace=False):  # edits apart add up to less than 0.8
                w[p] = f"e{rng.integers(0, 3)}"
            rows.append((len(rows), " ".join(w)))
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(54)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base[: 41 + g % 4], *(f"g{g}x{i}" for i in range(13 - 4 * (g % 4)))]))]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    want = {i for i in range(len(rows)) if find(i) == i}
    assert {r["doc_id"] for r in simhash.one_of_each_group(df).collect()} == want
    assert 90 < len(want) < len(rows) - 200


# ---- toxicity ----

def toxic_tables(spark, n=600):
    rng = np.random.default_rng(8)
    plain = [f"{a}{b}" for a in ("ba", "ko", "mi", "te", "ru", "sa") for b in ("len", "dor", "nim", "pat", "gos", "var", "tul", "fek")]
    docs, labels = [], []
    for i in range(n):
        words = rng.choice(plain, 60).tolist()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words[int(rng.integers(60))] = rng.choice(["moron", "worthless"]) if i % 2 else "zarq" + rng.choice(["a", "ol", "ist", "en", "ur", "if"])
        docs.append((i, " ".join(words) + "."))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def test_toxicity_learns_words_and_stems(spark):
    docs, labels, rows = toxic_tables(spark)
    model = toxicity.train(docs, labels)
    assert any(s.startswith("zar") for s in model.lexicon.stems)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, score_col="score").collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in held)
    kept = toxicity.drop_toxic(docs.withColumn("__extra", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "__extra"] and kept.count() == sum(1 for i, _ in rows if i % 5)


def test_toxicity_grammar():
    lexicon = toxicity.Lexicon(toxicity.seed_lexicon())
    kind = lambda t: [toxicity.KINDS[i] for i in np.flatnonzero(toxicity.features(t, lexicon))]
    assert kind("what an idiot.") == [("insult", "plain")]
    assert kind("You are an IDIOT") == kind("an idiot you are") == [("insult", "target")]
    assert kind("this is not stupid") == [("insult", "negation")]
    assert kind("she said he is not an idiot") == [("insult", "report")]
    assert kind("we will hurt you") == [("threat", "target")]
    assert kind("he said so. what an idiot") == [("insult", "plain")]
    assert kind("") == kind("nothing here") == []
    one, two = (toxicity.features(t, lexicon).sum() for t in ("idiot idiot idiot", "idiot. idiot. idiot"))
    assert one < two


def rule_features(text, lexicon):
    """The grammar as rules that look back over a clause, without machines."""
    total = Counter()
    for clause in __import__("re").split(r"[.!?;:\n]+", text.lower()):
        found = [x for w in __import__("re").findall(r"[^\W\d_]+", clause) if (x := lexicon.of(w))]
        kinds, hits = [k for k, _ in found], []

        def posture(k, kinds=kinds):  # what an insult at k is said of
            while k:
                k -= 1
                if kinds[k] == "target":
                    return "target"
                if kinds[k] == "opener" or (kinds[k] == "closer" and posture(k) == "opener"):
                    return kinds[k]
                if kinds[k] == "copula" and posture(k) in ("target", "said"):
                    return "said"
            return "none"

        for k, (kind, weight) in enumerate(found):
            before = kinds[:k]
            hit = None
            if kind == "insult":
                hit = ("insult", weight * {"target": 1.2, "said": 1.5}.get(posture(k), 1.0))
            elif kind == "closer" and posture(k) == "opener":
                hit = ("insult", weight)
            elif kind == "threat":
                hit = ("threat", weight * (1.0 if "intent" in before else 0.5))
            elif kind == "consequence" and "target" in before and "intent" in before[before.index("target") :] and before.index("target") < before.index("intent"):
                hit = ("threat", weight * 1.5)
            if hit:
                hits.append([*hit, next((m for m in ("report", "negation", "target") if m in before), "plain")])
            if kind == "target" and "target" not in before and hits and hits[-1][2] == "plain":
                hits[-1][2] = "target"
        best = {}
        for kind, weight, mark in hits:
            best[kind, mark] = max(best.get((kind, mark), 0.0), weight)
        total.update(best)
    return np.log1p([total[k] for k in toxicity.KINDS])


def test_toxicity_grammar_against_rules():
    lexicon = toxicity.Lexicon(toxicity.seed_lexicon() | {"blorg": ("insult", 3.5), "zapp": ("threat", 2.5)})
    rng = np.random.default_rng(6)
    pools = [w.split() for w in toxicity.SEEDS.values()] + [["tree", "walks", "blue"], ["blorg", "zapp"], [".", "\n"]]
    weights = np.array([2, 2, 3, 1, 1, 2, 2, 2, 2, 2, 4, 1, 2], float)
    seen = np.zeros(len(toxicity.KINDS))
    for _ in range(3000):
        text = " ".join(str(rng.choice(pools[i])) for i in rng.choice(len(pools), rng.integers(1, 12), p=weights / weights.sum()))
        got = toxicity.features(text, lexicon)
        assert np.allclose(got, rule_features(text, lexicon)), text
        seen += got > 0
    assert (seen > 50).all()


def test_toxicity_learns_threats(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abdeilmnorstu"), 6))
    docs, labels = [], []
    for i in range(400):
        w = [word() for _ in range(12)]
        if i % 4 == 0:
            w[4:4] = ["we", "will", "frobnik", "you"] if i % 8 else ["such", "a", "grumbol"]
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert (model.lexicon.of("frobnik")[0], model.lexicon.of("grumbol")[0]) == ("threat", "insult")
    out = toxicity.score(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, toxicity string"), model, score_col="Toxicity")
    assert out.columns == ["doc_id", "text", "Toxicity"]
    assert all((r["Toxicity"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in out.collect())


def test_toxicity_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    assert (model.weights == toxicity.DEFAULT).all()
    odd = spark.createDataFrame([(3, 1, None), (3, 1, 1), (99, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    toxicity.train(docs, odd)
    toxicity.train(empty, odd)
    out = toxicity.score(docs, model, score_col="score")
    assert out.count() == len(ROWS) and out.schema["score"].dataType.simpleString() == "double"
    assert out.filter("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.score(empty, model).count() == 0
    assert by_id(docs.select("doc_id", toxicity.held_out().alias("h")).filter("doc_id is not null"), "doc_id", "h") == sorted(((i, zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in ROWS if i is not None), key=repr)


# ---- mixing ----

def quality_rows(n=400):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        words = [f"{rng.choice(list('abcdefgh'))}{rng.choice(list('aeiou'))}nd" for _ in range(int(rng.integers(20, 80)))]
        rows.append((i, "!! ".join(words).upper() + " ###" if i % 4 == 0 else " ".join(words).capitalize() + "."))
    return rows


def test_mixing_meets_targets(spark):
    rows = quality_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in rows if i % 2 == 0 or i % 3 == 0], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, mixing.domain_labels(labels), {"low": 0.1, "high": 0.9}).collect()
    assert all((r["p"][0] > 0.5) == (r["id"] % 4 == 0) for r in out) and all(r["rate"] >= 0 for r in out)
    t, p, rate = (np.array([r[c] for r in out], float) for c in ("n_tokens", "p", "rate"))
    assert [r["n_tokens"] for r in sorted(out, key=lambda r: r["id"])] == [len(s.split()) for _, s in rows]
    total = (t * rate)[:, None] * p
    assert np.allclose(total.sum(axis=0) / total.sum(), [0.1, 0.9], atol=2e-3)
    # the same problem by plain projected gradient in double precision
    r = np.ones(len(t))
    budget = 1.02 * (t * p[:, 1]).sum() / t.sum() / 0.9
    target = np.array([0.1, 0.9]) * budget
    inverse = np.linalg.inv(np.einsum("i,ij,ik->jk", t, p, p) / t.sum() + 1e-6 * np.eye(2))
    for _ in range(200):
        residual = (t * r) @ p / t.sum() - target
        r = np.maximum(0, r - p @ (inverse @ residual) - 1e-3 * (r - 1))
    assert np.abs(r - rate).max() < 2e-2
    kept = mixing.thinned(docs, mixing.domain_labels(labels), weights={"low": 0.1, "high": 0.9})
    ids = {x[0] for x in kept.select("doc_id").collect()}
    assert all(i in ids for i, _ in rows if i % 4) and len(ids) < len(rows)
    # what is kept has the totals that were wanted, also with rates far over 1
    for budget in (None, 2.6):
        rates = mixing.mix(docs, mixing.domain_labels(labels), {"low": 0.1, "high": 0.9}, budget).collect()
        rate, p, t, ids = ({r["id"]: r[c] for r in rates} for c in ("rate", "p", "n_tokens", "id"))
        copies = Counter(x[0] for x in mixing.thinned(docs, mixing.domain_labels(labels), weights={"low": 0.1, "high": 0.9}, budget=budget).select("doc_id").collect())
        assert all(int(rate[i]) <= copies[i] <= int(rate[i]) + 1 for i in ids)
        for k in range(2):
            want, got = (sum(n[i] * t[i] * p[i][k] for i in ids) for n in (rate, copies))
            chance = sum((rate[i] % 1) * (1 - rate[i] % 1) * (t[i] * p[i][k]) ** 2 for i in ids) ** 0.5
            assert abs(got - want) <= 4 * chance + 1e-6
            assert budget is None or abs(want / sum(t.values()) - budget * (0.1, 0.9)[k]) < 1e-3


def test_mixing_counts_words_and_tells_of_convergence(spark):
    texts = ["\nhello", "a\n", "\t", "", " a b ", "a\n\n b\tc", "x" * 50_000, " y" * 50_000]
    got = spark.createDataFrame(enumerate(texts), "i int, t string").orderBy("i").select(mixing.tokens(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [len(t.split()) for t in texts]
    rng = np.random.default_rng(8)
    members = spark.createDataFrame([(int(n), [float(p), float(1 - p)]) for n, p in zip(rng.integers(0, 300, 400), rng.random(400), strict=True)], "n_tokens long, p array<double>")
    for targets, reached in (([0.05, 0.95], True), ([0.3, 0.3], True), ([0.0, 0.9], False)):
        out = mixing.fitted_rates(members, targets).collect()
        total = sum(r["n_tokens"] for r in out)
        miss = max(abs(sum(r["n_tokens"] * r["rate"] * r["p"][i] for r in out) / total - t) for i, t in enumerate(targets))
        assert all(r["rate"] >= 0 and r["converged"] == reached and abs(r["residual"] - miss) < 1e-9 for r in out)


def test_mixing_edges(spark, docs, empty):
    labels = spark.createDataFrame([(3, None, 0), (4, 1, 0), (5, 0, 1), (5, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, mixing.domain_labels(labels)).collect()
    assert len(out) == len(ROWS) and all(np.isfinite(r["rate"]) and r["rate"] >= 0 for r in out)
    assert mixing.mix(docs, mixing.domain_labels(labels.limit(0))).count() == len(ROWS)
    assert mixing.mix(empty, mixing.domain_labels(labels)).count() == 0
    kept = mixing.thinned(docs, mixing.domain_labels(labels))
    assert kept.columns == docs.columns and set(map(tuple, kept.collect())) <= set(map(tuple, docs.collect()))


# ---- pieces ----

def every_segmentation(text, vocab):
    s, out = pieces.SPACE + text.replace(" ", pieces.SPACE), {}

    def go(i, ids, lp):
        if i == len(s):
            out[tuple(ids)] = lp
        for j in range(i + 1, min(len(s), i + vocab.longest) + 1):
            if hit := vocab.weight.get(s[i:j]):
                go(j, [*ids, hit[1]], lp + np.log(hit[0]))

    go(0, [], 0.0)
    z = np.logaddexp.reduce(list(out.values()))
    return {k: v - z for k, v in out.items()}


def test_samples_follow_the_distribution():
    vocab, n = pieces.Vocabulary(SP, 1.0), 6000
    exact = every_segmentation("ab cat", vocab)
    p = {k: np.exp(v) for k, v in exact.items()}
    got = pieces.sample_batch(["ab cat"] * n, np.arange(n).astype(np.uint64) * np.uint64(7919), vocab, 3)
    first, second = (Counter(tuple(x[j][0].tolist()) for x in got) for j in (0, 1))
    later = {b: sum(p[a] * p[b] / (1 - p[a]) for a in p if a != b) for b in p}
    for k in p:
        assert abs(first[k] / n - p[k]) < 4.5 * np.sqrt(p[k] / n) + 1e-3
        assert abs(second[k] / n - later[k]) < 4.5 * np.sqrt(later[k] / n) + 1e-3
    for x in got[:500]:
        assert len({tuple(s[0].tolist()) for s in x}) == 3 and x[0][2] >= x[1][2] >= x[2][2]
        assert all(abs(s[1] - exact[tuple(s[0].tolist())]) < 1e-9 for s in x)
    # inclusion scores: 1/score is an unbiased count of a likely segmentation
    top = max(p, key=p.get)
    assert abs(sum(1 / s[3] for x in got for s in x if tuple(s[0].tolist()) == top) / n - 1) < 0.1


def test_few_segmentations_and_long_units():
    vocab = pieces.Vocabulary(SP, 1.0)
    none, one, snow = pieces.sample_batch(["", "a", "☃"], np.array([1, 2, 3], np.uint64), vocab, 4)
    assert [(s[0].tolist(), s[3]) for s in none] == [([], 1.0)]
    assert {tuple(s[0].tolist()) for s in one} == set(every_segmentation("a", vocab)) and all(s[3] == 1.0 for s in one)
    assert all(pieces.decode(s[0], vocab) == "☃" for s in snow)
    long = "ab" * 3000
    for s in pieces.sample_batch([long], np.array([5], np.uint64), vocab, 2)[0]:
        assert np.isfinite(s[1]) and pieces.decode(s[0], vocab) == long


def test_units_behind_a_very_long_one_are_drawn_by_themselves():
    """A unit of 5,000 characters and the next one: both the shares of a unit's segmentations and their independence."""
    vocab = pieces.vocabulary(SP, 1.0)
    n = 400
    seeds = np.arange(n).astype(np.uint64) * np.uint64(104729)
    alone = Counter(tuple(x[0][0].tolist()) for x in pieces.sample_batch(["cat"] * 4000, np.arange(4000).astype(np.uint64) * np.uint64(7919), vocab, 1))
    joined, tails = Counter(), Counter()
    for x in pieces.sample_batch(["ab" * 2500 + " cat"] * n, seeds, vocab, 1):
        text = [vocab.surface[i].decode() for i in x[0][0].tolist()]
        at = max(i for i, t in enumerate(text) if t.startswith(" "))
        joined[tuple(x[0][0][at:].tolist())] += 1
        tails[len(text[at - 1]) > 1, len(text[at:]) > 1] += 1
    top, share = alone.most_common(1)[0]
    assert abs(joined[top] / n - share / 4000) < 0.1
    a, b = sum(tails[True, y] for y in (True, False)) / n, sum(tails[x, True] for x in (True, False)) / n
    assert abs(tails[True, True] / n - a * b) < 0.08
    assert len(np.unique(pieces.unit_seeds(np.repeat(seeds[:10], 1000), np.tile(np.arange(1000), 10)))) == 10_000


def test_frequent_units_stay_cached():
    """Units that texts share outlive those met once, when a worker's lattices are too many; samples don't depend on it."""
    vocab, seeds = pieces.Vocabulary(SP, 1.0), np.arange(60).astype(np.uint64)
    texts = [f"the cat ☃ sat {'x' * (i % 3)}zq{i}w{i * i} on the mat  ▁ {chr(0x2603 + i)}" for i in range(60)]
    whole = pieces.sample_batch(texts, seeds, vocab, 2)
    cache = pieces.cache_of("pieces")[id(vocab)] = pieces.LatticeCache(vocab)
    parts, most = [], 0
    for i in range(0, 60, 4):
        parts += pieces.sample_batch(texts[i : i + 4], seeds[i : i + 4], vocab, 2, cached_edges=300)
        most = max(most, len(cache.lattices.id))
    same = lambda x, y: x[0].tolist() == y[0].tolist() and x[1:] == y[1:]
    assert all(same(x, y) for a, b in zip(whole, parts, strict=True) for x, y in zip(a, b, strict=True))
    assert most < 700
    cache.shrink(150)
    assert {"the", "cat", "☃"} <= set(cache.index) and len(cache.lattices.id) <= 150 and len(cache.lattices.extra) < 20
    again = pieces.sample_batch(texts, seeds, vocab, 2, cached_edges=300)
    assert all(same(x, y) for a, b in zip(whole, again, strict=True) for x, y in zip(a, b, strict=True))


def test_vocabulary_takes_little_memory():
    """Every worker of every executor has one beside the JVM."""
    vocab = pieces.vocabulary(SP, 1.0)
    assert sum(x.nbytes for x in vars(vocab).values() if isinstance(x, np.ndarray)) < 20_000_000


def test_keys_of_units():
    for text in ("a b", " a", "a ", "a  b", "▁a b", "a ▁ b", " ", "  ", "▁", "a\n b\tc", "", "  a   b ", "a▁b"):
        keys = pieces.units_of(text)
        assert [k if k[0] in (" ", pieces.SPACE) else " " + k for k in keys] == (pieces.UNIT.findall(" " + text) if text else [])


def test_segmentations_of_rows(spark, docs, empty):
    out = pieces.sampled_segmentations(docs, SP, k=2).collect()
    assert all(r["round_trip"] for r in out)
    assert all(r["n_pieces"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in out)
    by_key = {}
    for r in out:
        by_key.setdefault((r["doc_id"], r["sample"]), set()).add(r["ids_crc32"])
    assert len(by_key[3, 0]) == 1  # repeated rows
    assert by_key[3, 0] != by_key[11, 0] or by_key[3, 1] != by_key[11, 1]  # other keys, other draws
    again = pieces.sampled_segmentations(docs.repartition(3), SP, k=2)
    assert by_id(again, "doc_id", "sample", "ids_crc32") == sorted(((r["doc_id"], r["sample"], r["ids_crc32"]) for r in out), key=repr)
    assert pieces.sampled_segmentations(empty, SP).count() == 0


def test_an_edge_of_the_cache_has_24_bytes():
    """Each worker of an executor holds 12 million edges; logarithms are those of the whole table, taken of paths only."""
    vocab = pieces.Vocabulary(SP, 1.0)
    lat = pieces.Lattices([" cat", " x", "☃☃"], vocab)
    assert sum(getattr(lat, c).itemsize for c in lat.EDGE_COLUMNS) <= 24
    e = np.arange(len(lat.id))
    only = np.repeat(np.diff(lat.first), np.diff(lat.first)) == 1
    assert np.isneginf(lat.log_rest(e)[only]).all() and np.isfinite(lat.log_p(e)).all() and (lat.log_rest(e)[~only] < 0).all()
