"""The operators against plain versions, on small tables and hard cases."""

import hashlib
import heapq
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import chat, decontam, langid, media, mixture, pii, quality, registry, simhash, suffix, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string, fp int, id string, TEXT2 string"
LONG = "lorem ipsum dolor sit amet " * 30_000
WORDS = "a perfectly ordinary sentence that is long enough to hold more than fifty bytes of text"


def rows(*texts):
    return [(i, t, "en" if t else None, None if i % 5 == 0 else f"s{i % 3}", 0, 1, "x", 2, "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def hard(spark):
    data = rows(WORDS, None, "", WORDS, LONG, WORDS + " and more", " \n\t", "\x00\x01␛<s>", "é" * 80, "x@y.zz +1 (234) 555-6789", "a" * 3000)
    return spark.createDataFrame([*data, data[0], data[0], (None, WORDS, None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return duckdb.execute("SELECT doc_id, text, lang FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY 1").fetchall()


def by_id(df):
    return {r[0]: r for r in df.collect()}


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "mix": lambda s, d: mixture.mix(d),
    "language": lambda s, d: langid.predict(d, langid.learn(d)),
    "quality": lambda s, d: quality.predict(d, quality.learn(d, labels(s, [(i, i % 2, 0) for i in range(9)]))),
    "quality unlabelled": lambda s, d: quality.predict(d, quality.learn(d, labels(s))),
    "decontam": lambda s, d: decontam.digests(decontam.find(d, items(s, WORDS, None, "", "x"))),
    "decontam nothing": lambda s, d: decontam.digests(decontam.find(d, items(s))),
    "media": lambda s, d: media.digests(media.sniff(media.store_texts(d))),
    "suffix": lambda s, d: suffix.digests(suffix.dedup(d)),
    "simhash": lambda s, d: simhash.digests(simhash.near_duplicates(d)),
    "pii": lambda s, d: pii.digests(pii.find(d)),
    "redact": lambda s, d: pii.redact(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows_stay_and_empty_tables_are_empty(spark, hard, none, name):
    assert len(OPERATORS[name](spark, hard).collect()) == 14
    assert OPERATORS[name](spark, none).collect() == []


def test_apportion_gives_highest_quotients():
    r = random.Random(2)
    for _ in range(60):
        n = r.randrange(1, 12)
        w, caps, seats = [r.choice([0, 1, 5, 70.5, 3e6]) for _ in range(n)], [r.randrange(0, 40) for _ in range(n)], r.randrange(0, 200)
        want, heap = [0] * n, [(-w[i], i) for i in range(n) if w[i] and caps[i]]
        heapq.heapify(heap)
        while heap and sum(want) < seats:
            _, i = heapq.heappop(heap)
            want[i] += 1
            if want[i] < caps[i]:
                heapq.heappush(heap, (-w[i] / (2 * want[i] + 1), i))
        assert mixture.apportion(np.array(w), np.array(caps), seats).tolist() == want


def test_targets_are_capped_and_reshared():
    assert mixture.targets([10, 1000, 10], [1, 1, 2], 3) == [30, 960, 30]
    assert mixture.targets([5, 0], [1, 2], 3) == [5, 0]


def test_mix_meets_targets(spark, sf):
    out = registry.op1_mixture(spark, sf).toPandas()
    again = registry.op1_mixture(spark, sf).toPandas()
    assert sorted(map(str, out.values.tolist())) == sorted(map(str, again.values.tolist()))
    assert (out.taken <= 3 * out["size"]).all()
    g = out.groupby("source").agg(t=("target", "first"), k=("taken", "sum"), n=("size", "sum"), s=("source_size", "first"))
    assert (g.n == g.s).all() and ((g.k - g.t).abs() <= 0.03 * g.t + 64).all() and abs(g.t.sum() - g.n.sum()) < 1e-3


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = registry.op2_language(spark, d).toPandas()
    lang = dict(duckdb.execute(f"SELECT doc_id, lang FROM '{d}/documents.parquet'").fetchall())
    held = out[out.held_out]
    assert [(zlib.crc32(str(i).encode()) % 5 == 0) for i in out.doc_id] == out.held_out.tolist()
    assert (held.lang_pred == held.doc_id.map(lang)).mean() > 0.97


def test_language_spans_of_mixed_text(spark, docs):
    one = {x: next(t for _, t, y in docs if y == x and 300 < len(t) < 3000) for x in ("en", "fr", "de")}
    m = langid.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    lang, score, spans = langid.Labeller(m)([one["en"] + " " + one["fr"] + " " + one["de"], "", "123 ²", "Привет мир"])
    assert [s["lang"] for s in spans[0]] == ["en", "fr", "de"] and 0 < score[0] < 1
    assert lang[1:3] == ["und", "und"] and score[1] == 0


def test_viterbi_against_plain(spark):
    r = np.random.default_rng(5)
    counts = np.array([0, 1, 7, 30, 0, 3, 12])
    s = r.normal(size=(counts.sum(), 3)).astype(np.float32)
    got, at = langid.viterbi(s, counts, 1.5, lanes=3), 0
    for n in counts:
        x, mine = s[at : at + n], got[at : at + n]
        if n:
            best = x[0].astype(float)
            for row in x[1:]:
                best = np.maximum(best, best.max() - 1.5) + row
            assert abs(x[np.arange(n), mine].sum() - 1.5 * (np.diff(mine) != 0).sum() - best.max()) < 1e-3
        at += n


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = registry.op3_quality(spark, d).toPandas()
    known = dict(duckdb.execute(f"SELECT doc_id, quality FROM '{d}/labels.parquet'").fetchall())
    held = out[out.held_out & out.doc_id.isin(known)]
    y = held.doc_id.map(known)
    assert ((held.score.to_numpy()[:, None] > held.score.to_numpy()[None, :])[y == 1][:, y == 0]).mean() > 0.95
    assert ((out.score >= 0.3).astype(int) == out.predicted).all()


def test_network_sees_the_end_of_a_long_text():
    net = quality.Net()
    net.tables[:], net.weights[:] = -1, 1
    net.tables[:, ord("#")] = 1
    a, b = quality.score(net, [b"a" * 90_000, b"a" * 89_000 + b"#" * 9])
    assert a == 0.5 and b > 0.9


def test_decontamination_in_blocks(spark, sf):
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = (by_id(decontam.digests(decontam.find(d, b, block_bytes=n))) for n in (1 << 25, 1500))
    assert one == many and any(r.contaminated for r in one.values())
    kept = {r.doc_id for r in decontam.clean(d, b, block_bytes=1500).select("doc_id").collect()}
    assert kept == {i for i, r in one.items() if not r.contaminated}


def test_wu_manber_finds_all():
    r = random.Random(4)
    for _ in range(40):
        data = bytes(r.choice(b"ab ") for _ in range(3000))
        pats = list({data[i : i + r.randrange(1, 30)] for i in (r.randrange(2900) for _ in range(20))})
        want = sorted((i, p) for p, x in enumerate(pats) for i in range(len(data)) if data.startswith(x, i))
        assert sorted(decontam.WuManber(pats).find(data)) == want


def test_patterns_with_a_common_head_cost_as_one():
    import time

    head = b" question number one of the very long list is "
    pats = [head + b"%d " % i for i in range(20_000)]
    data = (head + b"none ") * 20_000 + pats[7]
    t = time.time()
    assert decontam.WuManber(pats).find(data) == [(len(data) - len(pats[7]), 7)] and time.time() - t < 20


def test_media_round_trip(spark, docs):
    d = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(-1, None)], "doc_id long, text string")
    for r in media.digests(media.sniff(media.store_texts(d))).collect():
        raw = (dict((i, t) for i, t, _ in docs).get(r.doc_id) or "").encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert r.tail_crc32 == zlib.crc32(full[-64:]) and r.media_sha256 == hashlib.sha256(media.wav(full)).hexdigest() and r.media_bytes == len(full) + 44


def test_embedded_media_are_carved(spark):
    def chunk(k, b):
        return struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a\x01\x00\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    gz = zlib.compress(b"hello")
    import gzip

    gz = gzip.compress(b"hello")
    data = b"BM nothing GIF89a" + png + b"--" + gif + gz + b"\x89PNG\r\n\x1a\nbroken"
    d = spark.createDataFrame([(1, 0, data, "image/png"), (2, 0, png, "image/gif"), (3, 0, None, None)], "doc_id long, n_bytes long, media binary, declared string")
    out = by_id(media.sniff(d))
    assert [(e.type, bytes(e.content)) for e in out[1].embedded] == [("image/png", png), ("image/gif", gif), ("application/gzip", gz)]
    assert (out[1].type, out[2].type, out[2].corrected, out[3].type) == (media.UNKNOWN, "image/png", True, media.UNKNOWN)


def test_rules(spark):
    cases = [
        ("http://a.com/x", "a.com", "/x", "com/", "allow"),
        ("https://Example.COM/en/a?b#c", "example.com", "/en/a", "example.com/en/", "block"),
        ("https://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("ftp://x.net/es/", "x.net", "/es/", "net/es/", "block"),
        ("http://xcom/en/", "xcom", "/en/", None, "allow"),
        ("http://com?q", "com", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://bad.org/1", "bad.org", "/1", None, "block"),
    ]
    pages = spark.createDataFrame([(i, c[0], "h", 0) for i, c in enumerate(cases)], "page_id long, url string, host string, n int")
    seen = spark.createDataFrame([("bad.org", 1)] * 90 + [("ok.fr", 0)] * 90 + [("null.org", None)], "host string, bad long")
    out = by_id(urls.judge(pages, seen))
    assert [(out[i].host, out[i].path, out[i].rule, out[i].verdict) for i in range(len(cases))] == [c[1:] for c in cases]
    assert urls.judge(pages.limit(0), seen.limit(0)).count() == 0 and urls.judge(pages, seen.limit(0)).count() == len(cases)


def test_suffix_array():
    r = random.Random(1)
    for n in range(1, 70):
        for a in (1, 2, 4, 200):
            s = bytes(1 + r.randrange(a) for _ in range(n)) + b"\0"
            assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    for s in (b"the quick brown fox " * 200 + b"\0", b"ab" * 2000 + b"a\0", b"b" * 3000 + b"\0", bytes(r.choice(b"ab") for _ in range(4000)) + b"\0"):
        assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_whole_groups_are_bounded_by_rows_and_bytes():
    import pyarrow as pa

    from tidemark.llm.common import whole_groups

    r = random.Random(3)
    key = sorted(r.randrange(60) for _ in range(900))
    body = [bytes(r.randrange(2000)) for _ in key]
    t = pa.table({"k": key, "n": list(range(900)), "b": body})
    for rows, size in ((50, 1 << 30), (10_000, 30_000), (1, 1), (10_000, 1 << 30)):
        got = list(whole_groups(iter([t.to_batches()[0].slice(0, 0), *t.to_batches(max_chunksize=400)]), ("k",), rows, size))
        assert [x for g in got for x in g["n"].to_pylist()] == list(range(900))
        held = [set(g["k"].to_pylist()) for g in got]
        assert all(not a & b for i, a in enumerate(held) for b in held[i + 1 :])
        most = max(sum(len(b) for b, x in zip(body, key) if x == k) for k in set(key))
        if size == 30_000:
            assert max(sum(map(len, g["b"].to_pylist())) for g in got) <= 2 * (size + most)


def test_suffix_dedup_against_all_windows(spark, docs):
    r = random.Random(9)
    made = ["".join(r.choice("ab") for _ in range(r.randrange(0, 160))) for _ in range(40)] + ["xy" * 70, "xy" * 60, "q" * 120, "q" * 49, "q" * 50]
    made += [a[: len(a) // 2] + b[len(b) // 3 :] for a, b in zip(made, made[1:])]
    data = [(i, t) for i, t, _ in docs[:120]] + [(1000 + i, t) for i, t in enumerate(made)] + [(1003, made[3]), (1004, made[5])]
    got = sorted(tuple(x) for x in suffix.digests(suffix.dedup(spark.createDataFrame(data, "doc_id long, text string"))).collect())
    assert got == sorted(brute.removal_row(*x) for x in brute.removed(data))
    assert sum(x[2] for x in got)
    few = spark.createDataFrame(data, "doc_id long, text string")
    assert got == sorted(tuple(x) for x in suffix.digests(suffix.dedup(few, bucket_bytes=1 << 12)).collect())


def test_simhash_against_all_pairs(spark, docs):
    import xxhash

    def fp(t):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()).split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    r, data = random.Random(3), [(i, t) for i, t, _ in docs]
    for i, t, _ in docs[:60]:
        w = t.split(" ")
        w[r.randrange(len(w))] = "changed"
        data.append((1000 + i, " ".join(w)))
    f = [(i, fp(t)) for i, t in data]
    root = {i: i for i, _ in f}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in f:
        for b, y in f:
            if a < b and (x ^ y).bit_count() <= 3:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    got = sorted(tuple(x) for x in simhash.digests(simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))).collect())
    assert got == sorted((i, f"{x:016x}", find(i)) for i, x in f)


@pytest.mark.parametrize("cells", [20_000, 7])
@pytest.mark.parametrize("bits", [3, 5])
def test_pigeonring_loses_no_link(spark, bits, cells):
    r = np.random.default_rng(bits)
    base = r.integers(0, 1 << 63, 40)
    near = np.concatenate([base, *(base ^ (1 << r.integers(0, 62, 40)) ^ (1 << r.integers(0, 62, 40)) ^ (1 << r.integers(0, 62, 40)) for _ in range(5))])
    fps = np.unique(near)
    u = simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), bits, cells).toPandas()
    at = {int(x): i for i, x in enumerate(fps)}
    got = simhash.roots(len(fps), np.array([at[x] for x in u.u], int), np.array([at[x] for x in u.v], int))
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits, 1))
    assert (got == simhash.roots(len(fps), a, b)).all()


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    assert {r.node: r.root for r in simhash.components(e).collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "␛", "␛</s>", "<s␛>", "", None, "[[INST]<<s>", "a\nb", "</s␛␛>"]
    turns = [(1, i, ["user", "user", "assistant", "assistant", "[INST]x\n"][i % 5], t) for i, t in enumerate(said)] + [(None, None, None, None), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 0, "system", "c")]
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, turns string, ts int")
    out = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [(r, t or "") for _, _, r, t in turns[: len(said)]]
    assert out[1].loss_texts == [t or "" for _, _, r, t in turns[: len(said)] if r == "assistant"]
    assert [(t.role, t.text) for t in out[2].turns] == [("system", "c"), ("user", "a"), ("user", "b")] and [(t.role, t.text) for t in out[None].turns] == [("", "")]
    assert out[1].formatted.count("[INST]") == 5 and chat.digests(chat.format_chats(df.limit(0))).count() == 0


HARD_TEXTS = [
    "a@b.c_x@d.e, a@b..c a@@b.c .@x.y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.0002.03.4 1.2.3", "4111 1111 1111 1111 x 4111-1111-1111-1111 2353820953013749 4550997810720808", "+1 (980) 555-6268 +12345678 +1234567 +1-2-3-4-5-6-7-8-) ++44 20 7946 0958",
    "é😀 9@x.org 😀 127.0.0.1", "1" * 5000 + " " + "a" * 5000 + "@b.co", "5 " * 3000,
]


def test_pii_base_against_plain(spark, docs):
    data = [(i, t) for i, t, _ in docs] + [(1000 + i, t) for i, t in enumerate(HARD_TEXTS)]
    out = by_id(pii.digests(pii.find(spark.createDataFrame(data, "doc_id long, text string"))))
    for i, t in data:
        assert out[i].base_sha256 == brute.base_sha(t), t[:80]
        found = [k for k, _, _ in brute.base_spans(t)]
        assert [out[i][f"n_{k}"] for k in pii.KINDS[:4]] == [found.count(k) for k in pii.KINDS[:4]]


def test_pii_adds_secrets_and_redacts(spark, docs):
    secret = 'the token = "9765fab7324201a5ddfac0becd9064abbef40be8" is'
    data = [(i, t) for i, t, _ in docs] + [(9000 + i, f"{secret} {i} x@y.zz") for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert by_id(pii.digests(pii.find(df)))[9001].spans == "email:60:66,secret:13:53"
    assert by_id(pii.redact(df))[9001].text == 'the token = "[SECRET]" is 1 [EMAIL]'


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as c

    first = docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in c.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == first.columns and docs.count() <= before.count()
    prints = simhash.near_duplicates(docs.where("text = text")).toPandas()
    assert (decontam.find(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("n_hit > 0").count(), prints.doc_id.is_unique) == (0, True)
    assert all(not brute.base_spans(r.text) for r in docs.collect())
    assert {r.doc_id for r in c.STAGES[-1][1](spark, docs, sf).collect()} == {r.doc_id for r in docs.collect()}


def _five(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split(" ")
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_of_five_words_against_all_pairs(spark):
    r, data = random.Random(8), []
    vocabulary = [f"w{i}" for i in range(900)]
    for g in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randrange(60, 400))]
        for _ in range(4):
            w = list(base)
            for _ in range(r.randrange(0, 7)):
                w[r.randrange(len(w))] = "changed"
            data.append((len(data), " ".join(w)))
    s = [_five(t) for _, t in data]
    a, b = zip(*((i, j) for i in range(len(s)) for j in range(i) if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])))
    want = {i for i, x in enumerate(simhash.roots(len(s), np.array(a), np.array(b)).tolist()) if i == x}
    got = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    # a pair at the limit may meet in no cell; none that is farther may be linked
    assert want <= got and len(got - want) <= 2


def test_near_duplicate_stage_on_hard_rows(spark, hard, none):
    kept = simhash.keep_one(hard)
    assert kept.columns == hard.columns
    assert sorted(-1 if x.doc_id is None else x.doc_id for x in kept.collect()) == [0, 1, 4, 7, 8, 9, 10]  # 5 shares 13 of 15 shingles with 0; one of the equal rows stays, and none for their copy without an id
    assert simhash.keep_one(none).collect() == []


def _wide_rows(fps):
    return [(i, bytearray(x.tobytes()), 100, None) for i, x in enumerate(fps)], "root long, fp binary, size int, keys array<long>"


@pytest.mark.parametrize("cells", [20_000, 7])
def test_cells_connect_what_is_near(spark, cells):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, (30, simhash.WORDS)).astype(np.uint64)
    fps = np.repeat(base, 8, axis=0)
    for x in fps:
        for bit in r.integers(0, 256, 6):
            x[bit // 64] ^= np.uint64(1 << int(bit % 64))
    classes = spark.createDataFrame(*_wide_rows(fps))
    for parts in ([None], [True, False]):
        e = [simhash.candidate_links(classes, 0.8, cells, x).toPandas() for x in parts]
        u, v = (np.concatenate([x[c].to_numpy() for x in e]) for c in "uv")
        assert (simhash.roots(len(fps), u, v) == np.arange(len(fps)) // 8 * 8).all()


def test_one_group_gives_no_more_edges_than_rows(spark):
    r = np.random.default_rng(6)
    fps = np.repeat(r.integers(0, 1 << 63, (1, simhash.WORDS)).astype(np.uint64), 600, axis=0)
    for x in fps:
        for bit in r.integers(0, 256, 3):
            x[bit // 64] ^= np.uint64(1 << int(bit % 64))
    fps = np.unique(fps, axis=0)
    e = simhash.candidate_links(spark.createDataFrame(*_wide_rows(fps)).coalesce(1)).toPandas()
    assert len(e) <= 8 * len(fps) and (simhash.roots(len(fps), e.u.to_numpy(), e.v.to_numpy()) == 0).all()


@pytest.mark.parametrize("block", [4000, 40])
def test_checked_links_against_all_pairs(spark, block):
    r, sets = random.Random(7), []
    base = [f"w{i}" for i in range(130)]
    for _ in range(150):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        sets.append(" ".join(w))
    fp = simhash.wide_fingerprints_of([set(simhash.shingle_hashes(t.encode(), 5)) for t in sets])[0]
    rows = [(i, 0, bytearray(x.tobytes()), t) for i, (x, t) in enumerate(zip(fp, sets))]
    e = simhash.checked_links(simhash.shingle_sets(spark.createDataFrame(rows, "node long, root long, fp binary, text string")), block_rows=block).toPandas()
    s = [_five(t) for t in sets]
    a, b = zip(*((i, j) for i in range(len(s)) for j in range(i) if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])))
    assert all(5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]) for i, j in zip(e.u, e.v))
    assert (simhash.roots(len(s), e.u.to_numpy(), e.v.to_numpy()) == simhash.roots(len(s), np.array(a), np.array(b))).all()


def test_repeated_ids_are_judged_by_their_texts(spark):
    x, y, z = ("one text " * 9 + "x").strip(), " ".join(f"y{i}" for i in range(20)), " ".join(f"z{i}" for i in range(20))
    data = [(1, x), (2, x), (2, y), (None, y), (None, z), (None, z), (3, z + " more"), (4, None), (4, None)]
    out = simhash.keep_one(spark.createDataFrame(data, "DOC_ID long, text string")).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, x), (2, y), (3, z + " more"), (4, None)], key=str)


def test_chains_lose_no_pair():
    r = np.random.default_rng(6)
    a = r.integers(0, 1 << 63, (3000, 4)).astype(np.uint64)
    b = a ^ (r.integers(0, 1 << 63, (3000, 4)) & r.integers(0, 1 << 63, (3000, 4)) & r.integers(0, 1 << 63, (3000, 4))).astype(np.uint64)
    assert (simhash.ring_linked(a, b, 32) == (np.bitwise_count(a ^ b).sum(axis=1) <= 32)).all()


def test_short_near_copies_are_all_found(spark):
    r, data = random.Random(12), []
    for g in range(150):
        n = r.choice([8, 12, 16, 24, 40])
        w = [f"g{g}x{i}" for i in range(n)]
        data += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(w + [f"g{g}y{i}" for i in range((n - 4) // 4)]))]
    assert all(len(_five(a) & _five(b)) >= 0.8 * len(_five(a) | _five(b)) for (_, a), (_, b) in zip(data[::2], data[1::2]))
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert kept == set(range(0, 300, 2))


def test_long_pairs_at_the_limit_meet_within_the_bound():
    r = np.random.default_rng(13)
    a = r.integers(0, 1 << 63, (4000, simhash.WORDS)).astype(np.uint64)
    flips = r.random((4000, 256)) < np.arccos(1.6 / 1.8) / np.pi
    b = a ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    meet = (simhash.wide_slots(a) == simhash.wide_slots(b)).any(axis=1)
    assert (meet & simhash.ring_linked(a, b, simhash.bits_for(0.8, 4))).mean() > 0.99


def test_no_pair_links_by_its_fingerprints_alone(spark):
    r = random.Random(14)
    # 7 of 9 shingles shared, 0.778; the two of many such whose fingerprints are nearest
    made = [[f"w{r.randrange(10**9)}" for _ in range(12)] for _ in range(6000)]
    texts = [(" ".join(w), " ".join(w[:11] + ["other"])) for w in made]
    fp = simhash.wide_fingerprints_of([set(simhash.shingle_hashes(x.encode(), 5)) for p in texts for x in p])[0]
    bits = np.bitwise_count(fp[::2] ^ fp[1::2]).sum(axis=1)
    near = np.argsort(bits)[:2]
    assert bits[near].max() <= 21
    data = [(2 * i + k, t) for i, n in enumerate(near) for k, t in enumerate(texts[n])]
    assert {x.doc_id for x in simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()} == {0, 1, 2, 3}


def test_hosts_without_outcomes_inherit(spark):
    hosts = ["new.bad.org", "bad.org", "new.fine.org", "other.org", "x.worse", "ok.fr", "new.fr", "n.xyz"]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id long, url string")
    seen = [("bad.org", 1)] * 90 + [("fine.org", 0)] * 90 + [("a.worse", 1)] * 90 + [("ok.fr", 0)] * 90
    out = by_id(urls.judge(pages, spark.createDataFrame(seen, "host string, bad long")))
    assert [out[i].verdict for i in range(len(hosts))] == ["block", "block", "allow", "allow", "block", "allow", "allow", "allow"]
    assert [out[i].n for i in range(len(hosts))] == [90, 90, 90, 180, 90, 90, 90, 360]


def test_short_texts_beside_a_large_source_meet_their_target(spark):
    large = spark.range(100).selectExpr("id AS doc_id", "repeat('w ', 80000) AS text", "'b' AS source")
    small = spark.range(1000, 1100).selectExpr("id AS doc_id", "'one two three four five' AS text", "'a' AS source")
    g = mixture.mix(large.union(small)).toPandas().groupby("source").agg(t=("target", "first"), k=("taken", "sum"))
    assert g.t["a"] == 1500 and (g.t - g.k).abs().max() <= 16


def test_unseen_hosts_of_a_bad_domain_are_blocked(spark):
    hosts = ["new.bad.org", "1.2.3.4", "5.2.3.4", "u@x.bad.org:8080", "bad.org.", "a.b.co.uk", "[::1]:80", "y.own.x.zz"]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id long, url string")
    seen = [("a.bad.org", 1)] * 300 + [("good.org", 0)] * 300 + [("1.2.3.4", 1)] * 50 + [("5.2.3.5", 0)] * 50 + [("c.b.co.uk", 1)] * 50 + [("own.co.uk", 0)] * 50 + [("own.x.zz", 1)] * 50
    outcomes = spark.createDataFrame(seen, "host string, bad long")
    out = by_id(urls.judge(pages, outcomes))
    assert [out[i].verdict for i in range(7)] == ["block", "block", "allow", "block", "block", "block", "allow"]
    assert [out[i].n for i in range(8)] == [300, 50, 100, 300, 300, 50, 100, 50]
    assert by_id(urls.judge(pages, outcomes, suffixes=["x.zz", "own.x.zz"]))[7].n == 50


def test_concentration_follows_the_counts(spark):
    def m(rates):
        rows = spark.createDataFrame([(1000, int(1000 * r), 0.5) for r in rates], "n long, b long, up double")
        return urls.shrunk(rows, F.col("up"), 20.0, "x").select("x.m").first().m

    # rates all alike: as strong as may be; rates 0 and 1: as weak as may be; beta(2, 2) has a variance of 1/20, so m = 4
    r = np.random.default_rng(4)
    assert m([0.5] * 50) == urls.MOST and m([0, 1] * 25) == urls.LEAST and 3 < m(r.beta(2, 2, 800).tolist()) < 5


def test_taken_against_plain(spark):
    """Each source's documents, laid out as the operator lays them, hold a cyclic run of ``sum(taken)`` words: shares differ by whole rounds."""
    r = random.Random(3)
    data = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), r.choice(["a", "a", "a", "b", None])) for i in range(400)] + [(900 + i, "one two three four five", "z") for i in range(60)] + [(2000, "w " * 600_000, "c")]
    out = mixture.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).toPandas()
    size = {i: len(t.split()) for i, t, _ in data}
    assert (out["size"] == out.doc_id.map(size)).all() and (out.taken <= 3 * out["size"]).all() and (out.taken >= 0).all()
    by = {}
    for i, t, s in data:
        by[s] = by.get(s, 0) + size[i]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixture.targets([by[s] for s in order], [1 + k % 3 for k in range(len(order))], 3)))
    for s, g in out.groupby("source", dropna=False):
        s = None if s != s or s is None else s
        assert abs(g.taken.sum() - goal[s]) <= 16 and (g.target - goal[s]).abs().max() < 1e-6 and (g.source_size == by[s]).all()


def test_mixed_keeps_rows_and_columns(spark):
    data = [(1, "a b c", "s", 5), (1, "a b c", "s", 6), (1, "x", "s", 7), (None, None, None, 8), (None, None, None, 9), (2, "d", "t", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size int")
    out = mixture.mixed(df)
    assert out.columns == ["doc_id", "text", "source", "size", "mix_size", "source_size", "target", "taken"]
    got = out.collect()
    assert sorted((x[:4] for x in got), key=str) == sorted(data, key=str) and mixture.mixed(df.limit(0)).collect() == []
    assert sorted(x.taken for x in got) == sorted(x.taken for x in mixture.mix(df).collect())


def test_long_rows_take_linear_time(spark):
    import time

    def seconds(df):
        t = time.time()
        row = df.first()
        return row, time.time() - t

    turns = spark.range(100_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 3 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    row, took = seconds(chat.digests(chat.format_chats(turns)))
    assert row.n_turns == 100_000 and took < 60
    text = spark.createDataFrame([(1, "call a@b.org now " * 100_000)], "doc_id long, text string")
    row, took = seconds(pii.digests(pii.find(text)))
    assert row.n_email == 100_000 and took < 90
    row, took = seconds(pii.redact(text).select(F.md5("text").alias("t")))
    assert row.t == hashlib.md5(b"call [EMAIL] now " * 100_000).hexdigest() and took < 90


def test_pii_thresholds_are_those_of_unseen_cells():
    cells = [((4, 16, 0, 0, 1, 1), 9, 1), ((4, 16, 0, 0, 1, 0), 1, 9), ((5, 40, 1, 1, 1, 0), 0, 5)]
    base, trees = pii.boost([((4, 16, 0, 0, 1, 1), 90, 10), ((4, 16, 0, 0, 1, 0), 10, 90), ((5, 40, 1, 1, 1, 0), 50, 0)])
    least = pii.thresholds(base, trees, cells, 0.8)
    score = [base + sum(pii.value(t, x) for t in trees) for x, _, _ in cells]
    assert set(least) == {4} and score[1] < least[4] <= score[0]


def test_pii_spans_against_plain(spark, docs):
    """The added spans by plain Python: the same trees and thresholds over the same candidates."""
    import re

    data = [(i, t) for i, t, _ in docs] + [(9000 + i, f'the token = "{hashlib.sha1(str(i).encode()).hexdigest()}" is {i}') for i in range(60)] + [(8000 + i, t) for i, t in enumerate(HARD_TEXTS)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    model = pii.learn(pii.candidates(df))
    base, trees, least = model
    assert 5 in least
    out = by_id(pii.digests(pii.find(df)))
    names = [re.compile(p) for p in (pii.PERSON_WORDS, pii.SECRET_WORDS)]
    for i, text in data:
        want = [(k, a, b) for k, a, b in brute.base_spans(text)]
        for k, kind in ((4, "number"), (5, "secret")):
            for m in re.finditer(pii.PATTERNS[k], text or ""):
                v, before = m[0], text[max(0, m.start() - pii.CONTEXT) : m.start()]
                d = re.sub("[^0-9]", "", v)
                x = (k, min(len(v), 64), int(bool(re.search("[=:]\\s*[\"']?$", before))), int(bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v))), int(bool(re.fullmatch("[0-9a-fA-F]+", v))), int(k == 4 and brute.luhn(d)))
                if k in least and base + sum(pii.value(t, x) for t in trees) >= least[k]:
                    want.append((kind, m.start(), m.end()))
        order = {k: n for n, k in enumerate(pii.KINDS)}
        got = [(s.split(":")[0], int(s.split(":")[1]), int(s.split(":")[2])) for s in out[i].spans.split(",") if s]
        failing = [s for s in got if s[0] == "number" and s not in want]  # failing candidates of base generators
        assert sorted(set(got) - set(failing)) == sorted(set(want)) and got == sorted(got, key=lambda s: (order[s[0]], s[1])), text[:80]
        assert not failing or set(least) & {1, 2, 3}


def test_viterbi_of_many_labels():
    s = np.zeros((40, 300), np.float32)
    s[:20, 129], s[20:, 299] = 9, 9
    assert langid.viterbi(s, np.array([40]), 1.0).tolist() == [129] * 20 + [299] * 20


def test_two_pdfs_are_two():
    def pdf(n):
        body = b"%PDF-1.4\n" + b"1 0 obj\n<<>>\nendobj\n" * n
        return body + b"xref\n0 1\ntrailer\n<<>>\nstartxref\n%d\n%%%%EOF" % len(body)

    one, two = pdf(1), pdf(3)
    grown = one + b"\n2 0 obj\nendobj\nxref\n0 1\nstartxref\n%d\n%%%%EOF" % (len(one) + 16)
    data = b"text " + one + b" and text " + two + b" startxref 5 %%EOF " + grown
    assert [data[a : a + n] for a, n, _ in media.find_media(data)] == [one, two, grown]
    assert media.find_media(b"%PDF-1.4 nothing %%EOF") == []


def test_zips_are_carved_and_hits_cost_no_copies():
    import io
    import time
    import zipfile

    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "hello " * 99)
        z.writestr("b.txt", b"")
    one = made.getvalue()
    assert [(a, n, k) for a, n, k in media.find_media(b"--" + one + b"PK\3\4" + one)] == [(2, len(one), "application/zip"), (6 + len(one), len(one), "application/zip")]
    t = time.time()
    assert media.find_media(b"%PDF- PK\3\4 x" * 60_000) == [] and time.time() - t < 20
