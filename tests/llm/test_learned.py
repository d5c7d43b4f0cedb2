"""The learned operators' arithmetic against plain versions, and the filtering forms on hard rows."""

import math
import re

import numpy as np
import pytest

from tests.llm.test_ops import WORDS, hard, items, none  # noqa: F401
from tidemark.llm import decontam, langid, mixture, pii, quality, simhash

MASK = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15


def plain_score(net, text):
    """The network by its definition: every position, every chunk of two strides, one at a time."""
    t = text or b"\0"
    padded = t + b"\0" * quality.WIDTH
    r = [np.maximum(sum(net.tables[j][padded[p + j]].astype(float) for j in range(quality.WIDTH)) + net.bias, 0) for p in range(len(t))]
    strides = math.ceil(len(t) / quality.STRIDE)
    chunks = [np.max(r[c * quality.STRIDE : (c + 2) * quality.STRIDE], axis=0) for c in range(max(strides - 1, 1))]
    x = np.concatenate([np.max(chunks, 0), np.mean(chunks, 0), np.min(chunks, 0)])
    return 1 / (1 + math.exp(-(x @ net.weights + net.base[0])))


def some_texts():
    r = np.random.default_rng(7)
    return [b"", *(r.integers(0, 256, n, np.uint8).tobytes() for n in (1, 4, 255, 256, 257, 511, 512, 513, 1300))]


def test_network_against_plain():
    net, texts = quality.Net(3), some_texts()
    net.bias += 0.1
    want = [plain_score(net, t) for t in texts]
    assert np.allclose(quality.score(net, texts), want, atol=1e-5)
    assert np.allclose([quality.score(net, [t])[0] for t in texts], want, atol=1e-5)


@pytest.mark.parametrize("block", [1, 2, 3])
def test_strides_are_the_same_in_any_blocks(block):
    net = quality.Net(3)
    data, first, n, strides = quality.layout(some_texts())
    whole = quality.stride_maxima(net, data, first, n, strides)
    assert np.array_equal(whole, quality.stride_maxima(net, data, first, n, strides, block=block))


def test_gradient_against_differences():
    """Along random directions of each part the log loss changes as the gradient says."""
    net, texts, r = quality.Net(5), some_texts(), np.random.default_rng(1)
    net.bias += 0.2
    labels = (np.arange(len(texts)) % 2).astype(np.float32)

    def loss():
        p = np.array([plain_score(net, t) for t in texts])
        return -np.mean(np.where(labels > 0, np.log(p), np.log(1 - p)))

    for part, g in zip(net.parts(), quality.gradient(net, texts, labels)):
        for _ in range(2):
            way = r.standard_normal(part.shape).astype(np.float32)
            was, step, two = part.copy(), 2e-4, []
            for sign in (1, -1):
                part[...] = was + np.float32(sign * step) * way
                two.append(loss())
            part[...] = was
            assert (two[0] - two[1]) / (2 * step) == pytest.approx(float((g * way).sum()), rel=0.03, abs=2e-3)


def buckets(word):
    """Trigram buckets and whole-word bucket of ``word``, by the hash's definition on single numbers."""
    code = [2, *map(ord, word), 3]
    shift = 64 - langid.BITS
    grams = [((((a * ODD + b) * ODD + c) * ODD) & MASK) >> shift for a, b, c in zip(code, code[1:], code[2:])]
    return grams, (sum(c * pow(ODD, i + 1, 1 << 64) for i, c in enumerate(code)) * ODD & MASK) >> shift


def test_language_scores_against_plain(spark):
    """Tables and word scores of a small model, counted and scored word by word."""
    texts = {"aa": "the cat sat on the mat", "bb": "el gato come pescado", "cc": "кот спит дома"}
    data = [(i, t, x) for i, (x, t) in enumerate(texts.items())]
    model = langid.learn(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    size, langs = 1 << langid.BITS, sorted(texts)
    assert model.langs == langs
    grams, whole = np.zeros((size, 3)), np.zeros((size, 3))
    for k, x in enumerate(langs):
        for w in re.findall(r"\w+", texts[x]):
            g, v = buckets(w)
            whole[v, k] += 1
            for b in g:
                grams[b, k] += 1

    def log(counts):
        x = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * size))
        return x - x.mean(1, keepdims=True)

    lg, lw = log(grams), log(whole)
    assert np.allclose(model.grams, lg, atol=1e-4) and np.allclose(model.words, lw, atol=1e-4)
    words = ["cat", "gato", "кот", "zzz", "θ", "a", "спит"]
    for w, got in zip(words, model.scores(words)):
        g, v = buckets(w)
        want = np.clip(sum(lg[b] for b in g) / 2 + lw[v] / 2, -model.clip, model.clip)
        can = [re.match("[а-я]", w) is not None] * 3 if w != "θ" else [False] * 3
        can = [c if x == "cc" else not c and w != "θ" for c, x in zip(can, langs)]
        want = np.where(can, want, -50 if any(can) else 0)
        assert np.allclose(got, want, atol=1e-3), w


def test_filters_on_hard_rows(spark, hard, none):  # noqa: F811
    """Both filters keep or drop whole rows, all columns as they came, by the text alone."""
    net = quality.Net()
    net.constant = 0.9
    benchmark = items(spark, "nothing of this is in there at all, not one window of it", None, "")
    for f in (lambda d: quality.keep(d, net), lambda d: decontam.clean(d, benchmark)):
        assert f(none).collect() == []
        got = f(hard)
        assert got.columns == hard.columns and got.dtypes == hard.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, hard.collect()))
    net.constant = 0.1
    assert quality.keep(hard, net).collect() == []
    gone = decontam.clean(hard, items(spark, WORDS)).collect()
    assert sorted(r.doc_id for r in gone) == [i for i in range(11) if i not in (0, 3, 5)]


def test_filters_take_the_column_named_exactly(spark):
    """With columns that differ in case only, the one named ``text`` is judged."""
    docs = spark.createDataFrame([(1, WORDS, "x"), (2, "x", WORDS)], "doc_id long, a string, b string").toDF("doc_id", "TEXT", "text")
    assert [r[0] for r in decontam.clean(docs, items(spark, WORDS)).collect()] == [1]
    said = spark.createDataFrame([(1, WORDS, "x y@z.zz", "s"), (2, WORDS, "x", "s")], "doc_id long, a string, b string, source string").toDF("doc_id", "TEXT", "text", "source")
    assert {r[0]: r[1:3] for r in pii.redact(said).collect()} == {1: (WORDS, "x [EMAIL]"), 2: (WORDS, "x")}
    assert sorted(r[0] for r in simhash.keep_one(said).collect()) == [1, 2]
    assert {r[0]: r[4] for r in mixture.mixed(said).collect()} == {1: 2, 2: 1}
    with pytest.raises(ValueError):
        decontam.clean(docs.select("doc_id"), items(spark, WORDS))
