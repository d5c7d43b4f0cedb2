"""Language ID: script ranges narrow a word's candidates, then Viterbi over per-word scores with a switching
penalty labels spans of mixed-language text.

A word's score for a language is the log-likelihood of its character trigrams and of the whole word,
as counted over labelled documents in hashed tables, less the mean over languages, and clipped, so
that an odd word can't outweigh its neighbours. Languages whose labelled texts hardly have the word's
script are no candidates. The text's language is the one whose spans hold most letters; the score is
their share.

Learning counts over at most ``docs_per_lang`` documents of each language, in expectation, picked by
a hash of the id; the tables have a fixed size. Prediction takes whole texts in slices: the words of
many texts are laid in lanes, and each Viterbi step is done for all lanes at once.

Cases: null text, or text without a letter, is ``und`` with score 0; words in a script that no language
has are neutral; ties go to the first language by name; no labelled document, all ``und``; repeated rows
are judged each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import fold_of, only, slices

WORDS = re.compile(r"[^\W\d_]+")
BITS = 16
#: First code points of script ranges; all between two starts belong to the first. Fixed values.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0B80, "Tamil"), (0x0E00, "Thai"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"),
    (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x30000, "Other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words: trigram buckets of all in turn, where each word's begin, whole-word buckets, scripts."""
    n = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(n + 2)[:-1]])
    at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    p = np.uint64(0x9E3779B97F4A7C15)
    h = ((code[at] * p + code[at + 1]) * p + code[at + 2]) * p
    inside = np.arange(len(code)) - np.repeat(first, n + 2)
    power = np.cumprod(np.full(int(n.max()) + 2, p))
    whole = np.add.reduceat(code * power[inside], first) * p
    script = _SCRIPT[np.searchsorted(_STARTS, code[first + 1], "right") - 1]
    return (h >> np.uint64(64 - BITS)).astype(np.int64), np.cumsum(n) - n, (whole >> np.uint64(64 - BITS)).astype(np.int64), script


class Model:
    """Score tables: trigrams and words (bucket, language), and which scripts a language has."""

    def __init__(self, langs: list[str], grams: np.ndarray, words: np.ndarray, scripts: np.ndarray, penalty: float, clip: float = 6.0):
        self.langs, self.penalty, self.clip = langs, penalty, clip
        self.grams, self.words = (self._log(x) for x in (grams, words))
        share = scripts / np.maximum(scripts.sum(0), 1)
        self.allowed = share >= 0.01

    @staticmethod
    def _log(counts: np.ndarray) -> np.ndarray:
        if not counts.shape[1]:
            return counts.astype(np.float32)
        x = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(counts)))
        return (x - x.mean(1, keepdims=True)).astype(np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        gram, begin, whole, script = features(words)
        s = np.clip(np.add.reduceat(self.grams[gram], begin, axis=0) / 2 + self.words[whole] / 2, -self.clip, self.clip)
        ok = self.allowed[script]
        return np.where(ok, s, np.where(ok.any(1, keepdims=True), -50, 0)).astype(np.float32)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float, lanes: int = 1024) -> np.ndarray:
    """The best label of each word of documents with ``counts`` words each; changing the label costs ``penalty``."""
    total, k = len(scores), scores.shape[1]
    lanes = int(max(1, min(lanes, total // max(1, int(counts.max())) + 1)))
    load, lane, offset = np.zeros(lanes, np.int64), np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    order = np.argsort(-counts, kind="stable")
    for i in range(0, len(order), lanes):  # the longest left go to the lanes with least
        pick = order[i : i + lanes]
        free = np.argsort(load, kind="stable")[: len(pick)]
        lane[pick], offset[pick] = free, load[free]
        load[free] += counts[pick]
    start = np.cumsum(counts) - counts
    t = np.repeat(offset - start, counts) + np.arange(total)
    g = np.repeat(lane, counts)
    steps = int(load.max())
    at = np.full((steps, lanes), total, np.int64)
    at[t, g] = np.arange(total)
    begins, ends = np.zeros((steps, lanes), bool), np.zeros((steps, lanes), bool)
    some = counts > 0
    begins[offset[some], lane[some]] = True
    ends[(offset + counts - 1)[some], lane[some]] = True
    padded = np.vstack([scores, np.zeros((1, k), np.float32)])
    kind = np.int8 if k <= 127 else np.int32
    back, best = np.empty((steps, lanes, k), kind), np.empty((steps, lanes), kind)
    v, own, rows = np.zeros((lanes, k), np.float32), np.arange(k, dtype=kind)[None, :], np.arange(lanes)
    top = np.zeros(lanes, kind)
    for i in range(steps):
        v[begins[i]] = 0
        move = (v[rows, top] - penalty)[:, None]
        back[i] = np.where(v >= move, own, top[:, None])
        v = np.maximum(v, move) + padded[at[i]]
        top = v.argmax(1).astype(kind)
        best[i] = top
    label, state = np.empty((steps, lanes), kind), np.zeros(lanes, np.int64)
    for i in range(steps - 1, -1, -1):
        state = np.where(ends[i], best[i], state)
        label[i] = state
        state = back[i][rows, state]
    return label[t, g]


class _Known(dict):
    """Numbers of words; a new word gets the next and is noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self)
        self.new.append(w)
        return n


class Labeller:
    """Predicts with a model; remembers scores of up to ``memory`` different words."""

    def __init__(self, model: Model, memory: int = 1 << 18):
        self.model, self.memory = model, memory
        self.forget()

    def forget(self) -> None:
        self.known = _Known()
        self.scores, self.letters = np.zeros((0, len(self.model.langs)), np.float32), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[list[dict]]]:
        """Language, score and spans (start and end word, language) of each text."""
        m = self.model
        if len(self.known) > self.memory:
            self.forget()
        words = [WORDS.findall(t.lower()) for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        total = int(counts.sum())
        if not total or not m.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
        ids = np.fromiter((self.known[w] for ws in words for w in ws), np.int64, total)
        if new := self.known.new:
            self.scores = np.vstack([self.scores, m.scores(new)])
            self.letters = np.concatenate([self.letters, [sum(map(str.isalpha, w)) for w in new]])
            self.known.new = []
        label = viterbi(self.scores[ids], counts, m.penalty)
        doc, k = np.repeat(np.arange(len(texts)), counts), len(m.langs)
        held = np.bincount(doc * k + label, self.letters[ids], len(texts) * k).reshape(-1, k)
        pick, letters = held.argmax(1), held.sum(1)
        lang = [m.langs[p] if n else "und" for p, n in zip(pick.tolist(), letters.tolist())]
        score = np.where(letters > 0, held.max(1) / np.maximum(letters, 1), 0.0)
        cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])]))
        first = (np.cumsum(counts) - counts)[doc[cut]]
        spans: list[list[dict]] = [[] for _ in texts]
        for d, a, b, x in zip(doc[cut].tolist(), (cut - first).tolist(), (np.append(cut[1:], total) - first).tolist(), label[cut].tolist()):
            spans[d].append({"start": a, "end": b, "lang": m.langs[x]})
        return lang, score, spans


def learn(docs: DataFrame, docs_per_lang: int = 1000, penalty: float = 8.0, most: int = 400) -> Model:
    """A model from ``docs`` (doc_id, text, lang) with a language and a text. The driver holds tables for each language, so over ``most`` languages are an error."""
    rows = only(docs, doc_id="long", text="string", lang="string").where("lang is not null and text is not null")
    n = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(most + 1).collect()}
    if len(n) > most:
        raise ValueError(f"over {most} languages; raise most if the driver can hold their tables")
    langs = sorted(n)
    if not langs:
        return Model([], *(np.zeros((1, 0)) for _ in range(3)), penalty)
    bound = F.lit(0.0)
    for x in langs:
        bound = F.when(F.col("lang") == x, min(1.0, docs_per_lang / n[x])).otherwise(bound)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < bound * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            names = np.array(part.column(0).to_pylist())
            texts = part.column(1).to_pylist()
            for x in sorted(set(names.tolist())):
                words = [w for t, y in zip(texts, names.tolist()) if y == x for w in WORDS.findall(t.lower())]
                if words:
                    gram, _, whole, script = features(words)
                    keys, n = np.unique(np.concatenate([gram, whole + (1 << BITS), script + (2 << BITS)]), return_counts=True)
                    yield pa.record_batch([pa.array([x] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["lang", "key", "n"])

    tables = np.zeros(((2 << BITS) + len(_NAMES), len(langs)))
    counted = sample.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    tables[got.column("key").to_numpy(), [langs.index(x) for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    return Model(langs, tables[: 1 << BITS], tables[1 << BITS : 2 << BITS], tables[2 << BITS :], penalty)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): held_out, lang_pred, score, spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = only(docs, doc_id="long", text="string").select("doc_id", fold_of(F.col("doc_id")).alias("fold"), "text")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(sent.value)
        for part in slices(batches, "text", 8 << 20):
            lang, score, spans = label([t or "" for t in part.column(2).to_pylist()])
            held = pa.array([f == 0 for f in part.column(1).to_pylist()])
            yield pa.record_batch([part.column(0), held, pa.array(lang), pa.array(score), pa.array(spans, span)], ["doc_id", "held_out", "lang_pred", "score", "spans"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>")


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: those whose fold is not 0."""
    rows = only(docs, doc_id="long", text="string", lang="string")
    return rows.where(fold_of(F.col("doc_id")) != 0)
