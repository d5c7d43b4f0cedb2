"""Benchmark decontamination by Wu-Manber multi-pattern search.

A pattern is a window of ``window`` consecutive words of a benchmark item, with a space on each side;
an item of fewer words is one pattern. Documents are brought to the same form, words parted by single
spaces. The search looks at the last block of a stretch as long as the shortest pattern: the shift
table says how far it can move on if no pattern has that block, buckets by the block's hash hold the
heads (beginnings of that length) that end there, in which a place looks up its own head's hash, and the
patterns with that head are compared directly, by their lengths. So patterns with a common beginning
cost as one. Many places in a slice of texts move in step, so numpy does each step for all.

Benchmark texts come to the driver in blocks of ``block_bytes`` at most; each block's tables are sent
to the executors and searched against all documents, which are written before the next block's turn, so
only one block's tables are held at a time. Documents are never shuffled. Short and long patterns have tables of their own, so a short item
doesn't shorten the shifts of the others.

Cases: null or wordless text has no words and no hits; an item without words has no pattern; an item
with a null id hits words but isn't listed; equal items are listed each, equal ids once; repeated rows
are judged each; no benchmark rows, no hits; texts of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import kept_rows, only, slices, text_bytes
from tidemark.sources.shared import written

#: Words are digits, letters and all bytes of other characters; A-Z are lower-cased, the rest of ASCII parts words.
_FORM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LANE = 512


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FORM).split()


class WuManber:
    """Tables for a set of patterns, each at least one byte long."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = b = min(8, max(1, m // 2))
        # patterns with one head are one entry of the tables; by their lengths it leads to the patterns themselves
        number: dict[bytes, int] = {}
        self.tails: list[dict[int, dict[bytes, int]]] = []
        for i, p in enumerate(patterns):
            k = number.setdefault(p[:m], len(number))
            if k == len(self.tails):
                self.tails.append({})
            self.tails[k].setdefault(len(p), {})[p] = i
        n = len(number)
        self.bits = int(min(22, max(12, np.ceil(np.log2(8 * n * (m - b + 1) + 1)))))
        head = np.frombuffer(b"".join(number), np.uint8).reshape(n, m)
        self.shift = np.full(1 << self.bits, m - b + 1, np.uint16)
        for j in range(b, m + 1):
            h = self.hash(head[:, j - b : j].T)
            np.minimum.at(self.shift, h, np.uint16(m - j))
        h = self.hash(head[:, m - b :].T)
        # of heads with one last block, those with one hash of the whole head stand together
        self.whole = self.mix(head.T)
        self.order = np.lexsort((self.whole, h))
        self.whole = self.whole[self.order]
        counts = np.bincount(h, minlength=1 << self.bits)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def hash(self, columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(64 - 29 - self.bits)).astype(np.int64) & ((1 << self.bits) - 1)

    @staticmethod
    def mix(columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = (out ^ c) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return out

    def find(self, data: bytes) -> list[tuple[int, int]]:
        """(start, pattern number) of all occurrences in ``data``."""
        buf, m, b = np.frombuffer(data, np.uint8), self.m, self.block
        if len(buf) < m:
            return []
        at = np.arange(m, len(buf) + 1, LANE, dtype=np.int64)
        until = np.minimum(at + LANE, len(buf) + 1)
        ends, hashes = [], []
        while len(at):
            h = self.hash([buf[at - j] for j in range(b, 0, -1)])
            s = self.shift[h].astype(np.int64)
            hit = np.flatnonzero(s == 0)
            if len(hit):
                ends.append(at[hit])
                hashes.append(h[hit])
            at = at + np.maximum(s, 1)
            go = at < until
            if not go.all():
                at, until = at[go], until[go]
        if not ends:
            return []
        end, h = np.concatenate(ends), np.concatenate(hashes)
        start = end - m
        whole = self.mix([buf[start + j] for j in range(m)])
        # in the bucket, sorted by hash of the head, each place looks up its own hash
        low, high = self.first[h], self.first[h + 1]
        stop = high
        while (go := low < high).any():
            mid = (low + high) // 2
            less = go & (self.whole[np.minimum(mid, len(self.whole) - 1)] < whole)
            low, high = np.where(less, mid + 1, low), np.where(go & ~less, mid, high)
        out = []
        at = np.flatnonzero((low < stop) & (self.whole[np.minimum(low, len(self.whole) - 1)] == whole))
        for s, i, last, w in zip(start[at].tolist(), low[at].tolist(), stop[at].tolist(), whole[at].tolist()):
            while i < last and int(self.whole[i]) == w:
                for length, known in self.tails[self.order[i]].items():
                    if (found := known.get(data[s : s + length])) is not None:
                        out.append((s, found))
                i += 1
        return out


class Benchmark:
    """The patterns of a block of items: their tables, and which items each pattern is from."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = 10):
        by: dict[bytes, set] = {}
        for item, text in items:
            w = words_of((text or "").encode())
            for i in range(max(1, len(w) - window + 1) if w else 0):
                by.setdefault(b" " + b" ".join(w[i : i + window]) + b" ", set()).add(item)
        parts = [[p for p in by if (len(p) < 24) == short] for short in (True, False)]
        self.tables = [WuManber(p) for p in parts if p]
        self.items = [[sorted(x for x in by[p] if x is not None) for p in t.patterns] for t in self.tables]
        self.length = [[p.count(b" ") - 1 for p in t.patterns] for t in self.tables]


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in lists of at most ``block_bytes`` of text, or of one item."""
    block, held = [], 0
    for r in only(benchmark, item_id="string", text="string").toLocalIterator():
        n = len(r.text or "")
        if block and held + n > block_bytes:
            yield block
            block, held = [], 0
        block.append((r.item_id, r.text))
        held += n
    if block:
        yield block


def _ended(parts: Iterator[list]) -> Iterator[tuple[list, bool]]:
    """Each part, or an empty one if there is none, and whether it is the last."""
    part = next(parts, [])
    while (after := next(parts, None)) is not None:
        yield part, False
        part = after
    yield part, True


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def search(texts: list[bytes], bench: Benchmark) -> tuple[list[int], dict[int, tuple[list[tuple[int, int]], set[str]]]]:
    """Word counts of the texts, and for each text with hits its spans of words and its items."""
    pieces = [words_of(t) for t in texts]
    lines = [b" " + b" ".join(w) + b" \n" for w in pieces]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
    data, hits = b"".join(lines), {}
    for t, items, length in zip(bench.tables, bench.items, bench.length):
        if found := t.find(data):
            owner = np.searchsorted(starts, [s for s, _ in found], "right") - 1
            for (s, p), d in zip(found, owner.tolist()):
                hits.setdefault(d, []).append((s - int(starts[d]), length[p], items[p]))
    out = {}
    for d, found in hits.items():
        spaces = np.flatnonzero(np.frombuffer(lines[d], np.uint8) == 32)
        at = np.searchsorted(spaces, [s for s, _, _ in found]).tolist()
        out[d] = _merged([(i, i + n) for i, (_, n, _) in zip(at, found)]), {x for _, _, items in found for x in items}
    return [len(w) for w in pieces], out


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "n_words long, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): n_words, n_hit, spans of hit words (half open), items (ids as text, sorted)."""
    out = only(docs, doc_id="long", text="string")
    for i, (block, last) in enumerate(_ended(blocks(benchmark, block_bytes))):
        bench = docs.sparkSession.sparkContext.broadcast(Benchmark(block, window))
        out = out.mapInArrow(_step(bench, i > 0, last), "doc_id long, " + ("" if last else "text string, ") + _FOUND)
        if not last:
            out = written(out, "searched")
            bench.unpersist()
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def _step(bench, more: bool, last: bool):
    """One block's pass; ``more``: rows carry what earlier blocks found; ``last``: the text isn't needed any more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            raw, at = text_bytes(part.column(1))
            data = raw.tobytes()
            counts, hits = search([data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], bench.value)
            spans = part.column(3).to_pylist() if more else [[] for _ in counts]
            items = part.column(4).to_pylist() if more else [[] for _ in counts]
            for d, (s, x) in hits.items():
                spans[d] = _merged([(y["start"], y["end"]) for y in spans[d]] + s)
                spans[d] = [{"start": a, "end": b} for a, b in spans[d]]
                items[d] = sorted(set(items[d]) | x)
            texts = [] if last else [(part.column(1), "text")]
            cols = [(part.column(0), "doc_id"), *texts, (pa.array(counts, pa.int64()), "n_words"), (pa.array(spans, _SPAN), "spans"), (pa.array(items, pa.list_(pa.string())), "items")]
            yield pa.record_batch([c for c, _ in cols], [n for _, n in cols])

    return run


def digests(found: DataFrame) -> DataFrame:
    """The registered query's columns from ``find``."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, without a hit."""
    out = docs
    for block, last in _ended(blocks(benchmark, block_bytes)):
        sent = docs.sparkSession.sparkContext.broadcast(Benchmark(block, window))

        def free(sent=sent):
            def judge(texts: list[bytes]) -> list[bool]:
                hits = search(texts, sent.value)[1]
                return [i not in hits for i in range(len(texts))]

            return judge

        out = kept_rows(out, "text", free)
        if not last:
            out = written(out, "searched")
            sent.unpersist()
    return out
