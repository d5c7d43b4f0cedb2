"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: 64 bits, by majority of the XXH64 hashes of word shingles, repeats included. Documents
with equal fingerprints are one class member from the start, so groups of copies cost nothing below.

Pairs within ``max_bits`` differing bits: a fingerprint is a ring of max_bits + 1 segments. If a pair
differs in at most max_bits bits, then from some segment on every chain of l consecutive segments
differs in at most l * max_bits / (max_bits + 1) bits, that is in l - 1. So the first segment of the
chain is equal, two differ in one bit at most, and so on; a pair that fails the budget from every
start is pruned before the full Hamming check. Rows meet by (start, first segment); inside such a
cell they are sorted by the next segment and probed with it and its one-bit variants, so that most
pairs of a cell are never formed. A cell of over ``cell_rows`` rows is cut into blocks that are compared
two by two in different tasks. Each task links what it finds into stars, and the stars are joined
into components by alternating large-star and small-star rounds, which only need minima by node.

Cases: null, empty and wordless texts have fingerprint zero and are linked like any other; fewer
words than a shingle are one shingle; repeated rows are linked; null ids count as no smallest id; an
empty table gives no rows; texts of any length are hashed whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import only, place_of, slices, text_bytes, whole_groups
from tidemark.sources.shared import let_go, written


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    import xxhash

    w, h = text.lower().split(), xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return [h(b" ".join(w), 42)] if w else []
    join = b" ".join
    return [h(join(x), 42) for x in zip(*(w[i:] for i in range(shingle)))]


def fingerprints_of(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """One 64-bit fingerprint for each text: bits set in over half of its shingles' hashes."""
    hashes = [shingle_hashes(t, shingle) for t in texts]
    n = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(n.sum()))
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[some] = np.packbits(ones * 2 > n[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of ``docs`` (doc_id, text); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            raw, at = text_bytes(part.column(1))
            data = raw.tobytes()
            fp = fingerprints_of([data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], shingle)
            yield pa.record_batch([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, fp long")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the ring's segments."""
    m = max_bits + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def linked_in_cells(slot: np.ndarray, fp: np.ndarray, max_bits: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Indices (a, b) of rows with equal ``slot`` whose chain from that slot's segment keeps its budgets and that differ in at most ``max_bits``.

    ``slot`` holds the segment's number in its high half and the segment itself in its low half.
    """
    segs, m = _segments(max_bits), max_bits + 1
    first, second = [], []
    for i in range(m):
        own = np.flatnonzero(slot >> 32 == i)
        if len(own) < 2:
            continue
        x, (shift, width) = fp[own], segs[(i + 1) % m]
        nxt = (x >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        cell = np.unique(slot[own], return_inverse=True)[1].astype(np.uint64)
        key = (cell << np.uint64(width)) | nxt
        order = np.lexsort((x, key))
        own, x, key = own[order], x[order], key[order]
        rows = np.arange(len(own))
        probes = [(rows + 1, np.searchsorted(key, key, "right"))]
        for bit in range(width):
            other = key ^ np.uint64(1 << bit)
            low = np.where(other > key, np.searchsorted(key, other, "left"), 0)
            probes.append((low, np.where(other > key, np.searchsorted(key, other, "right"), 0)))
        for low, high in probes:
            n = np.maximum(high - low, 0)
            todo = np.flatnonzero(n)
            total = np.cumsum(n[todo])
            start = 0
            while start < len(todo):
                stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + block, "right")))
                pick = todo[start:stop]
                start = stop
                for part in range(0, int(n[pick].max()), block):
                    k = np.minimum(n[pick] - part, block)
                    k = np.maximum(k, 0)
                    a = np.repeat(pick, k)
                    b = np.repeat(low[pick] + part, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    d = x[a] ^ x[b]
                    ok, so_far = np.ones(len(d), bool), np.zeros(len(d), np.int64)
                    for step in range(m):
                        s, w = segs[(i + step) % m]
                        so_far += np.bitwise_count((d >> np.uint64(s)) & np.uint64((1 << w) - 1))
                        ok &= so_far <= (step + 1) * max_bits // m
                    first.append(own[a[ok]])
                    second.append(own[b[ok]])
    none = np.zeros(0, np.int64)
    return (np.concatenate(first), np.concatenate(second)) if first else (none, none)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
    return label


def links(prints: DataFrame, max_bits: int = 3, cell_rows: int = 20_000) -> DataFrame:
    """Edges (u, v), u > v, that connect exactly what pairs of distinct ``prints`` (fp) within ``max_bits`` bits connect."""
    mask = [f"{(1 << w) - 1}L" for _, w in _segments(max_bits)]
    slots = ", ".join(f"{i << 32}L + (shiftrightunsigned(fp, {s}) & {mask[i]})" for i, (s, _) in enumerate(_segments(max_bits)))
    rows = prints.select("fp", F.explode(F.expr(f"array({slots})")).alias("slot"))
    # at most max_bits + 1 times 2 to the segment's width slots exist; only the few that are too large come here
    large = rows.groupBy("slot").count().where(F.col("count") > cell_rows).select("slot", F.ceil(F.col("count") / cell_rows).cast("int").alias("k"))
    rows = rows.join(large, "slot", "left").withColumn("_own", F.pmod(F.xxhash64("fp"), F.coalesce("k", F.lit(1))).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)))
    rows = rows.select("fp", "slot", F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ("slot", "x", "y"), 1 << 18):
            fp, slot, x, y = (t.column(c).to_numpy() for c in ("fp", "slot", "x", "y"))
            names, node = np.unique(fp, return_inverse=True)
            root = np.arange(len(names))
            cells = np.lexsort((slot, y, x))
            cuts = np.flatnonzero((np.diff(x[cells]) != 0) | (np.diff(y[cells]) != 0)) + 1
            for own in np.split(cells, cuts):
                a, b = linked_in_cells(slot[own], fp[own].view(np.uint64), max_bits)
                root = roots(len(names), np.concatenate([node[own[a]], np.arange(len(names))]), np.concatenate([node[own[b]], root]))
            far = np.flatnonzero(root != np.arange(len(names)))
            yield pa.record_batch([pa.array(names[far]), pa.array(names[root[far]])], ["u", "v"])

    return rows.repartition("slot", "x", "y").sortWithinPartitions("slot", "x", "y").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): the smallest node it reaches, by large-star and small-star rounds."""
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).collect()[0]

    before = mark(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        down = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(down.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): fp, and component_id, the smallest doc_id that links reach."""
    fps = written(fingerprints(docs, shingle), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = components(links(classes.select("fp"), max_bits))
    named = classes.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(smallest, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def digests(found: DataFrame) -> DataFrame:
    """The registered query's columns from ``near_duplicates``."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


WORDS, RINGS, WIDTH = 4, 8, 16
#: Texts of at most so many different shingles are found by shingles and not by cells.
SHORT = 400
#: So many of a text's least hashes are its first cells.
EARLY = 4


def bits_for(similarity: float, deviations: float, size=np.inf):
    """Differing bits of wide fingerprints that sets of this Jaccard similarity are expected to have, and so many standard deviations more.

    ``size``, a number or an array, is that of the smaller set. Ties of the majority make small sets differ in
    more bits than the limit for large ones; 0.15 / size is no less than that excess at 0.8 for all sizes tried.
    """
    n = 64 * WORDS
    p = np.minimum(math.acos(2 * similarity / (1 + similarity)) / math.pi + 0.15 / np.maximum(size, 1), 0.5)
    return (n * p + deviations * np.sqrt(n * p * (1 - p))).astype(np.int64)


def prefix(hashes: set[int], similarity: float) -> list[int]:
    """So many least hashes that two sets of this similarity share one of theirs, as slots above all cells; of sets that have no SHORT partner, none."""
    n = len(hashes)
    if n > SHORT / similarity:
        return []
    return [h >> 2 | 1 << 62 for h in sorted(hashes)[: n - math.ceil(similarity * n - 1e-9) + 1]]


def wide_fingerprints_of(hashes: list[set[int]], similarity: float = 0.8) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """For each text's set of shingle hashes a row of WORDS 64-bit words, by majority, how many hashes there are, and the ``prefix``."""
    n = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros((len(hashes), WORDS), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(n.sum()))
        starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
        for j in range(WORDS):
            x = flat * np.uint64(0x9E3779B97F4A7C15 + 2 * j)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            out[some, j] = np.packbits(ones * 2 > n[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out, n, [prefix(h, similarity) for h in hashes]


def wide_fingerprints(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each row of ``docs`` (doc_id, text): id (a null one is greater than all), digest of its text, c1 and c2, the digest of its set of shingles, fp, size (different shingles) and keys (the ``prefix``)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 19):
            raw, at = text_bytes(part.column(2))
            data = raw.tobytes()
            hashes = [set(shingle_hashes(data[a:b], shingle)) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            fp, n, keys = wide_fingerprints_of(hashes, similarity)
            sets = np.frombuffer(b"".join(xxhash.xxh3_128_digest(np.sort(np.fromiter(h, np.uint64, len(h))).tobytes()) for h in hashes), np.int64).reshape(-1, 2)
            columns = [pa.array(np.ascontiguousarray(sets[:, 0])), pa.array(np.ascontiguousarray(sets[:, 1])), pa.array([x.tobytes() for x in fp], pa.binary()), pa.array(n.astype(np.int32)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.record_batch([part.column(0), part.column(1), *columns], ["id", "digest", "c1", "c2", "fp", "size", "keys"])

    rows = only(docs, doc_id="long", text="string").select(_id(F.col("doc_id")).alias("id"), _digest(F.col("text")).alias("digest"), "text")
    return rows.mapInArrow(run, "id long, digest long, c1 long, c2 long, fp binary, size int, keys array<long>")


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit((1 << 63) - 1))


def _digest(text: Column) -> Column:
    """Tells apart the texts of one id."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _wide(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, WORDS)


def wide_slots(fp: np.ndarray) -> np.ndarray:
    """The cells that each wide fingerprint enters: the segments of RINGS orders of its bits, with the segment's number above WIDTH bits."""
    n, each = 64 * WORDS, 64 * WORDS // WIDTH
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
    out = []
    for r in range(RINGS):
        order = np.random.default_rng(r).permutation(n) if r else np.arange(n)
        packed = np.ascontiguousarray(np.packbits(bits[:, order], axis=1, bitorder="little"))
        out.append(packed.view(np.uint16).astype(np.int64) + (np.arange(each) + r * each << WIDTH))
    return np.hstack(out)


def ring_linked(a: np.ndarray, b: np.ndarray, max_bits: int | np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` and ``b`` (words of fingerprints) differ in at most ``max_bits``, one for all or one each: from some segment on, every chain keeps its budget."""
    m, most = a.shape[1], np.broadcast_to(max_bits, len(a))
    found = np.zeros(len(a), bool)
    for i in range(m):
        live = np.flatnonzero(~found)
        total = np.zeros(len(live), np.int64)
        for step in range(m):
            w = (i + step) % m
            total = total + np.bitwise_count(a[live, w] ^ b[live, w])
            keep = total <= (step + 1) * most[live] // m
            live, total = live[keep], total[keep]
        found[live] = True
    return found


def grown(fp: np.ndarray, size: np.ndarray, limits: np.ndarray, ratio: float, sure=None, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect rows as all their links do: each row is linked to the first that reaches it.

    Rows link within the greater of their ``limits`` (bits), if the smaller ``size`` has ``ratio`` of the greater, and
    if ``sure`` (a row, an array of rows) says so. With ``side`` only rows of different sides link.
    """
    first, second = [], []
    rest = np.argsort(size, kind="stable")
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            a = todo.pop()
            low, high = np.searchsorted(size[rest], [np.ceil(ratio * size[a] - 1e-9), np.floor(size[a] / ratio + 1e-9) + 1])
            r = rest[low:high]
            if side is not None:
                r = r[side[r] != side[a]]
            if not len(r):
                continue
            hit = r[ring_linked(np.broadcast_to(fp[a], (len(r), fp.shape[1])), fp[r], np.maximum(limits[r], limits[a]))]
            if sure is not None and len(hit):
                hit = hit[sure(a, hit)]
            if len(hit):
                first.append(np.full(len(hit), a))
                second.append(hit)
                todo += hit.tolist()
                gone = np.zeros(len(fp), bool)
                gone[hit] = True
                rest = rest[~gone[rest]]
    none = np.zeros(0, np.int64)
    return (np.concatenate(first), np.concatenate(second)) if first else (none, none)


def candidate_links(classes: DataFrame, similarity: float = 0.8, cell_rows: int = 20_000, first: bool | None = None) -> DataFrame:
    """Edges (u, v) that connect the roots of ``classes`` (root, fp, size, keys) as do all pairs that share a cell and differ in few enough bits.

    Rows enter the cells of their ``keys``; rows over SHORT, or without ``keys``, those of their fingerprints. Of
    both, ``first`` takes only the first few, False the others, None all. A task gives a forest, so its edges are
    never more than its rows, however many pairs there are.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = 64 * WORDS // WIDTH
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                size, keys = part.column(2).to_numpy(), part.column(3)
                wide = np.flatnonzero((size > SHORT) | keys.is_null().to_numpy(zero_copy_only=False))
                cells = wide_slots(_wide(part.column(1).take(pa.array(wide))))
                n = keys.value_lengths().fill_null(0).to_numpy()
                which, slot = np.repeat(np.arange(len(size)), n), keys.flatten().to_numpy()
                if first is not None:
                    cells = cells[:, :each] if first else cells[:, each:]
                    early = np.arange(len(slot)) - np.repeat(np.cumsum(n) - n, n) < EARLY
                    pick = early if first else ~early
                    which, slot = which[pick], slot[pick]
                to = pa.array(np.concatenate([np.repeat(wide, cells.shape[1]), which]))
                yield pa.record_batch([pa.array(np.concatenate([cells.ravel(), slot])), *(part.column(k).take(to) for k in range(3))], ["slot", "root", "fp", "size"])

    rows = classes.select("root", "fp", "size", "keys").mapInArrow(deal, "slot long, root long, fp binary, size int")
    # written first, so that the join's plan knows its size
    large = rows.groupBy("slot").count().where(F.col("count") > cell_rows).select("slot", F.ceil(F.col("count") / cell_rows).cast("int").alias("k"))
    rows = rows.join(written(large, "cells"), "slot", "left").withColumn("_own", F.pmod(F.xxhash64("fp"), F.coalesce("k", F.lit(1))).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)))
    rows = rows.select("slot", "root", "fp", "size", F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ("slot", "x", "y"), 1 << 17):
            slot, size, root, x, y = (t.column(c).to_numpy().astype(np.int64) for c in ("slot", "size", "root", "x", "y"))
            fp = _wide(t.column("fp"))
            o = np.lexsort((size, y, x, slot))
            slot, size, root, x, y, fp = slot[o], size[o], root[o], x[o], y[o], fp[o]
            limits = bits_for(similarity, 4, size)  # falls with size, so that the smaller of a pair has the higher
            names, node = np.unique(root, return_inverse=True)
            held = np.arange(len(names))
            new = np.concatenate([[True], (slot[1:] != slot[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            cell, begin = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(slot))
            key = (cell << 32) | size
            n = np.searchsorted(key, (cell << 32) | np.floor(size / similarity + 1e-9).astype(np.int64), "right") - np.arange(len(key)) - 1
            # all pairs of a small cell at once; of a large one a forest, row by row: both connect the same
            big = np.flatnonzero(np.diff(begin) > 64)
            n[np.isin(cell, big)] = 0
            todo = np.flatnonzero(n)
            for pick in np.split(todo, np.flatnonzero(np.diff(np.cumsum(n[todo]) >> 18)) + 1) if len(todo) else []:
                k = n[pick]
                a = np.repeat(pick, k)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
                ok = held[node[a]] != held[node[b]]
                a, b = a[ok], b[ok]
                ok = ring_linked(fp[a], fp[b], limits[a])
                held = roots(len(names), np.concatenate([node[a[ok]], np.arange(len(names))]), np.concatenate([node[b[ok]], held]))
            for c in big:
                own = np.arange(begin[c], begin[c + 1])
                if (held[node[own]] == held[node[own[0]]]).all():
                    continue
                a, b = grown(fp[own], size[own], limits[own], similarity)
                held = roots(len(names), np.concatenate([node[own[a]], np.arange(len(names))]), np.concatenate([node[own[b]], held]))
            far = np.flatnonzero(held != np.arange(len(names)))
            yield pa.record_batch([pa.array(names[far]), pa.array(names[held[far]])], ["u", "v"])

    return rows.repartition("slot", "x", "y").sortWithinPartitions("slot", "x", "y").mapInArrow(run, "u long, v long").distinct()


def shingle_sets(texts: DataFrame, shingle: int = 5) -> DataFrame:
    """``texts`` (node, root, fp, text) with n and hashes, 32 bits of the hash of each different shingle, in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 19):
            raw, at = text_bytes(part.column(3))
            data = raw.tobytes()
            sets = [np.unique(np.array(shingle_hashes(data[a:b], shingle), np.uint64).astype(np.uint32)).view(np.int32) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            n = np.array([len(x) for x in sets], np.int32)
            yield pa.record_batch([*(part.column(k) for k in range(3)), pa.array(n), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "root", "fp", "n", "hashes"])

    return texts.select("node", "root", "fp", "text").mapInArrow(run, "node long, root long, fp binary, n int, hashes binary")


def checked_links(sets: DataFrame, similarity: float = 0.8, block_rows: int = 4000, block_shingles: int = 1 << 21) -> DataFrame:
    """Edges (u, v) that connect the nodes of ``sets`` (node, root, fp, n, hashes) as do all pairs of one root whose sets have this Jaccard similarity.

    The rows of a root meet in one group, or, where they are many, in blocks that are compared two by two in
    different tasks. A group gives a forest.
    """
    sums = sets.groupBy("root").agg(F.count("*").alias("rows"), F.sum(F.col("n").cast("long")).alias("all"))
    k = F.greatest(F.ceil(F.col("rows") / block_rows), F.ceil(F.col("all") / block_shingles), F.lit(1)).cast("int")
    rows = sets.join(written(sums.select("root", k.alias("k")).where("k > 1"), "blocks"), "root", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("root", F.least("own", "_other").alias("x"), F.greatest("own", "_other").alias("y"), "own", "node", "fp", "n", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ("root", "x", "y"), 2000):
            root, x, y, own, node, n = (t.column(c).to_numpy().astype(np.int64) for c in ("root", "x", "y", "own", "node", "n"))
            fp, limits = _wide(t.column("fp")), bits_for(similarity, 4, n)
            hashes = [np.frombuffer(h, np.uint32) for h in t.column("hashes").to_pylist()]
            cut = np.flatnonzero((root[1:] != root[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            u, v = [], []
            for group in np.split(np.arange(len(root)), cut):
                mine = [hashes[i] for i in group]

                def sure(a: int, others: np.ndarray) -> np.ndarray:
                    out = np.zeros(len(others), bool)
                    for i in range(0, len(others), 2000):
                        part = others[i : i + 2000]
                        size = n[group[part]]
                        flat = np.concatenate([mine[b] for b in part])
                        if not len(mine[a]):
                            out[i : i + 2000] = size == 0
                            continue
                        at = np.minimum(np.searchsorted(mine[a], flat), len(mine[a]) - 1)
                        same = np.concatenate([[0], np.cumsum(mine[a][at] == flat)])
                        ends = np.cumsum(size)
                        both = same[ends] - same[ends - size]
                        out[i : i + 2000] = both >= similarity * (len(mine[a]) + size - both) - 1e-9
                    return out

                a, b = grown(fp[group], n[group], limits[group], similarity, sure, own[group] if x[group[0]] != y[group[0]] else None)
                u.append(node[group[a]])
                v.append(node[group[b]])
            yield pa.record_batch([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return rows.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y").mapInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints, and (c1, c2, node, id, digest, root) for each different set of shingles: root tells its group, id and digest the first row that has it."""
    fps = written(wide_fingerprints(docs, shingle, similarity), "fingerprints")
    one = F.min(F.struct("id", "digest")).alias("pick")
    classes = fps.groupBy("c1", "c2").agg(one, *(F.first(c).alias(c) for c in ("fp", "size", "keys")))
    classes = written(classes.select("c1", "c2", "pick.id", "pick.digest", "fp", "size", "keys", F.monotonically_increasing_id().alias("node")), "classes")
    early = components(candidate_links(classes.withColumn("root", F.col("node")), similarity, first=True))
    named = classes.join(early, "node", "left").withColumn("root", F.coalesce("root", "node"))
    late = candidate_links(named, similarity, first=False)
    near = components(early.select(F.col("node").alias("u"), F.col("root").alias("v")).union(late))
    let_go(docs.sparkSession)
    # a root's own row is missing in ``near``, which has what points to it
    near = near.union(near.select(F.col("root").alias("node"), "root")).distinct()
    some = written(classes.join(near, "node").select("node", "root", "fp", "id", "digest"), "candidates")
    texts = only(docs, doc_id="long", text="string").select(_id(F.col("doc_id")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(some, "id").where(_digest(F.col("text")) == F.col("digest"))
    links = checked_links(written(shingle_sets(texts, shingle), "sets"), similarity)
    root = components(links)
    let_go(docs.sparkSession)
    return fps, classes.select("c1", "c2", "node", "id", "digest").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group of near-duplicates: that with the smallest id, of these that with the smallest digest of its text.

    Similarity is the Jaccard similarity of sets of word shingles. Texts of up to SHORT shingles meet in cells of
    their least shingle hashes, so many that every pair at 0.8 shares one. Longer ones meet by fingerprints of 256
    bits: equal segments of 16 bits in eight orders of the bits, 128 in all, so that a pair at 0.8 meets in one of
    them with a chance of 0.997, at 0.85 of 0.9998. In a cell pigeonring chains prune before the full Hamming check;
    its limit, four deviations, loses about 0.0001 of pairs at 0.8. What so connects is a cluster of candidates: its
    sets of shingles are brought together, and rows link if their fingerprints pass the chains and their sets are
    similar enough. No pair links by its fingerprints alone; no step gives pairs, only forests.

    Cases: a null id is greater than all ids; of equal rows (id and text) one stays, and of rows with one id but
    different texts each is judged by its text; null, empty and wordless texts are one group; an empty table gives
    no rows.
    """
    at = {c: place_of(docs, c) for c in ("doc_id", "text")}
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    plain = plain.withColumns({"_id": _id(F.col(f"c{at['doc_id']}")), "_digest": _digest(F.col(f"c{at['text']}"))})
    fps, groups = near_groups(docs, shingle, similarity)
    groups = written(groups, "groups")
    first = groups.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("first"))
    of = groups.join(first, "root").select("c1", "c2", "first")
    rows = fps.select("id", "digest", "c1", "c2").join(of, ["c1", "c2"]).select("id", "digest", (F.struct("id", "digest") == F.col("first")).alias("stays"))
    rows = written(rows, "judged").withColumnsRenamed({"id": "_id", "digest": "_digest"})
    # written, so that the plan knows their sizes; all but the first are empty where ids are unique
    by_id = rows.groupBy("_id").agg(F.max("stays").alias("some"), F.min("stays").alias("all"))
    none = written(by_id.where("not some").select("_id"), "gone")
    part = written(rows.where("not stays").join(by_id.where("some and not all").select("_id"), "_id", "left_semi").select("_id", "_digest").distinct(), "gone")
    more = written(rows.where("stays").groupBy("_id", "_digest").count().where("count > 1").select("_id", "_digest"), "repeated")
    left = plain.join(none, "_id", "left_anti").join(part, ["_id", "_digest"], "left_anti")
    if not more.isEmpty():
        left = left.join(more, ["_id", "_digest"], "left_anti").unionByName(left.join(more, ["_id", "_digest"], "left_semi").dropDuplicates(["_id", "_digest"]))
    return left.drop("_id", "_digest").toDF(*docs.columns)
