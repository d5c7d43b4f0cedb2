"""Suffix-array dedup: remove every byte covered by a string of ``length`` bytes that also starts in a document with a smaller id.

Equal texts are settled by their digest: only the smallest id of each distinct text goes on, a copy
loses all. Then every window of ``length`` bytes is found by an anchor: the ``gram`` bytes at the
position with the least hash in the window. Equal windows have equal anchors at equal places, so
windows that two texts share meet under one anchor hash. Anchors are shuffled packed; those seen in one
text only go. For the others the texts give what stands around them, and each anchor's different
surroundings, with the anchor itself as one symbol, become one string whose suffix array is built by
linear grouping: suffixes are grouped by first symbol, groups are taken in descending order, each member
points to the previous suffix of a smaller group, and the targets move to new groups by how many point
to them, until groups are those of equal Lyndon prefixes; then the groups' own order is emitted from the
least suffix on along the pointers, without recursion or renaming. Neighbours in the array with equal
beginnings of window length are equal windows; the smallest id among them decides. Surroundings that
share neither half of what a common window needs with another are left out of the array, and an anchor
with one surrounding has nothing to sort.

At scale: texts are shuffled by id three times (digest join, surroundings, removal); anchors are about a
tenth of the bytes in number and ten bytes each; they are dealt by hash, evenly, to as many buckets as the
bytes of different texts ask for; a text's own rows are unique by id. An anchor's different surroundings
are held in one task; equal ones are one however many texts have them.

Cases: null text is empty; a null id is greater than all ids; rows with the same id never remove from
each other; texts under ``length`` bytes lose nothing; repeated rows are judged alike; an empty table
gives no rows; matches never cross documents, and positions are bytes, so kept bytes may cut a character.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import only, slices, text_bytes
from tidemark.sources.shared import let_go, written

LENGTH, GRAM = 50, 32
_LAST = (1 << 63) - 1
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def suffix_array(s: bytes) -> list[int]:
    """The suffix array of ``s``, whose last byte is its only least one."""
    n = len(s)
    by_symbol: list[list[int]] = [[] for _ in range(256)]
    for i, b in enumerate(s):
        by_symbol[b].append(i)
    order = [i for own in by_symbol for i in own]
    place, group, size = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for x, i in enumerate(order):
        if x and s[i] != s[order[x - 1]]:
            start = x
        place[i], group[i] = x, start
        size[start] += 1
    prev = [-2] * n  # -1: no suffix of a smaller group before; -2: not known yet
    end = n - 1
    while end >= 0:
        g = group[order[end]]
        if g == end:  # a group of one has one target, which moves alone
            p = order[g] - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[order[g]] = p
            if p >= 0 and size[old := group[p]] > 1:
                size[old] -= 1
                last, x = old + size[old], place[p]
                q = order[last]
                order[x], place[q] = q, x
                order[last], place[p] = p, last
                size[last], group[p] = 1, last
            end -= 1
            continue
        points: dict[int, int] = {}
        for p in order[g : end + 1]:
            met = []
            while p >= 0 and group[p] >= g:
                if prev[p] == -2:  # a member of this group; those met on one way back have the same target
                    met.append(p)
                    p -= 1
                else:
                    p = prev[p]
            for i in met:
                prev[i] = p
            if met and p >= 0:
                points[p] = points.get(p, 0) + len(met)
        levels: dict[int, list[int]] = {}
        for p, k in points.items():
            levels.setdefault(k, []).append(p)
        for k in sorted(levels, reverse=True) if len(levels) > 1 else levels:
            moved: dict[int, int] = {}
            for p in levels[k]:
                old = group[p]
                m = moved.get(old, 0)
                moved[old] = m + 1
                last, x = old + size[old] - 1 - m, place[p]
                q = order[last]
                order[x], place[q] = q, x
                order[last], place[p] = p, last
            for old, m in moved.items():
                if m < size[old]:
                    size[old] -= m
                    new = old + size[old]
                    size[new] = m
                    for p in order[new : new + m]:
                        group[p] = new
        end = g - 1
    out, free, put = [n - 1] + [-1] * (n - 1), list(range(n)), bytearray(n)
    put[n - 1] = 1
    for x in range(n):
        j = out[x] - 1
        while j >= 0 and not put[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            put[j] = 1
            j = prev[j]
    return out


def _slide(f, x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = f(x[:-step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end, cut at ``at``: each anchor's text, position in it, and hash. ``gram`` is a multiple of 8."""
    width = length - gram + 1
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    words = np.array(np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,)))
    m = len(data) - gram + 1
    h = np.zeros(m, np.uint64)
    for i in range(gram // 8):
        x = words[8 * i : 8 * i + m] * _MIX[i % 3]
        x ^= x >> np.uint64(29)
        h *= _MIX[3]
        h += x
    h ^= h >> np.uint64(32)
    h *= _MIX[1]
    h ^= h >> np.uint64(29)
    edge = np.zeros(width - 1, np.uint64)
    least = np.concatenate([edge, _slide(np.minimum, h, width), edge])
    pos = np.flatnonzero(_slide(np.maximum, least, width) == h)
    text = np.searchsorted(at, pos, "right") - 1
    ok = (pos + gram <= at[text + 1]) & (np.diff(at)[text] >= length)
    pos, text = pos[ok], text[ok]
    return text, pos - at[text], h[pos]


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that what sorted or small numbers have in common compresses."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(b: bytes, kind) -> np.ndarray:
    k = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(k, len(b) // k).T).view(kind)[:, 0]


class Packing:
    """Columns of numbers, dealt to buckets: one row for each bucket, a column of bytes for each column."""

    def __init__(self, **kinds):
        self.kinds = {k: np.dtype(v) for k, v in kinds.items()}
        self.schema = "bucket int, " + ", ".join(f"{k} binary" for k in kinds)

    def pack(self, bucket: np.ndarray, order_by: str, **cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(bucket):
            return
        o = np.lexsort((cols[order_by], bucket))
        bucket = bucket[o]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        out: list[list] = [[] for _ in self.kinds]
        for a, b in zip(cut[:-1], cut[1:]):
            for x, (k, kind) in zip(out, self.kinds.items()):
                x.append(_planes(np.ascontiguousarray(cols[k][o[a:b]], kind)))
        yield pa.record_batch([pa.array(bucket[cut[:-1]].astype(np.int32)), *(pa.array(x, pa.binary()) for x in out)], ["bucket", *self.kinds])

    def unpack(self, batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        got: dict[str, list[np.ndarray]] = {k: [] for k in self.kinds}
        for batch in batches:
            for k, kind in self.kinds.items():
                got[k] += [_numbers(b, kind) for b in batch.column(batch.schema.get_field_index(k)).to_pylist()]
        return {k: np.concatenate(v) if v else np.zeros(0, self.kinds[k]) for k, v in got.items()}


def _side(n: int) -> np.dtype:
    return np.dtype(f"V{n}")


_ANCHOR = Packing(hash=np.uint64, owner=np.int64, twin=np.int32, pos=np.uint32)
_RANGE = Packing(owner=np.int64, twin=np.int32, start=np.uint32, end=np.uint32)
_AROUND = Packing(hash=np.uint64, check=np.uint32, owner=np.int64, twin=np.int32, pos=np.uint32, left=np.uint8, right=np.uint8, around=_side(2 * (LENGTH - GRAM)))


def _dealt(owner: np.ndarray, buckets: int) -> np.ndarray:
    return ((owner.astype(np.uint64) * _MIX[0] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def find_anchors(units: DataFrame, buckets: int) -> DataFrame:
    """Packed anchors of ``units`` (owner, twin, text), dealt by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, at = text_bytes(part.column(2))
            text, pos, h = anchors(data, at)
            owner, twin = part.column(0).to_numpy()[text], part.column(1).to_numpy()[text]
            yield from _ANCHOR.pack((h >> np.uint64(40)).astype(np.int64) % buckets, "hash", hash=h, owner=owner, twin=twin, pos=pos)

    return units.select("owner", "twin", "text").mapInArrow(run, _ANCHOR.schema)


def shared_anchors(packed: DataFrame, buckets: int) -> DataFrame:
    """Packed anchors whose hash two units have, dealt by owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _ANCHOR.unpack(batches)
        h = c["hash"]
        if not len(h):
            return
        o = np.argsort(h, kind="stable")
        h, owner = h[o], c["owner"][o]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        many = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
        o = o[np.repeat(many, np.diff(np.append(first, len(h))))]
        for i in range(0, len(o), 1 << 20):
            x = {k: v[o[i : i + (1 << 20)]] for k, v in c.items()}
            yield from _ANCHOR.pack(_dealt(x["owner"], buckets), "owner", **x)

    return packed.repartitionById(buckets, "bucket").mapInArrow(run, _ANCHOR.schema)


def by_unit(packed: DataFrame, packing: Packing, buckets: int) -> DataFrame:
    """One row (owner, twin, a column of bytes for each other column) for each unit in ``packed``, sorted by its third column."""
    names = [k for k in packing.kinds if k not in ("owner", "twin")]
    order = names[-1] if "pos" in names else names[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = packing.unpack(batches)
        if not len(c["owner"]):
            return
        o = np.lexsort((c[order], c["twin"], c["owner"]))
        c = {k: v[o] for k, v in c.items()}
        new = (c["owner"][1:] != c["owner"][:-1]) | (c["twin"][1:] != c["twin"][:-1])
        cut = np.flatnonzero(np.concatenate([[True], new, [True]]))
        for i in range(0, len(cut) - 1, 2000):
            ends = cut[i : i + 2001]
            cols = [pa.array([c[k][a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()) for k in names]
            yield pa.record_batch([pa.array(c["owner"][ends[:-1]]), pa.array(c["twin"][ends[:-1]]), *cols], ["owner", "twin", *names])

    return packed.repartitionById(buckets, "bucket").mapInArrow(run, "owner long, twin int, " + ", ".join(f"{k} binary" for k in names))


def surroundings(units: DataFrame, buckets: int) -> DataFrame:
    """What stands around the shared anchors of ``units`` (owner, twin, text, hash, pos), packed, dealt by hash."""
    side = LENGTH - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            owner, twin, _, hashes, places = (part.column(i) for i in range(5))
            raw, at = text_bytes(part.column(2))
            pos = [np.frombuffer(b, np.uint32) for b in places.to_pylist()]
            n = np.array([len(p) for p in pos])
            pos, h = np.concatenate(pos).astype(np.int64), np.concatenate([np.frombuffer(b, np.uint64) for b in hashes.to_pylist()])
            size = np.repeat(np.diff(at), n)
            left, right = np.minimum(pos, side), np.minimum(size - pos - GRAM, side)
            padded = np.concatenate([np.zeros(side, np.uint8), raw, np.zeros(side + GRAM, np.uint8)])
            here = pos + np.repeat(at[:-1], n) + side
            steps = np.arange(side)
            before, after = padded[(here - side)[:, None] + steps], padded[(here + GRAM)[:, None] + steps]
            before[steps[None, :] < (side - left)[:, None]] = 0
            after[steps[None, :] >= right[:, None]] = 0
            around = np.ascontiguousarray(np.hstack([before, after])).view(_side(2 * side))[:, 0]
            data = padded.tobytes()
            check = np.fromiter((zlib.crc32(data[x : x + GRAM]) for x in here.tolist()), np.uint32, len(here))
            yield from _AROUND.pack(
                (h >> np.uint64(40)).astype(np.int64) % buckets, "hash", hash=h, check=check, owner=np.repeat(owner.to_numpy(), n), twin=np.repeat(twin.to_numpy(), n), pos=pos, left=left, right=right, around=around
            )

    return units.select("owner", "twin", "text", "hash", "pos").mapInArrow(run, _AROUND.schema)


def least_owners(around: np.ndarray, left: np.ndarray, right: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For one anchor's different surroundings: the smallest owner of each window, by its bytes before the anchor.

    A window takes x bytes before the anchor and the rest behind it; impossible windows have the greatest number.
    """
    side = around.shape[1] // 2
    out = np.full((len(around), side + 1), _LAST)
    s = np.ones((len(around), 2 * side + 2), np.uint8)
    s[:, :side] = around[:, :side] + 2
    s[:, side] = 255
    s[:, side + 1 : -1] = around[:, side:] + 2
    width = 2 * side + 2
    text = s.tobytes() + b"\0"
    lead = (left.tolist(), right.tolist())
    run: list[tuple[int, int]] = []
    before = b""

    def settle() -> None:
        low = min(int(owner[c]) for c, _ in run)
        for c, x in run:
            out[c, x] = low

    for i in suffix_array(text):
        c, at = divmod(i, width)
        x = side - at
        if x < 0 or c == len(around) or x > lead[0][c] or side - x > lead[1][c]:
            continue
        w = text[i : i + side + 1]
        if w != before and run:
            settle()
            run = []
        before = w
        run.append((c, x))
    if run:
        settle()
    return out


def _often(*keys: np.ndarray) -> np.ndarray:
    """Whether another row has the same keys."""
    o = np.lexsort(keys)
    same = np.ones(len(o) - 1, bool)
    for k in keys:
        same &= k[o][1:] == k[o][:-1]
    out = np.zeros(len(o), bool)
    out[o[1:]] |= same
    out[o[:-1]] |= same
    return out


def _folded(block: np.ndarray) -> np.ndarray:
    h = np.zeros(len(block), np.uint64)
    for j in range(block.shape[1]):
        h = (h ^ block[:, j]) * _MIX[0]
        h ^= h >> np.uint64(31)
    return h


def removals(packed: DataFrame, buckets: int) -> DataFrame:
    """Packed ranges of bytes to remove, dealt by owner."""
    side = LENGTH - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _AROUND.unpack(batches)
        if not len(c["hash"]):
            return
        around = np.ascontiguousarray(c["around"]).view(np.uint8).reshape(-1, 2 * side)
        key = _folded(np.hstack([around, c["left"][:, None], c["right"][:, None]]))
        o = np.lexsort((c["owner"], key, c["check"], c["hash"]))
        c, around, key = {k: v[o] for k, v in c.items() if k != "around"}, around[o], key[o]
        new_anchor = np.concatenate([[True], (c["hash"][1:] != c["hash"][:-1]) | (c["check"][1:] != c["check"][:-1])])
        differs = (around[1:] != around[:-1]).any(1) | (c["left"][1:] != c["left"][:-1]) | (c["right"][1:] != c["right"][:-1])
        new = new_anchor | np.concatenate([[True], differs])
        first = np.flatnonzero(new)  # of each different surrounding; its first row has the smallest owner
        kind = np.cumsum(new) - 1
        anchor = (np.cumsum(new_anchor) - 1)[first]
        left, right, owner = c["left"][first].astype(np.int64), c["right"][first].astype(np.int64), c["owner"][first]
        x = np.arange(side + 1)
        possible = (x[None, :] <= left[:, None]) & (side - x[None, :] <= right[:, None])
        least = np.where(possible, owner[:, None], _LAST)
        if len(first) > 1:
            half = side // 2
            a = anchor.astype(np.uint64)
            partner = _often(_folded(around[first, side - half : side]), a) | _often(_folded(around[first, side : side + half]), a)
            rows = np.flatnonzero(partner)
            cut = np.flatnonzero(np.concatenate([[True], anchor[rows][1:] != anchor[rows][:-1], [True]])) if len(rows) else np.zeros(1, np.int64)
            for i, j in zip(cut[:-1], cut[1:]):
                own = rows[i:j]
                least[own] = least_owners(around[first[own]], left[own], right[own], owner[own])
        gone = least[kind] < c["owner"][:, None]
        # windows that go start at pos - x; runs of x are runs of starts
        edge = np.zeros((len(gone), 1), bool)
        turn = np.diff(np.hstack([edge, gone, edge]).astype(np.int8), axis=1)
        row, low = np.nonzero(turn == 1)
        high = np.nonzero(turn == -1)[1] - 1
        pos = c["pos"][row].astype(np.int64)
        for i in range(0, len(row), 1 << 20):
            k = slice(i, i + (1 << 20))
            own = c["owner"][row[k]]
            yield from _RANGE.pack(_dealt(own, buckets), "owner", owner=own, twin=c["twin"][row[k]], start=(pos - high)[k], end=(pos - low + LENGTH)[k])

    return packed.repartitionById(buckets, "bucket").mapInArrow(run, _RANGE.schema)


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The union of ranges, sorted by start."""
    if not len(start):
        return []
    reach = np.maximum.accumulate(end.astype(np.int64))
    cut = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return list(zip(start[cut].tolist(), reach[np.append(cut[1:], len(reach)) - 1].tolist()))


def dedup(docs: DataFrame, bucket_bytes: int = 16 << 20) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): n_bytes, spans that go (start, end), and the kept bytes.

    Anchors are dealt to buckets, one to a task, each with the anchors of about ``bucket_bytes`` of different texts.
    """
    spark = docs.sparkSession
    rows = only(docs, doc_id="long", text="string")
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    slim = written(rows.where(F.octet_length("text") >= LENGTH).select("id", "digest", F.octet_length("text").cast("long").alias("size")), "digests")
    owners = slim.groupBy("digest").agg(F.min("id").alias("owner"), F.max("size").alias("size"))
    owners = written(owners.withColumn("twin", F.row_number().over(Window.partitionBy("owner").orderBy("digest")) - 1), "owners")
    different = owners.agg(F.sum("size").alias("n")).collect()[0].n or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-different // bucket_bytes))
    owners = owners.drop("size")
    units = rows.join(owners.withColumnRenamed("owner", "id").withColumn("owner", F.col("id")), ["id", "digest"])
    shared = written(shared_anchors(find_anchors(units, buckets), buckets), "anchors")
    let_go(spark)

    keyed = by_unit(shared, _ANCHOR, buckets).join(owners, ["owner", "twin"]).withColumnRenamed("owner", "id")
    around = rows.join(keyed, ["id", "digest"]).withColumn("owner", F.col("id"))
    ranges = written(removals(surroundings(around, buckets), buckets), "ranges")
    let_go(spark)

    parts = by_unit(ranges, _RANGE, buckets).join(owners, ["owner", "twin"]).select(F.col("owner").alias("id"), "digest", "start", "end", F.lit(False).alias("whole"))
    copies = slim.select("id", "digest").distinct().join(owners.select("digest", "owner"), "digest").where("id > owner").select("id", "digest")
    none = F.lit(None).cast("binary")
    parts = parts.unionByName(copies.select("id", "digest", none.alias("start"), none.alias("end"), F.lit(True).alias("whole")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            raw, at = text_bytes(part.column(1))
            data, spans, kept = raw.tobytes(), [], []
            for a, b, whole, s, e in zip(at[:-1].tolist(), at[1:].tolist(), *(part.column(i).to_pylist() for i in (2, 3, 4))):
                gone = [(0, b - a)] if whole else merged(np.frombuffer(s or b"", np.uint32), np.frombuffer(e or b"", np.uint32))
                edges = [0, *(x for span in gone for x in span), b - a]
                kept.append(b"".join(data[a + x : a + y] for x, y in zip(edges[::2], edges[1::2])))
                spans.append([{"start": x, "end": y} for x, y in gone])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([part.column(0), pa.array(np.diff(at)), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = rows.join(parts, ["id", "digest"], "left").select("doc_id", "text", "whole", "start", "end")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def digests(found: DataFrame) -> DataFrame:
    """The registered query's columns from ``dedup``."""
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
