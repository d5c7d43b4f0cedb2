"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Separators of words in the contracts: [\x20\x09-\x0D].
WORD = r"[^\x20\x09-\x0D]+"


def place_of(df: DataFrame, name: str) -> int:
    """Which column of ``df`` has this name exactly, else without regard to case; of several the first."""
    at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not at:
        raise ValueError(f"no column {name} in {df.columns}")
    return at[0]


def only(df: DataFrame, **kinds: str) -> DataFrame:
    """``df`` narrowed to these columns, cast. Other columns go, whatever their names, so none can clash.

    A name is matched exactly, else without regard to case; of several the first is taken.
    """
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    picked: list[Column] = []
    for name, kind in kinds.items():
        picked.append(F.col(f"c{place_of(df, name)}").cast(kind).alias(name))
    return plain.select(*picked)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets, without a copy; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a piece hold ``limit`` bytes at most, unless it is one text."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        n = np.diff(text_bytes(col)[1])
        start, held = 0, 0
        for i, k in enumerate(n):
            if held and held + k > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(k)
        if start < len(n):
            yield batch.slice(start)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int, size: int = 32 << 20) -> Iterator[pa.Table]:
    """The rows of ``batches``, sorted by integer ``keys``, in tables that never part rows with equal keys.

    A table has about ``rows`` rows or ``size`` bytes, whichever is less, or one larger group.
    """

    def cut(t: pa.Table) -> int:
        """Where the last group begins."""
        new = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            new |= x[1:] != x[:-1]
        at = np.flatnonzero(new)
        return int(at[-1]) + 1 if len(at) else 0

    held: list[pa.RecordBatch] = []
    n, held_size, wait, wait_size = 0, 0, rows, size
    for whole in batches:
        step = max(1, whole.num_rows * size // max(whole.nbytes, 1))
        for i in range(0, whole.num_rows, step):
            batch = whole.slice(i, step)
            held.append(batch)
            n, held_size = n + batch.num_rows, held_size + batch.nbytes
            if n >= wait or held_size >= wait_size:
                t = pa.Table.from_batches(held)
                if at := cut(t):
                    yield t.slice(0, at)
                    held, n = t.slice(at).to_batches(), n - at
                    held_size = sum(b.nbytes for b in held)
                # a group that is larger than a table is looked through again only when it has doubled
                wait, wait_size = max(rows, 2 * n), max(size, 2 * held_size)
    if n:
        yield pa.Table.from_batches(held)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)).cast("int")


def kept_rows(docs: DataFrame, text: str, wanted, size: int = 4 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, for which ``wanted(list of texts as bytes)`` is true; no shuffle.

    ``wanted`` is made on the executor by calling the given function without arguments.
    """
    at = place_of(docs, text)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = wanted()
        for part in slices(batches, f"c{at}", size):
            raw, cut = text_bytes(part.column(at))
            data = raw.tobytes()
            keep = judge([data[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())])
            yield part.filter(pa.array(np.asarray(keep, bool)))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def bound(x: Column, f) -> Column:
    """``f`` of ``x``, which is evaluated once however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running(xs: Column, add=lambda a, b: a + b, chunk: int = 256) -> Column:
    """For an array of longs: what ``add`` makes of all elements before each, from 0 on.

    Appending in an aggregate copies the array each time. So chunks are run through on their own, and then the
    chunks' totals: that copies about ``chunk`` / 2 numbers for each element, and few for each chunk.
    """
    kind = "struct<at:bigint,out:array<bigint>>"
    zero = F.expr(f"cast(named_struct('at', 0L, 'out', array()) as {kind})")

    def step(acc: Column, x: Column) -> Column:
        return F.struct(add(acc["at"], x).cast("long").alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")).cast(kind)

    def whole(all_: Column) -> Column:
        begins = F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(chunk))
        parts = F.transform(begins, lambda i: F.aggregate(F.slice(all_, i, F.lit(chunk)), zero, step))
        return bound(parts, lambda ps: F.flatten(F.zip_with(ps, F.aggregate(ps, zero, lambda acc, p: step(acc, p["at"]))["out"], lambda p, off: F.transform(p["out"], lambda x: add(x, off).cast("long")))))

    return bound(xs, whole)


def pieces(text: Column, spans: Column, chunk: int = 128) -> Column:
    """The parts of ``text`` at ``spans``, an ascending array of (start, length) in code points.

    A substring is counted off from the start of its text, so each ``chunk`` of spans first gets its own stretch of it.
    """

    def stretch(t: Column, part: Column) -> Column:
        low, last = part[0]["start"], F.element_at(part, -1)
        own = F.substring(t, (low + 1).cast("int"), (last["start"] + last["length"] - low).cast("int"))
        cut = bound(own, lambda o: F.transform(part, lambda s: F.substring(o, (s["start"] - low + 1).cast("int"), s["length"].cast("int"))))
        return F.when(F.size(part) > 0, cut).otherwise(F.array().cast("array<string>"))

    def whole(x: Column) -> Column:
        begins = F.sequence(F.lit(1), F.greatest(F.size(x["spans"]), F.lit(1)), F.lit(chunk))
        return F.flatten(F.transform(begins, lambda i: bound(F.slice(x["spans"], i, F.lit(chunk)), lambda part: stretch(x["text"], part))))

    return bound(F.struct(text.alias("text"), spans.alias("spans")), whole)
