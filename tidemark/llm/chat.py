"""Chat formatting with Spark expressions only: collected turn structs are sorted, adjacent turns of
one role merged by array aggregation, and concatenated.

Template: ``<s>`` then for each merged turn ``[INST]role[/INST]text</s>``; further texts of a merged turn
follow, each after another ``[/INST]``. Escapes: the mark U+241B is doubled in a text, and put after the first
character of each control string in it, so no control string is left; reading a mark drops it and
keeps what follows.

Loss mask: the texts of assistant turns, as spans of code points of the formatted string.

Cases: null text or role is empty; null turns come first; rows with the same turn are ordered by
role, then text; repeated rows are turns of their own; a null conv_id is a conversation; an empty
table gives no rows. One conversation is one output row, so it has to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import bound, only, pieces, running

MARK = "␛"
BEGIN, TURN, PART, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (BEGIN, TURN, PART, END)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(MARK), F.lit(MARK * 2))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + MARK + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"(?s){MARK}(.)", "$1")


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``turns`` (conv_id, turn, role, text) to one row for each conversation: conv_id, formatted, loss_spans.

    ``loss_spans``: array of (start, length) in code points, one for each text of ``trained_role``.
    """
    rows = only(turns, conv_id="long", turn="long", role="string", text="string")
    rows = rows.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text")).alias("t")
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    merged = merge_turns(sorted_turns)
    heads = F.transform("merged", lambda m: F.concat(F.lit(TURN), escape(m["role"]), F.lit(PART)))
    shaped = merged.select("conv_id", "merged", heads.alias("heads"))
    text = F.concat(F.lit(BEGIN), F.array_join(F.zip_with("merged", "heads", lambda m, h: F.concat(h, F.array_join(m["texts"], PART), F.lit(END))), ""))

    def length(m: Column, h: Column) -> Column:
        return F.char_length(h).cast("long") + m["chars"] + len(PART) * (F.size(m["texts"]) - 1) + len(END)

    def spans(m: Column, at: Column) -> Column:
        """The texts of merged turn ``m``, the first of which begins at ``at``."""
        sizes = F.transform(m["texts"], lambda x: F.char_length(x).cast("long"))
        offsets = running(F.transform(sizes, lambda n: n + len(PART)))
        return F.zip_with(sizes, offsets, lambda n, off: F.struct((at + off).cast("long").alias("start"), n.alias("length")))

    begins = F.zip_with(running(F.zip_with("merged", "heads", length)), "heads", lambda at, h: at + len(BEGIN) + F.char_length(h))
    trained = F.filter(F.zip_with("merged", begins, lambda m, at: F.struct(m.alias("m"), at.alias("at"))), lambda x: x["m"]["role"] == trained_role)
    return shaped.select("conv_id", text.alias("formatted"), F.flatten(F.transform(trained, lambda x: spans(x["m"], x["at"]))).alias("loss_spans"))


def merge_turns(sorted_turns: DataFrame) -> DataFrame:
    """(conv_id, ts: array of role, text) to (conv_id, merged): an array of role, texts and chars, one for each stretch of turns of one role.

    A stretch begins where the role changes; its turns are cut out of the array and aggregated.
    """
    differs = lambda i: (i == 1) | (F.get("ts", i - 1)["role"] != F.get("ts", i - 2)["role"])
    begins = sorted_turns.select("conv_id", "ts", F.filter(F.sequence(F.lit(1), F.size("ts")), differs).alias("begins"))

    def stretch(i: Column, j: Column) -> Column:
        return F.slice("ts", i, F.coalesce(F.get("begins", j + 1), F.size("ts") + 1) - i)

    runs = begins.select("conv_id", F.transform("begins", stretch).alias("runs"))
    chars = lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda n, t: n + F.char_length(t["text"]))
    one = F.transform("runs", lambda r: F.struct(F.get(r, F.lit(0))["role"].alias("role"), F.transform(r, lambda t: t["text"]).alias("texts"), chars(r).alias("chars")))
    return runs.select("conv_id", one.alias("merged"))


def read_chats(chats: DataFrame) -> DataFrame:
    """What ``format_chats`` wrote, read back: conv_id, turns (array of role, text), loss_texts, formatted."""
    body = F.substring("formatted", F.lit(len(BEGIN) + 1), F.char_length("formatted"))
    merged = F.filter(F.split(body, F.lit(r"\Q" + END + r"\E"), -1), lambda x: x != "")

    def texts(m: Column) -> Column:
        parts = F.split(F.substring(m, F.lit(len(TURN) + 1), F.char_length(m)), F.lit(r"\Q" + PART + r"\E"), -1)
        return bound(parts, lambda ps: bound(unescape(ps[0]), lambda role: F.transform(F.slice(ps, F.lit(2), F.size(ps) - 1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))))

    loss = F.transform(pieces(F.col("formatted"), F.col("loss_spans")), unescape)
    return chats.select("conv_id", F.flatten(F.transform(merged, texts)).alias("turns"), loss.alias("loss_texts"), "formatted")


def digests(chats: DataFrame) -> DataFrame:
    """The registered query's columns from ``read_chats``."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_chats(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(F.array_join("loss_texts", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("loss_texts", ""), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
