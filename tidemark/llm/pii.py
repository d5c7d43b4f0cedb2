"""PII spans with DataFrame functions only: candidate gradient boosting.

Generators with high recall propose spans, which may overlap: emails, dotted quads, digit chains,
phone-like runs, bare digit runs and long opaque strings. Those of the first four that pass their
validator are the base and always stay. Boosted trees over format and context features score all
candidates; a bare digit run or opaque string is added if its score reaches its generator's
threshold; so is a failing candidate of a base generator, as a ``number``.

There are no labelled spans, so learning is weakly supervised: a naming word before a candidate ("card", "phone",
"token") labels it, and is no feature. Features are its format: the generator, length, whether it is assigned, what
characters it has, and the validator's outcome (parts, digit count, Luhn sum). Candidates are counted by cells of
their discrete features in Spark; the cells, whose number the grid bounds, are all that the driver sees. Trees are
fitted on the cells of four folds and become column expressions; the thresholds are the least scores that reach
``precision`` on the cells of fold 0. A generator that never reaches it adds nothing.

At scale: one pass over the texts, no shuffle but of cell counts. A digit of any script but ASCII is
none. Positions are code points, ends are exclusive.

Cases: null text is empty and has no spans; equal spans of one kind are one; repeated rows are judged
each; no candidates, no additions; an empty table gives no rows; texts of any length are searched
whole, by patterns that never backtrack over long runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import bound, fold_of, only, pieces, place_of, running
from tidemark.sources.shared import written

KINDS = ("email", "ip", "card", "phone", "number", "secret")
BASE = 4
#: The contract's patterns, with possessive repeats where no match needs to give back, and starts only where a run starts or a match ended.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![0-9])[0-9]{12,19}(?![0-9])",
    r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+",
)
#: A text without a match of these has no candidate of that kind.
HINTS = (r"@", r"[0-9]\.[0-9]", r"(?:[0-9][\x20-]?+){7}", r"\+[0-9]", r"[0-9]{12}", r"[A-Za-z0-9_/+=-]{20}")
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CONTEXT = 32
SECRET_WORDS = r"(?i)(?:token|key|secret|passw|pwd|auth|bearer|credential)[A-Za-z_]{0,8}\W{0,6}$"
PERSON_WORDS = r"(?i)(?:card|visa|account|iban|acct|tel|phone|mobile|fax|mail|ssn)\w{0,8}\W{0,6}$"
FEATURES = ("kind", "size", "assigned", "mixed", "hex", "passes")

_SPAN = "struct<start:bigint,end:bigint,value:string,before:string>"


def located(text: Column, pattern: str, hint: str) -> Column:
    """The leftmost non-overlapping matches, with what stands before each, as an array of structs."""
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    pairs = F.filter(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, h: F.struct(p.alias("p"), h.alias("h"))), lambda x: x["h"].isNotNull())

    def span(x: Column, at: Column) -> Column:
        start = at + F.char_length(x["p"])
        before = F.substring(x["p"], F.greatest(F.char_length(x["p"]) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT))
        return F.struct(start.alias("start"), (start + F.char_length(x["h"])).alias("end"), x["h"].alias("value"), before.alias("before"))

    def placed(ps: Column) -> Column:
        return F.zip_with(ps, running(F.transform(ps, lambda x: (F.char_length(x["p"]) + F.char_length(x["h"])).cast("long"))), span)

    return F.when(text.rlike(hint), bound(pairs, placed)).otherwise(none)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum ends in 0; false without digits."""
    n = F.char_length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.when(n > 0, F.pmod(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add), F.lit(10)) == 0).otherwise(False)


def _judged(spans: Column, k: int) -> Column:
    """Candidates of generator ``k``: position, validator's outcome, features; digit chains under 7 digits are none."""

    def one(s: Column) -> Column:
        value, before, digits = s["value"], s["before"], digits_of(s["value"])
        n = F.char_length(digits)
        valid = {
            "email": F.lit(True),
            "ip": value.rlike(f"^{PART}\\.{PART}\\.{PART}\\.{PART}$"),
            "card": n.between(16, 19) & luhn(digits),
            "phone": n.between(8, 15),
            "number": luhn(digits),
            "secret": F.lit(False),
        }[KINDS[k]]
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            valid.alias("valid"),
            F.lit(k).alias("kind"),
            before.rlike(SECRET_WORDS if KINDS[k] == "secret" else PERSON_WORDS).alias("named"),
            F.least(F.char_length(value), F.lit(64)).alias("size"),
            before.rlike("[=:]\\s*[\"']?$").cast("int").alias("assigned"),
            (value.rlike("[0-9]") & value.rlike("[A-Za-z]")).cast("int").alias("mixed"),
            value.rlike("^[0-9a-fA-F]+$").cast("int").alias("hex"),
            valid.cast("int").alias("passes"),
        )

    out = F.transform(spans, one)
    return F.filter(out, lambda s: s["end"] - s["start"] >= 7) if KINDS[k] == "card" else out


def spans_of(text: Column) -> Column:
    """All generators' candidates in ``text``, by kind and start."""
    return F.concat(*(_judged(located(text, p, h), k) for k, (p, h) in enumerate(zip(PATTERNS, HINTS))))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of ``docs`` (doc_id, text)."""
    return only(docs, doc_id="long", text="string").select("doc_id", spans_of(F.coalesce("text", F.lit(""))).alias("spans"))


Tree = tuple


def boost(cells: list[tuple[tuple[int, ...], float, float]], rounds: int = 20, rate: float = 0.3) -> tuple[float, list[Tree]]:
    """Trees of depth two on ``cells`` (features, positives, negatives) by Newton steps on the log loss.

    A tree is (feature, value, below-or-equal branch, above branch); a branch is a tree or a number.
    """
    total = [sum(c[i] for c in cells) for i in (1, 2)]
    base = math.log((total[0] + 1) / (total[1] + 1))
    score, trees = [base] * len(cells), []

    def sums(own: list[int]) -> tuple[float, float]:
        g = h = 0.0
        for i in own:
            p = 1 / (1 + math.exp(-score[i]))
            n = cells[i][1] + cells[i][2]
            g += cells[i][1] - n * p
            h += n * p * (1 - p)
        return g, h

    def gain(own: list[int]) -> float:
        g, h = sums(own)
        return g * g / (h + 1)

    def grow(own: list[int], depth: int) -> Tree | float:
        best, at = 1e-6, None
        if depth:
            for f in range(len(cells[0][0])):
                for v in sorted({cells[i][0][f] for i in own})[:-1]:
                    low, high = [i for i in own if cells[i][0][f] <= v], [i for i in own if cells[i][0][f] > v]
                    if (won := gain(low) + gain(high) - gain(own)) > best:
                        best, at = won, (f, v, low, high)
        if at is None:
            g, h = sums(own)
            return round(rate * g / (h + 1), 9)
        f, v, low, high = at
        return f, v, grow(low, depth - 1), grow(high, depth - 1)

    for _ in range(rounds if cells else 0):
        trees.append(tree := grow(list(range(len(cells))), 2))
        score = [s + value(tree, c[0]) for s, c in zip(score, cells)]
    return base, trees


def value(tree: Tree | float, x: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def expression(tree: Tree | float) -> str:
    """SQL for the tree's value at the span ``s``."""
    if not isinstance(tree, tuple):
        return f"{float(tree)!r}D"
    return f"CASE WHEN s.{FEATURES[tree[0]]} <= {tree[1]} THEN {expression(tree[2])} ELSE {expression(tree[3])} END"


def learn(found: DataFrame, precision: float = 0.8, rounds: int = 20) -> tuple[float, list[Tree], dict[int, float]]:
    """Base score, trees, and the least score of each generator that reaches ``precision`` on fold 0, which the trees haven't seen."""
    spans = found.select((fold_of(F.col("doc_id")) == 0).alias("held"), F.inline("spans"))
    counted = spans.groupBy("held", *FEATURES).agg(F.sum(F.col("named").cast("long")).alias("pos"), F.count("*").alias("n")).collect()
    cells = sorted((r.held, tuple(r[f] for f in FEATURES), r.pos, r.n - r.pos) for r in counted)
    base, trees = boost([c[1:] for c in cells if not c[0]], rounds)
    return base, trees, thresholds(base, trees, [c[1:] for c in cells if c[0]], precision)


def thresholds(base: float, trees: list[Tree], cells: list[tuple[tuple[int, ...], float, float]], precision: float) -> dict[int, float]:
    """For each generator the least score from which on the share of positives is ``precision``; cells of equal score go together."""
    least: dict[int, float] = {}
    for k in range(len(KINDS)):
        by: dict[float, list[float]] = {}
        for x, pos, neg in cells:
            if x[0] == k:
                at = by.setdefault(round(base + sum(value(t, x) for t in trees), 6), [0, 0])
                at[0] += pos
                at[1] += neg
        hit = miss = 0
        for s in sorted(by, reverse=True):
            hit, miss = hit + by[s][0], miss + by[s][1]
            if hit and hit >= precision * (hit + miss):
                least[k] = round(s - 1e-5, 9)
    return least


def find(docs: DataFrame, precision: float = 0.8) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): spans, an array of (kind, start, end, base), by kind and start."""
    found = written(candidates(docs), "candidates")
    return found.select("doc_id", chosen_spans(*learn(found, precision)).alias("spans"))


def chosen_spans(base: float, trees: list[Tree], least: dict[int, float]) -> Column:
    """Of the column ``spans`` of candidates, those that are base or reach their generator's threshold."""

    score = " + ".join([f"{float(base)!r}D", *(f"({expression(t)})" for t in trees)])
    added = "CASE s.kind " + " ".join(f"WHEN {k} THEN {score} >= {at!r}D" for k, at in least.items()) + " END" if least else "false"
    of = f"s.kind < {BASE} AND s.valid"
    names = f"array({', '.join(map(repr, KINDS))})"
    kind = f"CASE WHEN s.kind < {BASE} AND NOT s.valid THEN {BASE + 1} ELSE s.kind + 1 END"
    picked = f"transform(filter(spans, s -> ({of}) OR coalesce({added}, false)), s -> struct({kind} AS n, s.start AS start, s.end AS end, ({of}) AS base))"
    # by kind and start; added spans that two generators propose alike are one
    once = f"get(transform(array(sort_array({picked})), a -> filter(a, (s, i) -> i = 0 OR s <> a[i - 1])), 0)"
    return F.expr(f"transform({once}, s -> struct(get({names}, s.n - 1) AS kind, s.start AS start, s.end AS end, s.base AS base))")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with the union of ``spans`` replaced, each stretch by the kind of its first span in brackets."""
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def opened(ss: Column) -> Column:
        """Where a new stretch begins: the kept text before it, as (start, length), and its kind."""
        reach = running(F.transform(ss, lambda s: s["end"]), F.greatest)
        return F.filter(
            F.zip_with(ss, reach, lambda s, r: F.struct(r.alias("start"), (s["start"] - r).alias("length"), s["kind"].alias("kind"))), lambda x: x["length"] >= 0
        )

    def written_out(x: Column) -> Column:
        kept = F.zip_with(pieces(text, x["gaps"]), x["gaps"], lambda t, g: F.concat(t, F.lit("["), F.upper(g["kind"]), F.lit("]")))
        return F.concat(F.array_join(kept, ""), F.substring(text, (x["last"] + 1).cast("int"), F.char_length(text)))

    last = lambda ss: F.array_max(F.transform(ss, lambda s: s["end"]))
    done = bound(order, lambda ss: bound(F.struct(opened(ss).alias("gaps"), last(ss).alias("last")), written_out))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """The registered query's columns from ``find``."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.array_remove(F.transform(F.filter("spans", lambda s: s["base"]), lambda s: s["kind"] != kind), F.lit(True))).cast("long").alias(f"n_{kind}") for kind in KINDS[:BASE]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, precision: float = 0.8) -> DataFrame:
    """``docs`` (doc_id, text, and any other columns) with the selected spans of their texts replaced; ``n_chars`` follows if there.

    The texts are searched twice, once to learn from all candidates and once to replace, so no text is shuffled.
    """
    base, trees, least = learn(written(candidates(docs), "candidates"), precision)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = f"c{place_of(docs, 'text')}"
    found = plain.withColumn("spans", spans_of(F.coalesce(F.col(text), F.lit(""))))
    found = found.withColumn("spans", chosen_spans(base, trees, least))
    out = found.withColumn(text, redacted(F.col(text), F.col("spans")))
    if "n_chars" in (c.lower() for c in docs.columns):
        n = f"c{place_of(docs, 'n_chars')}"
        out = out.withColumn(n, F.when(F.size("spans") > 0, F.char_length(text)).otherwise(F.col(n)).cast(plain.schema[n].dataType))
    return out.drop("spans").toDF(*docs.columns)
