"""Personal data: base patterns, and spans added by boosted trees over candidates.

Everything that touches texts is DataFrame expressions.  Base matches of each
kind are cut out by a pattern and checked (digit counts, Luhn, parts of an
address); they always stay.  Looser generators then propose candidate spans,
which may overlap: numbers without a plus, addresses spelled with (at) and
(dot), cards with odd separators.  A candidate is described by eight features
of its format and context, some in grades: how near and on which side a telling
word stands, its length, its share of digits.  Trees are boosted on how often
each combination of features (a cell) occurs with and without a base match
inside, over three quarters of the documents by a hash of their text; the
features leave out what makes a base match one, so the trees judge the other
candidates by their likeness.  Candidates in which another kind's base match
lies teach nothing, as they are never judged.  The other quarter calibrates: a
kind's threshold is the lowest score above which the share of candidates with a
base match is ``precision`` at least, by the lower end of its 95 % interval
(one-sided), so few examples open nothing.  Candidates at or above it are added
where no span is yet.

Patterns are possessive and begin where a run begins, so they take linear time
and no stack, whatever the text.  Starts come from summed lengths, and texts
are rewritten from their spans, in blocks.

Defined results: null and empty texts have no spans.  Offsets are code points,
the end exclusive.  A kind without enough base matches in the documents adds
nothing.  In a redacted text overlapping spans become one, named by the first.
Rows are judged one by one, so repeated rows are equal and extra columns never
read.
"""

from __future__ import annotations

from collections.abc import Callable
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubjay.functions.columns import qcol

KINDS = ("email", "ip", "card", "phone")
_CONTEXT = 24
_BLOCK, _TEXT_BLOCK = 64, 1024
#: Grades of a candidate's features, and the number of cells that they make.
_GRADES = (4, 2, 4, 4, 2, 2, 2, 2)
CELLS = math.prod(_GRADES)
_FILL = "\x01"

#: Base patterns: leftmost matches as of the plain pattern in the comment.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_EDGE, _AFTER = r"(?<![0-9A-Za-z\x01+@.-])", r"(?![0-9A-Za-z\x01@])"
_DOT = r"(?:\.|\x20?[\[(](?:\.|dot)[\])]\x20?|\x20dot\x20)"
_AT = r"(?:@|\x20?[\[(](?:@|at)[\])]\x20?|\x20at\x20)"
#: Generators of candidates: looser patterns of the same kinds.
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+\x01-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++{_AFTER}",
    "ip": rf"{_EDGE}[0-9]++(?:{_DOT}[0-9]++){{3}}+{_AFTER}",
    "card": rf"{_EDGE}[0-9](?:[\x20./_-]{{0,2}}+[0-9]){{12,18}}+{_AFTER}",
    "phone": rf"(?<![0-9A-Za-z\x01@.-])[+(]?[0-9][\x20()./0-9-]{{6,24}}[0-9]{_AFTER}",
}
#: What each match of a base or loose pattern holds, so that other texts need not be tried.
_NEED = {"email": r"@|[\[(]at[\])]|\x20at\x20", "ip": r"[0-9]", "card": r"[0-9]", "phone": r"[0-9]"}
#: Words that make a kind likelier when they stand before it.
_NEAR = {"email": r"mail|contact|write|reach", "ip": r"(?<![a-z0-9])ip(?![a-z0-9])|host|addr|server|client", "card": r"card|visa|pay|credit|debit", "phone": r"tel|phone|call|fax|mobil|whatsapp"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 20 digits passes Luhn's check."""

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(F.lpad(digits, 20, "0"), place, F.lit(1)).cast("int")
        return total + F.when(place % 2 == 0, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), add) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    """Whether a match of the kind's base pattern stands."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")
    n = F.length(_digits(hit))
    if kind == "card":
        return n.between(14, 19) & luhn(_digits(hit))
    return n.between(10, 15)


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda s, x: s + x)


def _indexes(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _sums_before(lengths: Column) -> Column:
    """For each item the sum of those before it, by blocks."""
    whole = lambda i: F.floor(i / F.lit(_BLOCK)).cast("int")

    def by_block(a: Column) -> Column:
        blocks = F.transform(_indexes(F.ceil(F.size(a) / F.lit(_BLOCK)).cast("int")), lambda b: _sum(F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK))))
        before = lambda sums: F.transform(_indexes(F.size(sums)), lambda b: _sum(F.slice(sums, F.lit(1), b)))
        return let(let(blocks, before), lambda starts: F.transform(_indexes(F.size(a)), lambda i: F.get(starts, whole(i)) + _sum(F.slice(a, whole(i) * _BLOCK + 1, i % _BLOCK))))

    return let(lengths, by_block)


def _cut(text: Column, pattern: str) -> Column:
    """The matches of a pattern and the gaps around them."""
    return F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))


def _contexts(cut: Column) -> Column:
    """hit, left and right of each match."""
    return F.transform(
        cut["hits"],
        lambda hit, i: F.struct(hit.alias("hit"), F.right(F.get(cut["gaps"], i), F.lit(_CONTEXT)).alias("left"), F.left(F.get(cut["gaps"], i + 1), F.lit(_CONTEXT)).alias("right")),
    )


def _spans(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """start and end of each kept match."""

    def place(cut: Column) -> Column:
        lengths = F.zip_with(F.slice(cut["gaps"], F.lit(1), F.size(cut["hits"])), cut["hits"], lambda gap, hit: F.length(gap) + F.length(hit))
        with_start = let(_sums_before(lengths), lambda before: F.transform(_contexts(cut), lambda x, i: F.struct((F.get(before, i) + F.length(F.get(cut["gaps"], i))).alias("start"), x.alias("x"))))
        kept = F.filter(with_start, lambda s: keep(s["x"]))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["x"]["hit"])).alias("end")))

    return let(_cut(text, pattern), place)


def rewrite(text: Column, spans: Column, by: Callable[[Column, Column, Column], Column]) -> Column:
    """The text with its spans (in their order) replaced.

    ``by`` gives what stands for a piece of a span from the span, the piece's
    length and whether it is the span's beginning and in no earlier span.
    """

    def block(own: Column, i: Column) -> Column:
        at = i * _TEXT_BLOCK
        inside = F.filter(spans, lambda s: (s["end"] > at) & (s["start"] < at + F.length(own)))

        def step(state: Column, s: Column) -> Column:
            start, end = F.greatest(s["start"] - at, F.lit(0)), F.least(s["end"] - at, F.length(own))
            pos = state["pos"]
            first = (s["start"] >= at) & (start >= pos)
            piece = F.concat(state["out"], F.substring(own, pos + 1, F.greatest(start - pos, F.lit(0))), by(s, F.greatest(end - F.greatest(start, pos), F.lit(0)), first))
            return F.struct(F.greatest(end, pos).alias("pos"), piece.alias("out"))

        return F.aggregate(inside, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda x: F.concat(x["out"], F.substr(own, x["pos"] + 1)))

    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_TEXT_BLOCK}}}+"), F.lit(0))
    return F.when(F.size(spans) > 0, F.array_join(F.transform(blocks, block), "")).otherwise(text)


def _blanked(text: Column, spans: Column) -> Column:
    return rewrite(text, spans, lambda s, n, first: F.repeat(F.lit(_FILL), n))


def _grades(kind: str, x: Column) -> list[Column]:
    """A candidate's features, each below its number of grades; none tells a base match from its likes."""
    hit, left, right = x["hit"], F.lower(x["left"]), F.lower(x["right"])
    has = lambda c, p: c.rlike(p)
    yes = lambda test: F.when(test, 1).otherwise(0)
    grade = lambda n, *cuts: sum((yes(n >= c) for c in cuts[1:]), yes(n >= cuts[0]))
    near = rf"(?:{_NEAR[kind]})"
    context = F.when(has(left, rf"{near}\W{{0,3}}\z"), 3).when(has(left, near), 2).when(has(right, near), 1).otherwise(0)
    ends = yes(has(right, r"\A[.,;:!?)\]\x20\n]") | (right == "") | right.isNull())
    n = F.length(_digits(hit))
    share = F.least(F.floor(n * 4 / F.length(hit)).cast("int"), F.lit(3))
    if kind == "email":
        labels = F.regexp_replace(hit, rf"\A[A-Za-z0-9._%+-]++{_AT}", "")
        length = grade(F.length(hit), 12, 24, 40)
        rest = [has(hit, r"[A-Za-z]{2,6}\z"), has(labels, r"[A-Za-z]"), has(hit, r"\A[A-Za-z]"), has(labels, r"[A-Za-z0-9-]{3}")]
    elif kind == "ip":
        length = grade(n, 6, 8, 10)
        rest = [has(hit, rf"\A{_PART}(?:{_DOT}{_PART}){{3}}\z"), ~has(hit, r"(?<![0-9])0[0-9]"), has(hit, r"\A[1-9]"), has(left, r"(?<![a-z0-9])v(?:er(?:sion)?)?\.?\x20?\z")]
    elif kind == "card":
        length = grade(n, 14, 16, 17)
        rest = [let(_digits(hit), luhn), has(hit, r"\A[3-6]"), has(hit, r"[^0-9]"), has(hit, r"\A(?:[0-9]{4}[^0-9]+)+[0-9]{1,4}\z")]
    else:
        length = grade(n, 8, 10, 13)
        rest = [has(hit, r"\([0-9]{2,4}\)"), has(hit, r"[^0-9][0-9]{4}\z"), has(hit, r"[0-9]{3}[\x20.-][0-9]{4}\z"), has(left, r"\s\z") | (left == "")]
    return [context, ends, length, share, *map(yes, rest)]


def _cell(kind: str, x: Column) -> Column:
    """A candidate's grades as one number below CELLS."""
    out = F.lit(0)
    for n, grade in zip(_GRADES, _grades(kind, x), strict=True):
        out = out * n + grade
    return out


def _if_needed(kind: str, text: Column, value: Column, otherwise: Column) -> Column:
    return F.when(text.rlike(_NEED[kind]), value).otherwise(otherwise)


# --- learning ----------------------------------------------------------------


def _tests(codes: np.ndarray) -> np.ndarray:
    """For each cell, whether each feature reaches each of its grades above none."""
    columns, rest = [], codes
    for n in reversed(_GRADES):
        columns += [rest % n >= g for g in range(1, n)]
        rest = rest // n
    return np.stack(columns, 1)


def boost(cells: dict[int, tuple[int, int]], rounds: int = 40, rate: float = 0.3, penalty: float = 1.0) -> np.ndarray:
    """Log odds for all cells from {cell: (positive, negative)}: two-level trees boosted by Newton steps."""
    codes = np.array(sorted(cells), np.int64)
    pos = np.array([cells[c][0] for c in codes], float)
    total = pos + np.array([cells[c][1] for c in codes], float)
    own, every = _tests(codes), _tests(np.arange(CELLS))
    start = math.log((pos.sum() + 1) / (total.sum() - pos.sum() + 1))
    margin, out = np.full(len(codes), start), np.full(CELLS, start)

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> int:
        """The test that divides the rows best."""
        g, h = g * rows, h * rows
        yes_g, yes_h = g @ own, h @ own
        gain = yes_g**2 / (yes_h + penalty) + (g.sum() - yes_g) ** 2 / (h.sum() - yes_h + penalty)
        return int(np.argmax(np.round(gain, 9)))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = pos - total * p, total * p * (1 - p)
        f = split(np.ones(len(codes)), g, h)
        for side in (True, False):
            rows = own[:, f] == side
            f2 = split(rows, g, h)
            for side2 in (True, False):
                leaf = rows & (own[:, f2] == side2)
                step = rate * g[leaf].sum() / (h[leaf].sum() + penalty)
                margin[leaf] += step
                out[(every[:, f] == side) & (every[:, f2] == side2)] += step
    return out


def sure_share(pos: float, n: float, z: float = 1.645) -> float:
    """Lower end of the Wilson interval of a share of ``pos`` in ``n``."""
    if not n:
        return 0.0
    p = pos / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def threshold(cells: dict[int, tuple[int, int]], scores: np.ndarray, precision: float) -> float:
    """Lowest score from which upwards the share of positives among the candidates is surely ``precision``."""
    best, pos, neg = math.inf, 0, 0
    for score in sorted({float(scores[c]) for c in cells}, reverse=True):
        for c in (c for c in cells if scores[c] == score):
            pos, neg = pos + cells[c][0], neg + cells[c][1]
        if sure_share(pos, pos + neg) >= precision:
            best = score
    return best


Model = dict[str, list[bool]]
CLOSED: Model = {kind: [False] * CELLS for kind in KINDS}


def learn(docs: DataFrame, text: str = "text", precision: float = 0.9) -> Model:
    """For each kind, which of the CELLS combinations of features are redacted.

    One pass over all documents counts the cells, with at most four rows a
    kind and cell as its result.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    empty = F.array().cast("array<struct<kind:string,cell:int,base:boolean>>")

    def candidates(kind: str) -> Column:
        def one(x: Column) -> Column:
            others = F.array(*(_holds_base(k, x["hit"]) for k in KINDS if k != kind))
            base = F.when(_holds_base(kind, x["hit"]), F.lit(True)).when(~F.exists(others, lambda o: o), F.lit(False))
            return F.struct(F.lit(kind).alias("kind"), _cell(kind, x).alias("cell"), base.alias("base"))

        return _if_needed(kind, value, let(_cut(value, LOOSE[kind]), lambda cut: F.transform(_contexts(cut), one)), empty)

    held = (F.crc32(F.encode(value, "UTF-8")) % 4 == 0).alias("held")
    rows = docs.select(held, F.explode(F.concat(*map(candidates, KINDS))).alias("c")).select("held", "c.*").where(F.col("base").isNotNull())
    counts = {(kind, held): {} for kind in KINDS for held in (True, False)}
    for r in rows.groupBy("kind", "held", "cell", "base").agg(F.count("*").alias("n")).collect():
        own = counts[r.kind, r.held].setdefault(r.cell, [0, 0])
        own[0 if r.base else 1] += r.n
    model = {}
    for kind in KINDS:
        taught, shown = counts[kind, False], counts[kind, True]
        if not taught or not shown:
            model[kind] = CLOSED[kind]
            continue
        scores = boost(taught)
        least = threshold(shown, scores, precision)
        model[kind] = [bool(s >= least) for s in scores]
    return model


def _holds_base(kind: str, hit: Column) -> Column:
    return F.coalesce(F.exists(F.regexp_extract_all(hit, F.lit(BASE[kind]), F.lit(0)), lambda h: valid(kind, h)), F.lit(False))


# --- spans and redaction -----------------------------------------------------


def _chosen(kind: str, model: Model, x: Column) -> Column:
    marks = "".join("1" if on else "0" for on in model[kind])
    return F.substring(F.lit(marks), _cell(kind, x) + 1, F.lit(1)) == "1"


def _tagged(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


_SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"


def base_spans(text: Column) -> Column:
    """Array of (start, order, end, kind) of all base matches, by start, then kind."""
    value = F.coalesce(text, F.lit(""))
    empty = F.array().cast(_SPANS)
    parts = [_if_needed(k, value, _tagged(k, _spans(value, BASE[k], lambda x, k=k: valid(k, x["hit"]))), empty) for k in KINDS]
    return F.array_sort(F.concat(*parts))


def find(docs: DataFrame, model: Model, text: str = "text", base: str = "base", added: str = "added") -> DataFrame:
    """The rows with two more columns: base spans, and the spans that the model adds.

    No added span touches another or a base match: they are sought one kind
    after the other in the text without those, each step a projection of its
    own, so that no expression is computed twice.
    """
    rest, empty = F.col("__scrubjay_rest"), F.array().cast(_SPANS)
    kinds = [k for k in KINDS if any(model[k])]
    rows = docs.withColumn("__scrubjay_base", base_spans(F.col(text)))
    for i, kind in enumerate(kinds):
        before = _blanked(rest, F.col(f"__scrubjay_{kinds[i - 1]}")) if i else _blanked(F.coalesce(F.col(text), F.lit("")), F.col("__scrubjay_base"))
        rows = rows.withColumn("__scrubjay_rest", before)
        found = _tagged(kind, _spans(rest, LOOSE[kind], lambda x, kind=kind: _chosen(kind, model, x)))
        rows = rows.withColumn(f"__scrubjay_{kind}", _if_needed(kind, rest, found, empty))
    own = F.concat(*(F.col(f"__scrubjay_{k}") for k in kinds)) if kinds else empty
    return rows.select(*map(qcol, docs.columns), F.col("__scrubjay_base").alias(base), own.alias(added))


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with base matches and added spans of a text replaced by their kind; null stays null."""
    name = lambda s, n, first: F.when(first, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
    found = find(docs, model, text, "__scrubjay_base", "__scrubjay_added")
    spans = found.withColumn("__scrubjay_spans", F.array_sort(F.concat("__scrubjay_base", "__scrubjay_added")))
    new = rewrite(F.col(text), F.col("__scrubjay_spans"), name).alias(text)
    return spans.select(*(new if c == text else qcol(c) for c in docs.columns))
