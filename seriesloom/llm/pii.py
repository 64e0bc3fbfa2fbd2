"""Personal data in texts: rules for certain spans, boosted trees over candidates for more.

Base spans are fixed by patterns and checks. Generators of high recall propose further, overlapping spans. Their format
and context are described by a few small numbers. A candidate is an example of its kind if it touches a base span of that
kind. One that touches no base span is an example if there is other evidence for it, so that what the base rules miss is
not held against itself: an e-mail address once ``[at]`` and ``[dot]`` are written out; an ip of four parts beside a word
like host; a card number in groups that passes the check sum; a phone number after a word like tel, or one of the shape that
base phone numbers have without their plus sign (at least two separators, ``SHARED`` base spans, and base spans a tenth of
all numbers of that shape). Anything else counts against.

Candidates are counted by description (``cells``), so the trees are fitted on exact counts over all documents while the
driver sees one row per description, of which there are at most the product of the feature ranges. The trees are compiled
into CASE expressions. Per kind, the threshold is the lowest score from which on the share of examples among held-out
candidates is at least ``precision``; candidates that touch no base span and score as high are added.

Everything is built-in functions over whole texts; patterns use possessive parts, so no text makes them slow or deep.
Null text counts as empty. Repeated rows get equal results. An empty table gives no rows and a model that adds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import let, stored

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
#: The contract's patterns. A match can start inside a run of its first class only after another match (\G).
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators: (kinds, pattern).
GENERATORS = (
    (
        ("email",),
        rf"(?<!{LOCAL}){LOCAL}++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++",
    ),
    (("ip",), r"(?<![A-Za-z0-9.])[0-9]++(?:[.,][0-9]++){2,4}+(?![A-Za-z0-9])"),
    (("card", "phone"), r"(?<![A-Za-z0-9])[+(]?[0-9](?:[\x20().\-/]{0,2}+[0-9])++(?![A-Za-z0-9])"),
)
CONTEXT = {
    "email": r"(?i)mail|contact|e-?mail",
    "ip": r"(?i)\bip\b|host|server|addr",
    "card": r"(?i)card|visa|credit|carte|karte|tarjeta",
    "phone": r"(?i)tel|phone|call|mobile|fax|llam",
}
#: Ranges of the features; the number of cells is bounded by their product.
RANGES = {"kind": 4, "digits": 6, "marks": 4, "paren": 2, "luhn": 2, "before": 3, "after": 3, "context": 2, "dots": 5, "small": 2}
_SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"
CONTEXT_CHARS = 24
#: A shape of phone numbers counts as evidence from so many base spans on.
SHARED = 5


def found(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as array<start, end, value, before, after>; positions in code points.

    The texts between the matches give the positions, so each text is matched twice and never cut up by position.
    """

    def step(z: Column):
        def add(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(z["gaps"], i))
            value = F.get(z["hits"], i)
            end = start + F.length(value)
            span = F.struct(
                start.alias("start"),
                end.alias("end"),
                value.alias("value"),
                F.right(F.get(z["gaps"], i), F.lit(CONTEXT_CHARS)).alias("before"),
                F.left(F.get(z["gaps"], i + 1), F.lit(CONTEXT_CHARS)).alias("after"),
            ).cast(_SPAN)
            return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return add

    def collect(z: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        n = F.size(z["hits"])
        spans = F.aggregate(F.sequence(F.lit(0), n - 1), start, step(z), lambda acc: acc["out"])
        return F.when(n == 0, F.array().cast(f"array<{_SPAN}>")).otherwise(spans)

    z = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
    )
    return let(z, collect)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether a string of digits passes the check sum."""

    def term(d: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).try_cast("int")
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return F.when((F.length(d) - i) % 2 == 1, twice).otherwise(v)

    def passes(d: Column) -> Column:
        total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + term(d, i))
        return (F.length(d) > 0) & (total % 10 == 0)

    return let(value, passes)


def octets(value: Column) -> Column:
    """Whether all parts between dots or commas are at most 255."""
    parts = F.transform(F.split(value, "[.,]"), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return octets(value)
    if kind == "card":
        return let(digits(value), lambda d: F.length(d).between(14, 19) & luhn(F.left(d, F.lit(19))))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def base_spans(text: Column) -> Column:
    """array<start, kind number, end, value> of the base rules."""
    def of_kind(number: int, kind: str) -> Column:
        ok = F.filter(found(text, BASE[kind]), lambda s: _valid(kind, s["value"]))
        return F.transform(
            ok, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"))
        )

    out = []
    for number, kind in enumerate(KINDS):
        may = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")
        out.append(F.when(may, of_kind(number, kind)).otherwise(_empty("struct<start:int,kind:int,end:int>")))
    return F.array_sort(F.concat(*out))


def _side(c: Column) -> Column:
    return F.when(c.rlike("[A-Za-z]"), 2).when(c.rlike(r"[\x20\n,;:]|^$"), 0).otherwise(1)


def _features(kind: str, s: Column) -> Column:
    value, d = s["value"], F.length(digits(s["value"]))
    marks = F.length(F.regexp_replace(value, r"[^\x20()\-/]", ""))
    dots = F.length(F.regexp_replace(value, r"[^.,]", ""))
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        F.when(d < 7, 0).when(d < 10, 1).when(d < 14, 2).when(d < 16, 3).when(d < 20, 4).otherwise(5).alias("digits"),
        F.when(marks == 0, 0).when(marks < 3, 1).when(marks < 5, 2).otherwise(3).alias("marks"),
        value.rlike(r"[(\[]").cast("int").alias("paren"),
        (d.between(14, 19) & luhn(F.left(digits(value), F.lit(19)))).cast("int").alias("luhn"),
        _side(F.right(s["before"], F.lit(1))).alias("before"),
        _side(F.left(s["after"], F.lit(1))).alias("after"),
        F.concat(s["before"], F.lit(" "), s["after"]).rlike(CONTEXT[kind]).cast("int").alias("context"),
        F.least(dots, F.lit(4)).alias("dots"),
        octets(value).cast("int").alias("small"),
    )


def candidates(text: Column, base: Column) -> Column:
    """array<start, kind, end, same, any, value, before, f>: proposed spans; do they touch a base span of their or any kind."""
    features = ",".join(f"{f}:int" for f in RANGES)
    kind_of = f"struct<start:int,kind:int,end:int,same:boolean,any:boolean,value:string,before:string,f:struct<{features}>>"

    def row(kind: str):
        n = KINDS.index(kind)

        def of(s: Column) -> Column:
            def touches(b: Column) -> Column:
                return (b["start"] < s["end"]) & (b["end"] > s["start"])

            return F.struct(
                s["start"].alias("start"),
                F.lit(n).alias("kind"),
                s["end"].alias("end"),
                F.exists(base, lambda b: touches(b) & (b["kind"] == n)).alias("same"),
                F.exists(base, touches).alias("any"),
                s["value"].alias("value"),
                s["before"].alias("before"),
                _features(kind, s).alias("f"),
            )

        return of

    out = []
    for kinds, pattern in GENERATORS:
        may = text.rlike(r"@|[(\[]at[)\]]") if kinds == ("email",) else text.rlike("[0-9]")
        spans_ = found(text, pattern)
        if "card" in kinds:
            spans_ = F.filter(spans_, lambda s: F.length(digits(s["value"])) >= 7)
        rows = let(spans_, lambda x: F.concat(*[F.transform(x, row(kind)) for kind in kinds]))
        out.append(F.when(may, rows.cast(f"array<{kind_of}>")).otherwise(_empty(kind_of)))
    return F.concat(*out)


def evidence(c: Column) -> Column:
    """Whether a candidate's own text and context, without any base span, say that it is of its kind."""
    value, f = c["value"], c["f"]
    plain = F.regexp_replace(F.regexp_replace(value, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")
    mail = plain.rlike(rf"^{LOCAL}++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{{2,}}+$")
    ip = value.rlike(r"^[0-9]++(?:[.,][0-9]++){3}+$") & (f["small"] == 1) & (f["context"] == 1)
    card = value.rlike(r"^[0-9]{4}(?:[^0-9]{1,2}[0-9]{4}){3}$|^[0-9]{4}[^0-9]{1,2}[0-9]{6}[^0-9]{1,2}[0-9]{5}$") & (f["luhn"] == 1)
    phone = _phone_long(value) & c["before"].rlike(r"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax)\b[^A-Za-z0-9]*$")
    out = F.lit(False)
    for kind, is_kind in zip(KINDS, (mail, ip, card, phone), strict=True):
        out = F.when(c["kind"] == KINDS.index(kind), is_kind).otherwise(out)
    return out


def _phone_long(value: Column) -> Column:
    return F.length(digits(value)).between(10, 15)


def phone_shape(c: Column) -> Column:
    """A phone candidate's value with all digits 0 and no plus sign; null with fewer than two separators or other kinds."""
    shape = F.regexp_replace(F.regexp_replace(c["value"], r"^\+", ""), "[0-9]", "0")
    may = (c["kind"] == KINDS.index("phone")) & _phone_long(c["value"])
    return F.when(may & shape.rlike(r"0[^0]+0+[^0]+0"), shape)


def _proposed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with a column ``pii``: base spans and candidates."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("pii", F.struct(base_spans(whole).alias("base")))
    more = candidates(whole, F.col("pii.base"))
    return out.withColumn("pii", F.col("pii").withField("more", more))


# -- boosted trees on counted cells ------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Tree:
    """Two levels of splits ``feature <= value``; ``leaves`` by (first, second)."""

    splits: tuple[tuple[str, int], tuple[str, int], tuple[str, int]]
    leaves: tuple[float, float, float, float]

    def leaf(self, x: dict[str, int]) -> int:
        (f, v), low, high = self.splits
        f2, v2 = low if x[f] <= v else high
        return 2 * (x[f] > v) + (x[f2] > v2)


@dataclass(frozen=True)
class Model:
    start: float
    trees: tuple[Tree, ...]
    #: Lowest accepted score per kind; infinity accepts nothing.
    thresholds: tuple[float, ...]

    def score(self, x: dict[str, int]) -> float:
        return sum((t.leaves[t.leaf(x)] for t in self.trees), self.start)  # added up in the order that accepts has

    def accepts(self, f: Column) -> Column:
        """The same as a column over a struct of features."""
        total = F.lit(self.start)
        for t in self.trees:
            (a, va), (b, vb), (c, vc) = t.splits
            first = F.when(f[b] <= vb, t.leaves[0]).otherwise(t.leaves[1])
            second = F.when(f[c] <= vc, t.leaves[2]).otherwise(t.leaves[3])
            total = total + F.when(f[a] <= va, first).otherwise(second)
        bound = F.lit(math.inf)
        for kind, t in enumerate(self.thresholds):
            bound = F.when(f["kind"] == kind, t).otherwise(bound)
        return total >= bound


Cell = tuple[dict[str, int], float, float]


def _split(cells: Sequence[tuple[dict[str, int], float, float]]) -> tuple[tuple[str, int], float]:
    """The split of (features, gradient, hessian) rows with the largest gain."""

    def gain(g: float, h: float) -> float:
        return g * g / (h + 1.0)

    all_g, all_h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best, at = -1.0, (next(iter(RANGES)), 0)
    for feature, size in RANGES.items():
        by = [[0.0, 0.0] for _ in range(size)]
        for x, g, h in cells:
            by[x[feature]][0] += g
            by[x[feature]][1] += h
        g = h = 0.0
        for value in range(size - 1):
            g, h = g + by[value][0], h + by[value][1]
            won = gain(g, h) + gain(all_g - g, all_h - h) - gain(all_g, all_h)
            if won > best + 1e-12:
                best, at = won, (feature, value)
    return at, best


def boost(cells: Sequence[Cell], rounds: int, rate: float) -> tuple[float, tuple[Tree, ...]]:
    """Logistic boosting on (features, examples, others) cells."""
    good, bad = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not good or not bad:
        return (20.0 if good else -20.0), ()
    start, trees = math.log(good / bad), []
    scores = [start] * len(cells)
    for _ in range(rounds):
        rows = []
        for (x, p, n), s in zip(cells, scores, strict=True):
            q = 1 / (1 + math.exp(-s))
            rows.append((x, p * (1 - q) - n * q, (p + n) * q * (1 - q)))
        first, _ = _split(rows)
        sides = [[r for r in rows if (r[0][first[0]] > first[1]) == high] for high in (False, True)]
        splits = (first, _split(sides[0])[0], _split(sides[1])[0])
        sums = [[0.0, 0.0] for _ in range(4)]
        shape = Tree(splits, (0.0,) * 4)
        where = [shape.leaf(r[0]) for r in rows]
        for k, r in zip(where, rows, strict=True):
            sums[k][0] += r[1]
            sums[k][1] += r[2]
        tree = Tree(splits, tuple(rate * g / (h + 1.0) for g, h in sums))
        trees.append(tree)
        scores = [s + tree.leaves[k] for s, k in zip(scores, where, strict=True)]
    return start, tuple(trees)


def fit(docs: DataFrame, text: str = "text", rounds: int = 24, rate: float = 0.3, precision: float = 0.95, least: int = 20) -> Model:
    """Trees and thresholds from all candidates of ``docs``; a quarter of the texts is held out for the thresholds.

    A kind with fewer than ``least`` held-out candidates above every threshold gets no additions.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col(text), F.lit(""))), F.lit(4)) == 0
    # outer, as Spark would else filter by the size of the array first and find all candidates once more for that
    rows = _proposed(docs.select(text), text).select(held.alias("held"), F.explode_outer("pii.more").alias("c"))
    rows, c = rows.where("c IS NOT NULL"), F.col("c")
    own = rows.groupBy("held", phone_shape(c).alias("shape"), *[F.col(f"c.f.{f}").alias(f) for f in RANGES]).agg(
        F.sum(c["same"].cast("long")).alias("base"),
        F.sum((~c["any"] & evidence(c)).cast("long")).alias("evident"),
        F.sum((~c["any"]).cast("long")).alias("free"),
        F.count("*").alias("n"),
    )
    own = stored(own, "pii-cells")
    shapes = own.where("shape IS NOT NULL").groupBy("shape").agg(F.sum("base").alias("b"), F.sum("n").alias("all"))
    shapes = shapes.where((F.col("b") >= SHARED) & (10 * F.col("b") >= F.col("all"))).select("shape", F.lit(True).alias("shared"))
    more = F.when(F.coalesce("shared", F.lit(False)), F.col("free")).otherwise(F.col("evident"))
    counted = own.join(shapes, "shape", "left").groupBy("held", *RANGES).agg(F.sum(F.col("base") + more).alias("good"), F.sum("n").alias("n"))
    train, test = [], []
    for r in counted.orderBy("held", *RANGES).collect():  # at most 2 * product of RANGES rows
        (test if r["held"] else train).append(({f: r[f] for f in RANGES}, r["good"], r["n"] - r["good"]))
    start, trees = boost(train, rounds, rate)
    model = Model(start, trees, (math.inf,) * len(KINDS))
    thresholds = []
    for kind in range(len(KINDS)):
        rows = sorted(((model.score(x), p, n) for x, p, n in test if x["kind"] == kind), reverse=True)
        good = bad = 0
        best = math.inf
        for i, (score, p, n) in enumerate(rows):
            good, bad = good + p, bad + n
            tied = i + 1 < len(rows) and rows[i + 1][0] == score
            if not tied and good + bad >= least and good >= precision * (good + bad):
                best = score
        thresholds.append(best)
    return Model(start, trees, tuple(thresholds))


def spans(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a column ``pii``: struct of ``base`` and ``all``, arrays of (start, kind number, end), sorted."""

    def row(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))

    p = F.col("pii")
    added = F.transform(F.filter(p["more"], lambda c: ~c["any"] & model.accepts(c["f"])), row)
    out = F.struct(p["base"].alias("base"), F.array_sort(F.array_union(p["base"], added)).alias("all"))
    return _proposed(docs, text).withColumn("pii", out)


def digest_text(spans_: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans_,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redacted(text: Column, spans_: Column) -> Column:
    """The text with each run of overlapping spans replaced by the name of its first kind, as ``<EMAIL>``."""
    marks = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def add(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        parts = F.when(inside, acc["parts"]).otherwise(F.concat(acc["parts"], F.array(gap, F.get(marks, s["kind"]))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    def done(acc: Column) -> Column:
        rest = F.substring(text, acc["at"] + 1, F.length(text))
        return F.concat(F.array_join(acc["parts"], ""), rest)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    return F.when(F.size(spans_) == 0, text).otherwise(F.aggregate(spans_, start, add, done))
