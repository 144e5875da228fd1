"""Personal data: proposals of high recall, judged by boosted trees. DataFrame functions only.

Base rules find four kinds and are always kept. They miss what stands too close to other digits: two card
numbers side by side are one run with too many digits. Further generators propose spans that may overlap
each other and those of the base; trees on the format and the surroundings of a span score them, and
those at their kind's threshold or more are added, unless they overlap a base span of their kind.

Trees learn from the base's own verdicts on all documents: a proposal that is a base span is
right, one that the base looked at and refused, or that cuts through a base span, is wrong, and one that
the base cannot judge teaches nothing. Gradients are whole numbers, so a model does not depend on how
rows are dealt. Everything that is applied to a document is one projection of its row: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.columns import shared_checkpoint

KINDS = ("email", "ip", "card", "phone")
#: Proposals of a document that are held against base spans at a time.
SPANS = 128
ROUNDS, DEPTH, RATE, RIDGE = 5, 2, 0.5, 1.0
#: Calibrated share of right ones that a score must reach.
PRECISION = 0.9
_UNIT, _SHIFT, _SPREAD = 1_000_000, 1 << 31, 256

_NAME, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: The base patterns. Possessive loops and the looks behind change no match: one that begins inside a run of the first class would begin at the start of the run too. They make the search linear in the text.
BASE = {
    "email": rf"(?:\G|(?<!{_NAME})){_NAME}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the base pattern of a kind to give a span that passes.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){15}", "phone": r"\+[0-9]"}
#: Further proposals of each kind: what a text must hold, and the pattern.
PROPOSALS = {
    "email": [(r"[\[(](?:at|AT|@)[\])]", rf"(?<!{_NAME}){_NAME}{{1,64}}+ ?[\[(](?:at|AT|@)[\])] ?{_LABEL}++(?: ?(?:\.|[\[(](?:dot|DOT|\.)[\])]) ?{_LABEL}++)++")],
    "ip": [(_NEEDS["ip"], rf"(?<![0-9]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])")],
    "card": [(_NEEDS["card"], r"(?<![0-9])[0-9]{16,19}(?![0-9])"), (_NEEDS["card"], r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")],
    "phone": [
        (_NEEDS["phone"], r"\+[0-9]{1,3}+ ?\([0-9]{1,4}\) ?[0-9]{2,4}[\x20.-][0-9]{2,4}(?![0-9])"),
        (_NEEDS["phone"], r"\+[0-9]{1,3}+(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9])"),
        (_NEEDS["phone"], r"\+[0-9]{8,15}(?![0-9])"),
        (r"\([0-9]{3}\)", r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"),
    ],
}
#: Words that announce each kind, looked for before a span (fixed values).
ANNOUNCED = {"email": "e-?mail|write to|contact", "ip": r"\bip\b|host|server|address", "card": "card|visa|credit|payment", "phone": r"phone|\btel|call|fax|mobile"}
FEATURES = ("luhn", "octets", "plus", "paren", "digits", "separators", "length", "lead", "before", "after", "joined_before", "joined_after", "announced")
SPAN = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(xs: Column, base: Column) -> Column:
    """base + x1, base + x1 + x2, ... of a short array."""
    return F.slice(F.aggregate(xs, F.array(base), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x))), F.lit(2), F.greatest(F.size(xs), F.lit(1)))


def _running_total(xs: Column) -> Column:
    """Sums of the first 1, 2, ... entries of an array that is not empty; in runs, so that a long one is not copied for each entry."""

    def over(runs: Column) -> Column:
        sums = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda a, x: a + x))
        bases = F.concat(F.array(F.lit(0)), _running(sums, F.lit(0)))
        return F.flatten(F.zip_with(runs, F.slice(bases, F.lit(1), F.size(runs)), _running))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _SPREAD).cast("int")), lambda b: F.slice(v, b * _SPREAD + 1, F.lit(_SPREAD)))
    return _let(_let(xs, cut), over)


def find_spans(text: Column, pattern: str, needs: str) -> Column:
    """Leftmost non-overlapping matches as an array of start and end (code points, end exclusive), text, and up to 24 characters before and 8 after. needs: what a text must hold to be searched."""

    def placed(v: Column) -> Column:
        n = F.size(v["hits"])
        pieces = F.zip_with(F.slice(v["gaps"], F.lit(1), n), v["hits"], lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit"), (F.length(gap) + F.length(hit)).alias("n")))
        pieces = F.zip_with(pieces, F.slice(v["gaps"], F.lit(2), n), lambda p, after: F.struct(p["hit"].alias("hit"), p["n"].alias("n"), F.right(p["gap"], F.lit(24)).alias("before"), F.left(after, F.lit(8)).alias("after")))
        span = lambda p, end: F.struct((end - F.length(p["hit"])).alias("start"), end.alias("end"), p["hit"].alias("text"), p["before"].alias("before"), p["after"].alias("after"))
        return F.when(n > 0, _let(pieces, lambda ps: F.zip_with(ps, _running_total(F.transform(ps, lambda p: p["n"])), span)))

    found = _let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), placed)
    return F.coalesce(F.when(text.rlike(needs), found), F.array().cast(SPAN))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a text of digits is right."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def octets_fit(text: Column) -> Column:
    return text.rlike(rf"^0*{_OCTET}(?:\.0*{_OCTET}){{3}}$")


def passes(kind: str, text: Column) -> Column:
    """The base's check of a match."""
    n = F.length(_digits(text))
    return {"email": F.lit(True), "ip": octets_fit(text), "card": F.when(n.between(16, 19), luhn(_digits(text))).otherwise(False), "phone": n.between(8, 15)}[kind]


def _passes(kind: str) -> Callable[[Column], Column]:
    return lambda span: passes(kind, span["text"])


def _class(char: Column) -> Column:
    return F.when(char == "", 0).when(char.rlike(r"^\s$"), 1).when(char.rlike(r"^\p{L}$"), 2).when(char.rlike("^[0-9]$"), 3).when(char.rlike("^[.-]$"), 4).otherwise(5)


def features(kind: str, span: Column) -> Column:
    """FEATURES of a span as an array of small whole numbers."""
    text, digits, before, after = span["text"], _digits(span["text"]), span["before"], span["after"]
    n, flag = F.length(digits), lambda c: F.when(c, 1).otherwise(0)
    own = F.lower(before).rlike(ANNOUNCED[kind])
    other = F.lower(before).rlike("|".join(v for k, v in ANNOUNCED.items() if k != kind))
    values = {
        "luhn": flag(passes("card", text)) if kind == "card" else F.lit(0), "octets": flag(octets_fit(text)) if kind == "ip" else F.lit(0), "plus": flag(text.startswith("+")), "paren": flag(text.contains("(")),
        "digits": F.least(n, F.lit(24)), "separators": F.least(F.length(F.regexp_replace(text, "[0-9A-Za-z]", "")), F.lit(8)), "length": F.least(F.length(text), F.lit(48)),
        "lead": F.coalesce(F.left(digits, F.lit(1)).try_cast("int"), F.lit(-1)), "before": _class(F.right(before, F.lit(1))), "after": _class(F.left(after, F.lit(1))),
        "joined_before": flag(before.rlike(r"[0-9][\x20.-]?$")), "joined_after": flag(after.rlike(r"^[\x20.-]?[0-9]")), "announced": F.when(own, 2).when(other, 1).otherwise(0),
    }
    return F.array(*(values[f].cast("int") for f in FEATURES))


@dataclass
class Tree:
    """A split (feature, most for the left side) with two trees, or a leaf. number: 1 for the root, twice that and one more below it."""

    value: float = 0.0
    number: int = 1
    feature: int = -1
    most: int = 0
    low: Tree | None = None
    high: Tree | None = None

    def column(self, x: Column, leaf: Callable[[Tree], float]) -> Column:
        if self.feature < 0:
            return F.lit(leaf(self))
        return F.when(F.get(x, F.lit(self.feature)) <= self.most, self.low.column(x, leaf)).otherwise(self.high.column(x, leaf))


def _parts(spans: Column, base: Column) -> Column:
    """Spans, each once, in parts of at most SPANS in the order of their starts, each part with the base spans that can overlap one of it: a document with very many of both is not held pair by pair."""

    def cut(ordered: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / SPANS).cast("int")), lambda k: F.slice(ordered, k * SPANS + 1, F.lit(SPANS)))
        ends = F.transform(parts, lambda p: F.struct(p.alias("spans"), p[0]["start"].alias("start"), F.array_max(F.transform(p, lambda s: s["end"])).alias("end")))
        return F.transform(ends, lambda p: F.struct(p["spans"].alias("spans"), F.filter(base, lambda b: (b["start"] < p["end"]) & (b["end"] > p["start"])).alias("near")))

    once = lambda ordered: F.filter(ordered, lambda s, i: F.when(i == 0, True).otherwise(s != F.get(ordered, i - 1)))
    return _let(_let(F.array_sort(spans), once), cut)


def _by_kind(kind: Column, of: Callable[[str], Column]) -> Column:
    out = of(KINDS[-1])
    for k in KINDS[:-1]:
        out = F.when(kind == k, of(k)).otherwise(out)
    return out


def _best_split(cells: dict[int, dict[int, tuple[int, int]]]) -> tuple[int, int, tuple[int, int], tuple[int, int]] | None:
    """(feature, most, sums of the left side, of the right side) of the largest gain over sums of gradients and curvatures by feature and value, the first feature of equal ones; None if nothing is gained."""
    worth = lambda g, h: g * g / (h + RIDGE * _UNIT)
    best, gain = None, 1e-3 * _UNIT
    for f in sorted(cells):
        values = sorted(cells[f])
        all_g, all_h = (sum(cells[f][v][i] for v in values) for i in (0, 1))
        g = h = 0
        for v in values[:-1]:
            g, h = g + cells[f][v][0], h + cells[f][v][1]
            now = worth(g, h) + worth(all_g - g, all_h - h) - worth(all_g, all_h)
            if now > gain * (1 + 1e-9):
                best, gain = (f, v, (g, h), (all_g - g, all_h - h)), now
    return best


def _grow(rows: DataFrame, score: Column) -> dict[str, Tree]:
    """A tree for each kind on the gradients of the logistic loss, one pass over the rows for each level. Gradients are whole numbers of millionths: sums have no order."""
    p, x = F.lit(1.0) / (F.lit(1.0) + F.exp(-score)), F.col("x")
    g, h = (F.round((F.col("right") - p) * _UNIT).cast("long") * F.col("n")), (F.round(p * (F.lit(1.0) - p) * _UNIT).cast("long") * F.col("n"))
    value = lambda g, h: round(RATE * g / (h + RIDGE * _UNIT), 6)
    trees = {k: Tree() for k in KINDS}
    open_nodes = list(trees.items())
    for level in range(DEPTH):
        place = _by_kind(F.col("kind"), lambda k: trees[k].column(x, lambda leaf: leaf.number))
        cells = rows.select("kind", place.alias("node"), g.alias("g"), h.alias("h"), F.posexplode(x).alias("f", "v")).groupBy("kind", "node", "f", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        sums: dict[tuple, dict[int, dict[int, tuple[int, int]]]] = {}
        for r in cells.collect():  # a row for each node, feature and small number
            sums.setdefault((r.kind, r.node), {}).setdefault(r.f, {})[r.v] = (r.g, r.h)
        after = []
        for kind, node in open_nodes:
            found = sums.get((kind, node.number), {})
            if level == 0 and found:
                node.value = value(*(sum(v[i] for v in found[0].values()) for i in (0, 1)))
            split = _best_split(found)
            if split:
                node.feature, node.most, low, high = split
                node.low, node.high = Tree(value(*low), 2 * node.number), Tree(value(*high), 2 * node.number + 1)
                after += [(kind, node.low), (kind, node.high)]
        open_nodes = after
    return trees


def calibrated_threshold(bins: list[tuple[int, int, int]], precision: float = PRECISION) -> int | None:
    """The least bin from which on the share of right ones, made to rise with the bin by pooling, is precision or more. bins: (bin, right, all)."""
    pools: list[list[int]] = []
    for b, right, n in sorted(bins):
        pools.append([b, right, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    return next((b for b, right, n in pools if right >= precision * n), None)


@dataclass
class PersonalData:
    """A model: trees of each round by kind, and a threshold of the score (in hundredths of a probability) for each kind. Without trees nothing is added to the base."""

    trees: list[dict[str, Tree]] = field(default_factory=list)
    thresholds: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def proposals(text: Column) -> dict[str, list[Column]]:
        """Arrays of spans of the further generators, by kind."""
        return {k: [find_spans(text, p, needs) for needs, p in PROPOSALS[k]] for k in KINDS}

    @staticmethod
    def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """kind, x (features), right (0 or 1), held_out and n: proposals of all documents that the base can judge, like ones counted together. The table is read once for each kind."""
        mark = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
        texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), (F.pmod(F.shiftright(mark, 20), F.lit(4)) == 2).alias("held_out"))
        t, out = F.col("t"), None
        for kind in KINDS:
            base = find_spans(t, BASE[kind], _NEEDS[kind])
            all_spans = F.concat(base, *(find_spans(t, p, needs) for needs, p in PROPOSALS[kind]))
            rows = texts.filter(reduce(or_, (t.rlike(n) for n in sorted({_NEEDS[kind], *(needs for needs, _ in PROPOSALS[kind])})))).select("held_out", base.alias("base"), all_spans.alias("all"))
            each = rows.filter(F.size("all") > 0).select("held_out", F.explode(_parts(F.col("all"), F.col("base"))).alias("part")).select("held_out", F.col("part.near").alias("base"), F.explode("part.spans").alias("s"))
            met = F.filter("base", lambda b: (b["start"] < F.col("s.end")) & (b["end"] > F.col("s.start")))
            same = F.exists("met", lambda b: (b["start"] == F.col("s.start")) & (b["end"] == F.col("s.end")))
            good = F.exists("met", _passes(kind))
            right = F.when(same, passes(kind, F.col("s.text")).cast("int")).when(good, 0)
            rows = each.withColumn("met", met).select(F.lit(kind).alias("kind"), "held_out", features(kind, F.col("s")).alias("x"), right.alias("right")).filter("right is not null")
            out = rows if out is None else out.union(rows)
        return out.groupBy("kind", "x", "right", "held_out").agg(F.count("*").alias("n"))

    @staticmethod
    def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> PersonalData:
        """Trees from three quarters of all documents, thresholds from the last one. An empty table, or one without any proposal, gives a model that adds nothing."""
        rows = shared_checkpoint(PersonalData.labelled(docs, id_col, text_col))
        learn, model = rows.filter("not held_out"), PersonalData()
        if learn.isEmpty():
            return model
        score = lambda kind: model.logit(kind, F.col("x"))
        for _ in range(rounds):
            model.trees.append(_grow(learn, _by_kind(F.col("kind"), score)))
        bins = rows.groupBy("kind", "held_out", _by_kind(F.col("kind"), lambda k: model.hundredths(k, F.col("x"))).alias("bin")).agg(F.sum(F.col("right") * F.col("n")).alias("right"), F.sum("n").alias("n")).collect()
        for kind in KINDS:
            own = [b for b in bins if b.kind == kind]
            held = [(b.bin, b.right, b.n) for b in own if b.held_out] or [(b.bin, b.right, b.n) for b in own]
            least = calibrated_threshold(held)
            if least is not None:
                model.thresholds[kind] = least
        return model

    def logit(self, kind: str, x: Column) -> Column:
        out = F.lit(0.0)
        for trees in self.trees:
            out = out + trees[kind].column(x, lambda leaf: leaf.value)
        return out

    def hundredths(self, kind: str, x: Column) -> Column:
        return F.floor(F.lit(100.0) / (F.lit(1.0) + F.exp(-self.logit(kind, x)))).cast("int")

    def _accepts(self, kind: str) -> Callable[[Column], Column]:
        return lambda s: self.hundredths(kind, features(kind, s)) >= self.thresholds[kind]

    def find(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with two columns, base and found: maps of kind to sorted arrays of span keys (see `span_keys`).

        base has what the base rules say, found also what the trees add. A null text is empty. No
        row is shuffled. A doc's columns of these names are replaced.
        """
        hidden = "__text"
        while hidden in docs.columns:
            hidden += "_"
        text = F.col(hidden)
        rows = docs.withColumn(hidden, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
        key = lambda s: s["start"].cast("long") * _SHIFT + s["end"]
        base = [F.transform(F.filter(find_spans(text, BASE[k], _NEEDS[k]), _passes(k)), key).alias(k) for k in KINDS]
        more = []
        for kind, arrays in self.proposals(text).items():
            if self.trees and kind in self.thresholds:
                good = [F.transform(F.filter(a, self._accepts(kind)), key) for a in arrays]
                more.append(F.array_distinct(F.concat(*good)).alias(kind))
            else:
                more.append(F.array().cast("array<bigint>").alias(kind))
        rows = rows.withColumns({"base": F.struct(*base), "found": F.struct(*more)}).drop(hidden)
        joined = F.struct(*(_with_additions(F.col(f"base.{k}"), F.col(f"found.{k}")).alias(k) for k in KINDS))
        return rows.withColumn("found", joined)

    def redact(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with each span found replaced by its kind in brackets (the first kind by name of overlapping ones). A null text stays null."""
        found = self.find(docs, text_col)
        tag = lambda kind: lambda key: F.struct(key.alias("key"), F.lit(kind).alias("kind"))
        tagged = F.array_sort(F.concat(*(F.transform(F.col(f"found.{k}"), tag(k)) for k in KINDS)))
        start, end = (lambda s: F.shiftright(s["key"], 31).cast("int")), (lambda s: s["key"].bitwiseAND(F.lit(_SHIFT - 1)).cast("int"))
        text = F.col(text_col).cast("string")
        first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        step = lambda a, s: F.when(start(s) < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], end(s)).alias("at"))).otherwise(F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, start(s) - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), end(s).alias("at")))
        done = F.aggregate(tagged, first, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
        return found.withColumn(text_col, done).drop("base", "found")


def _with_additions(base: Column, more: Column) -> Column:
    """Sorted keys of the base and of those of more that overlap none of them; of additions that overlap each other the longer one stays, then the first."""
    start, end = (lambda k: F.shiftright(k, 31)), (lambda k: k.bitwiseAND(F.lit(_SHIFT - 1)))
    events = F.array_sort(F.concat(F.transform(base, lambda k: F.struct(start(k).alias("at"), F.lit(0).alias("own"), k.alias("key"))), F.transform(F.array_except(more, base), lambda k: F.struct(start(k).alias("at"), F.lit(1).alias("own"), k.alias("key")))))
    none = F.lit(-1).cast("long")
    state = lambda kept, base_end, held: F.struct(kept.alias("kept"), base_end.alias("base_end"), held.alias("held"))

    def step(a: Column, e: Column) -> Column:
        meets = (a["held"] >= 0) & (end(a["held"]) > e["at"])
        kept = F.when((a["held"] >= 0) & ~meets, F.concat(a["kept"], F.array(a["held"]))).otherwise(a["kept"])
        longer = end(e["key"]) - start(e["key"]) > end(a["held"]) - start(a["held"])
        return (
            F.when(e["own"] == 0, state(kept, end(e["key"]), none))
            .when(e["at"] < a["base_end"], a)
            .otherwise(state(kept, a["base_end"], F.when(meets & ~longer, a["held"]).otherwise(e["key"])))
        )

    added = F.aggregate(events, state(F.array().cast("array<bigint>"), F.lit(0).cast("long"), none), step, lambda a: F.when(a["held"] >= 0, F.concat(a["kept"], F.array(a["held"]))).otherwise(a["kept"]))
    return F.when(F.size(more) == 0, base).otherwise(F.array_sort(F.concat(base, added)))


def span_text(found: str) -> Column:
    """kind:start:end of all spans of a column of `find`, by kind, then start, joined by commas."""
    each = lambda k: F.transform(F.col(f"{found}.{k}"), lambda key: F.concat(F.lit(f"{k}:"), F.shiftright(key, 31).cast("string"), F.lit(":"), key.bitwiseAND(F.lit(_SHIFT - 1)).cast("string")))
    return F.array_join(F.concat(*(each(k) for k in KINDS)), ",")
