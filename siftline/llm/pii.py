"""Personal data by weak supervision.

Patterns give candidate spans.  Five labelers vote on each (for, against or not
at all): the strict format of its kind, a gazetteer, cue words before it, words
before it that speak against, and what it touches.  Votes are counted over the
whole corpus by combination, a table of bounded size; expectation-maximisation
over these counts estimates how reliable each labeler is, and a logistic
regression on votes and shape is trained on the outcome.  Its weights become
constants of the query.  Spans of the base patterns are always reported, other
candidates of every kind when they have the strict format of their kind, the
classifier gives them one half or more and no base span overlaps them.  The format
is wider than the base pattern for cards (Luhn from 12 digits on) and phones (7
digits).  Candidates without it (an octet over 255, digits that fail Luhn) are the
counterexamples that the fit needs and are never reported.  Added spans may overlap
each other, as base spans may; they are masked as one.  Column functions only; the
driver sees the counts.

Cases: null texts count as empty (and stay null when masked); rows that repeat
are rows of their own; without any candidate there is nothing to train and
nothing is added.  Extra columns pass through ``redact_pii`` and are not looked
at.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.spans import SPANS, blocks_of, bound, count_of, digits_of, find_spans, joined, luhn, mask, overlapping, part_of
from siftline.plans.materialize import keep

# The base patterns.  Possessive runs and starts at the beginning
# of a run (or where the last match ended) find what the plain forms find, without
# trying every start in a run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ["email", "ip", "card", "phone"]
# the other kinds
NATIONAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
LOCAL = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])"
KINDS = [*BASE, "national", "local", "iban"]

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOMAINS = r"\.(?i:com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|ch|at|us|ca|au|in|jp|br|mx)$"
CALLING = r"^\+(?:1|7|20|27|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
COUNTRIES = r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|SE)"
CUES = {
    "email": "e-?mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|host|server|client|adresse",
    "card": "card|visa|master|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|cell|anruf",
    "national": "ssn|social|security|national|tax",
    "local": "phone|call|tel|fax|mobile|cell",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
AGAINST = r"(?i)\b(?:version|ver|isbn|issn|section|chapter|release|build|port|seed|sku|part no)\b\W*$"
LABELERS = ["format", "gazetteer", "cue", "against", "edges"]
CANDIDATE = "struct<kind:string,start:int,end:int,value:string,base:boolean,format:int,gazetteer:int,cue:int,against:int,edges:int,size:int,digits:int>"


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).otherwise(F.lit(0) if no is None else F.when(no, -1).otherwise(0))


def _by_kind(kind: Column, cases: dict[str, Column], rest: Column) -> Column:
    out = rest
    for name, value in cases.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def _candidate(blocks: Column, s: Column) -> Column:
    """A span with its votes; ``blocks`` are those of its text."""
    before = part_of(blocks, F.greatest(s["start"] - 40, F.lit(0)), s["start"])
    touches = F.concat(part_of(blocks, F.greatest(s["start"] - 1, F.lit(0)), s["start"]), part_of(blocks, s["end"], s["end"] + 1))
    around = F.struct(before.alias("before"), touches.alias("touches"))
    return bound(around, lambda x: _votes(s, x["before"], x["touches"]))


def _votes(s: Column, before: Column, touches: Column) -> Column:
    kind, value = s["kind"], s["value"]
    n = F.length(digits_of(value))
    strict = _by_kind(
        kind,
        {
            "email": value.rlike(r"\.[A-Za-z]{2,}$"),
            "ip": value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
            "card": n.between(12, 19) & luhn(value),
            "phone": n.between(7, 15),
            "national": ~value.rlike("^(?:000|666|9)|-00-|-0000$"),
            "local": ~value.rlike(r"^\(?[01]"),
        },
        F.length(value) >= 15,
    )
    long = {"card": strict & (n >= 16), "phone": strict & (n >= 8)}
    base = _by_kind(kind, {"email": F.lit(True), "ip": strict, **long}, F.lit(False))
    known = _by_kind(
        kind,
        {
            "email": _vote(value.rlike(DOMAINS)),
            "ip": _vote(F.lit(False), value.rlike(r"^(?:0|127|255)\.")),
            "card": _vote(value.rlike("^[3-6]"), value.rlike("^0")),
            "phone": _vote(value.rlike(CALLING)),
            "iban": _vote(value.rlike(COUNTRIES)),
        },
        F.lit(0),
    )
    cue = _by_kind(kind, {k: _vote(before.rlike(f"(?i){words}")) for k, words in CUES.items()}, F.lit(0))
    share = F.length(digits_of(value)) / F.length(value)
    return F.struct(
        kind.alias("kind"),
        s["start"].alias("start"),
        s["end"].alias("end"),
        value.alias("value"),
        base.alias("base"),
        F.when(strict, 1).otherwise(-1).alias("format"),
        known.alias("gazetteer"),
        cue.alias("cue"),
        F.when(before.rlike(AGAINST), -1).otherwise(0).alias("against"),
        F.when(touches.rlike(r"[\p{L}\p{N}]"), -1).otherwise(1).alias("edges"),
        F.least(F.floor(F.length(value) / 8), F.lit(3)).cast("int").alias("size"),
        F.when(share > 0.9, 2).when(share > 0.3, 1).otherwise(0).alias("digits"),
    )


def candidates(text: Column) -> Column:
    """All candidate spans of a text with their votes; digit runs from 12 digits on."""
    cards = F.filter(find_spans(text, CARD, "card"), lambda s: F.length(digits_of(s["value"])) >= 12)
    patterns = [(EMAIL, "email"), (IP, "ip")], [(PHONE, "phone"), (NATIONAL, "national"), (LOCAL, "local"), (IBAN, "iban")]
    found = [find_spans(text, p, k) for p, k in patterns[0]] + [cards] + [find_spans(text, p, k) for p, k in patterns[1]]
    nothing = F.array().cast(f"array<{CANDIDATE}>")

    def voted(spans: Column) -> Column:
        votes = bound(blocks_of(text), lambda blocks: F.transform(spans, lambda s: _candidate(blocks, s)))
        return F.when(F.size(spans) > 0, votes.cast(f"array<{CANDIDATE}>")).otherwise(nothing)

    return bound(F.concat(*found), voted)


class SpanModel:
    """Labeler reliabilities by expectation-maximisation, and the classifier trained on them.

    ``cells`` are the counts of each combination of kind, votes and shape.
    """

    def __init__(self, cells: list[tuple[dict, int]], rounds: int = 50, steps: int = 300):
        self.reliability: dict[tuple, float] = {}
        self.weights: dict[tuple, float] = {("bias", 0): -35.0}
        if cells:
            self._train(cells, self._posteriors(cells, rounds), steps)

    def _posteriors(self, cells: list[tuple[dict, int]], rounds: int) -> list[float]:
        """How likely each cell is personal data, labelers taken as independent given the truth."""
        guess = [0.9 if sum(c[v] for v in LABELERS) > 0 else 0.1 for c, _ in cells]
        for _ in range(rounds):
            prior: dict[tuple, float] = {}
            table: dict[tuple, float] = {}
            for (cell, n), p in zip(cells, guess, strict=True):
                for truth, q in ((1, p), (0, 1 - p)):
                    prior[cell["kind"], truth] = prior.get((cell["kind"], truth), 1.0) + n * q
                    for v in LABELERS:
                        key = (v, cell[v], truth)
                        table[key] = table.get(key, 1.0) + n * q
            totals = {(v, t): sum(table.get((v, x, t), 1.0) for x in (-1, 0, 1)) for v in LABELERS for t in (0, 1)}
            guess = []
            for cell, _ in cells:
                odds = math.log(prior[cell["kind"], 1]) - math.log(prior[cell["kind"], 0])
                for v in LABELERS:
                    for truth, sign in ((1, 1), (0, -1)):
                        odds += sign * math.log(table[v, cell[v], truth] / totals[v, truth])
                guess.append(1 / (1 + math.exp(-max(-35.0, min(35.0, odds)))))
            self.reliability = {k: x / totals[k[0], k[2]] for k, x in table.items()}
        return guess

    @staticmethod
    def features(cell: dict) -> list[tuple]:
        votes = [(v, cell[v]) for v in LABELERS if cell[v]]
        return [("bias", 0), ("kind", cell["kind"]), ("size", cell["size"]), ("digits", cell["digits"]), *votes]

    def _train(self, cells: list[tuple[dict, int]], truth: list[float], steps: int) -> None:
        """Logistic regression on soft labels, each cell by the logarithm of its count, with AdaGrad steps."""
        weights: dict[tuple, float] = {}
        squares: dict[tuple, float] = {}
        shares = [1 + math.log(n) for _, n in cells]
        for _ in range(steps):
            slope: dict[tuple, float] = {}
            for (cell, _), y, share in zip(cells, truth, shares, strict=True):
                names = self.features(cell)
                p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(weights.get(f, 0.0) for f in names)))))
                for f in names:
                    slope[f] = slope.get(f, 0.0) + share * (p - y)
            for f, g in slope.items():
                g += 0.01 * weights.get(f, 0.0)
                squares[f] = squares.get(f, 0.0) + g * g
                weights[f] = weights.get(f, 0.0) - 0.5 * g / math.sqrt(squares[f] + 1e-9)
        self.weights = weights

    def probability(self, s: Column) -> Column:
        total = F.lit(float(self.weights.get(("bias", 0), 0.0)))
        for (name, value), weight in sorted(self.weights.items(), key=str):
            if name != "bias":
                total = total + F.when(s[name] == F.lit(value), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def learn_spans(spans: DataFrame) -> SpanModel:
    """From rows with an array ``spans`` of candidates; only counts reach the driver."""
    shape = ["kind", *LABELERS, "size", "digits"]
    counts = spans.select(F.explode("spans").alias("s")).select(*(F.col("s")[c].alias(c) for c in shape))
    rows = counts.groupBy(*shape).agg(F.count(F.lit(1)).alias("n")).collect()
    return SpanModel(sorted((({c: r[c] for c in shape}, r["n"]) for r in rows), key=str))


def chosen(spans: Column, model: SpanModel) -> tuple[Column, Column]:
    """Base spans, and all reported spans, by kind as listed and start."""

    def plain(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"])).cast(SPANS)

    base = plain(F.filter(spans, lambda s: s["base"]))
    likely = plain(F.filter(spans, lambda s: ~s["base"] & (s["format"] == 1) & (model.probability(s) >= 0.5)))

    def added(sides: Column) -> Column:
        new = F.zip_with(sides["likely"], overlapping(sides["likely"], sides["base"]), lambda s, hit: F.struct(s.alias("span"), hit.alias("hit")))
        new = F.transform(F.filter(new, lambda x: ~x["hit"]), lambda x: x["span"])
        return F.when(F.size(sides["likely"]) > 0, F.concat(sides["base"], new)).otherwise(sides["base"])

    return base, bound(F.struct(base.alias("base"), likely.alias("likely")), added)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, found): spans of each document, base ones and all reported."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = keep(docs.select(F.col(id_col).alias("doc_id"), candidates(text).alias("spans")))
    base, found = chosen(F.col("spans"), learn_spans(rows))
    return rows.select("doc_id", base.alias("base"), found.alias("found"))


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows with every reported span put as its kind in angle brackets.

    Texts are searched twice, once for the counts and once where they are masked,
    so that no text has to be shuffled to its spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    model = learn_spans(keep(docs.select(candidates(text).alias("spans")).where(F.size("spans") > 0)))
    found = bound(candidates(text), lambda spans: chosen(spans, model)[1])
    marks = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    return docs.withColumn(text_col, mask(F.col(text_col), marks))


def pii_columns(found: DataFrame) -> DataFrame:
    """The counts and digests of ``find_pii``."""
    return found.select(
        "doc_id",
        *(count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
