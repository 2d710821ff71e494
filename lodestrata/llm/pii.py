"""Personal data by weak supervision, in DataFrame expressions only.

Four strict patterns (email, ip, card, phone) give the base spans, which always
stay. A wider pattern proposes further spans: tokens with digits, such as keys,
passwords and national or account numbers. Labelers vote on every proposal and on every base
span (1 for, -1 against, 0 abstains):

* shape: a regular expression of a known key, hash or number format;
* gazetteer: the words before it against lists of cue words and of innocent ones;
* context: assignment marks and quotes around it;
* alternation: how often letters and digits change, and how varied the characters are;
* strict: whether a strict pattern and its checks accept it.

The votes' patterns are counted over all documents. Expectation-maximisation on
these counts (a table of at most 3^5 patterns) estimates the labelers' reliabilities
and each pattern's probability; a logistic classifier on the votes and the length is
trained on those probabilities and decides on the proposals, again as an expression.

Every row is handled by itself, so nothing but the pattern counts is shuffled. Offsets are code
points, ends exclusive. The patterns are written so that the engine neither
recurses nor re-scans a run of characters: possessive repeats, and look-behinds that let a
run be tried at its start (or where the match before it ended) only.

Defined cases: a null text is an empty one and has no spans; repeated rows are
handled one by one; proposals that overlap a base span are dropped; without proposals nothing
is added; an empty table gives an empty one; texts and tokens of any length are read whole. ``mask`` keeps
all columns of the caller, whatever their names and nulls, apart from its own working columns; a null text stays null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound_once
from .common import materialize

#: In the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone", "secret", "number")
BASE = KINDS[:4]

_MAIL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
HINTS = {"email": "@[A-Za-z0-9]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: A whole run of letters, digits and inner hyphens of 8 characters or more that holds a digit.
PROPOSAL = r"(?<![A-Za-z0-9-])(?=[A-Za-z-]*+[0-9])(?=[A-Za-z0-9])[A-Za-z0-9-]{8,}+(?<!-)"

# Cue words of the gazetteer labeler, lower case.
CUES = "password passwd pwd passphrase token secret key apikey api_key access_key credential bearer ssn passport iban account acct license_no tel phone mobile pin cvv".split()
INNOCENT = "version isbn issn page chapter section figure table volume license rfc iso commit revision".split()

LABELERS = ("shape", "gazetteer", "context", "alternation", "strict")
_SPAN = "array<struct<start:int,kind:int,stop:int,hit:string,before:string,after:string>>"


#: Elements that one fold goes through. Extending an array costs its length each time, so long arrays are folded in runs, and the runs' starts beside them.
RUN = 64


def _runs(items: Column) -> Column:
    """The array in parts of RUN elements, in order; one empty part for an empty array."""
    parts = lambda a: F.sequence(F.lit(0), F.greatest(F.floor((F.size(a) - 1) / RUN).cast("int"), F.lit(0)))
    return bound_once(items, lambda a: F.transform(parts(a), lambda i: F.slice(a, i * RUN + 1, RUN)))


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each whole number, the fold of those before it, from 0."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    more = lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(values, start, more, lambda acc: acc["out"])


def _hits(text: Column, pattern: str, hint: str, kind: int) -> Column:
    """All matches with their places. The text parted at the matches gives the gaps between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(hits, gaps, lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))

    def step(acc: Column, x: Column) -> Column:
        # the last pair has no hit: it only gives the characters after the last match
        start = acc["at"] + F.length(x["gap"])
        entry = F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["hit"])).alias("stop"), x["hit"].alias("hit"),
            F.right(x["gap"], F.lit(24)).alias("before"), F.lit("").alias("after"),
        )
        more = F.when(x["hit"].isNotNull(), F.concat(acc["out"], F.array(entry))).otherwise(acc["out"])
        return F.struct((start + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"), more.alias("out"))

    def placed(run: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("out"))
        return F.aggregate(run, start, step, lambda acc: acc["out"])

    size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))
    sizes = lambda runs: F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda acc, x: acc + size(x)))
    found = bound_once(_runs(pairs), lambda runs: F.flatten(F.zip_with(runs, _running(sizes(runs), lambda at, n: at + n), placed)))
    if kind >= len(BASE):
        follow = F.slice(gaps, F.lit(2), F.greatest(F.size(gaps), F.lit(1)))
        found = F.zip_with(found, follow, lambda x, gap: x.withField("after", F.left(gap, F.lit(2))))
    return F.when(text.rlike(hint), found).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


#: A part of an address, at most 255 as a number.
_PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

CHECKS = {
    "email": lambda hit: F.lit(True),
    "ip": lambda hit: hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda hit: F.length(_digits(hit)).between(14, 19) & F.call_function("luhn_check", _digits(hit)),
    "phone": lambda hit: F.length(_digits(hit)).between(10, 15),
}


def _votes(x: Column, strict: int) -> Column:
    """The labelers' votes on one span."""
    hit, low = x["hit"], F.lower(x["before"])
    shape = (
        F.when(hit.rlike(r"^AKIA[A-Z0-9]{16}$|^(?=.*[a-f])(?=.*[0-9])[0-9a-f]{16,}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,}$|^(?=.*[A-Z])(?=.*[0-9])[A-Z0-9]{16,}$"), 1)
        .when(hit.rlike(r"^[A-Za-z]+-?[0-9]{1,4}$|^[0-9]{1,4}-[A-Za-z]+$|^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), -1)
        .otherwise(0)
    )
    gazetteer = F.when(low.rlike(rf"(?:{'|'.join(CUES)})[\s=:\"']*$"), 1).when(low.rlike(rf"\b(?:{'|'.join(INNOCENT)})[\s:.#]*$"), -1).otherwise(0)
    context = F.when(low.rlike(r"[=:]\s*[\"']?$|[\"']$"), 1).when(low.rlike(r"[A-Za-z]\s$") & x["after"].rlike(r"^[,.;]?\s?[A-Za-z]"), F.lit(0)).when(low.rlike(r"[#/\\]$"), -1).otherwise(0)
    changes = F.regexp_count(hit, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"))
    varied = F.size(F.array_distinct(F.split(hit, "")))
    alternation = F.when((changes >= 2) & (varied >= 7), 1).when((changes <= 1) & (F.length(hit) < 12), -1).otherwise(0)
    values = (shape, gazetteer, context, alternation, F.lit(strict))
    return F.struct(*(v.cast("int").alias(n) for n, v in zip(LABELERS, values, strict=True)))


def _checked(kind: str) -> Column:
    return F.filter(f"__{kind}", lambda x: CHECKS[kind](x["hit"]))


def _apart(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base``; runs of base spans that lie elsewhere are passed over as a whole."""
    over = lambda x, y: (y["start"] < x["stop"]) & (x["start"] < y["stop"])
    least = lambda run: F.coalesce(F.array_min(F.transform(run, lambda y: y["start"])), F.lit(0))
    most = lambda run: F.coalesce(F.array_max(F.transform(run, lambda y: y["stop"])), F.lit(0))
    runs = F.transform(_runs(base), lambda run: F.struct(least(run).alias("start"), most(run).alias("stop"), run.alias("spans")))
    return bound_once(runs, lambda all_: F.filter(spans, lambda x: ~F.exists(all_, lambda run: over(x, run) & F.exists(run["spans"], lambda y: over(x, y)))))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, base spans, proposals with votes), one row per row; ``whole``: plus the row itself, as the struct ``row``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole else []
    out = docs.select(*row, F.col(id_col).alias("__id"), text.alias("__text"))
    for k, kind in enumerate(BASE):
        out = out.withColumn(f"__{kind}", _hits(F.col("__text"), PATTERNS[kind], HINTS[kind], k))
    out = out.withColumn("__more", _hits(F.col("__text"), PROPOSAL, "[0-9]", len(BASE)))
    for kind in BASE:
        out = out.withColumn(f"__{kind}", _checked(kind))
    out = out.withColumn("__base", F.array_sort(F.concat(*(f"__{kind}" for kind in BASE))))
    apart = _apart(F.col("__more"), F.col("__base"))
    number = len(BASE) + 1
    proposals = F.transform(
        apart,
        lambda x: F.struct(x["start"].alias("start"), F.when(x["hit"].rlike("[A-Za-z]"), len(BASE)).otherwise(number).alias("kind"), x["stop"].alias("stop"), _votes(x, -1).alias("votes")),
    )
    base = F.transform("__base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"), _votes(x, 1).alias("votes")))
    return out.select(*(["row"] if whole else []), F.col("__id").alias("doc_id"), base.alias("base"), proposals.alias("proposals"))


def pattern_counts(found: DataFrame) -> list[tuple[tuple[int, ...], int, float]]:
    """(votes, spans, mean length) of each pattern of votes; at most 3^5 rows."""
    spans = found.select(F.explode(F.concat("base", "proposals")).alias("x"))
    counts = spans.groupBy(*(F.col(f"x.votes.{n}").alias(n) for n in LABELERS)).agg(F.count("*").alias("n"), F.avg(F.col("x.stop") - F.col("x.start")).alias("size"))
    return sorted((tuple(r[n] for n in LABELERS), r["n"], r["size"]) for r in counts.collect())


def reliabilities(counts: list[tuple[tuple[int, ...], int, float]], rounds: int = 60) -> list[float]:
    """Probability that a span of each pattern is personal data, by expectation-maximisation.

    Labelers are independent given the class, each with its own distribution of votes.
    """
    p = [1 / (1 + math.exp(-1.5 * sum(v))) for v, _, _ in counts]
    for _ in range(rounds):
        yes = sum(n * q for (_, n, _), q in zip(counts, p, strict=True))
        no = sum(n * (1 - q) for (_, n, _), q in zip(counts, p, strict=True))
        prior = min(0.99, max(0.01, (yes + 1) / (yes + no + 2)))
        tables = []
        for k in range(len(LABELERS)):
            table = {}
            for vote in (-1, 0, 1):
                a = sum(n * q for (v, n, _), q in zip(counts, p, strict=True) if v[k] == vote)
                b = sum(n * (1 - q) for (v, n, _), q in zip(counts, p, strict=True) if v[k] == vote)
                # no labeler is trusted to err on the whole: a vote for never counts against
                r = ((a + 0.5) / (yes + 1.5)) / ((b + 0.5) / (no + 1.5))
                table[vote] = max(r, 1.0) if vote > 0 else min(r, 1.0) if vote < 0 else r
            tables.append(table)
        odds = [math.log(prior / (1 - prior)) + sum(math.log(t[x]) for t, x in zip(tables, v, strict=True)) for v, _, _ in counts]
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds]
    return p


def classifier(counts: list[tuple[tuple[int, ...], int, float]], p: list[float], steps: int = 4000) -> list[float]:
    """Logistic weights (votes, length, 1) fitted to the patterns' probabilities."""
    total = sum(n for _, n, _ in counts) or 1
    rows = [([*map(float, v), min(size, 40.0) / 40, 1.0], math.sqrt(n / total), q) for (v, n, size), q in zip(counts, p, strict=True)]
    w = [1.0] * len(LABELERS) + [0.0, 0.0]
    norm = sum(weight for _, weight, _ in rows) or 1.0
    for _ in range(steps):
        slope = [1e-4 * x for x in w]
        for x, weight, q in rows:
            miss = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True)))))) - q
            slope = [s + weight / norm * miss * a for s, a in zip(slope, x, strict=True)]
        w = [a - 2.0 * s for a, s in zip(w, slope, strict=True)]
    return w


def learn(found: DataFrame) -> list[float]:
    counts = pattern_counts(found)
    return classifier(counts, reliabilities(counts))


def _spelt(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def decide(found: DataFrame, weights: list[float]) -> DataFrame:
    """``found`` with the spans that stay: all base spans and the accepted proposals."""
    def margin(x: Column) -> Column:
        size = F.least(x["stop"] - x["start"], F.lit(40)) / 40
        return sum((F.lit(w) * x["votes"][n] for w, n in zip(weights, LABELERS, strict=False)), F.lit(weights[-1]) + F.lit(weights[-2]) * size)

    accepted = F.filter("proposals", lambda x: margin(x) > 0)
    bare = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))
    return found.withColumn("spans", F.array_sort(F.concat(bare(F.col("base")), bare(accepted))))


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of the base spans, their digest and all spans of every row."""
    found = materialize(find(docs))
    out = decide(found, learn(found))
    counts = [_count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return out.select("doc_id", *counts, F.sha2(_spelt(F.col("base")), 256).alias("base_sha256"), _spelt(F.col("spans")).alias("spans"))


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with the spans, ordered by start, replaced. Each run reads the part of the text from where those before it ended."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    end = lambda run: F.coalesce(F.array_max(F.transform(run, lambda x: x["stop"])), F.lit(0))

    def replaced(run: Column, at: Column) -> Column:
        def of(part: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                gap = F.substring(part, acc["at"] - at + 1, x["start"] - acc["at"])
                new = F.concat(acc["out"], gap, F.element_at(names, x["kind"] + 1))
                return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.when(x["start"] < acc["at"], acc["out"]).otherwise(new).alias("out"))

            return F.aggregate(run, F.struct(at.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

        return bound_once(F.substring(text, at + 1, F.greatest(end(run) - at, F.lit(0))), of)

    def whole(runs: Column) -> Column:
        parts = F.zip_with(runs, _running(F.transform(runs, end), F.greatest), replaced)
        return F.concat(F.array_join(parts, ""), F.substring(text, F.array_max(F.transform(runs, end)) + 1, F.length(text)))

    return bound_once(_runs(spans), whole)


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets; overlapping spans become one."""
    columns = docs.columns
    found = materialize(find(docs, whole=True))
    out = decide(found, learn(found))
    own = lambda c: F.col(f"row.`{c}`")
    masked = F.when(F.size("spans") > 0, _masked(F.coalesce(own("text"), F.lit("")), F.col("spans"))).otherwise(own("text"))
    return out.select(*((masked if c == "text" else own(c)).alias(c) for c in columns))
