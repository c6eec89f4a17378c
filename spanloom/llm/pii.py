"""Personal data: fixed patterns, and candidates judged by boosted trees.

Four kinds (email, ip, card, phone) have a base pattern with a validity test;
what passes is always reported. Beyond that, wide generators propose spans
that need not be valid and may overlap: addresses with "(at)", numbers with
unusual separators, phones without a plus sign. Gradient boosted trees score
every candidate by its format and its context, thresholds calibrated on rows
kept from training select, and of overlapping selected spans the best stays.

The trees learn from the base spans of the corpus: a span is an example, its
rewritten forms are further examples, and its broken forms (a digit changed,
a part too large, too short, no dot) are counter-examples. Everything is SQL
functions and Spark ML; texts are scanned once and only spans leave the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import isqrt

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.frames import col_of, stored

KINDS = ("email", "ip", "card", "phone")

#: Base patterns. They match what the plain forms in the contract match; runs are possessive and start
#: where a run starts or the last match ended, which keeps the search linear on very long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Runs of fewer than 12 digits fail the test anyway.
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){11}[0-9]", "phone": r"\+[0-9]"}

_AT = r"(?:\x20?@\x20?|\x20?[\[({<]\x20?(?:at|AT)\x20?[\])}>]\x20?|\x20(?:at|AT)\x20)"
_DOT = r"(?:\.|\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20)"
#: Generators of candidates. Numbers have one for every count of digits, so where a number runs into further
#: digits, each way to cut it that ends at a separator is proposed; such spans overlap.
WIDE = {
    "email": [rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"],
    "ip": [r"(?<![0-9.])[0-9]{1,3}+(?:\x20?[\[({]?[.,][\])}]?\x20?[0-9]{1,3}+){3}+(?![0-9])"],
    "card": [rf"(?<![0-9])[0-9](?:[\x20._/-]{{0,2}}+[0-9]){{{n - 1}}}+(?![0-9])" for n in range(12, 20)],
    "phone": [rf"(?<![0-9A-Za-z])(?:\+|00|\()?+[0-9](?:[\x20()./-]{{0,2}}+[0-9]){{{n - 1}}}+(?![0-9A-Za-z])" for n in range(7, 16)],
}
#: Without this a text has no candidate: each holds wherever a generator of the kind does.
WIDE_GUARD = {"email": rf"@|[\[({{<]\x20?(?:at|AT)\x20?[\])}}>]|\x20(?:at|AT)\x20[A-Za-z0-9-]++{_DOT}", "ip": r"[0-9]\x20?[\[({]?[.,][\])}]?\x20?[0-9]",
              "card": r"(?:[0-9][\x20._/-]{0,2}+){11}[0-9]", "phone": r"(?:[0-9][\x20()./-]{0,2}+){6}[0-9]"}
CONTEXT = {"email": r"(?i)e-?mail|contact|write|address|reach", "ip": r"(?i)\bip\b|host|server|addr|from", "card": r"(?i)card|visa|credit|pay|account",
           "phone": r"(?i)phone|tel|call|mobile|fax|dial"}

#: Number and depth of the trees.
TREES, DEPTH = 10, 4
#: Precision that a threshold must reach on the calibration rows of its kind.
PRECISION = 0.98


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits pass the Luhn test."""
    ds = F.transform(F.filter(F.split(F.reverse(digits_of(match)), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    n = F.length(digits_of(match))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
        return match.rlike(rf"\A{part}(?:\.{part}){{3}}\z")
    if kind == "card":
        return n.between(12, 19) & luhn(match)
    return n.between(9, 15)


_SPAN = "array<struct<kind:int,start:int,end:int,match:string,before:string,after:string>>"


#: Lengths that are added up in one fold; longer arrays are folded in slices of this size.
_SLICE = 512


def running(lengths: Column) -> Column:
    """Sums of an array up to and with each element.

    A fold copies its array at every step, so slices are folded on their own and get the sum of all earlier slices added.
    """
    fold = lambda xs: F.aggregate(xs, F.array().cast("array<int>"), lambda done, x: F.array_append(done, F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + x))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda done, x: done + x)
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _SLICE).cast("int")), lambda i: F.slice(lengths, i * _SLICE + 1, _SLICE))
    before = lambda parts: F.concat(F.array(F.lit(0)), fold(F.transform(parts, total)))
    return F.flatten(F.zip_with(F.transform(slices, fold), F.slice(before(slices), 1, F.size(slices)), lambda own, earlier: F.transform(own, lambda x: x + earlier)))


def _matches(df: DataFrame, text: str, name: str, kind: int, regex: str, guard: Column) -> DataFrame:
    """Adds the column ``name``: the matches with code point positions.

    What lies between the matches comes from a split by the same pattern;
    positions are running lengths.
    """
    none = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(guard, F.regexp_extract_all(text, F.lit(regex), F.lit(0))).otherwise(none))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split(F.col(text), regex, -1)).otherwise(none))
    df = df.withColumn("_e", F.when(F.size("_m") > 0, running(F.zip_with(F.slice("_p", 1, F.size("_m")), "_m", lambda p, m: F.length(p) + F.length(m)))))
    at = lambda end, i: F.struct(
        F.lit(kind).alias("kind"), (end - F.length(F.get("_m", i))).alias("start"), end.alias("end"), F.get("_m", i).alias("match"),
        F.right(F.get("_p", i), F.lit(24)).alias("before"), F.left(F.get("_p", i + 1), F.lit(12)).alias("after"))
    return df.withColumn(name, F.when(F.size("_m") > 0, F.transform("_e", at).cast(_SPAN)).otherwise(F.array().cast(_SPAN))).drop("_m", "_p", "_e")


def scan(df: DataFrame, id: str, text: str) -> DataFrame:
    """A row per text: ``row`` (unique), ``doc_id``, base ``spans`` and ``candidates``, by start, then kind."""
    out = df.select(F.monotonically_increasing_id().alias("row"), col_of(df, id).alias("doc_id"), F.coalesce(col_of(df, text), F.lit("")).alias("_text"))
    wide = []
    for no, kind in enumerate(KINDS):
        out = _matches(out, "_text", f"_b{no}", no, BASE[kind], F.col("_text").rlike(GUARD[kind]))
        out = out.withColumn(f"_g{no}", F.col("_text").rlike(WIDE_GUARD[kind]))
        for i, regex in enumerate(WIDE[kind]):
            wide.append(f"_w{no}_{i}")
            out = _matches(out, "_text", wide[-1], no, regex, F.col(f"_g{no}"))
    passing = lambda no, kind: F.filter(f"_b{no}", lambda s: valid(kind, s["match"]))
    base = F.concat(*[passing(no, kind) for no, kind in enumerate(KINDS)])
    by_place = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s.alias("s")))), lambda o: o["s"])
    return out.select("row", "doc_id", by_place(base).alias("spans"), F.concat(*wide).alias("candidates"))


@dataclass(frozen=True)
class Judge:
    """Fitted trees and a threshold for every kind; no trees when the corpus had nothing to learn from."""

    model: object | None
    thresholds: dict[int, float]


def described(spans: DataFrame) -> DataFrame:
    """Adds the vector ``features`` to rows with ``kind``, ``match``, ``before`` and ``after``."""
    m, before, after = F.col("match"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    count = lambda rx: F.regexp_count(m, F.lit(rx)).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    numbers = F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda x: F.least(F.length(x), F.lit(9)) * 0 + F.substring(x, 1, 9).cast("double"))
    named = {
        **{f"is_{kind}": flag(F.col("kind") == no) for no, kind in enumerate(KINDS)},
        "length": F.length(m).cast("double"), "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "groups": count("[0-9]+"), "dots": count(r"[.]|(?i)\bdot\b"),
        "at": flag(m.rlike(r"@|(?i)\bat\b")), "plus": flag(m.startswith("+")), "brackets": count(r"[()\[\]{}<>]"), "odd_separators": count("[_/,]"),
        "luhn": flag((F.length(digits_of(m)) >= 12) & luhn(m)), "largest": F.least(F.coalesce(F.array_max(numbers), F.lit(0.0)), F.lit(1000.0)),
        "longest_group": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x).cast("double"))), F.lit(0.0)),
        "glued_left": flag(before.rlike(r"[A-Za-z0-9]\z")), "glued_right": flag(after.rlike(r"\A[A-Za-z0-9]")),
        "said": flag(reduce(lambda a, b: a | b, [(F.col("kind") == no) & before.rlike(CONTEXT[kind]) for no, kind in enumerate(KINDS)])),
    }
    rows = spans.withColumns({f"x_{k}": v for k, v in named.items()})
    return VectorAssembler(inputCols=[f"x_{k}" for k in named], outputCol="features").transform(rows).drop(*[f"x_{k}" for k in named])


def examples(spans: DataFrame) -> DataFrame:
    """Base spans, their rewritten forms (label 1) and their broken forms (label 0)."""
    m, kind = F.col("match"), F.col("kind")
    pick = lambda *forms: reduce(lambda c, nf: c.when(kind == nf[0], nf[1]), enumerate(forms[1:], 1), F.when(kind == 0, forms[0]))
    good = pick(F.concat(F.substring_index(m, "@", 1), F.lit(" (at) "), F.replace(F.substring_index(m, "@", -1), F.lit("."), F.lit(" dot "))), F.replace(m, F.lit("."), F.lit("[.]")),
                F.regexp_replace(digits_of(m), "([0-9]{4})(?=[0-9])", "$1."), F.regexp_replace(m, r"\A\+[0-9]{1,2}\x20?", ""))
    wrong_end = F.translate(F.right(m, F.lit(1)), "0123456789", "1234567890")
    bad = pick(F.regexp_replace(m, r"\..*\z", ""), F.concat(F.lit("999"), m), F.concat(F.left(m, F.length(m) - 1), wrong_end), F.left(m, F.lit(6)))
    worse = pick(F.concat(F.regexp_extract(m, "@(.*)", 1), F.lit(" at work")), F.regexp_replace(m, r"\.[0-9]+\z", ".256"), F.left(m, F.lit(11)), F.concat(m, F.lit(" 555 555 555")))
    forms = F.array(*[F.struct(f.alias("match"), F.lit(y).alias("label")) for f, y in ((m, 1.0), (good, 1.0), (bad, 0.0), (worse, 0.0))])
    return spans.withColumn("_e", F.explode(forms)).select("kind", F.col("_e.match").alias("match"), "before", "after", F.col("_e.label").alias("label"), F.xxhash64("match").alias("origin"))


def fit(spans: DataFrame) -> Judge:
    """Trees from the examples of all distinct spans; a fifth of them, by hash, only calibrates.

    ``spans`` are base spans with ``kind``, ``match``, ``before``, ``after``.
    A kind whose precision reaches ``PRECISION`` at no threshold adds nothing.
    """
    distinct = spans.groupBy("kind", "match").agg(F.min("before").alias("before"), F.min("after").alias("after"))
    table = stored(described(examples(distinct)), "pii_examples")
    train, hold = table.filter(F.pmod("origin", F.lit(5)) != 0), table.filter(F.pmod("origin", F.lit(5)) == 0)
    if len(train.select("label").distinct().collect()) < 2 or not hold.take(1):
        return Judge(None, {})
    # Split points are proposed from the square of the bins in rows, at least 10,000: this many bins let all rows propose.
    # Features have few distinct values, and no more bins than those are made.
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=max(32, isqrt(train.count()) + 1), seed=7).fit(train)
    scored = model.transform(hold).select("kind", "label", vector_to_array("probability")[1].alias("p"))
    steps = [0.5 + 0.05 * i for i in range(10)]
    sums = scored.groupBy("kind").agg(*[x for i, t in enumerate(steps) for x in (
        F.count(F.when(F.col("p") >= t, 1)).alias(f"n{i}"), F.count(F.when((F.col("p") >= t) & (F.col("label") == 1), 1)).alias(f"y{i}"))]).collect()
    thresholds = {}
    for r in sums:
        fine = [t for i, t in enumerate(steps) if r[f"n{i}"] and r[f"y{i}"] >= PRECISION * r[f"n{i}"]]
        if fine:
            thresholds[r["kind"]] = fine[0]
    return Judge(model, thresholds)


def detect(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per text: ``doc_id``, base ``spans`` and ``added`` spans, arrays of kind number, start, end.

    Null and empty texts have none. Repeated rows and equal or null ids give
    a row each. Positions are code points, ends exclusive. Added spans
    overlap no base span and, of those that overlap each other, the likeliest
    stays, ties by length and place. Very long texts are searched whole. With nothing to learn from, or an
    empty table, nothing is added.
    """
    found = stored(scan(df, id, text), "pii_spans")
    judge = fit(found.select(F.explode("spans").alias("s")).select("s.*"))
    place = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = found.select("row", "doc_id", place("spans").alias("spans"))
    if judge.model is None or not judge.thresholds:
        return base.select("doc_id", "spans", F.slice("spans", 1, 0).alias("added"))
    # A candidate is open when no base span begins before its end and ends behind its start.
    spans = found.select("row", F.explode("spans").alias("c"), F.lit(True).alias("base"))
    both = spans.unionByName(found.select("row", F.explode("candidates").alias("c"), F.lit(False).alias("base"))).select("row", "c.*", "base")
    place_ = Window.partitionBy("row").orderBy("start")
    behind, ahead = place_.rangeBetween(Window.unboundedPreceding, -1), place_.rangeBetween(0, Window.unboundedFollowing)
    open_ = both.withColumns({"_end": F.max(F.when(F.col("base"), F.col("end"))).over(behind), "_next": F.min(F.when(F.col("base"), F.col("start"))).over(ahead)}).filter(
        ~F.col("base") & (F.coalesce("_end", F.lit(0)) <= F.col("start")) & ~F.coalesce(F.col("_next") < F.col("end"), F.lit(False))).drop("base", "_end", "_next")
    limit = reduce(lambda c, kt: c.when(F.col("kind") == kt[0], kt[1]), judge.thresholds.items(), F.when(F.lit(False), 0.0))
    scored = judge.model.transform(described(open_)).withColumn("p", vector_to_array("probability")[1]).filter(F.col("p") >= limit)
    # Spans that touch others, over any number of steps, are one run; what stays is decided run by run.
    ends = F.max("end").over(place_.rowsBetween(Window.unboundedPreceding, -1))
    runs = scored.select("row", "start", "end", "kind", "p", F.coalesce(F.col("start") >= ends, F.lit(True)).cast("int").alias("first")).withColumn("run", F.sum("first").over(place_.rowsBetween(Window.unboundedPreceding, 0)))
    # By likelihood, then the longest, then place: a span stays when none before it that stays overlaps it.
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    of_run = runs.groupBy("row", "run").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("rank"), (F.col("start") - F.col("end")).alias("size"), "start", "end", "kind"))).alias("all"))
    chosen = F.aggregate("all", F.array().cast("array<struct<kind:int,start:int,end:int>>"), lambda kept, c: F.when(
        F.exists(kept, lambda k: overlap(k, c)), kept).otherwise(F.array_append(kept, F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))))
    ranked = of_run.select("row", chosen.alias("added")).groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("added"))).alias("added"))
    return base.join(ranked, "row", "left").select("doc_id", "spans", F.coalesce("added", F.slice("spans", 1, 0)).alias("added"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(df: DataFrame, id: str = "doc_id", text: str = "text", mark: str = "<{}>") -> DataFrame:
    """``doc_id`` and the text with every span (base and added) replaced by its kind; one text per id is expected."""
    spans = detect(df, id, text).select("doc_id", F.array_sort(F.transform(F.concat("spans", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans"))
    source = df.select(col_of(df, id).alias("_id"), F.coalesce(col_of(df, text), F.lit("")).alias("_text"))
    marks = F.array(*[F.lit(mark.format(k)) for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(
        s["end"].alias("at"), F.concat(a["out"], F.substr(F.col("_text"), a["at"] + 1, s["start"] - a["at"]), F.get(marks, s["kind"])).alias("out")))
    done = source.join(spans, F.col("_id").eqNullSafe(F.col("doc_id"))).withColumn("_r", F.aggregate("spans", zero, step))
    return done.select("doc_id", F.concat("_r.out", F.substr(F.col("_text"), F.col("_r.at") + 1)).alias("text"))
