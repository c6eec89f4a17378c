"""Quality rules by weak supervision.

Rules look at countable features of a text and vote good or bad, or abstain.
Nobody says which texts are good: expectation-maximisation estimates, from
the agreement of the votes over all texts, how the votes of every rule fall
on good and on bad texts. A text stays when the posterior probability that it
is good reaches a threshold, and no hard limit is broken.

The features are SQL functions. As votes are discrete, the corpus enters the
estimation as counts of vote patterns: one aggregation whose size depends on
the rules, not on the texts, and EM on those counts equals EM on the texts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.frames import SPACE_CLASS, col_of, fresh, stored, words_of

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
GOOD, BAD, ABSTAIN = 1, 0, 2

#: Base limits: fewer words, or a larger share of words in repeated windows, fail.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


Table = tuple[tuple[float, float, float], tuple[float, float, float]]


@dataclass(frozen=True)
class Rule:
    """A vote from a share of two features: bad on one side, good on the other, else abstain."""

    name: str
    part: str
    whole: str
    bad_from: float | None = None
    good_to: float | None = None
    bad_to: float | None = None
    good_from: float | None = None

    def prior(self) -> Table:
        """What the rule is held to do before any text was seen: votes bad, good, abstain on bad and on good texts.

        A vote it never casts has no share of either.
        """
        speaks = self.good_to is not None or self.good_from is not None
        return ((0.2, 0.7, 0.1), (0.001, 0.9, 0.099)) if speaks else ((0.15, 0.0, 0.85), (0.001, 0.0, 0.999))

    def vote(self) -> Column:
        whole = F.col(self.whole)
        share = F.col(self.part) / whole
        vote = F.when(whole <= 0, ABSTAIN)
        for limit, test, value in ((self.bad_from, share.__ge__, BAD), (self.bad_to, share.__le__, BAD),
                                   (self.good_to, share.__le__, GOOD), (self.good_from, share.__ge__, GOOD)):
            if limit is not None:
                vote = vote.when(test(F.lit(limit)), value)
        return vote.otherwise(ABSTAIN).cast("int")


#: Most rules know one kind of junk and are silent on everything else: their silence says little for a text.
RULES = (
    Rule("symbols", "n_symbols", "n_words", bad_from=0.10, good_to=0.02),
    Rule("shouting", "n_upper", "word_chars", bad_from=0.40),
    Rule("exclamation", "n_exclaim", "n_words", bad_from=0.30),
    Rule("digits", "n_digits", "word_chars", bad_from=0.25),
    Rule("repeated_words", "n_repeat_words", "n_words", bad_from=0.20),
    Rule("repeated_lines", "n_dup_lines", "n_lines", bad_from=0.40),
    Rule("word_length", "word_chars", "n_words", bad_from=14.0, bad_to=2.0),
    Rule("sentences", "n_stops", "n_words", bad_from=0.45, good_from=0.02),
)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count(text: Column, character_class: str) -> Column:
    """How many code points of the text the class matches."""
    return F.regexp_count(text, F.lit(character_class)).cast("long")


def features(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts of every text (null counts as empty).

    A window of eight words is compared by a 64-bit hash of its words. Only
    texts in which a hash comes twice sort their windows; the words covered
    by repeated windows are then the gaps between their starts, eight at most.
    All of it happens in the row: no window leaves its text.
    """
    internal = ["_text", "_h", "_w", "_rep", "_p", "_lines"]
    if clash := {c.lower() for c in keep} & {c.lower() for c in internal + COUNTS + EXTRA}:
        raise ValueError(f"columns {sorted(clash)} are in the way of features; rename them")
    base = df.select(*[col_of(df, c).alias(c) for c in keep], F.coalesce(col_of(df, text), F.lit("")).alias("_text"))
    t = F.col("_text")
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in keep]
    one = base.select(*kept, "_text", F.transform(words_of(t), lambda w: F.xxhash64(w)).alias("_h"))
    two = one.select(*kept, "_text", "_h", F.when(
        F.size("_h") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_h"), i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>")).alias("_w"))
    three = two.select(*kept, "_text", F.size("_h").alias("_n"), F.when(
        F.size(F.array_distinct("_w")) < F.size("_w"), F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_rep"))
    four = three.select(*kept, "_text", "_n", F.sort_array(F.transform(
        F.filter("_rep", lambda s, k: (F.coalesce(F.get("_rep", k - 1)["h"] == s["h"], F.lit(False)))
                 | F.coalesce(F.get("_rep", k + 1)["h"] == s["h"], F.lit(False))),
        lambda s: s["i"])).alias("_p"),
        F.filter(F.split(t, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    return four.select(
        *kept,
        F.col("_n").cast("long").alias("n_words"),
        (F.length(t) - _count(t, SPACE_CLASS)).cast("long").alias("word_chars"),
        _count(t, SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(F.transform("_p", lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - v, F.lit(WINDOW)))),
                    F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        _count(t, "[A-Z]").alias("n_upper"), _count(t, "!").alias("n_exclaim"), _count(t, "[0-9]").alias("n_digits"),
        _count(t, "[.?!]").alias("n_stops"))


RESULT = [*COUNTS, "base_failed", "quality", "kept"]
EXTRA = ["n_lines", "n_upper", "n_exclaim", "n_digits", "n_stops"]


@dataclass(frozen=True)
class VoteModel:
    """Class balance and, for every rule, the probabilities of its votes on bad and on good texts."""

    prior: float
    tables: tuple[Table, ...]

    def posterior(self, votes: tuple[int, ...]) -> float:
        bad, good = math.log(1 - self.prior), math.log(self.prior)
        for v, (on_bad, on_good) in zip(votes, self.tables):
            # A vote that neither class was ever seen or held to cast tells nothing.
            if on_bad[v] and on_good[v]:
                bad += math.log(on_bad[v])
                good += math.log(on_good[v])
        return 1 / (1 + math.exp(max(-700.0, min(700.0, bad - good))))


#: Texts that the tables of votes held before are worth, whatever the size of the corpus, and the share of good ones.
PRIOR_TEXTS, PRIOR_GOOD = 1000, 0.8
#: Share of good texts on which a rule votes bad at most; rules are made so, and EM is held to it.
FALSE_ALARMS = 0.001


def fit(patterns: dict[tuple[int, ...], int], priors: Sequence[Table], rounds: int = 60, texts: float = PRIOR_TEXTS, alarms: float = FALSE_ALARMS) -> VoteModel:
    """EM over vote patterns with counts.

    Starts at the ``priors`` of the rules and keeps them as pseudo-counts worth
    ``texts`` texts. Rules about different kinds of junk seldom agree, and on
    agreement alone the commonest kind would become the class and the others
    good; so in every round no rule may vote bad on more than ``alarms`` of
    the good texts. How often it does on bad ones, and how many of those there
    are, is up to the corpus. Texts without any vote tell little; no texts at
    all leave the priors.
    """
    model = VoteModel(PRIOR_GOOD, tuple(priors))
    for _ in range(rounds):
        mass = [(1 - PRIOR_GOOD) * texts, PRIOR_GOOD * texts]
        seen = [[[held * p for p in side] for held, side in zip(mass, rule)] for rule in priors]
        for votes, n in patterns.items():
            good = model.posterior(votes)
            for side, share in ((0, n * (1 - good)), (1, n * good)):
                mass[side] += share
                for r, v in enumerate(votes):
                    seen[r][side][v] += share
        tables = tuple((_shares(bad), _bounded(_shares(good), alarms)) for bad, good in seen)
        model = VoteModel(mass[1] / sum(mass), tables)
    return model


def _shares(counts: list[float]) -> tuple[float, float, float]:
    return tuple(x / sum(counts) for x in counts)


def _bounded(shares: tuple[float, float, float], most: float) -> tuple[float, float, float]:
    """Shares with at most ``most`` of the first; the others grow alike."""
    if shares[BAD] <= most:
        return shares
    return tuple(most if v == BAD else x * (1 - most) / (1 - shares[BAD]) for v, x in enumerate(shares))


def judge(df: DataFrame, text: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> tuple[DataFrame, VoteModel]:
    """Features, votes and verdict of every row, and the fitted model.

    Returns the columns ``keep`` (default: all but those named like a result), the counts, ``base_failed``,
    ``quality`` (posterior probability of good, double) and ``kept``. Null and
    empty texts have no words and fail the base. Repeated rows and equal ids
    are judged one by one. An empty table gives an empty result. Features are
    computed once and stored, as estimating and judging both read them.
    """
    keep = [c for c in df.columns if c.lower() not in RESULT] if keep is None else keep
    names = {c: fresh(df, f"_k{i}") for i, c in enumerate(keep)}
    renamed = df.select(*[col_of(df, c).alias(n) for c, n in names.items()], col_of(df, text).alias("_source"))
    table = stored(coded(renamed, "_source", list(names.values()), rules), "quality")
    model, known = learned(table, rules)
    result = verdicts(table, known, threshold)
    return result.select(*[F.col(n).alias(c) for c, n in names.items()], *COUNTS, "base_failed", "quality", "kept"), model


def coded(df: DataFrame, text: str, keep: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``features`` and ``_code``, the votes of all rules in one number."""
    code = F.lit(0)
    for rule in rules:
        code = code * 3 + rule.vote()
    return features(df, text, keep).withColumn("_code", code.cast("int"))


def learned(table: DataFrame, rules: tuple[Rule, ...]) -> tuple[VoteModel, DataFrame]:
    """The model of a table of ``_code``, and the ``quality`` of every code that occurs."""
    # At most 3 ** rules rows, whatever the corpus.
    patterns = {_votes(r["_code"], len(rules)): r["n"] for r in table.groupBy("_code").agg(F.count("*").alias("n")).collect()}
    model = fit(patterns, [rule.prior() for rule in rules])
    return model, table.sparkSession.createDataFrame([(_code(v), model.posterior(v)) for v in patterns], "_code int, quality double")


def verdicts(table: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Adds ``quality``, ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    result = table.join(F.broadcast(known), "_code").withColumn("base_failed", failed)
    return result.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def kept_rows(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that are kept, with the columns they came with.

    Null and empty ones go; repeated rows stay or go together.
    """
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    renamed = df.select(*[col_of(df, c).alias(n) for c, n in names.items()])
    judged, _ = judge(renamed, names[text], list(names.values()), threshold=threshold)
    return judged.filter("kept").select(*[F.col(n).alias(c) for c, n in names.items()])


def _votes(code: int, rules: int) -> tuple[int, ...]:
    votes = []
    for _ in range(rules):
        code, v = divmod(code, 3)
        votes.append(v)
    return tuple(reversed(votes))


def _code(votes: tuple[int, ...]) -> int:
    code = 0
    for v in votes:
        code = code * 3 + v
    return code
