"""Quality rules under weak supervision.

DataFrame functions only.  Each rule votes for good, for bad, or abstains.  Expectation-maximisation over the counts of
vote patterns estimates how far each rule can be trusted, without labels; a document is kept if the posterior
probability of good is high enough, and not only if it passes every rule.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import free_prefix, quoted
from .storage import Scratch

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
ROUNDS = 12
#: A bad vote is at least so many times as likely on bad texts as on good ones, and a good vote never likelier on bad
#: texts; so good and bad can't change places.
LEAN = 3.0
PRIOR_GOOD, KEEP_FROM = 0.8, 0.5
RULES = (
    "words", "symbols", "word_length", "lines", "repeats", "capitals", "stutter", "shouts", "plain", "density", "variety"
)
#: Where the estimates start: chances of a good and of a bad vote on good texts, then on bad ones.
START = ((0.75, 0.02), (0.25, 0.5))


def statistics(docs: DataFrame, p: str) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), and what else the rules read in columns
    that begin with p."""
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = [quoted(c) for c in docs.columns if c.lower() not in new]
    text = F.col(f"{p}text")
    found = docs.withColumn(f"{p}text", F.coalesce("text", F.lit("")))
    found = found.withColumns(
        {
            f"{p}words": F.array_remove(F.split(text, SPACE), ""),
            f"{p}lines": F.filter(F.split(text, "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]")),
        }
    )
    found = found.withColumn(f"{p}1", F.transform(f"{p}words", lambda w: F.xxhash64(w)))
    for half in (1, 2, 4):
        n = F.greatest(F.size(f"{p}{half}") - half, F.lit(0))
        whole = F.col(f"{p}{half}")
        doubled = F.zip_with(F.slice(whole, F.lit(1), n), F.slice(whole, F.lit(1 + half), n), lambda a, b: F.xxhash64(a, b))
        found = found.withColumn(f"{p}{2 * half}", doubled)
    windows = F.col(f"{p}8")
    twice = F.size(F.array_distinct(windows)) < F.size(windows)
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = found.withColumn(f"{p}sorted", F.when(twice, ordered))
    same = lambda k, h: F.coalesce(F.get(F.col(f"{p}sorted"), k)["h"] == h, F.lit(False))
    repeated = F.filter(f"{p}sorted", lambda x, k: F.when(k > 0, same(k - 1, x["h"])).otherwise(False) | same(k + 1, x["h"]))
    starts = F.array_sort(F.transform(repeated, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
    )["n"]
    first = F.col(f"{p}1")
    stutter = F.filter(first, lambda h, k: (k > 0) & (h == F.get(first, F.greatest(k - 1, F.lit(0)))))
    return found.select(
        *names,
        F.size(f"{p}words").cast("long").alias("n_words"),
        F.length(F.array_join(f"{p}words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col(f"{p}sorted").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(f"{p}lines").alias(f"{p}n_lines"),
        F.regexp_count(text, F.lit("[A-Z]")).alias(f"{p}capitals"),
        F.regexp_count(text, F.lit("!")).alias(f"{p}shouts"),
        F.size(stutter).alias(f"{p}stutter"),
        F.regexp_count(text, F.lit("(?:^|(?<=[\\x20\\x09-\\x0D]))[\\p{L}'-]+[.,;:!?]?(?=[\\x20\\x09-\\x0D]|$)")).alias(f"{p}plain"),
        F.regexp_count(text, F.lit("[\\p{L}\\p{N}]")).alias(f"{p}letters"),
        F.size(F.array_distinct(first)).alias(f"{p}distinct"),
    )


def votes(p: str) -> list[Column]:
    """1 for good, 0 for bad, null to abstain, in the order of RULES."""
    n, chars = F.col("n_words"), F.col("word_chars")
    per_word = lambda c: F.try_divide(F.col(c), n)
    two_sided = lambda x, good, bad: F.when(x >= bad, 0).when(x <= good, 1)
    length = F.try_divide(chars, n)
    return [
        F.when(n >= 40, 1).when(n < 20, 0),
        two_sided(per_word("n_symbols"), 0.02, 0.1),
        F.when(length.between(3, 9), 1).when((length < 2) | (length > 14), 0),
        two_sided(F.try_divide("n_dup_lines", F.col(f"{p}n_lines")), 0.1, 0.4),
        two_sided(per_word("n_repeat_words"), 0.05, 0.3),
        two_sided(F.try_divide(f"{p}capitals", chars), 0.2, 0.5),
        two_sided(per_word(f"{p}stutter"), 0.05, 0.2),
        two_sided(per_word(f"{p}shouts"), 0.05, 0.2),
        two_sided(1 - per_word(f"{p}plain"), 0.1, 0.3),
        two_sided(1 - F.try_divide(f"{p}letters", chars), 0.05, 0.12),
        F.when((n >= 40) & (per_word(f"{p}distinct") < 0.3), 0).when(per_word(f"{p}distinct") >= 0.4, 1),
    ]


def _log_odds(columns: list[Column], trust: list, prior: float) -> Column:
    """Log-odds of good.  trust: for each rule the chances of a good and of a bad vote, on good texts and on bad ones."""
    total = F.lit(log(prior / (1 - prior)))
    for vote, ((a, b), (c, d)) in zip(columns, trust, strict=True):
        total = total + F.when(vote == 1, log(a / c)).when(vote == 0, log(b / d)).otherwise(log((1 - a - b) / (1 - c - d)))
    return total


def _leaning(good: list[float], bad: list[float]) -> tuple:
    """Chances of votes from weights (good vote, bad vote, abstained), smoothed and kept apart as LEAN says."""
    (a, b), (c, d) = (tuple((x + 1) / (sum(v) + 3) for x in v[:2]) for v in (good, bad))
    if d < LEAN * b:
        b, d = min(b, 0.9 / LEAN), max(d, LEAN * min(b, 0.9 / LEAN))
        c = min(c, (1 - d) / 2)
    c = min(c, a)
    return (a, b), (c, d)


def fit(voted: DataFrame, names: list[str], scratch: Scratch) -> tuple[list, float]:
    """Chances of each rule's votes and the share of good documents, from the columns that hold the votes.

    The table of patterns has at most 3**11 rows, whatever the input; each round sums over it and sends one row.
    """
    patterns = scratch.keep(voted.groupBy(*names).agg(F.count("*").alias("n")), "patterns")
    columns, trust, prior = [F.col(c) for c in names], [START] * len(RULES), PRIOR_GOOD
    for _ in range(ROUNDS):
        good = 1 / (1 + F.exp(-_log_odds(columns, trust, prior)))
        weighed = patterns.withColumns({"good": good * F.col("n"), "bad": (1 - good) * F.col("n")})
        sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
        for k, c in enumerate(columns):
            for side in ("good", "bad"):
                sums += [F.sum(F.when(c == v, F.col(side)).otherwise(0.0)).alias(f"{side}_{k}_{v}") for v in (1, 0)]
        row = weighed.agg(*sums).first()
        if row.good is None:
            break
        rest = lambda s, k: max(0.0, row[s] - row[f"{s}_{k}_1"] - row[f"{s}_{k}_0"])
        weights = lambda s, k: [row[f"{s}_{k}_1"], row[f"{s}_{k}_0"], rest(s, k)]
        trust = [_leaning(weights("good", k), weights("bad", k)) for k in range(len(RULES))]
        prior = min(0.99, max(0.5, row.good / (row.good + row.bad)))
    scratch.drop("patterns")
    return trust, prior


def judge(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The columns of docs but the text, the five statistics, base_failed, probability_good and kept.

    A null text counts as empty: it has no word and so fails.  base_failed: fewer than 20 words, or more than 30 % of
    them in repeated windows; such documents are never kept, others if the posterior reaches KEEP_FROM.  Columns of docs
    that are named as results are replaced, all others stay.  Equal texts have equal results.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    p, taken = free_prefix(docs, "rule_"), {"text", *own, "base_failed", "probability_good", "kept"}
    kept = [quoted(c) for c in docs.columns if c.lower() not in taken]
    marks = [f"{p}vote_{r}" for r in RULES]
    # Statistics are computed once; the text itself isn't written.
    voted = scratch.keep(statistics(docs, p).withColumns(dict(zip(marks, votes(p), strict=True))).select(*kept, *own, *marks), "voted")
    trust, prior = fit(voted, marks, scratch)
    good = 1 / (1 + F.exp(-_log_odds([F.col(c) for c in marks], trust, prior)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    keeps = ~F.col("base_failed") & (F.col("probability_good") >= KEEP_FROM)
    out = voted.withColumns({"base_failed": failed, "probability_good": good}).withColumn("kept", keeps)
    return out.select(*kept, *own, "base_failed", "probability_good", "kept")
