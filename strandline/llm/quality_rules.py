"""Quality rules as weak supervision.

DataFrame functions only. Each rule votes good, bad or abstains on a document. Rules are taken as independent given
the unknown quality; expectation-maximisation estimates each rule's accuracy and the share of good documents, and the
posterior probability of good quality decides instead of "all rules must pass".

Scale: one pass over the texts writes a few numbers a document. The estimation works on counts of vote patterns, of
which there are at most 3 to the number of rules whatever the input; these counts (no documents) go to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, save, words, work_dir

SYMBOLS = "#*$%&|<>"
RULES = ("length", "word_length", "symbols", "duplicate_lines", "repeated_words", "line_ends", "prose")


def measures(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` and the counts the rules use, for whole texts; a null text counts as empty.

    n_repeat_words: words inside 3-word windows that stand twice or more in the text. The windows are hashed to 64 bits
    and sorted with their places, so that even a text of one repeated line costs n log n.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*carry, text.alias("t"))
    df = df.select(*carry, "t", words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("l"))
    windows = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    bare = F.translate("t", SYMBOLS, "")
    ended = F.filter("l", lambda x: F.btrim(x, F.lit(WHITE)).rlike("[.!?:;\"')…。]$"))
    df = df.select(
        *carry,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(bare)).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size(ended).cast("long").alias("n_ended_lines"),
        windows.alias("g"),
    )
    # Sorted windows with their places, only where some window stands twice.
    twice = F.size(F.array_distinct("g")) < F.size("g")
    df = df.withColumn("s", F.when(twice, F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("g")
    same = lambda s, x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i + 1 < F.size(s)) & (F.get(s, i + 1)["h"] == x["h"]))
    df = df.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda x, i: same(F.col("s"), x, i)), lambda x: x["i"]))).drop("s")
    covered = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("p")


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))

    def bad(when: Column) -> Column:
        return F.when(when, -1).otherwise(0)

    def good(when: Column) -> Column:
        return F.when(when, 1).otherwise(0)

    mean = F.col("word_chars") / n
    return {
        "length": bad(F.col("n_words") < 50),
        "word_length": bad((mean < 2.5) | (mean > 12)),
        "symbols": bad(F.col("n_symbols") > 0.1 * n),
        "duplicate_lines": bad((F.col("n_dup_lines") > 0.3 * lines) & (F.col("n_dup_lines") >= 3)),
        "repeated_words": bad(F.col("n_repeat_words") > 0.4 * n),
        "line_ends": F.when(F.col("n_ended_lines") < 0.1 * lines, -1).when(F.col("n_ended_lines") >= 0.5 * lines, 1).otherwise(0),
        "prose": good(mean.between(3, 9) & (F.col("n_symbols") <= 0.02 * n) & (F.col("n_repeat_words") <= 0.35 * n)),
    }


VOTES = (-1, 0, 1)
Rates = list[dict[int, tuple[float, float]]]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 50, weight: float = 0.02, priors: dict[int, dict[int, tuple[float, float]]] | None = None) -> tuple[float, Rates]:
    """(share of good, for each rule and vote its probability among bad and among good documents).

    Expectation-maximisation on counted vote patterns, begun from "one bad vote makes a document doubtful". A rule's
    two accuracies are P(bad vote | bad) and P(good vote | good). A prior for these rates, worth ``weight`` of all
    documents and one more, steadies rules that seldom vote (at every size alike, as the share of documents that such a
    rule speaks of does not depend on it); ``priors`` has those of single rules. The share of good documents has no
    prior beyond one document of each kind. A bad vote never speaks for good quality, nor a good vote against it.
    """
    usual = {-1: (0.3, 0.02), 0: (0.6, 0.38), 1: (0.1, 0.6)}
    prior = [(priors or {}).get(r, usual) for r in range(rules)]
    belief = {p: 0.15 if -1 in p else 0.95 for p, _ in patterns}
    weight = 1 + weight * sum(c for _, c in patterns)
    share, rates = 0.85, [dict(x) for x in prior]
    for _ in range(rounds):
        good = sum(belief[p] * c for p, c in patterns)
        bad = sum(c for _, c in patterns) - good
        share = (good + 1) / (good + bad + 2)
        for r in range(rules):
            tally = {v: [weight * prior[r][v][0], weight * prior[r][v][1]] for v in VOTES}
            for p, c in patterns:
                tally[p[r]][0] += (1 - belief[p]) * c
                tally[p[r]][1] += belief[p] * c
            rates[r] = {v: (tally[v][0] / (bad + weight), tally[v][1] / (good + weight)) for v in VOTES}
        belief = {p: posterior(p, share, rates) for p, _ in patterns}
    return share, rates


def evidence(rate: dict[int, tuple[float, float]], vote: int) -> float:
    """Log odds that an outcome adds: never for good from a bad vote, never for bad from a good one.

    Abstaining counts too: a rule that votes good on nearly all good documents says something when it does not.
    """
    x = math.log(rate[vote][1] / rate[vote][0])
    return x if vote == 0 else min(0.0, x) if vote < 0 else max(0.0, x)


def posterior(pattern: tuple[int, ...], share: float, rates: Rates) -> float:
    z = math.log(share / (1 - share)) + sum(evidence(r, v) for v, r in zip(pattern, rates))
    return 1 / (1 + math.exp(-z))


def judge(docs: DataFrame, carry: list[str] | None = None, threshold: float = 0.5, rounds: int = 50) -> DataFrame:
    """``carry`` (doc_id), the measures, each rule's vote, quality (posterior), base_failed and kept.

    base_failed: under 50 words, or more than half of the words in repeated windows. kept: not base_failed and quality
    at least ``threshold``. Null and empty texts fail. Repeated rows count as often as they stand. An empty table gives
    an empty result. Columns of ``docs`` other than ``carry`` and text are ignored.
    """
    carry = carry or ["doc_id"]
    ids = [F.col(c).alias(f"__{k}") for k, c in enumerate(carry)]
    inner = [f"__{k}" for k in range(len(carry))]
    folder = work_dir(docs.sparkSession)
    base = save(measures(docs.select(*ids, "text"), inner), folder, "measures")
    voted = base.select(*base.columns, *[v.alias(f"vote_{r}") for r, v in votes().items()])
    names = [f"vote_{r}" for r in RULES]
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).agg(F.count(F.lit(1))).collect()]  # at most 3 ** len(RULES) rows
    share, rates = estimate(sorted(patterns), len(RULES), rounds)
    z = F.lit(math.log(share / (1 - share)))
    for name, rate in zip(names, rates):
        z = z + F.when(F.col(name) < 0, F.lit(evidence(rate, -1))).when(F.col(name) > 0, F.lit(evidence(rate, 1))).otherwise(F.lit(evidence(rate, 0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("quality", 1 / (1 + F.exp(-z))).withColumn("base_failed", failed)
    out = out.withColumn("kept", ~failed & (F.col("quality") >= threshold))
    return out.select(*[F.col(i).alias(c) for i, c in zip(inner, carry)], *[c for c in out.columns if c not in inner])
