"""Quality rules under weak supervision, with DataFrame functions only.

Each rule votes for or against a document or abstains. Documents are good, or bad in one of several kinds; three rules look
for each kind, so that their agreement tells a kind from false alarms. Expectation and maximisation over the counts of vote
patterns estimates how often each rule condemns documents of each kind and good ones; a document's posterior probability
of being good decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, col, cut, words

#: What is bad in one way, and the rules that look for it. Whether a text is long tells of no kind.
KINDS = {"junk": ("symbols", "letters", "wordless"), "repetition": ("repeated_lines", "repeated_words", "variety"), "shouting": ("upper", "shouting", "word_length")}
RULES = ("length", *[r for rules in KINDS.values() for r in rules])
LEAST_WORDS = 50
#: ASCII characters that aren't letters, in words.
MARKS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORDLESS = r"(?<![^\x20\x09-\x0D])[!-@\[-`{-~]++(?![^\x20\x09-\x0D])"


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base measures of every whole text, and those that only rules use."""
    t = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    gone = lambda chars: F.char_length("text") - F.char_length(F.translate("text", chars, ""))
    t = t.withColumn("w", words(F.col("text"))).withColumn("n", F.size("w"))
    three = F.when(F.col("n") >= 3, F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    t = t.withColumns({"h": three, "lines": lines})
    # windows sorted by hash: equal neighbours are repeated
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    t = t.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs))
    twice = F.filter("s", lambda x, i: F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False)))
    t = t.withColumn("at", F.when(F.col("s").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["p"]))))
    steps = F.zip_with(F.slice("at", 2, F.size("at")), F.slice("at", 1, F.size("at") - 1), lambda b, a: F.least(F.lit(3), b - a))
    covered = F.when(F.col("at").isNull(), 0).otherwise(F.aggregate(steps, F.lit(3), lambda a, x: a + x))
    return t.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        (F.char_length("text") - gone(SPACE_CHARS)).cast("long").alias("word_chars"),
        gone("#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        gone("!").cast("long").alias("n_shouts"),
        gone(MARKS).cast("long").alias("n_marks"),
        F.regexp_count("text", F.lit(_WORDLESS)).cast("long").alias("n_wordless"),
        gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
    )


def votes(m: DataFrame) -> DataFrame:
    """+1, -1 or 0 (abstains) of each rule, in columns v_<rule>."""
    n, share = F.col("n_words"), lambda a, percent, b: 100 * F.col(a) > percent * F.col(b)
    vote = lambda bad, good: F.when(n == 0, 0).when(bad, -1).when(good, 1).otherwise(0)
    rules = {
        "length": vote(F.lit(False), n >= 2 * LEAST_WORDS),  # the base rules see to short ones
        "symbols": vote(share("n_symbols", 25, "n_words"), ~share("n_symbols", 5, "n_words")),
        "letters": vote(share("n_marks", 12, "word_chars"), ~share("n_marks", 8, "word_chars")),
        "wordless": vote(share("n_wordless", 20, "n_words"), ~share("n_wordless", 8, "n_words")),
        "repeated_lines": vote(share("n_dup_lines", 30, "n_lines"), (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1)),
        "repeated_words": vote(share("n_repeat_words", 35, "n_words"), ~share("n_repeat_words", 15, "n_words")),
        "word_length": vote((F.col("word_chars") < 3 * n) | (F.col("word_chars") > 12 * n), (F.col("word_chars") >= 4 * n) & (F.col("word_chars") <= 9 * n)),
        "upper": vote(share("n_upper", 25, "word_chars"), ~share("n_upper", 8, "word_chars")),
        "variety": vote(share("n_words", 400, "n_distinct"), ~share("n_words", 250, "n_distinct")),
        "shouting": vote(share("n_shouts", 25, "n_words"), ~share("n_shouts", 5, "n_words")),
    }
    return m.withColumns({f"v_{k}": v.cast("int") for k, v in rules.items()})


#: The share of good documents and of each kind, and P(condemns | kind, not abstaining) of each rule, good ones first.
Estimates = tuple[list[float], list[dict[str, float]]]


def estimate(patterns: DataFrame, most_rounds: int = 300, false_alarms: float = 0.01, own: float = 0.5, prior: float = 2.0) -> Estimates:
    """Shares and rates from patterns(v_..., n): at most 3 ** rules rows.

    At first a document is of a kind as far as the rules for it condemn it, and good for the rest. `prior` documents of a rate of
    `own` (a kind's own rules) or `false_alarms` (others) are added to each, which keeps rates off 0 and 1 and is outweighed
    by a few dozen documents. Abstaining says nothing. Rounds end when no posterior moves by a millionth."""
    rows = [({k: r[f"v_{k}"] for k in RULES}, r["n"]) for r in patterns.collect()]
    kinds, total = [(), *KINDS.values()], sum(n for _, n in rows)

    def first(votes: dict[str, int]) -> list[float]:
        heard = [[votes[r] for r in rules if votes[r]] for rules in KINDS.values()]
        against = [sum(v < 0 for v in x) / len(x) if x else 0.0 for x in heard]
        against = [x / max(1.0, sum(against)) for x in against]
        return [1 - sum(against), *against]

    def maximised() -> Estimates:
        shares, rates = [], []
        for y, rules in enumerate(kinds):
            part = [(votes, p[y] * n) for p, (votes, n) in zip(posteriors, rows, strict=True)]
            shares.append((sum(w for _, w in part) + 1) / (total + len(kinds)))
            rates.append({})
            for r in RULES:
                condemned, passed = (sum(w for votes, w in part if votes[r] == v) for v in (-1, 1))
                rates[y][r] = (condemned + prior * (own if r in rules else false_alarms)) / (condemned + passed + prior)
        return shares, rates

    def posterior(votes: dict[str, int]) -> list[float]:
        logs = [math.log(share) + sum(math.log(rate[r] if v < 0 else 1 - rate[r]) for r, v in votes.items() if v) for share, rate in zip(shares, rates, strict=True)]
        odds = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(odds) for x in odds]

    posteriors = [first(votes) for votes, _ in rows]
    for _ in range(most_rounds):
        shares, rates = maximised()
        before, posteriors = posteriors, [posterior(votes) for votes, _ in rows]
        if all(abs(a - b) < 1e-6 for x, y in zip(before, posteriors, strict=True) for a, b in zip(x, y, strict=True)):
            break
    return maximised()


def quality(estimates: Estimates) -> Column:
    """The posterior probability of being good, given the columns v_<rule>."""
    shares, rates = estimates
    odds = F.lit(0.0)
    for y in range(1, len(shares)):  # bad of this kind to good
        one = F.lit(math.log(shares[y] / shares[0]))
        for r in RULES:
            v = F.col(f"v_{r}")
            passes, condemns = math.log((1 - rates[y][r]) / (1 - rates[0][r])), math.log(rates[y][r] / rates[0][r])
            one = one + F.when(v == 1, passes).when(v == -1, condemns).otherwise(0.0)
        odds = odds + F.exp(one)
    return 1 / (1 + odds)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The base measures, base_failed, kept and the posterior probability of every row of docs.

    Null and empty texts have no words and fail the base rules. Rows that repeat an id are judged each for itself. An
    empty table gives an empty result. Only id and text are read.
    """
    m = cut(votes(measures(docs, id_col, text_col)), "measures")
    names = [f"v_{r}" for r in RULES]
    estimates = estimate(m.groupBy(*names).agg(F.count("*").alias("n")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    m = m.withColumn("base_failed", failed).withColumn("quality", quality(estimates))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("quality") >= least)).alias("kept"), "quality")
