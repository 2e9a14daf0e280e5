"""Quality rules under weak supervision, with DataFrame functions only.

Each rule votes good or bad, or abstains. Expectation-maximisation over the votes of all documents estimates each
rule's chances of its three outcomes on good and on bad documents and how common good documents are; a document's posterior probability
of being good replaces the usual demand that every rule pass. Votes are first counted by pattern. There are at most
3**rules patterns, so each step of the estimation is an aggregation over a table of bounded size, and the driver holds
no more than its parameters.

Windows that repeat within a text are found without leaving its row: each window becomes a hash and a position packed
into one long, the longs are sorted, and only windows whose hash has a neighbour are then compared as strings.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Bits of a packed long that hold the position; the others hold the hash.
PLACE = 31
WINDOW = 3
STEPS = 60
#: Where estimation starts: the share of good documents, and a rule's outcomes on good and on bad ones.
PRIOR = 0.9
GOOD = {-1: 0.02, 0: 0.18, 1: 0.8}
BAD = {-1: 0.3, 0: 0.3, 1: 0.4}
#: The start counts as so many documents, however many there are, so that no chance becomes 0 and few votes decide little.
PSEUDO = 50
THRESHOLD = 0.5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct"]


def _unless_null(xs: Column) -> Column:
    return F.filter(xs, lambda x: x.isNotNull())


def measure(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """The columns in carry, then MEASURES of each whole text; a null text is empty."""
    n, zero = WINDOW, F.lit(0).cast("long")
    out = docs.select(*[F.col(c).alias(f"c_{c}") for c in carry], F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    out = out.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).withColumn("nw", F.size("w"))
    out = out.withColumn("l", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)))

    def packed(i: Column) -> Column:
        return F.shiftleft(F.xxhash64(*[F.get("w", i + k) for k in range(n)]), PLACE).bitwiseOR(i.cast("long"))

    out = out.withColumn("p", F.when(F.col("nw") > n, F.sort_array(F.transform(F.sequence(F.lit(0), F.col("nw") - n), packed))).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("h", F.transform("p", lambda x: F.shiftright(x, PLACE)))
    near = F.transform("h", lambda x, i: F.when((F.get("h", i - 1) == x) | (F.get("h", i + 1) == x), F.get("p", i).bitwiseAND(F.lit((1 << PLACE) - 1))))
    out = out.withColumn("near", _unless_null(near))
    out = out.withColumn("s", F.sort_array(F.transform("near", lambda i: F.struct(F.array_join(F.slice("w", (i + 1).cast("int"), n), " ").alias("s"), i.alias("i")))))
    same = F.transform("s", lambda x, i: F.when((F.get("s", i - 1)["s"] == x["s"]) | (F.get("s", i + 1)["s"] == x["s"]), x["i"]))
    out = out.withColumn("e", F.sort_array(_unless_null(same)))
    covered = F.aggregate("e", F.struct(zero.alias("sum"), F.lit(-n).cast("long").alias("last")), lambda a, x: F.struct((a["sum"] + F.least(F.lit(n).cast("long"), x - a["last"])).alias("sum"), x.alias("last")), lambda a: a["sum"])
    long = lambda x: x.cast("long")
    return out.select(
        *[F.col(f"c_{c}").alias(c) for c in carry],
        long(F.col("nw")).alias("n_words"),
        long(F.length(F.translate("t", SPACES, ""))).alias("word_chars"),
        long(F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        long(covered).alias("n_repeat_words"),
        long(F.size("l")).alias("n_lines"),
        long(F.size(F.array_distinct("w"))).alias("n_distinct"),
    )


def rules() -> list[Column]:
    """Over MEASURES: 1 for good, -1 for bad, 0 to abstain."""

    def share(part: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.col(part) / F.col(of)).otherwise(F.lit(0.0))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    words, per = F.col("n_words"), share("word_chars", "n_words")
    symbols, lines = share("n_symbols", "n_words"), share("n_dup_lines", "n_lines")
    repeats, distinct = share("n_repeat_words", "n_words"), share("n_distinct", "n_words")
    return [
        vote(words >= 100, words < 50),
        vote((per >= 4) & (per <= 6.5), (per < 3) | (per > 7)),
        vote(symbols <= 0.02, symbols > 0.1),
        vote(lines <= 0.1, lines > 0.3),
        vote(repeats <= 0.15, repeats > 0.3),
        vote(distinct >= 0.6, distinct < 0.3),
    ]


def posterior(votes: list[Column], p: float, good: list[dict[int, float]], bad: list[dict[int, float]]) -> Column:
    """P(good | votes), where good and bad hold each rule's chances of its three outcomes."""
    odds = F.lit(log(p) - log(1 - p))
    for v, g, b in zip(votes, good, bad, strict=True):
        odds = odds + F.when(v == 1, log(g[1]) - log(b[1])).when(v == -1, log(g[-1]) - log(b[-1])).otherwise(log(g[0]) - log(b[0]))
    return 1 / (1 + F.exp(-odds))


Chances = list[dict[int, float]]


def _shared_out(good: dict[int, float], bad: dict[int, float], n_good: float, n_bad: float) -> tuple[dict[int, float], dict[int, float]]:
    """The chances, with that of a bad vote made equal where it is larger on good documents; each still sums to 1."""
    if bad[-1] >= good[-1]:
        return good, bad
    both = (good[-1] * n_good + bad[-1] * n_bad) / (n_good + n_bad)
    return tuple({o: both if o == -1 else x[o] * (1 - both) / (x[0] + x[1]) for o in x} for x in (good, bad))


def estimate(patterns: DataFrame, n_rules: int, steps: int = STEPS) -> tuple[float, Chances, Chances]:
    """Share of good documents and each rule's chances on good and bad ones, by expectation-maximisation over (v0, ..., n).

    PSEUDO documents that vote as PRIOR, GOOD and BAD say are added, so the documents outweigh the start as soon as they
    are many. A rule is at least as likely to vote bad on bad documents as on good ones. Without rows the start is the
    estimate.
    """
    p, good, bad = PRIOR, [dict(GOOD)] * n_rules, [dict(BAD)] * n_rules
    votes = [F.col(f"v{i}") for i in range(n_rules)]
    for _ in range(steps):
        weighed = patterns.select(*votes, F.col("n").cast("double").alias("n"), (F.col("n") * posterior(votes, p, good, bad)).alias("g"))
        sums = [F.sum("n").alias("n"), F.sum("g").alias("g")]
        sums += [F.sum(F.when(v == o, F.col(c)).otherwise(0.0)).alias(f"{c}{i}{o}") for i, v in enumerate(votes) for o in GOOD for c in "ng"]
        row = weighed.agg(*sums).first()
        if not row["n"]:
            break
        before, n_good, n_bad = p, row["g"] + PSEUDO * PRIOR, row["n"] - row["g"] + PSEUDO * (1 - PRIOR)
        p = n_good / (n_good + n_bad)
        good = [{o: (row[f"g{i}{o}"] + PSEUDO * PRIOR * GOOD[o]) / n_good for o in GOOD} for i in range(n_rules)]
        bad = [{o: (row[f"n{i}{o}"] - row[f"g{i}{o}"] + PSEUDO * (1 - PRIOR) * BAD[o]) / n_bad for o in BAD} for i in range(n_rules)]
        pairs = [_shared_out(g, b, n_good, n_bad) for g, b in zip(good, bad, strict=True)]
        good, bad = [g for g, _ in pairs], [b for _, b in pairs]
        if abs(p - before) < 1e-9:
            break
    return p, good, bad


def judge(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: the columns in carry (all, if not given), MEASURES, base_failed, p_good and kept.

    base_failed: under 50 words, or over half of the words in repeated windows of three. kept: not base_failed, and
    p_good at least threshold; chances are estimated from the documents that do not fail the base, as the many short
    ones would otherwise be what tells bad from good. A null text is empty, and fails; repeated rows are each judged; equal posteriors are
    judged alike. Columns of docs that clash with the results' names are replaced; an empty table gives no rows. A text
    is held whole with its words, their windows and lines, in some 100 bytes a word.

    Measures are written and read again, but where texts are carried, which would be a copy of docs: then the votes are
    counted in one pass, and the texts are measured again as the result is read.
    """
    mine = [*MEASURES, "base_failed", "p_good", "kept"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in mine]
    measured = measure(docs, text_col, carry)
    if text_col not in carry:
        measured = keep(measured, "measures")
    # Rows are numbered, from 0, so that no filter on what follows is pushed below the measures, which it would repeat.
    row = "_" * (1 + max(map(len, [*carry, *mine])))
    measured = measured.withColumn(row, F.monotonically_increasing_id())
    columns = [v.cast("int").alias(f"v{i}") for i, v in enumerate(rules())]
    failed = ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))) & (F.col(row) >= 0)
    counted = measured.where(~failed).select(*columns).groupBy(*[f"v{i}" for i in range(len(columns))]).agg(F.count("*").alias("n"))
    # At most 3**rules rows, whatever the input.
    patterns = keep(counted.coalesce(1), "patterns")
    p, good, bad = estimate(patterns, len(columns))
    out = measured.withColumn("base_failed", failed).withColumn("p_good", posterior(rules(), p, good, bad))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)).drop(row)
