"""Weak supervision over quality rules, with DataFrame functions alone.

Each rule votes for (1) or against (-1) a document, or abstains (0). The documents are counted by their pattern of votes
(at most 3 ** rules rows, whatever the input), and expectation-maximisation on these counts estimates the share of good
documents and, for each rule, how often it votes right for good and for bad ones. The posterior of a pattern is joined
back as the probability of quality; no rule has to pass for itself. No label is read, and no belief about a rule goes in but
two counts for each class; the rules' majority is where the estimate begins.

The estimate counts only documents that pass the base test. Rules' accuracies thus ignore short and repetitive documents
(the length rule's vote against is never counted), and `quality` of rows that fail the test is extrapolated and no measure
of them; `kept` is false for these whatever it says.

Counts and repeats are computed inside each row by array functions, so that the only shuffle is that of pattern counts.

Defined cases: a null text has no words and fails the base test; texts without words have posterior like any other
pattern; an empty table gives an empty result; repeated rows are judged each for itself; ties between lines or windows
count every later copy; columns other than the key and the text are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BLANKS = ("\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = "#*$%&|<>"
#: Rounds at most, and the change of a posterior that ends them.
ROUNDS, SETTLED = 200, 1e-9
#: Counts added to each vote of each class, and to each class.
ADDED = 2.0
#: Characters of a short word, at most.
SHORT = 3


def without(text: Column, marks: str) -> Column:
    """The text without any of the characters; one byte search each, which beats translate() where they are rare."""
    for m in marks:
        text = F.replace(text, F.lit(m))
    return text


def word_array(text: Column) -> Column:
    for b in BLANKS:
        text = F.replace(text, F.lit(b), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def window_hashes(words: Column) -> Column:
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def repeated_places(hashes: Column) -> Column:
    """(hash, place) pairs in order; empty where all hashes differ, which spares most texts the sorting."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def same_as_neighbour(pairs: Column) -> Column:
    return F.filter(pairs, lambda x, j: (x["h"] == F.get(pairs, j + 1)["h"]) | (x["h"] == F.get(pairs, j - 1)["h"]))


def covered(places: Column) -> Column:
    """Words that 3-word windows at the sorted places cover."""
    gaps = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)


def measures(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need besides."""
    rows = docs.select(F.col(key), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", word_array(F.col("text"))).withColumn("hashes", window_hashes(F.col("words")))
    rows = rows.withColumn("pairs", repeated_places(F.col("hashes")))
    rows = rows.withColumn("pairs", same_as_neighbour(F.col("pairs")))
    rows = rows.withColumn("places", F.sort_array(F.transform("pairs", lambda x: x["i"])))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: without(x, "\x20\t\x0b\x0c\r") != ""))
    rows = rows.withColumn("solid", F.concat_ws("", "words"))

    def length(c: Column) -> Column:
        return F.char_length(c).cast("long")

    solid = F.col("solid")
    return rows.select(
        key,
        F.size("words").cast("long").alias("n_words"),
        length(solid).alias("word_chars"),
        (length(solid) - length(without(solid, SYMBOLS))).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered(F.col("places")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (length(solid) - length(without(solid, "!"))).alias("n_shouts"),
        (length(solid) - length(without(solid, "."))).alias("n_stops"),
        (length(solid) - length(without(solid, ","))).alias("n_commas"),
        F.size(F.filter("words", lambda w: F.char_length(w) <= SHORT)).cast("long").alias("n_short"),
        F.size(F.filter("words", lambda w: F.instr(F.lit(SYMBOLS), F.substring(w, -1, 1)) > 0)).cast("long").alias("n_marked"),
    )


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """The votes, by rule. Between its two thresholds a rule abstains."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    per_word = F.col("word_chars") / n
    plain = 1 - (F.col("n_symbols") + F.col("n_stops") + F.col("n_commas") + F.col("n_shouts")) / chars

    def share(column: str) -> Column:
        return F.col(column) / n

    def outside(x: Column, low: float, high: float) -> Column:
        return (x < low) | (x > high)

    return {
        "length": vote(F.col("n_words") < 100, F.col("n_words") >= 200),
        "symbols": vote(share("n_symbols") > 0.1, share("n_symbols") <= 0.01),
        "marked_words": vote(share("n_marked") > 0.1, share("n_marked") <= 0.01),
        "letters": vote(plain < 0.9, plain >= 0.95),
        "word_length": vote(outside(per_word, 4.2, 6.5), per_word.between(4.6, 5.6)),
        "short_words": vote(share("n_short") < 0.2, share("n_short") >= 0.25),
        "stops": vote(outside(share("n_stops"), 0.03, 0.25), share("n_stops").between(0.05, 0.15)),
        "commas": vote(outside(share("n_commas"), 0.02, 0.15), share("n_commas").between(0.03, 0.1)),
        "lines": vote(F.col("n_dup_lines") > 0.1 * F.col("n_lines"), F.col("n_dup_lines") == 0),
        "repeats": vote(share("n_repeat_words") > 0.05, share("n_repeat_words") <= 0.01),
    }


def estimate(counts: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior of each pattern after expectation-maximisation.

    It begins with the majority of the votes, sigmoid(votes for - votes against), which also says which class is the good
    one. For each rule and class the model has the chance of a vote for, given that the rule doesn't abstain; so a rule that
    votes alike in both classes weighs nothing, and one that is wrong more often than right counts the other way round.
    """
    if not counts:
        return {}
    votes = range(len(counts[0][0]))
    posterior = {p: 1 / (1 + math.exp(-sum(p))) for p, _ in counts}
    total = sum(n for _, n in counts)
    for _ in range(rounds):
        prior = (sum(n * posterior[p] for p, n in counts) + ADDED) / (total + 2 * ADDED)
        weights = []
        for j in votes:
            own = {c: {-1: ADDED, 1: ADDED} for c in (0, 1)}
            for p, n in counts:
                if p[j]:
                    own[1][p[j]] += n * posterior[p]
                    own[0][p[j]] += n * (1 - posterior[p])
            chance = {c: {v: x / sum(own[c].values()) for v, x in own[c].items()} for c in own}
            weights.append({v: math.log(chance[1][v] / chance[0][v]) for v in (-1, 1)} | {0: 0.0})
        odds = {p: math.log(prior / (1 - prior)) + sum(weights[j][p[j]] for j in votes) for p, _ in counts}
        new = {p: 1 / (1 + math.exp(-min(700.0, max(-700.0, x)))) for p, x in odds.items()}
        change = max(abs(new[p] - posterior[p]) for p in new)
        posterior = new
        if change < SETTLED:
            break
    return posterior


def judge_quality(docs: DataFrame, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """Measures, base_failed, the posterior of quality and kept for every document.

    The measures, a few numbers per document, are written to the shared folder once and read for the counts of patterns
    and for the result.
    """
    own = rules()
    names = [f"vote_{x}" for x in own]
    # One number stands for a pattern, so that counts and posteriors are keyed by a long.
    code = sum(((F.col(n) + 1).cast("long") * 3**i for i, n in enumerate(names)), F.lit(0).cast("long"))
    voted = stored(measures(docs, key).withColumns(dict(zip(names, own.values()))).withColumn("pattern", code), "quality-rules")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # Documents that fail the base test are decided already, so the estimate counts the others alone.
    counted = voted.groupBy("pattern").agg(F.count(F.when(~failed, 1)).alias("n")).collect()  # at most 3 ** rules rows
    posterior = estimate([(tuple(r["pattern"] // 3**i % 3 - 1 for i in range(len(names))), r["n"]) for r in sorted(counted, key=lambda r: r["pattern"])])
    rows = json.dumps([{"pattern": sum((v + 1) * 3**i for i, v in enumerate(p)), "quality": q} for p, q in posterior.items()])
    table = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<pattern:bigint,quality:double>>")))
    scored = voted.join(F.broadcast(table), "pattern", "left").withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.coalesce("quality", F.lit(0.0)) >= threshold)
    return scored.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "quality", *names)
