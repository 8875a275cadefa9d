"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

All measures are Spark expressions over one row, so nothing is exploded.  The votes of the rules form a pattern; patterns are
counted (at most three to the power of the number of rules), and expectation-maximisation runs over the counted patterns:
each round is one aggregation that returns a single row of sums.  A document's verdict is the posterior probability of its
pattern.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import computed
from ..session import reliable_checkpoint

WINDOW = 3
ROUNDS = 12
THRESHOLD = 0.5
SMOOTH = 1.0  # imagined documents of either kind
SPACES = r"[\x20\x09-\x0D]+"

# Name, measure, good when at most / bad when at least (the other way round where good > bad); abstains in between.
RULES = (
    ("symbols", "symbol_share", 0.02, 0.10),
    ("repeats", "repeat_share", 0.10, 0.35),
    ("lines", "dup_line_share", 0.10, 0.40),
    ("long_words", "mean_word", 9.0, 12.0),
    ("length", "n_words", 80.0, 30.0),
    ("letters", "letter_share", 0.90, 0.70),
    ("shouting", "upper_share", 0.15, 0.40),
    ("ends", "stop_mark_share", 0.02, 0.004),
    ("bars", "bar_share", 0.02, 0.10),
)


def measured(docs: DataFrame) -> DataFrame:
    """Base measures of the contract and those of the rules for every row of ``docs`` (``doc_id``, ``text``).

    Repeated 3-word windows: the 64-bit names of a text's windows are sorted with their place in as many low bits as places
    need; equal neighbours are then told by their whole names, and their places, sorted, give the words they cover.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    rows = computed(rows, {"words": F.filter(F.split("text", SPACES), lambda w: w != "")})
    rows = computed(
        rows,
        {
            "bits": F.expr("cast(ceil(log2(greatest(size(words), 2))) as int)"),
            "names": F.expr(
                f"CASE WHEN size(words) < {WINDOW} THEN cast(array() AS array<bigint>) "
                f"ELSE transform(sequence(0, size(words) - {WINDOW}), i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2))) END"
            ),
            "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
            "joined": F.array_join("words", ""),
        },
    )
    rows = computed(
        rows,
        {
            "places": F.expr(
                "CASE WHEN size(array_distinct(names)) = size(names) THEN cast(array() AS array<bigint>) "
                "ELSE sort_array(transform(names, (h, i) -> shiftleft(shiftright(h, bits), bits) | cast(i AS bigint))) END"
            ),
            "mask": F.expr("shiftleft(1L, bits) - 1"),
        },
    )
    like = "(shiftright(x, bits) = shiftright(get(places, {j}), bits) AND get(names, cast(x & mask AS int)) = get(names, cast(get(places, {j}) & mask AS int)))"
    rows = computed(
        rows,
        {"repeats": F.expr(f"sort_array(transform(filter(places, (x, i) -> (i > 0 AND {like.format(j='i - 1')}) OR {like.format(j='i + 1')}), x -> x & mask))")},
    )
    return computed(
        rows,
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length("joined").cast("long"),
            "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": F.expr(f"aggregate(transform(repeats, (p, i) -> CASE WHEN i = 0 THEN {WINDOW}L ELSE least({WINDOW}L, p - get(repeats, i - 1)) END), 0L, (s, x) -> s + x)"),
            "n_letters": F.length(F.regexp_replace("joined", r"\P{L}+", "")).cast("long"),
            "n_upper": F.length(F.regexp_replace("joined", r"\P{Lu}+", "")).cast("long"),
            "n_bars": F.regexp_count("text", F.lit(r"[|{}<>]")).cast("long"),
            "n_stops": F.regexp_count("text", F.lit(r"[.!?](?:[\x20\x09-\x0D]|$)")).cast("long"),
        },
    ).select("doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_bars", "n_stops")


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def votes(rows: DataFrame) -> Column:
    """One character for each rule: 1 good, 0 bad, - abstains; a document without words makes every rule abstain but ``length``."""
    measures = {
        "symbol_share": _share("n_symbols", "word_chars"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "mean_word": _share("word_chars", "n_words"),
        "n_words": F.col("n_words").cast("double"),
        "letter_share": _share("n_letters", "word_chars"),
        "upper_share": _share("n_upper", "n_letters"),
        "stop_mark_share": _share("n_stops", "n_words"),
        "bar_share": _share("n_bars", "word_chars"),
    }
    out = []
    for name, measure, good, bad in RULES:
        m = measures[measure]
        vote = F.when(m <= good, "1").when(m >= bad, "0") if good < bad else F.when(m >= good, "1").when(m <= bad, "0")
        vote = vote.otherwise("-")
        out.append(vote if name == "length" else F.when(F.col("n_words") == 0, "-").otherwise(vote))
    return F.concat(*out)


Model = tuple[float, list[dict[str, float]]]  # log odds of the prior; for each rule what each vote adds to them

# Before anything is known: most documents are good, a bad vote says much, a good vote little.
FIRST: Model = (1.0, [{"1": 0.5, "0": -3.0, "-": 0.0}] * len(RULES))


def _log_odds(model: Model) -> Column:
    """Log odds that a pattern of votes belongs to a good document."""
    prior, adds = model
    total = F.lit(prior)
    for k, add in enumerate(adds):
        vote = F.substring("votes", k + 1, 1)
        total = total + F.when(vote == "1", add["1"]).when(vote == "0", add["0"]).otherwise(add["-"])
    return total


def expectation_maximisation(patterns: DataFrame, rounds: int = ROUNDS) -> Model:
    """Model fitted to ``votes`` and ``n``: how often good and bad documents get each vote (or none) from each rule.

    A rule that looks for one kind of junk votes good on all other kinds; so the rates of the three outcomes are estimated for either side, and
    a vote weighs as much as its rates differ.  ``FIRST`` settles which side is good; each rate is smoothed with ``SMOOTH`` imagined
    documents, a bad vote never speaks for a document nor a good one against it, and an abstention adds at most 1 either way.
    """
    model = FIRST
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-_log_odds(model)))
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("good")]
        for k in range(len(RULES)):
            for mark in "10":
                own = F.substring("votes", k + 1, 1) == mark
                sums.append(F.sum(F.when(own, F.col("n")).otherwise(0)).alias(f"n{mark}{k}"))
                sums.append(F.sum(F.when(own, F.col("n") * F.col("p")).otherwise(0.0)).alias(f"g{mark}{k}"))
        s = patterns.withColumn("p", p).agg(*sums).first()
        if not s["n"]:
            break
        good, bad = s["good"] + SMOOTH, s["n"] - s["good"] + SMOOTH
        adds = []
        for k in range(len(RULES)):
            of_good = {m: s[f"g{m}{k}"] for m in "10"}
            of_bad = {m: s[f"n{m}{k}"] - of_good[m] for m in "10"}
            of_good["-"], of_bad["-"] = s["good"] - sum(of_good.values()), s["n"] - s["good"] - sum(of_bad.values())
            add = {m: math.log((max(0.0, of_good[m]) + SMOOTH / 3) / good) - math.log((max(0.0, of_bad[m]) + SMOOTH / 3) / bad) for m in "10-"}
            adds.append({"1": max(0.0, add["1"]), "0": min(0.0, add["0"]), "-": max(-1.0, min(1.0, add["-"]))})
        model = (math.log(good / bad), adds)
    return model


def judged(docs: DataFrame, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): measures, ``base_failed``, ``votes``, ``quality``, ``kept``.

    ``quality`` is the posterior probability that the document is good; ``kept`` is false where the base rules fail, else whether
    it reaches ``threshold``.  A null or empty text has no words and fails; repeated rows are judged alike; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = measured(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = reliable_checkpoint(rows.withColumn("votes", votes(rows)).withColumn("base_failed", failed))
    patterns = reliable_checkpoint(rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).coalesce(1))  # at most 3 ** rules rows
    quality = 1 / (1 + F.exp(-_log_odds(expectation_maximisation(patterns, rounds))))
    return rows.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
