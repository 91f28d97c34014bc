"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how accurate each is, and the
posterior probability of good quality decides. DataFrame and SQL functions only.

A rule votes 1 (good), -1 (bad) or 0 (abstains). The model is a mixture of two classes in which the rules are independent: for each class
it has the probabilities that a rule votes bad, abstains or votes good there. Documents with the same votes are
alike, so EM runs on the counts of the vote patterns: at most 3 ** rules of them, whatever the number of documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import cut, narrow

WORD, BLANK = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]+"
WINDOW = 8

#: name -> (condition of a bad vote, condition of a good vote), over the columns of features(); otherwise the rule abstains.
RULES = {
    "length": ("n_words < 20", "false"),
    "word_length": ("word_chars < 2 * n_words or word_chars > 15 * n_words", "false"),
    "symbols": ("4 * n_symbols > n_words", "50 * n_symbols <= n_words and n_words >= 20"),
    "marks": ("5 * n_marks > n_words", "false"),
    "letters": ("4 * n_letters < 3 * word_chars", "25 * n_letters >= 23 * word_chars and n_words >= 20"),
    "repeated_lines": ("10 * n_dup_lines > 3 * n_lines", "false"),
    "repeated_words": ("5 * n_repeat_words > n_words", "false"),
    "stutter": ("10 * n_stutter > 3 * n_words", "false"),
    "capitals": ("5 * n_upper > 2 * n_letters and n_words >= 10", "5 * n_upper <= n_letters and n_letters > 0"),
    "exclamation": ("5 * n_exclaim > n_words", "false"),
    "sentences": ("100 * n_stops < n_words and n_words >= 100", "100 * n_stops between 3 * n_words and 40 * n_words and 20 * n_symbols <= n_words"),
}


@dataclass(frozen=True)
class Model:
    """prior of good quality; for each rule the probabilities of votes -1, 0 and 1 on good and on bad documents."""

    prior: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]


def _materialised(df: DataFrame, keep: list[str], **exprs: Column) -> DataFrame:
    """Compute exprs once a row: a generator over one element keeps the optimiser from copying them into each later use."""
    one = F.explode_outer(F.array(F.struct(*(e.alias(n) for n, e in exprs.items())))).alias("one")
    return df.select(*keep, one).select(*keep, *(F.col(f"one.{n}").alias(n) for n in exprs))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that the rules read, for every row; no shuffle.

    n_repeat_words counts words in windows of eight that the text holds at least twice (first ones included): windows are hashed, from
    hashes of two and four words, sorted with their places, equal neighbours marked, and the marked places' windows united. A text without
    a repeated run of four words has none of eight. Null and empty texts count 0 everywhere.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = _materialised(rows, ["doc_id", "text"], words=F.filter(F.split("text", BLANK), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(WORD))
    rows = _materialised(rows, ["doc_id", "text"], n_words=F.size("words").cast("long"), word_chars=F.length(F.array_join("words", "")).cast("long"), hashes=F.transform("words", lambda w: F.xxhash64(w)), lines=lines)
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    from_ = lambda name, at: F.slice(name, at, F.greatest(F.size(name), F.lit(1)))
    joined = lambda name, n: F.slice(F.zip_with(name, from_(name, n + 1), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(name) - n, F.lit(0)))
    rows = _materialised(
        rows,
        ["doc_id", "n_words", "word_chars"],
        n_stutter=F.size(F.filter(F.zip_with("hashes", from_("hashes", 2), lambda a, b: a == b), lambda e: e)).cast("long"),
        n_symbols=count(r"[#*$%&|<>]"),
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_upper=count(r"\p{Lu}"),
        n_letters=F.length(F.regexp_replace("text", r"\P{L}+", "")).cast("long"),
        n_exclaim=count("!"),
        n_marks=count(r"[#*$%&|<>]{2,}|[#*$%&|<>](?<![^\x20\x09-\x0D].)(?![^\x20\x09-\x0D])"),
        n_stops=count(r"[.!?。！？](?=[\x20\x09-\x0D]|$)"),
        two=joined("hashes", 1),
    )
    kept = ["doc_id", "n_words", "word_chars", "n_stutter", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_letters", "n_exclaim", "n_marks", "n_stops"]
    rows = _materialised(rows, kept, four=joined("two", 2))
    repeats = F.size("four") > F.size(F.array_distinct("four"))
    rows = _materialised(rows, kept, windows=F.when(repeats, joined("four", 4)).otherwise(F.array().cast("array<bigint>")))
    counted = ["n_words", "word_chars", "n_stutter", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_letters", "n_exclaim", "n_marks", "n_stops"]
    twice = F.size("windows") > F.size(F.array_distinct("windows"))
    rows = _materialised(rows, ["doc_id", *counted], placed=F.when(twice, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    equal = F.zip_with(F.slice("placed", 1, F.greatest(F.size("placed") - 1, F.lit(0))), F.slice("placed", 2, F.greatest(F.size("placed") - 1, F.lit(0))), lambda a, b: a["h"] == b["h"])
    rows = _materialised(rows, ["doc_id", *counted], placed=F.col("placed"), equal=F.when(F.col("placed").isNotNull(), equal))
    marks = F.zip_with(F.zip_with("placed", F.concat("equal", F.array(F.lit(False))), lambda p, e: F.struct(p["i"].alias("i"), e.alias("e"))), F.concat(F.array(F.lit(False)), F.col("equal")), lambda p, e: F.struct(p["i"].alias("i"), (p["e"] | e).alias("e")))
    starts = F.sort_array(F.transform(F.filter(marks, lambda m: m["e"]), lambda m: m["i"]))
    rows = _materialised(rows, ["doc_id", *counted], starts=F.when(F.col("placed").isNotNull(), starts))
    gaps = F.zip_with("starts", F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
    return rows.select("doc_id", *counted, F.when(F.col("starts").isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)).cast("long").alias("n_repeat_words"))


def votes(rows: DataFrame, rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """The columns of rows, and v_<rule> in (-1, 0, 1) for each rule; a condition that is null does not hold."""
    vote = lambda bad, good: F.when(F.expr(bad), F.lit(-1)).when(F.expr(good), F.lit(1)).otherwise(F.lit(0))
    return rows.select("*", *(vote(*pair).alias(f"v_{name}") for name, pair in rules.items()))


def _weights(model: Model) -> list[tuple[float, float, float]]:
    """Log-odds of each rule's votes; a vote never speaks against what it says."""
    out = []
    for good, bad in zip(model.good, model.bad, strict=True):
        w = [math.log(g) - math.log(b) for g, b in zip(good, bad, strict=True)]
        out.append((min(w[0], 0.0), w[1], max(w[2], 0.0)))
    return out


def posterior(model: Model, names: list[str]) -> Column:
    """Probability of good quality given the votes."""
    total = F.lit(math.log(model.prior) - math.log1p(-model.prior))
    for name, (bad, none, good) in zip(names, _weights(model), strict=True):
        v = F.col(f"v_{name}")
        total = total + F.when(v == -1, F.lit(bad)).when(v == 1, F.lit(good)).otherwise(F.lit(none))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(voted: DataFrame, names: list[str], rounds: int = 15, weight: float = 20.0) -> Model:
    """Estimate the model from all rows. weight: documents that the start values count as, so that small or empty tables are defined.

    The prior stays within 0.05 and 0.95, and no vote is taken as evidence against what it says, so the classes can't swap.
    """
    patterns = cut(voted.groupBy(*(f"v_{n}" for n in names)).agg(F.count(F.lit(1)).alias("n")), "patterns")
    start = model = Model(0.85, ((0.02, 0.38, 0.6),) * len(names), ((0.4, 0.4, 0.2),) * len(names))
    for _ in range(rounds):
        good, bad = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        sums = [F.sum(good).alias("g"), F.sum(bad).alias("b")]
        for n in names:
            sums += [F.sum(F.when(F.col(f"v_{n}") == v, x)).alias(f"{c}_{n}_{v}") for v in (-1, 0, 1) for c, x in (("g", good), ("b", bad))]
        s = {k: x or 0.0 for k, x in patterns.withColumn("p", posterior(model, names)).agg(*sums).first().asDict().items()}
        rates = lambda c, first: tuple(tuple((s[f"{c}_{n}_{v}"] + weight * p) / (s[c] + weight) for v, p in zip((-1, 0, 1), f, strict=True)) for n, f in zip(names, first, strict=True))
        prior = (s["g"] + weight * start.prior) / (s["g"] + s["b"] + weight)
        model = Model(min(max(prior, 0.05), 0.95), rates("g", start.good), rates("b", start.bad))
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """One row for every row of docs: doc_id, the counts, base_failed, quality (the posterior) and kept.

    base_failed: under 20 words, or over 30 in 100 words in repeated windows; such a document is never kept. Otherwise kept says
    whether the posterior reaches the threshold. Null and empty texts fail. Repeated rows are judged alike; an empty table gives no rows.
    """
    counted = features(docs, id_col, text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    voted = cut(votes(counted.withColumn("base_failed", failed), rules), "votes")
    names = list(rules)
    model = fit(voted, names)
    return voted.withColumn("quality", posterior(model, names)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
