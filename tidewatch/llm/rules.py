"""Quality rules as a short-circuit cascade; DataFrame functions only.

Each rule has a test and an estimate of the work of its test on one document.  Over a sample of a
bounded number of documents (drawn by a hash of their ids) one aggregate gives every rule's share of
rejected documents and its mean work; the rules then run in the order of rejections per work in one
CASE, whose later branches are not evaluated once a rule has rejected.  The order decides only the
work and which rule is named: a document is kept if no rule rejects it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import id_hash
from tidewatch.llm.words import BLANKS, WORD, word_array

SAMPLE_ROWS = 2000
SYMBOLS = "#*$%&|<>"
LETTERS = r"\p{L}"


@dataclass(frozen=True)
class Rule:
    """``reject`` is true, false or null (null keeps); ``work`` counts the elements that its test visits."""

    name: str
    reject: Column
    work: Column


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the array, all occurrences included.

    Windows are compared by 64-bit hashes.  Repeats are neighbours once the hashes are sorted with
    their positions, so the work is n log n for any text.
    """

    def count(ws: Column) -> Column:
        grams = F.transform(F.slice(ws, 1, F.size(ws) - 2), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
        return bind(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))

    def covered(g: Column) -> Column:
        keyed = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = bind(keyed, lambda s: F.transform(
            F.filter(s, lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"]))),
            lambda x: x["i"],
        ))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
        return F.aggregate(F.array_sort(again), start, step, lambda a: a["n"])

    return bind(words, lambda ws: F.when(F.size(ws) < 4, F.lit(0)).otherwise(count(ws))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blanks = " \t\n\x0b\x0c\r"
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return (
        docs.withColumn("_words", word_array(F.col("text"))).withColumn("_lines", lines)
        .select(
            *docs.columns,
            F.size("_words").cast("long").alias("n_words"),
            F.length(F.translate(text, blanks, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            repeat_words(F.col("_words")).alias("n_repeat_words"),
        )
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules over the columns of ``statistics`` and the text."""
    words, chars = F.col("n_words"), F.col("word_chars")
    letters = F.regexp_count("text", F.lit(LETTERS))
    capitals = F.regexp_count("text", F.lit(r"\p{Lu}"))
    no_letter = F.regexp_count("text", F.lit(rf"(?<![^{BLANKS}])[^{BLANKS}\p{{L}}]+(?![^{BLANKS}])"))
    return [
        Rule("base", base_failed(), F.lit(1.0)),
        Rule("word_length", (chars < 2 * words) | (chars > 15 * words), F.lit(1.0)),
        Rule("symbols", 5 * F.col("n_symbols") > words, F.lit(1.0)),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.col("n_lines"), F.lit(1.0)),
        Rule("capitals", 2 * capitals > letters, 2.0 * chars),
        Rule("letters", 2 * letters < chars, 1.0 * chars),
        Rule("words_without_letters", 2 * no_letter > words, 1.5 * chars),
    ]


def plan_order(measured: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(name, share rejected, mean work) of the rules in the order in which to run them.

    About ``sample_rows`` documents are looked at, all of them in a smaller table.  Ties go by work,
    then by name; an empty sample leaves the order by work.
    """
    n = measured.count()
    part = F.conv(F.substring(id_hash(F.col("doc_id"), "rules"), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    sample = measured.filter(part < F.lit(min(1.0, sample_rows / max(n, 1))))
    figures = []
    for i, r in enumerate(rules):
        rejects = F.when(F.coalesce(r.reject, F.lit(False)), 1.0).otherwise(0.0)
        figures += [F.avg(rejects).alias(f"r{i}"), F.avg(r.work.cast("double")).alias(f"w{i}")]
    row = sample.agg(*figures).first()
    found = [(r.name, row[f"r{i}"] or 0.0, max(row[f"w{i}"] or 1.0, 1.0)) for i, r in enumerate(rules)]
    return sorted(found, key=lambda x: (-x[1] / x[2], x[2], x[0]))


def cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` (doc_id, text and more) with the statistics, base_failed, kept and rejected_by.

    Columns of ``docs`` named like a result are replaced.  Null and empty texts fail the base rule.
    Rows are judged one by one, so repeated rows get the same verdict.
    """
    added = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by", "_words", "_lines"}
    docs = docs.drop(*(c for c in docs.columns if c in added))
    rules = default_rules() if rules is None else rules
    measured = statistics(docs)
    by_name = {r.name: r for r in rules}
    verdict = None
    for name, _, _ in plan_order(measured, rules, sample_rows):
        test = by_name[name].reject
        verdict = F.when(test, F.lit(name)) if verdict is None else verdict.when(test, F.lit(name))
    out = measured.withColumn("base_failed", base_failed())
    out = out.withColumn("rejected_by", verdict if verdict is not None else F.lit(None).cast("string"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
