"""Quality rules: a threshold table compiled into DataFrame expressions, without user functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the corpus's languages.
STOP_WORDS = {
    "en": "a an and are as at be by for from has he in is it its of on or that the this to was were will with not but they you",
    "fr": "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne on ou par pas pour qui que sur un une",
    "de": "als am an auch auf aus bei das dem den der des die ein eine einer er es für ich im in ist mit nicht sich sie und von zu",
    "es": "al como con de del el ella en es esta la las lo los más no para pero por que se sin su sus un una y ya",
}


@dataclass(frozen=True)
class Rule:
    """Passes if low * per <= 100 * of <= high * per; a bound of None is open."""

    name: str
    of: str
    per: str
    low: int | None = None
    high: int | None = None

    def column(self) -> Column:
        value, per, true = F.col(self.of) * 100, F.col(self.per), F.lit(True)
        return (true if self.low is None else value >= per * self.low) & (true if self.high is None else value <= per * self.high)

    def sql(self) -> str:
        tests = [f"100 * {self.of} {op} {bound} * {self.per}" for op, bound in ((">=", self.low), ("<=", self.high)) if bound is not None]
        return " AND ".join(tests) or "TRUE"


#: Hundredths. Word length is in characters; symbols and stop words go by words, repeated lines by lines with a word.
THRESHOLDS = (
    Rule("word length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop words", "n_stop_words", "n_words", 4, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 40),
)


def stop_words() -> list[str]:
    """Each word as it stands and capitalised."""
    return sorted({x for words in STOP_WORDS.values() for w in words.split() for x in (w, w.capitalize())})


def count_features(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words (long)."""
    p = prefix or "__q_"
    long = lambda c: c.cast("long")
    c = lambda name: F.col(p + name)
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn(p + "text", text)
    out = out.withColumn(p + "trimmed", F.trim(c("text"), F.lit(SPACE)))
    out = out.withColumn(p + "words", F.when(c("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split(c("trimmed"), "[ \\t-\\r]+")))
    out = out.withColumn(p + "n", F.size(c("words")))
    lines = F.filter(F.split(c("text"), "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    out = out.withColumn(p + "lines", lines)
    # hashes of the 3-word windows with their places, in order of hash: equal windows stand side by side
    place = F.when(c("n") >= 3, F.sequence(F.lit(1), c("n") - 2)).otherwise(F.array().cast("array<int>"))
    window = F.transform(place, lambda i: F.struct(F.xxhash64(F.element_at(c("words"), i), F.element_at(c("words"), i + 1), F.element_at(c("words"), i + 2)).alias("h"), i.alias("i")))
    out = out.withColumn(p + "windows", F.sort_array(window))
    same = lambda k, x: F.coalesce(F.get(c("windows"), k)["h"] == x["h"], F.lit(False))
    twice = F.filter(c("windows"), lambda x, k: same(k - 1, x) | same(k + 1, x))
    out = out.withColumn(p + "starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform(c("starts"), lambda s, k: F.least(F.lit(3), F.coalesce(F.get(c("starts"), k + 1) - s, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    out = out.withColumns({
        "n_words": long(c("n")),
        "word_chars": long(F.length(F.translate(c("text"), SPACE, ""))),
        "n_symbols": long(F.length(c("text")) - F.length(F.translate(c("text"), SYMBOLS, ""))),
        "n_lines": long(F.size(c("lines"))),
        "n_dup_lines": long(F.size(c("lines")) - F.size(F.array_distinct(c("lines")))),
        "n_repeat_words": long(covered),
        "n_stop_words": long(F.size(F.filter(c("words"), lambda w: w.isin(*stop_words())))),
    })
    return out.drop(*[p + x for x in ("text", "trimmed", "words", "n", "lines", "windows", "starts")])


def quality_rules(docs: DataFrame, thresholds: tuple[Rule, ...] = THRESHOLDS, *, text_col: str = "text", min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Every row of docs with the counts of count_features, base_failed and kept.

    base_failed: under min_words words, or over max_repeat % of them in 3-word windows found twice. kept: base_failed is
    false and every rule passes. A null text has no words, so it fails; input columns named like a new one are replaced;
    rows are judged one by one, so repeats and ties don't matter. No shuffle.
    """
    out = count_features(docs, text_col)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    passed = reduce(lambda a, b: a & b, (r.column() for r in thresholds), F.lit(True))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passed)


def quality_sql(table: str = "documents", thresholds: tuple[Rule, ...] = THRESHOLDS, min_words: int = 50, max_repeat: int = 50) -> str:
    """The same in DuckDB's SQL."""
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words())
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, row_number() OVER () AS r FROM {table}),
w AS (SELECT r, unnest(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), 1) AS i FROM t),
g AS (SELECT r, i, w, lead(w, 1) OVER s AS w1, lead(w, 2) OVER s AS w2 FROM w WINDOW s AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, w, (w2 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w1, w2) >= 2) AS twice FROM g),
k AS (SELECT r, w, (twice OR coalesce(lag(twice, 1) OVER s, false) OR coalesce(lag(twice, 2) OVER s, false)) AS rep FROM c WINDOW s AS (PARTITION BY r ORDER BY i)),
a AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (rep) AS n_repeat_words, count(*) FILTER (w IN ({words})) AS n_stop_words FROM k GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT y) AS n_dup_lines FROM (SELECT r, unnest(string_split(x, chr(10))) AS y FROM t) WHERE regexp_matches(y, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, (length(x) - length(translate(x, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_stop_words, 0)::BIGINT AS n_stop_words FROM t LEFT JOIN a USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, (n_words < {min_words} OR 100 * n_repeat_words > {max_repeat} * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {" AND ".join(r.sql() for r in thresholds)}) AS kept FROM b"""
