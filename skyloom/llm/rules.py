"""Quality rules as a short-circuit cascade (DataFrame functions only).

The cost of a rule is its time over a bounded stored sample, its selectivity the
share of the sample that it rejects. Rules then run in falling order of
rejection per cost, each only for documents that all earlier rules let pass.
The order never changes a verdict, only what is spent on it.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import SPACES, has_word, n_words, sampled, words
from skyloom.scratch import store

#: Bound of the sample that costs and selectivities are estimated on.
SAMPLE_ROWS = 1_000
#: How often the sample is read within a timing, and timings of each rule.
REPEATS, TIMINGS = 4, 3
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def n_repeat_words(w: Column) -> Column:
    """Words in windows of five that are found twice or more in the array `w`, first ones included.

    Hashes of windows are compared, first through a set; only where that finds a
    repeat are (hash, position) pairs sorted, and the stretches that the repeated
    windows cover are added up.
    """

    def hashed(w: Column) -> Column:
        at = lambda i: [F.get(w, i + k) for k in range(WINDOW)]
        return F.when(F.size(w) > WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*at(i)))).otherwise(F.array().cast("array<bigint>"))

    # A lambda's variable is evaluated once, where a column would be once for each element.
    hashes = F.transform(F.array(w), hashed)[0]

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, i, j: F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))
        repeated = F.transform(F.array(pairs), lambda s: F.filter(F.transform(s, lambda x, i: F.when((i > 0) & same(s, i, i - 1) | same(s, i, i + 1), x["i"])), lambda x: x.isNotNull()))[0]
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at"))
        return F.aggregate(F.sort_array(repeated), start, step)["n"]

    per = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))
    return F.transform(F.array(hashes), per)[0].cast("long")


def base_columns(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines of a text, all 0 for null."""
    t = F.coalesce(text, F.lit(""))
    lines = F.transform(F.array(F.filter(F.split(t, "\n", -1), has_word)), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]
    return {
        "n_words": n_words(t),
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": lines.cast("long"),
    }


def rules(text: str = "text") -> dict[str, Column]:
    """Name of a rule: true where it rejects. Over the base columns and the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.col("n_words")
    lines = F.filter(F.split(t, "\n", -1), has_word)
    upper = F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return {
        "too_many_words": n > 1_000_000,
        "word_length_low": F.col("word_chars") < 2 * n,
        "word_length_high": F.col("word_chars") > 14 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.size(lines),
        "shouting": 2 * upper > letters,
        "few_letters": 2 * letters < F.col("word_chars"),
        "ellipsis_lines": 10 * F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))) > 3 * F.size(lines),
        "bullet_lines": 10 * F.size(F.filter(lines, lambda x: F.ltrim(x).rlike(r"^[-*•]"))) > 9 * F.size(lines),
    }


def rule_order(measured: DataFrame, total: int, named: dict[str, Column]) -> list[str]:
    """The rules by estimated rejections per second. The sample, about SAMPLE_ROWS rows (twice that at most) drawn by a hash, is stored and read several times over, and the median of a few timings counts, so that a rule's own cost stands out from that of a job."""
    drawn = sampled(measured, total, SAMPLE_ROWS, F.col("doc_id"), F.col("text"))
    sample = store(drawn, "rule-sample")
    many = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def spent(c: Column) -> tuple[float, float]:
        found = []
        for _ in range(TIMINGS):
            began = time.perf_counter()
            rejected = many.agg(F.avg((F.coalesce(c, F.lit(False)) & (F.col("_again") > 0)).cast("int"))).first()[0] or 0.0
            found.append(time.perf_counter() - began)
        return sorted(found)[TIMINGS // 2], rejected

    spent(F.lit(False))  # what compiling and scheduling cost comes off
    idle, _ = spent(F.lit(False))
    worth = {}
    for name, rule in named.items():
        seconds, rejected = spent(rule)
        worth[name] = rejected / max(seconds - idle, 1e-3)
    return sorted(named, key=lambda x: (-worth[x], x))


def cascade(named: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule in the order that rejects, null if none; later rules aren't evaluated."""
    out = F
    for name in order:
        out = out.when(F.coalesce(named[name], F.lit(False)), F.lit(name))
    return out


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base counts, base_failed, kept and rejected_by for each row.

    A null or blank text has zero counts and fails the base rules. Repeated rows
    are judged alike, each for itself. Columns beside the two named are not looked
    at. No rows give no rows. `rejected_by` names a rule that rejects (the first in
    the estimated order), `base` where the base rules do.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counted = plain.withColumns(base_columns(F.col("text")))
    named = rules("text")
    order = rule_order(counted, plain.count(), named)
    counted = counted.withColumn("n_repeat_words", n_repeat_words(words(F.col("text"))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed)
    judged = judged.withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(cascade(named, order)))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("rejected_by").isNull().alias("kept"), "rejected_by",
    )


_LINES = r"list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
_UPPER = r"(length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')))"
_LETTERS = r"length(regexp_replace(t, '[^\p{L}]', '', 'g'))"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, {_LINES} AS ls FROM d),
g AS (SELECT rn, i, array_to_string(ws[i:i+4], ' ') AS gram FROM (SELECT rn, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rn, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rn, i, lead(i) OVER (PARTITION BY rn ORDER BY i) AS nxt FROM r) GROUP BY rn),
b AS (SELECT doc_id, t, ls, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (rn)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_words > 1000000 OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_symbols > n_words
    OR 10 * n_dup_lines > 3 * len(ls) OR 2 * {_UPPER} > {_LETTERS} OR 2 * {_LETTERS} < word_chars
    OR 10 * len(list_filter(ls, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) > 3 * len(ls)
    OR 10 * len(list_filter(ls, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) > 9 * len(ls)) AS kept
FROM f
"""
