"""Line dedup by a suffix array over line-ID sequences (DataFrame functions only).

All lines that hold a word get positions in the order of documents and lines, with a
gap after each document, and lines that occur more than once get IDs. Prefix
doubling sorts and ranks the suffixes by their first 1, 2, 4, ... lines: the rank at
2 n lines comes from the sorted pairs of ranks at n lines, n lines apart. A suffix
whose first lines occur nowhere else leaves, so a round holds only what repeats,
and rounds end when nothing does.

Suffixes of one rank are an interval of the array. Descending from the deepest
ranks, intervals are parted by the ranks of what follows until each is as deep as
its longest common prefix; the first suffix of each part stays behind to stand for
it in the interval around. So every suffix ends as a later member of the deepest
interval that has an earlier one: that interval's depth is its longest repeat of
anything earlier. Those that no repeat from the line before covers are the maximal
repeated runs. Runs with enough words are deleted where they are later copies.

Documents with one text are grouped first: the earliest stands for them in the array,
and each other is a later copy as a whole, if it has enough words. Nothing is lost by
that, since whatever repeats in a copy is also found, earlier, in the one that stands.

Intervals are grouped minima and joins; no task sees all of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import fresh, has_word, n_words
from skyloom.scratch import ordered_index, store

MIN_WORDS = 5


def line_rows(docs: DataFrame) -> DataFrame:
    """One row for each line with a word of the first document of each text, and one of line -1 before each document: doc_id, _h (the text's hash), line (its number among all lines), name (a 128-bit digest, null for line -1), w and upto (words of the line, and of the document up to its end). Stored with `pos`, the row's place by doc_id (nulls first), _h and line."""
    split = F.split(F.col("text"), "\n", -1)
    numbered = F.transform(split, lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    kept = F.filter(numbered, lambda s: has_word(s["x"]))
    fact = lambda line, name, w: F.struct(line.cast("int").alias("line"), name.cast("binary").alias("name"), w.cast("long").alias("w"))
    facts = F.concat(F.array(fact(F.lit(-1), F.lit(None), F.lit(0))), F.transform(kept, lambda s: fact(s["line"], F.unhex(F.md5(s["x"].cast("binary"))), n_words(s["x"]))))
    texts = docs.where(F.col("text").isNotNull()).select(F.md5(F.col("text").cast("binary")).alias("_text"), F.struct("doc_id", F.xxhash64("text").alias("_h"), facts.alias("facts")).alias("d"))
    per_text = texts.groupBy("_text").agg(F.min_by("d", F.struct("d.doc_id")).alias("d"))
    rows = per_text.select("d.doc_id", "d._h", F.explode("d.facts").alias("f")).select("doc_id", "_h", "f.*")
    rows = rows.withColumn("upto", F.sum("w").over(Window.partitionBy("doc_id", "_h").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    return ordered_index(rows, [F.col("doc_id"), F.col("_h"), F.col("line")], "pos")


def ranked(level: DataFrame, keys: list[str], name: str) -> DataFrame:
    """pos, rank and head of those rows of `level` whose keys occur more than once; ranks number these keys in their order, and a head is the earliest pos of a rank. Stored."""
    several = level.groupBy(*keys).agg(F.min("pos").alias("head"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    ranks = ordered_index(several, [F.col(k) for k in keys], "rank")
    return store(level.join(ranks, keys).select("pos", "rank", "head"), name)


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """Level k has pos, rank and head of the suffixes whose first 2^k lines occur more than once, ranked by these lines."""
    levels = [ranked(lines.where("name is not null").select("pos", "name"), ["name"], "rank-1")]
    while True:
        span, level = 1 << (len(levels) - 1), levels[-1].drop("head")
        after = level.select((F.col("pos") - span).alias("pos"), F.col("rank").alias("then"))
        pairs = store(level.withColumnRenamed("rank", "this").join(after, "pos"), "pairs")
        level = ranked(pairs, ["this", "then"], f"rank-{2 * span}")
        if level.isEmpty():
            return levels
        levels.append(level)


def longest_repeats(levels: list[DataFrame]) -> DataFrame:
    """pos, n, first: the most lines from `pos` on that also begin at an earlier place, and the earliest such place. Stored.

    Rows on the way are members of intervals, which are named by their first suffix and
    their depth. A suffix comes in with the deepest level at which it isn't the head.
    """
    members = None
    for k in reversed(range(len(levels))):
        if members is not None:
            step = levels[k].select(F.col("pos").alias("_at"), "rank")
            seen = store(members.join(step, F.col("pos") + F.col("n") == F.col("_at"), "left").drop("_at"), "members")
            parts = seen.where("rank is not null").groupBy("first", "n", "rank").agg(F.min("pos").alias("head"), F.count("*").alias("size")).where("size > 1")
            deeper = seen.join(parts.drop("size"), ["first", "n", "rank"], "left")
            stays = deeper.where(F.col("head").isNull() | (F.col("pos") == F.col("head"))).select("first", "n", "pos")
            moves = deeper.where(F.col("head").isNotNull()).select(F.col("head").alias("first"), (F.col("n") + (1 << k)).alias("n"), "pos")
            members = stays.unionByName(moves)
        later = levels[k].where("pos <> head").select("pos", "head")
        if k + 1 < len(levels):
            later = later.join(levels[k + 1].where("pos <> head").select("pos"), "pos", "left_anti")
        n = F.lit(1 << k).cast("long").alias("n")
        come = store(later.select(F.col("head").alias("first"), n, "pos"), "come")
        come = come.unionByName(come.select("first", "n", F.col("first").alias("pos")).distinct())
        members = come if members is None else members.unionByName(come)
    return store(members.where("pos <> first"), "repeats")


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, _h, pos, n, start, stop: the maximal repeated runs of `min_words` words or more that are later copies: n lines with words from place `pos` on, in the document's lines from `start` to before `stop`."""
    repeats = longest_repeats(suffix_ranks(lines))
    before = repeats.select((F.col("pos") + 1).alias("pos"), (F.col("pos") + F.col("n")).alias("_end"))
    # Ends never fall from one line to the next; where they don't rise, the run goes on from the line before.
    runs = repeats.join(before, "pos", "left").where(F.col("_end").isNull() | (F.col("_end") < F.col("pos") + F.col("n"))).select("pos", "n")
    runs = store(runs, "runs")
    begin = lines.select("pos", "doc_id", "_h", F.col("line").alias("start"), (F.col("upto") - F.col("w")).alias("_before"))
    end = lines.select(F.col("pos").alias("_last"), (F.col("line") + 1).alias("stop"), F.col("upto").alias("_upto"))
    placed = begin.join(runs, "pos").withColumn("_last", F.col("pos") + F.col("n") - 1)
    placed = store(placed, "begun")
    return end.join(placed, "_last").where(F.col("_upto") - F.col("_before") >= min_words).select("doc_id", "_h", "pos", "n", "start", "stop")


def marked(runs: Column) -> Column:
    """Flags by line, up to the last run's end: true in a run. The runs of a document overlap, but both their starts and their stops rise."""

    def of(sorted_runs: Column) -> Column:
        def piece(r: Column, k: Column) -> Column:
            done = F.coalesce(F.get(sorted_runs, k - 1)["stop"], F.lit(0))
            gap, size = F.greatest(F.lit(0), r["start"] - done), r["stop"] - F.greatest(r["start"], done)
            return F.concat(F.array_repeat(F.lit(False), gap), F.array_repeat(F.lit(True), F.greatest(F.lit(0), size)))

        return F.flatten(F.transform(sorted_runs, piece))

    # A lambda's variable is evaluated once, where a column would be once for each element.
    return F.transform(F.array(F.array_sort(runs)), of)[0]


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, lines_to: str = "n_lines", removed_to: str = "n_removed") -> DataFrame:
    """All columns of `docs`, text without the later copies of repeated line runs, and n_lines, n_removed (or as named), which take the place of columns of these names.

    `docs` has doc_id and text; what comes first is told by doc_id (nulls first), then
    by the text's hash. A null text stays null with no lines; blank lines are never
    deleted and never part of a run; rows that repeat both doc_id and text are one
    document and are edited alike. Other columns pass through. No rows give no rows.
    """
    lines = line_rows(docs.select("doc_id", "text"))
    run = F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))
    marks = repeated_runs(lines, min_words).select("doc_id", "_h", run.alias("run"))
    firsts = lines.where("line = -1").select("doc_id", "_h", F.lit(None).cast(marks.schema["run"].dataType).alias("run"))
    marks = firsts.unionByName(marks).groupBy("doc_id", "_h").agg(F.collect_list("run").alias("runs"))
    key, runs = fresh(docs, "_h"), fresh(docs, "_runs")
    marks = marks.select(F.col("doc_id").alias(fresh(docs, "_doc")), F.col("_h").alias(fresh(docs, "_text")), F.col("runs").alias(runs))
    named = docs.withColumn(key, F.xxhash64("text"))
    joined = named.join(marks, named["doc_id"].eqNullSafe(marks[marks.columns[0]]) & (named[key] == marks[marks.columns[1]]), "left")
    split = F.split(F.col("text"), "\n", -1)
    left = F.transform(F.array(marked(F.col(runs))), lambda flags: F.filter(split, lambda x, i: ~(F.coalesce(F.get(flags, i), F.lit(False)) & has_word(x))))[0]
    # No runs, not even an empty list: a later copy of a whole text, which is one repeated run.
    wordless = F.when(n_words(F.col("text")) >= min_words, F.filter(split, lambda x: ~has_word(x))).otherwise(split)
    left = F.when(F.col(runs).isNull(), wordless).when(F.size(runs) == 0, split).otherwise(left)
    done = joined.withColumn(runs, left)
    count = lambda n: F.coalesce(n, F.lit(0)).cast("long")
    out = done.select(
        *[F.when(F.size(split) == F.size(runs), F.col("text")).otherwise(F.array_join(runs, "\n")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in (lines_to, removed_to)],
        count(F.when(F.col("text").isNotNull(), F.size(split))).alias(lines_to),
        count(F.when(F.col("text").isNotNull(), F.size(split) - F.size(runs))).alias(removed_to),
    )
    return out


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of `docs` with later copies of repeated line runs deleted and n_chars, if there, brought up to date; a document that loses all its words goes."""
    n, gone = fresh(docs, "n_lines"), fresh(docs, "n_removed")
    out = dedup_lines(docs, min_words, n, gone)
    left = out.where((F.col(gone) == 0) | has_word(F.col("text")))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


#: Pairs of equal lines on one diagonal of two documents form maximal matches; all lines of the later side go where it has enough words.
ORACLE_SQL = rf"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(ls) AS x, unnest(range(0, len(ls))) AS line FROM s WHERE text IS NOT NULL),
l AS (SELECT doc_id, line, x, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS i,
  len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM u WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
p AS (SELECT a.doc_id AS d1, b.doc_id AS d2, b.i, b.line, b.w, b.i - a.i AS diag FROM l a JOIN l b ON a.x = b.x AND (a.doc_id, a.i) < (b.doc_id, b.i)),
q AS (SELECT *, i - row_number() OVER (PARTITION BY d1, d2, diag ORDER BY i) AS run FROM p),
z AS (SELECT DISTINCT d2 AS doc_id, line FROM (SELECT *, sum(w) OVER (PARTITION BY d1, d2, diag, run) AS words FROM q) WHERE words >= {MIN_WORDS}),
g AS (SELECT doc_id, list(line) AS gone FROM z GROUP BY doc_id)
SELECT s.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  md5(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END) AS kept_md5
FROM s LEFT JOIN g ON s.doc_id = g.doc_id
"""
