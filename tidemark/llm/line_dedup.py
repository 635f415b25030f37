"""Repeated runs of lines, found with a suffix array over line names by prefix doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import discard, materialize

PLACE = ("doc_id", "copy", "line")
INTERVAL = ("lcp", "name")


def _worded(line: Column) -> Column:
    return line.rlike("[^ \\t-\\r]")


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """``doc_id`` and ``copy``: they tell rows apart, also those with one id or none; a row without an id stands where 0 would."""
    id_ = F.col(id_col).cast("long")
    return [F.coalesce(id_, F.lit(0)).alias("doc_id"), F.xxhash64(F.col(text_col), id_.isNull()).alias("copy")]


def _names(keys: DataFrame, *by: str) -> DataFrame:
    """Distinct keys with a ``name``: numbers in the order of the keys, with gaps."""
    return materialize(keys.orderBy(*by).withColumn("name", F.monotonically_increasing_id()), "names")


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10) -> DataFrame:
    """A row per line with a word: document, copy number, place among such lines, 128-bit key, and whether it has ``min_words``.

    ``copy`` is a hash of the text, which tells rows with one id apart.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), _worded)
    many = lambda x: F.size(F.filter(F.split(x, "[ \\t-\\r]+"), lambda w: w != "")) >= min_words
    keys = F.transform(lines, lambda x: F.struct(F.unhex(F.md5(F.encode(x, "UTF-8"))).alias("key"), many(x).alias("long")))
    own = docs.select(*_row_key(id_col, text_col), F.posexplode(keys).alias("line", "x"))
    return own.select(*PLACE, "x.key", "x.long")


def prefix_ranks(lines: DataFrame) -> list[DataFrame]:
    """Ranks of suffixes by their first 1, 2, 4, ... lines, for suffixes that share them with another.

    A line that occurs once ends every repeated run, so suffixes start and go on in
    repeated lines only, and each level holds those whose first lines occur twice at
    least.  A rank is the name of a pair of ranks half as deep, and names follow the
    order of pairs: sorted by the ranks of all levels the suffixes form the suffix
    array, and those with one rank at a level stand together in it.
    Levels end where no run is repeated.
    """
    keys = lines.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    names = _names(keys, "key")
    level = materialize(lines.join(names, "key").select(*PLACE, "long", F.col("name").alias("rank")).dropDuplicates(list(PLACE)), "ranks0")
    discard(names)
    levels = [level]
    while True:
        step = 1 << (len(levels) - 1)
        behind = level.select("doc_id", "copy", (F.col("line") - step).alias("line"), F.col("rank").alias("then"))
        pairs = materialize(level.join(behind, list(PLACE)).select(*PLACE, "rank", "then"), "pairs")
        names = _names(pairs.groupBy("rank", "then").agg(F.count("*").alias("n")).where("n > 1").select("rank", "then"), "rank", "then")
        level = materialize(pairs.join(names, ["rank", "then"]).select(*PLACE, F.col("name").alias("rank")), f"ranks{len(levels)}")
        discard(pairs, names)
        if level.isEmpty():
            discard(level)
            return levels
        levels.append(level)


def lcp_intervals(levels: list[DataFrame], min_lines: int = 2) -> DataFrame:
    """Members (``PLACE``) of the intervals (``lcp``, ``name``) of the suffix array that share ``min_lines`` lines or more.

    All suffixes of an interval share their first ``lcp`` lines, and no two members
    share more: where some do, they form a deeper interval, and its first suffix alone
    stands for it here.  So intervals form the tree of maximal repeated runs, a suffix
    that isn't the first of its interval is the later copy of a run of ``lcp`` lines,
    and it is that in one interval only, the deepest with an earlier suffix.

    Depths are found by halves: from the deepest level to the first, members of an
    interval move on by ``2**k`` lines with those that have the same rank of level k
    behind their common lines.
    """
    state = levels[0].select(*PLACE, F.lit(0).alias("lcp"), F.lit(0).cast("long").alias("name")).limit(0)
    made: list[DataFrame] = []
    for k in reversed(range(len(levels))):
        rank = levels[k].select(*PLACE, F.col("rank").alias("then"))
        if (2 << k) - 1 >= min_lines:  # a run that starts with this level may be long enough
            new = rank.select(*PLACE) if k + 1 == len(levels) else rank.select(*PLACE).join(levels[k + 1].select(*PLACE), list(PLACE), "left_anti")
            state = state.unionByName(new.select(*PLACE, F.lit(0).alias("lcp"), F.lit(0).cast("long").alias("name")))
        else:
            state = state.where("lcp > 0")
        behind = rank.select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), F.col("line").alias("l"), "then")
        found = state.join(behind, F.expr("doc_id = d and copy = c and line + lcp = l"), "left").drop("d", "c", "l")
        ranked = materialize(found, "ranked")
        groups = ranked.where("then is not null").groupBy(*INTERVAL, "then").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1")
        names = materialize(groups.select(*INTERVAL, "then", "first", F.monotonically_increasing_id().alias("deeper")), "intervals")
        moved = ranked.join(names.drop("first"), [*INTERVAL, "then"], "left")
        moved = moved.select(*PLACE, F.when(F.col("deeper").isNull(), F.col("lcp")).otherwise(F.col("lcp") + (1 << k)).alias("lcp"), F.coalesce("deeper", "name").alias("name"))
        state = materialize(moved.unionByName(names.select("first.*", *INTERVAL)), "state")
        discard(ranked, names, *made)
        made = [state]
    return state.where(F.col("lcp") >= min_lines)


def later_copies(levels: list[DataFrame], min_lines: int = 2) -> tuple[DataFrame, DataFrame]:
    """Later copies of maximal repeated runs, with their ``lcp`` lines, and later copies of single long lines.

    The first suffix of an interval by document and line stays.  A later one that
    begins within the lines of the first is no copy beside it.
    """
    members = materialize(lcp_intervals(levels, min_lines), "members")
    firsts = members.groupBy(*INTERVAL).agg(F.min(F.struct(*PLACE)).alias("first")).select(*INTERVAL, "first.*")
    later = members.join(firsts, [*INTERVAL, *PLACE], "left_anti")
    here = firsts.withColumnRenamed("line", "start")  # joined by document: no interval is one task
    apart = later.join(here, [*INTERVAL, "doc_id", "copy"], "left").where("start is null or line - start >= lcp")
    long = levels[0].where("long")
    first_lines = long.groupBy("rank").agg(F.min(F.struct(*PLACE)).alias("first")).select("first.*")
    return apart.select(*PLACE, "lcp"), long.select(*PLACE).join(first_lines, list(PLACE), "left_anti")


def _deletions(docs: DataFrame, id_col: str, text_col: str, min_lines: int, min_words: int) -> DataFrame:
    """Sorted places of the lines to delete for each document that has some, and the lines of its longest copied run."""
    lines = materialize(line_table(docs, id_col, text_col, min_words), "lines")
    levels = prefix_ranks(lines)
    discard(lines)
    runs, long = later_copies(levels, min_lines)
    copies = runs.unionByName(long.withColumn("lcp", F.lit(1)))
    before = W.partitionBy("doc_id", "copy").orderBy("line", "lcp").rowsBetween(W.unboundedPreceding, -1)  # of one document
    fresh = F.greatest(F.col("line"), F.max(F.col("line") + F.col("lcp")).over(before)).alias("fresh")  # lines from there aren't covered yet
    parts = copies.select("doc_id", "copy", "line", "lcp", fresh)
    new = F.when(F.col("line") + F.col("lcp") > F.col("fresh"), F.sequence("fresh", F.col("line") + F.col("lcp") - 1)).otherwise(F.array().cast("array<int>"))
    gone = parts.select("doc_id", "copy", "lcp", new.alias("new")).groupBy("doc_id", "copy").agg(F.sort_array(F.flatten(F.collect_list("new"))).alias("gone"), F.max("lcp").alias("longest"))
    out = materialize(gone, "gone")
    discard(*levels)
    return out


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines, counted among lines with a word, at the sorted places ``gone``."""
    lines = F.split(text, "\n")
    # places of worded lines among all lines
    worded = F.filter(F.transform(lines, lambda x, i: F.when(_worded(x), i)), lambda i: i.isNotNull())
    dropped = F.transform(gone, lambda g: F.get(worded, g))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")


def delete_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int = 10) -> DataFrame:
    """``docs`` without later copies of repeated runs of lines; ``n_chars``, if there, is counted anew.

    A run repeats if its lines stand in the same order elsewhere, in another document
    or further on in the same one.  At each line the longest run is taken that stands
    earlier too (``lcp_intervals``); it goes if it has ``min_lines`` lines and doesn't
    overlap its first copy by (id, line), which stays.  Later copies of one line of
    ``min_words`` words go as well.  Lines without a word are no part of runs and stay.
    Rows stay, even those that lose all lines.  Nothing is collected: levels of ranks
    and intervals are tables in the shared folder.

    Null and empty texts stay as they are.  Rows with a null id stand where id 0 would
    and lose lines as any other.  Rows with one id are told apart by their
    texts and come in the order of the texts' hashes; rows equal in both count as one
    document and lose the same lines.  An empty table stays empty.
    """
    gone = _deletions(docs, id_col, text_col, min_lines, min_words)
    left = docs.select(F.struct(*docs.columns).alias("row"), *_row_key(id_col, text_col))
    both = left.join(gone.hint("merge"), ["doc_id", "copy"], "left")  # texts move alike at any size
    text = F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(_without(F.col("row")[text_col], F.col("gone")))
    cols = [text.alias(c) if c == text_col else F.char_length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return both.select(*cols)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int = 10) -> DataFrame:
    """For every row its lines with a word, those deleted, the stretches they form, the lines of its longest copied run, and a hash of the text left."""
    gone = _deletions(docs, id_col, text_col, min_lines, min_words)
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = docs.select(F.col(id_col).cast("long").alias("id"), *_row_key(id_col, text_col), text.alias("text"))
    both = left.join(gone.hint("merge"), ["doc_id", "copy"], "left")  # texts move alike at any size
    starts = F.filter(F.transform("gone", lambda g, i: F.when((i == 0) | (F.get("gone", i - 1) != g - 1), i)), lambda i: i.isNotNull())
    return both.select(
        F.col("id").alias("doc_id"),
        F.size(F.filter(F.split("text", "\n"), _worded)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce(F.size(starts), F.lit(0)).cast("long").alias("n_runs"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest_run"),
        F.sha2(F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("gone"))), 256).alias("kept_sha256"),
    )
