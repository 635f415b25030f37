"""Quality rules whose thresholds follow each language and source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import let
from tidemark.session import materialize

WORD_GAPS = "[ \\t-\\r]+"
LONGS = "array<bigint>"
#: Metric -> slack beyond the fence.  All are integers, so that every engine finds the same thresholds.
METRICS = {"sym": 100, "mwl": 100, "dup": 400, "upper": 300, "bang": 300}
#: A sketch of fewer documents isn't trusted; the merged one of the language, then of all, is taken.
MIN_GROUP = 100


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAPS), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the text."""

    def grams(h: Column) -> Column:
        three = lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))
        return F.when(F.size(h) >= 3, F.transform(F.sequence(F.lit(0), F.size(h) - 3), three)).otherwise(F.array().cast(LONGS))

    def covered(at: Column) -> Column:  # of the sorted starts of such windows
        new = F.transform(at, lambda p, k: F.when(k > 0, F.least(F.lit(3), p - F.get(at, k - 1))).otherwise(3))
        return F.aggregate(new, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:  # of windows sorted by hash
        same = lambda e, k: F.coalesce(F.get(s, k)["x"] == e["x"], F.lit(False))
        marked = F.transform(s, lambda e, k: F.struct(e["i"].alias("i"), (same(e, k - 1) | same(e, k + 1)).alias("d")))
        return let(F.sort_array(F.transform(F.filter(marked, lambda e: e["d"]), lambda e: e["i"])), covered)

    def count(g: Column) -> Column:
        some = F.size(F.array_distinct(g)) < F.size(g)
        return F.when(some, let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), repeated)).otherwise(0)

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(grams(h), count)).cast("long")


def measures(text: Column) -> Column:
    """The counts of one text as a struct of longs."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        def of_letters(j: Column) -> Column:
            n = F.char_length(j)
            without = lambda pattern: (n - F.char_length(F.regexp_replace(j, pattern, ""))).cast("long")
            lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                n.cast("long").alias("word_chars"),
                without("[#*$%&|<>]+").alias("n_symbols"),
                let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
                _repeat_words(words).alias("n_repeat_words"),
                let(lines, lambda x: F.size(x).cast("long")).alias("n_lines"),
                without("\\p{Lu}+").alias("n_upper"),
                without("[!?]+").alias("n_bang"),
            )

        return let(F.array_join(words, ""), of_letters)

    return let(words_of(text), of_words)


def ratios() -> list[Column]:
    """The metrics in thousandths (mean word length in hundredths), from the counts."""
    per = lambda a, b, k: F.expr(f"cast({k} * {a} div greatest({b}, 1) as bigint)")
    return [
        per("n_symbols", "n_words", 1000).alias("sym"),
        per("word_chars", "n_words", 100).alias("mwl"),
        per("n_dup_lines", "n_lines", 1000).alias("dup"),
        per("n_upper", "word_chars", 1000).alias("upper"),
        per("n_bang", "n_words", 1000).alias("bang"),
    ]


def bucket_of(v: Column) -> Column:
    """Bucket of a non-negative integer: itself below 256, else its upper 8 bits and their place (error below 1/128)."""
    shift = F.greatest(F.length(F.bin(v)) - 8, F.lit(0))
    return F.shiftleft(shift.cast("long"), 8) + F.call_function("shiftright", v, shift)


def lower_bound(b: Column) -> Column:
    return F.call_function("shiftleft", b.bitwiseAND(F.lit(255).cast("long")), F.shiftright(b, 8).cast("int"))


def sketches(measured: DataFrame) -> DataFrame:
    """Mergeable quantile sketches: counts by language, source, metric and bucket.

    Sketches merge by adding counts, exactly and in any order, so map-side partial
    sums, retries and lost executors can't change a threshold.
    """
    entries = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket_of(F.col(m)).alias("bucket")) for m in METRICS]))
    return measured.where("n_words > 0").select("lang", "source", entries.alias("e")).groupBy("lang", "source", "e.metric", "e.bucket").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Documents and quartiles of each metric (values at buckets' lower bounds) for each group of ``keys``."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "metric")
    upto = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    at = lambda q: lower_bound(F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket"))))
    return upto.groupBy(*keys, "metric").agg(F.max("total").alias("docs"), at(1).alias("q1"), at(3).alias("q3"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """For each language and source the largest (and for word length least) value of each metric that passes."""
    keys = sketch.select("lang", "source").distinct()
    levels = [
        keys.join(_quartiles(sketch, ["lang", "source"]).withColumnsRenamed({"lang": "l", "source": "s"}), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).drop("l", "s"),
        keys.join(_quartiles(sketch, ["lang"]).withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l"))).drop("l"),
        keys.withColumn("metric", F.explode(F.array(*map(F.lit, METRICS)))).join(F.broadcast(_quartiles(sketch, [])), "metric"),  # of one row for each metric
    ]
    level = reduce(DataFrame.unionByName, [x.withColumn("level", F.lit(i)) for i, x in enumerate(levels)])
    usable = level.where((F.col("docs") >= MIN_GROUP) | (F.col("level") == 2))
    chosen = usable.groupBy("lang", "source", "metric").agg(F.min_by(F.struct("q1", "q3"), "level").alias("q"))
    fence = F.col("q.q3") + 3 * (F.col("q.q3") - F.col("q.q1"))
    most = [F.max(F.when(F.col("metric") == m, fence + slack)).alias(f"most_{m}") for m, slack in METRICS.items()]
    least = F.max(F.when(F.col("metric") == "mwl", F.col("q.q1") - 3 * (F.col("q.q3") - F.col("q.q1")) - METRICS["mwl"])).alias("least_mwl")
    return chosen.groupBy("lang", "source").agg(*most, least)


def judge(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row, after the columns in ``carry`` (``doc_id`` unless given).

    A text fails the base rules with fewer than 50 words, or when over half of its
    words lie in repeated 3-word windows.  Others are held against thresholds of
    their language and source: Tukey's far fence, 3 quartile distances beyond the
    quartiles, and a slack for groups without spread.  Quartiles come from mergeable
    sketches over all documents with words (``sketches``); small groups take merged
    ones.  Counts are taken once and written to the shared folder, then read for
    the sketches and for the verdict.

    Null and empty texts have no words, take no part in sketches and fail; a null
    language or source is a group of its own; equal rows get equal verdicts; an
    empty table gives no rows.
    """
    carry = ["doc_id"] if carry is None else carry
    packed = F.struct(*[F.col(c) for c in carry]).alias("row") if carry else F.lit(None).alias("row")
    slim = docs.select(packed, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), measures(F.col(text_col)).alias("m"))
    measured = materialize(slim.select("row", "lang", "source", "m.*").select("*", *ratios()), "measures")
    limits = thresholds(sketches(measured)).withColumnsRenamed({"lang": "l", "source": "s"})
    within = [F.col(m) <= F.col(f"most_{m}") for m in METRICS] + [F.col("mwl") >= F.col("least_mwl")]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passed = F.coalesce(reduce(Column.__and__, within), F.lit(False))
    out = measured.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    return out.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & passed).alias("kept"))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``judge`` with the id of each row."""
    return judge(docs, text_col, [id_col]).select(F.col("row")[id_col].alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    return judge(docs, text_col, docs.columns).where("kept").select("row.*")
