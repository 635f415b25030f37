"""Merkle fingerprints of documents: equal roots for equal texts, differing branches where texts differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import let

#: Code points in a leaf.
LEAF = 16
#: Documents in a range of ids, and the most ranges.
RANGE_ROWS, MAX_RANGES = 1000, 1 << 14


def _hex(x: Column, digits: int) -> Column:
    return F.substring(F.sha2(x, 256), 1, digits)


def tree(text: Column) -> Column:
    """The Merkle tree of a text: ``root``, the whole ``fingerprint`` and the ``leaves``.

    Sections are parted by blank lines and hold paragraphs, one a line; leaves are
    blocks of 16 code points of a paragraph.  A paragraph's node hashes its text, a
    section's node its paragraphs' nodes, the root the sections' nodes and the text's
    length.  The string is ``root/section:paragraph.leaves,paragraph.leaves;section:...``
    with 64, 16, 16 and 8 hexadecimal digits, so two strings can be compared branch by branch.
    """
    text = F.coalesce(text, F.lit(""))

    def of_paragraph(p: Column) -> Column:
        blocks = F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{LEAF}}}"), 0), lambda b: F.crc32(F.encode(b, "UTF-8")))
        return F.struct(_hex(p, 16).alias("node"), blocks.alias("leaves"))

    def of_section(ps: Column) -> Column:
        return F.struct(_hex(F.array_join(F.transform(ps, lambda p: p["node"]), ","), 16).alias("node"), ps.alias("paragraphs"))

    sections = F.transform(F.split(text, "\n\n"), lambda s: let(F.transform(F.split(s, "\n"), of_paragraph), of_section))

    def written(p: Column) -> Column:
        return F.concat(p["node"], F.lit("."), F.array_join(F.transform(p["leaves"], lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), ""))

    def whole(ss: Column) -> Column:
        root = F.sha2(F.concat(F.array_join(F.transform(ss, lambda s: s["node"]), ";"), F.lit("/"), F.char_length(text).cast("string")), 256)
        body = F.array_join(F.transform(ss, lambda s: F.concat(s["node"], F.lit(":"), F.array_join(F.transform(s["paragraphs"], written), ","))), ";")
        leaves = F.flatten(F.transform(ss, lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["leaves"]))))
        return let(root, lambda r: F.struct(r.alias("root"), F.concat(r, F.lit("/"), body).alias("fingerprint"), F.array_distinct(leaves).alias("leaves")))

    return let(sections, whole)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else twice the leaves in common over the leaves of both, below 1."""
    both = F.size(a["leaves"]) + F.size(b["leaves"])
    shared = F.size(F.array_intersect(a["leaves"], b["leaves"]))
    return F.when(a["root"] == b["root"], 1.0).when(both == 0, 0.0).otherwise(F.least(2.0 * shared, both - 1.0) / both)


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Places (section, paragraph) at which two fingerprints differ; subtrees with equal nodes aren't entered."""
    sections = lambda f: F.split(F.substring_index(f, "/", -1), ";")
    paragraphs = lambda s: F.split(F.substring_index(s, ":", -1), ",")

    def pair(x: Column, y: Column, i: Column) -> Column:
        same = F.zip_with(paragraphs(F.coalesce(x, F.lit(":"))), paragraphs(F.coalesce(y, F.lit(":"))), lambda p, q: ~p.eqNullSafe(q))
        where = F.filter(F.transform(same, lambda d, k: F.when(d, F.struct(i.alias("section"), k.alias("paragraph")))), lambda d: d.isNotNull())
        return F.when(x.eqNullSafe(y), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(where)

    zipped = F.zip_with(sections(a), sections(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.when(a == b, F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(F.flatten(F.transform(zipped, lambda z, i: pair(z["x"], z["y"], i))))


def _range_of(id_: Column, bounds: list[int]) -> Column:
    """How many bounds are below the id, by bisection."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    array = F.expr("array(" + ",".join(f"{b}L" for b in bounds) + ")")
    jump = lambda at, s: F.when((at + s <= len(bounds)) & (F.get(array, at + s - 1) < id_), at + s).otherwise(at)
    return F.coalesce(F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), jump), F.lit(0))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``range``, ``ghost``, ``doc_id``, ``text`` such that the next row by descending id stands in the same range.

    Ids are dealt to ranges between quantiles.  The top document of each range also
    goes, as a ghost, behind the last of the range above; that of the highest range
    goes behind the last of the lowest, which closes the ring.  The table of tops has a
    row for each range, ``MAX_RANGES`` at most.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = own.count()
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    bounds: list[int] = []
    if ranges > 1:
        cuts = [i / ranges for i in range(1, ranges)]
        bounds = sorted(set(own.agg(F.percentile_approx("doc_id", cuts, 20 * ranges)).first()[0] or []))
    dealt = own.withColumn("range", _range_of(F.col("doc_id"), bounds))
    tops = dealt.groupBy("range").agg(F.max("doc_id").alias("top"))
    ring = W.partitionBy(F.lit(0)).orderBy("range")  # of the tops alone
    above = F.coalesce(F.lead("range").over(ring), F.first("range").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    ghosts = tops.select("top", above.alias("to"))
    places = F.when(F.col("to").isNull(), F.array(F.struct("range", F.lit(False).alias("ghost")))).otherwise(
        F.array(F.struct("range", F.lit(False).alias("ghost")), F.struct(F.col("to").alias("range"), F.lit(True).alias("ghost")))
    )
    marked = dealt.join(F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("top")), "left")
    return marked.select("doc_id", "text", F.explode(places).alias("p")).select("p.*", "doc_id", "text")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    The edited text has its last third replaced by the start of the next document by
    descending id.  Texts are shuffled once, into ranges of ids sorted within, where
    the next document is the next row; all is built in.

    A null text is empty, an empty one has one empty paragraph and no leaf.  A lone
    document is its own next one.  Rows with one id stand in the order of their texts'
    hashes; equal rows are interchangeable.  Null ids come last.  An empty table gives no rows.
    """
    dealt = with_next(docs, id_col, text_col).repartition("range")
    trees = dealt.select("*", tree(F.col("text")).alias("own"))
    order = W.partitionBy("range").orderBy("ghost", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    beside = trees.select("*", F.lead(F.struct("text", "own.root", "own.leaves")).over(order).alias("next")).where("not ghost")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.expr("substring(next.text, 1, cast(floor(char_length(text) / 3) as int))"))
    both = beside.select("doc_id", n.cast("long").alias("n_chars"), "own", "next", F.when(third > 0, edited).otherwise(F.col("text")).alias("edited_text"))
    done = both.select("*", tree(F.col("edited_text")).alias("edited"))
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        F.col("own.fingerprint").alias("fingerprint"),
        F.col("edited.fingerprint").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
