"""Operator 5, quality rules [native]: DataFrame functions only.

Two kinds of rules. *Within a document*: word and symbol counts, repeated lines, words in repeated three-word
windows. *Across documents*: lines are normalised (A-Z lower-cased, white space collapsed) and hashed, and the
distinct documents that hold a line are counted per host (``source``). Lines over the limit are removed, and a
document that loses more than ``DEPLETED`` of its words is rejected.

What counts as a distinct document: exact copies of a page must not condemn it, so documents are told apart by the hash
of their whole normalised text: a page that is copied a thousand times counts once, and a line that stands in a thousand
different pages counts a thousand times. Near copies are different pages here; to keep one of them is operator 4's work.

Shuffles carry one row per distinct line and document (hashes, no text). The counts are pre-aggregated, so a line or
a host with a third of all rows is a few rows per task; the join back to documents is left to the skew join.

Defined cases: a null or empty text has no words and fails the base rule; a null host is a host of its own; repeated
rows of a document give repeated rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import written

#: Base rule: fewer words, or a larger share (in percent) of words in repeated three-word windows, fails.
MIN_WORDS = 50
MAX_REPEATED = 50
#: A line in more distinct documents of a host than this is removed.
LINE_LIMIT = 10
#: A document that loses more than this share of its words is rejected.
DEPLETED = 0.5

SPACE = r"[\x20\x09-\x0D]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _trimmed(text: Column) -> Column:
    """Without white space at the ends; in linear time, however long the white space is."""
    # possessive, and not begun inside a run: no position is looked at twice
    return F.regexp_replace(text, r"^[\x20\x09-\x0D]++|(?<![\x20\x09-\x0D])[\x20\x09-\x0D]++$", "")


def word_list(text: Column) -> Column:
    """Words between ASCII white space."""
    t = _trimmed(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def _neighbours(x: Column, k: Column, key, items: Column) -> Column:
    """Whether an element of a sorted array has the same key as the one before or after it."""
    return ((k > 0) & (key(F.get(items, k - 1)) == key(x))) | (
        (k + 1 < F.size(items)) & (key(F.get(items, k + 1)) == key(x)))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts.

    n_repeat_words: windows get a hash; hash and position share one long (the position takes as many bits as it
    needs), so that one primitive sort puts equal hashes side by side. Windows with a repeated hash are then
    compared word for word. Each array is a column of its own projection and is computed once.
    """
    words = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("w", word_list(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: _trimmed(x) != "")
    hashed = words.select(
        "doc_id", "text_hash", "w", F.size("w").alias("n"), F.length(F.concat_ws("", "w")).alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).alias("n_symbols"), lines.alias("lines"),
        F.when(F.size("w") < 4, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.size("w") - 3),
            lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).alias("h"))
    packed = hashed.withColumn("bits", F.ceil(F.log2(F.size("h") + F.lit(2))).cast("int")).withColumn("packed", F.when(
        F.size(F.array_distinct("h")) == F.size("h"), F.array().cast("array<bigint>")).otherwise(
        F.sort_array(F.transform("h", lambda x, i: F.call_function("shiftleft", x, F.col("bits")).bitwiseOR(i.cast("bigint"))))))
    key = lambda x: F.call_function("shiftrightunsigned", x, F.col("bits"))
    near = packed.withColumn("near", F.filter("packed", lambda x, k: _neighbours(x, k, key, F.col("packed"))))
    place = lambda x: (x - F.call_function("shiftleft", key(x), F.col("bits"))).cast("int")
    grams = near.withColumn("grams", F.sort_array(F.transform("near", lambda x: F.struct(
        F.concat_ws(" ", F.get("w", place(x)), F.get("w", place(x) + 1), F.get("w", place(x) + 2)).alias("g"), place(x).alias("i")))))
    same = F.filter(F.transform("grams", lambda x, k: F.when(_neighbours(x, k, lambda y: y["g"], F.col("grams")), x["i"])), lambda i: i.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(same, lambda i: F.array(i, i + 1, i + 2)))))
    return grams.select("doc_id", "text_hash", F.col("n").cast("bigint").alias("n_words"), F.col("word_chars").cast("bigint").alias("word_chars"),
                        F.col("n_symbols").cast("bigint").alias("n_symbols"),
                        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
                        covered.cast("bigint").alias("n_repeat_words"))


def normalised(line: Column) -> Column:
    """A-Z lower-cased, white space collapsed and trimmed."""
    return F.regexp_replace(_trimmed(F.translate(line, _UP, _LOW)), SPACE, " ")


def line_hash(line: Column) -> Column:
    """60 bits of the MD5 of a normalised line."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("bigint")


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per line with a word: doc_id, text_hash, host, line (hash), n_words, page (hash of all normalised lines)."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), normalised), lambda x: x != "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                       F.col(host_col).alias("host"), lines.alias("lines"))
    rows = rows.select("doc_id", "text_hash", "host", line_hash(F.array_join("lines", "\n")).alias("page"), F.explode(F.transform("lines", lambda x: F.struct(
        line_hash(x).alias("line"), F.size(F.split(x, " ")).alias("n")))).alias("x"))
    return rows.select("doc_id", "text_hash", "host", "page", F.col("x.line").alias("line"), F.col("x.n").cast("bigint").alias("n_words"))


def frequent_lines(lines: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """host, line of the lines that stand in more than ``limit`` distinct documents (pages) of their host."""
    return (lines.groupBy("host", "line").agg(F.count_distinct("page").alias("documents"))
            .where(F.col("documents") > limit).select("host", "line"))


def judge(docs: DataFrame, limit: int = LINE_LIMIT, depleted: float = DEPLETED, id_col: str = "doc_id",
          text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures of every document, base_failed, n_removed_words (words in frequent lines) and kept."""
    lines = written(document_lines(docs, id_col, text_col, host_col), "quality-lines")
    often = frequent_lines(lines, limit).select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    lost = (lines.join(often, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line")))
            .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.sum("n_words").alias("gone")))
    # repeated rows of a document add up in ``gone``; so do they here
    copies = lines.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.sum("n_words").alias("all"))
    lost = lost.join(copies.withColumnsRenamed({"_id": "_id2", "_hash": "_hash2"}),
                     F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")))
    share = lost.select("_id", "_hash", (F.col("gone") / F.col("all")).alias("share"))
    # written: a filter on the verdict must not be pushed into the array expressions, which would repeat them per element
    m = written(measures(docs, id_col, text_col), "quality-measures")
    out = m.join(share, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.select("doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), F.coalesce("share", F.lit(0.0)).alias("removed_share"),
                      (~failed & (F.coalesce("share", F.lit(0.0)) <= depleted)).alias("kept"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents, with all their columns, that :func:`judge` keeps."""
    good = judge(docs, id_col=id_col, text_col=text_col, host_col=host_col).where("kept").select(
        F.col("doc_id").alias("_good_id"), F.col("text_hash").alias("_good_hash")).distinct()
    return docs.join(good, F.col(id_col).eqNullSafe(F.col("_good_id")) & (F.xxhash64(F.col(text_col)) == F.col("_good_hash")), "left_semi")
