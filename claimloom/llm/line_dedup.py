"""Line dedup with DataFrame functions only: explode, hash, count documents, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.runtime import BLANKS, ascii_lower, cut, fresh, join_by_key


def lines_of(text: Column) -> Column:
    """The text split at every line feed; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with text_col rid of repeated lines, plus n_lines (before) and n_dropped.

    A line's key is the line without white space at both ends and with A-Z lower-cased. Keys of at least min_chars
    code points that at least min_docs distinct ids hold lose all lines but those of the least id. The rest is
    joined by line feeds in its old order; null texts become empty. Repeated rows count as one document and are
    treated alike; rows that repeat an id with different texts are one document too, of which each row loses its own
    lines; rows with a null id keep their lines. Only hashes and positions are shuffled by line; texts
    move once, by id; columns n_lines and n_dropped of docs are replaced. Two 64-bit hashes stand for a key.
    """
    docs = docs.drop("n_lines", "n_dropped")
    of, of_text, gone, split = fresh(docs, "line_id", "line_mark", "line_gone", "line_parts")
    line = F.posexplode(lines_of(F.col(text_col)))
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), line.alias("pos", "line"))
    lines = lines.select("id", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    lines = lines.select("id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"))
    lines = cut(lines)  # 48 bytes a line
    by_key, n = lines.groupBy("h1", "h2"), F.count("*").alias("n")
    if min_docs == 2:  # two distinct ids: the least is not the greatest
        repeated = by_key.agg(F.min("id").alias("keeper"), F.max("id").alias("last"), n).where("keeper < last")
    else:
        held = lines.groupBy("h1", "h2", "id").agg(n)
        repeated = held.groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.count("*").alias("ids"), F.sum("n").alias("n"))
        repeated = repeated.where(F.col("ids") >= min_docs)
    dropped = join_by_key(lines, repeated, ["h1", "h2"], "n").where(F.col("id") != F.col("keeper"))
    dropped = dropped.groupBy(F.col("id").alias(of), F.col("mark").alias(of_text)).agg(F.collect_set("pos").alias(gone))
    own = (F.col(id_col) == F.col(of)) & (F.xxhash64(text_col) == F.col(of_text))
    joined = docs.join(dropped, own, "left").withColumn(split, lines_of(F.col(text_col)))
    parts = F.col(split)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    whole = F.coalesce(F.col(text_col), F.lit(""))
    text = F.when(F.col(gone).isNull(), whole).otherwise(F.array_join(F.transform(kept, lambda k: F.get(parts, k)), "\n"))
    out = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(
        *out,
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )
