"""Embedding, search and snippets, with any encoder of texts into vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from claimloom.functions.isolated import Function
from claimloom.functions.text import sentences
from claimloom.operators.joins import missing_from, upsert
from claimloom.operators.numbering import numbered
from claimloom.operators.ranking import best_of_group, nearest
from claimloom.sources.shared import Store, scratch

Encoder = Callable[[list[str]], np.ndarray]
#: Marks that tell an asymmetric encoder questions from texts, and characters of a snippet where there is no sentence.
QUERY, PASSAGE, FALLBACK = "query: ", "passage: ", 200


def hashing_encoder(dim: int = 384) -> Encoder:
    """Signed counts of hashed character trigrams: a stand-in where no model is at hand; the marks are left out."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for k, t in enumerate(texts):
            data = f"  {t.removeprefix(QUERY).removeprefix(PASSAGE).lower()} ".encode()
            codes = np.frombuffer(data, np.uint8).astype(np.uint64)
            if len(codes) > 2:
                h = (codes[:-2] * np.uint64(65599) + codes[1:-1] * np.uint64(257) + codes[2:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
                np.add.at(out[k], (h % np.uint64(dim)).astype(int), np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0))
        return out

    return encode


def unit_vectors(encode: Encoder, mark: str, dim: int) -> Function:
    """A function from texts to unit vectors, null for blank ones; a vector of another length is an error."""

    def of(texts: list[str]) -> list:
        known = [k for k, t in enumerate(texts) if t and t.strip()]
        out: list = [None] * len(texts)
        if known:
            found = np.asarray(encode([mark + texts[k] for k in known]), float)
            if found.shape[1] != dim:
                raise ValueError(f"the encoder gives {found.shape[1]} numbers, not {dim}")
            size = np.linalg.norm(found, axis=1, keepdims=True)
            for k, v in zip(known, (found / np.where(size > 0, size, 1)).astype(np.float32), strict=True):
                out[k] = v
        return out

    return of


def embed(text: Column, make: Callable[[], Encoder], mark: str = PASSAGE, dim: int = 384) -> Column:
    """Unit vectors of a text column; null and blank texts give null. The encoder is made once a task and gets whole
    batches; a vector of another length is an error. isolated() over unit_vectors() is for encoders that may fail."""

    @F.pandas_udf("array<float>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors = unit_vectors(make(), mark, dim)
        for texts in batches:
            yield pd.Series(vectors(texts.tolist()), dtype=object)

    return udf(text)


def question_vector(question: str, encode: Encoder) -> Column:
    """The unit vector of one question as a literal array."""
    v = np.asarray(encode([QUERY + question]), float)[0]
    return F.array(*[F.lit(float(x)) for x in v / (np.linalg.norm(v) or 1)])


def store(current: DataFrame, texts: DataFrame, make: Callable[[], Encoder], key: str = "claim_id", dim: int = 384) -> DataFrame:
    """Vectors (key, embedding) after those of texts (key, text, at) are put in by key, the last text winning; a
    blank text raises."""
    if texts.where("coalesce(trim(text), '') = ''").limit(1).count():
        raise ValueError("blank text")
    new = texts.select(key, embed(F.col("text"), make, dim=dim).alias("embedding"), F.struct(F.lit(1).alias("new"), F.col("at").cast("string").alias("at")).alias("at"))
    old = current.withColumn("at", F.struct(F.lit(0).alias("new"), F.lit(None).cast("string").alias("at")))
    return upsert(old, new, key, "at").drop("at")


def backfill(claims: DataFrame, vectors: DataFrame, make: Callable[[], Encoder], key: str = "claim_id", force: bool = False, limit: int | None = None, dim: int = 384) -> DataFrame:
    """Vectors of the claims (key, text) that have none yet, or of all with force, at most `limit` of them."""
    todo = (claims if force else missing_from(claims, vectors, key)).where("trim(text) != ''")
    if limit is not None:
        todo = todo.orderBy(key).limit(limit)
    return todo.select(key, embed(F.col("text"), make, dim=dim).alias("embedding"))


def search(vectors: DataFrame, question: str, make: Callable[[], Encoder], key: str = "claim_id", k: int = 5) -> DataFrame:
    """The k rows nearest to a question with their scores, exactly."""
    return nearest(vectors, question_vector(question, make()), "embedding", key, k)


def snippets(hits: DataFrame, question: str, make: Callable[[], Encoder], key: str, text: str, dim: int = 384, split: Callable[[Column], Column] = sentences) -> DataFrame:
    """hits with the sentence of each text that is nearest to the question, the first of equal ones; a text without
    a sentence gives its beginning. `split` makes sentences of a text."""
    parts = hits.select(key, F.posexplode(split(F.col(text))).alias("position", "sentence"))
    parts = parts.withColumn("vector", embed(F.col("sentence"), make, dim=dim))
    best = best_of_group(parts, key, question_vector(question, make()), "vector", "position").select(key, F.col("sentence").alias("_best"))
    return hits.join(best, key, "left").withColumn("snippet", F.coalesce("_best", F.substring(text, 1, FALLBACK))).drop("_best")


def search_many(vectors: DataFrame, questions: DataFrame, key: str, vector: str, question_key: str, k: int = 5, block: int = 1024) -> DataFrame:
    """(question_key, rank, key, score): of each question the k vectors of least cosine distance, exactly; ties fall to the smaller key.

    Questions are taken in blocks, each a pass over the vectors: a task multiplies its vectors with the block and keeps k for each question, so that
    a pass shuffles k rows a task and question. A block's vectors, `block` of them, go to every task. Null and zero vectors, and those of another
    length than the questions, are no partners; a question without a vector has no rows."""
    spark, name = questions.sparkSession, questions.schema[question_key].dataType
    asked = numbered(questions.where(F.col(vector).isNotNull()).select(question_key, vector), question_key, name="_place", start=0)
    path = scratch(spark, "nearest")
    kinds = f"_q int, _key {vectors.schema[key].dataType.simpleString()}, _score double"
    for b in range(-(-asked.count() // block)):
        some = asked.where(F.col("_place").between(b * block, (b + 1) * block - 1)).orderBy("_place").collect()  # at most `block`
        sizes = sorted({len(r[vector]) for r in some})
        if len(sizes) > 1:
            raise ValueError(f"questions of {sizes} numbers")
        wanted = np.array([r[vector] for r in some], float)
        norms = np.linalg.norm(wanted, axis=1, keepdims=True)
        wanted = np.divide(wanted, norms, out=np.full_like(wanted, np.nan), where=norms > 0)

        def best(batches: Iterator[pd.DataFrame], wanted: np.ndarray = wanted) -> Iterator[pd.DataFrame]:
            scores, keys = np.zeros((len(wanted), 0)), np.zeros((len(wanted), 0), object)
            for rows in batches:
                rows = rows[[v is not None and len(v) == wanted.shape[1] for v in rows["v"]]]
                if len(rows):
                    held = np.array(rows["v"].tolist(), float)
                    size = np.linalg.norm(held, axis=1)
                    found = wanted @ np.divide(held, size[:, None], out=np.full_like(held, np.nan), where=size[:, None] > 0).T
                    scores = np.hstack((scores, np.where(np.isnan(found), -np.inf, found)))
                    keys = np.hstack((keys, np.broadcast_to(rows["k"].to_numpy(object), found.shape)))
                    by_key = np.argsort(keys, axis=1, kind="stable")
                    scores, keys = np.take_along_axis(scores, by_key, 1), np.take_along_axis(keys, by_key, 1)
                    first = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    scores, keys = np.take_along_axis(scores, first, 1), np.take_along_axis(keys, first, 1)
            at = np.nonzero(np.isfinite(scores))
            yield pd.DataFrame({"_q": at[0].astype(np.int32), "_key": keys[at], "_score": scores[at]})

        near = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("k IS NOT NULL").mapInPandas(best, kinds)
        names = spark.createDataFrame([(n, r[question_key]) for n, r in enumerate(some)], StructType([StructField("_q", IntegerType()), StructField("_name", name)]))
        place = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("_score"), "_key"))
        ranked = near.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "_q")  # at most `block`
        ranked.select(F.col("_name").alias("_name"), "rank", "_key", "_score").write.mode("append").parquet(path)
    schema = StructType([StructField("_name", name), StructField("rank", IntegerType()), StructField("_key", vectors.schema[key].dataType), StructField("_score", DoubleType())])
    found = spark.read.schema(schema).parquet(path) if Store(spark, path).names() else spark.createDataFrame([], schema)
    return found.select(F.col("_name").alias(question_key), "rank", F.col("_key").alias(key), F.col("_score").alias("score"))
