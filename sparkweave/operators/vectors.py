"""Vector queries and embeddings of entities."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 64
_WORD = re.compile(r"[^\W_]+")


def embed(text: Column, width: int = WIDTH) -> Column:
    """A stand-in for a model: words hashed to signed places, at unit length; null for a null text, zeros for no words.

    Arrow batches and numpy: as nested expressions the same sums took a hundred times as long.
    """

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            h = np.fromiter((zlib.crc32(w.encode()) for w in _WORD.findall(t.lower())), np.int64)
            v = np.bincount(h // 2 % width, weights=np.where(h % 2 == 0, 1.0, -1.0), minlength=width) if len(h) else np.zeros(width)
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).astype(np.float32))
        return pd.Series(out)

    return run(text)


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def search(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` vectors nearest to ``query``, ties by id; the query is a literal, so nothing is joined or shuffled but the best of each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.filter(F.size(vector) == len(query)).select(id_col, F.round(distance(F.col(vector), q), 6).alias("_distance")).orderBy("_distance", id_col).limit(k)


def search_text(chunks: DataFrame, query: str, k: int = 10, id_col: str = "uid", vector: str = "vector") -> DataFrame:
    """The ``k`` chunks nearest to a text, which is embedded as the chunks were."""
    of_query = chunks.sparkSession.createDataFrame([(query,)], "t string").select(embed(F.col("t")).alias("v")).first()["v"]
    return search(chunks, of_query, k, id_col, vector)


def neighbours(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` of greatest cosine to ``query`` of which those above 0 are kept, so there may be fewer."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.filter(F.size(vector) == len(query)).select(id_col, F.round(cosine(F.col(vector), q), 6).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k).filter("similarity > 0")


def entity_neighbours(embeddings: DataFrame, key: str, k: int = 10) -> DataFrame:
    """``key, similarity``: of trained entities (``key, vector``) the ``k`` most similar to one, itself left out, of which
    those above 0 are kept; none if the key isn't known."""
    own = embeddings.filter(F.col("key") == key).select("vector").first()
    others = embeddings.filter(F.col("key") != key)
    return neighbours(others if own else others.limit(0), own["vector"] if own else [0.0], k, "key", "vector")


def train_entities(bags: DataFrame, size: int = 50, seed: int = 7) -> Word2VecModel | None:
    """Embeddings of keys from sentence bags, the window as wide as the longest bag; None without bags.

    Keys of fewer than two bags are left out. The training algorithm isn't the reference's, so values differ.
    """
    widest = bags.agg(F.max(F.size("bag") - 1)).first()[0]
    if not widest:
        return None
    return Word2Vec(vectorSize=size, minCount=2, windowSize=int(widest), seed=seed, numPartitions=1, maxIter=1, inputCol="bag", outputCol="v").fit(bags)
