"""Text features: hashed embeddings and language votes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinarium.functions.language import detect

EMBEDDING_DIMS = 384


def embed_hashed(texts: DataFrame, id_column: str = "review_id", text: str = "text", dims: int = EMBEDDING_DIMS) -> DataFrame:
    """Unit-length float vectors from hashed, idf-weighted words.

    Null text counts as empty and has a zero vector. Two scans without any exchange of text: document frequencies are aggregated into
    one vector of ``dims`` numbers, then every row is transformed in place.
    """
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dims)
    counted = counts.transform(words.transform(texts.select(id_column, F.coalesce(text, F.lit("")).alias(text))))
    weighted = IDF(inputCol="_counts", outputCol="_weighted").fit(counted).transform(counted)
    unit = Normalizer(inputCol="_weighted", outputCol="_unit").transform(weighted)
    return unit.select(id_column, vector_to_array("_unit", "float32").alias("embedding"))


def embed_with(
    texts: DataFrame, encoder: Callable[[list[str]], Any], id_column: str = "review_id", text: str = "text"
) -> DataFrame:
    """Vectors from a caller's encoder (a list of texts to a matrix), applied per Arrow batch."""

    def encode(batches: Iterator[Any]) -> Iterator[Any]:
        import numpy as np

        for batch in batches:
            vectors = np.asarray(encoder(batch[text].tolist()), dtype=np.float64)
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = (vectors / np.where(length == 0, 1, length)).astype(np.float32)
            yield batch[[id_column]].assign(embedding=list(unit))

    id_type = texts.schema[id_column].dataType.simpleString()
    return texts.select(id_column, text).mapInPandas(encode, f"{id_column} {id_type}, embedding array<float>")


def vector_norms(vectors: DataFrame, id_column: str = "review_id", vector: str = "embedding") -> DataFrame:
    """Length of each stored vector, summed in double precision."""
    squares = F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return vectors.select(id_column, F.size(vector).alias("dims"), F.sqrt(squares).alias("norm"))


def detect_language(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add the language whose frequent words occur most often, within the row."""
    return detect(texts, text)
