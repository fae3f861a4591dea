"""Embeddings in the latent dimensions of the table of texts and words, found by a randomised range finder.

Words are hashed to a fixed number of features and weighted by inverse document frequency. The leading right singular vectors of that
table come from a few passes over the texts: each task multiplies its rows' Gram matrix with a narrow block of directions, without
forming it, the products are summed in a tree, and the sum is made orthogonal for the next pass. What reaches the driver
is one such block, whose size depends on the parameters alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinarium.session import fresh_path
from opinarium.sources.writers import write_parquet

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Hashed words; directions beyond those wanted; passes; rows of a block of the product; texts in Python at once.
FEATURES, SPARE, PASSES, BLOCK_ROWS, SLICE = 4096, 16, 4, 512, 256
LATENT_DIMS = 64
WORD = r"[^\p{L}\p{N}]+"
SEED = 20


@dataclass(frozen=True)
class LatentModel:
    """Weights of the features, and for every latent dimension its direction (features x dims) and singular value."""

    idf: np.ndarray
    basis: np.ndarray
    singular: np.ndarray


def hashed_words(text: Column, features: int) -> Column:
    """The feature of every word of a text; none for null."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD), lambda word: word != "")
    return F.transform(words, lambda word: F.pmod(F.hash(word), F.lit(features)))


def _table(lists: pa.ListArray, idf: np.ndarray) -> np.ndarray:
    """Weighted counts (texts x features), rows of length one."""
    sizes = np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(len(lists)), sizes)
    flat = rows * len(idf) + lists.flatten().to_numpy()
    counts = np.bincount(flat, minlength=len(lists) * len(idf)).reshape(len(lists), len(idf)) * idf
    length = np.sqrt((counts**2).sum(1, keepdims=True))
    return counts / np.where(length == 0, 1, length)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _summed(parts: DataFrame, lanes: int, rows: int, columns: int) -> np.ndarray:
    """The sum of matrices given as rows ``block, part, values``: per lane of tasks, then per block, then put together."""
    schema = "block int, part int, values binary"

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in table.column("values").to_pylist())
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()])], ["block", "part", "values"])

    laned = parts.withColumn("lane", F.col("part") % lanes).groupBy("block", "lane").applyInArrow(add, schema)
    whole = laned.groupBy("block").applyInArrow(add, schema).orderBy("block").collect()  # rows x columns values in all
    if not whole:
        return np.zeros((rows, columns))
    return np.concatenate([np.frombuffer(r["values"], np.float64) for r in whole]).reshape(rows, columns)


def _gram_product(words: DataFrame, idf: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The Gram matrix of the weighted table times ``directions``."""
    shared = words.sparkSession.sparkContext.broadcast((idf, directions))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, block = shared.value
        total = np.zeros(block.shape)
        for batch in _sliced(batches):
            x = _table(batch.column(0), weights)
            total += x.T @ (x @ block)
        part = TaskContext.get().partitionId()
        for i, at in enumerate(range(0, len(total), BLOCK_ROWS)):
            values = np.ascontiguousarray(total[at : at + BLOCK_ROWS]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([values])], ["block", "part", "values"])

    parts = words.select("words").mapInArrow(multiply, "block int, part int, values binary")
    lanes = max(1, int(words.rdd.getNumPartitions() ** 0.5))
    return _summed(parts, lanes, *directions.shape)


def learn_latent(
    texts: DataFrame, dims: int = LATENT_DIMS, features: int = FEATURES, text: str = "text", passes: int = PASSES
) -> LatentModel:
    """Latent dimensions of all texts. Null texts count as empty. The same texts give the same model up to rounding.

    Each pass brings directions closer to the leading ones by the ratio of singular values squared; a dimension the texts do not have gets
    the singular value zero.
    """
    words = write_parquet(texts.select(hashed_words(F.col(text), features).alias("words")), fresh_path(texts.sparkSession, "hashed-words"))
    rows = words.count()
    found = words.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count().collect()  # a row per feature
    spread = np.zeros(features)
    spread[[r["w"] for r in found]] = [r["count"] for r in found]
    idf = np.log((rows + 1) / (spread + 1))
    width = min(features, dims + SPARE)
    block = np.linalg.qr(np.random.default_rng(SEED).normal(size=(features, width)))[0]
    for _ in range(passes):
        block = np.linalg.qr(_gram_product(words, idf, block))[0]
    inner = block.T @ _gram_product(words, idf, block)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values)[:dims]
    basis = block @ vectors[:, order]
    basis *= np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1, 1)
    return LatentModel(idf, basis, np.sqrt(np.maximum(values[order], 0)))


def embed_latent(
    texts: DataFrame, model: LatentModel, id_column: str = "review_id", text: str = "text"
) -> DataFrame:
    """Unit vectors of texts in the latent dimensions; zero for texts without a known word. Rows stay where they are."""
    shared = texts.sparkSession.sparkContext.broadcast((model.idf, model.basis))
    source = texts.select(id_column, hashed_words(F.col(text), len(model.idf)).alias("words"))
    kind = texts.schema[id_column].dataType.simpleString()

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = shared.value
        for batch in _sliced(batches):
            latent = _table(batch.column(1), idf) @ basis
            length = np.sqrt((latent**2).sum(1, keepdims=True))
            unit = (latent / np.where(length < 1e-12, np.inf, length)).astype(np.float32)
            offsets = pa.array((np.arange(len(unit) + 1) * unit.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))], [id_column, "embedding"])

    return source.mapInArrow(embed, f"{id_column} {kind}, embedding array<float>")
