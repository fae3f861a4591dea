"""Exact top-k search by BM25 over an inverted index in shards, with block-max pruning.

Every scan task turns its documents into shards: postings by term, documents in blocks of like ones, and the largest
contribution of each frequent term in each block. Queries are searched for in tiles. The postings of a query's rare terms are added up;
a strip of blocks is a pivot of those queries whose best such sum in a block, plus their maxima of the frequent terms there, reaches the
k-th best score so far, and is passed over for the others. A pivot's documents are scored in single precision first; those that come as near
the bar as its error allows are scored exactly, which raises the bar. Document frequencies and the mean length are global, so shards merge
exactly. A first pass over some shards gives each query a bar for all others.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from opinarium.llm.tables import small, written
from opinarium.session import fresh_path

K1, B = 1.2, 0.75
#: Documents of a shard at most, and postings after which it is closed; documents of a block.
SHARD_DOCS, SHARD_POSTINGS, BLOCK = 16384, 1_000_000, 64
#: A term is frequent in a shard if one document in so many has it, and it is among so many such terms.
FREQUENT, COLUMNS = 24, 512
#: Cells that a shard's frequent terms take at most, which leaves long shards fewer such terms; cells of a tile's sums for rare ones.
DENSE_CELLS, TILE_CELLS = 1 << 21, 1 << 20
#: Postings of a query's rare terms that are added up at once.
ADDED = 1 << 18
#: Queries of a tile; blocks of a strip, after which the bars are raised.
TILE, STRIP = 512, 8
#: Scores are rounded, so that equal documents tie wherever they lie.
DECIMALS = 9
TINY = 10.0**-DECIMALS
#: Cells that are scored exactly at once.
EXACT = 1024
#: Bytes of queries, about, that are broadcast at once.
QUERY_BYTES = 24 << 20
#: Setting that says how many rows go to a worker at once, and how many texts do.
BATCH_ROWS, TEXTS = "spark.sql.execution.arrow.maxRecordsPerBatch", 200
#: One shard in so many is searched first, for the bars.
FIRST = 8

SHARD_FIELDS = ("docs", "lengths", "terms", "offsets", "postings", "times")
SHARD_SCHEMA = "shard bigint, n bigint, total bigint, " + ", ".join(f"{f} binary" for f in SHARD_FIELDS)


@contextmanager
def _at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """So many rows go to a worker at once while this lasts; a partition's shards or 10,000 texts would stand there and in the JVM whole."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def terms_of(text: str | None) -> Counter:
    """Terms (64-bit hashes of lower-cased words) and how often a text has them."""
    return Counter(map(xxh64_intdigest, (text or "").encode().lower().split()))


def _arrays(own: Counter) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(own, np.uint64, len(own)), np.fromiter(own.values(), np.int32, len(own))


def _narrow(values: np.ndarray) -> np.ndarray:
    """Numbers in as few bytes as they need, as a row goes through Spark whole."""
    return values.astype(np.min_scalar_type(values.max(initial=0)))


def _narrowed(data: bytes | pa.Buffer, n: int) -> np.ndarray:
    """``n`` such numbers."""
    return np.frombuffer(data, f"u{len(data) // n}") if n else np.zeros(0, np.uint8)


def _shard(ids: list[int], texts: list[Counter]) -> tuple:
    return _shard_of(ids, [_arrays(own) for own in texts])


def _shard_of(ids: list[int], texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple:
    """One shard's arrays; documents with the same commonest term lie together, short ones first."""
    own_ids = np.array(ids, np.int64)
    sizes = np.array([len(own) for own, _ in texts], np.int64)
    lengths = np.array([n.sum() for _, n in texts], np.int64)
    terms = np.concatenate([own for own, _ in texts])
    times = np.concatenate([n for _, n in texts])
    lead = np.zeros(len(ids), np.uint64)
    if len(terms):
        distinct, at, spread = np.unique(terms, return_inverse=True, return_counts=True)
        commonest = np.lexsort((distinct, spread))
        rank = np.empty(len(distinct), np.int32)
        rank[commonest] = np.arange(len(distinct))
        filled = sizes > 0
        begin = (np.cumsum(sizes) - sizes)[filled]
        lead[filled] = distinct[commonest[np.maximum.reduceat(rank[at], begin)]]
    order = np.lexsort((own_ids, lengths, lead))
    place = np.empty(len(ids), np.int32)
    place[order] = np.arange(len(ids))
    docs = np.repeat(place, sizes)
    by_term = np.lexsort((docs, terms))
    terms, times, docs = terms[by_term], times[by_term], docs[by_term]
    starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
    doc_ids = own_ids[order]
    arrays = (
        doc_ids, lengths[order], terms[starts],
        np.r_[starts, len(terms)].astype(np.int64), _narrow(docs), _narrow(times),
    )
    name = struct.unpack("<q", struct.pack("<Q", xxh64_intdigest(doc_ids.tobytes())))[0]
    return (name, len(ids), int(lengths.sum()), *(a.tobytes() for a in arrays))


def build_index(docs: DataFrame) -> DataFrame:
    """The index as a written table, one shard a row. Rows without an id are left out; null texts have no terms."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in small(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(_arrays(terms_of(text)))
                size += len(texts[-1][0])
                if len(ids) >= SHARD_DOCS or size >= SHARD_POSTINGS:
                    yield packed(_shard_of(ids, texts))
                    ids, texts, size = [], [], 0
        if ids:
            yield packed(_shard_of(ids, texts))

    def packed(row: tuple) -> pa.RecordBatch:
        types = [pa.int64()] * 3 + [pa.binary()] * len(SHARD_FIELDS)
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(row, types)], ["shard", "n", "total", *SHARD_FIELDS]
        )

    with _at_once(docs.sparkSession, TEXTS):
        return written(docs.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInArrow(build, SHARD_SCHEMA), "bm25-index")


def document_frequencies(index: DataFrame) -> DataFrame:
    """``term, df`` over all shards."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, offsets in zip(batch.column(0), batch.column(1)):
                found = np.frombuffer(terms.as_buffer(), np.int64)
                n = np.diff(np.frombuffer(offsets.as_buffer(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["term", "df"])

    counts = index.select("terms", "offsets").mapInArrow(spread, "term bigint, df bigint")
    return counts.groupBy("term").agg(F.sum("df").alias("df"))


def weighted_queries(queries: DataFrame, index: DataFrame) -> DataFrame:
    """``query_id, terms, weights`` (arrays as bytes, by term) of every query with a term that some document has.

    A term weighs its inverse document frequency times how often the query has it. ``queries``: ``query_id, text``; rows without an id
    are left out, and texts of one id are one query with the words of all of them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for query_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = terms_of(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([query_id] * len(own), pa.int64()),
                        pa.array(np.fromiter(own, np.uint64, len(own)).view(np.int64)),
                        pa.array(list(own.values()), pa.int32()),
                    ],
                    ["query_id", "term", "times"],
                )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            lists = batch.column(1)
            offsets, flat = lists.offsets.to_numpy(), lists.values
            terms, weights = (flat.field(i).to_numpy() for i in range(2))
            rows = []
            for start, end in zip(offsets, offsets[1:]):
                own = terms[start:end].view(np.uint64)
                order = np.argsort(own)
                rows.append((own[order].tobytes(), weights[start:end][order].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.binary()) for c in zip(*rows))], ["query_id", "terms", "weights"]
            )

    n = index.agg(F.sum("n")).first()[0] or 0
    rows = queries.select("query_id", "text").filter("query_id IS NOT NULL").mapInArrow(cut, "query_id bigint, term bigint, times int")
    summed = rows.groupBy("query_id", "term").agg(F.sum("times").alias("times"))
    weight = F.col("times") * F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    met = summed.join(document_frequencies(index), "term").select("query_id", "term", weight.alias("weight"))
    listed = met.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    return listed.mapInArrow(pack, "query_id bigint, terms binary, weights binary")


class Shard:
    """A shard in a worker."""

    def __init__(self, row: dict, mean_length: float):
        kinds = (np.int64, np.int64, np.uint64, np.int64)
        self.docs, lengths, self.terms, self.offsets = (np.frombuffer(row[f], kind) for f, kind in zip(SHARD_FIELDS, kinds))
        self.postings, times = (_narrowed(row[f], int(self.offsets[-1])) for f in SHARD_FIELDS[-2:])
        norm = K1 * (1 - B + B * lengths / mean_length)
        self.gains = norm[self.postings]
        self.gains += times
        np.divide(times, self.gains, out=self.gains)
        self.gains *= K1 + 1
        spread = np.diff(self.offsets)
        frequent = np.flatnonzero(spread * FREQUENT >= len(self.docs))
        widest = np.argsort(-spread[frequent], kind="stable")[: min(COLUMNS, DENSE_CELLS // max(len(self.docs), 1))]
        self.common = np.sort(frequent[widest])
        self.place = np.full(len(self.terms), -1, np.int32)
        self.place[self.common] = np.arange(len(self.common))
        self.dense = np.zeros((len(self.docs), len(self.common)))
        for column, term in enumerate(self.common):
            own = slice(self.offsets[term], self.offsets[term + 1])
            self.dense[self.postings[own], column] = self.gains[own]
        self.screen = self.dense.astype(np.float32)
        self.starts = np.arange(0, len(self.docs), BLOCK)
        self.maxima = np.maximum.reduceat(self.dense, self.starts, axis=0) if len(self.docs) else self.dense

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, bar: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best for one query, as far as they reach the bar."""
        _, docs, scores = self.search_tile(Tile(np.array([0, len(terms)]), terms, weights), k, np.array([float(bar)]))
        return docs, scores

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Where each term stands in the shard, -1 if it does not."""
        if not len(self.terms):
            return np.full(len(terms), -1, np.int32)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1).astype(np.int32)

    def search_tile(
        self, tile: Tile, k: int, bars: np.ndarray, at: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, document and score of the k best of every query of a tile, as far as they reach its bar. ``at``: where its terms are."""
        n, width = len(bars), len(self.docs)
        at = self.find(tile.terms) if at is None else at
        found = np.flatnonzero(at >= 0)
        query = np.repeat(np.arange(n), np.diff(tile.offsets))[found]
        at, weights = at[found], tile.weights[found]
        column = self.place[at]
        rare = column < 0
        wide = np.zeros((n, len(self.common)))
        wide[query[~rare], column[~rare]] = weights[~rare]
        base = self._added(query[rare], at[rare], weights[rare], n)
        bound = np.maximum.reduceat(base, self.starts, axis=1) + wide @ self.maxima.T
        bound = np.ascontiguousarray((bound * (1 + 1e-9) + TINY).T)
        strips = np.arange(0, len(self.starts), STRIP)
        bound = np.maximum.reduceat(bound, strips, axis=0)
        coarse = wide.astype(np.float32)
        # What single precision makes of a sum of so many terms, none negative, differs from it by less than this factor.
        slack = 1 + (len(self.common) + 16) * 2.0**-23
        bars = np.maximum(bars, TINY)
        low = self._low(bars, slack)
        held: list[tuple[np.ndarray, ...]] = []
        # Strips that promise most come first; each is a pivot of the queries that one of its blocks can still give something.
        for strip in np.argsort(-bound.sum(1), kind="stable").tolist():
            need = np.flatnonzero(bound[strip] >= bars)
            if not len(need):
                continue
            start = strip * STRIP * BLOCK
            rows = slice(start, min(start + STRIP * BLOCK, width))
            near = coarse[need] @ self.screen[rows].T
            near += base[need, rows]
            hit = near >= low[need][:, None]
            if np.count_nonzero(hit) > 2 * k * len(need) and near.shape[1] > k:
                bars[need] = np.maximum(bars[need], np.partition(near, -k, axis=1)[:, -k] / slack - TINY)
                low = self._low(bars, slack)
                hit = near >= low[need][:, None]
            own, doc = np.nonzero(hit)
            if not len(own):
                continue
            query, doc = need[own], doc + start
            # Those that may reach the bar are scored exactly, some at a time.
            exact = base[query, doc]
            for at in range(0, len(own), EXACT):
                some = slice(at, at + EXACT)
                exact[some] += np.einsum("ij,ij->i", wide[query[some]], self.dense[doc[some]])
            exact = np.round(exact, DECIMALS)
            keep = (exact >= bars[query]) & (exact > 0)
            held.append((query[keep], doc[keep], exact[keep]))
            held, bars = self._raised(held, k, bars)
            low = self._low(bars, slack)
        if not held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        [(query, doc, score)], _ = self._raised(held, k, bars)
        return query, self.docs[doc], score

    def _low(self, bars: np.ndarray, slack: float) -> np.ndarray:
        """What a sum in single precision must reach so as not to be missed; those that round to nothing never do."""
        return (np.maximum(bars - TINY, TINY / 4) / slack).astype(np.float32)

    def _added(self, query: np.ndarray, at: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """Sums of the rare terms by query and document. Some postings at a time, as those of a long query are as many as the shard's."""
        width = len(self.docs)
        base = np.zeros((n, width))
        begin = self.offsets[at]
        size = self.offsets[at + 1] - begin
        ends = np.cumsum(size)
        shift = begin - (ends - size)
        first = done = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(ends, done + ADDED, "right")))
            some = size[first:last]
            pick = np.repeat(shift[first:last], some)
            pick += np.arange(done, ends[last - 1])
            gained = np.repeat(weights[first:last], some)
            gained *= self.gains.take(pick, mode="clip")
            place = self.postings.take(pick, mode="clip").astype(np.int64)
            # Query by query, as one row of sums stays in the cache.
            edges = np.flatnonzero(np.diff(query[first:last], prepend=-1))
            cuts = (np.r_[ends[first + edges] - some[edges], ends[last - 1]] - done).tolist()
            for i, start, stop in zip(query[first + edges].tolist(), cuts, cuts[1:]):
                base[i] += np.bincount(place[start:stop], gained[start:stop], width)
            first, done = last, ends[last - 1]
        return base

    def _raised(self, held: list[tuple[np.ndarray, ...]], k: int, bars: np.ndarray) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
        """The first ``k`` of each query, ties by id, and the bars that they set."""
        query, doc, score = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((self.docs[doc], -score, query))
        query, doc, score = query[order], doc[order], score[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < k
        query, doc, score = query[keep], doc[keep], score[keep]
        counts = np.bincount(query, minlength=len(bars))
        full = counts == k
        bars = bars.copy()
        bars[full] = np.maximum(bars[full], score[(np.cumsum(counts) - 1)[full]])
        return [(query, doc, score)], bars


@dataclass(frozen=True)
class Tile:
    """Queries as arrays: the terms of query ``i`` (hashes, or numbers in a list of them) and their weights stand from ``offsets[i]`` to
    ``offsets[i + 1]``.
    """

    offsets: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def tiles(self, width: int) -> Iterator[tuple[int, Tile]]:
        for first in range(0, len(self.offsets) - 1, width):
            own = self.offsets[first : first + width + 1]
            part = slice(own[0], own[-1])
            yield first, Tile(own - own[0], self.terms[part], self.weights[part])


def _packed(block: pa.Table) -> tuple[np.ndarray, np.ndarray, Tile]:
    """The ids of a block of queries, in order, its distinct terms, and the queries as arrays with the number of each term among these."""
    block = block.sort_by("query_id")
    parts = [block.column(c).to_pylist() for c in ("terms", "weights")]
    offsets = np.cumsum([0, *(len(t) // 8 for t in parts[0])])
    terms, weights = (np.frombuffer(b"".join(p), kind) for p, kind in zip(parts, (np.uint64, np.float64)))
    distinct, number = np.unique(terms, return_inverse=True)
    return block.column("query_id").to_numpy(), distinct, Tile(offsets, number.astype(np.int32), weights)


def _search(shards: DataFrame, sent: Broadcast, bars: Broadcast, k: int, mean_length: float) -> DataFrame:
    """``query_id, doc_id, score``: what each shard holds of the k best of a block of queries: their ids, they and their bars."""
    names = ["query_id", "doc_id", "score"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, distinct, block = sent.value
        low = bars.value
        for batch in small(batches, 1):
            shard = None  # one at a time
            shard = Shard({f: batch.column(f)[0].as_buffer() for f in SHARD_FIELDS}, mean_length)
            where = shard.find(distinct)  # each term once for all queries
            for first, tile in block.tiles(max(1, min(TILE, TILE_CELLS // max(len(shard.docs), 1)))):
                own_bars = low[first : first + len(tile.offsets) - 1]
                query, docs, scores = shard.search_tile(tile, k, own_bars, where[tile.terms])
                if len(docs):
                    found = [pa.array(c) for c in (own_ids[first + query], docs, scores)]
                    yield pa.RecordBatch.from_arrays(found, names)

    return shards.mapInArrow(search, "query_id bigint, doc_id bigint, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, doc_id, score`` of the ``k`` best documents of every query, ties by id.

    ``docs``: ``doc_id, text``, repeated rows are documents of their own; ``queries``: ``query_id, text``, texts of one id being one query.
    Only documents that share a term are found, so there may be fewer than ``k``, and none for a query without words.

    Queries are dealt out to as many blocks as keep one at about ``QUERY_BYTES``. A block goes to the executors as a few
    arrays, never as rows, and is searched for in the index where it lies.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    total, n = index.agg(F.sum("total"), F.sum("n")).first()
    mean_length = max((total or 0) / (n or 1), 1e-9)
    with _at_once(spark, TEXTS):
        weighted = written(weighted_queries(queries, index), "bm25-queries")
    size = weighted.agg(F.sum(2 * F.octet_length("terms") + 64)).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    shards = index.drop("n", "total").withColumn("_first", F.pmod("shard", F.lit(FIRST)) == 0)
    results = fresh_path(spark, "bm25-found")
    schema = "query_id bigint, doc_id bigint, score double"
    spark.createDataFrame([], schema).write.parquet(results)
    for block in range(blocks):
        ids, distinct, own = _packed(weighted.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow())
        if not len(ids):
            continue
        # The queries are sent once for both passes.
        sent, bars = spark.sparkContext.broadcast((ids, distinct, own)), np.zeros(len(ids))
        low = spark.sparkContext.broadcast(bars)
        with _at_once(spark, 1):
            first = written(_best(_search(shards.filter("_first"), sent, low, k, mean_length), k), "bm25-first")
        low.destroy()
        last = first.filter(F.col("rank") == k).select("query_id", "score").toArrow()
        bars[np.searchsorted(ids, last.column("query_id").to_numpy())] = last.column("score").to_numpy()
        low = spark.sparkContext.broadcast(bars)
        with _at_once(spark, 1):
            rest = _search(shards.filter("NOT _first"), sent, low, k, mean_length)
            first.select("query_id", "doc_id", "score").unionByName(rest).write.mode("append").parquet(results)
        low.destroy()
        sent.destroy()
    return _best(spark.read.schema(schema).parquet(results), k).select("query_id", "rank", "doc_id", "score")
