"""Exact inner-product search of a whole table of query vectors over a corpus."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinarium.fixed import MAX_VARIANTS
from opinarium.session import fresh_path

# Largest query matrix, as float64, handed to every executor.
MATRIX_BYTES = 64 * 1024 * 1024
# Corpus rows and queries scored at once in a task: 4,096 x 512 float64 cells are 16 MB.
TILE_ROWS, TILE_QUERIES = 4096, 512
# Hits of a block at most: queries times k.
BLOCK_HITS = 1_000_000
# Every query gets a bar first, found on one row in so many and gathered in so many lanes.
BAR_SLICE, BAR_LANES = 64, 32
SCORE_DECIMALS = 9
# More queries than these are dealt out in groups, which every vector is sent to. Hits of a group at most, about, and
# vectors of a row that is sent; groups for each core, so that all are busy to the end.
GRID_QUERIES, GROUP_HITS, PACK_ROWS, GROUPS_A_CORE = 4096, 4_000_000, 2048, 3
# Vectors that meet a tile of queries at once in single precision, so that the products stay in a core's cache; values of pairs that
# are multiplied again at once. Products of lengths above the last are not screened.
SCREEN_ROWS, AGAIN_VALUES, SCREEN_REACH = 512, 1 << 20, 1e30

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the task side travels with the job

_SCORES = "question_id bigint, query_no int, review_id bigint, score double, lane int"


def query_blocks(queries: DataFrame, k: int) -> list[tuple[DataFrame, int]]:
    """Split the queries, whole questions together, into blocks of a checked number of rows.

    A block's matrix stays within ``MATRIX_BYTES`` and its hits within ``BLOCK_HITS``.
    """
    queries = queries.filter(F.col("query_vec").isNotNull())
    rows, dims = queries.agg(F.count(F.lit(1)), F.max(F.size("query_vec"))).first()
    if not rows:
        return [(queries, 0)]
    limit = max(MAX_VARIANTS, min(MATRIX_BYTES // (8 * dims), BLOCK_HITS // k))
    if rows <= limit:
        return [(queries, rows)]
    pieces = -(-rows * 2 // limit)
    while True:
        numbered = queries.withColumn("_piece", F.pmod(F.xxhash64("question_id"), F.lit(pieces)))
        sizes = dict(numbered.groupBy("_piece").count().collect())  # one number per block
        if max(sizes.values()) <= limit:
            break
        if pieces > rows:
            raise ValueError(f"a question has more than {limit} query vectors")
        pieces *= 2
    return [(numbered.filter(F.col("_piece") == i).drop("_piece"), n) for i, n in sorted(sizes.items())]


def in_blocks(queries: DataFrame, k: int, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a per-question job on every block of queries and put the results together.

    However many blocks there are, each one's hits are written to the shared folder, one after the other, so that a
    matrix is only held while its block runs and no plan grows with the questions. Every block scans the
    vectors once more, which its arithmetic, one product per vector and query, outweighs.
    """
    path = fresh_path(queries.sparkSession, "hits")
    schema = None
    for block, _ in query_blocks(queries, k):
        hits = job(block)
        schema = hits.schema
        hits.write.mode("append").parquet(path)
    return queries.sparkSession.read.schema(schema).parquet(path)


class Best:
    """The best ``k`` of each query so far, none below its bar.

    Scores are rounded, so that equal vectors tie whatever their place in a batch; ties go to the smaller id.
    """

    def __init__(self, bars: np.ndarray, k: int, decimals: int = SCORE_DECIMALS) -> None:
        none = np.zeros(0, np.int64)
        self.floor, self.bars, self.k, self.decimals = bars, bars, k, decimals
        self.query, self.score, self.ids = none, np.zeros(0), none
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some queries (rows) with some vectors (columns)."""
        # Candidates are taken with a margin of one rounding step, then rounded.
        step = 10.0**-self.decimals
        found = scores >= (self.bars[queries] - step)[:, None]
        rows = scores.shape[1]
        if rows > self.k and np.count_nonzero(found) > 4 * self.k * len(queries):
            found &= scores >= np.partition(scores, rows - self.k, axis=1)[:, rows - self.k, None] - step
        new, row = np.nonzero(found)
        self._held(queries[new], scores[new, row], ids[row])

    def add_pairs(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of pairs of a query and a vector."""
        found = scores >= self.bars[queries] - 10.0**-self.decimals
        self._held(queries[found], scores[found], ids[found])

    def _held(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.new.append((queries, np.round(scores, self.decimals), ids))
        self.waiting += len(queries)
        if self.waiting >= self.k * len(self.bars):
            self.trim()

    def trim(self) -> None:
        """Drop what is below the ``k``-th score; done once as much has come as is held, so that sorting does not grow with batches.

        Ids are compared, and ties cut, by ``settle`` only, unless many tie.
        """
        query, score, all_ids = (np.concatenate(c) for c in zip((self.query, self.score, self.ids), *self.new))
        width = len(self.bars)
        order = np.argsort(-score)
        # Small integers are sorted by their digits.
        order = order[np.argsort(query[order].astype(np.min_scalar_type(width)), kind="stable")]
        counts = np.bincount(query, minlength=width)
        full = counts >= self.k
        worst = np.full(width, -np.inf)
        worst[full] = score[order[(np.cumsum(counts) - counts)[full] + self.k - 1]]
        keep = score >= worst[query]
        self.query, self.score, self.ids = query[keep], score[keep], all_ids[keep]
        self.new, self.waiting = [], 0
        self.bars = np.maximum(worst, self.floor)
        if len(self.query) > 1.25 * self.k * width:
            self.settle()

    def settle(self) -> None:
        """Put the best in order, ties by id, and cut them at ``k``."""
        query, score, all_ids = (np.concatenate(c) for c in zip((self.query, self.score, self.ids), *self.new))
        self.new, self.waiting = [], 0
        order = np.lexsort((all_ids, -score, query))
        query, score, all_ids = query[order], score[order], all_ids[order]
        width = len(self.bars)
        keep = np.arange(len(query)) - np.searchsorted(query, np.arange(width))[query] < self.k
        self.query, self.score, self.ids = query[keep], score[keep], all_ids[keep]
        counts = np.bincount(self.query, minlength=width)
        full = counts == self.k
        worst = np.full(width, -np.inf)
        worst[full] = self.score[(np.cumsum(counts) - 1)[full]]
        self.bars = np.maximum(worst, self.floor)


def _found(tiles: dict[int, Best], question_ids: np.ndarray, query_nos: np.ndarray, lane: int):
    """What the tiles hold, as batches of ``_SCORES``."""
    for start, best in tiles.items():
        best.settle()
        query = start + best.query
        columns = [question_ids[query], query_nos[query], best.ids, best.score, np.full(len(query), lane)]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["question_id", "query_no", "review_id", "score", "lane"]
        )


def _tiles(bars: np.ndarray, k: int, width: int, decimals: int = SCORE_DECIMALS) -> dict[int, Best]:
    return {start: Best(bars[start : start + width], k, decimals) for start in range(0, len(bars), width)}


def _scorer(shared, k: int, lanes: int, tile_rows: int, tile_queries: int, decimals: int):
    """The task side: running top ``k`` per query over the Arrow batches of one partition."""

    def score(batches):
        question_ids, query_nos, matrix, bars = shared.value
        total, dims = matrix.shape
        if not total:
            return
        tiles = _tiles(bars, k, tile_queries, decimals)
        pieces = (b.slice(o, tile_rows) for b in batches for o in range(0, b.num_rows, tile_rows))
        for piece in pieces:
            ids = piece.column(0).to_numpy(zero_copy_only=False)
            flat = piece.column(1).flatten().to_numpy(zero_copy_only=False)
            if len(flat) != piece.num_rows * dims:
                raise ValueError(f"corpus vectors must have {dims} values like the queries")
            vectors = flat.reshape(piece.num_rows, dims).astype(np.float64)
            for start, best in tiles.items():
                width = len(best.bars)
                best.add(np.arange(width), matrix[start : start + width] @ vectors.T, ids)
        yield from _found(tiles, question_ids, query_nos, TaskContext.get().partitionId() % lanes)

    return score


def _as_arrays(block: DataFrame):
    """A block as arrays: question ids, variant numbers, float64 matrix."""
    table = block.select("question_id", "query_no", "query_vec").toArrow()
    flat = table.column("query_vec").combine_chunks().flatten().to_numpy()
    matrix = flat.reshape(table.num_rows, -1 if table.num_rows else 0).astype(np.float64)
    return table.column("question_id").to_numpy(), table.column("query_no").to_numpy(), matrix


def _bars(vectors: DataFrame, arrays, k: int):
    """The ``k``-th best score of every query on a slice of the corpus: no hit of the whole lies below it."""
    part = vectors.filter(F.pmod(F.xxhash64("review_id"), F.lit(BAR_SLICE)) == 0)
    found = _ranked(part, arrays, np.full(len(arrays[0]), -np.inf), k, BAR_LANES)
    return last_scores(found, arrays, k)


def last_scores(found: DataFrame, arrays, k: int) -> np.ndarray:
    """The score at rank ``k`` of every query of a block, if there is one."""
    found = found.filter(F.col("rank") == k)
    last = {(r["question_id"], r["query_no"]): r["score"] for r in found.collect()}  # one number per query
    return np.array([last.get(key, -np.inf) for key in zip(arrays[0].tolist(), arrays[1].tolist())])


def _ranked(vectors: DataFrame, arrays, bars, k: int, lanes: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((*arrays, bars))
    scorer = _scorer(shared, k, lanes, TILE_ROWS, TILE_QUERIES, SCORE_DECIMALS)
    return merged(vectors.mapInArrow(scorer, _SCORES), k)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of every query, numbered by ``rank``, from what the tasks found: cut per lane, then per query."""
    best_first = [F.col("score").desc(), F.col("review_id")]
    by_lane = Window.partitionBy("question_id", "query_no", "lane").orderBy(*best_first)
    by_query = Window.partitionBy("question_id", "query_no").orderBy(*best_first)
    return (
        found.withColumn("_place", F.row_number().over(by_lane))
        .filter(F.col("_place") <= k)
        .drop("_place", "lane")
        .repartition("question_id")
        .withColumn("rank", F.row_number().over(by_query))
        .filter(F.col("rank") <= k)
    )


def lanes_of(table: DataFrame) -> int:
    """Lanes that share out what the tasks of a table's scan send: the root of their number."""
    return max(1, int(table.rdd.getNumPartitions() ** 0.5))


def top_k_of_block(corpus: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """``top_k`` for a block of queries, partitioned by ``question_id``.

    In a corpus of many partitions most of them hold no hit of a query: its bar keeps them from sending
    any, and lanes, as many as the root of the partitions, share out the rest.
    """
    vectors = corpus.select("review_id", "embedding").filter(F.col("embedding").isNotNull())
    arrays = _as_arrays(block)
    return _ranked(vectors, arrays, _bars(vectors, arrays, k), k, lanes_of(vectors))


_PACKED = "kind int, ids binary, numbers binary, vectors binary, radii binary"
_RANKED = "question_id bigint, query_no int, review_id bigint, score double, rank int"
_MERGED = "question_id bigint, review_id bigint, score double, position int"
# Rows of a batch that a group sends.
SENT_ROWS = 1 << 18
# Kinds of rows that a group gets, in this order.
QUERIES, BARS, VECTORS = 0, 1, 2


def grid_of(queries: DataFrame, k: int) -> tuple[int, int, int]:
    """Number of queries, their dimensions, and the groups to deal them out in; one that is not enough for a group means none."""
    rows, dims = queries.filter(F.col("query_vec").isNotNull()).agg(F.count(F.lit(1)), F.max(F.size("query_vec"))).first()
    if not rows:
        return 0, 0, 0
    room = max(MAX_VARIANTS, min(MATRIX_BYTES // (8 * dims), GROUP_HITS // k))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return rows, dims, max(-(-rows * 5 // (room * 4)), min(GROUPS_A_CORE * cores, -(-rows * 4 // GRID_QUERIES)))


def searched(
    queries: DataFrame, k: int, of_block: Callable[[DataFrame], DataFrame], of_grid: Callable[[DataFrame, int, int], DataFrame]
) -> DataFrame:
    """Hits of a few queries by ``of_block``, which sends these to the vectors, of many by ``of_grid``, which sends vectors to groups of queries."""
    rows, dims, groups = grid_of(queries, k)
    if rows <= GRID_QUERIES and len(query_blocks(queries, k)) == 1:
        return in_blocks(queries, k, of_block)
    path = fresh_path(queries.sparkSession, "hits")
    hits = of_grid(queries.filter(F.col("query_vec").isNotNull()), dims, groups)
    hits.write.parquet(path)
    return queries.sparkSession.read.schema(hits.schema).parquet(path)


def _flat(column: pa.Array) -> np.ndarray:
    """The values of an array column, as they are typed."""
    return column.flatten().to_numpy(zero_copy_only=False)


def _typed(df: DataFrame, column: str):
    return np.float32 if df.schema[column].dataType.elementType.typeName() == "float" else np.float64


def packed_queries(queries: DataFrame, groups: int) -> DataFrame:
    """``place`` and ``_PACKED``: the queries of each group, whole questions together."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, question, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            matrix = _flat(batch.column(3)).astype(np.float64).reshape(batch.num_rows, -1)
            rows = []
            for own in (np.flatnonzero(place == group) for group in np.unique(place)):
                rows.append((int(place[own[0]]), QUERIES, question[own].astype(np.int64).tobytes(), number[own].astype(np.int32).tobytes(), matrix[own].tobytes(), None))
            if rows:
                yield as_batch(rows)

    group = F.pmod(F.xxhash64("question_id"), F.lit(groups)).cast("int")
    return queries.select(group.alias("place"), "question_id", "query_no", "query_vec").mapInArrow(pack, f"place int, {_PACKED}")


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ``_PACKED``, with a place in front if they have one."""
    names = ["place", *(field.split()[0] for field in _PACKED.split(", "))][-len(rows[0]) :]
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 4][-len(rows[0]) :]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def packed_vectors(vectors: DataFrame) -> DataFrame:
    """``_PACKED``: the vectors of a corpus, some thousand to a row."""
    kind = _typed(vectors, "embedding")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(at, PACK_ROWS) for at in range(0, batch.num_rows, PACK_ROWS)):
                ids = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield as_batch([(VECTORS, ids.tobytes(), None, _flat(piece.column(1)).astype(np.float64 if kind is np.float64 else np.float32).tobytes(), None)])

    return vectors.mapInArrow(pack, _PACKED)


class Group:
    """The queries of a group, in order of their ids, as one task holds them, and their bars."""

    def __init__(self, rows: list[dict]) -> None:
        question = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
        number = np.concatenate([np.frombuffer(r["numbers"], np.int32) for r in rows])
        matrix = np.concatenate([np.frombuffer(r["vectors"], np.float64).reshape(len(r["ids"]) // 8, -1) for r in rows])
        order = np.lexsort((number, question))
        self.question_ids, self.query_nos, self.matrix = question[order], number[order], matrix[order]
        self.norms = np.sqrt((self.matrix**2).sum(1))
        self.bars = np.full(len(order), -np.inf)
        with np.errstate(over="ignore"):
            self.coarse = self.matrix.astype(np.float32)

    def vectors(self, row: dict, kind=np.float32) -> tuple[np.ndarray, np.ndarray]:
        """Ids and vectors of a row."""
        ids, flat = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], kind)
        if len(flat) != len(ids) * self.matrix.shape[1]:
            raise ValueError(f"corpus vectors must have {self.matrix.shape[1]} values like the queries")
        return ids, flat.reshape(len(ids), -1).astype(np.float64)

    def add(self, tiles: dict[int, Best], v: np.ndarray, ids: np.ndarray) -> None:
        """Add vectors to the best of all tiles: every product in single precision, those that may reach a bar again in double.

        A product in single precision is off by no more than ``dims`` and some roundings of the lengths' product. Tiles in which a query
        has no bar yet are multiplied in double precision at once.
        """
        dims = self.matrix.shape[1]
        longest = np.sqrt((v**2).sum(1).max(initial=0.0))
        with np.errstate(over="ignore"):
            coarse = v.astype(np.float32)
        pairs = max(1, AGAIN_VALUES // max(dims, 1))
        for start, best in tiles.items():
            tile = slice(start, start + len(best.bars))
            reach = self.norms[tile] * longest
            every, own = np.arange(len(best.bars)), self.matrix[tile]
            for at in range(0, len(ids), SCREEN_ROWS):
                part = slice(at, at + SCREEN_ROWS)
                low = best.bars - 2 * 10.0**-best.decimals - reach * (dims + 8) * 2.0**-23
                if not (np.isfinite(low).all() and reach.max(initial=0.0) < SCREEN_REACH):
                    best.add(every, own @ v[part].T, ids[part])
                    continue
                rough = self.coarse[tile] @ coarse[part].T
                found = np.flatnonzero(rough >= np.nextafter(low.astype(np.float32), np.float32(-np.inf))[:, None])
                if len(found) > rough.size // 8:
                    best.add(every, own @ v[part].T, ids[part])
                    continue
                query, row = np.divmod(found, rough.shape[1])
                for first in range(0, len(found), pairs):
                    q, r = query[first : first + pairs], at + row[first : first + pairs]
                    best.add_pairs(q, np.einsum("ij,ij->i", own[q], v[r]), ids[r])

    def hits(self, tiles: dict[int, Best]) -> Iterator[pa.RecordBatch]:
        """What the tiles hold, as batches of ``_RANKED``."""
        for start, best in tiles.items():
            best.settle()
            query = start + best.query
            rank = 1 + np.arange(len(query)) - np.searchsorted(best.query, best.query)
            columns = [self.question_ids[query], self.query_nos[query], best.ids, best.score, rank]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["question_id", "query_no", "review_id", "score", "rank"])


    def merged(self, tiles: dict[int, Best]) -> Iterator[pa.RecordBatch]:
        """What ``merge_variants`` makes of ``hits``, as batches of ``_MERGED``; a group has all variants of its questions."""
        for best in tiles.values():
            best.settle()
        query = np.concatenate([start + best.query for start, best in tiles.items()])
        ids, score = (np.concatenate([getattr(best, name) for best in tiles.values()]) for name in ("ids", "score"))
        rank = 1 + np.arange(len(query)) - np.searchsorted(query, query)
        question, seen = self.question_ids[query], self.query_nos[query].astype(np.int64) * (1 << 32) + rank
        if not len(query):
            return

        def first(*columns: np.ndarray) -> np.ndarray:
            return np.flatnonzero(np.logical_or.reduce([np.r_[True, c[1:] != c[:-1]] for c in columns]))

        order = np.lexsort((ids, question))
        question, ids, score, seen = question[order], ids[order], score[order], seen[order]
        one = first(question, ids)
        score, seen = np.maximum.reduceat(score, one), np.minimum.reduceat(seen, one)
        question, ids = question[one], ids[one]
        order = np.lexsort((ids, seen, -score, question))
        question, ids, score = question[order], ids[order], score[order]
        position = 1 + np.arange(len(question)) - np.searchsorted(question, question)
        for at in range(0, len(question), SENT_ROWS):
            columns = [pa.array(c[at : at + SENT_ROWS], t) for c, t in zip((question, ids, score, position), (pa.int64(), pa.int64(), pa.float64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["question_id", "review_id", "score", "position"])


def in_groups(sides: DataFrame, groups: int, job: Callable[[int, Group, Iterator[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``job`` on each group: its place, its queries and bars, and its other rows as they stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow = (dict(zip(b.schema.names, row)) for b in batches for i in range(b.num_rows) for row in zip(*(c.to_pylist() for c in b.slice(i, 1).columns)))
        ahead = next(flow, None)

        def of(place: int, *kinds: int) -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead["place"] == place and ahead["kind"] in kinds:
                row, ahead = ahead, None
                yield row
                ahead = next(flow, None)

        while ahead is not None:
            place = ahead["place"]
            own = list(of(place, QUERIES))
            if own:
                group = Group(own)
                for row in of(place, BARS):
                    group.bars = np.frombuffer(row["vectors"], np.float64)
                yield from job(place, group, of(place, VECTORS))
            for _ in of(place, BARS, VECTORS):
                pass

    return sides.repartitionById(groups, "place").sortWithinPartitions("place", "kind").mapInArrow(run, schema)


def to_all(packed: DataFrame, groups: int) -> DataFrame:
    """Packed rows with the place of every group."""
    return packed.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("place"), *packed.columns)


def grid_top_k(corpus: DataFrame, queries: DataFrame, groups: int, k: int, merge: bool = False) -> DataFrame:
    """``top_k`` of many queries, or ``merge_variants`` of it, in one job: a task holds a group of them and their best, and all vectors stream past.

    A query's hits are complete where they are found, so each sends ``k`` rows however many tasks there are. A task holds its
    queries and their hits only; the vectors go out once for each group.
    """
    vectors = corpus.select("review_id", "embedding").filter(F.col("embedding").isNotNull())
    kind, tile_queries, decimals = _typed(vectors, "embedding"), TILE_QUERIES, SCORE_DECIMALS

    def job(place: int, group: Group, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        tiles = _tiles(group.bars, k, tile_queries, decimals)
        for row in rows:
            ids, v = group.vectors(row, kind)
            group.add(tiles, v, ids)
        yield from group.merged(tiles) if merge else group.hits(tiles)

    sides = packed_queries(queries, groups).unionByName(to_all(packed_vectors(vectors), groups))
    return in_groups(sides, groups, job, _MERGED if merge else _RANKED)


def top_k(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best reviews of every query: ``question_id, query_no, review_id, score, rank``.

    corpus: ``review_id bigint, embedding array<float>``; queries: ``question_id bigint,
    query_no int, query_vec array<float>``, unit vectors throughout.

    A few queries go to every executor; the corpus is scanned in place and not shuffled. Each task scores Arrow batches by
    matrix product and passes on only its own ``k`` best per query, so no table of all pairs exists. These are
    merged per lane, then per question. Many queries are dealt out in groups, and the vectors go to them (``grid_top_k``).
    Ties go to the smaller id.
    """
    return searched(
        queries, k, lambda block: top_k_of_block(corpus, block, k), lambda many, dims, groups: grid_top_k(corpus, many, groups, k)
    )


def merge_variants(ranked: DataFrame) -> DataFrame:
    """One row per question and review with its best score, numbered by ``position``.

    Equal scores keep the order in which the variants, taken in turn, first list them.
    """
    first_seen = F.min(F.col("query_no").cast("bigint") * (1 << 32) + F.col("rank"))
    merged = ranked.groupBy("question_id", "review_id").agg(
        F.max("score").alias("score"), first_seen.alias("_seen")
    )
    by_question = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "_seen", "review_id")
    return merged.withColumn("position", F.row_number().over(by_question)).drop("_seen")


def attach(hits: DataFrame, corpus: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fetch corpus columns for hits by their id.

    No hint is given: stored hits that are small enough are broadcast by their size, more of them are joined by id.
    """
    return corpus.select("review_id", *columns).join(hits, "review_id")
