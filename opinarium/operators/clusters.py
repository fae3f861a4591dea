"""An index of vectors in cells of like ones, from which an exact search reads only what can hold a hit.

Vectors are clustered once, around centroids that are learned from a bounded sample, and stored in order of their cluster in
cells with their own centre and radius. With a vector in a ball around ``c`` of radius ``r``, its inner product with a query ``q`` is
at most ``q.c + |q| r``. A query's nearest cells give it a bar, the score at rank ``k`` in them; a cell whose bound lies below
the bar holds no hit and is neither shuffled nor scored for it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinarium.operators.search import (
    _MERGED, _PACKED, _RANKED, _SCORES, BARS, SCORE_DECIMALS, TILE_QUERIES, VECTORS, Group, _as_arrays, _found, _tiles, as_batch, in_blocks,
    in_groups, lanes_of, last_scores, merged, packed_queries, searched, to_all,
)
from opinarium.session import fresh_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors of a cell at most, and of a partition of the index.
CELL_ROWS, PART_ROWS = 1024, 1 << 14
#: Centroids at most; vectors, about, that they are learned from; rounds of learning.
CENTROIDS, SAMPLE_ROWS, ROUNDS = 1024, 1 << 15, 8
#: Cells whose bounds are computed at once.
TILE_CELLS = 2048
#: Room for rounding in a bound.
SLACK = 1e-7

CELLS = "cell bigint, cluster int, n int, centre binary, radius double, ids binary, vectors binary"


@dataclass(frozen=True)
class VectorIndex:
    """Stored cells, and the centroids that new vectors are dealt out by."""

    cells: DataFrame
    centroids: np.ndarray
    path: str


def _rows(corpus: DataFrame) -> DataFrame:
    return corpus.select("review_id", "embedding").filter(F.col("embedding").isNotNull())


def _learned(vectors: DataFrame, rows: int, wanted: int) -> np.ndarray:
    """Centroids (Lloyd's rounds) of a sample: all vectors whose id hashes below a share that gives about ``SAMPLE_ROWS``."""
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    part = vectors.filter(F.pmod(F.xxhash64("review_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    table = part.orderBy("review_id").toArrow()
    if not table.num_rows:
        return np.zeros((1, 0))
    sample = table.column("embedding").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).astype(np.float64)
    centres = np.unique(sample[:: max(1, len(sample) // wanted)][:wanted], axis=0)
    for _ in range(ROUNDS):
        near = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (vectors @ centres.T - (centres**2).sum(1) / 2).argmax(1)


def _store(vectors: DataFrame, rows: int, centres: np.ndarray, path: str) -> None:
    """Append the cells of ``vectors`` to the index at ``path``.

    A partition is a range of (cluster, id), so that a cluster with most of the rows fills many partitions.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            near = _nearest(flat.reshape(batch.num_rows, shared.value.shape[1]).astype(np.float64), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), *batch.columns], ["cluster", "review_id", "embedding"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held = TaskContext.get().partitionId() << 32, 0, None

        def cells(table: pa.Table, last: bool) -> Iterator[tuple[pa.Table, int]]:
            """Runs of one cluster cut to size; of the last run, what may still grow is left."""
            clusters = table.column("cluster").to_numpy()
            edges = np.flatnonzero(np.r_[True, clusters[1:] != clusters[:-1]]).tolist() + [len(clusters)]
            for start, end in zip(edges, edges[1:]):
                for at in range(start, end, CELL_ROWS):
                    n = min(CELL_ROWS, end - at)
                    if n == CELL_ROWS or last or end < len(clusters):
                        yield table.slice(at, n), at + n

        for batch in _ended(batches):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
            if held is None or not held.num_rows:
                continue
            used = 0
            for cell, used in cells(held, batch is None):
                v = cell.column("embedding").combine_chunks().flatten().to_numpy().reshape(cell.num_rows, -1)
                centre = v.mean(0, dtype=np.float64)
                radius = float(np.sqrt(((v - centre) ** 2).sum(1)).max())
                ids = cell.column("review_id").to_numpy().astype(np.int64)
                values = [first + made, cell.column("cluster")[0].as_py(), cell.num_rows, centre.tobytes(), radius, ids.tobytes(), v.astype(np.float32).tobytes()]
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types)], names)
            held = held.slice(used)

    names = [field.strip().split()[0] for field in CELLS.split(",")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.binary(), pa.binary()]
    dealt = vectors.mapInArrow(deal, "cluster int, review_id bigint, embedding array<float>")
    ordered = dealt.repartitionByRange(max(1, -(-rows // PART_ROWS)), "cluster", "review_id").sortWithinPartitions("cluster", "review_id")
    ordered.mapInArrow(build, CELLS).write.mode("append").parquet(f"{path}/cells")


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def build_index(corpus: DataFrame, path: str | None = None, centroids: int = CENTROIDS) -> VectorIndex:
    """Cluster the vectors of a corpus (``review_id, embedding``) and store them at ``path``; rows without a vector are left out.

    There is a centroid to every ``CELL_ROWS`` vectors, up to ``centroids``. They decide how much a search skips, never
    what it finds.
    """
    vectors = _rows(corpus)
    spark = corpus.sparkSession
    path = path or fresh_path(spark, "vector-index")
    rows = vectors.count()
    centres = _learned(vectors, rows, max(1, min(centroids, rows // CELL_ROWS)))
    listed = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(listed, "cluster int, centre array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    _store(vectors, rows, centres, path)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """A stored index."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cluster").collect()  # at most ``centroids`` rows
    return VectorIndex(spark.read.schema(CELLS).parquet(f"{path}/cells"), np.array([r["centre"] for r in rows], np.float64), path)


def add_to_index(index: VectorIndex, corpus: DataFrame) -> VectorIndex:
    """More vectors, dealt out by the same centroids and appended as cells of their own; ids must be new."""
    vectors = _rows(corpus)
    _store(vectors, vectors.count(), index.centroids, index.path)
    return open_index(corpus.sparkSession, index.path)


def _bounds(batch: pa.RecordBatch, matrix: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of some queries with the centres of a batch's cells, and bounds of those with their vectors."""
    names = batch.schema.names
    centres = np.frombuffer(b"".join(batch.column(names.index("centre")).to_pylist()), np.float64).reshape(batch.num_rows, -1)
    products = matrix @ centres.T
    return products, products + norms[:, None] * batch.column(names.index("radius")).to_numpy() * (1 + SLACK) + SLACK


def _tiled(batches: Iterator[pa.RecordBatch], matrix: np.ndarray, norms: np.ndarray):
    """Slices of cells with tiles of queries: the slice, the tile's first query, products and bounds."""
    for batch in batches:
        for at in range(0, batch.num_rows, TILE_CELLS):
            part = batch.slice(at, TILE_CELLS)
            for start in range(0, len(matrix), TILE_QUERIES):
                tile = slice(start, start + TILE_QUERIES)
                yield part, start, *_bounds(part, matrix[tile], norms[tile])


class _Block:
    """A block of queries as the tasks need it, and the searches over an index's cells with it."""

    def __init__(self, index: VectorIndex, block: DataFrame, k: int) -> None:
        self.cells, self.k, self.arrays = index.cells, k, _as_arrays(block)
        self.spark = index.cells.sparkSession
        self.bars = np.full(len(self.arrays[0]), -np.inf)
        if len(self.bars) and self.arrays[2].shape[1] != index.centroids.shape[1] and index.centroids.shape[1]:
            raise ValueError(f"corpus vectors must have {self.arrays[2].shape[1]} values like the queries")

    def _shared(self):
        matrix = self.arrays[2]
        return self.spark.sparkContext.broadcast((*self.arrays, np.sqrt((matrix**2).sum(1)), self.bars))

    def home(self) -> DataFrame:
        """``cell, queries``: for each query the cells with the nearest centres that hold ``k`` vectors together."""
        shared, k = self._shared(), self.k

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, _, matrix, norms, _ = shared.value
            for part, start, products, _ in _tiled(batches, matrix, norms):
                ids, sizes = part.column(0).to_numpy(), part.column(1).to_numpy()
                order = np.argsort(-products, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                query, place = np.nonzero(before < k)
                cell = order[query, place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(start + query, pa.int32()), pa.array(ids[cell]), pa.array(sizes[cell]), pa.array(products[query, cell])],
                    ["query", "cell", "n", "product"],
                )

        found = self.cells.select("cell", "n", "centre", "radius").mapInArrow(nearest, "query int, cell bigint, n int, product double")
        order = Window.partitionBy("query").orderBy(F.col("product").desc(), "cell")
        before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        return found.withColumn("_before", before).filter(F.col("_before") < k).groupBy("cell").agg(F.collect_list("query").alias("queries"))

    def asked(self) -> DataFrame:
        """``cell, queries``: how many queries a cell may hold a hit of, for cells that may hold any."""
        shared = self._shared()

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, _, matrix, norms, bars = shared.value
            for part, start, _, bounds in _tiled(batches, matrix, norms):
                wanted = (bounds >= bars[start : start + len(bounds), None]).sum(0)
                kept = np.flatnonzero(wanted)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept)), pa.array(wanted[kept])], ["cell", "queries"])

        found = self.cells.select("cell", "centre", "radius").mapInArrow(ask, "cell bigint, queries bigint")
        return found.groupBy("cell").agg(F.sum("queries").alias("queries"))

    def score(self, cells: DataFrame, listed: bool) -> DataFrame:
        """The best of every query in ``cells``; with ``listed``, a cell is scored for its ``queries`` only."""
        shared, k, lanes = self._shared(), self.k, lanes_of(self.cells)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            question_ids, query_nos, matrix, norms, bars = shared.value
            tiles = _tiles(bars, k, TILE_QUERIES)
            for cell in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
                field = dict(zip(cell.schema.names, cell.columns))
                own = np.frombuffer(field["ids"][0].as_py(), np.int64)
                v = np.frombuffer(field["vectors"][0].as_py(), np.float32).reshape(len(own), -1).astype(np.float64)
                chosen = np.zeros(len(bars), bool)
                if listed:
                    chosen[field["queries"][0].as_py()] = True
                for start, best in tiles.items():
                    part = slice(start, start + len(best.bars))
                    need = chosen[part] if listed else _bounds(cell, matrix[part], norms[part])[1][:, 0] >= best.bars
                    queries = np.flatnonzero(need)
                    if len(queries):
                        best.add(queries, matrix[part][queries] @ v.T, own)
            yield from _found(tiles, question_ids, query_nos, TaskContext.get().partitionId() % lanes)

        columns = ["cell", "centre", "radius", "ids", "vectors", *(["queries"] if listed else [])]
        return merged(cells.select(*columns).mapInArrow(run, _SCORES), k)

    def raise_bars(self) -> None:
        found = self.score(self.cells.join(self.home(), "cell"), listed=True)
        self.bars = last_scores(found, self.arrays, self.k) - 10.0**-SCORE_DECIMALS

    def hits(self) -> DataFrame:
        if not len(self.bars):
            return self.score(self.cells.limit(0), listed=False)
        self.raise_bars()
        return self.score(self.cells.join(self.asked().drop("queries"), "cell"), listed=False)


def index_top_k_of_block(index: VectorIndex, block: DataFrame, k: int) -> DataFrame:
    """``index_top_k`` for a block of queries, partitioned by ``question_id``."""
    return _Block(index, block, k).hits()


def _packed_cells(index: VectorIndex) -> DataFrame:
    """``_PACKED``: number, size, centre and radius of the cells, as many to a row as are bounded at once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, TILE_CELLS) for at in range(0, batch.num_rows, TILE_CELLS)):
                ids, n, radii = (part.column(i).to_numpy() for i in (0, 1, 3))
                yield as_batch([(VECTORS, ids.tobytes(), n.tobytes(), b"".join(part.column(2).to_pylist()), radii.tobytes())])

    cells = index.cells.select("cell", "n", "centre", "radius")
    return cells.repartition(-(-max(1, cells.count()) // TILE_CELLS), "cell").mapInArrow(pack, _PACKED)


def _with_cells(index: VectorIndex, pairs: DataFrame) -> DataFrame:
    """``place`` and ``_PACKED``: for ``place, cell, numbers`` the vectors of the cell."""
    radius = F.lit(None).cast("binary").alias("radii")
    return index.cells.select("cell", "ids", "vectors").join(pairs, "cell").select(
        "place", F.lit(VECTORS).alias("kind"), "ids", "numbers", "vectors", radius
    )


def grid_index_top_k(index: VectorIndex, queries: DataFrame, dims: int, groups: int, k: int, merge: bool = False) -> DataFrame:
    """``index_top_k`` of many queries, or ``merge_variants`` of it, dealt out in groups (see ``search.grid_top_k``): a cell goes only to groups that it may hold a hit for.

    Each query first gets a bar from the nearest cells that hold ``k`` vectors together. A group's task raises bars as it goes and scores
    a cell only for the queries whose bars its bound reaches.
    """
    if index.centroids.shape[1] not in (0, dims):
        raise ValueError(f"corpus vectors must have {dims} values like the queries")
    spark, tile_queries, decimals = index.cells.sparkSession, TILE_QUERIES, SCORE_DECIMALS
    asked, pairs = packed_queries(queries, groups), "place int, cell bigint, numbers binary"

    def tiled(group: Group, row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First query of a tile, products with centres and bounds."""
        centres = np.frombuffer(row["vectors"], np.float64).reshape(-1, group.matrix.shape[1])
        radii = np.frombuffer(row["radii"], np.float64)
        for start in range(0, len(group.matrix), tile_queries):
            tile = slice(start, start + tile_queries)
            products = group.matrix[tile] @ centres.T
            yield start, products, products + group.norms[tile, None] * radii * (1 + SLACK) + SLACK

    def paired(place: int, cells: list[int], numbers: list[bytes | None]) -> pa.RecordBatch:
        columns = [pa.array([place] * len(cells), pa.int32()), pa.array(cells, pa.int64()), pa.array(numbers, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["place", "cell", "numbers"])

    def home(place: int, group: Group, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            cells, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["numbers"], np.int32)
            near: list[np.ndarray] = []
            for start, products, _ in tiled(group, row):
                order = np.argsort(-products, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                query, rank = np.nonzero(before < k)
                near.append(np.stack([order[query, rank], start + query]))
            cell, query = np.concatenate(near, axis=1)
            order = np.lexsort((query, cell))
            chosen, first = np.unique(cell[order], return_index=True)
            members = np.split(query[order].astype(np.int32), first[1:])
            yield paired(place, cells[chosen].tolist(), [m.tobytes() for m in members])

    def raise_bars(place: int, group: Group, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        tiles = _tiles(group.bars, k, tile_queries, decimals)
        for row in rows:
            ids, v = group.vectors(row)
            members = np.frombuffer(row["numbers"], np.int32)
            for start, best in tiles.items():
                own = members[slice(*np.searchsorted(members, [start, start + len(best.bars)]))]
                if len(own):
                    best.add(own - start, group.matrix[own] @ v.T, ids)
        for best in tiles.values():
            best.settle()
        bars = np.concatenate([best.bars for best in tiles.values()]) - 10.0**-decimals
        yield as_batch([(place, BARS, None, None, bars.tobytes(), None)])

    def ask(place: int, group: Group, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            cells = np.frombuffer(row["ids"], np.int64)
            wanted = np.zeros(len(cells), bool)
            for start, _, bounds in tiled(group, row):
                wanted |= (bounds >= group.bars[start : start + len(bounds), None]).any(0)
            cells = cells[wanted].tolist()
            yield paired(place, cells, [None] * len(cells))

    def best_of(place: int, group: Group, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        tiles = _tiles(group.bars, k, tile_queries, decimals)
        for row in rows:
            ids, v = group.vectors(row)
            centre = v.mean(0)
            radius = np.sqrt(((v - centre) ** 2).sum(1).max())
            for start, best in tiles.items():
                tile = slice(start, start + len(best.bars))
                bounds = group.matrix[tile] @ centre + group.norms[tile] * radius * (1 + SLACK) + SLACK
                own = np.flatnonzero(bounds >= best.bars)
                if len(own):
                    best.add(own, group.matrix[start + own] @ v.T, ids)
        yield from group.merged(tiles) if merge else group.hits(tiles)

    def with_queries(*sides: DataFrame) -> DataFrame:
        whole = asked
        for side in sides:
            whole = whole.unionByName(side)
        return whole

    cells = to_all(_packed_cells(index), groups)
    near = in_groups(with_queries(cells), groups, home, pairs)
    path = fresh_path(spark, "bars")
    in_groups(with_queries(_with_cells(index, near)), groups, raise_bars, f"place int, {_PACKED}").write.parquet(path)
    bars = spark.read.schema(f"place int, {_PACKED}").parquet(path)
    wanted = in_groups(with_queries(bars, cells), groups, ask, pairs)
    return in_groups(with_queries(bars, _with_cells(index, wanted)), groups, best_of, _MERGED if merge else _RANKED)


def index_top_k(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """What ``top_k`` finds in the corpus of the index: ``question_id, query_no, review_id, score, rank``.

    No vector is left out by more than the proof that it cannot be a hit. Where vectors show no clusters all cells are asked for, and
    this does the work of a scan.
    """
    return searched(
        queries, k, lambda block: index_top_k_of_block(index, block, k),
        lambda many, dims, groups: grid_index_top_k(index, many, dims, groups, k),
    )


def index_use(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """``cells, asked_cells, pairs, asked_pairs`` of each query block: how much of the index a search reads and scores."""

    def job(block: DataFrame) -> DataFrame:
        own = _Block(index, block, k)
        if len(own.bars):
            own.raise_bars()
        n = F.lit(len(own.bars)).cast("bigint")
        every = own.cells.select("cell").join(own.asked(), "cell", "left")
        return every.agg(
            F.count(F.lit(1)).alias("cells"), F.count("queries").alias("asked_cells"),
            (F.count(F.lit(1)) * n).alias("pairs"), F.coalesce(F.sum("queries"), F.lit(0).cast("bigint")).alias("asked_pairs"),
        )

    return in_blocks(queries, k, job)
