"""Hard negatives by integer inner products over blocks in Hilbert order with zone maps.

Rows are ordered along a Hilbert curve through all dimensions and stored in blocks, each with the least and largest
value of every dimension and of the label. Interval arithmetic bounds an anchor's products with a block from both sides; only blocks
whose bounds meet what the anchor looks for (a positive above its bar, a negative inside one of its windows) are asked for. Blocks stand
in pages and anchors in lanes, both of fixed size: a task holds one page and one lane, however many there are of either. As every page
could send its best rows for every anchor, some pages, the root of their number, are read first; what they give sets bars for the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinarium.llm.tables import small, written

#: Rows of a block, blocks of a page, anchors of a lane.
BLOCK, PAGE, LANE = 512, 64, 1024
#: Bits of a dimension on the curve.
CURVE_BITS = 2
#: A component is multiplied by this and rounded down.
SCALE = 256
#: An anchor's positives, and negatives of each; a negative's score in percent of its positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95

NONE = np.iinfo(np.int64).min
ZONE = "label_lo bigint, label_hi bigint, lo binary, hi binary"


def curve_keys(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Place of each row of ``cells`` (n x dims, each below ``2 ** bits``) on the Hilbert curve, as bytes in order."""
    x = cells.T.astype(np.int64)
    top = 1 << (bits - 1)
    for level in (top >> i for i in range(bits - 1)):
        for own in x:
            turned = own & level != 0
            swapped = np.where(turned, 0, (x[0] ^ own) & (level - 1))
            x[0] ^= np.where(turned, level - 1, swapped)
            own ^= swapped
    x = np.bitwise_xor.accumulate(x, axis=0)
    flips = np.zeros_like(x[-1])
    for level in (top >> i for i in range(bits - 1)):
        flips ^= np.where(x[-1] & level, level - 1, 0)
    x ^= flips
    planes = np.concatenate([x >> shift & 1 for shift in range(bits - 1, -1, -1)])
    return np.packbits(planes.T.astype(np.uint8), axis=1)


def _usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v`` of rows that take part, with whole components."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    return kept.select("vec_id", F.col("label").cast("bigint").alias("label"), whole.alias("v"))


class Shape:
    """Dimensions, the narrowest type that holds all components, the type in which products are exact, and the curve's grid."""

    def __init__(self, rows: DataFrame) -> None:
        each = rows.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(
            F.avg("x").alias("mean"), F.stddev_pop("x").alias("width"), F.max(F.abs("x")).alias("most")
        )
        found = each.orderBy("pos").collect()  # a row per dimension
        self.dims = max(1, len(found))  # without any component, one of zeros
        self.mean, self.width = (np.array([r[c] for r in found] or [0], float) for c in ("mean", "width"))
        most = max((r["most"] for r in found), default=0)
        self.stored = next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)
        worst = self.dims * most * most
        self.exact = np.float32 if worst < 2**24 else np.float64 if worst < 2**53 else np.int64

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """Curve places of rows, the widest dimensions first; two standard deviations to each side are told apart."""
        order = np.argsort(-self.width, kind="stable")
        scaled = (rows - self.mean) / np.where(self.width > 0, self.width, 1) + 2
        cells = np.clip(np.floor(scaled * 2 ** (CURVE_BITS - 2)), 0, 2**CURVE_BITS - 1)
        return curve_keys(cells[:, order])

    def matrix(self, parts: list[bytes]) -> np.ndarray:
        """Stored rows as a matrix."""
        return np.frombuffer(b"".join(parts), self.stored).reshape(-1, self.dims)


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _coded(rows: DataFrame, shape: Shape, anchor: Column) -> DataFrame:
    """``key, vec_id, label, is_anchor, v``: rows with their place on the curve, vectors as bytes, short ones filled with zeros."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4096):
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            full = np.zeros((batch.num_rows, shape.dims), np.int64)
            full[np.arange(shape.dims) < sizes[:, None]] = lists.flatten().to_numpy()
            coded = [_binary(shape.keys(full)), _binary(full.astype(shape.stored))]
            yield pa.RecordBatch.from_arrays([coded[0], *batch.columns[:3], coded[1]], ["key", "vec_id", "label", "is_anchor", "v"])

    source = rows.select("vec_id", "label", F.coalesce(anchor, F.lit(False)).alias("is_anchor"), "v")
    return written(source.mapInArrow(code, "key binary, vec_id bigint, label bigint, is_anchor boolean, v binary"), "negatives-coded")


def _best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int, n: int) -> tuple[np.ndarray, ...]:
    """The first ``k`` of each owner by score and id, and per owner the score that the next has to reach."""
    order = np.lexsort((ids, -score, owner))
    owner, score, ids = owner[order], score[order], ids[order]
    keep = np.arange(len(owner)) - np.searchsorted(owner, np.arange(n))[owner] < k
    owner, score, ids = owner[keep], score[keep], ids[keep]
    counts = np.bincount(owner, minlength=n)
    bars, full = np.full(n, NONE), counts == k
    bars[full] = score[(np.cumsum(counts) - 1)[full]]
    return owner, score, ids, bars


def _blocks(coded: DataFrame, shape: Shape, k: int) -> DataFrame:
    """Blocks in order of the curve, written: ids, labels, vectors, the zone map, and of anchors in them the place and first bar.

    Equal keys are told apart by id, so that one vector with very many rows fills partitions like any other.
    """
    rows = coded.count()
    ordered = coded.repartitionByRange(max(1, -(-rows // (BLOCK * PAGE))), "key", "vec_id").sortWithinPartitions("key", "vec_id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held: pa.Table | None = None

        def block(table: pa.Table) -> pa.RecordBatch:
            nonlocal seq, before
            ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
            v = shape.matrix(table.column("v").to_pylist())
            at = np.flatnonzero(table.column("is_anchor").to_numpy(zero_copy_only=False))
            score = (v[at].astype(shape.exact) @ v.T.astype(shape.exact)).astype(np.int64)
            own, other = np.nonzero((labels[at][:, None] == labels) & (ids[at][:, None] != ids))
            *_, bars = _best(own, score[own, other], ids[other], k, len(at))
            values = [
                part, seq, before, len(at), int(labels.min()), int(labels.max()), v.min(0).tobytes(), v.max(0).tobytes(),
                ids.tobytes(), labels.tobytes(), v.tobytes(), at.astype(np.int64).tobytes(), bars.tobytes(),
            ]
            seq, before = seq + 1, before + len(at)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in values], names)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= BLOCK:
                yield block(held.slice(0, BLOCK))
                held = held.slice(BLOCK)
        if held is not None and held.num_rows:
            yield block(held)

    schema = f"part bigint, seq bigint, before bigint, anchors bigint, {ZONE}, ids binary, labels binary, v binary, at binary, bars binary"
    names = [field.strip().split()[0] for field in schema.split(",")]
    return written(ordered.select("vec_id", "label", "is_anchor", "v").mapInArrow(build, schema), "negatives-blocks")


def _numbered(blocks: DataFrame) -> tuple[DataFrame, int, int]:
    """Blocks with ``block``, ``page`` and the number ``first`` of their first anchor; numbers of pages and of lanes."""
    parts = blocks.groupBy("part").agg(F.max("seq").alias("last"), F.sum("anchors").alias("n")).orderBy("part").collect()  # a row per page or two
    pages, anchors, starts = 0, 0, []
    for r in parts:
        starts.append((r["part"], pages, anchors))
        pages, anchors = pages + r["last"] // PAGE + 1, anchors + r["n"]
    spark = blocks.sparkSession
    placed = blocks.join(F.broadcast(spark.createDataFrame(starts, "part bigint, _page bigint, _first bigint")), "part")
    numbered = placed.withColumns(
        {
            "block": F.shiftleft("part", 32) + F.col("seq"),
            "page": F.col("_page") + F.floor(F.col("seq") / PAGE),
            "first": F.col("_first") + F.col("before"),
        }
    )
    return numbered.drop("_page", "_first"), max(pages, 1), max(-(-anchors // LANE), 1)


ANCHOR = "lane bigint, no bigint, anchor_id bigint, label bigint, v binary"


def _anchors(blocks: DataFrame, shape: Shape) -> DataFrame:
    """A row per anchor, written: ``lane, no, anchor_id, label, v``, and ``bar``, its first bar for positives."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            first, ids, labels, v, at, bars = (batch.column(i)[0].as_py() for i in range(6))
            at, bars = np.frombuffer(at, np.int64), np.frombuffer(bars, np.int64)
            no = first + np.arange(len(at))
            ids, labels = (np.frombuffer(x, np.int64)[at] for x in (ids, labels))
            columns = [no // LANE, no, ids, labels, _binary(shape.matrix([v])[at]), bars]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["lane", "no", "anchor_id", "label", "v", "bar"])

    held = blocks.filter("anchors > 0").select("first", "ids", "labels", "v", "at", "bars")
    return written(held.mapInArrow(pick, f"{ANCHOR}, bar bigint"), "negatives-anchors")


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False)


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def _is_first(page: Column, pages: int) -> Column:
    """Whether a page is read in the first round: one in so many as the root of their number."""
    return page % -(-pages // max(1, int(pages**0.5))) == 0


def _asked(
    zones: DataFrame, seekers: DataFrame, pages: int, lanes: int, shape: Shape, wants: Callable, first: bool | None
) -> DataFrame:
    """``page, lane, block, wanted``, written: blocks that some anchor of a lane must read, and bits for which of them.

    ``wants(seekers, least, most, label_lo, label_hi)`` says so (anchors x blocks) from the bounds of the products. ``first`` takes the
    pages of the first round, or the others; None takes all.
    """

    def taken(page: Column) -> Column:
        return F.lit(True) if first is None else _is_first(page, pages) == first

    left = zones.filter(taken(F.col("page"))).select("page", F.explode(_numbers(lanes)).alias("lane"), "block", "label_lo", "label_hi", "lo", "hi")
    right = seekers.withColumn("page", F.explode(F.filter(_numbers(pages), taken)))

    def choose(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["page", "lane", "block", "wanted"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())], names)
        right = right.sort_by("no")
        lo, hi, a = (shape.matrix(t.column(c).to_pylist()).astype(shape.exact) for t, c in ((left, "lo"), (left, "hi"), (right, "v")))
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        most, least = up @ hi.T + down @ lo.T, up @ lo.T + down @ hi.T
        need = wants(right, least, most, _column(left, "label_lo"), _column(left, "label_hi"))
        bits = np.packbits(need.T, axis=1)
        asked = need.any(0)
        n = int(asked.sum())
        page, lane = (pa.array(np.full(n, k.as_py())) for k in key)
        return pa.table([page, lane, left.column("block").filter(pa.array(asked)).combine_chunks(), _binary(bits[asked])], names)

    cells = left.groupBy("page", "lane").cogroup(right.groupBy("page", "lane"))
    return written(cells.applyInArrow(choose, "page bigint, lane bigint, block bigint, wanted binary"), "negatives-asked")


def _read(blocks: DataFrame, asked: DataFrame, seekers: DataFrame, shape: Shape, score: Callable, schema: str) -> DataFrame:
    """``score(seekers, blocks)`` for every page and lane that belong together; only blocks asked for are read by it.

    ``blocks`` gives, one after the other, the anchors that want a block, its products with them, its ids and labels.
    """
    left = asked.join(blocks.select("block", "ids", "labels", "v"), "block")
    cells = asked.select(F.col("page").alias("own_page"), F.col("lane").alias("own_lane")).distinct()
    right = seekers.join(cells, F.col("lane") == F.col("own_lane"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("no")
        a = shape.matrix(right.column("v").to_pylist()).astype(shape.exact)

        def each() -> Iterator[tuple[np.ndarray, ...]]:
            for at in range(left.num_rows):
                wanted, ids, labels, v = (left.column(c)[at].as_py() for c in ("wanted", "ids", "labels", "v"))
                rows = np.flatnonzero(np.unpackbits(np.frombuffer(wanted, np.uint8), count=len(a)))
                ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
                yield rows, (a[rows] @ shape.matrix([v]).T.astype(shape.exact)).astype(np.int64), ids, labels

        return score(right, each())

    return left.groupBy("page", "lane").cogroup(right.groupBy("own_page", "own_lane")).applyInArrow(run, schema)


class _Running:
    """The first ``k`` candidates of each owner so far."""

    def __init__(self, bars: np.ndarray, k: int) -> None:
        none = np.zeros(0, np.int64)
        self.k, self.floor, self.bars, self.held = k, bars, bars, (none, none, none)

    def add(self, rows: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (owners ``rows`` x ``ids``) where ``allowed``; what cannot be among the first is left out."""
        allowed &= scores >= self.bars[rows][:, None]
        if scores.shape[1] > self.k and np.count_nonzero(allowed) > 4 * self.k * len(rows):
            masked = np.where(allowed, scores, NONE)
            allowed &= scores >= np.partition(masked, -self.k, axis=1)[:, -self.k, None]
        owner, place = np.nonzero(allowed)
        if len(owner):
            new = rows[owner], scores[owner, place], ids[place]
            *held, bars = _best(*(np.concatenate(x) for x in zip(self.held, new)), self.k, len(self.floor))
            self.held, self.bars = tuple(held), np.maximum(bars, self.floor)


def _positives(blocks: DataFrame, anchors: DataFrame, pages: int, lanes: int, shape: Shape, k: int) -> DataFrame:
    """Anchors with ``places, positive_ids, positive_scores``: their first ``k`` other rows of the same label; written."""

    def wants(right, least, most, label_lo, label_hi):
        label = _column(right, "label")[:, None]
        return (label_lo <= label) & (label <= label_hi) & (most.astype(np.int64) >= _column(right, "bar")[:, None])

    def score(right: pa.Table, parts) -> pa.Table:
        own_ids, own_labels = _column(right, "anchor_id"), _column(right, "label")
        running = _Running(_column(right, "bar"), k)
        for rows, scores, ids, labels in parts:
            running.add(rows, scores, (own_labels[rows][:, None] == labels) & (own_ids[rows][:, None] != ids), ids)
        owner, value, ids = running.held
        return pa.table([pa.array(_column(right, "no")[owner]), pa.array(ids), pa.array(value)], ["no", "positive_id", "positive_score"])

    def ranked(seekers: DataFrame, first: bool, before: DataFrame | None = None) -> DataFrame:
        asked = _asked(blocks, seekers, pages, lanes, shape, wants, first)
        found = _read(blocks, asked, seekers, shape, score, "no bigint, positive_id bigint, positive_score bigint")
        found = found if before is None else found.unionByName(before.select(found.columns))
        place = F.row_number().over(W.partitionBy("no").orderBy(F.col("positive_score").desc(), "positive_id"))
        return written(found.withColumn("place", place).filter(F.col("place") <= k), "negatives-ranked")

    some = ranked(anchors, True)
    last = some.filter(F.col("place") == k).select(F.col("no").alias("_no"), F.col("positive_score").alias("_last"))
    raised = anchors.join(last, F.col("no") == F.col("_no"), "left").withColumn("bar", F.greatest("bar", "_last")).drop("_no", "_last")
    best = ranked(written(raised, "negatives-raised"), False, some)
    # At most k rows a group.
    lists = best.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    return written(
        anchors.join(lists, "no").select(
            "lane", "no", "anchor_id", "label", "v",
            F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores"),
        ),
        "negatives-positives",
    )


def _windows(right: pa.Table, places: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positive ids and scores (anchors x places) and each window's ends; a missing place has an empty window."""
    ids, scores = np.zeros((2, right.num_rows, places), np.int64)
    sizes = np.diff(right.column("positive_ids").combine_chunks().offsets.to_numpy())
    given = np.arange(places) < sizes[:, None]
    for out, name in ((ids, "positive_ids"), (scores, "positive_scores")):
        out[given] = right.column(name).combine_chunks().flatten().to_numpy()
    hundreds, rest = np.divmod(scores, 100)  # percentages of large scores without overflow
    start = np.where(given, low * hundreds - (-low * rest // 100), 1)
    if "floor_scores" in right.column_names:  # what a first round found
        place, floor = (right.column(c).combine_chunks() for c in ("floor_places", "floor_scores"))
        row = np.repeat(np.arange(right.num_rows), np.diff(place.offsets.to_numpy()))
        at = row, place.flatten().to_numpy()
        start[at] = np.maximum(start[at], floor.flatten().to_numpy())
    return ids, scores, start, np.where(given, high * hundreds + high * rest // 100, 0)


def asked_blocks(p: Prepared, seekers: DataFrame | None = None, first: bool | None = None) -> DataFrame:
    """``page, lane, block, wanted``: what the windows of the anchors must read; ``seekers`` may bring floors of a first round."""
    places, low, high = p.places, p.low, p.high

    def wants(right, least, most, label_lo, label_hi):
        _, _, start, end = _windows(right, places, low, high)
        other = (label_lo != label_hi) | (_column(right, "label")[:, None] != label_lo)
        least, most = least.astype(np.int64), most.astype(np.int64)
        meets = [
            (most >= start[:, i, None]) & (least <= end[:, i, None]) & (start[:, i] <= end[:, i])[:, None] for i in range(places)
        ]
        return other & reduce(np.logical_or, meets)

    return _asked(p.blocks, p.seekers if seekers is None else seekers, p.pages, p.lanes, p.shape, wants, first)


class Prepared:
    """Blocks, and anchors with their positives, both written."""

    def __init__(self, vectors: DataFrame, anchor: Column, places: int, low: int, high: int) -> None:
        rows = _usable(vectors)
        self.places, self.low, self.high = places, low, high
        self.shape = Shape(rows)
        stored = _blocks(_coded(rows, self.shape, anchor), self.shape, places)
        self.blocks, self.pages, self.lanes = _numbered(stored)
        anchors = _anchors(self.blocks, self.shape)
        self.seekers = _positives(self.blocks, anchors, self.pages, self.lanes, self.shape, places)


FOUND = "anchor_no bigint, anchor_id bigint, positive_id bigint, positive_score bigint, place int, negative_id bigint, negative_score bigint"


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows where ``anchor`` holds.

    ``vectors``: ``vec_id, label, embedding``. Rows with a null id or label, a null vector, or a null or non-finite component
    take no part. Components are multiplied by 256 and rounded down; scores are inner products of these, which must fit
    64 bits. Shorter vectors count as filled with zeros. Higher scores come first, then smaller ids.

    An anchor's positives are its first ``positives`` rows of the same label and another id; for each, the first ``negatives`` rows of
    another label whose score is from ``low`` to ``high`` percent of the positive's are returned, if there are any. A
    repeated row counts each time, as an anchor too. No rows in, none out.
    """
    p = Prepared(vectors, anchor, positives, low, high)

    def score(right: pa.Table, parts) -> pa.Table:
        ids, scores, start, end = _windows(right, positives, low, high)
        labels = _column(right, "label")
        running = [_Running(start[:, i], negatives) for i in range(positives)]
        for rows, products, own_ids, own_labels in parts:
            other = labels[rows][:, None] != own_labels
            for i, top in enumerate(running):
                top.add(rows, products, other & (products <= end[rows, i, None]), own_ids)
        out = []
        for i, top in enumerate(running):
            owner, value, found = top.held
            out.append((_column(right, "no")[owner], _column(right, "anchor_id")[owner], ids[owner, i], scores[owner, i], np.full(len(owner), i, np.int32), found, value))
        columns = [pa.array(np.concatenate(c)) for c in zip(*out)]
        return pa.table(columns, [field.strip().split()[0] for field in FOUND.split(",")])

    def ranked(seekers: DataFrame, first: bool, before: DataFrame | None = None) -> DataFrame:
        found = _read(p.blocks, asked_blocks(p, seekers, first), seekers, p.shape, score, FOUND)
        found = found if before is None else found.unionByName(before.select(found.columns))
        order = W.partitionBy("anchor_no", "place").orderBy(F.col("negative_score").desc(), "negative_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)

    some = written(ranked(p.seekers, True), "negatives-first")
    floors = some.filter(F.col("rank") == negatives).groupBy(F.col("anchor_no").alias("_no")).agg(
        F.collect_list("place").alias("floor_places"), F.collect_list("negative_score").alias("floor_scores")
    )  # at most one value per positive
    none = {c: F.coalesce(c, F.array().cast(t)) for c, t in (("floor_places", "array<int>"), ("floor_scores", "array<bigint>"))}
    raised = written(p.seekers.join(floors, F.col("no") == F.col("_no"), "left").withColumns(none).drop("_no"), "negatives-floors")
    return ranked(raised, False, some).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
