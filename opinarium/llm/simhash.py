"""SimHash near copies: fingerprints, links within a bit distance, components.

A fingerprint is embedded as the popcounts of its two-bit segments. Popcounts of a segment differ by no more
than its bits do, so the Manhattan distance of two embeddings is a lower bound of the bit distance.
Within ``3`` bits one half of the embedding differs by 1 at most: fingerprints that share a grid cell
of a half, or lie in cells one step apart, are compared exactly, and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from opinarium.llm.components import components
from opinarium.llm.tables import hot_join, rows_with_text, small, written
from opinarium.operators.bits import bit_words, with_likely

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Hashes whose bits are counted at once.
BLOCK = 1 << 16
#: Fingerprints of a cell that one task holds; a cell with more is dealt out in blocks.
CELL = 1024
#: Pairs that a worker compares at once.
PAIRS = 2_000_000
SEGMENTS = 16  # two-bit segments in a half


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of the word shingles of a text; 0 if it has no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingle = min(shingle, len(words))
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    spans = list(zip((ends - sizes)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), BLOCK):
        hashes = [xxh64_intdigest(line[start:end], SEED) for start, end in spans[at : at + BLOCK]]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, carried: Column, shingle: int = SHINGLE) -> DataFrame:
    """``_row, _print``: a struct carried along with each row, and the fingerprint of its text as a signed bigint."""
    source, text_of = rows_with_text(docs, carried)
    schema = source.select("_row", F.lit(0).cast("bigint").alias("_print")).schema

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            prints = [fingerprint(text, shingle) for text in text_of(batch).to_pylist()]
            column = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["_row", "_print"])

    return source.mapInArrow(tag, schema)


def _cells(prints: DataFrame) -> DataFrame:
    """``_cell, _role, _print``: role 0 in the own cell of each half, role 1 in those one step up.

    Of two cells one step apart one lies above the other, so steps up find all pairs.
    """
    low, high = F.col("_print").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("_print", 32)

    def counts(half: Column) -> Column:
        return half.bitwiseAND(0x55555555) + F.shiftrightunsigned(half, 1).bitwiseAND(0x55555555)

    halves = prints.select(
        "_print",
        F.explode(F.array(counts(low), counts(high) + F.lit(1 << 40))).alias("_cell"),
    )
    ups = [F.lit(1 << (2 * i)).cast("bigint") for i in range(SEGMENTS)]
    steps = F.filter(F.array(*ups), lambda up: F.col("_cell").bitwiseAND(up * 2) == 0)
    own = F.array(F.struct(F.lit(0).cast("bigint").alias("up"), F.lit(0).alias("role")))
    above = F.transform(steps, lambda up: F.struct(up.alias("up"), F.lit(1).alias("role")))
    return halves.select("_print", "_cell", F.explode(F.concat(own, above)).alias("_step")).select(
        (F.col("_cell") + F.col("_step.up")).alias("_cell"), F.col("_step.role").alias("_role"), "_print"
    )


def _dealt(cells: DataFrame, cell_rows: int) -> DataFrame:
    """Cells with their block: crowded ones in blocks of about ``cell_rows`` fingerprints.

    In a crowded cell a fingerprint is kept in one block and compared with the others, so every pair
    of the cell meets in a task that holds one block of it.
    """
    crowded = written(
        cells.filter("_role = 0").groupBy("_cell").count().filter(F.col("count") > cell_rows).select(
            F.col("_cell").alias("_crowded"), F.ceil(F.col("count") / cell_rows).cast("int").alias("_blocks")
        ),
        "simhash-crowded",
    )
    rows = cells.join(crowded, F.col("_cell") == F.col("_crowded"), "left")
    home = F.pmod(F.xxhash64("_print"), F.col("_blocks")).cast("int")
    blocks = F.when(
        F.col("_blocks").isNull(), F.array(F.struct(F.lit(0).alias("block"), F.col("_role").alias("role")))
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("_blocks") - 1),
            lambda b: F.struct(
                b.alias("block"), F.when((F.col("_role") == 0) & (b == home), 0).otherwise(1).alias("role")
            ),
        )
    )
    return rows.select("_cell", "_print", F.explode(blocks).alias("_place")).select(
        "_cell", F.col("_place.block").alias("_block"), F.col("_place.role").alias("_role"), "_print"
    )


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node that the links join each to, without those alone."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        label = label[label]
        if (label == before).all():
            nodes = np.flatnonzero(label != np.arange(n))
            return nodes, label[nodes]


def _near(place: np.ndarray, role: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is near: rows of one place, held ones (role 0) first."""
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    held = np.add.reduceat((role == 0).astype(np.int64), first)
    group = np.cumsum(np.r_[False, place[1:] != place[:-1]])
    tests, base = held[group], first[group]
    upto = np.cumsum(tests)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(place):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        n = tests[at:stop]
        row = np.repeat(np.arange(at, stop), n)
        other = np.repeat(base[at:stop], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        near = (other < row) & (np.bitwise_count(prints[row] ^ prints[other]) <= max_bits)
        found.append((row[near], other[near]))
        at = stop
    left, right = (np.concatenate(x) for x in zip(*found))
    return _forest(left, right, len(place))


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL) -> DataFrame:
    """``u, v``: links between distinct fingerprints that join all those within ``max_bits`` (3 at most).

    Pairs already joined by others of their cell are left out, so links grow with the rows, not with the pairs. A task
    reads its cells in order and holds one block of one cell.
    """
    if max_bits > 3:
        raise ValueError("halves of the embedding prove distances up to 3 only")
    placed = _dealt(_cells(prints), cell_rows)
    ordered = placed.repartition("_cell", "_block").sortWithinPartitions("_cell", "_block", "_role")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_place, kept = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, block, role, value = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
            if len(kept) and (kept_place[0, 0], kept_place[0, 1]) == (cell[0], block[0]):
                cell, block = np.r_[kept_place[:, 0], cell], np.r_[kept_place[:, 1], block]
                role, value = np.r_[np.zeros(len(kept), role.dtype), role], np.r_[kept, value]
            changes = (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])
            place = np.cumsum(np.r_[False, changes])
            nodes, roots = _near(place, role, value.view(np.uint64), max_bits)
            last = (place == place[-1]) & (role == 0)
            kept_place, kept = np.stack([cell[last], block[last]], axis=1), value[last]
            yield pa.RecordBatch.from_arrays([pa.array(value[nodes]), pa.array(value[roots])], ["u", "v"])

    return ordered.mapInArrow(links, "u bigint, v bigint")


def near_groups(tagged: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``_print, component_id, _kept_print, _rows`` of every fingerprint in ``tagged`` (``doc_id, _print``).

    Rows: how many have it. Component id: smallest doc_id among fingerprints joined by links; null only if no row of it has an id.
    ``_kept_print``: the smallest fingerprint that this document has in the component.
    """
    classes = written(tagged.groupBy("_print").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_rows")), "simhash-classes")
    joined = components(near_links(classes.select("_print"), max_bits))
    rooted = classes.join(joined, F.col("_print") == F.col("node"), "left").select(
        "_print", "_least", "_rows", F.coalesce("root", "_print").alias("_root")
    )
    first = rooted.groupBy("_root").agg(F.min(F.struct(F.col("_least").isNull(), "_least", "_print")).alias("_first"))
    return rooted.join(first, "_root").select(
        "_print", F.col("_first._least").alias("component_id"), F.col("_first._print").alias("_kept_print"), "_rows"
    )


def near_copies(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Null and blank texts share fingerprint 0, which links like any other; texts shorter than a
    shingle have one of all their words. Rows without an id get the id of their component. No rows in, none out.
    """
    tagged = written(
        with_fingerprints(docs, F.struct("doc_id"), shingle).select("_row.doc_id", "_print"), "simhash-prints"
    )
    groups = written(near_groups(tagged, max_bits), "simhash-groups")
    # One fingerprint, of blank texts say, may be that of most rows.
    return hot_join(tagged, groups, "_print", "_rows").select(
        "doc_id", F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_copies(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One whole row of every component: that of the smallest doc_id, once even if it is repeated.

    Which rows go is found on their numbers alone. Set as bits, these let rows that stay pass where they lie; only
    rows that go, and the few that share their bits, are shuffled.
    """
    number = F.monotonically_increasing_id().alias("_nth")
    tagged = written(with_fingerprints(docs, F.struct("*"), shingle).select("_row", "_print", number), "simhash-rows")
    narrow = tagged.select(F.col("_row.doc_id").alias("_id"), "_print", "_nth")
    groups = near_groups(narrow.select(F.col("_id").alias("doc_id"), "_print"), max_bits)
    kept = groups.filter("_print = _kept_print").select(
        F.col("component_id").alias("_kept_id"), F.col("_print").alias("_kept")
    )
    firsts = narrow.groupBy("_id", "_print").agg(F.min("_nth").alias("_first"))
    stays = firsts.join(kept, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_print") == F.col("_kept")))
    goes = written(
        narrow.join(stays.select("_first"), F.col("_nth") == F.col("_first"), "left_anti").select(
            F.col("_nth").alias("_gone"), F.xxhash64("_nth").alias("_key")
        ),
        "simhash-gone",
    )
    tested = with_likely(tagged.select("_row", "_nth"), F.xxhash64("_nth"), bit_words(goes, "_key"), "_likely")
    spared = tested.filter("_likely").join(goes, F.col("_nth") == F.col("_gone"), "left_anti")
    return tested.filter("NOT _likely").unionByName(spared).select("_row.*")
