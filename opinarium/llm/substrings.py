"""Substring dedup: windows of words that an earlier document has already.

Every window of a document has a Rabin-Karp hash, and an anchor: the least hash of the shorter windows within it. Equal
windows have equal anchors, so a window whose anchor no other document has is found nowhere else and need not
be counted. Successive windows with one anchor form a run, and equal runs of windows are counted as one, with their smallest
document: all windows of the same run in later documents go. Only where an anchor has different runs, the windows of the
smallest document of each are counted one by one. Windows of later documents merge into maximal intervals, which go.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from opinarium.llm.filters import bits_of, build_filter, contains, mixed
from opinarium.llm.tables import small, words_of, written

WINDOW = 50
#: Bits of the filter of shared anchors, as a power of two: 32 MB for any corpus. A fuller filter lets more windows be counted.
LOG_BITS, PROBES = 28, 2
#: Words after which the texts read so far are hashed together.
AT_ONCE = 200_000
#: Two odd multipliers with their inverses modulo 2**64: 96 bits of two hashes make equal hashes of unequal windows negligible.
BASES = tuple((base, pow(base, -1, 1 << 64)) for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def slices(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: tuple[int, int] = BASES[0]) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of the values from each start to its end (exclusive)."""
    up = np.full(len(x), base[0], np.uint64)
    down = np.full(len(x), base[1], np.uint64)
    up[:1] = down[:1] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * down, dtype=np.uint64)])
    return (sums[ends] - sums[starts]) * up[ends - 1]


def rolling(x: np.ndarray, size: int, base: tuple[int, int] = BASES[0]) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``size`` values."""
    starts = np.arange(max(len(x) - size + 1, 0))
    return slices(x, starts, starts + size, base)


def anchors(x: np.ndarray, window: int) -> np.ndarray:
    """Anchor of every window: least mixed hash of the windows of half its size within it."""
    short = (window + 1) // 2
    least = mixed(rolling(x, short))
    width = window - short + 1  # of short windows in a window
    done = 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return least


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def hashed_texts(batch: pa.RecordBatch, least: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Rows of a batch with ``text`` of at least so many words, some at once: their numbers, where each begins, and all word hashes."""
    rows, sizes, words = [], [], []
    for row, text in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
        own = words_of(text)
        if len(own) >= least:
            rows.append(row)
            sizes.append(len(own))
            words += own
            if len(words) >= AT_ONCE:
                yield pa.array(rows), np.cumsum([0, *sizes]), word_hashes(words)
                rows, sizes, words = [], [], []
    if rows:
        yield pa.array(rows), np.cumsum([0, *sizes]), word_hashes(words)


def runs_of(begins: np.ndarray, x: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, anchor, first and last window (places in ``x``) of each run; windows across two texts are none."""
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    places = np.flatnonzero(text[: len(x) - window + 1] == text[window - 1 :])
    least, text = anchors(x, window)[places], text[places]
    begin = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
    end = np.r_[begin[1:], len(places)] - 1
    return text[begin], least[begin], places[begin], places[end]


def shared_anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``hash``: anchors that documents with different ids have."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for rows, begins, x in hashed_texts(batch, window):
                text, found, _, _ = runs_of(begins, x, window)
                ids = batch.column(0).take(rows).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([_signed(found), ids], ["hash", "doc_id"])

    found = docs.mapInArrow(own, "hash bigint, doc_id bigint")
    spread = found.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return spread.filter("low < high").select("hash")


def _check(h: np.ndarray) -> pa.Array:
    return pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32))


def candidate_runs(docs: DataFrame, shared: np.ndarray, window: int = WINDOW) -> DataFrame:
    """``h1, h2, anchor, doc_id, own, first, last``: runs of windows whose anchor may be shared, hashed as a whole."""
    sent = docs.sparkSession.sparkContext.broadcast(shared)
    log_bits = int(shared.size * 8).bit_length() - 1
    schema = "h1 bigint, h2 int, anchor bigint, doc_id bigint, own bigint, first int, last int"
    names = [f.split()[0] for f in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = sent.value
        for batch in small(batches):
            for rows, begins, x in hashed_texts(batch, window):
                text, anchor, first, last = runs_of(begins, x, window)
                may = np.flatnonzero(contains(packed, bits_of(anchor, log_bits, PROBES)))
                text, anchor, first, last = text[may], anchor[may], first[may], last[may]
                h1, h2 = (slices(x, first, last + window, base) for base in BASES)
                ids = [batch.column(i).take(rows).take(pa.array(text)) for i in (0, 1)]
                places = [pa.array((v - begins[text]).astype(np.int32)) for v in (first, last)]
                yield pa.RecordBatch.from_arrays([_signed(h1), _check(h2), _signed(anchor), *ids, *places], names)

    return docs.mapInArrow(cut, schema)


def windows_in(docs: DataFrame, runs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``h1, h2, doc_id, own, place`` of every window in ``runs`` (``doc_id, own, first, last``)."""
    wanted = runs.groupBy("doc_id", "own").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    schema = "h1 bigint, h2 int, doc_id bigint, own bigint, place int"
    names = [f.split()[0] for f in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            spans = batch.column(3)
            for rows, begins, x in hashed_texts(batch, window):
                runs = spans.take(rows)
                text, inner = runs.value_parent_indices().to_numpy(), runs.flatten()
                first, last = (inner.field(f).to_numpy().astype(np.int64) for f in ("first", "last"))
                sizes = last - first + 1
                upto = np.cumsum(sizes)
                text = np.repeat(text, sizes)
                places = np.arange(len(text)) + np.repeat(first - (upto - sizes), sizes)
                h1, h2 = (slices(x, begins[text] + places, begins[text] + places + window, base) for base in BASES)
                ids = [batch.column(i).take(rows).take(pa.array(text)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([_signed(h1), _check(h2), *ids, pa.array(places.astype(np.int32))], names)

    met = docs.join(wanted.hint("merge"), ["doc_id", "own"]).select("doc_id", "own", "text", "runs")
    return met.mapInArrow(cut, schema)


def _counted(rows: DataFrame, *extra) -> DataFrame:
    return rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), *extra)


def contested_runs(runs: DataFrame, classes: DataFrame) -> DataFrame:
    """``doc_id, own, first, last``: runs in the smallest document of their class, of anchors with classes from different ones."""
    by_anchor = classes.groupBy("anchor").agg(F.min("low").alias("from"), F.max("low").alias("to"))
    open_ = by_anchor.filter("from < to").select("anchor")
    held = classes.join(open_.hint("merge"), "anchor").select("h1", "h2", F.col("low").alias("doc_id"))
    return runs.join(held.hint("merge"), ["h1", "h2", "doc_id"]).select("doc_id", "own", "first", "last")


def removal_intervals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, own, cuts``: intervals of words (``start``, ``end`` exclusive) that windows of smaller ids cover.

    ``docs``: ``doc_id, own, text``, where ``own`` tells texts of one id apart. Intervals neither touch nor overlap.
    Documents without one are left out, as are null ids.
    """
    narrow = docs.select("doc_id", "own", "text").filter("doc_id IS NOT NULL")
    anchored = written(shared_anchors(narrow.select("doc_id", "text"), window), "substring-anchors")
    shared = build_filter(anchored, LOG_BITS, PROBES)
    runs = written(candidate_runs(narrow, shared, window), "substring-runs")
    classes = written(_counted(runs, F.min("anchor").alias("anchor")), "substring-classes")
    windows = written(windows_in(narrow, contested_runs(runs, classes), window), "substring-windows")
    firsts = written(_counted(windows).filter("low < high"), "substring-firsts")

    def later(rows: DataFrame, counted: DataFrame) -> DataFrame:
        low = counted.filter("low < high").select("h1", "h2", "low").hint("merge")
        return rows.join(low, ["h1", "h2"]).filter("doc_id > low")

    end = (F.col("last") + window).alias("end")
    whole = later(runs, classes).select("doc_id", "own", F.col("first").alias("start"), end)
    single = windows.withColumn("last", F.col("place"))
    spans = whole.unionByName(later(single, firsts).select("doc_id", "own", F.col("place").alias("start"), end))
    order = W.partitionBy("doc_id", "own").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") > reach, F.lit(True))
    parts = spans.withColumn("_fresh", fresh.cast("int")).withColumn("_part", F.sum("_fresh").over(order))
    merged = parts.groupBy("doc_id", "own", "_part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("doc_id", "own").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))


def without_cuts(words: list[bytes], cuts: list[dict] | None) -> list[bytes]:
    kept, at = [], 0
    for cut in cuts or ():
        kept += words[at : cut["start"]]
        at = cut["end"]
    return kept + words[at:]


def cut_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text, cuts``: every row with the intervals of words that go; null where none does.

    Rows of one ``doc_id`` do not remove each other's words; null ids neither lose
    words nor take any. Null texts have no words.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("own"), "text")
    cuts = written(removal_intervals(rows, window), "substring-cuts")
    return rows.join(cuts.hint("merge"), ["doc_id", "own"], "left").select("doc_id", "text", "cuts")


def removal_digests(cut: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of cut documents: kept words joined by one space."""
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = words_of(text)
                kept = without_cuts(words, cuts)
                rows.append((len(words), len(words) - len(kept), sha256(b" ".join(kept)).hexdigest()))
            columns = zip(*rows) if rows else ((), (), ())
            types = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return cut.mapInArrow(digest, schema)
