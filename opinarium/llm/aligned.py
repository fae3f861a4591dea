"""Alignment of two tokenizers, measured over a whole corpus, with every distinct text tokenised once.

Texts are shuffled by their full content, so copies meet and are counted, a map task's own copies beforehand. Each distinct text
is tokenised both ways and cut where tokens of both end at the same byte. Its distinct id pairs are kept as two arrays; a
pair's count adds the copies of the texts that hold it. The most frequent pairs, of which there is a fixed number at most, are
looked up where the arrays lie; only the others, none of them frequent, are exploded and joined with their counts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinarium.llm.tables import hot_join, small, written

#: Pairs at most whose counts are broadcast: 24 bytes each.
FREQUENT = 1 << 16
#: Links of a group beyond which its pairs are found from distinct ids.
WIDE = 1 << 12
#: Texts in Python at once.
SLICE = 200

MEASURES = ("n_a", "n_b", "n_groups", "n_links")


@dataclass(frozen=True)
class Tokenizers:
    """What the tasks need: byte ranks and word pattern of A, the model of B."""

    ranks: dict[bytes, int]
    pattern: str
    model: bytes


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: visible Latin-1 for itself, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def read_tokenizers(byte_level: str, pieces: str, pattern: str) -> Tokenizers:
    """A from a JSON file of a byte-level BPE, B from a model file of pieces with byte fallback.

    A's ids must be in the order of its merges, as ids then are ranks.
    """
    with open(byte_level, encoding="utf-8") as file:
        model = json.load(file)["model"]
    signs, vocab = _byte_signs(), model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocab["".join(pair)] for pair in merges]
    if made != list(range(len(vocab) - len(made), len(vocab))):
        raise ValueError("ids are not in the order of the merges")
    ranks = {bytes(signs[s] for s in entry): i for entry, i in vocab.items()}
    with open(pieces, "rb") as file:
        return Tokenizers(ranks, pattern, file.read())


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, a byte piece its byte."""
    return [
        bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in enumerate(model.id_to_piece(list(range(model.get_piece_size()))))
    ]


def _digits(n: int) -> np.ndarray:
    """Decimal digits of 0 to ``n - 1`` as bytes, zero bytes on the right, and a column to spare for a separator."""
    width = len(str(max(n - 1, 0)))
    out = np.zeros((n, width + 1), np.uint8)
    out[:, :width] = np.arange(n).astype(f"S{width}").view(np.uint8).reshape(n, width)
    return out


def _pairs(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs that share a group, as ``a << 32 | b``, and how many links each has.

    ``ca, cb``: tokens of each group. Links of wide groups are not listed: their pairs come from distinct ids.
    """
    start_a, start_b = np.cumsum(ca) - ca, np.cumsum(cb) - cb
    wide = ca * cb > WIDE
    times = np.where(wide[group_a], 0, cb[group_a])
    inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    codes = [np.repeat(a, times) << 32 | b[np.repeat(start_b[group_a], times) + inner]]
    counts = [np.ones(len(codes[0]), np.int64)]
    for g in np.flatnonzero(wide).tolist():
        own_a, n_a = np.unique(a[start_a[g] : start_a[g] + ca[g]], return_counts=True)
        own_b, n_b = np.unique(b[start_b[g] : start_b[g] + cb[g]], return_counts=True)
        codes.append((own_a[:, None] << 32 | own_b).ravel())
        counts.append((n_a[:, None] * n_b).ravel())
    found, place = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)


class Aligner:
    """Both tokenizers, loaded, with tables of their tokens' bytes and digits."""

    def __init__(self, given: Tokenizers) -> None:
        self.a = tiktoken.Encoding("a", pat_str=given.pattern, mergeable_ranks=given.ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=given.model)
        self.b_bytes = piece_bytes(self.b)
        sizes = sorted((i, len(t)) for t, i in given.ranks.items())
        self.a_sizes = np.array([n for _, n in sizes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        self.digits = [_digits(len(t)) for t in (self.a_sizes, self.b_sizes)]

    def align(self, text: str) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """Tokens of both, groups, links, the digest of the groups, and distinct pairs with their links.

        All zero, with an empty digest, if either side does not give back the text after a space.
        """
        none = np.zeros(0, np.int64)
        spaced = " " + text
        data = spaced.encode()
        a = np.array(self.a.encode_ordinary(spaced), np.int64)
        ids = self.b.encode(text, num_threads=1) if text else []
        b = np.array(ids, np.int64)
        if not text or b"".join(map(self.b_bytes.__getitem__, ids)) != data or self.a_sizes[a].sum() != len(data):
            return 0, 0, 0, 0, "", none, none
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.zeros((2, len(data) + 1), bool)
        ends[0, ends_a], ends[1, ends_b] = True, True
        last_a, last_b = ends[1, ends_a], ends[0, ends_b]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        ca, cb = np.bincount(group_a), np.bincount(group_b)
        pairs, links = _pairs(a, b, group_a, ca, cb)
        digest = self._digest((a, b), (group_a, group_b), (last_a, last_b), (ca, cb))
        return len(a), len(b), len(ca), int((ca * cb).sum()), digest, pairs, links

    def _digest(self, ids, groups, lasts, counts) -> str:
        """Digest of the groups as text: ids of A, a bar, ids of B, semicolons between groups."""
        width = max(t.shape[1] for t in self.digits)
        out = np.zeros((len(ids[0]) + len(ids[1]), width), np.uint8)
        before_b, upto_a = np.cumsum(counts[1]) - counts[1], np.cumsum(counts[0])
        shifts = before_b[groups[0]], upto_a[groups[1]]
        for own, last, shift, table, end in zip(ids, lasts, shifts, self.digits, b"|;"):
            rows = table[own]
            rows[:, -1] = np.where(last, end, ord(","))
            out[np.arange(len(own)) + shift, : rows.shape[1]] = rows
        return hashlib.sha256(out[out != 0][:-1].tobytes()).hexdigest()


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def align_texts(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """One row per distinct text, written: ``text_key, copies``, the measures, ``groups_sha256, pairs, links``.

    Null and empty texts are left out. Copies are found by the text itself; ``text_key`` is its SHA-256.
    """
    distinct = docs.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    given = docs.sparkSession.sparkContext.broadcast(tokenizers)
    schema = (
        "text_key string, copies bigint, " + ", ".join(f"{m} bigint" for m in MEASURES)
        + ", groups_sha256 string, pairs array<bigint>, links array<bigint>"
    )

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(given.value)
        for batch in small(batches, SLICE):
            rows = [aligner.align(text) for text in batch.column(2).to_pylist()]
            *measures, digests, pairs, links = zip(*rows)
            columns = [pa.array(m, pa.int64()) for m in measures] + [pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns, _lists(pairs), _lists(links)],
                ["text_key", "copies", *MEASURES, "groups_sha256", "pairs", "links"],
            )

    keyed = distinct.select(F.sha2("text", 256).alias("text_key"), "copies", "text")
    return written(keyed.mapInArrow(tokenise, schema), "aligned-texts")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, count, best``, written: documents that hold each id pair, and whether no other pair of its A id has more.

    An A id has no more pairs than B has ids.
    """
    counted = aligned.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("count"))
    of_a = W.partitionBy(F.shiftright("pair", 32))
    return written(counted.withColumn("best", F.col("count") == F.max("count").over(of_a)), "aligned-counts")


def _cutoff(counts: DataFrame, frequent: int) -> int:
    """The least power of two that at most ``frequent`` pairs reach."""
    sizes = counts.groupBy(F.length(F.bin("count")).alias("bits")).count().collect()  # a row per bit length
    reached, bits = 0, 63
    for size, n in sorted(((r["bits"], r["count"]) for r in sizes), reverse=True):
        if reached + n > frequent:
            break
        reached, bits = reached + n, size
    return 1 << (bits - 1)


def measure_texts(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` without its arrays, with ``n_best`` and ``count_sum``; written."""
    counts = pair_counts(aligned)
    cutoff = _cutoff(counts, frequent)
    # At most ``frequent`` rows.
    known = counts.filter(F.col("count") >= cutoff).orderBy("pair").toArrow()
    shared = aligned.sparkSession.sparkContext.broadcast(
        tuple(known.column(c).to_numpy().astype(np.int64) for c in ("pair", "count", "best"))
    )
    kept = ["text_key", "copies", *MEASURES, "groups_sha256"]
    fields = {f.name: f.dataType.simpleString() for f in aligned.schema}
    added = {"n_best": "bigint", "count_sum": "bigint", "pairs": "array<bigint>", "links": "array<bigint>"}
    schema = ", ".join(f"{name} {kind}" for name, kind in ({k: fields[k] for k in kept} | added).items())
    split = written(
        aligned.select(*kept, "pairs", "links").mapInArrow(_looked_up(shared, len(kept)), schema), "aligned-frequent"
    )
    rare = split.select("text_key", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("text_key", "p.*")
    found = rare.join(counts.filter(F.col("count") < cutoff), F.col("pairs") == F.col("pair")).groupBy("text_key").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("_best"),
        F.sum(F.col("links") * F.col("count")).alias("_sum"),
    )
    zero = F.lit(0).cast("bigint")
    summed = split.drop("pairs", "links").join(found, "text_key", "left").withColumns(
        {
            "n_best": F.col("n_best") + F.coalesce("_best", zero),
            "count_sum": F.col("count_sum") + F.coalesce("_sum", zero),
        }
    )
    return written(summed.drop("_best", "_sum"), "aligned-measures")


def _looked_up(shared, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task side: sums over frequent pairs, the other pairs passed on. The arrays follow ``width`` columns."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = shared.value
        for batch in small(batches):
            lists = batch.column(width)
            sizes = np.diff(lists.offsets.to_numpy())
            pairs, links = lists.flatten().to_numpy(), batch.column(width + 1).flatten().to_numpy()
            text = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.searchsorted(codes, pairs)
            hit = place < len(codes)
            hit[hit] = codes[place[hit]] == pairs[hit]
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], text[hit], links[hit] * best[place[hit]])
            np.add.at(sums[1], text[hit], links[hit] * counts[place[hit]])
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(text[~hit], minlength=batch.num_rows))].astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit])) for x in (pairs, links)]
            names = [*batch.schema.names[:width], "n_best", "count_sum", "pairs", "links"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *map(pa.array, sums), *rest], names)

    return look_up


def aligned_documents(docs: DataFrame, tokenizers: Tokenizers, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id``, the measures, ``n_best, count_sum, groups_sha256`` of every row.

    Rows whose text is null, empty or not given back by both tokenizers have zeros and an empty ``groups_sha256``, and add
    to no count. Repeated rows count as documents of their own. No rows in, none out.
    A text of any length is tokenised whole, in one task. A group so long that neither tokenizer's
    ends meet costs memory with the product of its distinct ids of both sides.
    """
    measured = measure_texts(align_texts(docs, tokenizers), frequent).withColumnRenamed("copies", "_copies")
    keyed = docs.select("doc_id", F.when(F.col("text") != "", F.sha2("text", 256)).alias("text_key"))
    joined = hot_join(written(keyed, "aligned-keys"), measured, "text_key", "_copies")
    sums = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in (*MEASURES, "n_best", "count_sum")]
    return joined.select("doc_id", *sums, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
