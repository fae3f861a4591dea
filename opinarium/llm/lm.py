"""Language-model scores from a log-frequency Bloom filter.

A bigram of count ``c`` is put into the filter once for each of its ``1 + floor(log2 c)`` levels, so its quantised count is read by
probing level after level until one is missing. The filter has a fixed size; each of its segments keeps all
bigrams down to the least count with which it stays half empty. Rarer ones are listed, and a join brings their quantised counts. Bigrams are
those of a bounded vocabulary; all other words form one class in them, whose probability its members share by their exact counts, which
the same join brings. Counts of single words are exact.

What follows a word is weighed by the sum of all quantised counts, so probabilities after a word sum to 1 but for
bigrams that the filter wrongly has: one in ``2 ** PROBES`` at most, each counted as 1; where a segment lists its rare bigrams, one in that many
for each level up to the least that it holds.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinarium.llm.filters import SEGMENT_BITS, SEGMENTS, bits_of, contains, mixed, segment_of, unmixed
from opinarium.llm.tables import small, written

#: Words of the vocabulary at most; bits of the filter as a power of two (32 MB); probes of a level.
VOCABULARY, LOG_BITS, PROBES = 100_000, 28, 2
#: Tokens after which the texts read so far are scored together.
AT_ONCE = 200_000
#: Weight of the single-word model against the count of the word before.
PRIOR = 200.0
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
#: The end of a text, counted as a token; no word is empty.
END = ""


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of all tokens of ``docs``, summed within each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in small(batches):
            for text in batch.column(0).to_pylist():
                seen.update(tokens_of(text))
                seen[b""] += 1
                if len(seen) >= HELD:
                    yield flushed(seen)
                    seen.clear()
        if seen:
            yield flushed(seen)

    def flushed(seen: Counter) -> pa.RecordBatch:
        words = pa.array(list(seen), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Vocabulary with counts, tokens and distinct tokens in training, the filter of bigrams, and by first token the sum of what it holds.

    ``rest`` is that sum for the listed bigrams, ``least`` the least level that each segment holds, ``lists`` a table of the ``hashes`` and
    ``levels`` of the listed ones, if there are any.
    """

    words: list[str]
    counts: np.ndarray
    tokens: int
    distinct: int
    packed: np.ndarray
    mass: np.ndarray
    rest: np.ndarray
    least: np.ndarray
    lists: DataFrame | None = None


def vocabulary(counts: DataFrame, size: int) -> tuple[list[str], np.ndarray]:
    """At most ``size`` words that occur at least twice, by a least count, so that no ranking is needed."""
    by_count = counts.groupBy("n").agg(F.count("*").alias("words"))
    upto = F.sum("words").over(W.orderBy(F.desc("n")))
    least = by_count.filter("n >= 2").withColumn("upto", upto).filter(F.col("upto") <= size).agg(F.min("n")).first()[0]
    if least is None:
        return [], np.zeros(0, np.int64)
    rows = sorted((r["word"], r["n"]) for r in counts.filter((F.col("n") >= least) & (F.col("word") != END)).collect())
    return [w for w, _ in rows], np.array([n for _, n in rows], np.int64)


def _ids(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Ids of a text's tokens from the vocabulary; the size of it stands for other words, one more for the end of a text."""
    other = len(known)
    ids = np.full(len(words) + 1, other + 1, np.int64)
    ids[:-1] = np.fromiter(map(known.get, words, repeat(other)), np.int64, len(words))
    return ids


def _hashes(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mixed((before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))


def _pairs(ids: np.ndarray, known: int) -> np.ndarray:
    """Hashes of each token with the one before; a text begins after an end."""
    return _hashes(np.concatenate([[known + 1], ids[:-1]]), ids)


def _level(h: np.ndarray, level: int) -> np.ndarray:
    """Hash of a bigram at a level, in the same segment."""
    top = np.uint64(64 - SEGMENT_BITS)
    step = np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)
    return (h >> top << top) | (mixed(h + step) >> np.uint64(SEGMENT_BITS))


def _levels(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(n)).astype(np.int64)


def _quantised(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for, the middle of its range; none for level 0."""
    return np.where(levels > 0, 1.5 * 2.0 ** (levels - 1) - 0.5, 0.0)


def _key(h: np.ndarray) -> pa.Array:
    """Bigrams as words of the join: hashes after two line feeds, which begin no word and no other key."""
    data = np.full((len(h), 10), ord("\n"), np.uint8)
    data[:, 2:] = np.ascontiguousarray(h, np.uint64).view(np.uint8).reshape(-1, 8)
    return pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(np.arange(len(h) + 1, dtype=np.int32) * 10), pa.py_buffer(data)])


def least_count(n: np.ndarray, room: int) -> int:
    """Least count whose bigrams, with all larger ones, take at most ``room`` places."""
    if not len(n):
        return 1
    order = np.sort(n)[::-1]
    taken = np.cumsum(_levels(order))
    fits = int(np.searchsorted(taken, room, "right"))
    return 1 if fits == len(order) else int(order[fits]) + 1


def bigram_filter(docs: DataFrame, words: list[str], log_bits: int = LOG_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The packed filter of the bigrams of ``docs``, and the sum of its quantised counts by their first token."""
    filled = bigram_segments(docs, words, log_bits)
    packed, _ = _gathered(filled, log_bits)
    mass, _ = _masses(filled, len(words))
    return packed, mass


def _gathered(filled: DataFrame, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed filter and the least level of each segment."""
    size = (1 << (log_bits - SEGMENT_BITS)) // 8
    packed, least = np.zeros((1 << log_bits) // 8, np.uint8), np.ones(SEGMENTS, np.int8)
    for row in filled.select("segment", "bits", "least").collect():
        packed[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
        least[row["segment"]] = row["least"]
    return packed, least


def _masses(filled: DataFrame, known: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of quantised counts by first token: in the filter, and in the lists."""
    each = filled.select(F.explode(F.arrays_zip("contexts", "mass", "rest")).alias("c"))
    rows = each.groupBy("c.contexts").agg(F.sum("c.mass").alias("mass"), F.sum("c.rest").alias("rest")).toArrow()  # a row per word of the vocabulary
    sums = np.zeros((2, known + 2))
    sums[:, rows.column("contexts").to_numpy()] = [rows.column(c).to_numpy() for c in ("mass", "rest")]
    return sums[0], sums[1]


def bigram_segments(docs: DataFrame, words: list[str], log_bits: int) -> DataFrame:
    """The filter of the bigrams of ``docs`` by segments, with the bigrams that a segment has no room for.

    A segment is built by the task that has all of its counts. ``contexts`` are first tokens, ``mass`` and ``rest`` the sums of the quantised
    counts after them in the filter and in the lists; ``hashes`` and ``levels`` are the lists, of bigrams below the level ``least`` or, as counts
    of one level may part, at it.
    """
    sent = docs.sparkSession.sparkContext.broadcast({w.encode(): i for i, w in enumerate(words)})
    inner = log_bits - SEGMENT_BITS
    room = int((1 << inner) * 0.69 / PROBES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            ids = [_ids(tokens_of(t), known) for t in batch.column(0).to_pylist()]
            if ids:
                hashes, n = np.unique(np.concatenate([_pairs(own, len(known)) for own in ids]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int32))], ["hash", "n"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)])
            held.append(rows)
            whole = held[0] if len(held) == 1 else None
            places = rows[0].view(np.uint64) >> np.uint64(64 - SEGMENT_BITS)
            first = held[0][0, :1].view(np.uint64) >> np.uint64(64 - SEGMENT_BITS)
            if len(places) and (places[-1] != places[0] or first != places[0]):
                whole = np.concatenate(held, axis=1)
                places = whole[0].view(np.uint64) >> np.uint64(64 - SEGMENT_BITS)
                end = np.flatnonzero(places[1:] != places[:-1])[-1] + 1
                yield segments(whole[:, :end])
                held = [whole[:, end:]]
        if held and held[0].shape[1]:
            yield segments(np.concatenate(held, axis=1))

    def segments(rows: np.ndarray) -> pa.RecordBatch:
        columns: list[tuple] = []
        places = rows[0].view(np.uint64) >> np.uint64(64 - SEGMENT_BITS)
        for own in np.split(np.arange(rows.shape[1]), np.flatnonzero(places[1:] != places[:-1]) + 1):
            h, n = rows[0, own].view(np.uint64), rows[1, own]
            least = least_count(n, room)
            keep, levels = n >= least, _levels(n)
            part = np.zeros(1 << inner, bool)
            for level in range(1, int(levels[keep].max(initial=0)) + 1):
                bits = bits_of(_level(h[keep & (levels >= level)], level), log_bits, PROBES)
                part[bits & np.uint64((1 << inner) - 1)] = True
            contexts, place = np.unique((unmixed(h) >> np.uint64(32)).astype(np.int64), return_inverse=True)
            mass, rest = (np.bincount(place, _quantised(levels) * some, len(contexts)).tolist() for some in (keep, ~keep))
            packed = zlib.compress(np.packbits(part, bitorder="little").tobytes(), 1)
            lists = h[~keep].tobytes(), levels[~keep].astype(np.uint8).tobytes()
            columns.append((int(places[own[0]]), packed, contexts.tolist(), mass, rest, int(least).bit_length(), *lists))
        types = (pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*columns), types)], [f.split()[0] for f in schema.split(", ")])

    schema = "segment int, bits binary, contexts array<int>, mass array<double>, rest array<double>, least int, hashes binary, levels binary"
    counted = docs.select("text").mapInArrow(count, "hash bigint, n int")
    summed = (
        counted.withColumn("segment", segment_of("hash"))
        .repartition("segment")
        .groupBy("segment", "hash")
        .agg(F.sum("n").alias("n"))
        .sortWithinPartitions("segment")
        .select("hash", "n")
    )
    return written(summed.mapInArrow(fill, schema), "lm-filter")


def train(docs: DataFrame, size: int = VOCABULARY, log_bits: int = LOG_BITS) -> tuple[Model, DataFrame]:
    """A model of all texts of ``docs``, and their exact counts ``word, n``. Null texts are empty ones."""
    counts = written(word_counts(docs), "lm-words")
    tokens, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    words, n = vocabulary(counts, size)
    filled = bigram_segments(docs, words, log_bits)
    packed, least = _gathered(filled, log_bits)
    lists = filled.filter("least > 1").select("hashes", "levels") if least.max() > 1 else None
    return Model(words, n, tokens or 0, distinct, packed, *_masses(filled, len(words)), least, lists), counts


def _others(model: Model, texts: int) -> int:
    """Tokens of the class of words outside the vocabulary, and one for all unseen words."""
    return max(model.tokens - int(model.counts.sum()) - texts, 0) + 1


def _single(model: Model, texts: int) -> np.ndarray:
    """Probabilities of single tokens: the vocabulary, all other words, the end."""
    counts = np.maximum(np.concatenate([model.counts, [_others(model, texts), texts]]).astype(float), 1)
    return counts / counts.sum()


def _gains(model: Model, texts: int) -> DataFrame:
    """``_word, gain``: the keys of the listed bigrams, and what each adds to the log10 of a probability that was found without it."""
    prior = PRIOR * _single(model, texts)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, levels in zip(batch.column(0), batch.column(1)):
                h = np.frombuffer(hashes.as_buffer(), np.uint64)
                ids = (unmixed(h) & np.uint64(2**32 - 1)).astype(np.int64)
                gain = np.log10(1 + _quantised(np.frombuffer(levels.as_buffer(), np.uint8).astype(np.int64)) / prior[ids])
                yield pa.RecordBatch.from_arrays([_key(h), pa.array(gain)], ["_word", "gain"])

    return model.lists.mapInArrow(spread, "_word binary, gain double")


class Scorer:
    """Log probabilities in a worker."""

    def __init__(self, model: Model, texts: int):
        self.model = model
        self.known = {w.encode(): i for i, w in enumerate(model.words)}
        self.log_bits = int(model.packed.size * 8).bit_length() - 1
        others = max(model.distinct - len(model.words) - (texts > 0), 0)
        rare = _others(model, texts)
        self.single = _single(model, texts)
        # A word outside the vocabulary with count c has the part (c + 1) of this in its class, all unseen words together 1.
        self.share = -np.log10(float(others + rare))

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Levels in the filter: probes level after level, for what is still found. Less than a segment holds is nothing that it holds."""
        levels = np.zeros(len(h), np.int64)
        open_ = np.arange(len(h))
        for level in range(1, 48):
            hit = contains(self.model.packed, bits_of(_level(h[open_], level), self.log_bits, PROBES))
            open_ = open_[hit]
            if not len(open_):
                break
            levels[open_] = level
        levels[levels < self._least(h)] = 0
        return levels

    def _least(self, h: np.ndarray) -> np.ndarray:
        return self.model.least[(h >> np.uint64(64 - SEGMENT_BITS)).astype(np.int64)]

    def count(self, h: np.ndarray) -> np.ndarray:
        """Quantised counts in the filter."""
        return _quantised(self.levels(h))

    def chances(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Probability of each token after the one before, a class of words counting as one, by the bigrams of the filter alone."""
        return (self.count(_hashes(before, ids)) + PRIOR * self.single[ids]) / (self.model.mass[before] + PRIOR)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of each text, given as the ids of its tokens, but for the counts of words outside the vocabulary and of listed bigrams."""
        return self.parts(texts)[0]

    def parts(self, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """These scores, and the bigrams that may be listed: number of the text, hash, times in the text.

        Bigrams are smoothed towards single words.
        """
        ids = np.concatenate(texts)
        sizes = np.array([len(own) for own in texts])
        starts = np.cumsum(sizes) - sizes
        before = np.concatenate([[0], ids[:-1]])
        before[starts] = len(self.known) + 1
        h, prior = _hashes(before, ids), PRIOR * self.single[ids]
        levels = self.levels(h)
        chance = (_quantised(levels) + prior) / (self.model.mass[before] + self.model.rest[before] + PRIOR)
        found = np.add.reduceat(np.log10(chance) + (ids == len(self.known)) * self.share, starts)
        open_ = np.flatnonzero((levels == 0) & (self._least(h) > 1))
        text = np.repeat(np.arange(len(texts)), sizes)[open_]
        order = np.lexsort((h[open_], text))
        open_, text = open_[order], text[order]
        first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (h[open_] != np.roll(h[open_], 1)))
        return found, text[first], h[open_][first], np.diff(first, append=len(open_))


def scores(docs: DataFrame, model: Model, counts: DataFrame, texts: int, held_out: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Words of the vocabulary are looked up where the text is read; all others meet their exact counts in a join, keyed by
    word and so without a hot one, and share the probability of their class by them. What the filter does not have meets the listed bigrams in
    the same join, one row a text. Texts are told apart by two hashes of id and text, 128 bits; repeated rows
    add up and are divided again. Null texts are empty: the end is their only token.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast({"model": (model.words, model.counts, model.tokens, model.distinct, model.packed, model.mass, model.rest, model.least)})
    keyed = docs.select(
        F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text", "doc_id", F.lit(1)).alias("check"), "doc_id", held_out.alias("held_out"), "text"
    )
    schema = (
        "key bigint, check bigint, doc_id bigint, held_out boolean, word binary, pair boolean, times int, base double, known bigint, n_tokens bigint, "
        "score double, copies int"
    )
    names = [f.split()[0] for f in schema.split(", ")]
    whole_numbers, doubles = pa.int64(), pa.float64()
    types = (
        *[whole_numbers] * 3, pa.bool_(), pa.binary(), pa.bool_(), pa.int32(), doubles, whole_numbers, whole_numbers, doubles, pa.int32(),
    )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = sent.value
        if "scorer" not in cell:
            cell["scorer"] = Scorer(Model(*cell["model"]), texts)
        scorer = cell["scorer"]
        logs = np.log10(np.concatenate([scorer.model.counts + 1.0, [1.0, texts + 1.0]]))
        for batch in small(batches):
            rows: list[tuple] = []
            open_: list[tuple] = []
            outside: list[bytes] = []
            times: list[int] = []
            sizes: list[int] = []
            size = 0
            for key, check, doc_id, held, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = tokens_of(text)
                ids = _ids(words, scorer.known)
                rare = ids == len(scorer.known)
                base = float(logs[ids].sum())
                known = int((~rare).sum()) - (not texts)
                open_.append((key, check, doc_id, held, base, known, ids))
                size += len(ids)
                met = Counter(compress(words, rare.tolist()))
                outside += met
                times += met.values()
                sizes.append(len(met))
                if size >= AT_ONCE:
                    yield from whole(open_, scorer, rows)
                    open_, size = [], 0
            yield from whole(open_, scorer, rows)
            if outside:
                yield met_words(batch, outside, times, sizes)
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns, names)

    def met_words(batch: pa.RecordBatch, words: list[bytes], times: list[int], sizes: list[int]) -> pa.RecordBatch:
        key, check = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), sizes) for i in range(2))
        return met(key, check, pa.array(words, pa.binary()), pa.array(times, pa.int32()), False)

    def met(key: np.ndarray, check: np.ndarray, words: pa.Array, times: pa.Array, pair: bool) -> pa.RecordBatch:
        # Rows of words outside the vocabulary, or of bigrams that may be listed: text, word and times only, made column by column.
        given = {"key": pa.array(key), "check": pa.array(check), "word": words, "times": times, "pair": pa.repeat(pa.scalar(pair), len(words))}
        given |= {name: pa.nulls(len(words), t) for name, t in zip(names, types) if name in ("doc_id", "held_out")}
        return pa.RecordBatch.from_arrays([given[n] if n in given else pa.repeat(pa.scalar(0, t), len(words)) for n, t in zip(names, types)], names)

    def whole(texts: list[tuple], scorer: Scorer, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not texts:
            return
        found, text, h, times = scorer.parts([ids for *_, ids in texts])
        if len(h):
            key, check = (np.array([t[i] for t in texts], np.int64)[text] for i in range(2))
            yield met(key, check, _key(h), pa.array(times.astype(np.int32)), True)
        # A line feed is in no word, so these rows meet no count.
        rows += [
            (key, check, doc_id, held, b"\n%d" % key, False, 0, base, known, len(ids), score, 1)
            for (key, check, doc_id, held, base, known, ids), score in zip(texts, found.tolist())
        ]

    parts = keyed.mapInArrow(local, schema)
    known = counts.select(F.col("word").cast("binary").alias("_word"), "n")
    if model.lists is not None:
        known = known.unionByName(_gains(model, texts), allowMissingColumns=True)
    else:
        known = known.withColumn("gain", F.lit(None).cast("double"))
    # Texts were scored as if they had none of the listed bigrams; what is not listed either adds nothing.
    met = parts.join(known, F.col("word") == F.col("_word"), "left").filter("NOT pair OR gain IS NOT NULL")
    n = F.coalesce("n", F.lit(0))
    copies = F.sum("copies")
    outside = F.sum(F.when(F.col("pair"), 0.0).otherwise(F.col("times") * F.log10(n + 1)))
    listed = F.sum(F.when(F.col("pair"), F.col("times") * F.col("gain")).otherwise(0.0))
    total = met.groupBy("key", "check").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        (F.sum("n_tokens") / copies).cast("bigint").alias("n_tokens"),
        ((F.sum("known") + F.sum(F.when(n > 0, F.col("times")).otherwise(0))) / copies).cast("bigint").alias("n_known"),
        ((F.sum("base") + outside) / copies).alias("logs"),
        ((F.sum("score") + outside + listed) / copies).alias("score"),
        copies.cast("int").alias("copies"),
    )
    spread = F.log10(F.lit(float(model.tokens + model.distinct + 1)))
    return total.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * spread).alias("base_score"),
        "score",
    )


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores of all ``docs`` by a model of those that are not ``held_out``."""
    training = docs.filter(~held_out)
    model, counts = train(training)
    ends = counts.filter(F.col("word") == END).select("n").first()
    return scores(docs, model, counts, ends["n"] if ends else 0, held_out)
