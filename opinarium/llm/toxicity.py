"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

The kernel counts common subsequences of four letters that lie within six, a skipped letter costing a factor; inserted
signs are passed over and runs of single letters are read as one word, so spaced and padded insults still match. Labels are those
of whole texts: fragments (words with their borders) that labelled toxic sentences have and clean ones lack are the positive
examples, frequent and random fragments of clean ones the negative. A decision is linear in kernel values with
the landmarks, hence linear in subsequences, and is read from one table of weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinarium.llm.tables import bounded_sample, rows_with_text, small

#: Kernel: letters of a subsequence, letters it may span, factor of a skipped letter, hash bits of a subsequence.
LETTERS, SPAN, SKIP, BITS = 4, 6, 0.6, 20
#: Sample: labelled texts of each label, fragments of each kind, landmarks.
SAMPLE_TEXTS, FRAGMENTS, LANDMARKS = 4000, 3000, 300
#: Words longer than this are read in parts that overlap by half, so that what is no longer than the overlap stands whole in one.
LONGEST, STRIDE = 40, 20
CLASSES = 64
#: Strengths beyond which the link counts fragments.
LEVELS = (0.3, 0.6, 0.85)
LINKS = 3 + 2 * len(LEVELS)
#: Characters scored at once.
CHUNK = 1 << 18

OFFSETS = [(0, *inner) for inner in combinations(range(1, SPAN), LETTERS - 1)]


def _class_table() -> np.ndarray:
    """Letter classes by code point below 128: 0 ends a word, -1 is passed over; look-alike digits and signs are letters."""
    table = np.full(128, -1, np.int8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = i + 1
    for sign, letter in zip("013457@$!", "oieastasi"):
        table[ord(sign)] = ord(letter) - ord("a") + 1
    table[[ord(c) for c in "2689"]] = 27
    return table


ASCII_CLASS = _class_table()
_RNG = np.random.default_rng(7)
SALT = _RNG.integers(0, 2**32, (LETTERS, CLASSES), dtype=np.uint32)


def letters_of(text: str) -> np.ndarray:
    """Classes of a text's letters with 0 before, between and after words; single letters in a row form one word."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = 28 + (points % 35)
    kinds = np.where(points < 128, ASCII_CLASS[np.minimum(points, 127)], wide.astype(np.int8))
    kinds = kinds[kinds >= 0]
    if not len(kinds):
        return np.zeros(1, np.int8)
    kinds = np.concatenate([[0], kinds, [0]]).astype(np.int8)
    kinds = kinds[np.concatenate([[True], (kinds[1:] != 0) | (kinds[:-1] != 0)])]
    ends = np.flatnonzero(kinds == 0)
    single = np.diff(ends) == 2
    joined = ends[1:-1][single[:-1] & single[1:]]
    return np.delete(kinds, joined)


def subsequences(kinds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Places where a subsequence may start, its hash there, and its weight, for every set of offsets."""
    n = len(kinds)
    ends = np.flatnonzero(kinds == 0)
    limit = ends[np.minimum(np.searchsorted(ends, np.arange(n), "right"), len(ends) - 1)] - np.arange(n)
    salted = [SALT[i][kinds] for i in range(LETTERS)]
    for offsets in OFFSETS:
        last = offsets[-1]
        if n <= last:
            continue
        places = np.flatnonzero(limit[: n - last] >= last)
        mixed = salted[0][places]
        for i, offset in enumerate(offsets[1:], 1):
            mixed = mixed + salted[i][places + offset]
        mixed *= np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA6B)
        yield places, mixed >> np.uint32(32 - BITS), SKIP ** (last - LETTERS + 1)


def fragments_of(text: str) -> set[str]:
    """Distinct fragments as strings of letter classes."""
    kinds = letters_of(text)
    return set("".join(map(chr, _parted(kinds) + 64)).split("@")) - {""}


@dataclass
class Machine:
    """Weights of subsequences, bias, and the weights that turn a text's strongest fragments into a probability."""

    table: np.ndarray
    bias: float
    link: np.ndarray

    def strengths(self, text: str) -> np.ndarray:
        """Decision values of all fragments of a text."""
        kinds = _parted(letters_of(text))
        out = []
        at = 0
        while at < len(kinds) - 1:
            # A chunk begins and ends at a border; no part is as long as a chunk, so there is one.
            stop = min(len(kinds), at + CHUNK)
            stop = at + 2 + int(np.flatnonzero(kinds[at + 1 : stop] == 0)[-1])
            out.append(self.of_classes(kinds[at:stop]))
            at = stop - 1
        return np.concatenate(out) if out else np.full(1, self.bias)

    def fragment(self, fragment: str) -> float:
        hashes, weights = fragment_features(fragment)
        return float(weights @ self.table[hashes] + self.bias)

    def of_classes(self, kinds: np.ndarray) -> np.ndarray:
        """Decision values of the words between borders."""
        sums = np.zeros(len(kinds), np.float32)
        for places, hashes, weight in subsequences(kinds):
            sums[places] += weight * self.table[hashes]
        starts = np.flatnonzero(kinds[:-1] == 0)
        if not len(starts):
            return np.full(1, self.bias)
        sizes = np.diff(np.append(starts, len(kinds) - 1)) + 1
        return np.add.reduceat(sums[:-1], starts) / np.sqrt(sizes) + self.bias

    def summary(self, text: str) -> np.ndarray:
        """What the link looks at: the strongest fragments, and how many are beyond some strengths."""
        values = self.strengths(text)
        top = np.full(2, -1.0)
        best = np.sort(np.partition(values, -min(2, len(values)))[-2:])[::-1]
        top[: len(best)] = best
        beyond = [(values > level).sum() for level in LEVELS]
        return np.array([1.0, *np.clip(top, -1, 1.2), *np.log1p(beyond), *np.sqrt(np.array(beyond) / len(values))])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.summary(text) @ self.link, -30, 30))))


def _parted(kinds: np.ndarray) -> np.ndarray:
    """Words longer than LONGEST as overlapping parts, each a word of its own."""
    ends = np.flatnonzero(kinds == 0)
    sizes = np.diff(ends) - 1
    if not len(sizes) or sizes.max() <= LONGEST:
        return kinds
    parts = np.maximum(0, -((LONGEST - sizes) // STRIDE)) + 1
    word = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = ends[word] + 1 + nth * STRIDE
    length = np.minimum(LONGEST, ends[word + 1] - start)
    first = np.cumsum(length + 1) - length
    inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out = np.zeros(first[-1] + length[-1] + 1, np.int8)
    out[np.repeat(first, length) + inner] = kinds[np.repeat(start, length) + inner]
    return out


def _matrix(features: list[tuple[np.ndarray, np.ndarray]], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column among ``known`` hashes and weight of the features that are known."""
    rows = np.repeat(np.arange(len(features)), [len(h) for h, _ in features])
    hashes = np.concatenate([h for h, _ in features]) if features else np.zeros(0, np.uint32)
    weights = np.concatenate([w for _, w in features]) if features else np.zeros(0)
    columns = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    keep = known[columns] == hashes if len(known) else np.zeros(len(hashes), bool)
    return rows[keep], columns[keep], weights[keep]


def _kernel(features: list, landmarks: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Kernel of each fragment with each landmark (``landmarks``: known hashes by landmark)."""
    out = np.zeros((len(features), landmarks.shape[1]))
    for at in range(0, len(features), 200):
        rows, columns, weights = _matrix(features[at : at + 200], known)
        np.add.at(out, rows + at, landmarks[columns] * weights[:, None])
    return out


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps on the examples inside the margin."""
    w = np.zeros(x.shape[1])
    scale = penalty * np.eye(x.shape[1])
    scale[-1, -1] = 1e-3  # the bias
    for _ in range(25):
        inside = y * (x @ w) < 1
        a = x[inside] * cost[inside, None]
        new = np.linalg.solve(scale + a.T @ x[inside], a.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _closed() -> np.ndarray:
    """A link that calls nothing toxic."""
    return np.r_[-3.0, np.zeros(LINKS - 1)]


def fit_fragments(positive: list[tuple[str, float]], negative: list[tuple[str, float]], landmarks: int = LANDMARKS) -> Machine:
    """A machine from weighted fragments; without examples of both kinds it calls nothing toxic."""
    table = np.zeros(1 << BITS, np.float32)
    if not positive or not negative:
        return Machine(table, -1.0, _closed())
    examples = [f for f, _ in positive + negative]
    features = [fragment_features(f) for f in examples]
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    cost = np.array([w for _, w in positive + negative])
    cost[y > 0] *= 0.5 / cost[y > 0].sum() * len(y)
    cost[y < 0] *= 0.5 / cost[y < 0].sum() * len(y)
    half = landmarks // 2
    chosen = [*range(min(half, len(positive))), *range(len(positive), len(positive) + min(half, len(negative)))]
    known = np.unique(np.concatenate([features[i][0] for i in chosen]))
    dense = np.zeros((len(known), len(chosen)))
    rows, columns, weights = _matrix([features[i] for i in chosen], known)
    np.add.at(dense, (columns, rows), weights)
    among = dense.T @ dense
    values, vectors = np.linalg.eigh(among + 1e-6 * np.eye(len(chosen)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    mapped = _kernel(features, dense, known) @ root
    w = _squared_hinge(np.c_[mapped, np.ones(len(mapped))], y, cost)
    table[known] = dense @ (root @ w[:-1])
    return Machine(table, float(w[-1]), _closed())


def fragment_features(fragment: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of a fragment's subsequences, scaled by the root of its letters."""
    kinds = np.array([0, *[ord(c) - 64 for c in fragment], 0], np.int8)
    parts = [(h, np.full(len(h), w)) for _, h, w in subsequences(kinds)]
    if not parts:
        return np.zeros(0, np.uint32), np.zeros(0)
    hashes, weights = (np.concatenate(x) for x in zip(*parts))
    return hashes, weights / np.sqrt(len(kinds))


def fit_link(summaries: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic weights over summaries, by Newton steps with a small quadratic penalty."""
    w = np.zeros(summaries.shape[1])
    if len(set(toxic.tolist())) < 2:
        w[0] = 5.0 if len(toxic) and toxic[0] else -5.0
        return w
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(summaries @ w, -30, 30)))
        gradient = summaries.T @ (p - toxic) + 0.1 * w
        hessian = (summaries * (p * (1 - p))[:, None]).T @ summaries + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _strongest(fragments: DataFrame, machine: Machine, n: int) -> list[str]:
    """The ``n`` fragments with the largest decision values."""
    shared = fragments.sparkSession.sparkContext.broadcast((machine.table, machine.bias, machine.link))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Machine(*shared.value)
        for batch in batches:
            line = "@" + "@".join(batch.column(0).to_pylist()) + "@"
            values = fitted.of_classes(np.array([ord(c) - 64 for c in line], np.int8))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["fragment", "value"])

    scored = fragments.mapInArrow(score, "fragment string, value double")
    return [r["fragment"] for r in scored.orderBy(F.desc("value"), "fragment").limit(n).collect()]


def train_machine(docs: DataFrame, labels: DataFrame, texts: int = SAMPLE_TEXTS) -> Machine:
    """A machine from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``).

    At most ``texts`` labelled texts of each label are read, chosen by a hash of their id; of these, at most FRAGMENTS fragments
    that speak for toxic texts, and as many frequent and random ones of clean texts. Ids or labels that are null
    are left out; labels that contradict each other count twice. Without fragments that speak for toxic texts nothing is called toxic.
    """
    known = labels.select("doc_id", "toxic").dropna().distinct()
    chosen = [bounded_sample(known.filter(F.col("toxic") == t), "doc_id", texts) for t in (1, 0)]
    # At most 2 * texts labels: a bounded side.
    marked = chosen[0].unionByName(chosen[1]).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sample = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("toxic", "text").persist()

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sorted(fragments_of(text or ""))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], ["fragment", "toxic"]
                )

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    counts = (
        sample.mapInArrow(distinct, "fragment string, toxic int")
        .filter(F.length("fragment") >= 2)
        .groupBy("fragment")
        .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
        .persist()
    )
    n_bad, n_good = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    # Shares of toxic and clean texts that have the fragment: its pull, and how sure it is.
    pull = F.log((F.col("bad") / n_bad) / ((F.col("good") + 0.5) / n_good))
    weighted = counts.withColumn("sure", F.col("bad") * pull)
    positive = weighted.filter("bad >= 2").filter(pull > 1.5).orderBy(F.desc("sure"), "fragment").limit(FRAGMENTS)
    frequent = weighted.filter(pull < 0).orderBy(F.desc("good"), "fragment").limit(FRAGMENTS // 2)
    random = weighted.filter("bad = 0").orderBy(F.xxhash64("fragment"), "fragment").limit(FRAGMENTS // 2)
    bad = [(r["fragment"], r["sure"]) for r in positive.collect()]
    good = [(r["fragment"], 1.0) for part in (frequent, random) for r in part.collect()]
    # Once more with the fragments of clean texts that the first machine finds worst, and without what it doubts.
    machine = fit_fragments(bad, good)
    worst = _strongest(counts.filter("bad = 0").select("fragment"), machine, FRAGMENTS)
    bad = [(f, sure) for f, sure in bad if machine.fragment(f) > 0]
    machine = fit_fragments(bad, [*dict(good + [(f, 1.0) for f in worst]).items()])
    counts.unpersist()
    shared = docs.sparkSession.sparkContext.broadcast((machine.table, machine.bias, machine.link))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Machine(*shared.value)
        for batch in small(batches):
            rows = [fitted.summary(text or "").tolist() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "summary"])

    rows = sample.mapInArrow(summarise, "toxic int, summary array<double>").collect()
    sample.unpersist()
    if rows and machine.table.any():  # what has learned nothing calls nothing toxic
        machine.link = fit_link(np.array([r["summary"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    return machine


def toxicity(docs: DataFrame, machine: Machine, carried: Column) -> DataFrame:
    """``_row, score``: a struct carried along with each row, and the probability that its text is toxic.

    Null and empty texts are scored like a text without fragments. The weights, of a fixed size, are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((machine.table, machine.bias, machine.link))
    source, text_of = rows_with_text(docs, carried)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Machine(*shared.value)
        for batch in small(batches):
            scores = [fitted.score(text or "") for text in text_of(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["_row", "score"])

    return source.mapInArrow(score, source.select("_row", F.lit(0.0).alias("score")).schema)


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The whole rows of ``docs`` whose text scores below ``threshold``."""
    return toxicity(docs, machine, F.struct("*")).filter(F.col("score") < threshold).select("_row.*")
