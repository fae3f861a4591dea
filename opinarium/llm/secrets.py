"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Tokens are words between ASCII blanks. The field tags each as begin, inside or outside of a secret from its
shape, its neighbours and features of the file; it is trained on windows of a bounded sample in which
the patterns say what is secret. Decoding is by Viterbi; tokens that cannot be secret whatever their neighbours are
recognised by a bound, so the recursion runs over the short stretches between them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinarium.llm.tables import bounded_sample, rows_with_text, small

# The patterns that always count, and the least length of what they match.
PATTERNS = {
    "assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 12, "access": 18, "hex": 16}
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

KINDS = (*PATTERNS, "model")
TOKEN = re.compile(r"[^ \t-\r]+")
#: Hash buckets of token features; three tags: outside, begin, inside.
BUCKETS, TAGS = 4096, 3
#: Features of a token at most, places of the window around it, file features.
FEATURES, PLACES, FILE = 8, (0, -1, -2, 1), 12
#: Training: documents read, windows kept, tokens on each side of a window's middle.
SAMPLE_DOCS, SAMPLE_WINDOWS, SIDE = 3000, 6000, 5
MEMO = 200_000

_ASSIGN = re.compile(PATTERNS["assign"], re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(PATTERNS["access"])
_HEX = re.compile(r"[0-9a-f]{16,}")  # a longest run of at least 16, which is what the pattern leaves after the drop
_EDGES = "\"'`,;:.()[]{}<>|#*$%&"


def base_matches(text: str) -> list[tuple[str, int, int, int, int]]:
    """``kind, start, end, secret start, secret end`` of the fixed patterns, by start and kind."""
    found = []
    low = text.lower()
    if any(word in low for word in WORDS):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                found.append(("assign", *m.span(), *m.span(2)))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST["access"]:
                found.append(("access", *m.span(), *m.span()))
    found += [("hex", *m.span(), *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def _bucket(text: str) -> int:
    return crc32(text.encode("utf-8", "surrogatepass")) % BUCKETS


def _kind(c: str) -> str:
    """Kind of a character: digit, upper or lower letter, a sign that counts by itself, or another."""
    return "d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else c if c in "=:-_/+.@" else "s"


ASCII_KINDS = {chr(i): _kind(chr(i)) for i in range(128)}


def _shape(token: str) -> str:
    """Kinds of a whole token's characters, runs as one."""
    return "".join(kind for kind, _ in groupby(ASCII_KINDS.get(c) or _kind(c) for c in token))


def token_features(token: str) -> list[int]:
    """Buckets of a token's word or shape; at most FEATURES of them.

    A word of letters counts by itself (the neighbours of secrets are words); any other token by length, mix of characters
    and changes between kinds of them.
    """
    core = token.strip(_EDGES)
    size = min(len(core).bit_length(), 9)
    if core.isalpha() or not core:
        return [_bucket("word:" + core.lower()), _bucket(f"letters:{size}"), _bucket("edge:" + token[-1])]
    n = len(core)
    digits, upper = sum(map(str.isdigit, core)), sum(map(str.isupper, core))
    other = n - digits - upper - sum(map(str.islower, core))
    shape = _shape(core)
    longest = max(len(run) for run in re.split(r"[^0-9A-Za-z]+", core))
    return [
        _bucket(f"mixed:{min(n // 4, 12)}"),
        _bucket(f"digits:{4 * digits // n}:{4 * upper // n}:{4 * other // n}"),
        _bucket(f"shape:{shape[:12]}" if len(shape) < 12 else f"turns:{min(len(shape) // 4, 8)}"),
        _bucket(f"run:{min(longest // 4, 10)}:{digits == n}"),
        _bucket("start:" + core[:4]),
        _bucket(f"varied:{8 * len(set(core)) // n}"),
        _bucket(f"quoted:{token[0] in _EDGES}:{token[-1] in _EDGES}"),
        _bucket("with:" + "".join(sorted({c for c in core if c in "=:@/_-+."}))),
    ]


def file_features(text: str, n_tokens: int) -> list[int]:
    """Numbers below FILE: size, share of lines, share of braces and of signs of code."""
    lines = text.count("\n") + 1
    code = sum(map(text.count, "{};=()"))
    return [
        min(n_tokens.bit_length() // 3, 3),
        4 + min(3, 40 * lines // (n_tokens + 1)),
        8 + min(3, 200 * code // (len(text) + 1)),
    ]


@dataclass
class Field:
    """Weights of the field: by place of the token, bucket and tag; file feature and tag; neighbouring tags."""

    tokens: np.ndarray
    file: np.ndarray
    moves: np.ndarray

    def margin(self) -> float:
        """The most that neighbours can add to a tag other than outside."""
        m = self.moves
        around = m[:, :, None] + m[None, :, :] - m[:, :1, None] - m[None, :1, :]
        return float(around.max())


def _numpy_crf(windows: list[tuple[list[list[int]], list[int], list[int]]], rounds: int = 60) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam over all windows at once."""
    n, width = len(windows), max((len(w[0]) for w in windows), default=1)
    pad = BUCKETS
    buckets = np.full((n, width, FEATURES), pad, np.int64)
    tags, real = np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    files = np.zeros((n, FILE))
    for i, (tokens, labels, file) in enumerate(windows):
        for j, features in enumerate(tokens):
            buckets[i, j, : len(features)] = features
        tags[i, : len(labels)], real[i, : len(labels)] = labels, True
        files[i, file] = 1
    around = np.full((len(PLACES), n, width, FEATURES), pad, np.int64)
    for k, place in enumerate(PLACES):
        if place >= 0:
            around[k, :, : width - place] = buckets[:, place:]
        else:
            around[k, :, -place:] = buckets[:, :place]
    weights = [np.zeros((len(PLACES), BUCKETS + 1, TAGS)), np.zeros((FILE, TAGS)), np.zeros((TAGS, TAGS))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    eye = np.eye(TAGS)
    gold = eye[tags] * real[..., None]
    both = real[:, 1:] & real[:, :-1]
    gold_moves = np.einsum("nta,ntb,nt->ab", eye[tags[:, :-1]], eye[tags[:, 1:]], both)
    for step in range(1, rounds + 1):
        score = sum(weights[0][k][around[k]].sum(axis=2) for k in range(len(PLACES))) + (files @ weights[1])[:, None]
        moves = np.exp(weights[2])
        emit = np.exp(np.clip(score, -30, 30)) * real[..., None] + (~real)[..., None] * np.array([1.0, 0, 0])
        ahead, back = np.zeros((n, width, TAGS)), np.ones((n, width, TAGS))
        ahead[:, 0] = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
        for t in range(1, width):
            x = (ahead[:, t - 1] @ moves) * emit[:, t]
            ahead[:, t] = x / x.sum(1, keepdims=True)
        for t in range(width - 2, -1, -1):
            x = (back[:, t + 1] * emit[:, t + 1]) @ moves.T
            back[:, t] = x / x.sum(1, keepdims=True)
        marginal = ahead * back
        marginal /= marginal.sum(2, keepdims=True)
        pair = ahead[:, :-1, :, None] * moves * (emit[:, 1:] * back[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        wrong = marginal * real[..., None] - gold
        grads = [np.zeros_like(weights[0]), files.T @ wrong.sum(1), (pair * both[..., None, None]).sum((0, 1)) - gold_moves]
        for k in range(len(PLACES)):
            for tag in range(TAGS):
                share = np.repeat(wrong[..., tag, None], FEATURES, axis=2).ravel()
                grads[0][k, :, tag] = np.bincount(around[k].ravel(), share, BUCKETS + 1)
        grads[0][:, pad] = 0
        for w, g, a, b in zip(weights, grads, first, second):
            g += 0.1 * w
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Field(*(w.astype(np.float32) for w in weights))


def _labels(spans: list[tuple[int, int]], secret: list[tuple[int, int]]) -> list[int]:
    """Tags of tokens: those that share characters with a secret are begin, or inside if the one before has the same."""
    tags, at, last = [], 0, None
    for start, end in spans:
        while at < len(secret) and secret[at][1] <= start:
            at += 1
        hit = at if at < len(secret) and secret[at][0] < end else None
        tags.append(0 if hit is None else 2 if hit == last else 1)
        last = hit
    return tags


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _windows(text: str) -> Iterator[tuple[list[list[int]], list[int], list[int], int]]:
    """Windows around secrets, around other tokens that are no plain words, and a few around plain ones."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    tags = _labels(spans, _joined([(f[3], f[4]) for f in base_matches(text)]))
    file = file_features(text, len(spans))
    for i, (start, end) in enumerate(spans):
        token = text[start:end]
        order = crc32(f"{i}:{token}".encode("utf-8", "surrogatepass"))
        plain = token.strip(_EDGES).isalpha()
        if tags[i] or order % (50 if plain else 2) == 0:
            low, high = max(0, i - SIDE), min(len(spans), i + SIDE + 1)
            window = [token_features(text[a:b]) for a, b in spans[low:high]]
            yield window, tags[low:high], file, (0 if tags[i] else 1 if not plain else 2) * 2**32 + order


def train_field(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS) -> Field:
    """A field trained on at most ``windows`` windows of at most ``sample_docs`` documents.

    A third of the windows each are for secrets, for tokens that are no words, and for words, chosen by a hash. Without
    any document the field has no weights and tags nothing.
    """
    sample = bounded_sample(docs.select("doc_id", "text"), "doc_id", sample_docs)
    schema = "tokens array<array<int>>, tags array<int>, file array<int>, place bigint"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each: list[list] = [[], [], []]
        for batch in small(batches):
            for text in batch.column(1).to_pylist():
                for window in _windows(text or ""):
                    each[window[3] >> 32].append(window)
                for k in range(3):
                    if len(each[k]) > windows:
                        each[k] = sorted(each[k], key=lambda w: (w[3], w[0]))[: windows // 3]
        rows = [w for kind in each for w in sorted(kind, key=lambda w: (w[3], w[0]))[: windows // 3]]
        columns = zip(*rows) if rows else ((), (), (), ())
        types = (pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)], ["tokens", "tags", "file", "place"]
        )

    cuts = sample.mapInArrow(cut, schema).withColumn("kind", F.shiftright("place", 32)).persist()
    rows = []
    for kind in range(3):
        best = cuts.filter(F.col("kind") == kind).orderBy("place", "tokens", "tags", "file").limit(windows // 3)
        rows += [(r.tokens, r.tags, r.file) for r in best.collect()]
    cuts.unpersist()
    return _numpy_crf(rows)


class Tagger:
    """Spans of the field in whole texts; what tokens contribute is remembered by token."""

    def __init__(self, field: Field):
        self.field = field
        self.margin = field.margin()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(PLACES), TAGS), np.float32)

    def _learn(self, token: str) -> int:
        at = len(self.known)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = self.field.tokens[:, token_features(token)].sum(axis=1)
        self.known[token] = at
        return at

    def _viterbi(self, emit: np.ndarray) -> list[int]:
        """Best tags of a stretch with outside on both sides."""
        moves = self.field.moves
        best, back = emit[0] + moves[0], []
        for row in emit[1:]:
            paths = best[:, None] + moves
            back.append(paths.argmax(0))
            best = paths.max(0) + row
        tag = int((best + moves[:, 0]).argmax())
        tags = [tag]
        for step in reversed(back):
            tag = int(step[tag])
            tags.append(tag)
        return tags[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        if len(self.known) > MEMO:
            self._forget()
        known = self.known.get
        ids = np.array([i if (i := known(t)) is not None else self._learn(t) for t in tokens])
        table = self.table[ids]
        emit = table[:, 0] + self.field.file[file_features(text, len(tokens))].sum(axis=0)
        emit[1:] += table[:-1, 1]
        emit[2:] += table[:-2, 2]
        emit[:-1] += table[1:, 3]
        open_ = np.flatnonzero(emit[:, 1:].max(axis=1) - emit[:, 0] + self.margin > 0)
        if not len(open_):
            return []
        found: list[tuple[int, int]] = []
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            last = 0
            for i, tag in zip(run.tolist(), self._viterbi(emit[run[0] : run[-1] + 1])):
                if tag == 2 and last:
                    found[-1] = (found[-1][0], i)
                elif tag:
                    found.append((i, i))
                last = tag
        if not found:
            return []
        places = [m.span() for m in TOKEN.finditer(text)]
        return [self._trimmed(text, places[a][0], places[b][1]) for a, b in found]

    @staticmethod
    def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
        piece = text[start:end]
        left, right = len(piece) - len(piece.lstrip(_EDGES)), len(piece.rstrip(_EDGES))
        return (start + left, start + right) if left < right else (start, end)


def all_spans(text: str, tagger: Tagger) -> list[tuple[str, int, int]]:
    """Base spans, and spans of the field that no base span contains, by start and kind."""
    base = [f[:3] for f in base_matches(text)]
    added = [
        ("model", a, b) for a, b in tagger.spans(text) if not any(s <= a and b <= e for _, s, e in base)
    ]
    return sorted(base + added, key=lambda f: (f[1], KINDS.index(f[0])))


def _shared(docs: DataFrame, field: Field) -> Callable[[], Tagger]:
    """A worker's tagger, from broadcast weights of a fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast({"weights": (field.tokens, field.file, field.moves)})

    def tagger() -> Tagger:
        cell = sent.value
        if "tagger" not in cell:
            cell["tagger"] = Tagger(Field(*cell["weights"]))
        return cell["tagger"]

    return tagger


def secret_spans(docs: DataFrame, field: Field, carried: Column) -> DataFrame:
    """``_row, spans``: a struct carried along with each row, and its text's ``kind, start, end`` in code points.

    Null and empty texts have no spans.
    """
    tagger = _shared(docs, field)
    source, text_of = rows_with_text(docs, carried)
    schema = source.select(
        "_row", F.expr("cast(null as array<struct<kind:string,start:bigint,end:bigint>>)").alias("spans")
    ).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tagger()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in small(batches):
            rows = [
                [dict(zip(("kind", "start", "end"), span)) for span in all_spans(text or "", own)]
                for text in text_of(batch).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["_row", "spans"])

    return source.mapInArrow(scan, schema)


def redact(text: str | None, tagger: Tagger, mark: str) -> str | None:
    if text is None:
        return None
    for start, end in reversed(_joined([(start, end) for _, start, end in all_spans(text, tagger)])):
        text = text[:start] + mark + text[end:]
    return text


def redacted(docs: DataFrame, field: Field, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``, and ``n_chars`` counted anew. No row goes."""
    tagger = _shared(docs, field)
    others = [c for c in docs.columns if c != "text"]
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col("text").alias("_text"))

    def blank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tagger()
        for batch in small(batches):
            texts = [redact(text, own, mark) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_row", "_text"])

    clean = source.mapInArrow(blank, source.schema)
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("bigint")}
    return clean.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
