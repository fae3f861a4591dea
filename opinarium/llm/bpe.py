"""Byte-level BPE by longest matches and backtracking.

A token sequence is what the merges produce exactly if every two neighbours are compatible, that is, if
merging their bytes leaves the border between them. So a piece is cut at longest matches and
neighbours are tested; only where a test fails, shorter tokens are tried, and a dead position is never
entered twice. Bytes stand as Latin-1 characters, so that the automaton can work on strings.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from opinarium.llm.tables import arrow_rows, small

#: Entries of each memo in a worker; a full memo is emptied.
MEMO = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: one base64 token and its rank per line."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Codec:
    """Encoder and decoder for one table of ranks; ``pattern`` cuts a text into pieces first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.whole = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.digits_of = {rank: str(rank) for rank in self.bytes_of}
        self.pattern = regex.compile(pattern)
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        for rank in sorted(self.bytes_of):
            self._learn_halves(rank)
        self.fits.clear()
        self.automaton = ahocorasick.Automaton()
        for rank in self.halves:
            token = self.bytes_of[rank].decode("latin-1")
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.size_of = {rank: len(token) for rank, token in self.bytes_of.items()}
        self.shorter = {rank: self._prefix(rank) for rank in self.halves}

    def _learn_halves(self, rank: int) -> None:
        """The last merge that makes a token; one that no merge reaches stays out of the automaton."""
        token = self.bytes_of[rank].decode("latin-1")
        if len(token) == 1:
            self.halves[rank] = (rank, rank)
            return
        for cut in range(1, len(token)):
            left, right = self.whole.get(token[:cut]), self.whole.get(token[cut:])
            if left in self.halves and right in self.halves and self._compatible(left, right):
                self.halves[rank] = (left, right)
                self.joined[left, right] = rank
                return

    def _prefix(self, rank: int) -> int | None:
        """The longest token that is a proper prefix of a token."""
        token = self.bytes_of[rank].decode("latin-1")
        shorter = (self.whole.get(token[:end]) for end in range(len(token) - 1, 0, -1))
        return next((other for other in shorter if other in self.halves), None)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging keeps a border between two tokens.

        The merges that made either token are undone at the border, the latest first; the border is lost if the two
        parts facing each other then could merge earlier than the merge just undone.
        """
        limit = 1 << 62
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            outer_left, outer_right = len(self.bytes_of[left]) > 1, len(self.bytes_of[right]) > 1
            if not outer_left and not outer_right:
                return True
            # A later merge has a larger rank; of equal ones the left one was made first.
            if outer_left and (not outer_right or left > right):
                limit, left = left, self.halves[left][1]
            else:
                limit, right = right + 1, self.halves[right][0]

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            known = self.fits[pair] = self._compatible(left, right)
        return known

    def _longest(self, text: str, place: int) -> int:
        for _, rank in self.automaton.iter_long(text, place):
            return rank

    def _merged(self, text: str) -> tuple[int, ...]:
        """Longest tokens first, shorter ones where neighbours do not fit."""
        size, shorter, known = self.size_of, self.shorter, self.fits.get
        greedy = [rank for _, rank in self.automaton.iter_long(text)]
        good = 1
        for pair in zip(greedy, greedy[1:]):
            fits = known(pair)
            if not (self.compatible(*pair) if fits is None else fits):
                break
            good += 1
        else:
            return tuple(greedy)
        tokens, rank = greedy[:good], greedy[good]
        place = sum(map(size.__getitem__, tokens))
        dead: set[int] = set()
        while True:
            end = place + size[rank]
            fits = end not in dead
            if fits and tokens:
                fits = known((tokens[-1], rank))
                if fits is None:
                    fits = self.compatible(tokens[-1], rank)
            if fits:
                tokens.append(rank)
                if end == len(text):
                    return tuple(tokens)
                place, rank = end, self._longest(text, end)
                continue
            rank = shorter[rank]
            while rank is None:
                dead.add(place)
                last = tokens.pop()
                place -= size[last]
                rank = shorter[last]

    def _piece(self, piece: str) -> tuple[int, ...]:
        text = piece.encode().decode("latin-1")
        rank = self.whole.get(text)
        return self._merged(text) if rank is None else (rank,)

    def _learn(self, chunk: str) -> tuple[int, ...]:
        """Tokens of a part of a text that no piece leaves, remembered."""
        pieces = self.pattern.findall(chunk)
        if len(pieces) == 1:
            tokens = self._piece(chunk)
        else:
            known = self.chunks.get
            tokens = tuple(chain.from_iterable([known(p) or self._learn(p) for p in pieces]))
        if len(self.chunks) >= MEMO:
            self.chunks.clear()
        self.chunks[chunk] = tokens
        return tokens

    def encode(self, text: str) -> list[int]:
        """Token ids of a text.

        No piece runs across a space that stands between two visible characters, so the parts between such
        spaces are cut into pieces once and remembered. Other texts are cut as a whole.
        """
        if UNEVEN.search(text):
            chunks = self.pattern.findall(text)
        else:
            first, *rest = text.split(" ")
            chunks = [first, *[" " + part for part in rest]] if text else []
        known = self.chunks.get
        return list(chain.from_iterable([known(c) or self._learn(c) for c in chunks]))

    def decode(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, tokens))


#: A space next to other white space or at an end.
UNEVEN = re.compile(r"^ | $| \s|\s ")


def _codec(shared: dict) -> Codec:
    """The codec of a broadcast table, built once in each worker."""
    if "codec" not in shared:
        shared["codec"] = Codec(shared["ranks"], shared["pattern"])
    return shared["codec"]


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every text, in the rows' own order; null text has no ids.

    The table of ranks, some 50,000 entries whatever the data, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"ranks": ranks, "pattern": pattern})
    schema = "doc_id bigint, ids array<int>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in small(batches):
            ids = [codec.encode(text or "") for _, text in arrow_rows(batch, "doc_id", "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``doc_id, ids, bytes binary``: the bytes that the ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.__getitem__
        for batch in small(batches):
            out = [b"".join(map(table, ids)) for (ids,) in arrow_rows(batch, "ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, ids array<int>, bytes binary")


def token_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text encoded, its ids decoded again.

    Ids and bytes of one text at a time are held, and only their digests leave the worker. Null text is an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"ranks": ranks, "pattern": pattern})

    def digest(text: str | None, codec: Codec) -> tuple[int, str, str]:
        ids = codec.encode(text or "")
        line = " ".join(map(codec.digits_of.__getitem__, ids))
        return len(ids), sha256(line.encode()).hexdigest(), sha256(codec.decode(ids)).hexdigest()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in small(batches):
            rows = [digest(text, codec) for _, text in arrow_rows(batch, "doc_id", "text")]
            counts, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        digests, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
