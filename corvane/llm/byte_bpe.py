"""Byte-level BPE encoding and decoding by prefix dynamic programming.

An encoding is the one that merging by rank gives exactly if each two neighbours in it are left alone by merging: merging
the bytes of the two gives back the two, which undoing their last merges one by one tells.  Hence for every prefix of a piece's bytes there is exactly one token that can
end its encoding.  :class:`PrefixEncoder` stores that last token for each prefix.  Reading it backwards gives the tokens
of any prefix; appending bytes extends the table and changes nothing before it; after an edit only the prefixes from the
edit on are computed anew, and only until they agree again with what was stored.

Texts are split by the tokenizer's pattern and each match is encoded separately.  Of some texts at a time the distinct
pieces are taken, and those whose encoding isn't at hand go through the table together, all prefixes of one length in one
step.  Encodings of short pieces are kept in a bounded table, as words recur; when it is full the half that was not used
of late goes.

Defined results: a null text counts as empty and has no ids; decoding gives the exact bytes; ids outside the vocabulary
raise KeyError; repeated rows are encoded alike; other columns of the input are carried along, and those whose names
clash with added ones are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .words import Table

#: Distinct pieces whose ids a worker keeps (half of them from before, half recent), and the longest of them in characters.
KEPT_PIECES, KEPT_LENGTH = 400_000, 32
PAIRS = 250_000
#: Pieces of more bytes are encoded one by one, others many at a time; a long text is read so many pieces at a time.
MANY, TAKEN = 256, 200_000


class Vocabulary:
    """Tokens' bytes and ranks, and which two tokens may stand next to each other.

    ``left`` and ``right`` of a token are the two that merging joins last to make it.  Two tokens may stand next to each
    other if, as their merges are undone from the last to the first, nothing that meets at the border would have been
    merged before.  That takes two parts' ranks to lie below that of what they make (``ordered``); otherwise the bytes of
    both are merged.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: A trie of tokens read from their last byte: edges by node and byte, and the token that ends in a node.
        self.edges: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in reversed(token):
                key = node << 8 | byte
                if (after := self.edges.get(key)) is None:
                    after = self.edges[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = after
            self.token_at[node] = rank
        self.left, self.right, self.joined = {}, {}, {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._alone: dict[int, bool] = {}
        self.ordered = True
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self._alone[rank] = True
                continue
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i], rank), ranks.get(token[i:], rank)
                if left < rank and right < rank and self._alone[left] and self._alone[right] and self._stand(left, right):
                    self.left[rank], self.right[rank], self.joined[left, right], self._alone[rank] = left, right, rank, True
                    break
            else:
                self._alone[rank] = False
                self.ordered &= self.merged(token) != [rank]
        if not self.ordered:
            self._alone = {rank: self.merged(token) == [rank] for token, rank in ranks.items()}
        self._arrays: tuple | None = None

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))})

    def merged(self, data: bytes) -> list[int]:
        """Ids by merging the neighbours of lowest rank, leftmost first, until none can be merged.  For short data."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            options = [(rank, i) for i in range(len(parts) - 1) if (rank := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not options:
                break
            _, i = min(options)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def alone(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        return self._alone[token]

    def _stand(self, left: int, right: int) -> bool:
        limit = 1 << 40  # the rank of the merge undone last, one more where it lies to the right: of equals the leftmost goes first
        while self.joined.get((left, right), limit) >= limit:
            one, two = left if left in self.left else -1, right if right in self.left else -1
            if one < 0 and two < 0:
                return True
            if one > two:
                limit, left = left, self.right[left]
            else:
                limit, right = right + 1, self.left[right]
        return False

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives both."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            if self.ordered:
                known = self._alone[left] and self._alone[right] and self._stand(left, right)
            else:
                known = self.merged(self.bytes[left] + self.bytes[right]) == [left, right]
            self.pairs[left, right] = known
        return known

    def arrays(self) -> tuple:
        """(edges, tokens by node, joined pairs, left, right, lengths) as arrays; tokens that merging never makes have no node."""
        if self._arrays is None:
            size = max(self.bytes, default=0) + 1
            left, right, length = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.zeros(size, np.int64)
            for out, known in ((left, self.left), (right, self.right)):
                out[np.fromiter(known.keys(), np.int64, len(known))] = np.fromiter(known.values(), np.int64, len(known))
            length[np.fromiter(self.bytes.keys(), np.int64, len(self.bytes))] = np.fromiter(map(len, self.bytes.values()), np.int64, len(self.bytes))
            at = np.asarray([t if t >= 0 and self._alone[t] else -1 for t in self.token_at], np.int64)
            joined = {a << 32 | b: t for (a, b), t in self.joined.items()}
            self._arrays = Table.of(self.edges), at, Table.of(joined), left, right, length
        return self._arrays

    def stand(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """neighbours() of many pairs of tokens that stand alone."""
        _, _, joined, lefts, rights, _ = self.arrays()
        ok = np.ones(len(left), bool)
        live, limit = np.arange(len(left)), np.full(len(left), 1 << 40)
        while len(live):
            made = joined.get(left << 32 | right)
            clash = (made >= 0) & (made < limit)
            ok[live[clash]] = False
            one, two = np.where(lefts[left] >= 0, left, -1), np.where(lefts[right] >= 0, right, -1)
            on = ~clash & ((one >= 0) | (two >= 0))
            live, left, right, one, two = live[on], left[on], right[on], one[on], two[on]
            undo = one > two
            limit = np.where(undo, left, right + 1)
            left, right = np.where(undo, rights[left], left), np.where(undo, right, lefts[right])
        return ok

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of short pieces, as PrefixEncoder gives them, packed: the last tokens of all prefixes of one length at a time."""
        if not self.ordered:
            return [np.asarray(PrefixEncoder(self, p).ids(), "<u4").tobytes() for p in pieces]
        edges, token_at, _, _, _, length = self.arrays()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")
        sizes, n = sizes[order], len(pieces)
        high = int(sizes[0]) if n else 0
        if not high:
            return [b""] * n
        # byte t of piece i stands at t * n + i
        starts = np.concatenate([[0], np.cumsum(sizes)])
        data, step = np.frombuffer(b"".join([pieces[i] for i in order]), np.uint8), np.arange(starts[-1])
        piece = np.repeat(np.arange(n), sizes)
        spots = (step - starts[piece]) * n + piece
        grid = np.zeros(high * n, np.uint8)
        grid[spots] = data
        # tokens that end at each byte, the longest first
        live, node, back, found = spots, np.zeros(len(spots), np.int64), 0, []
        while len(live):
            node = edges.get(node << 8 | grid[live - back])
            there = node >= 0
            live, node = live[there], node[there].astype(np.int64)
            token = token_at[node]
            ends = token >= 0
            found.append((live[ends], token[ends]))
            back += n
            inside = live >= back
            live, node = live[inside], node[inside]
        spot, token = (np.concatenate([f[k] for f in reversed(found)]) for k in (0, 1))
        by = np.argsort(spot, kind="stable")
        token = token[by]
        first = np.zeros(high * n + 1, np.int64)
        np.cumsum(np.bincount(spot, minlength=high * n), out=first[1:])
        last = np.full(high * n, -1, np.int64)
        active = np.searchsorted(-sizes, -np.arange(high), "left")  # pieces of more than t bytes
        for t in range(high):
            todo = np.arange(t * n, t * n + active[t])
            at = first[todo]
            while len(todo):
                if (at >= first[todo + 1]).any():
                    raise ValueError("no token ends with a byte")
                now = token[at]
                before = todo - length[now] * n
                held = np.flatnonzero(before >= 0)
                stands = np.ones(len(todo), bool)
                stands[held] = self.stand(last[before[held]], now[held])
                last[todo[stands]] = now[stands]
                todo, at = todo[~stands], at[~stands] + 1
        # backwards from the last byte of each piece
        at, whose, parts = (sizes - 1) * n + np.arange(n), np.arange(n), []
        some = sizes > 0
        at, whose = at[some], whose[some]
        while len(at):
            now = last[at]
            parts.append((whose, now))
            at = at - length[now] * n
            on = at >= 0
            at, whose = at[on], whose[on]
        whose, ids = (np.concatenate([p[k] for p in reversed(parts)]) for k in (0, 1))
        by = np.argsort(order[whose], kind="stable")
        packed = ids[by].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(order[whose], minlength=n)) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class PrefixEncoder:
    """The encoding of a growing and changing run of bytes: ``last[i]`` is the only token that can end the first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), []
        self.append(data)

    def append(self, data: bytes) -> PrefixEncoder:
        v, whole, last = self.vocabulary, self.data, self.last
        edge, token_at, known, end = v.edges.get, v.token_at, v.pairs.get, len(self.data)
        whole += data
        for end in range(end + 1, len(whole) + 1):
            node, start = 0, end
            while start:
                start -= 1
                node = edge(node << 8 | whole[start])
                if node is None:
                    raise ValueError(f"no token ends with byte {end - 1}")
                token = token_at[node]
                if token < 0:
                    continue
                if start:
                    pair = (last[start - 1], token)
                    stands = known(pair)
                    if stands if stands is not None else v.neighbours(*pair):
                        break
                elif v.alone(token):
                    break
            else:
                raise ValueError(f"no token ends with byte {end - 1}")
            last.append(token)
        return self

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put data in place of bytes start to stop.  Returns how many prefixes had to be computed."""
        tail, old = bytes(self.data[stop:]), self.last[stop:]
        del self.data[start:], self.last[start:]
        self.append(data)
        need, done, agreed = self.vocabulary.longest, len(data), 0
        for i in range(len(tail)):
            # a token reaches back at most as far as the longest: after as many agreeing prefixes the rest agrees too
            if agreed >= need:
                self.data.extend(tail[i:])
                self.last.extend(old[i:])
                break
            self.append(tail[i : i + 1])
            agreed = agreed + 1 if self.last[-1] == old[i] else 0
            done += 1
        return done

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes, by default all."""
        end, out = len(self.data) if end is None else end, []
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.vocabulary.bytes[token])
        return out[::-1]


class Tokenizer:
    """Whole texts to ids and back."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self._recent: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> list[str]:
        """See that the ids of all pieces are at hand.  Returns those that are too long to be kept."""
        if len(self._recent) > KEPT_PIECES // 2:
            self._recent, self._before = {}, self._recent
        recent, before, ranks = self._recent, self._before, self.vocabulary.ranks
        few, many, long = [], [], []
        for piece in pieces.difference(recent):
            if (ids := before.get(piece)) is not None:
                recent[piece] = ids
                continue
            data = piece.encode("utf-8")
            if (whole := ranks.get(data)) is not None:
                recent[piece] = whole.to_bytes(4, "little")
            elif len(data) > MANY:
                recent[piece] = np.asarray(PrefixEncoder(self.vocabulary, data).ids(), "<u4").tobytes()
            else:
                few.append(piece)
                many.append(data)
            if len(piece) > KEPT_LENGTH:
                long.append(piece)
        if many:
            recent.update(zip(few, self.vocabulary.encode_many(many), strict=True))
        return long

    def _forget(self, long: list[str]) -> None:
        for piece in long:
            self._recent.pop(piece, None)

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, some texts at a time."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            if text and len(text) > TAKEN:
                yield from self._packed(held)
                held, size = [], 0
                found, parts = self.pattern.finditer(text), []
                while some := [m[0] for m in islice(found, TAKEN)]:
                    parts += self._packed([some])
                yield b"".join(parts)
                continue
            held.append(self.pattern.findall(text) if text else [])
            size += len(held[-1])
            if size >= TAKEN:
                yield from self._packed(held)
                held, size = [], 0
        yield from self._packed(held)

    def _packed(self, texts: list[list[str]]) -> list[bytes]:
        long = self._learn(set().union(*texts))
        ids = self._recent.__getitem__
        out = [b"".join(map(ids, pieces)) for pieces in texts]
        self._forget(long)
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(next(self.encode_many([text])), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))

    def decode_packed(self, packed: bytes) -> bytes:
        return self.decode(np.frombuffer(packed, "<u4").tolist())


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One to a worker process; path is a file that every machine has, as part of an installed package."""
    return Tokenizer(Vocabulary.read(path), pattern)


def _lists(packed: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of its texts, as array<int>."""

    @F.arrow_udf("array<int>")
    def encoded(column: pa.Array) -> pa.Array:
        t = tokenizer(path, pattern)
        return _lists(list(t.encode_many(x.as_py() for x in column)))

    return df.withColumn(ids, encoded(F.col(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """df with the bytes of its ids, as binary."""

    @F.arrow_udf("binary")
    def decoded(column: pa.Array) -> pa.Array:
        t = tokenizer(path, pattern)
        return pa.array([t.decode(x or ()) for x in column.to_pylist()], pa.binary())

    return df.withColumn(data, decoded(F.col(ids)))


def digests(df: DataFrame, path: str, pattern: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256 (and ids): encoding and decoding in one pass."""
    fields = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if with_ids else {})

    @F.arrow_udf(", ".join(f"{k} {v}" for k, v in fields.items()))
    def digested(column: pa.Array) -> pa.Array:
        t, counts, ids, data, all_packed = tokenizer(path, pattern), [], [], [], []
        for packed in t.encode_many(x.as_py() for x in column):
            counts.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            data.append(hashlib.sha256(t.decode_packed(packed)).hexdigest())
            if with_ids:
                all_packed.append(packed)
        out = [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())]
        return pa.StructArray.from_arrays(out + ([_lists(all_packed)] if with_ids else []), list(fields))

    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in fields]
    out = df.select(*kept, digested(F.col(text)).alias("__digest"))
    return out.select(*kept, *(F.col(f"__digest.{n}").alias(n) for n in fields))
