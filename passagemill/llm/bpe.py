"""Byte-level BPE by longest matches and backtracking.

The bytes of a piece are read as Latin-1 characters, so an automaton of all
tokens works on text. Encoding takes the longest token at each place; where it
cannot stand beside the token before it, the next shorter one is tried, and
where none can, the token before is taken back. Two tokens are compatible when
merging their joined bytes gives just these two; that is remembered per pair.
Places already found to lead nowhere are marked, so the work is linear in the
length of a piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import text_of
from passagemill.llm.tokenizing import PartCache


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of base64 tokens."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(piece: str, ranks: dict[str, int]) -> list[str]:
    """Plain merging of a short piece: the pair of lowest rank first, leftmost among equals."""
    parts = list(piece)
    while len(parts) > 1:
        best, at = None, 0
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class BytePairs:
    """Encoder and decoder for one rank file and one pattern."""

    def __init__(self, rank_file: str, pattern: str, pairs: int = 1_000_000, pieces: int = 600_000):
        import ahocorasick
        import regex

        ranks = read_ranks(rank_file)
        self.bytes_of = {str(rank): token for token, rank in ranks.items()}
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.longest = ahocorasick.Automaton()
        for token in self.ranks:
            self.longest.add_word(token, len(token))
        self.cut = regex.compile(pattern).findall
        self.width = max(map(len, self.ranks))
        self.shorter: dict[str, str] = {}
        self.compatible: dict[tuple[str, str], bool] = {}
        self.pairs, self.limit = pairs, pieces
        self.pieces: dict[str, str] = {}
        self.parts = PartCache(self.part, pieces // 2)

    def next_shorter(self, token: str) -> str:
        """The longest token that begins ``token`` and is shorter, or nothing."""
        found = self.shorter.get(token)
        if found is None:
            found = self.shorter[token] = token[: self.longest.longest_prefix(token[:-1])] if len(token) > 1 else ""
            while found and found not in self.ranks:
                found = found[:-1]
        return found

    def token_at(self, piece: str, at: int) -> str:
        """The longest token at a place; the automaton gives the longest beginning of any token."""
        window = piece[at : at + self.width]
        token = window[: self.longest.longest_prefix(window)]
        while token not in self.ranks:
            token = token[:-1]
        return token

    def fit(self, left: str, right: str) -> bool:
        pair = (left, right)
        found = self.compatible.get(pair)
        if found is None:
            if len(self.compatible) >= self.pairs:
                self.compatible.clear()
            whole = [left, right] if left else [right]
            found = self.compatible[pair] = merged(left + right, self.ranks) == whole
        return found

    def backtrack(self, piece: str) -> list[str]:
        """Tokens of a piece of Latin-1 characters."""
        if piece in self.ranks:
            return [piece]
        size, tokens, at = len(piece), [], 0
        dead: set[int] = set()
        token = self.token_at(piece, 0)
        while at < size:
            end = at + len(token)
            if end not in dead and (self.fit(tokens[-1], token) if tokens else self.stands(token)):
                tokens.append(token)
                at = end
                token = self.token_at(piece, at) if at < size else ""
                continue
            token = self.next_shorter(token)
            while not token:
                dead.add(at)
                token = tokens.pop()
                at -= len(token)
                token = self.next_shorter(token)
        return tokens

    def stands(self, token: str) -> bool:
        """Whether merging a token's bytes gives the token."""
        return self.fit("", token)

    def piece(self, piece: str) -> str:
        """Decimal ids of a piece, joined by blanks."""
        found = self.pieces.get(piece)
        if found is None:
            found = " ".join([str(self.ranks[t]) for t in self.backtrack(piece.encode().decode("latin-1"))])
            if len(piece) < 200:
                if len(self.pieces) >= self.limit:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def part(self, part: str) -> str:
        return " ".join(map(self.piece, self.cut(part)))

    def encode(self, text: str) -> str:
        """Decimal ids of a whole text, joined by blanks."""
        return " ".join(self.parts.of_text(text))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


_coders: dict[tuple[str, str], BytePairs] = {}


def coder(rank_file: str, pattern: str) -> BytePairs:
    """One coder per worker, rank file and pattern."""
    key = (rank_file, pattern)
    if key not in _coders:
        _coders[key] = BytePairs(rank_file, pattern)
    return _coders[key]


def encode_column(text, rank_file: str, pattern: str):
    """The decimal ids of a text column, joined by blanks; a null text counts as empty.

    Texts are encoded whole, whatever their length. No special tokens are
    made: their strings are ordinary text.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = coder(rank_file, pattern).encode
        for texts in batches:
            yield texts.map(encode)

    return run(text_of(text))


def decode_column(ids, rank_file: str, pattern: str):
    """The bytes of a column of decimal ids."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = coder(rank_file, pattern).decode
        for each in batches:
            yield each.map(decode)

    return run(ids)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of ids, digest of the ids and of the bytes they decode to.

    One pass without a shuffle. Null and empty texts have no ids; an empty
    table gives an empty table; ids of rows may be null or repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(rank_file, pattern)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            columns = [
                batch.column(0),
                pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64()),
                pa.array([digest(x.encode()) for x in ids]),
                pa.array([digest(own.decode(x)) for x in ids]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema)
