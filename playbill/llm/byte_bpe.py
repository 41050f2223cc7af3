"""Byte-level BPE encoding and decoding in linear time.

Tokens of a piece are found from the left as longest matches of an Aho-Corasick automaton over Latin-1 characters, one for each
byte. A token may follow another only if the merges would not have joined bytes across their border; the answer for a pair of
tokens is remembered. Where no token fits, the last one is taken back and its next shorter prefix is tried, and a position that
led nowhere is never tried again. A sequence whose neighbours all fit is unique and is what the merges give.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.llm.arrow import hex_digest, parts, worker_cache

#: a vocabulary file travels to the workers as a broadcast; larger ones are refused
MAX_FILE = 64 << 20
#: remembered pieces and pairs of a worker; when they are full, the pieces used since the last time stay
MAX_PIECES, MAX_PAIRS = 1 << 17, 1 << 18

# Characters that are letters or numbers in the Unicode version of the ``regex`` library only. The tokenizer library
# knows an older version, where they are neither.
NEWER_LETTERS = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb"
    "\\U00011df1\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff3\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda"
    "\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168"
    "\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de"
    "\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff"
    "\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
NEWER_NUMBERS = "\\U00011de0-\\U00011de9\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ff4-\\U00016ff6"
_NEWER = regex.compile(f"[{NEWER_LETTERS}{NEWER_NUMBERS}]")


def has_newer(text: str) -> bool:
    """Whether a text holds newer letters or numbers. Only its different characters are looked at, which are few in most texts."""
    return not text.isascii() and _NEWER.search("".join(set(text))) is not None


def _older_classes(pattern: str) -> str:
    """The pattern without the newer letters and numbers in its classes."""
    sets = {r"\p{L}": rf"[\p{{L}}--[{NEWER_LETTERS}]]", r"\p{N}": rf"[\p{{N}}--[{NEWER_NUMBERS}]]"}
    negated = r"[^\s\p{L}\p{N}]"
    parts = pattern.split(negated)
    for name, value in sets.items():
        parts = [p.replace(name, value) for p in parts]
    other = rf"(?:(?![{sets[chr(92) + 'p{L}']}{sets[chr(92) + 'p{N}']}\s])(?s:.))"
    return "(?V1)" + other.join(parts)


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def read_ranks(content: bytes) -> list[bytes]:
    """Tokens of a rank file by their rank, which is their id. Ranks are 0, 1, 2 ... and cover all single bytes."""
    ranks = {}
    for line in content.splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    tokens = [ranks[i] for i in range(len(ranks))]
    if len(set(tokens)) != len(tokens) or not {bytes([i]) for i in range(256)} <= set(tokens):
        raise ValueError("a rank file needs distinct tokens and every single byte")
    return tokens


class BytePairs:
    """Encoder and decoder for one vocabulary and one pattern of pieces."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.size = [len(t) for t in tokens]
        self.find = regex.compile(pattern).findall
        self.find_older = regex.compile(_older_classes(pattern)).findall
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.shorter = [-1] * len(tokens)
        self.automaton = ahocorasick.Automaton()
        reachable = set()
        for i, token in enumerate(tokens):
            parts = self._merge(token, i)
            if len(token) > 1 and parts is None:
                continue  # never made by merges: only a piece that is this token as a whole has it
            if len(token) > 1:
                self.left[i], self.right[i] = parts
                if max(parts) >= i:
                    raise ValueError("a token ranks before its parts")
            reachable.add(token)
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        for i, token in enumerate(tokens):
            for n in range(len(token) - 1, 0, -1):
                if token[:n] in reachable:
                    self.shorter[i] = self.rank[token[:n]]
                    break
        self.pairs: dict[int, bool] = {}
        self.pieces = _Pieces(self)

    def _merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two parts whose merge makes ``token``, if merges make it."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((self.rank.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None

    def _fits(self, first: int, second: int) -> bool:
        """Whether the merges leave a border between these neighbours.

        Both are taken apart from the border outwards, latest merge first. At each step the parts that met at the border would
        have merged before the parts' own next merge if their joint rank is lower.
        """
        left, right, rank, tokens = self.left, self.right, self.rank, self.tokens
        limit = len(tokens)
        while True:
            joint = rank.get(tokens[first] + tokens[second])
            if joint is not None and joint < limit:
                return False
            if first > second:
                limit, first = first, right[first]
                if first == limit:
                    limit, second = second + 1, left[second]
                    if second + 1 == limit:
                        return True
            else:
                limit, second = second + 1, left[second]
                if second + 1 == limit:
                    limit, first = first, right[first]
                    if first == limit:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        size, shorter, pairs = self.size, self.shorter, self.pairs
        longest = [0] * len(piece)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # later ends are longer
        dead = bytearray(len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + size[token]
            fits = not dead[end]
            if fits and out:
                key = out[-1] << 32 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= MAX_PAIRS:
                        pairs.clear()
                    fits = pairs[key] = self._fits(out[-1], token)
            if fits:
                out.append(token)
                if end == len(piece):
                    return out
                at, token = end, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if len(self.pieces) >= MAX_PIECES:
            self.pieces = _Pieces(self, dict(self.pieces))
        find = self.find_older if has_newer(text) else self.find
        return b"".join(map(self.pieces.__getitem__, find(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()


class _Pieces(dict):
    """Encoded pieces. Those of the generation before are taken over when they are used again."""

    def __init__(self, pairs: BytePairs, before: dict[str, bytes] | None = None):
        super().__init__()
        self.pairs, self.before = pairs, before or {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = _pack(self.pairs.encode_piece(piece.encode("utf-8", "replace")))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def _load(content: bytes, pattern: str) -> BytePairs:
    """The encoder of a vocabulary, which a worker builds once."""
    held, key = worker_cache(), (hex_digest(content), pattern)
    if held.get("byte_bpe_key") != key:
        held["byte_bpe"], held["byte_bpe_key"] = BytePairs(read_ranks(content), pattern), key
    return held["byte_bpe"]


def _shipped(docs: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as file:
        content = file.read(MAX_FILE + 1)
    if len(content) > MAX_FILE:
        raise ValueError("the vocabulary file is too large to broadcast")
    return docs.sparkSession.sparkContext.broadcast(content)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token ids of every whole text: ``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit integers) and ``n_tokens``.

    A null text is empty and an empty text has no tokens; null ids and repeated rows are encoded like any other row; other columns
    are not looked at; an empty table gives an empty table. Very long pieces take time and memory in proportion to their length.
    """
    shipped = _shipped(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _load(shipped.value, pattern)
        for part in parts(batches):
            ids = [pairs.encode_bytes((t or b"").decode("utf-8", "replace")) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"]
            )

    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    return plain.mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """Bytes of every id sequence: ``doc_id``, ``ids``, ``n_tokens`` and ``decoded`` (binary). Null ids are empty."""
    shipped = _shipped(tokens, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = read_ranks(shipped.value).__getitem__
        for part in parts(batches):
            found = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], ["doc_id", "ids", "n_tokens", "decoded"])

    return tokens.select("doc_id", "ids", "n_tokens").mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded binary")
