"""Secret scans: keywords find where to look, anchored patterns decide, embedded checksums confirm.

One Aho-Corasick pass over the lower-cased text gives all keyword hits. Only there the pattern of the keyword's kind is tried,
anchored at the hit. Kinds that carry a checksum (access tokens of code hosts and package registries, wallet keys, card numbers) count only
if it is right, and kinds with a structure (signed web tokens, private key blocks) only if they decode to it. Keys of payment and chat
services carry neither and are told by their prefix and length. Runs of hex digits have no keyword; every run long enough covers a character at a multiple of its least length, so only
those characters are looked at.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.llm.arrow import parts, text_list

# Keywords and patterns of the kinds, in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "host_token", "registry_token", "wallet_key", "web_token", "key_block", "card", "payment_key", "chat_token")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "host_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "registry_token": ("npm_",),
    "wallet_key": ("xprv",),
    "web_token": ("eyj",),
    "key_block": ("-----begin ",),
    "card": ("card",),
    "payment_key": ("sk_live_", "rk_live_"),
    "chat_token": ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"),
}
PATTERNS = {
    "assign": re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "host_token": re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "registry_token": re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "wallet_key": re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])"),
    "web_token": re.compile(r"(?<![0-9A-Za-z_-])(eyJ[0-9A-Za-z_-]+)\.(eyJ[0-9A-Za-z_-]+)\.[0-9A-Za-z_-]+"),
    "key_block": re.compile(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----([0-9A-Za-z+/=\s]+)-----END \1-----", re.ASCII),
    "card": re.compile(r"(?i:card)[^0-9\n]{0,20}([0-9](?:[ -]?[0-9]){12,18})(?![0-9])", re.ASCII),
    "payment_key": re.compile(r"[sr]k_live_[0-9A-Za-z]{24,}"),
    "chat_token": re.compile(r"xox[abprs]-[0-9]{8,}-[0-9A-Za-z-]{16,}"),
}
BASE_62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE_58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
LEAST_HEX, LEAST_ACCESS, LEAST_VALUE = 24, 20, 6

_is_hex = np.zeros(256, bool)
_is_hex[list(b"0123456789abcdef")] = True


def crc_token(token: str) -> bool:
    """The last six characters of a 36-character body are the CRC-32 of the thirty before them, in base 62."""
    body = token[4:]
    value = 0
    for c in body[30:]:
        value = value * 62 + BASE_62.index(c)
    return value == zlib.crc32(body[:30].encode())


def base58_key(token: str) -> bool:
    """Base 58 with four check bytes from a double SHA-256."""
    value = 0
    for c in token:
        value = value * 58 + BASE_58.index(c)
    raw = value.to_bytes(max(82, (value.bit_length() + 7) // 8), "big")
    return len(raw) == 82 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def luhn(number: str) -> bool:
    """The last digit of a card number makes the weighted sum of its digits a multiple of ten; a number of one digit only is none."""
    digits = [int(c) for c in reversed(number) if c.isdigit()]
    return len(set(digits)) > 1 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def web_token(header: str, claims: str) -> bool:
    """Header and claims are JSON objects, and the header names its algorithm."""
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))) for part in (header, claims))
    except (binascii.Error, ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and "alg" in head


def key_block(label: str, body: str) -> bool:
    """The body is one DER sequence of exactly the length it states, or the container of its own that a key tool writes."""
    try:
        raw = base64.b64decode("".join(body.split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if label == "OPENSSH PRIVATE KEY":
        return raw.startswith(b"openssh-key-v1\0")
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    more = raw[1] - 0x80 if raw[1] > 0x80 else 0
    size = int.from_bytes(raw[2 : 2 + more], "big") if more else raw[1]
    return size > 0 and len(raw) == 2 + more + size


CHECKS = {
    "assign": lambda m: len(m[1]) >= LEAST_VALUE,
    "access": lambda m: len(m[0]) >= LEAST_ACCESS,
    "host_token": lambda m: crc_token(m[0]),
    "registry_token": lambda m: crc_token(m[0]),
    "wallet_key": lambda m: base58_key(m[0]),
    "web_token": lambda m: web_token(m[1], m[2]),
    "key_block": lambda m: key_block(m[1], m[2]),
    "card": lambda m: luhn(m[1]),
    "payment_key": lambda m: True,
    "chat_token": lambda m: True,
}


def keyword_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def hex_spans(plain: bytes) -> Iterator[tuple[int, int]]:
    """Maximal runs of at least ``LEAST_HEX`` lower-case hex digits."""
    data = np.frombuffer(plain, np.uint8)
    done = 0
    for at in (np.flatnonzero(_is_hex[data[LEAST_HEX - 1 :: LEAST_HEX]]) * LEAST_HEX + LEAST_HEX - 1).tolist():
        if at < done:
            continue
        start = end = at
        while start and _is_hex[plain[start - 1]]:
            start -= 1
        while end < len(plain) and _is_hex[plain[end]]:
            end += 1
        done = end
        if end - start >= LEAST_HEX:
            yield start, end


def scan_text(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Start, end (exclusive, in code points) and kind of all secrets, by start and then by the order of kinds."""
    plain = text.encode("ascii", "replace")  # one byte for each character; no pattern knows other characters
    ascii_text = plain.decode("ascii")
    done = dict.fromkeys(KINDS, 0)
    found = []
    hits = sorted((end + 1 - value[1], value[0]) for end, value in automaton.iter(plain.lower().decode("ascii")))
    for start, kind in hits:
        if start < done[kind]:
            continue
        match = PATTERNS[kind].match(ascii_text, start)
        if match:
            done[kind] = match.end()
            if CHECKS[kind](match):
                found.append((start, match.end(), kind))
    found += [(a, b, "hex") for a, b in hex_spans(plain)]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2])))


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text: ``doc_id`` and ``secrets``, an array of kind, start, end and value by start.

    A null or empty text has none. Null ids and repeated rows are scanned like any other; other columns are not looked at; an
    empty table gives an empty table. Within a kind, matches are the leftmost ones that do not overlap.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = keyword_automaton()
        for batch in parts(batches):
            found = [
                [{"kind": k, "start": a, "end": b, "value": text[a:b]} for a, b, k in scan_text(text, automaton)]
                for text in text_list(batch.column(1))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "secrets"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, secrets array<struct<kind:string,start:long,end:long,value:string>>")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """All columns of ``docs`` with every secret in ``text`` replaced by ``mark``. Overlapping secrets are replaced as one.

    A null or empty text stays as it is, whole long texts are read, repeated rows and null ids are rows like any other, and an empty table
    gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = keyword_automaton()
        for batch in parts(batches):
            at = batch.schema.get_field_index("text")
            out = []
            for text in batch.column(at).to_pylist():
                kept, end = [], 0
                for a, b, _ in scan_text(text or "", automaton):
                    if a >= end:
                        kept += [text[end:a], mark]
                    end = max(end, b)
                out.append(text if not kept else "".join([*kept, text[end:]]))
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def digest_rows(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds and the digests of the spans."""
    found = scan(docs)
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.concat_ws(",", F.transform(base, name)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("secrets", name)).alias("spans"),
    )
