"""Secret scan: keyword automaton, anchored patterns near its hits, embedded checksums.

One Aho-Corasick pass over the lower-cased text finds every place at which a secret can begin: the
names of assignments, the prefixes of access keys and tokens, and, for long hexadecimal runs, any
four hexadecimal characters in a row. A pattern is tried only at such a place, anchored there, and
never inside a match that the same kind already has. This gives the leftmost non-overlapping
matches of the whole text, because no match can begin anywhere else.

Tokens that carry a checksum of themselves are reported only if it is right.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: The base patterns. Letters of ``assign`` names count in either case, in ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Tokens of 30 characters and a CRC-32 of them in six base-62 digits.
CHECKED = re.compile(r"(?:ghp_|gho_|ghu_|ghs_|ghr_|npm_)([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "checked")
BASE_KINDS = KINDS[:3]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_SEED = 4

Span = tuple[int, int, int]  # start, kind, end


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ASSIGN_NAMES:
        found.add_word(word, (0, len(word)))
    found.add_word("akia", (1, 4))
    for word in CHECKED_PREFIXES:
        found.add_word(word, (3, len(word)))
    for word in map("".join, product("0123456789abcdef", repeat=HEX_SEED)):
        found.add_word(word, (2, HEX_SEED))
    found.make_automaton()
    return found


def _lowered(text: str) -> str:
    """Lower case with every position unchanged."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def checksum_ok(body: str, check: str) -> bool:
    number = zlib.crc32(body.encode())
    digits = ""
    while number:
        number, digit = divmod(number, 62)
        digits = BASE62[digit] + digits
    return digits.rjust(6, "0") == check


def find_secrets(text: str) -> list[Span]:
    """All spans of a whole text as (start, kind, end), sorted; end is exclusive, positions are code points."""
    spans: list[Span] = []
    upto = [0, 0, 0, 0]
    for last, (kind, width) in _automaton().iter(_lowered(text)):
        start = last + 1 - width
        if start < upto[kind]:  # inside a match; a hexadecimal run's first seed is at its beginning, so later ones are too
            continue
        match = (ASSIGN, ACCESS, HEX, CHECKED)[kind].match(text, start)
        if match is None:
            continue
        upto[kind] = match.end()
        if kind == 0 and len(match[2]) < 8 or kind == 1 and match.end() - start < 16 or kind == 2 and match.end() - start < 32 or kind == 3 and not checksum_ok(match[1], match[2]):
            continue
        spans.append((start, kind, match.end()))
    spans.sort()
    return spans


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, counts by kind, ``base_sha256`` and ``spans``.

    Null and empty texts have no spans. Texts are scanned whole; rows are independent, so repeated
    rows give repeated results and there is no shuffle. An empty table gives an empty result.
    """
    from pyspark.sql import functions as F

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[list[int], ...] = ([], [], [], [])
            digests, all_spans = [], []
            for text in batch.column(1):
                spans = find_secrets(text.as_py() or "")
                base = [s for s in spans if s[1] < len(BASE_KINDS)]
                for kind, column in enumerate(counts):
                    column.append(sum(s[1] == kind for s in spans))
                digests.append(sha256(written(base).encode()).hexdigest())
                all_spans.append(written(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(all_spans, pa.string())],
                [id_col, "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        scan, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string")
