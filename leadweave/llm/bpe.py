"""BPE encoding and decoding with a tokenizer file, merged in batched numpy rounds.

The file is a ``tokenizers`` JSON of a BPE model with word ends: text is NFC-normalised and
lower-cased, cut into letters, single digits and other marks, and each piece becomes byte symbols,
the last of which carries the word end. Pieces are merged many at a time: the symbols of all pieces
of a batch lie in one flat array; in each round every piece merges its lowest-ranked pair, which is
looked up by binary search in the sorted keys of all mergeable pairs.

Each distinct piece of a batch is encoded once and kept in a bounded table.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: White space as the tokenizer's patterns see it.
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NO_RANK = np.int64(1) << 40
MAX_PIECES = 400_000
#: Pieces that are encoded and looked up together.
SLICE = 100_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class BpeTokenizer:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        vocab = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        self.shown = [(str(i), self.tokens.get(i, "")) for i in range(max(self.tokens) + 1)]
        shown = byte_characters()
        self.first_ids = np.array([vocab[c] for c in shown], np.int64)
        self.last_ids = np.array([vocab[c + end] for c in shown], np.int64)
        self.width = np.int64(max(self.tokens) + 1)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"].replace("\\s", WHITE))
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.kept: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.kept.clear()
        self.sizes: list[int] = []
        self.id_texts: list[str] = []
        self.token_texts: list[str] = []

    def merge(self, pieces: list[bytes]) -> tuple[list[int], list[int]]:
        """The ids of all pieces in one list and where each piece ends in it; one merge a piece and round."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.first_ids[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last_ids[raw[ends]]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        done_symbols, done_owner = [], []
        while len(symbols):
            pair = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
            rank = np.full(len(symbols), NO_RANK, np.int64)
            rank[:-1][known] = self.ranks[at[known]]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            # The leftmost of a piece's lowest pairs merges; equal pairs further right follow in later rounds.
            hit = np.flatnonzero((rank == lowest) & (rank < NO_RANK))
            hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]] if len(hit) else hit
            finished = lowest == NO_RANK
            if finished.any():
                done_symbols.append(symbols[finished])
                done_owner.append(owner[finished])
            symbols[hit] = self.made[at[hit]]
            keep = ~finished
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order].tolist(), np.cumsum(np.bincount(owner, minlength=len(pieces))).tolist()

    def cut(self, text: str) -> list[str]:
        """The pieces of a text without special tokens. A sigma is lowered without regard to its place."""
        clean = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pieces.findall(clean.lower())

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that aren't in the table yet, together. The table is emptied when it grows too large."""
        new = [p for p in pieces if p not in self.kept]
        if len(self.kept) + len(new) > MAX_PIECES:
            self._clear()
            new = list(pieces)
        if not new:
            return
        ids, ends = self.merge([p.encode() for p in new])
        shown = [self.shown[i] for i in ids]
        numbers, names = [a for a, _ in shown], [b for _, b in shown]
        begin = 0
        for piece, end in zip(new, ends, strict=True):
            self.kept[piece] = len(self.sizes)
            self.sizes.append(end - begin)
            self.id_texts.append(" ".join(numbers[begin:end]))
            self.token_texts.append(" ".join(names[begin:end]))
            begin = end

    def segments(self, text: str) -> list[str]:
        """The text cut at special tokens, which stand alone."""
        if self.specials is None or "<|" not in text:
            return [text]
        return [s for s in regex.split(f"({self.specials.pattern})", text) if s]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for segment in self.segments(text):
            if segment in self.special:
                out.append(self.special[segment])
                continue
            found = self.cut(segment)
            for begin in range(0, len(found), SLICE):
                part = found[begin : begin + SLICE]
                self.learn(set(part))
                for piece in part:
                    out += map(int, self.id_texts[self.kept[piece]].split())
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, special ones included, as a tokenizer without a decoder does; unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def digest_rows(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of ids, SHA-256 of the ids and of the decoded text; new pieces of all texts are merged together."""
        found: list[tuple[int, list[str]]] = []  # text number, pieces or a special token
        for number, text in enumerate(texts):
            for segment in self.segments(text):
                pieces = [segment] if segment in self.special else self.cut(segment)
                found += [(number, pieces[begin : begin + SLICE]) for begin in range(0, len(pieces), SLICE)]
        counts, id_parts, token_parts = [0] * len(texts), [[] for _ in texts], [[] for _ in texts]
        while found:
            room, batch = SLICE, []
            while found and (not batch or len(found[0][1]) <= room):
                batch.append(found.pop(0))
                room -= len(batch[-1][1])
            self.learn({p for _, pieces in batch for p in pieces if p not in self.special})
            for number, pieces in batch:
                if pieces[0] in self.special:
                    counts[number] += 1
                    id_parts[number].append(str(self.special[pieces[0]]))
                    token_parts[number].append(pieces[0])
                    continue
                at = list(map(self.kept.__getitem__, pieces))
                counts[number] += sum(map(self.sizes.__getitem__, at))
                id_parts[number] += map(self.id_texts.__getitem__, at)
                token_parts[number] += map(self.token_texts.__getitem__, at)
        digest = lambda parts: sha256(" ".join(parts).encode()).hexdigest()
        return [(n, digest(i), digest(t)) for n, i, t in zip(counts, id_parts, token_parts, strict=True)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> BpeTokenizer:
    return BpeTokenizer(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``ids`` (list of int), ``decoded``. Null and empty texts give no ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):  # ids take more room than text
                part = batch.slice(begin, 200)
                ids = [coder.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(coder.decode, ids)), pa.string())], [id_col, "ids", "decoded"])

    return _mapped(docs, id_col, text_col, run, "ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Digests are taken over the decimal ids joined by one space and over the decoded text. Null
    texts count as empty. Rows are independent and stay where they are; repeated rows repeat their
    result; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            rows = []
            for begin in range(0, batch.num_rows, 64):
                rows += coder.digest_rows([t.as_py() or "" for t in batch.column(1)[begin : begin + 64]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs, id_col, text_col, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, id_col: str, text_col: str, run, columns: str) -> DataFrame:
    from pyspark.sql import functions as F

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {columns}")
