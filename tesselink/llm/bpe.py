"""Exact byte-level BPE by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over all tokens gives, in one pass over a piece of text, the longest token at each
position.  The encoder goes forward with the longest match; a token is accepted if it is compatible with the one
before it, which means that the merges would leave the two side by side.  Otherwise the next shorter token that
starts there is tried, and when there is none the encoder steps back and never returns to that position.  A token
sequence whose neighbours are all compatible is the one that the merges give.  Each position is left once, so
the time is linear in the piece, however long it is.

Whether two tokens are compatible is looked up in a table that is filled as pairs occur: a pair is incompatible if
some merge over its seam comes before the merges that built both its sides.  Pieces recur, so their ids are kept in
a table of bounded size.

Decoding copies the tokens' bytes from one buffer by an offset table; invalid UTF-8 becomes U+FFFD.

Defined cases: null text is the empty text, without ids; the special token's string in a text is that token; texts of
any length are encoded whole; repeated rows are encoded alike; ids are not looked at and may be null; an empty table
gives an empty result; further columns pass through, whatever their names, except those added.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import others

#: The splitting pattern of byte-level BPE (fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces in each of the two generations of the table of known pieces.
KEPT = 1 << 17
_STEP = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones for themselves, then U+0100 onwards."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def latin_pieces() -> re.Pattern:
    """The splitting pattern for texts up to U+00FF, its classes spelt out, for the faster matcher."""
    chars = [chr(k) for k in range(256)]
    letter, number = ("".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == kind) for kind in "LN")
    blank = "".join(re.escape(c) for c in chars if regex.match(r"\s", c))
    spelt = PIECES.replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
    return re.compile(spelt.replace(r"\s", f"[{blank}]").replace(r"\S", f"[^{blank}]"))


class Codec:
    def __init__(self, path: str, kept: int = KEPT):
        self.kept = kept
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in token): k for token, k in spec["model"]["vocab"].items() if all(c in letters for c in token)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {k: b for b, k in vocab.items()} | {k: s.encode() for s, k in special.items()}
        self.token = [by_id.get(k, b"") for k in range(max(by_id) + 1)]
        self.special = {s: k for s, k in special.items()}
        self._special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self._pieces, self._latin = regex.compile(PIECES), latin_pieces()
        # merges: rank and result of each pair, and how each token was made
        self._merge, self._made = {}, {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = (bytes(letters[c] for c in x) for x in (a, b))
            left, right, out = vocab[a], vocab[b], vocab[a + b]
            self._merge[left, right] = rank, out
            self._made.setdefault(out, (rank, left, right))
        self._auto = ahocorasick.Automaton()
        self._single = [0] * 256
        for b, k in vocab.items():
            if len(b) == 1:
                self._single[b[0]] = k
            else:
                self._auto.add_word(b.decode("latin-1"), (k, len(b) - 1))
        self._auto.make_automaton()
        self._vocab = vocab
        self._shorter: dict[int, int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        self._size = [len(t) for t in self.token]
        self._offset = np.concatenate([[0], np.cumsum(np.array(self._size, np.int64))])
        self._bytes = np.frombuffer(b"".join(self.token), np.uint8)

    def _next_shorter(self, k: int) -> int:
        """The longest token that is a proper beginning of this one, or -1."""
        if (found := self._shorter.get(k)) is None:
            b = self.token[k]
            found = next((self._vocab[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self._vocab), -1)
            self._shorter[k] = found
        return found

    def _seam(self, k: int, right: bool) -> list[tuple[int, int]]:
        """The tokens at one end of a token while it is built, newest last: (rank of the merge that makes it, token)."""
        out = []
        while True:
            rank, a, b = self._made.get(k, (-1, -1, -1))
            out.append((rank, k))
            if a < 0:
                return out[::-1]
            k = b if right else a

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of the joined bytes leave a and b as they are.

        At a time t the end of a is the newest token on its right spine that is made before t, likewise the
        start of b.  The pair is broken if a merge of two such ends has a rank before the later growth of either.
        """
        if (found := self._fits.get((a, b))) is None:
            ends, starts = self._seam(a, True), self._seam(b, False)
            i = j = 0
            found = True
            while found:
                grow_a = ends[i + 1][0] if i + 1 < len(ends) else 1 << 60
                grow_b = starts[j + 1][0] if j + 1 < len(starts) else 1 << 60
                rank = self._merge.get((ends[i][1], starts[j][1]), (1 << 60,))[0]
                # Equal ranks: the leftmost place merges first, which is inside a, then the seam, then inside b.
                if rank < grow_a and rank <= grow_b and rank < 1 << 60:
                    found = False
                elif grow_a == grow_b == 1 << 60:
                    break
                elif grow_a <= grow_b:
                    i += 1
                else:
                    j += 1
            if len(self._fits) >= 2 * self.kept:
                self._fits.clear()
            self._fits[a, b] = found
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of the bytes of one piece."""
        if (whole := self._vocab.get(data)) is not None and self._own(whole):
            return [whole]
        n, size, fits, shorter = len(data), self._size, self._fits, self._shorter
        longest = [self._single[b] for b in data]
        if n > 1 and len(self._auto):
            for end, (k, back) in self._auto.iter(data.decode("latin-1")):  # ends ascend: the last match of a start is the longest
                longest[end - back] = k
        open_ = bytearray(b"\x01") * (n + 1)  # positions not yet found to be dead ends
        ids, at, last, k = [], 0, -1, longest[0] if n else -1
        while at < n:
            end = at + size[k]
            if open_[end]:
                fit = True if last < 0 else fits.get((last, k))
                if self.compatible(last, k) if fit is None else fit:
                    ids.append(k)
                    last, at = k, end
                    if at < n:
                        k = longest[at]
                    continue
            k = shorter[k] if k in shorter else self._next_shorter(k)
            while k < 0:
                open_[at] = 0
                k = ids.pop()
                last = ids[-1] if ids else -1
                at -= size[k]
                k = self._next_shorter(k)
        return ids

    @lru_cache(maxsize=1 << 17)
    def _own(self, k: int) -> bool:
        """Whether the merges make the token from its own bytes."""
        if k not in self._made:
            return len(self.token[k]) == 1
        _, a, b = self._made[k]
        return self._own(a) and self._own(b) and self._joins(k, a, b)

    def _joins(self, k: int, a: int, b: int) -> bool:
        data = [self._single[x] for x in self.token[k]]
        while len(data) > 1:
            best = min(range(len(data) - 1), key=lambda i: self._merge.get((data[i], data[i + 1]), (1 << 60, -1))[0])
            if (found := self._merge.get((data[best], data[best + 1]))) is None:
                return False
            data[best : best + 2] = [found[1]]
        return data[0] == k

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece by the table; when a generation is full, pieces that come again move on to the next."""
        if (ids := self._known.get(piece)) is None:
            ids = self._older.get(piece)
            if ids is None:
                ids = tuple(self.encode_piece(piece.encode("utf-8", "surrogatepass")))
            if len(piece) <= 64:
                if len(self._known) >= self.kept:
                    self._older, self._known = self._known, {}
                self._known[piece] = ids
        return ids

    def _plain(self, text: str, out: list[int]) -> None:
        known, piece, add = self._known, self._piece, out.extend
        try:
            text.encode("latin-1")
            found = self._latin.findall(text)
        except UnicodeEncodeError:
            found = self._pieces.findall(text)
        for m in found:
            add(known.get(m) or piece(m))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            at = 0
            for m in self._special.finditer(text) if self._special else ():
                self._plain(text[at : m.start()], out)
                out.append(self.special[m[0]])
                at = m.end()
            self._plain(text[at:] if at else text, out)
        return out

    def decode(self, ids) -> str:
        parts = []
        ids = np.asarray(ids, np.int64)
        for at in range(0, len(ids), _STEP):
            part = ids[at : at + _STEP]
            start, size = self._offset[part], self._offset[part + 1] - self._offset[part]
            ends = np.cumsum(size)
            where = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
            parts.append(self._bytes[where].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, kept: int = KEPT) -> Codec:
    """One codec for each Python worker and vocabulary file."""
    return Codec(path, kept)


def encode_documents(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``ids``."""
    own = others(docs, text_col, "ids")
    rows = docs.select(*own, text_col)
    schema = rows.select(*own, F.array().cast("array<int>").alias("ids")).schema

    def run(batches):
        c = codec(path)
        for b in batches:
            ids = pa.array([np.array(c.encode(x), np.int32) for x in b.column(text_col).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in own), ids], names=[*own, "ids"])

    return rows.mapInArrow(run, schema)


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` with ``text`` for ``ids``."""
    own = others(coded, "ids", "text")
    rows = coded.select(*own, "ids")
    schema = rows.select(*own, F.lit("").alias("text")).schema

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = pa.array([c.decode(x) if x else "" for x in b.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in own), texts], names=[*own, "text"])

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, *, text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """``docs`` without the text, with n_tokens, ids_sha256 and decoded_sha256: texts are encoded, the ids decoded, both digested.

    ``kept``: pieces whose ids a worker remembers; fewer take less memory and more time, the results are the same.  Ids and decoded texts stay in the worker; they are what ``encode_documents`` and ``decode_documents`` return.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    own = others(docs, text_col, *names)
    rows = docs.select(*own, text_col)
    schema = rows.select(*own, F.lit(0).cast("long").alias(names[0]), *[F.lit("").alias(x) for x in names[1:]]).schema

    def run(batches):
        c = codec(path, kept)
        digit = [str(k) for k in range(len(c.token))].__getitem__
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column(text_col).to_pylist():
                ids = c.encode(text)
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(digit, ids))))
                text_sha.append(sha(c.decode(ids)))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in own), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[*own, *names])

    return rows.mapInArrow(run, schema)
