"""Token ids of whole texts with a public tokenizer, encoding every distinct piece of text once.

The byte-level pattern always starts a new match at white space that follows a solid
character, and between a letter and a punctuation mark other than the apostrophe, so
text may be cut there without changing its ids. Tasks encode distinct pieces only and
put the ids of documents together from them. A piece of letters is one match of the
pattern and goes straight to the tokenizer's model; others go through all of it. A
text that holds the string of an added token is not cut: the whole tokenizer encodes it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import binary_array, byte_view, ragged, values_of

MAX_PIECES = 1_000_000  # pieces a task remembers; beyond it starts afresh (ids do not depend on it)

# What a byte belongs to. The apostrophe may start a contraction, digits are cut off by white space only.
OTHER, SPACE, LETTER, MARK, SOLID, LATIN = range(6)  # LATIN: last byte of a Latin-1 letter
KIND = bytearray(256)
for _b in range(256):
    if _b in (0x20, *range(0x09, 0x0E)):
        KIND[_b] = SPACE
    elif 0x21 <= _b < 0x7F:
        KIND[_b] = LETTER if chr(_b).isalpha() else SOLID if chr(_b).isdigit() or chr(_b) == "'" else MARK
KIND = bytes(KIND)

CUTS = np.zeros((6, 6), bool)  # by the kinds of a byte and the next: may text be cut between them?
CUTS[[LETTER, MARK, SOLID, LATIN], SPACE] = True  # no run of white space goes on
CUTS[[LETTER, LATIN], MARK] = True
CUTS[MARK, LETTER] = True

LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")  # Latin-1 letters in UTF-8


def byte_characters() -> list[str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a column of texts, as the library gives them without adding special tokens of its own."""

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.model, self.shown = self.tokenizer.model, dict(enumerate(byte_characters()))
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.max_pieces = max_pieces
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, self.kind)
        self.used = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)

    def _remember(self, pieces: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, after = len(self.known), len(self.known) + len(pieces)
        while after > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.lengths[first:after] = lengths
        self.starts[first:after] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.known.update(zip(pieces, range(first, after)))

    def _learn(self, pieces: list[bytes]) -> None:
        plain = [p for p in pieces if LETTERS.fullmatch(p)]
        self._take(plain, ([t.id for t in self.model.tokenize(p.decode("latin-1").translate(self.shown))] for p in plain))
        texts = [p.decode() for p in pieces if not LETTERS.fullmatch(p)]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        self._take([t.encode() for t in texts], (e.ids for e in encoded))

    def _take(self, pieces: list[bytes], rows: Iterator[list[int]]) -> None:
        ids, lengths = [], []
        for row in rows:
            ids += row
            lengths.append(len(row))
        self._remember(pieces, np.array(ids, np.int64), np.array(lengths, np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and how many each row has; null is empty."""
        whole = np.zeros(len(texts), bool)
        for content in self.added:
            whole |= pc.fill_null(pc.match_substring(texts, content), False).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._encode_cut(texts)
        cut_ids, lengths = self._encode_cut(pc.if_else(pa.array(whole), pa.scalar(None, texts.type), texts))
        rows = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)]
        lengths[whole] = [len(r) for r in rows]
        ids = np.empty(lengths.sum(), self.kind)
        own = np.repeat(whole, lengths)
        ids[own], ids[~own] = np.concatenate(rows), cut_ids
        return ids, lengths

    def _encode_cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of texts without strings of added tokens."""
        data, offsets = byte_view(texts)
        if not len(data):
            return self.ids[:0].copy(), np.zeros(len(texts), np.int64)
        kind = np.frombuffer(data.tobytes().translate(KIND), np.uint8).copy()
        lead = np.flatnonzero(data[:-1] == 0xC3)
        after = data[lead + 1]
        kind[lead + 1] = np.where((after == 0x97) | (after == 0xB7), OTHER, LATIN)
        cut = np.empty(len(data), bool)
        cut[1:] = CUTS[kind[:-1], kind[1:]]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        pieces = binary_array(data, np.append(starts, len(data))).dictionary_encode()
        distinct = values_of(pieces.dictionary)
        if len(self.known) + len(distinct) > self.max_pieces:
            self.forget()
        new = [p for p in distinct if p not in self.known]
        if new:
            self._learn(new)
        slot = np.fromiter((self.known[p] for p in distinct), np.int64, len(distinct))[pieces.indices.to_numpy()]
        lengths = self.lengths[slot]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[ragged(self.starts[slot], lengths)], np.diff(ends[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker. Tasks forget their pieces when they end: workers live on in other stages."""
    return Encoder(path)
