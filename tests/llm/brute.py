"""The operators in plain Python, row by row, to hold results against."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def simhash(rows, shingle=3, bits=2):
    prints = {}
    for i, text in rows:
        w = WORD.findall(lowered(text))
        parts = [" ".join(w[j : j + shingle]) for j in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] * bool(w)
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    groups = Groups(prints)
    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= bits:
                groups.join(a, b)
    return {i: (format(prints[i], "016x"), groups.find(i)) for i in prints}


def repeats(rows, length=100):
    """By row number: n_bytes, n_removed, n_spans, kept_sha256, kept."""
    seen, out = set(), []
    for text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
        out.append((len(data), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept))
    return out


def near_vectors(rows, threshold=0.98):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    groups, links = Groups([r[0] for r in rows]), Counter()
    good = [r for r in rows if r[2] is not None and usable(r[1])]
    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    groups.join(a[0], b[0])
    return {r[0]: (links[r[0]], groups.find(r[0]), groups.find(r[0]) == r[0]) for r in rows}


def languages(train, texts, longest=4, least=2):
    """Language and score of ``texts`` after counting ``train`` (text, lang), word by word."""

    def words_in(text):
        return re.findall("[a-z\x80-\U0010ffff]+", (text or "").lower())

    counts = {}
    for text, lang in train:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(words_in(text))
    langs = sorted(x for x in counts if counts[x])
    total = sum(counts.values(), Counter())
    grams = {(x, s): Counter() for x in langs for s in range(1, longest + 1)}
    for x in langs:
        for w in counts[x]:
            grams[x, 1].update(w)
            for s in range(2, longest + 1):
                grams[x, s].update(f"_{w}_"[i : i + s] for i in range(len(w) + 3 - s))

    def share(table, key):
        return math.log((table[key] + 0.5) / (sum(table.values()) + 0.5 * (len(table) + 1)))

    def logs(word):
        if total[word] >= least:
            return [share(counts[x], word) for x in langs]
        marked, found = f"_{word}_", []
        for j in range(len(marked)):
            for s in range(min(longest, len(marked) - j), 0, -1):
                gram = marked[j : j + s]
                if (s > 1 or gram != "_") and any(grams[x, s][gram] for x in langs):
                    found.append([share(grams[x, s], gram) for x in langs])
                    break
        return [sum(v) / len(found) for v in zip(*found)] if found else [0.0] * len(langs)

    out = []
    for text in texts:
        if not langs or not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        sums = [sum(v) for v in zip(*[logs(w) for w in words_in(text)], [0.0] * len(langs))]
        best = max(sums)
        out.append((langs[sums.index(best)], 1 / sum(math.exp(x - best) for x in sums)))
    return out


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _chained(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", v), seed)
    return seed


def sketch(text, k=5, s=2, size=64):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    inner = [_signed(_chained(h[i : i + s])) for i in range(len(h) - s + 1)]
    found = [
        _chained(h[i : i + k])
        for i in range(len(h) - k + 1)
        if min(inner[i], inner[i + k - s]) <= min(inner[i + 1 : i + k - s])
    ]
    if not found and h:
        found = [_chained(h)]
    return sorted({x >> 32 for x in found})[:size]


def likeness(a, b, size=64):
    least = sorted({*a, *b})[:size]
    return 1.0 if not least else len({*least} & {*a} & {*b}) / len(least)


def fingerprints(rows):
    """Rows (doc_id, text) in order of doc_id."""
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        tail = len(text) // 4
        edited = text[: len(text) - tail] + after[:tail]
        own, changed, following = sketch(text), sketch(edited), sketch(after)
        digits = ["".join(format(x, "08x") for x in s) for s in (own, changed)]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i, len(text), sha, *digits, likeness(own, changed), likeness(own, following)))
    return out


def packing_faults(pieces, lengths, capacity):
    """Faults of placed pieces (doc_id, piece, start, length, sequence_id, offset) of documents with known token counts."""
    faults, sequences, cover = [], {}, {}
    for doc, piece, start, length, sequence, offset in pieces:
        sequences.setdefault(sequence, []).append((offset, length))
        cover.setdefault(doc, []).append((piece, start, length))
    for sequence, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            faults += [("gap", sequence)] * (offset != at)
            at += length
        faults += [("over", sequence)] * (at > capacity)
    for doc, parts in cover.items():
        at = 0
        for i, (piece, start, length) in enumerate(sorted(parts)):
            faults += [("cut", doc)] * ((piece, start) != (i, at))
            at += length
        faults += [("whole", doc)] * (at != lengths[doc] or len(parts) != -(-at // capacity))
    return faults + [("missing", d) for d in lengths if d not in cover]
