"""Byte-level BPE: chunks, heap merging and token counts without identifiers.

No token of the byte-level pattern goes on past an ASCII letter or digit before punctuation, past a
printing character before ASCII white space, or past the character before a space that is not
followed by white space; texts are cut there, and each different chunk is tokenized once.
"""

from __future__ import annotations

import heapq
import json
import os
from itertools import accumulate, chain, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .chunked import MARKS, Chunks, ValueTable

#: Fixed value: the pattern of byte-level BPE (GPT-2's), as in the tokenizers library.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The 256 printable characters that stand for bytes in byte-level vocabularies: bytes that print stand for themselves, the others take code points from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def cut_rules() -> tuple[np.ndarray, np.ndarray]:
    """For Chunks: pairs of ASCII bytes that no token spans, and bytes that surely begin no white space, before which a space begins a token."""
    pairs = np.zeros((256, 256), bool)
    letters = [b for b in range(128) if chr(b).isalnum()]
    marks = [ord(c) for c in MARKS]
    pairs[np.ix_(letters, marks)] = True
    pairs[np.ix_([*letters, *marks], [*range(9, 14)])] = True
    # The first bytes of white space beyond ASCII in UTF-8 are 0xC2, 0xE1, 0xE2 and 0xE3.
    sure = np.array([b in letters or b in marks or (b >= 0xC3 and b not in (0xE1, 0xE2, 0xE3)) for b in range(256)])
    return pairs.ravel(), sure


_PAIRS, _SURE = cut_rules()


def chunks(texts: pa.Array) -> Chunks:
    return Chunks(texts, _PAIRS, _SURE)


class MergeRanks:
    """Ranks of adjacent pairs of symbols, from the ``merges`` of a tokenizers JSON file."""

    def __init__(self, blob: bytes):
        model = json.loads(blob)
        self.specials = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)
        plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
        if model["normalizer"] is not None or any(t[k] != v for t in model["added_tokens"] for k, v in plain.items()):
            raise ValueError("only plain byte-level BPE files are supported: no normalizer, no stripping added tokens")
        pre = model["pre_tokenizer"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only the ByteLevel pre-tokenizer without prefix space is supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self.ranks = {pair: k for k, pair in enumerate(merges)}
        self.symbols = byte_symbols()
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.pattern = regex.compile(PATTERN)

    def merges_of(self, token: str) -> tuple[int, int]:
        """(symbols, merges) of one pre-token: pop the pair of lowest rank, leftmost first, from a heap over a linked list, until none is left."""
        return heap_merges([self.symbols[b] for b in token.encode("utf-8", "surrogatepass")], self.ranks)

    def count(self, text: str) -> int:
        """Tokens of a text without special strings: for each pre-token its symbols less its merges."""
        tokens = [text] if text.isalpha() or (text[:1] == " " and text[1:].isalpha()) else self.pattern.findall(text)
        return sum(symbols - merges for symbols, merges in map(self.merges_of, tokens))

    def odd(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold a special string."""
        found = np.zeros(len(texts), bool)
        for special in self.specials:
            found |= pc.match_substring(texts, special).fill_null(False).to_numpy(zero_copy_only=False)
        return found


def heap_merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> tuple[int, int]:
    """(symbols at first, merges done) for byte-pair merging by rank.

    ``after`` and ``before`` link the living symbols; heap entries are (rank, place, pair) and are
    stale if either symbol has changed since.
    """
    n = len(symbols)
    if n < 2:
        return n, 0
    heap = [(r, i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get(pair)) is not None]
    if not heap:
        return n, 0
    heapq.heapify(heap)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    merges = 0
    while heap:
        _, i, pair = heapq.heappop(heap)
        left = symbols[i]
        if left is not pair[0] and left != pair[0]:
            continue
        j = after[i]
        if j < 0 or symbols[j] != pair[1]:
            continue
        merged = symbols[i] = pair[0] + pair[1]
        symbols[j] = ""
        k = after[i] = after[j]
        merges += 1
        if k >= 0:
            before[k] = i
            if (r := ranks.get(next_pair := (merged, symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, next_pair))
        if (p := before[i]) >= 0 and (r := ranks.get(last_pair := (symbols[p], merged))) is not None:
            heapq.heappush(heap, (r, p, last_pair))
    return n, merges


class TokenCounter:
    """Token counts of texts by heap merging, with a bounded table of what chunks count."""

    def __init__(self, blob: bytes):
        self.ranks = MergeRanks(blob)
        self.table = ValueTable(lambda new: list(map(self.ranks.count, new)))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The tokens of each text; null: 0. Texts with special strings are counted piece by piece between them."""
        odd = self.ranks.odd(texts)
        plain = texts if not odd.any() else texts.filter(pa.array(~odd))
        found = chunks(plain)
        out = np.zeros(len(texts), np.int64)
        out[~odd] = found.totals(self.table.values(found.keys))
        for k in np.flatnonzero(odd):
            pieces = self.ranks.special.split(texts[int(k)].as_py())
            out[k] = len(pieces) - 1 + sum(self.ranks.count(x) for x in pieces if x)
        return out


def read_blob(path: str) -> bytes:
    """A tokenizer's file, read on the driver; the workers get its bytes (a few MB, as a vocabulary is)."""
    return Path(path).read_bytes()


class IdEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers: the tokenizers library encodes the chunks that a bounded table lacks, and texts with special strings whole."""

    def __init__(self, blob: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.tokenizer = Tokenizer.from_str(blob.decode())
        self.ranks = MergeRanks(blob)
        self.ranks.ranks = {}  # the library has its own
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(self.ranks.symbols)})
        self.space = self.ranks.symbols[32]
        self.table = ValueTable(self.compute)

    def compute(self, new: list[str]) -> list[bytes]:
        """Ids of chunks: a single word goes straight to the library's model, others through all of its pipeline."""
        ids: list[list[int]] = [[]] * len(new)
        tokenize, space, letters, rest = self.tokenizer.model.tokenize, self.space, self.letters, []
        for k, chunk in enumerate(new):
            if chunk[0] == " " and chunk[1:].isalpha():
                word = space + chunk[1:] if chunk.isascii() else chunk.encode().decode("latin-1").translate(letters)
                ids[k] = [t.id for t in tokenize(word)]
            else:
                rest.append(k)
        for at in range(0, len(rest), 4096):
            own = rest[at : at + 4096]
            for k, e in zip(own, self.tokenizer.encode_batch_fast([new[k] for k in own], add_special_tokens=False), strict=True):
                ids[k] = e.ids
        flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        return [flat[a:b] for a, b in pairwise(4 * n for n in accumulate(map(len, ids), initial=0))]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (and the end)."""
        odd = self.ranks.odd(texts)
        if not odd.any():
            found = chunks(texts)
            return found.joined(self.table.values(found.keys), "<u4")
        ids, cuts = self.ids(texts.filter(pa.array(~odd)))
        parts, plain = [], iter(np.split(ids, cuts[1:-1]) if len(cuts) > 1 else [])
        for k in range(len(texts)):
            parts.append(np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4") if odd[k] else next(plain))
        return np.concatenate(parts).astype("<u4"), np.concatenate([np.zeros(1, np.int64), np.cumsum([len(p) for p in parts])])
