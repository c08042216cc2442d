"""SentencePiece BPE with offsets: normalisation through the compiled character map, merging by score, byte fallback.

The compiled map is a double-array trie over UTF-8 bytes and a table of zero-ended replacements. At
each place the longest prefix in the trie is replaced; every byte of the result remembers the byte
of the text that it came from, and pieces are projected through that onto spans of the text.
"""

from __future__ import annotations

import heapq
import struct
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .chunked import Chunks, ValueTable, buffer_of

SPACE = "▁"


class CharsMap:
    """The compiled character map of a model; an empty one changes nothing."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.table = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.table = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest key that starts at ``at``, or None."""
        if not self.units:
            return None
        units, found = self.units, None
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node = step(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= step(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.table[found[1] : self.table.index(b"\0", found[1])]


class Normalizer:
    """A model's normaliser: ``normalize`` returns the normalised text and, for each of its bytes and for the end, its place in the text.

    Escaped spaces are plain ones here, of one byte: the normalised text has no others.
    """

    def __init__(self, spec, space_last: bool):
        if space_last or not spec.escape_whitespaces:
            raise ValueError("white space as a suffix, or not escaped, is not supported")
        self.map = CharsMap(spec.precompiled_charsmap)
        self.prefix, self.strip = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        #: Nothing but the prefix is added to a text that has no escaped space of its own.
        self.plain = not self.map.units and not self.strip and self.prefix

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        data = text.encode("utf-8", "replace")
        pieces: list[tuple[bytes, int]] = []
        at = 0
        while at < len(data):
            if (hit := self.map.longest(data, at)) is not None:
                taken, new = hit
            else:
                taken = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
                new = data[at : at + taken]
            pieces.append((new.replace(SPACE.encode(), b" "), at))
            at += taken
        end = len(data)
        if self.strip:
            start = next((k for k, p in enumerate(pieces) if p[0] not in (b" ", b"")), len(pieces))
            pieces = pieces[start:]
            while pieces and pieces[-1][0].strip(b" ") == b"":
                end = pieces.pop()[1]
        if not pieces:
            return b"", np.zeros(1, np.int64)
        out, places = bytearray(), []
        if self.prefix:
            out += b" "
            places.append(pieces[0][1])
        after_space = self.strip
        for new, at in pieces:
            if after_space:
                new = new.lstrip(b" ")
            out += new
            places += [at] * len(new)
            if new:
                after_space = self.strip and new[-1] == 32
        if self.strip:
            while out.endswith(b" "):
                end = places.pop()
                del out[-1]
        return bytes(out), np.array([*places, end], np.int64)


class Encoded:
    """What some texts encode to: ``ids`` one after another with ``cuts`` (each text's first, and the end), byte spans of each id, and the decoded texts' bytes with their cuts."""

    def __init__(self, ids: np.ndarray, cuts: np.ndarray, starts: np.ndarray, stops: np.ndarray, decoded: np.ndarray, decoded_cuts: np.ndarray):
        self.ids, self.cuts, self.starts, self.stops, self.decoded, self.decoded_cuts = ids, cuts, starts, stops, decoded, decoded_cuts


class PieceEncoder:
    """Encodes as the sentencepiece library does with a BPE model, and keeps offsets; chunks are decoded by the library."""

    def __init__(self, blob: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        if model.trainer_spec.model_type != 2:
            raise ValueError("only BPE models are supported")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.normalizer = Normalizer(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix)
        self.processor = SentencePieceProcessor(model_proto=blob)
        normal = [(p.score, i, p.piece) for i, p in enumerate(model.pieces) if p.type == 1]
        self.id_of = {piece: i for _, i, piece in normal}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("pieces that span words are not supported")
        scores = sorted({s for s, _, _ in normal}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        self.rank = {piece: order[s] for s, _, piece in normal}
        self.bytes_of = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unknown = model.trainer_spec.unk_id
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.pairs = self.apart()
        self.table = ValueTable(self.compute)

    def apart(self) -> np.ndarray:
        """Pairs of bytes that no piece has as neighbours, so that no merge spans them: of ASCII, and any byte before a space but a space."""
        near = {p[k : k + 2].replace(SPACE, " ") for p in self.id_of for k in range(len(p) - 1)}
        pairs = np.zeros((256, 256), bool)
        pairs[:128, :128] = True
        pairs[:, 32] = True
        for x in near:
            if x.isascii():
                pairs[ord(x[0]), ord(x[1])] = False
        pairs[32, 32] = False
        return pairs.ravel()

    def merged(self, text: str) -> list[str]:
        """Symbols after merging: the pair whose piece has the highest score, leftmost first. Short texts are scanned, long ones use a heap."""
        if len(text) > 40:
            return self.heap_merged(text)
        symbols, rank, none = list(text), self.rank.get, len(self.rank)
        ranks = [rank(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            symbols[i] += symbols[i + 1]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(symbols[i - 1] + symbols[i], none)
            if i < len(ranks):
                ranks[i] = rank(symbols[i] + symbols[i + 1], none)
        return symbols

    def heap_merged(self, text: str) -> list[str]:
        symbols, rank = list(text), self.rank.get
        n = len(symbols)
        heap = [(r, i, piece) for i, piece in enumerate(map(str.__add__, symbols, symbols[1:])) if (r := rank(piece)) is not None]
        if not heap:
            return symbols
        heapq.heapify(heap)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i]
            if j < 0 or not symbols[i] or len(symbols[i]) + len(symbols[j]) != len(piece) or symbols[i] + symbols[j] != piece:
                continue
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(new := piece + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, new))
            if (p := before[i]) >= 0 and (r := rank(new := symbols[p] + piece)) is not None:
                heapq.heappush(heap, (r, p, new))
        return [s for s in symbols if s]

    def pieces_of(self, chunk: str) -> tuple[list[int], list[int]]:
        """Ids of a chunk of normalised text and the bytes of it that each stands for."""
        ids, sizes = [], []
        for symbol in self.merged(chunk.replace(" ", SPACE)):
            own = len(symbol) if symbol.isascii() else len(symbol.replace(SPACE, " ").encode())
            if (i := self.id_of.get(symbol)) is not None:
                ids.append(i)
                sizes.append(own)
            elif self.bytes_of:
                data = symbol.encode()
                ids += [self.bytes_of[b] for b in data]
                sizes += [1] * own + [0] * (len(data) - own)
            else:
                ids.append(self.unknown)
                sizes.append(own)
        return ids, sizes

    def compute(self, new: list[str]) -> list[tuple[bytes, bytes, bytes]]:
        """Of each chunk its ids, their sizes, and what they decode to, with the space that decoding takes from the front."""
        found = list(map(self.pieces_of, new))
        text = self.processor.decode([ids for ids, _ in found], num_threads=1) if found else []
        ends = [4 * n for n in accumulate((len(ids) for ids, _ in found), initial=0)]
        ids = np.fromiter((i for own, _ in found for i in own), "<u4").tobytes()
        sizes = np.fromiter((i for _, own in found for i in own), "<u4").tobytes()
        return [(ids[a:b], sizes[a:b], (" " + t if chunk[0] == " " and self.normalizer.prefix else t).encode()) for chunk, t, (a, b) in zip(new, text, pairwise(ends), strict=True)]

    def encode(self, texts: pa.Array) -> Encoded:
        """Ids with begin and end, the span (first byte, byte after the last) of the text of each id between them, and the texts that the ids decode to."""
        norm, places = self.normalized(texts)
        found = Chunks(norm, self.pairs)
        values = self.table.values(found.keys)
        ids, cuts = found.joined([v[0] for v in values], "<u4")
        sizes, _ = found.joined([v[1] for v in values], "<u4")
        _, begins = buffer_of(norm)
        if not self.bytes_of and self.unknown >= 0:
            ids, sizes, cuts = self.one_unknown(ids, sizes, cuts)
        stops = np.cumsum(sizes, dtype=np.int64)
        starts = stops - sizes
        own = np.repeat(begins[:-1], np.diff(cuts))
        starts, stops = starts - own, stops - own
        if places is None:  # only the prefix was added
            starts, stops = np.maximum(starts - 1, 0), np.maximum(stops - 1, 0)
        else:
            for place, a, b in zip(places, cuts[:-1], cuts[1:], strict=True):
                starts[a:b], stops[a:b] = place[starts[a:b]], place[stops[a:b]]
        if self.bytes_of:
            decoded, decoded_cuts = found.joined([v[2] for v in values], "u1")
            decoded, decoded_cuts = self.without_prefix(decoded, decoded_cuts)
        else:  # unknown pieces decode by what is beside them
            whole = [self.processor.decode(ids[a:b].tolist()).encode() for a, b in pairwise(cuts.tolist())]
            decoded, decoded_cuts = np.frombuffer(b"".join(whole), "u1"), np.concatenate([np.zeros(1, np.int64), np.cumsum(list(map(len, whole)), dtype=np.int64)])
        ids, cuts = self.between(ids, cuts)
        return Encoded(ids, cuts, starts, stops, decoded, decoded_cuts)

    def normalized(self, texts: pa.Array) -> tuple[pa.Array, list[np.ndarray] | None]:
        """The normalised texts, and the places of each one's bytes; None where a text has only the prefix before it."""
        texts = texts.fill_null("")
        if self.normalizer.plain and not pc.any(pc.match_substring(texts, SPACE)).as_py():
            joined = pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar(""))
            return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, joined), None
        norm = [self.normalizer.normalize(t) for t in texts.to_pylist()]
        return pa.array([n.decode() for n, _ in norm], pa.string()), [p for _, p in norm]

    def one_unknown(self, ids: np.ndarray, sizes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbouring unknown characters of a text are one piece."""
        if not len(ids):
            return ids, sizes, cuts
        first = np.r_[True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)]
        first[cuts[:-1][cuts[:-1] < len(ids)]] = True
        at = np.flatnonzero(first)
        return ids[first], np.add.reduceat(sizes, at), np.searchsorted(at, cuts)

    def without_prefix(self, decoded: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decoded texts without the space that encoding put before them."""
        if not self.normalizer.prefix:
            return decoded, cuts
        some = np.diff(cuts) > 0
        keep = np.ones(len(decoded), bool)
        keep[cuts[:-1][some]] = False
        return decoded[keep], cuts - np.concatenate([np.zeros(1, np.int64), np.cumsum(some)])

    def between(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with begin and end around each text's."""
        n = np.arange(len(cuts))
        out = np.full(len(ids) + 2 * (len(cuts) - 1), self.begin, "<u4")
        own = np.ones(len(out), bool)
        wide = cuts + 2 * n
        own[wide[:-1]] = False
        own[wide[1:] - 1] = False
        out[wide[1:] - 1] = self.end
        out[own] = ids
        return out, wide
