"""Ops 3, 8 and 9 against the libraries."""

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
from tokenizers import Tokenizer

from lagweave.llm import dac, pieces, queries, sentencepieces, tokens
from lagweave.llm.bytepairs import IdEncoder, TokenCounter, chunks, heap_merges, read_blob
from lagweave.llm.chunked import ValueTable

DATA = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(BPE)
COUNTER, ENCODER = TokenCounter(read_blob(BPE)), IdEncoder(read_blob(BPE))
PROCESSOR, PIECE_ENCODER = SentencePieceProcessor(model_file=PIECES), pieces.PieceEncoder(read_blob(PIECES))
LETTERS = st.text(st.sampled_from(list(" \n\tab'sl1.,é日 　▁!x|<>")) | st.characters(exclude_categories=["Cs"]), max_size=40)


TEXTS = st.lists(st.none() | LETTERS | st.sampled_from(["a<|endoftext|> b", "<|endoftext|", "end  ", "word " * 40, "日本語" * 50]), max_size=6)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_byte_bpe_is_the_librarys(texts):
    want = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert COUNTER.counts(pa.array(texts, pa.string())).tolist() == list(map(len, want))
    ids, cuts = ENCODER.ids(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == want


def check_pieces(encoder, processor, texts):
    e = encoder.encode(pa.array(texts, pa.string()))
    spans = e.cuts - 2 * np.arange(len(e.cuts))
    for k, text in enumerate(texts):
        want = processor.encode(text or "", add_bos=True, add_eos=True)
        assert e.ids[e.cuts[k] : e.cuts[k + 1]].tolist() == want
        assert bytes(e.decoded[e.decoded_cuts[k] : e.decoded_cuts[k + 1]]).decode() == processor.decode(want)
        starts, stops, size = e.starts[spans[k] : spans[k + 1]], e.stops[spans[k] : spans[k + 1]], len((text or "").encode())
        assert (stops >= starts).all() and (starts[1:] >= starts[:-1]).all() and (not len(starts) or 0 <= starts[0] and stops[-1] <= size)
    return e, spans


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_pieces_are_the_librarys(texts):
    e, spans = check_pieces(PIECE_ENCODER, PROCESSOR, texts)
    for k, text in enumerate(texts):
        if text:
            assert e.starts[spans[k]] == 0 and e.stops[spans[k + 1] - 1] == len(text.encode())


@settings(max_examples=100, deadline=None)
@given(TEXTS)
@pytest.mark.parametrize("strip", [False, True])
def test_pieces_of_a_model_with_a_character_map(strip, texts):
    """The same model with a compiled map of its own: longest keys are replaced, and spans are of the text before that."""
    keys = {b"ab": b"X", b"abc": b"YY", "é".encode(): b"e", b"\t": b" ", "日".encode(): b"day ", b"|": b""}
    blob, spec = mapped_model(keys, strip)
    check_pieces(encoder_of(blob), spec, [t.replace("\x00", "") if t else t for t in texts])


def test_spans_are_of_the_text_before_the_map():
    keys = {b"ab": b"the", b"abc": b"of"}
    blob, _ = mapped_model(keys, False)
    e = encoder_of(blob).encode(pa.array(["ab abc"]))
    assert [(a, b) for a, b in zip(e.starts.tolist(), e.stops.tolist())][0][0] == 0 and e.stops[-1] == 6
    text = [PROCESSOR.id_to_piece(int(i)) for i in e.ids[1:-1]]
    assert text == ["▁the", "▁of"] and e.starts.tolist() == [0, 2] and e.stops.tolist() == [2, 6]


@lru_cache
def encoder_of(blob):
    return pieces.PieceEncoder(blob)


def mapped_model(keys, strip):
    key = tuple(keys.items()), strip
    if key not in _MODELS:
        table, offsets = b"", {}
        for k, new in keys.items():
            offsets[k] = len(table)
            table += new + b"\0"
        units = double_array(offsets)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(read_blob(PIECES))
        model.normalizer_spec.precompiled_charsmap = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + table
        model.normalizer_spec.remove_extra_whitespaces = strip
        blob = model.SerializeToString()
        _MODELS[key] = blob, SentencePieceProcessor(model_proto=blob)
    return _MODELS[key]


_MODELS: dict = {}


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("▁abethinosl.,é")), max_size=40))
def test_scans_merge_as_heaps_do(text):
    assert PIECE_ENCODER.merged(text) == PIECE_ENCODER.heap_merged(text)


def test_chunks_join_again():
    for text in ("a b c", "a  b", " a", "a ", "", "a \nb", "\n a", "don't, x"):
        found = chunks(pa.array(["x y", text, None, "z"]))
        own = found.index[found.first[1] : found.first[2]]
        assert "".join(found.keys[k] for k in own) == text


def test_tables_stay_within_their_bytes():
    """200 MB of text without spaces, and as much of short different words: tables hold what they may."""
    text = "日本語テスト"
    table = ValueTable(lambda new: [len(k) for k in new], most_bytes=1_000_000)
    for k in range(50):
        table.values([f"{k}-{j}" + text * 200 for j in range(1000)])
        assert table.bytes == 0 and not table.known
    for k in range(50):
        table.values([f" w{k}x{j}" for j in range(1000)])
        assert table.bytes <= 1_000_000 and len(table.known) <= 6_000


def test_heap_merges_count_like_repeated_scans():
    rng = np.random.default_rng(4)
    ranks = {}
    for _ in range(60):
        pool = ["a", "b", "c", *(x + y for x, y in ranks)]
        ranks.setdefault(tuple(rng.choice(pool, 2)), len(ranks))
    for _ in range(200):
        s = list(rng.choice(["a", "b", "c"], rng.integers(0, 30)))
        plain = [str(x) for x in s]
        while (live := [(ranks[p], i) for i, p in enumerate(zip(plain, plain[1:])) if p in ranks]):
            _, i = min(live)
            plain[i : i + 2] = [plain[i] + plain[i + 1]]
        n, merges = heap_merges([str(x) for x in s], ranks)
        assert n - merges == len(plain)


def double_array(keys: dict[bytes, int]) -> list[int]:
    """A small double-array trie, placed by trying bases one after another."""
    trie: dict = {}
    for key, value in keys.items():
        node = trie
        for b in key:
            node = node.setdefault(b, {})
        node[None] = value
    units, used = [0] * 4096, {0}

    def place(node, at):
        labels = [0 if b is None else b for b in node]
        base = next(c for c in range(1, 2000) if all(at ^ c ^ b not in used and at ^ c ^ b < 4096 for b in labels))
        units[at] |= base << 10 | (256 if None in node else 0)
        spots = {b: at ^ base ^ (0 if b is None else b) for b in node}
        used.update(spots.values())
        for b, spot in spots.items():
            if b is None:
                units[spot] = node[b] | 1 << 31
            else:
                units[spot] = b
                place(node[b], spot)

    place(trie, 0)
    return units


def test_compiled_map_replaces_longest_prefixes_and_keeps_places():
    keys = {b"ab": b"X", b"abc": b"YY", "é".encode(): b"e", b"\t": b" "}
    table, offsets = b"", {}
    for key, new in keys.items():
        offsets[key] = len(table)
        table += new + b"\0"
    units = double_array(offsets)
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + table
    spec = sentencepiece_model_pb2.NormalizerSpec(precompiled_charsmap=blob, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    norm, places = pieces.Normalizer(spec, False).normalize("  ab\tabcabé  z ")
    assert norm.decode() == " X YYXe z"
    assert places.tolist() == [2, 2, 4, 5, 5, 8, 10, 12, 14, 15]
    spec.remove_extra_whitespaces = False
    assert pieces.Normalizer(spec, False).normalize(" ab")[0].decode() == "  X"
    assert pieces.Normalizer(spec, False).normalize("")[0] == b""


def brute_pieces(processor, text):
    ids = processor.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(processor.decode(ids).encode()).hexdigest()


def test_op3_rows(spark, odd, none):
    processor = SentencePieceProcessor(model_file=PIECES)
    for docs in (odd, queries.table(spark, DATA, "documents")):
        want = sorted((r["doc_id"] or -1, *brute_pieces(processor, r["text"])) for r in docs.collect())
        got = sentencepieces.piece_digests(docs, PIECES).collect()
        assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    lists = sentencepieces.encode_pieces(odd, PIECES).collect()
    assert all(len(r["ids"]) == len(r["starts"]) + 2 == len(r["stops"]) + 2 for r in lists) and len(lists) == odd.count()
    assert sentencepieces.piece_digests(none, PIECES).count() == 0


def test_op8_rows(spark, odd, none):
    t = Tokenizer.from_file(BPE)
    for docs in (odd, queries.table(spark, DATA, "documents")):
        want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), n := len(t.encode(r["text"] or "", add_special_tokens=False).ids), n > 1024) for r in docs.collect())
        got = tokens.count_tokens(docs, BPE).collect()
        assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert tokens.count_tokens(none, BPE).count() == 0


@pytest.mark.parametrize("a_file", [50, 2_000_000])
def test_op9_rows(spark, odd, none, a_file):
    t = Tokenizer.from_file(BPE)
    for docs in (odd, queries.table(spark, DATA, "documents")):
        rows = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"] or "") for r in docs.collect())
        want, start = [], 0
        for name, text in rows:
            ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
            want.append((name, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.read_token_files(tokens.write_token_files(docs, BPE, ids_a_file=a_file)).collect())
        assert got == want
    assert tokens.read_token_files(tokens.write_token_files(none, BPE)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 2**24, 2**32 - 1]) | st.integers(0, 2**32 - 1), max_size=1500), st.data())
def test_levels_give_any_place(values, data):
    levels = dac.Levels(dac.encode_levels(np.array(values, "<u4")))
    assert len(levels) == len(values)
    for _ in range(5):
        if values:
            i = data.draw(st.integers(0, len(values) - 1))
            j = data.draw(st.integers(i, len(values)))
            assert levels[i] == values[i] and levels.span(i, j).tolist() == values[i:j]
