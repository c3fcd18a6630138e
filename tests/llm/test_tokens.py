"""Token counts, packing and piece encoding against the libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from tests.llm.conftest import edge_rows
from weftline.llm import packing, pieces, tokencounts
from weftline.llm.encoders import Encoder, Tokenizer
from weftline.llm.packing import best_fit_decreasing, bound
from weftline.llm.pieces import PieceModel
from weftline.llm.wordids import WordIds
from weftline.runtime import scratch_path

WORDS = Tokenizer(public_tokenizers.path("word_bpe_49k.json"), space_free=True)
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Library.from_file(WORDS.path)
PIECES = sentencepiece.SentencePieceProcessor(model_file=MODEL)

text = st.text(alphabet=st.one_of(st.sampled_from("abcABC ,.'\n\t<|>é́İΣß▁日\x1c\xa0😀12"), st.characters(codec="utf-8")), max_size=60)


def library_ids(t):
    return LIBRARY.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(text, max_size=5))
def test_word_ids_equal_the_library(texts):
    ids, counts = _encoder().encode(texts)
    assert ids.tolist() == [i for t in texts for i in library_ids(t)]
    assert counts.tolist() == [len(library_ids(t)) for t in texts]


_cached = []


def _encoder():
    if not _cached:
        _cached.append(Encoder(WORDS))
    return _cached[0]


def test_memo_starts_afresh_without_changing_results():
    memo = WordIds(lambda words: (np.array([len(w) for w in words], np.uint32), np.ones(len(words), np.int64)), limit=3)
    for words in (["a", "bb"], ["ccc", "dddd", "a"], ["eeeee", "bb"], []):
        ids, sizes = memo.gather(memo.lookup(words))
        assert ids.tolist() == [len(w) for w in words] and sizes.tolist() == [1] * len(words)


@pytest.mark.parametrize("tokenizer", [WORDS, Tokenizer(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer(MODEL)])
def test_counts(edge, tokenizer):
    tool = Encoder(tokenizer).library
    got = tokencounts.count_tokens(edge, tokenizer, scratch_path(edge.sparkSession, "cache")).collect()
    want = sorted((r[0] or -1, len((r[1] or "").encode()), len(tool.ids(r[1] or ""))) for r in edge_rows())
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want


def test_cache_is_used_per_tokenizer_version(spark, edge):
    cache = scratch_path(spark, "cache")
    tokencounts.count_tokens(edge, WORDS, cache)
    stored = spark.read.parquet(cache)
    distinct = {" ".join((r[1] or "").replace("\x0b", " ").split(" ")) for r in edge_rows()}
    assert stored.count() <= len(distinct)
    # a planted count proves that a hit is not encoded again
    planted = scratch_path(spark, "planted")
    stored.selectExpr("tokenizer", "content", "n_tokens + 1000 as n_tokens").write.parquet(planted)
    got = tokencounts.count_tokens(edge, WORDS, planted)
    assert got.where("n_tokens < 1000").isEmpty()
    assert spark.read.parquet(planted).count() == stored.count()
    other = tokencounts.count_tokens(edge, Tokenizer(MODEL), planted)
    assert not other.where("n_tokens < 1000").isEmpty()


def test_empty_tables(nothing):
    spark = nothing.sparkSession
    assert tokencounts.count_tokens(nothing, WORDS, scratch_path(spark, "cache")).count() == 0
    assert packing.packed_documents(nothing, WORDS, 4096, 1).count() == 0
    assert pieces.decode_pieces(pieces.encode_pieces(nothing, MODEL), MODEL).count() == 0


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(edge, capacity):
    got = packing.packed_documents(edge, WORDS, capacity, 1).collect()
    want = []
    for row in edge_rows():
        ids = np.array([*library_ids(row[1]), 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((row[0] or -1, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    _assert_gapless(got, capacity)
    assert len({r["sequence_id"] for r in got}) <= np.ceil(bound(np.array([w[3] for w in want]), capacity)) + 1


def _assert_gapless(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity


def test_repacking_meets_the_bound_over_many_partitions(spark):
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(5.5, 1.1, 6_000).astype(int) + 1, 4096).tolist()
    rows = spark.createDataFrame(list(enumerate(lengths)), "key bigint, length bigint")
    got = packing.pack(rows, 4096, partition_pieces=300).join(rows, "key").collect()
    assert len(got) == len(lengths)
    _assert_gapless(got, 4096)
    best = int(np.ceil(bound(np.array(lengths), 4096)))
    assert best <= len({r["sequence_id"] for r in got}) <= best + 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40), st.integers(20, 30))
def test_best_fit_and_bound(lengths, capacity):
    items = np.array(sorted(lengths, reverse=True), np.int64)
    bins, offsets, room = best_fit_decreasing(items, capacity)
    assert bound(items, capacity) <= len(room) + 1e-9
    for b in range(len(room)):
        assert items[bins == b].sum() == capacity - room[b]


def test_bound_beats_the_plain_sum():
    assert bound(np.array([60, 60, 60]), 100) == 3  # no two fit, though the sum needs two
    assert bound(np.array([34] * 6), 100) > 2.9     # three do not fit


MODEL_READ = PieceModel(MODEL)


@settings(max_examples=400, deadline=None)
@given(st.lists(text, max_size=5))
def test_pieces_equal_the_library(texts):
    ids, counts = MODEL_READ.encode(texts)
    want = PIECES.encode(texts)
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 31_999), st.integers(3, 258)), max_size=10), max_size=4))
def test_decoding_any_ids_equals_the_library(rows):
    flat, sizes = MODEL_READ.decode(np.array([i for r in rows for i in r], np.int64), np.array([len(r) for r in rows], np.int64))
    raw, at = flat.tobytes(), 0
    for row, size in zip(rows, sizes.tolist(), strict=True):
        assert raw[at : at + size].decode("utf-8", "weftline-each-byte") == PIECES.decode(row)
        at += size


def test_piece_query(edge):
    got = pieces.decode_pieces(pieces.encode_pieces(edge, MODEL), MODEL).collect()
    want = []
    for row in edge_rows():
        ids = PIECES.encode(row[1] or "", add_bos=True, add_eos=True)
        want.append((row[0] or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), PIECES.decode(ids)))
    assert sorted((r["doc_id"] or -1, r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest(), r["decoded"]) for r in got) == sorted(want)
