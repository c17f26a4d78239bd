"""Token counts and byte-level encoding against the libraries."""

import hashlib
import random

import public_tokenizers
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscan.llm import byte_bpe, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
COUNTS = token_counts.PrefixCounts(open(PIECES, "rb").read())
BYTE_LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS),
    special_tokens={})
CODEC = byte_bpe.Codec(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
PARTS = [*"aabcdet  \n\t'.,(12é中🙂▁́　\x00\r-=_²½", "the", " ing", "▁▁", "<s>", "<unk>", "<0x41>",
         "aaaa", "'re", "<|endoftext|>", "  ", "\n\n "]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_prefix_counts_equal_library(text):
    prefixes = [text[:i] for i in range(len(text) + 1)]
    want = [len(ids) for ids in PIECE_LIBRARY.encode(prefixes)]
    assert COUNTS.prefixes(text) == want
    assert COUNTS.counts([text]) == want[-1:]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_encoding_equals_library(text):
    [chunks] = CODEC.learn([text])
    ids = BYTE_LIBRARY.encode_ordinary(text)
    assert CODEC.ids(chunks) == ids
    assert CODEC.decode(ids) == text.encode()


def test_replay_many_words_at_once():
    rnd = random.Random(4)
    words = ["".join(rnd.choices("aeionst", k=rnd.randint(1, 40))).encode() for _ in range(500)]
    found = CODEC.merges.replay(words)
    want = [BYTE_LIBRARY._encode_single_piece(w) for w in words]
    assert found == want


def test_bounded_memory_keeps_results(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_WORDS", 3)
    monkeypatch.setattr(token_counts, "KEPT_UNITS", 3)
    codec = byte_bpe.Codec(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    for text in ("one two three four", "four five six", "one six seven"):
        [chunks] = codec.learn([text])
        assert codec.ids(chunks) == BYTE_LIBRARY.encode_ordinary(text)
        assert COUNTS.counts([text]) == [len(PIECE_LIBRARY.encode(text))]


def test_parts_of_a_replay(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REPLAY_LENGTH", 9)
    parts = list(byte_bpe._parts(["abc", "defg", "hij", "k" * 30, "l"]))
    assert parts == [["abc", "defg", "hij"], ["k" * 30], ["l"]]
    codec = byte_bpe.Codec(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    texts = ["several words, in small replays", "", " ", "words again 中文 in other  places"]
    found = list(map(codec.ids, codec.learn(texts)))
    assert found == [BYTE_LIBRARY.encode_ordinary(t) for t in texts]
    assert byte_bpe.id_lists(codec, codec.learn(texts)).to_pylist() == found


def test_long_words_leave_the_caches():
    codec = byte_bpe.Codec(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    texts = ["short words " + chr(0x4e00 + i) * 300 + " z" * 40 for i in range(20)]
    for text in [*texts, *texts, "end"]:
        assert codec.ids(next(codec.learn([text]))) == BYTE_LIBRARY.encode_ordinary(text)
    assert max(map(len, [*codec._words, *codec._chunks])) <= byte_bpe.KEPT_LENGTH
    assert {"short", "end"} <= set(codec._words)


def test_count_tokens(odd, nothing):
    rows = token_counts.count_tokens(odd, PIECES, limit=100).collect()
    texts = sorted((r.text or "") for r in odd.collect())
    want = sorted((len(t.encode()), n, n > 100) for t, n in zip(
        texts, map(len, PIECE_LIBRARY.encode(texts)), strict=True))
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert rows[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}
    assert token_counts.count_tokens(nothing, PIECES, limit=1).count() == 0


def test_budget(llm):
    docs = llm.createDataFrame([(1, "some words to cut here"), (2, None), (3, "")],
                               "doc_id bigint, text string")
    cut = {r.doc_id: r.text for r in token_counts.fit_budget(docs, PIECES, 3).collect()}
    text = "some words to cut here"
    want = max(i for i in range(len(text) + 1) if len(PIECE_LIBRARY.encode(text[:i])) <= 3)
    assert cut == {1: text[:want], 2: "", 3: ""}
    tables = {r.doc_id: r.prefix_tokens for r in token_counts.prefix_counts(docs, PIECES).collect()}
    assert tables[1] == [len(PIECE_LIBRARY.encode(text[:i])) for i in range(len(text) + 1)]
    assert tables[2] == tables[3] == [0]


def test_digests_and_round_trip(odd, nothing):
    rows = byte_bpe.encode_digests(odd, RANKS, public_tokenizers.PATTERN).collect()

    def digest(data):
        return hashlib.sha256(data).hexdigest()

    want = []
    for row in odd.collect():
        ids = BYTE_LIBRARY.encode_ordinary(row.text or "")
        want.append((len(ids), digest(" ".join(map(str, ids)).encode()),
                     digest((row.text or "").encode())))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    encoded = byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decode(encoded, RANKS).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted(
        (r.text or "").encode() for r in odd.collect())
    assert byte_bpe.encode_digests(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
