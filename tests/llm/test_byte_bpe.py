import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from finsieve.llm import byte_bpe as b
from finsieve.llm.queries import op3_byte_bpe

PATTERN = public_tokenizers.PATTERN
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="session")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=b.loaded(PATH).ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeiou thnsr'd ll\n\t0189.,=-éñß日🙂<|>"), st.characters(exclude_categories=("Cs",))), max_size=200))
def test_encodes_as_the_library_does(library, text):
    ids = b.encode(text, PATH, PATTERN)
    assert ids == library.encode_ordinary(text)
    assert b.vocabulary(PATH).decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30_000, "=" * 5000 + "-" * 5000, "x y" * 400_000, " " * 3000 + "a", "0123456789" * 2000, "thequickbrown" * 3000])
def test_long_texts(library, text):
    assert b.encode(text, PATH, PATTERN) == library.encode_ordinary(text)


def test_appends_and_edits_equal_encoding_anew():
    words, draw = b.vocabulary(PATH), random.Random(6)
    alphabet = b"the and ing tion er 0123 \xc3\xa9-=aaaa"
    for _ in range(60):
        data = bytes(draw.choice(alphabet) for _ in range(draw.randint(0, 400)))
        cut = draw.randint(0, len(data))
        table = b.PrefixTable(words, data[:cut])
        table.append(data[cut:])
        assert table.last == b.PrefixTable(words, data).last
        start = draw.randint(0, len(data))
        stop = draw.randint(start, min(len(data), start + 5))
        new = bytes(draw.choice(alphabet) for _ in range(draw.randint(0, 5)))
        redone = table.replace(start, stop, new)
        fresh = b.PrefixTable(words, data[:start] + new + data[stop:])
        assert table.last == fresh.last and table.data == fresh.data and table.tokens() == fresh.tokens()
        assert redone <= len(table.data) - start


def test_an_edit_redoes_little():
    table = b.PrefixTable(b.vocabulary(PATH), b"the quick brown fox " * 500)
    assert table.replace(100, 101, b"xy") < 300


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(b, "REMEMBERED", 10)
    v = b.loaded(PATH)
    known = b.Pieces(v)
    library_like = {w: v.encode_piece(w.encode()) for w in ("zq%dxk" % i for i in range(100))}
    for w, ids in library_like.items():
        assert known[w] == np.array(ids, "<u4").tobytes()
    assert len(known) <= 10 and len(v.follows) <= 10


def test_odd_rows(docs_of, library):
    texts = [None, "", "a", "a", "Tổng tài sản <|endoftext|>"]
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) for r in b.byte_bpe(docs_of(texts, ids=[1, 2, 3, 3, 4]), PATH, PATTERN, with_ids=True).collect())
    want = []
    for i, t in zip([1, 2, 3, 3, 4], texts):
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert got == sorted(want)
    assert b.byte_bpe(docs_of(["a"]).limit(0), PATH, PATTERN).count() == 0


def test_whole_query(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in op3_byte_bpe(spark, sf_dir).collect()}
    for i, t in docs.items():
        ids = np.array(library.encode_ordinary(t), "<u4")
        assert got[i] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert len(got) == len(docs)


def test_memory_is_bounded_in_bytes(library, monkeypatch):
    """Pieces of 64 long characters have hundreds of prefixes of hundreds of bytes."""
    monkeypatch.setattr(b, "REMEMBERED_BYTES", 100_000, raising=False)
    v = b.loaded(PATH)
    known, draw = b.Pieces(v), random.Random(7)
    for _ in range(200):
        piece = "".join(draw.choice("日本語文字列検査") for _ in range(60))
        assert np.frombuffer(known[piece], "<u4").tolist() == library._encode_single_piece(piece.encode())
        assert sum(map(len, v.prefixes)) <= 200_000 and sum(len(k.encode()) + len(x) for k, x in known.items()) <= 101_000
