import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from finsieve.llm import packing as p
from finsieve.llm.queries import op10_best_fit_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["the", "Thing", "É", "é", "İ", "Σ", "ς", "'s", "'t", " ", "\n", "\t", "\x85", "　", ".", ",", "!", "7", "日", "🙂", "<|endoftext|>", "ß", "\r", "-"]), st.characters(exclude_categories=("Cs",))), max_size=30).map("".join))
def test_ids_are_the_librarys(library, text):
    assert p.Words(PATH).ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(p, "REMEMBERED", 20)
    words = p.Words(PATH)
    for i in range(60):
        text = " ".join(f"w{chr(97 + (i * j) % 26)}{chr(97 + j % 26)}." for j in range(12))
        assert words.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(words.known) < 60


def best_fit(lengths, capacity, open_bins):
    """Plain: scan the open bins."""
    bins, opened, out = [], 0, []
    for n in lengths:
        fitting = [b for b in bins if b[0] >= n]
        if fitting:
            space = min(b[0] for b in fitting)
            at = next(b for b in reversed(bins) if b[0] == space)
            bins.remove(at)
        else:
            if len(bins) >= open_bins:
                full = min(b[0] for b in bins)
                bins.remove(next(b for b in reversed(bins) if b[0] == full))
            at, opened = (capacity, opened), opened + 1
        out.append((at[1], capacity - at[0]))
        if at[0] > n:
            bins.append((at[0] - n, at[1]))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120), st.integers(1, 9))
def test_bitset_equals_scanning(lengths, open_bins):
    packer = p.BestFit(30, open_bins)
    assert [packer.put(n) for n in lengths] == best_fit(lengths, 30, open_bins)
    assert packer.n_open <= open_bins


def test_lengths_that_do_not_fit():
    for n in (0, 31):
        with pytest.raises(ValueError, match="fit"):
            p.BestFit(30, 2).put(n)


def whole(rows, docs, library, capacity=2048):
    """Each document's pieces cover its ids; each sequence is gapless and fits."""
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    for i, text in docs.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == r["piece"] * capacity and r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(part.tobytes())
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_whole_query(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op10_best_fit_packing(spark, sf_dir).collect()
    n = whole(rows, docs, library)
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert n <= least * 1.01 + 1


def test_several_packers(docs_of, library):
    draw = random.Random(3)
    texts = {i: " ".join(draw.choice(["alpha", "beta", "gamma,", "δ."]) for _ in range(draw.choice([0, 1, 5, 30, 200]))) for i in range(150)}
    texts |= {200: None, 201: "", 202: "long " * 9000}
    rows = p.pack(docs_of(list(texts.values()), ids=list(texts)), PATH, capacity=64, open_bins=8, window=20, shard_rows=40).collect()
    whole(rows, texts, library, 64)


def test_odd_rows(docs_of):
    rows = p.pack(docs_of(["a", "a", None], ids=[1, 1, None]), PATH).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in rows) == [("1", 2), ("1", 2), ("None", 1)] and len({r["sequence_id"] for r in rows}) == 1
    assert p.pack(docs_of(["a"]).limit(0), PATH).count() == 0


@pytest.fixture(scope="session")
def defaults():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", "É", "İ", "e", "\u0301", " ", "\n", ".", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext"]), max_size=20).map("".join))
def test_special_tokens_are_the_librarys_at_its_defaults(defaults, text):
    assert p.Words(PATH).with_special(text).tolist() == defaults.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_packed_texts(docs_of, defaults):
    texts = {1: "see <|endoftext|> here", 2: "<|startoftext|>A b.<|endoftext|>", 3: "plain " * 100 + "<|endoftext|>" * 70}
    whole(p.pack(docs_of(list(texts.values()), ids=list(texts)), PATH, capacity=64).collect(), texts, defaults, 64)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["the", "Word.", "word, ", "İ.", "É, ", "x). ", "it's. ", "a.", " ", "\n", "é. ", "a.́ ", "<|endoftext|>", "7. ", "日, "]), max_size=12).map("".join)), max_size=12), st.integers(0, 4))
def test_batches_are_the_librarys_text_by_text(defaults, texts, start):
    import pyarrow as pa

    got = list(p.Words(PATH).batch(pa.array(texts, pa.string()).slice(start)))
    assert [g.tolist() for g in got] == [defaults.encode(t or "", add_special_tokens=False).ids for t in texts[start:]]


def test_batches_are_bounded_by_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(p, "BATCH_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["abcd", "abcdef", None, "x" * 99, "", "abc"])], names=["id", "text"])
    assert [part.column(0).to_pylist() for part in p.bounded(batch, 1)] == [[0, 1, 2], [3], [4, 5]]
    assert list(p.bounded(batch.slice(0, 0), 1)) == []
