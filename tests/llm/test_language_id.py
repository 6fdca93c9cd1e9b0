import struct
import unicodedata
import zlib

import pytest
import xxhash
import zstandard

from finsieve.llm import language_id as g
from finsieve.llm.queries import op9_compression_language_id


def test_whole_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_compression_language_id(spark, sf).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.95


WORDS = {"en": "the and of with that from this have ", "de": "der und die von nicht das ist mit ", "fr": "le et des dans pour une que les "}


@pytest.fixture(scope="module")
def learnt():
    return tuple(sorted((k, (v * 40).encode()) for k, v in WORDS.items()))


def test_smallest_encoding_wins(learnt):
    for lang, words in WORDS.items():
        assert g.judge(words[:20].upper(), learnt)[0] == lang
        found, score, rejected = g.judge(words * 3000, learnt)
        assert found == lang and score > 0.5 and isinstance(rejected, bool)


@pytest.mark.parametrize("text", [None, "", " \n", "123 !? 456", "١٢٣", "__", "½²①", "Ⅷ", "\u0301"])
def test_no_letter_is_unknown(learnt, text):
    assert g.judge(text, learnt) == ("und", 0.0, True)


def test_narrow_margins_are_rejected(learnt):
    assert g.judge("日", learnt)[2] and g.judge("日", learnt)[0] in WORDS
    assert g.judge("a", ()) == ("und", 0.0, True)
    assert g.judge("a", learnt[:1])[0] == "de"


def test_learning_leaves_out_held_out_rows_and_null_languages(docs_of):
    ids = list(range(60))
    texts = [("held " if zlib.crc32(str(i).encode()) % 5 == 0 else "kept ") * 10 for i in ids]
    docs = docs_of(texts, ids=ids, langs=[None if i % 7 == 0 else "en" for i in ids])
    made = g.learn(docs.where(g.trained_on()))
    assert set(made) == {"en"} and b"kept" in made["en"] and b"held" not in made["en"]


def test_odd_rows(docs_of):
    texts = [w * 5 for w in WORDS.values()] * 20 + [None, "", "x" * 100_000, "a", "a"]
    langs = list(WORDS) * 20 + [None, "en", "", None, None]
    ids = [*range(60), 60, 61, 62, 63, 63]
    docs = docs_of(texts, ids=ids, langs=langs)
    got = g.language_id(docs).collect()
    assert len(got) == 65 and {r["lang_pred"] for r in got if r["doc_id"] == 60} == {"und"}
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc_id"])[:3]] == list(WORDS)
    assert g.language_id(docs.limit(0)).count() == 0
    nameless = g.language_id(docs_of(["a b"], ids=[None])).first()
    assert nameless["held_out"] and nameless["lang_pred"] == "und"


def brute_dictionaries(rows, n=g.SAMPLE_ROWS, most=g.MOST_LANGUAGES):
    """rows: (id, text, lang). Whole texts of the ids with the smallest hashes of each language."""
    texts = {}
    for i, text, lang in rows:
        if i is not None and text is not None and lang is not None:
            texts.setdefault(lang, {}).setdefault(i, []).append(text)
    chosen = sorted(texts, key=lambda x: (-len(texts[x]), x))[:most]
    order = lambda i: ((h := xxhash.xxh64_intdigest(struct.pack("<q", i), 42)) - (h >> 63 << 64), i)
    return {x: "\n".join(min(texts[x][i]).lower() for i in sorted(texts[x], key=order)[:n]).encode() for x in sorted(chosen)}


def test_whole_query_equals_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    dictionaries = brute_dictionaries([d for d in docs if zlib.crc32(str(d[0]).encode()) % 5])
    assert dictionaries == g.learn(spark.read.parquet(f"{sf_dir}/documents.parquet").where(g.trained_on()))
    want = {}
    for i, text, _ in docs:
        sizes = []
        for lang, content in dictionaries.items():
            one = zstandard.ZstdCompressor(level=g.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append((len(one.compress((text or "").lower().encode())), lang))
        lettered = any(unicodedata.category(c).startswith("L") for c in text or "")
        want[i] = min(sizes)[1] if lettered else "und"
    assert {r["doc_id"]: r["lang_pred"] for r in op9_compression_language_id(spark, sf_dir).collect()} == want


def test_dictionaries_are_bounded(docs_of):
    texts = [f"word{i} " * 300 for i in range(100)] + ["noise"] * 3
    ids, langs = [*range(100), 100, 101, 101], ["en"] * 60 + ["de"] * 40 + ["x", "y", "y"]
    docs = docs_of(texts, ids=ids, langs=langs)
    for n, most in ((7, 2), (3, 1), (200, 9)):
        made = g.learn(docs, sample_rows=n, most_languages=most)
        assert {k: v for k, v in brute_dictionaries(zip(ids, texts, langs), n, most).items() if len(v) >= 8} == made


def test_columns_with_odd_names(docs_of):
    docs = docs_of(["the and of", "der und die"], ids=[1, 2], langs=["en", "de"]).withColumnsRenamed({"doc_id": "doc.id", "text": "the.text", "lang": "a.lang"})
    assert g.language_id(docs, "doc.id", "the.text", "a.lang").columns == ["doc.id", "held_out", "lang_pred", "score", "rejected"]
