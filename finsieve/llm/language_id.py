"""Language identification by compression.

Each language has a zstandard dictionary of raw content from its training texts. A text is encoded
with each, and the smallest encoding names the language; where the margin to the second is narrow,
the row is marked as rejected.
"""

from __future__ import annotations

import math

import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, over_texts, quoted, stored

UNKNOWN = "und"
#: Bounds of what is learnt: labelled rows that a language's dictionary is made of, whole texts each,
#: and languages, those of most rows.
SAMPLE_ROWS, MOST_LANGUAGES = 128, 64
LEVEL = 6
#: Bytes between the best and the second encoding under which a row is rejected.
NARROW = 2
LETTER = regex.compile(r"\p{L}")


def trained_on(doc_id: str = "doc_id") -> F.Column:
    """False for the fifth of the documents that is held out, to which those without an id belong."""
    return F.pmod(F.crc32(F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit(""))), F.lit(5)) != 0


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, most_languages: int = MOST_LANGUAGES) -> dict[str, bytes]:
    """Raw-content dictionaries of the languages in docs, from the whole texts of at most sample_rows rows of each.

    The rows of a language with the smallest hashes are taken, equal hashes by id; of rows that repeat
    an id and a language, the smallest text. Of more than most_languages languages those of most ids
    are learnt, equal ones by name, so that labels of noise can't fill the driver. Rows without a
    text, language or id aren't learnt from. Ranks are cut to the bound before they are shuffled.
    """
    labelled = docs.select(F.col(quoted(lang_col)).alias("lang"), F.col(quoted(order_col)).alias("id"), F.col(quoted(text_col)).alias("text")).dropna()
    keys = stored(labelled.select("lang", "id").distinct(), "language-keys")
    most = keys.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    sample = keys.join(F.broadcast(most.select("lang")), "lang").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample_rows)
    texts = labelled.join(F.broadcast(sample), ["lang", "id"]).groupBy("lang", "nth").agg(F.min("text").alias("text"))
    made: dict[str, list[str]] = {}
    for lang, _, text in sorted(map(tuple, texts.collect())):
        made.setdefault(lang, []).append(plain(text))
    dictionaries = {lang: "\n".join(parts).encode() for lang, parts in made.items()}
    return {lang: content for lang, content in dictionaries.items() if len(content) >= 8}


def plain(text: str) -> str:
    return text.lower()


def compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, content in dictionaries:
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=level)
        out.append((lang, zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def judge(text: str | None, dictionaries: tuple[tuple[str, bytes], ...], level: int = LEVEL, narrow: int = NARROW) -> tuple[str, float, bool]:
    """(language, score, rejected); ties go to the language first by name."""
    if not text or not dictionaries or not LETTER.search(text):
        return UNKNOWN, 0.0, True
    data = plain(text).encode()
    sizes = sorted((len(c.compress(data)), lang) for lang, c in held(("language_id", dictionaries, level), lambda: compressors(dictionaries, level)))
    margin = sizes[1][0] - sizes[0][0] if len(sizes) > 1 else len(data)
    return sizes[0][1], 1 / (1 + math.exp(-min(margin, 400) / 2)), margin < narrow


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every whole text; one pass, no shuffle.

    lang_pred is the language of the smallest encoding even where it is rejected, `und` where the
    text is null or has no letter, or nothing was learnt. Texts of any length are encoded whole. Score is a half at equal sizes and grows
    to 1 with the margin; it is 0 for `und`. Repeated rows each give a row; an empty table gives
    none; other columns are ignored.
    """
    fixed = tuple(sorted(dictionaries.items()))
    return over_texts(docs, [id_col], text_col, "lang_pred string, score double, rejected boolean", lambda texts: (judge(t, fixed) for t in texts))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents that aren't held out and judge all: id, held_out, lang_pred, score, rejected."""
    dictionaries = learn(docs.where(trained_on(id_col)), text_col, lang_col, id_col)
    made = identify(docs, dictionaries, id_col, text_col)
    return made.select(quoted(id_col), (~trained_on(id_col)).alias("held_out"), "lang_pred", "score", "rejected")
