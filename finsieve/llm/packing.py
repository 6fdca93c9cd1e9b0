"""Bounded-space online best-fit packing of tokenised documents."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import held, quoted, stored_from_python

SEPARATOR = 0
CAPACITY = 2048
#: Open bins of a packer.
OPEN_BINS = 4096
#: Items that arrive together, longest first; with it less than open bins a window, they hardly leave gaps.
WINDOW = 5000
#: Documents that one packer takes, as expected by hashing.
SHARD_ROWS = 200_000
#: Chunks of a generation of memory, of which there are two.
REMEMBERED = 1 << 17
#: Bytes of text that are cut into chunks at a time.
BATCH_BYTES = 4 << 20
#: A full stop or comma between an ASCII letter and a space, for RE2.
ENDED = r"([a-z])([.,]) "


class BestFit:
    """Bins of one capacity, at most `open_bins` of them open, in a bitset keyed by free space.

    An item goes to the open bin in which it leaves least space. If none takes it, a new bin is
    opened, and if there are too many then, the fullest is closed. A bin without space is closed too.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit f: some open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.opened = 0

    def put(self, length: int) -> tuple[int, int]:
        """The item's bin and its place there."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"length {length} doesn't fit")
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            at = self._take(space)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
            space, at = self.capacity, self.opened
            self.opened += 1
        left = space - length
        if left:
            self.bins[left].append(at)
            self.free |= 1 << left
            self.n_open += 1
        return at, self.capacity - space

    def _take(self, space: int) -> int:
        at = self.bins[space].pop()
        self.n_open -= 1
        if not self.bins[space]:
            self.free &= ~(1 << space)
        return at


class Words:
    """Ids of texts of a tokenizer that drops white space, chunk by chunk between spaces.

    Encoding never crosses white space there, nor the border between a letter and a full stop or
    comma, so a batch of texts is cut into chunks at both and made a dictionary of distinct chunks by
    Arrow; the library encodes the distinct ones that aren't known yet, and ids are gathered by
    places. A-Z are lower-cased first, as the tokenizer itself would.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.special = {c: np.array([i], "<u4") for c, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def with_special(self, text: str) -> np.ndarray:
        """Ids as the library gives them at its defaults: special tokens that stand in the text are one id each, what is between them is encoded by itself."""
        if self.cut is None or not self.cut.search(text):
            return self.ids(text)
        return np.concatenate([self.special[part] if part in self.special else self.ids(part) for part in self.cut.split(text)])

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text in which special tokens are words like others."""
        return self.of_batch(pa.array([text]))[0]

    def of_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (and the last one's end)."""
        spaced = pc.replace_substring_regex(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), ENDED, r"\1 \2 ")
        chunks = pc.split_pattern(spaced, " ")
        cut = chunks.flatten().dictionary_encode()
        parts = self._encoded(cut.dictionary.to_pylist())
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool, places = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(lengths) - lengths
        which = cut.indices.to_numpy()
        n_ids = lengths[which]
        ends = np.concatenate([[0], np.cumsum(n_ids)])
        ids = pool[np.repeat(places[which] - ends[:-1], n_ids) + np.arange(ends[-1])]
        bounds = chunks.offsets.to_numpy()
        return ids, ends[bounds - bounds[0]]

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text as the library gives them at its defaults; a null is empty."""
        texts = pc.fill_null(texts, "")
        odd: dict[int, np.ndarray] = {}
        for token in self.special:
            for i in np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)).tolist():
                odd[i] = odd[i] if i in odd else self.with_special(texts[i].as_py())
        ids, at = self.of_batch(texts)
        return (odd[i] if i in odd else ids[at[i] : at[i + 1]] for i in range(len(texts)))

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of the distinct chunks, out of two generations of memory: the younger one becomes the older when it is full, so that frequent chunks stay."""
        if len(self.known) >= REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        parts = list(map(known.get, chunks))
        gaps = [i for i, part in enumerate(parts) if part is None]
        fresh = []
        for i in gaps:
            if (made := older.get(chunk := chunks[i])) is None:
                fresh.append(chunk)
            else:
                known[chunk] = made
        self._learn(fresh)
        for i in gaps:
            parts[i] = known[chunks[i]]
        return parts

    def _learn(self, chunks: list[str]) -> None:
        alone, letters = [], []
        for chunk in chunks:
            (letters if chunk.isalpha() else alone).append(chunk)
        for at in range(0, len(letters), 1024):
            alone += self._learn_together(letters[at : at + 1024])
        if alone:
            for chunk, made in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
                self.known[chunk] = np.array(made.ids, "<u4").tobytes()

    def _learn_together(self, letters: list[str]) -> list[str]:
        """Encode chunks in one call; gives them back if any of them proves to be more than one piece."""
        made = self.tokenizer.encode(" ".join(letters), add_special_tokens=False)
        of = np.array(made.word_ids)
        if not len(of) or of[-1] != len(letters) - 1:
            return letters
        ids, bounds = np.array(made.ids, "<u4").tobytes(), (4 * np.searchsorted(of, np.arange(len(letters) + 1))).tolist()
        self.known.update(zip(letters, (ids[a:b] for a, b in zip(bounds, bounds[1:]))))
        return []


def words(path: str) -> Words:
    return held(("packing", path), lambda: Words(path))


def pieces_of(ids: np.ndarray, capacity: int, separator: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, CRC-32 of the ids) of a document's pieces, the separator behind its ids."""
    n, last = len(ids), np.array([separator], "<u4").tobytes()
    out = []
    for i, at in enumerate(range(0, n + 1, capacity)):
        end = min(at + capacity, n + 1)
        crc = zlib.crc32(ids[at:end].tobytes())
        out.append((i, at, end - at, zlib.crc32(last, crc) if end > n else crc))
    return out


def bounded(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most BATCH_BYTES bytes of text, but for single texts that are longer."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + BATCH_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


PIECES = "pieces array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


def cut_pieces(docs: DataFrame, path: str, capacity: int, separator: int, id_col: str, text_col: str) -> DataFrame:
    """(id, pieces) of each document, one pass over the scan."""
    source = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    schema = StructType([source.schema["id"], *StructType.fromDDL(PIECES).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in bounded(batch, 1):
                made = [pieces_of(ids, capacity, separator) for ids in words(path).batch(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), pa.array(made, arrow.field(1).type)], names=schema.names)

    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, window: int = WINDOW, shard_rows: int = SHARD_ROWS, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Each document's ids end with `separator`; only longer ones are cut, so that all pieces but the
    last are as long as a sequence and are one each. The last ones, a document each, are dealt by
    hash over packers of about shard_rows documents, whatever source or length they have, and each
    packer runs through its own in a fixed order, windows of about `window` rows one after another and
    each from its longest, with a bounded number of open bins. Only such slim rows are shuffled. At most open_bins bins a packer stay partly filled.
    A null text is empty and so the separator alone; a null id is carried; repeated rows are packed
    each; an empty table gives no rows; other columns are ignored.
    """
    made = cut_pieces(docs, path, capacity, separator, id_col, text_col)
    pieces = stored_from_python(made.select(F.col("id"), F.inline("pieces")).withColumn("__row", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") == capacity).select("id", "piece", "start", "length", "ids_crc32", (F.col("__row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    n = rest.count()
    n_shards = max(1, -(-n // shard_rows))
    n_windows = max(1, -(-n // (n_shards * window)))
    shard = F.pmod(F.xxhash64("__row"), F.lit(n_shards)).cast("int")
    kept = ["id", "piece", "start", "length", "ids_crc32"]
    dealt = rest.select(*kept, "__row", shard.alias("shard")).repartition(max(1, n_shards), "shard").sortWithinPartitions("shard", F.pmod(F.xxhash64("__row", F.lit(1)), F.lit(n_windows)), F.desc("length"), "__row")
    schema = whole.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, packer = None, None
        for batch in batches:
            places = []
            for s, length in zip(batch.column("shard").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if s != current:
                    current, packer = s, BestFit(capacity, open_bins)
                at, offset = packer.put(length)
                places.append((2 * ((s << 40) + at), offset))
            arrays = [batch.column(c) for c in kept]
            arrays += [pa.array([p[i] for p in places], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return whole.unionByName(dealt.mapInArrow(run, schema)).withColumnRenamed("id", id_col)
