"""Token ids in directly addressable codes (DAC).

An id is cut into 8-bit chunks, low chunk first. Level 0 holds the first chunk of every id; a
continuation bitmap says which ids go on, and level 1 holds the next chunk of those, and so on. A
rank directory counts the set bits before every 512th bit, so that the place of an id's next chunk
is one rank away: any token is read without decoding others.

Tables of segments are the file format: Spark writes them as Parquet, so that its commit protocol
covers lost and repeated tasks. A segment holds the ids of consecutive documents.

Null and empty texts have the end id alone. Rows with equal ids follow each other in the order of
their texts' hash, then their texts. A null id comes first. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docdelta.llm.common import by_batch, id_and_text, partitions, scratch_path, slices, table

MAGIC = b"DAC1"
RANK_BITS = 512
#: Words, and pieces of words, kept with their ids, per worker and generation.
CACHED_WORDS = 400_000
LONGEST_CACHED = 48


# ---- the code


def _ranks(bits: np.ndarray) -> np.ndarray:
    """Set bits before each block of RANK_BITS bits; bits: 0 or 1 each."""
    blocks = np.add.reduceat(bits, np.arange(0, len(bits), RANK_BITS), dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
    return np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u4") if len(blocks) else blocks.astype("<u4")


def dac_encode(ids: np.ndarray) -> bytes:
    """Header (magic, number of levels, number of ids), then for each level: its length, chunks, bitmap, ranks."""
    rest, levels = np.asarray(ids, np.uint32), []
    n = len(rest)
    while True:
        more = (rest >> 8) != 0
        levels.append(((rest & 255).astype(np.uint8).tobytes(), np.packbits(more, bitorder="little").tobytes(), _ranks(more.astype(np.uint32)).tobytes(), len(rest)))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = [MAGIC, struct.pack("<IQ", len(levels), n)]
    for chunks, bitmap, ranks, size in levels:
        out += [struct.pack("<Q", size), chunks, bitmap, ranks]
    return b"".join(out)


class DacReader:
    """Random access to the ids of one segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        n_levels, self.n = struct.unpack_from("<IQ", data, 4)
        at, self.levels = 16, []
        for _ in range(n_levels):
            (size,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, size, at)
            at += size
            bitmap = np.frombuffer(data, np.uint8, (size + 7) // 8, at)
            at += len(bitmap)
            ranks = np.frombuffer(data, "<u4", (size + RANK_BITS - 1) // RANK_BITS, at)
            at += ranks.nbytes
            self.levels.append((chunks, bitmap, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            first = block * RANK_BITS >> 3
            before = np.unpackbits(bitmap[first : (i >> 3) + 1], bitorder="little")[: i - (first << 3)]
            i, shift = int(ranks[block]) + int(before.sum()), shift + 8
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        ids = np.zeros(self.n, np.uint32)
        at = np.arange(self.n)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            ids[at] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            at = at[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return ids


# ---- the tokenizer

_words: dict[str, Words] = {}
#: How word_bpe_49k cuts a word in lower case into pieces: the fixed pattern of its pre-tokenizer, for
#: words whose characters all come before U+0130, which normal forms and lower-casing leave one by one.
_L, _N = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\x85\xa0{_L}{_N}]+")


class Lately:
    """What was met lately: a full generation becomes the old one, and what is met again moves to the new one."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def lacks(self, keys: set) -> list:
        """Those of keys that are in neither generation; the others are in the new one afterwards."""
        out = []
        for k in keys.difference(self.new):
            if (value := self.old.get(k)) is None:
                out.append(k)
            else:
                self.new[k] = value
        return out

    def turn(self) -> None:
        if len(self.new) > self.most:
            self.old, self.new = {k: x for k, x in self.new.items() if len(k) <= LONGEST_CACHED}, {}


class Words:
    """A tokenizer, and the words and pieces of words it met lately with their ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.pieces = Lately(CACHED_WORDS), Lately(CACHED_WORDS)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _lines(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece; a line of pieces is encoded at once and cut where a piece ends."""
        out = []
        for i in range(0, len(pieces), 1024):
            some = pieces[i : i + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            if len(cuts) != len(some) + 1 or cuts[-1] != len(ids):
                out += self._each(some)
                continue
            data = ids.tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain, rest = {}, []
        for w in words:
            if w.isalpha():  # of bytes: letters A-Z alone, a piece by themselves
                plain[w] = (w.decode().lower(),)
                continue
            word = w.decode()
            if (word.isascii() or max(word) < "\u0130") and "<|" not in word:
                plain[w] = (word.lower(),) if word.isalpha() else _PIECES.findall(word.lower())
            else:
                rest.append(w)
        pieces = self.pieces
        unknown = pieces.lacks(set(chain.from_iterable(plain.values())))
        pieces.new.update(zip(unknown, self._lines(unknown), strict=True))
        ids = pieces.new.__getitem__
        out = {w: ids(ps[0]) if len(ps) == 1 else b"".join(map(ids, ps)) for w, ps in plain.items()}
        pieces.turn()
        out.update(zip(rest, self._each([w.decode() for w in rest]), strict=True))
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        known = self.words
        # Lower case at once where that changes each character by itself and makes no special token.
        split = [(t.lower() if "<|" not in t and _latin(t) else t).encode().split() for t in texts]
        known.new.update(self.encode(known.lacks(set().union(*split))))
        ids = known.new.__getitem__
        out = [b"".join(map(ids, words)) for words in split]
        known.turn()
        return out


def _latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian 32-bit integers.

    This holds for tokenizers none of whose rules reaches across a space, tab or line end: a text's
    ids are then those of its words in order, so a word's ids are looked up where it was met lately.
    """
    if path not in _words:
        _words[path] = Words(path)
    return _words[path].ids(texts)


# ---- Spark

SEGMENT = pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("dac", pa.binary())])
SEGMENT_DDL = "part int, segment bigint, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, dac binary"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_words: bool = True) -> None:
    """Encode every text, append end_id, and write segments in ascending order of the ids of documents.

    Workers keep the words they met for their next task, unless other work is to have that memory.
    """
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        part, segment = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch):
                ids = [x + end for x in encode_texts([t or "" for t in piece.column("text").to_pylist()], tokenizer_path)]
                lengths = [len(x) // 4 for x in ids]
                dac = dac_encode(np.frombuffer(b"".join(ids), "<u4"))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, segment, piece.column("doc_id").to_pylist(), lengths, sum(lengths), dac), SEGMENT, strict=True)], schema=SEGMENT)
                segment += 1
        if not keep_words:
            _words.clear()

    rows = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    order = ["doc_id", "tie", "text"]
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(encode, SEGMENT_DDL).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with `start`, the number of ids before each.

    Running sums go over the parts (as many as the writing job had tasks), then within each part.
    """
    segments = spark.read.schema(SEGMENT_DDL).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = segments.select("part", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("in_part")).join(parts, "part").select("part", "segment", (F.col("part_start") + F.col("in_part")).alias("start"))
    return segments.join(places, ["part", "segment"])


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers)."""

    def decode(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in DOCS}
        for i in range(batch.num_rows):
            doc_ids, lengths, start, dac = (batch.column(c)[i].as_py() for c in ("doc_ids", "lengths", "start", "dac"))
            ids = DacReader(dac).all().astype("<u4").tobytes()
            at = 0
            for doc, n in zip(doc_ids, lengths, strict=True):
                out["doc_id"].append(doc)
                out["start"].append(start + at)
                out["n_tokens"].append(n)
                out["ids_crc32"].append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
                at += n
        return out

    return read_segments(spark, path).select("doc_ids", "lengths", "start", "dac").mapInArrow(by_batch(decode, DOCS), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer_path: str | None = None, keep_words: bool = True) -> DataFrame:
    """Write the documents' ids to a new folder of the shared checkpoint folder and read them back."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_path, keep_words=keep_words)
    return read_documents(docs.sparkSession, path)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
