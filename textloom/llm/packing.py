"""Packing by powers of two: each document is cut into pieces of binary length, and a sequence is one such piece.

A document's ids, the end id included, are cut into as many full sequences as fit and then into the powers of two of the
rest, largest first; no sequence crosses documents, and none is padded. Sequences of equal length form a bucket: their
numbers are one range, in which the shorter buckets come first, and `write_buckets` writes a folder of matrices for each.
Every piece is made where its document is read, so packing shuffles nothing; within a bucket a sequence's number comes
from its partition and place. Words between spaces or line ends are tokenised once and remembered, which gives the
library's own ids because its pre-tokeniser never joins across white space and its normaliser works within words; a text
that holds one of the vocabulary's added tokens goes to the library whole, which gives it that token's id.

Defined results: a null text is empty, and an empty one has the end id alone; an empty table gives no rows; repeated rows
are packed each, so equal pieces tie in all but their numbers; texts are packed whole, however long; only key and text
are read, so other columns may have any name.
"""

from __future__ import annotations

from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, text_slices

SEQUENCE, END_ID = 4096, 2
#: Words that a worker remembers: two generations of this many.
CACHE_WORDS = 300_000
#: Signs that may follow a word's letters; no apostrophe, which the pre-tokeniser treats apart.
SIGNS = ".,;:!?"


class Words:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tails: dict[str, list[int]] = {}
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that byte-level vocabularies show as they are
        rest = iter(range(256, 512))
        self.shown = {b: b if b in plain else next(rest) for b in range(256)}
        self.known = Known(self)

    def raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def one(self, word: str) -> bytes:
        """Ids of a word. Latin letters with signs after them go straight to the merges of the library's model, since the
        pre-tokeniser cuts between letters and signs and the normaliser only lowers such letters."""
        core = word.rstrip(SIGNS)
        if not core.isalpha() or len(word) - len(core) > 3:
            return b""
        if core.isascii():  # byte-level vocabularies show such letters as they are
            ids = [t.id for t in self.model.tokenize(core.lower())]
        elif max(core) < "\u0130":
            ids = [t.id for t in self.model.tokenize(core.lower().encode().decode("latin-1").translate(self.shown))]
        else:
            return b""
        if len(core) < len(word):
            if (tail := self.tails.get(word[len(core) :])) is None:
                tail = self.tails[word[len(core) :]] = [t.id for t in self.model.tokenize(word[len(core) :])]
            ids += tail
        return array("I", ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        self.known.age()
        find = self.known.__getitem__
        return [self.raw([t])[0] if any(a in t for a in self.added) else b"".join(map(find, t.replace("\n", " ").split(" "))) for t in texts]


class Known(dict):
    """Ids of words, made when first asked for; words not asked for since the generation before the last are forgotten."""

    def __init__(self, words: Words):
        super().__init__({"": b""})
        self.words, self.old = words, {}

    def __missing__(self, word: str) -> bytes:
        if (ids := self.old.get(word)) is None:
            ids = self.words.one(word) or self.words.raw([word])[0]
        self[word] = ids
        return ids

    def age(self) -> None:
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()
            self[""] = b""


@cache
def words(path: str) -> Words:
    return Words(path)


#: Bits of a sequence's number below its bucket's.
NUMBER_BITS = 58


def pieces(n: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    out = [(s, sequence) for s in range(0, n - n % sequence, sequence)]
    at, rest = n - n % sequence, n % sequence
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append((at, size))
        at, rest = at + size, rest - size
    return out


def pack(df: DataFrame, path: str, sequence: int = SEQUENCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian 32-bit), doc_tokens, bucket (log2 of the length), sequence_id, offset."""
    spark = df.sparkSession
    bounded_batches(spark)
    narrow = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], *(T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("bucket", T.IntegerType())))])
    schema.fields[0].nullable = True
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        for part in text_slices(batches):
            rows, found = [], words(path).encode([t or "" for t in part.column("text").to_pylist()])
            for i, b in enumerate(found):
                b += end
                n = len(b) // 4
                rows += [(i, s, size, b[4 * s : 4 * (s + size)], n, size.bit_length() - 1) for s, size in pieces(n, sequence)]
            at, *values = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at, pa.int32())), *(pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()), strict=True))], names=schema.names)

    number = F.shiftleft(F.col("bucket").cast("long"), NUMBER_BITS).bitwiseOR(F.monotonically_increasing_id())
    return narrow.mapInArrow(run, schema).select("*", number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame, uri: str) -> DataFrame:
    """Writes the sequences below uri, a folder for each length, whose files hold nothing else; returns bucket, length, n_sequences.

    A file's ids are equally long, so a reader can take any number of them as one matrix.
    """
    packed.select("sequence_id", "doc_id", "start", "ids", "length", "bucket").write.partitionBy("bucket").parquet(uri)
    return packed.sparkSession.read.parquet(uri).groupBy("bucket", "length").agg(F.count("*").alias("n_sequences"))


def packed_digest(df: DataFrame, path: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return pack(df, path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
