"""Token-id output as ORC.

Documents are dealt by ranges of their id, tokenized where they lie, sorted in
their partition and written as ORC: the writer run-length encodes the integer
columns, keeps row indexes per stride, and a Bloom filter on the document id,
so a reader can skip files, stripes and strides by metadata.  Reading back is
parallel by stripe; only footers and the count column are read for offsets.
A lookup of documents filters on the id in the scan itself, before any offset
is taken, so stripes and strides without them are skipped by their statistics
and Bloom filters.

Tokenization goes by white-space words: the tokenizer drops white space and
never joins across it, so a word's ids do not depend on its neighbours and
words seen before come from a bounded table.  Texts with characters outside a
plain set (where normalisation could look across words) and texts that spell
a special token go through the tokenizers library as a whole.

Defined cases: null or empty text is the end id alone; equal document ids stay
separate rows, in the files and by ``start`` ordered among themselves by a hash
of their token ids; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CACHE = 600_000
#: Characters for which word-by-word encoding equals encoding of the whole: no combining marks, no letters whose case depends on neighbours.
_ODD = re.compile("[^\t\n\r\x20-\x7e¡-¬®-įĲ-ňŊ-ž‐-―‘-„…]")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts; ``probe`` decides once whether the tokenizer's own steps
    are those that the word table repeats, else every text goes through it."""

    def __init__(self, blob: bytes, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(blob.decode())
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()) or "(?!)")
        self.words = _Words(self.tok.model, cache)
        self.by_word = self._probe(json.loads(blob))

    def _probe(self, spec: dict) -> bool:
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = [x["type"] for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or cuts != ["Split", "ByteLevel"] or spec.get("post_processor"):
            return False
        tests = ["Don't we'll 'S a1b22 x,y--z!! É ß_Ab", "…Æ “q” 3½ o'neil's", "\t a  b\nc ''s"]
        return all(self._plain(t) == self._whole(t) for t in tests)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.lower().split()))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_word or _ODD.search(text) or self.special.search(text):
            return self._whole(text)
        return self._plain(text)


class _Words(dict):
    #: Of the plain set, the characters that are neither letters nor decimal digits but numbers.
    pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")

    def __init__(self, model, bound: int):
        super().__init__()
        self.model, self.bound, self.letters = model, bound, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        ids: list[int] = []
        for piece in self.pieces.findall(word):
            shown = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            ids += [t.id for t in self.model.tokenize(shown)]
        got = np.array(ids, "<u4").tobytes()
        if len(word) <= 64 and len(self) <= self.bound:
            self[word] = got
        return got


_encoders: dict[int, WordEncoder] = {}


def _encoder(blob: bytes) -> WordEncoder:
    key = hash(blob)
    if key not in _encoders:
        _encoders[key] = WordEncoder(blob)
    return _encoders[key]


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, n_tokens, ids array<int>)``; each document ends with ``end_id``."""
    with open(tokenizer_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for big in batches:
            for k in range(0, big.num_rows, 256):
                batch = big.slice(k, 256)
                parts = [encoder.encode(t or "") + end for t in batch.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(parts), "<i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), ids)], [id_col, "n_tokens", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids array<int>")


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, stripe_mb: int = 32, stride: int = 10_000) -> None:
    """Tokenize and write ascending by document id; file order is id order."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(id_col, text_col).repartitionByRange(n, F.col(id_col))
    rows = tokenize(dealt, tokenizer_path, end_id, id_col, text_col)
    (
        rows.sortWithinPartitions(id_col, F.xxhash64("ids"))
        .write.option("orc.bloom.filter.columns", id_col)
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(stride))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("orc.compress", "ZSTD")
        .orc(path)
    )


def lookup_tokens(spark: SparkSession, path: str, wanted: list, id_col: str = "doc_id") -> DataFrame:
    """Rows ``(id, n_tokens, ids)`` of some documents; the files' metadata decides what is read."""
    return spark.read.orc(path).where(F.col(id_col).isin(wanted)).select(id_col, "n_tokens", "ids")


def read_token_orc(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Rows ``(id, start, n_tokens, ids)``: where each document starts in the stream of all ids.

    ``start`` is the ids of all files before, from one count per file, plus a
    running sum inside the file; a file holds one range of document ids.
    """
    rows = spark.read.orc(path).withColumn("_file", F.col("_metadata.file_path"))
    counts = rows.groupBy("_file").agg(F.min(id_col).alias("_least"), F.sum("n_tokens").alias("_n"))
    before = counts.select("_file", F.coalesce(F.sum("_n").over(Window.orderBy(F.col("_least").asc_nulls_first(), "_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_file").orderBy(F.col(id_col).asc_nulls_first(), F.xxhash64("ids")).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select("_file", id_col, "n_tokens", "ids").join(before, "_file")
    return starts.select(id_col, (F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids")


def token_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)``: checksums are taken in the first
    pass over the stripes, so the ids themselves are never moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            flat = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            at = (ids.offsets.to_numpy().astype(np.int64) * 4).tolist()
            crc = [zlib.crc32(flat[x:y]) for x, y in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crc, pa.int64()), b.column(3), b.column(4)], [id_col, "n_tokens", "ids_crc32", "_file", "_tie"])

    kind = dict(spark.read.orc(path).dtypes)[id_col]
    rows = spark.read.orc(path).select(id_col, "n_tokens", "ids", F.col("_metadata.file_path").alias("_file"), F.xxhash64("ids").alias("_tie")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_crc32 bigint, _file string, _tie bigint")
    counts = spark.read.orc(path).select(id_col, "n_tokens", F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.min(id_col).alias("_least"), F.sum("n_tokens").alias("_n"))
    before = counts.select("_file", F.coalesce(F.sum("_n").over(Window.orderBy(F.col("_least").asc_nulls_first(), "_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_file").orderBy(F.col(id_col).asc_nulls_first(), "_tie").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(before, "_file").select(id_col, (F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
