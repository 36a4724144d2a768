"""Token ids as ORC files: run-length encoded integers in stripes, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of doc_id and sorted, so file by file the ids stand in ascending doc_id order, the
stripe and row-group statistics on doc_id are narrow, and a reader of few documents skips stripes by them and by the
Bloom filters.  Spark's reader takes the stripes of a file in parallel.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, scratch_path, slices

#: Bound of the runs of letters that a worker remembers; beyond it, it starts anew.
WORDS, LONGEST = 400_000, 48
#: Marks that part a run of letters before them from what follows, whatever that is (the apostrophe may start 's or 't).
_MARK_LENGTH = 8
#: Latin, Greek and Cyrillic characters; the letters among them stay single letters through NFC and lower case (so not U+0130).
_STABLE = r"^[A-Za-z\x{C0}-\x{12F}\x{131}-\x{24F}\x{370}-\x{52F}]*$"
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


class WordwiseTokenizer:
    """A tokenizers file whose outcome for a text is that of its parts between white space, one after another.

    Only ASCII white space parts a text here; the library itself sees any other.
    This holds if the normalizer works character by character (NFC never joins over white space) and the pre-tokenizer
    drops white space; the constructor refuses other files.  The parts are encoded by the library itself, and frequent
    ones are remembered.  Runs of letters are one pre-token each and go to the library many at a time, one in a line;
    tokens with the end mark tell them apart.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        import json

        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as f:
            said = json.load(f)
        kinds = {x["type"] for x in said["normalizer"]["normalizers"]}
        split = said["pre_tokenizer"]["pretokenizers"][0]
        end = said["model"].get("end_of_word_suffix")
        if not kinds <= {"NFC", "Replace", "Lowercase"} or split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"] or "[\\p{L}]+" not in split["pattern"]["Regex"].split("|") or not end or any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) or x["content"].isalpha() for x in said["added_tokens"]):
            raise ValueError("this tokenizer's outcome isn't that of the parts between white space")
        self.library = Tokenizer.from_file(tokenizer_file)
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith(end)]] = True
        self.lower = "Lowercase" in kinds
        self.letters: dict[str, bytes] = {"": b""}
        self.marks: dict[str, bytes] = {"": b""}

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text, as little-endian 32-bit integers; null is taken as the empty text."""
        sizes, ids = self.encode_column(pa.array(texts, pa.string()))
        ends = np.cumsum(sizes) * 4
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip((ends - sizes * 4).tolist(), ends.tolist(), strict=True)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all ids one after another.

        Splitting, telling words apart and putting ids together is done on columns; only different runs of letters
        become Python objects.
        """
        texts = texts.fill_null("")
        if self.lower:  # of ASCII texts this is the normalizer's own step; it makes words alike
            texts = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts)
        parts = pc.ascii_split_whitespace(texts)
        words = parts.flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)
        first, second, pieces = self._pieces(words.dictionary)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        pool = np.frombuffer(b"".join(pieces), np.int32)
        starts = np.cumsum(lengths) - lengths
        used = np.stack([first[codes], second[codes]], axis=1).ravel()
        before, ids = _gathered(pool, starts[used], lengths[used])
        offsets = parts.offsets.to_numpy()
        bounds = before[2 * (offsets - offsets[0])]
        return np.diff(bounds), ids

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """For each word the two pieces that its ids consist of, and all pieces' ids.

        The first piece is the word's run of letters and the second the marks after it, or the first is the whole word and
        the second is empty.
        """
        runs = pc.utf8_rtrim(words, characters=_MARKS)
        plain = pc.string_is_ascii(runs)
        if self.lower:
            runs = pc.if_else(plain, pc.ascii_lower(runs), runs)
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        marked = sizes - pc.binary_length(runs).to_numpy(zero_copy_only=False)
        letters = pc.and_(pc.utf8_is_alpha(runs), pc.or_(plain, pc.match_substring_regex(runs, _STABLE)))
        parted = letters.to_numpy(zero_copy_only=False) & (marked <= _MARK_LENGTH)
        whole = np.flatnonzero(~parted)
        marked[whole] = 0
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)[1:]
        bounds, raw = _gathered(np.frombuffer(words.buffers()[2] or b"", np.uint8), ends - marked, marked)
        marks = pa.StringArray.from_buffers(len(words), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
        runs = pc.if_else(pa.array(parted), runs, "").dictionary_encode()
        first = runs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = runs.dictionary.to_pylist()
        pieces = self._letters(known)
        second = marks.indices.to_numpy(zero_copy_only=False) + len(pieces)
        pieces += self._known_marks(marks.dictionary.to_pylist())
        first[whole] = np.arange(len(whole)) + len(pieces)
        pieces += self._each(words.take(pa.array(whole)).to_pylist())
        return first, second, pieces

    def _letters(self, runs: list[str]) -> list[bytes]:
        """The ids of different runs of letters."""
        letters = self.letters
        found = list(map(letters.get, runs))
        new = [r for r, ids in zip(runs, found, strict=True) if ids is None]
        if new:
            if len(letters) + len(new) > WORDS:
                letters.clear()
                letters[""] = b""
            made: dict[str, bytes] = {}
            for i in range(0, len(new), 512):
                self._encode_letters(new[i : i + 512], made)
            found = [made[r] if ids is None else ids for r, ids in zip(runs, found, strict=True)]
            letters.update((r, ids) for r, ids in made.items() if len(r) <= LONGEST)
        return found

    def _encode_letters(self, runs: list[str], made: dict[str, bytes]) -> None:
        ids = np.array(self.library.encode_batch_fast(["\n".join(runs)], add_special_tokens=False)[0].ids, np.int32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(runs):
            raise ValueError("a run of letters isn't one pre-token")
        raw, start = ids.tobytes(), 0
        for run, end in zip(runs, (cuts * 4).tolist(), strict=True):
            made[run] = raw[start:end]
            start = end

    def _known_marks(self, marks: list[str]) -> list[bytes]:
        if len(self.marks) > WORDS:
            self.marks = {"": b""}
        new = [m for m in marks if m not in self.marks]
        self.marks.update(zip(new, self._each(new), strict=True))
        return [self.marks[m] for m in marks]

    def _each(self, words: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(words), 4096):
            out += [array("i", e.ids).tobytes() for e in self.library.encode_batch_fast(words[i : i + 4096], add_special_tokens=False)]
        return out


@lru_cache(2)
def tokenizer_of(tokenizer_file: str) -> WordwiseTokenizer:
    """One for each Python worker, so its words are known to later tasks too."""
    return WordwiseTokenizer(tokenizer_file)


def _gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of a pool one after another, and the bounds between them."""
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return bounds, pool[np.arange(int(bounds[-1])) + np.repeat(starts - bounds[:-1], lengths)]


SCHEMA = "doc_id long, at long, n_tokens long, ids array<int>"


def write_ids(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 64 << 20, row_index: int = 1000) -> None:
    """Encodes the documents, appends end_id to each and writes ORC files into path.

    The files (in the order of their part numbers) hold (doc_id long, at long, n_tokens long, ids array<int>) in
    ascending doc_id order, null ids first, equal doc_ids by text.  at counts the ids before the row in its file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, at = tokenizer_of(tokenizer_file), 0
        for batch in batches:
            for part in slices(batch, 8 << 20):
                sizes, ids = tokenizer.encode_column(part.column(1))
                ends = np.cumsum(sizes)
                flat = np.insert(ids, ends, end_id)
                ends = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                sizes = sizes + 1
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at + ends[:-1]), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "at", "n_tokens", "ids"])
                at += int(ends[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    options = {"compression": "zstd", "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": str(row_index), "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    arrow_map(dealt, run, SCHEMA).write.options(**options).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on doc_id reach the stripes' statistics, row indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def describe_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files.

    start counts the ids of all documents before it: those of the files before (one sum for each file, read from the
    columns at and n_tokens alone) and those before it in its own file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends = ids.offsets.to_numpy()
            flat = memoryview(ids.values.to_numpy(zero_copy_only=False)).cast("B")
            crc = [zlib.crc32(flat[4 * i : 4 * j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "file", "at", "n_tokens", "ids_crc32"])

    rows = read_ids(spark, path).withColumn("file", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long"))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    earlier = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    before = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))  # one row for each file
    seen = arrow_map(rows.select("doc_id", "file", "at", "ids"), run, "doc_id long, file long, at long, n_tokens long, ids_crc32 long")
    return seen.join(F.broadcast(before), "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokenize_to_orc(docs: DataFrame, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes the ids of all documents as ORC (into path, or the shared folder) and describes each from the files.

    Null and empty texts hold end_id alone.  Null ids come first, repeated rows stay, an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-ids")
    write_ids(docs, path, tokenizer_file, end_id, id_col, text_col)
    return describe_ids(spark, path)
