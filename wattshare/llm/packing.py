"""Packing by powers of two: a document becomes pieces of binary lengths, each a sequence without padding."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattshare.llm.common import WORD
from wattshare.session import staged

END_ID = 1
#: Most word forms whose ids a worker remembers before it starts anew; characters of documents looked up together.
MEMORY_WORDS, TOGETHER = 500_000, 400_000
#: Rows numbered by one task of a bucket.
BUCKET_ROWS = 100_000

_ASCII_WORDS = re.compile(WORD).findall
_SEPARATORS = re.compile("[\x1c-\x1f]").search
#: Capitals whose lower case depends on their place or takes two characters.
_CASES = re.compile("[\u03a3\u0130]").search
_STOPS = re.compile(r"(?<=[^\W_])([!-&(-/:-@\[-`{-~]+)(?=[ \n]|$)").sub


def piece_lengths(tokens: int, longest: int = 2048) -> list[int]:
    """Whole pieces of the longest length, then the binary digits of the rest from high to low."""
    rest = tokens % longest
    bits = [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return [longest] * (tokens // longest) + bits


class WordIds:
    """Token ids of texts, word by word, as little-endian 32-bit numbers.

    The vocabulary's own splitter never crosses white space and its normalisation works within words, so the ids of a
    text are those of its words in turn; every form is encoded once and remembered (a bounded number of them).  To meet
    fewer forms, text is lower-cased as the vocabulary would, and signs that end a word become
    a word: the splitter parts them from letters and digits anyway.  Both are left out where lower case is not the same
    letter by letter.  Texts that hold one of the vocabulary's special tokens are encoded whole.
    """

    def __init__(self, path: str, memory: int = MEMORY_WORDS):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab(False)
        # One token ends every piece that the splitter makes.
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        special = [re.escape(t.content) for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(special)).search if special else lambda text: None
        self._known: dict[str, bytes] = {}
        self._memory = memory

    def __call__(self, text: str) -> bytes:
        return self.of([text])[0]

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; forms that are new to the worker are learned together."""
        known = self._known
        if len(known) > self._memory:
            known.clear()
        split = [None if self._special(t) else self._words(t) for t in texts]
        new = set(chain.from_iterable(w for w in split if w is not None)).difference(known)
        if new:
            self._learn(list(new))
        return [self._whole(t) if w is None else b"".join(map(known.__getitem__, w)) for t, w in zip(texts, split)]

    def _whole(self, text: str) -> bytes:
        return np.array(self._ids([text])[0], dtype="<u4").tobytes()

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            text = _STOPS(r" \1", text.lower())
        elif not _CASES(text) and unicodedata.is_normalized("NFC", text):
            lower = text.lower()
            # A small letter may compose with a mark that its capital does not compose with.
            if unicodedata.is_normalized("NFC", lower):
                text = _STOPS(r" \1", lower)
        # Python takes four separators for white space that the vocabulary's splitter does not.
        return text.split() if not _SEPARATORS(text) else _ASCII_WORDS(text)

    def _learn(self, new: list[str]) -> None:
        """Encode words of plain letters in one go, told apart by the ends of their pieces; others one by one."""
        rest = new
        plain = [w for w in new if w.isalpha()]
        if plain:
            ids = np.array(self._ids([" ".join(plain)])[0], dtype="<u4")
            stops = (np.flatnonzero(self._ends[ids]) + 1) * 4
            if len(stops) == len(plain) and stops[-1] == 4 * len(ids):
                data, start = ids.tobytes(), 0
                for word, stop in zip(plain, stops.tolist()):
                    self._known[word] = data[start:stop]
                    start = stop
                rest = [w for w in new if w not in self._known]
        for word, ids in zip(rest, self._ids(rest)):
            self._known[word] = np.array(ids, dtype="<u4").tobytes()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _pieces(tokenizer_path: str, longest: int, end_id: int):
    """Arrow mapper: per document its number of tokens and the start, length and checksum of each piece, as arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = WordIds(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()

        def rows(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            tokens, starts, lengths, sums = [], [], [], []
            offsets = [0]
            for data in ids_of.of(texts):
                data = memoryview(data + end)
                parts = piece_lengths(len(data) // 4, longest)
                begins = list(accumulate(parts, initial=0))
                tokens.append(begins.pop())
                starts += begins
                lengths += parts
                sums += [zlib.crc32(data[4 * b:4 * (b + n)]) for b, n in zip(begins, parts)]
                offsets.append(len(starts))
            places = pa.array(offsets, pa.int32())
            pieces = [pa.ListArray.from_arrays(places, pa.array(v, pa.int64())) for v in (starts, lengths, sums)]
            return pa.RecordBatch.from_arrays([ids, pa.array(tokens, pa.int64()), *pieces], PIECES)

        for batch in batches:
            ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("_id", "_text"))
            first, held, size = 0, [], 0
            for i, text in enumerate(texts):
                held.append(text.as_py())
                size += len(held[-1])
                if size >= TOGETHER or i + 1 == len(ids):
                    yield rows(ids[first:i + 1], held)
                    first, held, size = i + 1, [], 0
    return run


PIECES = ["_id", "doc_tokens", "start", "length", "ids_crc32"]


def packed_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 2048,
    end_id: int = END_ID, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's ids, ``end_id`` last, are cut from the front into pieces of ``longest`` (a power of two) and then
    into the binary digits of the rest.  A piece is a sequence of its own, so none crosses documents and none
    is padded: offset is always 0.  Sequences of one length follow each other (shorter lengths
    first), so that a bucket is a range of ``sequence_id`` and a loader draws batches of one shape.

    Numbers come from nested counts: rows within (length, part), parts of about ``bucket_rows`` rows by hash of id
    and start, then the few sums of parts.  Null and empty texts hold ``end_id`` alone; very long texts
    give as many pieces as they need; rows that repeat an id are packed each; an empty table gives no rows.
    ``tokenizer_path`` must be readable by every executor.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    cut = texts.mapInArrow(
        _pieces(tokenizer_path, longest, end_id),
        f"_id {id_type}, doc_tokens long, start array<long>, length array<long>, ids_crc32 array<long>")
    pieces = staged(cut.select("_id", "doc_tokens", F.inline(F.arrays_zip("start", "length", "ids_crc32"))), "pieces")
    parts = max(1, -(-pieces.count() // bucket_rows))
    spread = pieces.withColumn("_part", F.pmod(F.xxhash64("_id", "start"), F.lit(parts)))
    counts = spread.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    lengths = longest.bit_length()
    per_length = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("length").agg(F.sum("_n").alias("_all"))
    # One row per power of two at most.
    shorter = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.limit(lengths).select("length", F.coalesce(F.sum("_all").over(shorter), F.lit(0)).alias("_base"))
    firsts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(per_length), F.lit(0))).join(
        F.broadcast(bases), "length").select("length", "_part", (F.col("_base") + F.col("_before")).alias("_first"))
    number = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_id", "start", "ids_crc32")) - 1
    return spread.withColumn("_number", number).join(firsts, ["length", "_part"]).select(
        F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_first") + F.col("_number")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
