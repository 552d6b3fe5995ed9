"""Exact dedup, packing and mixing against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from wattshare.llm.exact_dedup import exact_duplicates, text_digests
from wattshare.llm.mixing import in_training_order, mixture, schedule_position
from wattshare.llm.packing import WordIds, packed_pieces, piece_lengths
from wattshare.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
RUN = re.compile(r"[\x20\x09-\x0D]+")


@pytest.mark.parametrize("limit", [500_000, 0])
def test_exact_groups(documents, limit):
    """Both ways of reading whole texts: keys broadcast, keys shuffled."""
    rows = documents.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[RUN.sub(" ", r.text or "")].append(r.doc_id)
    first = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((r.doc_id is None, r.doc_id or 0), first[t], len(groups[t])) for r in rows for t in [RUN.sub(" ", r.text or "")])
    got = exact_duplicates(documents, broadcast_rows=limit, digests=True).collect()
    texts = sorted(((r.doc_id is None, r.doc_id or 0), hashlib.sha256(RUN.sub(" ", r.text or "").encode()).hexdigest()) for r in rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.text_sha256) for r in got) == texts
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_digests_and_empty_table(spark, documents):
    got = {r.doc_id: r.text_sha256 for r in text_digests(documents).collect()}
    assert got[4] == got[5] == hashlib.sha256(b"").hexdigest()
    assert got[6] == hashlib.sha256(b" ").hexdigest()
    assert exact_duplicates(documents.limit(0)).count() == 0


def test_a_sieve_tells_apart_what_the_one_before_could_not(spark):
    head = "p" * 64
    rows = [(1, "alone"), (2, head + "a"), (3, head + "b"), (4, head + "b"), (5, "q" * 65)]
    got = {r.doc_id: r.decided_by for r in exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "length", 2: "whole", 3: "whole", 4: "whole", 5: "prefix"}


def test_piece_lengths_are_binary():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000):
        parts = piece_lengths(n)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 2048 for p in parts)


def test_packing_round_trip(spark, documents):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    got = packed_pieces(documents, tokenizer_path(), bucket_rows=7).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    assert {r.offset for r in got} == {0}
    order = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert order == sorted(order)
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    for r in got:
        ids = np.array(whole.encode(texts[r.doc_id], add_special_tokens=False).ids + [1], dtype="<u4")
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    assert sum(r.length for r in got if r.doc_id == 10) == next(r.doc_tokens for r in got if r.doc_id == 10)
    assert packed_pieces(documents.limit(0), tokenizer_path()).count() == 0


def test_word_ids_equal_those_of_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    ids_of = WordIds(tokenizer_path(), memory=20)
    special = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "a <|endoftext |> b", "A<|ENDOFTEXT|>"]
    for text in [*special, "DİKKATLİ! Yİ. İ.", "J\u030c! H\u0331. T\u0308, \u0399\u0308\u0301?", "a\x1cb \x85c\xa0d e f　g", "ΑΣ ΑΣΒ İstanbul <|endoftext|>", "x's don't '. it's, 'tis",
                 "Å Å 하", "The.The, THE. 1.5, 3. a1. b_c. _. &&& the&&& !! no!!", "", "  ", "日本語 \U0001f600\U0001f600"]:
        assert np.frombuffer(ids_of(text), dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_ids_of_all_letters_before_signs():
    """Every letter of Unicode, alone, after another and before a mark, with signs around it."""
    import unicodedata

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    ids_of = WordIds(tokenizer_path())
    letters = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LM"]
    letters = [c for c in letters if not 0x3400 <= ord(c) < 0xd800 and ord(c) < 0x10000]
    rng = random.Random(1)
    texts = []
    for i in range(0, len(letters), 8):
        signs = [rng.choice([".", "!", ",", "'s", "\u0307.", "\u030c!", ")", "\u0301", "-", "1."]) for _ in range(8)]
        texts.append(" ".join(rng.choice(["", "a", "I", "\u0130"]) + c + s for c, s in zip(letters[i:i + 8], signs)))
    assert len(texts) > 1000
    for text, got in zip(texts, ids_of.of(texts)):
        assert np.frombuffer(got, dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op9_mixing"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    found = QUERIES[name](spark, SMALL)
    names = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(want)


def test_mixture(spark, documents):
    got = mixture(documents, bucket_rows=2).collect()
    assert len(got) == documents.count()
    by = defaultdict(lambda: [0, 0, 0.0])
    source = {r.doc_id: r.source for r in documents.collect()}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and 0 <= r.position <= 1
        s = by[source[r.doc_id]]
        s[0], s[1], s[2] = s[0] + r.size, s[1] + r.taken, r.target
        assert r.source_size >= r.size
    for size, taken, target in by.values():
        assert abs(taken - target) <= 1 and target <= 2 * size
    assert abs(sum(t for _, _, t in by.values()) - 1.5 * sum(s for s, _, _ in by.values())) < 1e-6
    again = mixture(documents, bucket_rows=5000)
    key = lambda r: (str(r.doc_id), r.taken, round(r.position, 9))
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))
    assert in_training_order(again).filter("copies = 0").count() == 0
    assert mixture(documents.limit(0)).count() == 0


def test_schedule_is_inverted(spark):
    from pyspark.sql import functions as F

    times = spark.range(11).select((F.col("id") / 10).alias("t"))
    for ramp in (-0.5, 0.0, 0.5):
        done = (1 + ramp) * F.col("t") - ramp * F.col("t") ** 2
        back = times.select("t", schedule_position(done, F.lit(ramp)).alias("b")).collect()
        assert all(abs(r.t - r.b) < 1e-9 for r in back)
