"""Collocations, periodic runs and sharding against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from wattshare.llm import collocations as phrases
from wattshare.llm import periodic_runs as periodic
from wattshare.llm import sharding
from wattshare.llm.queries import ORACLE_SQL, QUERIES, with_planted_runs

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Collocations


@pytest.mark.parametrize("bits, n", [(20, 3), (20, 2), (64, 3), (64, 2), (1, 3), (25, 3), (13, 4)])
def test_filters_lose_nothing(bits, n):
    """Packing, permuting and coding are undone exactly, for any width, range and counter."""
    rng = np.random.default_rng(bits * n)
    for size in (1, 7, 3000):
        ids = rng.integers(0, 2 ** min(bits, 63), size + n).astype(np.uint64)
        lanes, width = phrases.lanes_of(ids, np.ones(len(ids), bool), n, bits), phrases.lane_bits(n, bits)
        image = phrases.permuted(lanes, width)
        assert all((a == b).all() for a, b in zip(phrases.restored(image, width), lanes))
        assert all((a == ids[i:i + len(a)]).all() for i, a in enumerate(phrases.ids_of(lanes, n, bits)))
        image, counts = phrases.merged(image, None)
        counts = counts * rng.integers(1, 100_000, len(counts))
        assert len(np.unique(np.stack(image, 1), axis=0)) == len(counts)
        for range_bits in (0, 1, min(5, width)):
            low = width - range_bits
            ranges = (image[0] >> np.uint64(low)).astype(int) if low < 64 else np.zeros(len(counts), int)
            for number in set(ranges.tolist()):
                inside = ranges == number
                back, again = phrases.decoded(phrases.encoded([x[inside] for x in image], counts[inside], low), len(image))
                if low < 64:
                    back[0] = back[0] | np.uint64(number << low)
                assert (again == counts[inside]).all() and all((a == b[inside]).all() for a, b in zip(back, image))


def slow_phrases(rows, max_words=3, min_count=2, absorbed=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= min_count}
    out = defaultdict(list)
    for (lang, *w), a in found.items():
        longer = [b for (other, *v), b in found.items() if other == lang and len(v) > len(w)
                  and any(v[i:i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= absorbed * a for b in longer):
            continue
        cuts = [(1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def spoken(rng, count):
    words = ["the", "The", "big", "red", "dog", "ran", "ÉTÉ", "été", "a.b", "x y", "of", "end.", "no,", "what?", "\x1c", "\x00z"]
    rows = []
    for i in range(count):
        text = rng.choice([" ", "  ", "\t", " \n"]).join(rng.choices(words, range(len(words), 0, -1), k=rng.randrange(0, 30)))
        rows.append((i, text, rng.choice(["en", "en", "und", None, "fr"])))
    return [*rows, (None, None, "en"), (1, "", None), (1, "the big dog " * 400, "en"), (2, "the big dog " * 400, "en")]


@pytest.mark.parametrize("options", [{}, {"vocabulary_rows": 3}, {"filter_entries": 40, "range_entries": 20},
                                     {"vocabulary_rows": 0, "filter_entries": 40, "range_entries": 20}, {"max_words": 4}, {"top": 5}])
def test_phrases_equal_plain_counts(spark, options):
    """Dense ids and hashed ids, one filter and many small ones."""
    rows = spoken(random.Random(5), 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("doc_id", "rank").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(docs, min_count=2, **options).collect())
    want = slow_phrases([(r[2], r[1]) for r in rows], options.get("max_words", 3), top=options.get("top", 2000))
    assert got == want and len(got) > 10


def test_ranking_in_parts_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANKED_ROWS", 3)
    rows = spoken(random.Random(8), 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(tuple(r) for r in phrases.collocations(docs, min_count=2, top=7).collect())
    assert got == slow_phrases([(r[2], r[1]) for r in rows], top=7)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_hash_clash_draws_anew(spark, monkeypatch):
    """The first way of hashing lets all words clash; the second must be taken."""
    real, turns = phrases._hashed, []

    def first_clashes(turn):
        turns.append(turn)
        return phrases.F.lit(7).cast("long") if turn == 0 else real(turn)
    monkeypatch.setattr(phrases, "_hashed", first_clashes)
    rows = spoken(random.Random(9), 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(tuple(r) for r in phrases.collocations(docs, min_count=2, vocabulary_rows=0).collect())
    assert got == slow_phrases([(r[2], r[1]) for r in rows]) and max(turns) == 1


def test_phrases_agree_with_sql(spark):
    got = sorted(tuple(r) for r in QUERIES["op11_collocations"](spark, SMALL).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = db.execute(ORACLE_SQL["op11_collocations"]).fetchall()
    assert got == sorted(want) and got


# Periodic runs


def slow_runs(words, least=6, periods=4):
    out = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((x, y - x, q) for (x, y), q in out.items())


def slow_collapsed(words, runs):
    gone = {i for x, n, q in runs for i in range(x + q, x + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def drawn(rng):
    letters = rng.choice([1, 2, 2, 3, 5, 50])
    words = [f"w{rng.randrange(letters)}" for _ in range(rng.choice([0, 1, 2, 5, 8, 20, 60, 200]))]
    for _ in range(rng.randrange(3)):
        root = [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(1, 12))]
        part = (root * rng.randrange(3, 9))[:-rng.randrange(1, len(root) + 1)]
        at = rng.randrange(len(words) + 1)
        words[at:at] = part
        if rng.random() < 0.4:
            words += part
    return words


def test_runs_of_many_documents_equal_plain_search():
    rng = random.Random(3)
    found = 0
    for _ in range(300):
        docs = [drawn(rng) for _ in range(rng.randrange(1, 5))]
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        flat = [(i, w) for i, d in enumerate(docs) for w in d]
        numbers = {w: k for k, w in enumerate(dict.fromkeys(flat))}
        got = periodic.runs_of(np.array([numbers[w] for w in flat], np.int64), doc)
        begins = np.cumsum([0, *[len(d) for d in docs]])
        want = [(x + b, x + b + n, q) for d, b in zip(docs, begins.tolist()) for x, n, q in slow_runs(d)]
        assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda r: (r[0], r[2])), docs
        found += len(want)
    assert found > 500


@pytest.mark.parametrize("words, runs", [
    (["x"] * 100_000, [[0, 100_000, 1]]), (["x", "y"] * 50_000, [[0, 100_000, 2]]),
    ([str(i % 3000) for i in range(40_000)], [[0, 40_000, 3000]])])
def test_long_runs(words, runs):
    numbers = np.unique(np.array(words), return_inverse=True)[1].astype(np.int64)
    assert periodic.runs_of(numbers, np.zeros(len(words), np.int64)).tolist() == runs


def test_grammar_derives_the_text():
    """Every nonterminal is one pair, and all its derivations are equal stretches."""
    rng = random.Random(4)
    words = drawn(rng) + drawn(rng) + drawn(rng)
    numbers = np.unique(np.array(words), return_inverse=True)[1].astype(np.int64)
    bounds, rule, start = periodic.grammar(numbers.copy(), np.zeros(len(words), np.int64))
    assert (0, len(words)) in {(a, c) for a, _, c in bounds.tolist()}
    for r, s in zip(rule.tolist(), start.tolist()):
        a, _, c = bounds[r].tolist()
        assert words[s:s + c - a] == words[a:c]
    assert len(rule) == len(words) - 1  # a binary tree over the words


def run_rows(spark):
    rng = random.Random(12)
    texts = [rng.choice([" ", "\n", "\t\x0b "]).join(drawn(rng)) for _ in range(60)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(7, texts[7], 0), (7, "go " * 9, 0), (None, "no " * 7, 1), (900, None, 1), (901, "", 1),
                                                        (902, " \n", 1), (903, "a b " * 6 + "\x1cq", 1), (904, "z" * 90_000, 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, _id int")


@pytest.mark.parametrize("batch_words", [periodic.BATCH_WORDS, 1, 150])
def test_runs_and_collapsed_texts(spark, batch_words):
    rows, docs = run_rows(spark)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, [tuple(x) for x in r.runs], r.collapsed)
                 for r in periodic.periodic_runs(docs, batch_words=batch_words).collect())
    want = []
    for i, text, _ in rows:
        words = WORD.findall(text or "")
        runs = slow_runs(words)
        want.append(((i is None, i or 0), len(words), sorted(runs, key=lambda r: (r[0], r[2])), slow_collapsed(words, runs)))
    assert got == sorted(want)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, min_periods=3)


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else None
    if h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_runs_query(spark):
    """All columns of the query, on the whole small table, against plain search."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    several = 0
    for i, text in docs:
        words, r = planted(i, text), got[i]
        runs = sorted(slow_runs(words), key=lambda x: (x[0], x[2]))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{x},{n},{q}\n" for x, n, q in runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(slow_collapsed(words, runs).encode()).hexdigest()
        several += bool(runs)
    assert several > 5


def test_planted_runs_of_odd_rows(spark):
    rows = [(i, " \n".join(f"w{k}" for k in range(i % 13))) for i in range(200)] + [(None, "a b"), (5, None), (10, " \t")]
    got = sorted(((r[0] is None, r[0] or 0), WORD.findall(r[1] or "")) for r in with_planted_runs(
        spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(((i is None, i or 0), planted(i, t)) for i, t in rows)


# Sharding


def shard_rows(spark, hot=0):
    rng = random.Random(6)
    rows = [(i, "é" * rng.choice([0, 1, 5, 50, 400]), 0) for i in range(3000)] + [(None, None, 1)] * 3 + [(4, "", 2), (5, "x" * 3000, 2)]
    return rows + [(77, "same text", 0)] * hot


@pytest.mark.parametrize("hot, options", [(0, {}), (1500, {}), (1500, {"slots": 64, "part_rows": 100}), (0, {"shards": 1}), (0, {"slots": 5, "shards": 7})])
def test_shards_hold_everything_evenly(spark, hot, options):
    rows = shard_rows(spark, hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string, _slot int").repartition(4)
    shards = options.get("shards", 24)
    got = sharding.sharded(docs, **options).collect()
    sizes = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == sizes
    loads, places = Counter(), defaultdict(list)
    for r in got:
        loads[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(0 <= s < shards for s in loads) and all(sorted(p) == list(range(len(p))) for p in places.values())
    mean = sum(loads.values()) / shards
    if "slots" not in options or hot:
        assert max(loads.values()) - mean <= max(4000, 0.03 * mean)


def test_map_is_versioned_and_few_slots_move(spark, tmp_path):
    path = str(tmp_path / "map")
    rows = shard_rows(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, _slot int")
    first = {r.doc_id: r.shard for r in sharding.sharded(docs, 6, map_path=path).collect()}
    assert sharding.latest_version(spark, path) == 1
    assert {r.doc_id: r.shard for r in sharding.sharded(docs, 6, map_path=path).collect()} == first
    assert sharding.latest_version(spark, path) == 1  # nothing to edit
    v1 = sharding.read_map(spark, path)
    grown = sharding.rebalanced(v1, 7, grow_only=True)
    moved = [(a, b) for a, b in zip(v1, grown) if a.shard != b.shard]
    assert moved and all(b.shard == 6 for _, b in moved)
    assert sum(b.bytes for _, b in moved) <= 1.1 * sum(p.bytes for p in v1) / 7
    assert sharding.store_map(spark, grown, path) == 2
    assert sharding.read_map(spark, path, 1) == v1 and sharding.read_map(spark, path) == grown
    # Another 20 % of records, all of them in one place: slots leave the shards that became heavy.
    more = spark.createDataFrame([(10_000 + i, "y" * 300, 0) for i in range(600)], "doc_id long, text string, _slot int")
    got = sharding.sharded(docs.unionByName(more), 7, map_path=path).collect()
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert max(loads.values()) <= 1.03 * sum(loads.values()) / 7 and sharding.latest_version(spark, path) == 3
    fewer = sharding.rebalanced(grown, 4)
    assert {p.shard for p in fewer} <= set(range(4)) and len(fewer) == len(grown)


def test_sharding_of_an_empty_table_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * i, i) for i in range(50)], "doc_id long, text string, slot int")
    assert sharding.sharded(docs.limit(0)).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.slot) for r in back.collect()) == [(i, "t" * i, i) for i in range(50)]
    assert {r[0] for r in back.select("_shard").distinct().collect()} == {0, 1, 2}


def test_sharding_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op13_sharding"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all((r.size, r.text_crc32) == (len(docs[r.doc_id].encode()) + 8, zlib.crc32(docs[r.doc_id].encode())) for r in got)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
