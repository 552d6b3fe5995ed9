"""Similarity joins and the pipeline against brute force."""

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wattshare import session
from wattshare.llm import jaccard_join, line_dedup, stages
from wattshare.llm.components import connected
from wattshare.llm.queries import QUERIES
from wattshare.llm.vector_dedup import near_vectors

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _roots(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _near(rows):
    sets = {i: _shingles(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    roots = _roots(sets, links)
    return {i: (len(s), roots[i]) for i, s in sets.items()}


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [
        (rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    links = [(a, b) for a, b in links if a != b]
    want = _roots({n for pair in links for n in pair}, links)
    assert got == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def _mutated(rng, words, k):
    words = list(words)
    for _ in range(k):
        at, how = rng.randrange(len(words)), rng.randint(0, 2)
        if how == 0:
            words[at] = f"m{rng.randint(0, 999)}"
        elif how == 1:
            words.insert(at, f"m{rng.randint(0, 999)}")
        elif len(words) > 1:
            words.pop(at)
    return words


@pytest.mark.parametrize("rounds", [5, 0])
def test_near_duplicates(spark, rounds, monkeypatch):
    """Chains of edits of all sizes with a passage that many share; without star rounds the last round does it all."""
    monkeypatch.setattr(jaccard_join._links, "__defaults__", (rounds,))
    rng, rows = random.Random(7), []
    passage = [f"p{i}" for i in range(30)]
    for size in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20, 27, 40, 80, 81, 100, 243, 300):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(size)]
        for _ in range(6):
            words = _mutated(rng, words, rng.choice([0, 1, 1, 1 + size // 60]))
            rows.append((len(rows), " ".join(words)))
    for _ in range(12):
        own = [f"q{rng.randint(0, 5000)}" for _ in range(rng.randint(8, 60))]
        rows.append((len(rows), " ".join(own + passage)))
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _near(rows)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_near_duplicates_of_odd_rows(documents, limit):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(
        documents, broadcast_rows=limit).collect())
    by = defaultdict(set)
    for i, n, c in got:
        by[i].add((n, c))
    assert by["1"] == by["2"] == by["3"] == by["8"] == by["None"] | {(13, 1)} or by["1"] == {(12, 1)}
    assert by["4"] == {(0, 4)} and by["5"] == {(0, 5)} and by["6"] == {(0, 6)} and by["7"] == {(1, 7)}
    assert len(got) == documents.count()
    assert jaccard_join.near_duplicates(documents.limit(0)).count() == 0


def test_near_duplicates_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_jaccard_join"](spark, SMALL).collect()}
    assert got == _near(rows)


def _vectors(rng, n):
    out = []
    for _ in range(n):
        v = rng.normal(size=8)
        for _ in range(rng.integers(1, 6)):
            out.append(v + rng.normal(size=8) * 0.07)
    return out


@pytest.mark.parametrize("leaf,fan", [(1024, 8), (24, 4)])
def test_vectors(spark, leaf, fan):
    rng = np.random.default_rng(3)
    vectors = _vectors(rng, 60)
    rows = [(i, v.tolist(), int(i % 7 == 0)) for i, v in enumerate(vectors)]
    rows += [(1000, rows[3][1], 0), (1001, rows[3][1], 0), (1002, [0.0] * 8, 0), (1003, None, 0), (1004, [float("nan")] * 8, 0),
             (1005, rows[3][1], None), (1006, [None] + rows[3][1][1:], 0), (1007, [], 0), (1008, [1e200] * 8, 0), (1009, [2e200] * 8, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = {i: np.array(v) / np.abs(v).max() for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: k for i, _, k in rows}
    links = [(a, b) for a, b in combinations(good, 2) if label[a] == label[b]
             and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.98]
    roots, degree = _roots([i for i, _, _ in rows], links), defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(table, leaf=leaf, fan=fan).collect()}
    assert got == {i: (degree[i], roots[i], roots[i] == i) for i, _, _ in rows}
    assert near_vectors(table.limit(0)).count() == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_classes_that_share_a_number_get_others(spark, monkeypatch):
    """In the first turn all sets have one class number; the second must be taken and nothing be lost."""
    real = jaccard_join._class_of
    monkeypatch.setattr(jaccard_join, "_class_of", lambda digest, turn=0: real(digest, turn) if turn else 2)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() < 0.98 else "x" for w in base)) for i in range(20)] + [(30, "quite different words in here")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _near(rows)


@pytest.mark.parametrize("together", [500_000, 50])
def test_shingle_sets_of_a_batch(together, monkeypatch):
    """Texts hashed together have the sets they have alone; words that change places make another shingle."""
    monkeypatch.setattr(jaccard_join, "CHUNK_BYTES", together)
    rng = random.Random(6)
    texts = ["a b b b a", "b a b a b", "", " \t", "One two", "x" * 255 + " " + "x" * 256, "x" * 257, "x" * 8 + "\x0b" + "x" * 9, "a\x1cb c"]
    texts += ["".join(rng.choice("aAb é\n") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    got = [tuple(h.tolist()) for h in jaccard_join.shingle_sets(pa.array(["cut off", *texts]).slice(1))]
    sets = [frozenset(_shingles(t)) for t in texts]
    assert [len(h) for h in got] == [len(s) for s in sets] and all(list(h) == sorted(set(h)) for h in got)
    assert len(set(zip(got, sets))) == len(set(got)) == len(set(sets))


def test_places_of_words_count(spark):
    docs = spark.createDataFrame([(1, "a b b b a"), (2, "b a b a b"), (3, "A b b b a")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng, pairs = random.Random(3), []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 9)))
        b = "".join(_mutated(rng, list(a) or ["a"], rng.randint(0, 3)))[:12]
        pairs.append((a, b))
    table = spark.createDataFrame(pairs, "a string, b string")
    for r in table.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), edits).alias("w")).collect():
        assert r.w == (_distance(r.a, r.b) <= edits), (r.a, r.b)


@pytest.mark.parametrize("edits", [1, 3, 5])
def test_banded_distance_of_long_lines(spark, edits):
    """Lines of many blocks, edits anywhere: the common ends cut off and blocks passed over change nothing."""
    rng, pairs = random.Random(edits), []
    for _ in range(200):
        letters = rng.choice(["ab", "abcdefgh", "aaaaaab", "é\U0001f600xyz"])
        a = [rng.choice(letters) for _ in range(rng.choice([0, 15, 16, 17, 33, 90, 140]))]
        b = _mutated(rng, list(a) or ["a"], rng.randint(0, edits + 2))
        pairs.append(("".join(a), "".join(b)))
    table = spark.createDataFrame(pairs, "a string, b string")
    got = [r.w == (_distance(r.a, r.b) <= edits) for r in table.select(
        "a", "b", line_dedup.within(F.col("a"), F.col("b"), edits).alias("w")).collect()]
    assert all(got)


def test_banded_distance_beyond_one_number(spark):
    """More edits than one number holds go lane by lane, with equal results."""
    rng, pairs = random.Random(8), []
    for _ in range(100):
        a = [rng.choice("abcde") for _ in range(rng.choice([5, 20, 60]))]
        pairs.append(("".join(a), "".join(_mutated(rng, a, rng.randint(0, 9)))))
    edits = line_dedup.MOST_PACKED + 2
    table = spark.createDataFrame(pairs, "a string, b string")
    for r in table.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), edits).alias("w")).collect():
        assert r.w == (_distance(r.a, r.b) <= edits), (r.a, r.b)


def test_distance_is_a_small_expression(spark):
    """Plans hold it for each band and matching, on the driver."""
    assert len(str(line_dedup.within(F.col("a"), F.col("b"), 5))) < 10_000


def test_letter_counts_lose_no_near_pair(spark):
    rng, pairs = random.Random(9), []
    for _ in range(300):
        a = [rng.choice("abcdeé 59.,xyz") for _ in range(rng.randint(5, 50))]
        pairs.append(("".join(a), "".join(_mutated(rng, a, rng.randint(0, 6)))))
    allow = line_dedup._counts_allow(F.col("a"), F.col("b"), 3).alias("w")
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", allow).collect():
        assert r.w or _distance(r.a, r.b) > 3, (r.a, r.b)
    # Equally long, differing in letters that are not among the most frequent: never verified.
    far = spark.createDataFrame([("a line of words bcdfgh", "a line of words mpqvwx")], "a string, b string")
    assert not far.select(allow).first().w


def _copies_with_a_word_longer(n):
    """Lines that share nearly all segments though any two are eight edits apart."""
    rng = random.Random(12)
    base = "".join(rng.choice("etaoinshrdlu    ") for _ in range(400))
    places = [7 + 385 * i // n for i in range(n)]
    return [base[:p] + "".join(rng.choice("bcfgjkmpqvwxyz") for _ in range(4)) + base[p:] for p in places]


def test_letter_counts_at_cuts(spark):
    """Counts before and after cuts tell lines apart whose letters as a whole might be near, and lose no near pair."""
    lines = _copies_with_a_word_longer(24)
    rng, pairs = random.Random(13), list(combinations(lines, 2))
    rows = [(a, b, False) for a, b in pairs]
    for a in lines * 8:
        b = "".join(x[0] for x in _mutated(rng, list(a[rng.choice([0, 100, 300]):]), rng.randint(0, 6)))
        rows.append((a[-len(b):], b, True))
    table = spark.createDataFrame(rows, "a string, b string, near boolean")
    n, k = table.select(line_dedup._counts_allow(F.col("a"), F.col("b"), 5).alias("w"), line_dedup.within(F.col("a"), F.col("b"), 5).alias("d"), "near").agg(
        F.count_if(~F.col("near") & F.col("w")), F.count_if(F.col("d") & ~F.col("w"))).first()
    assert n < 0.4 * len(pairs) and k == 0 and not table.filter("NOT near").select(
        F.bool_or(line_dedup.within(F.col("a"), F.col("b"), 5))).first()[0]


def test_open_pairs_of_a_group_are_few(spark, monkeypatch):
    """Near copies of one line, none near another: few pairs go on to be verified, each once, and no table but the result stays."""
    lines, made, staged = _copies_with_a_word_longer(40), {}, line_dedup.staged

    def counted(df, label, *more):
        table = staged(df, label, *more)
        made.setdefault(label, []).append(table.count())
        return table
    monkeypatch.setattr(line_dedup, "staged", counted)
    before = set(session._staged_by(spark))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert line_dedup.near_lines(docs, "doc_id", "text", line_dedup.MAX_EDITS, 24).count() == 0
    assert sum(made["line-pairs"]) < 0.4 * 40 * 39 / 2 and len(set(session._staged_by(spark)) - before) == 1


@pytest.mark.parametrize("edits,small", [(1, 32), (1, 2), (2, 2)])
def test_near_lines(spark, edits, small, monkeypatch):
    """Small key limits force the splitting of keys by further segments."""
    monkeypatch.setattr(line_dedup, "SMALL_KEY", small)
    rng, lines = random.Random(11), []
    for _ in range(25):
        base = [rng.choice("abc d") for _ in range(rng.randint(6, 20))]
        for _ in range(rng.randint(1, 8)):
            lines.append("".join(x[0] for x in _mutated(rng, base, rng.randint(0, 2))))
    lines += [f"Page {i} of the same long document" for i in range(40)]
    docs = spark.createDataFrame([(i, "\n".join(lines[5 * i:5 * i + 5])) for i in range(-(-len(lines) // 5))], "doc_id long, text string")
    hashes = {r.l: r.h for r in spark.createDataFrame([(x,) for x in set(lines)], "l string").select("l", F.xxhash64("l").alias("h")).collect()}
    order = sorted(set(lines), key=lambda s: (len(s), hashes[s]))
    want = {hashes[y] for j, y in enumerate(order) if y and any(
        x and len(y) - len(x) <= edits and _distance(x, y) <= edits for x in order[:j])}
    assert {r._h for r in line_dedup.near_lines(docs, "doc_id", "text", edits, 1).collect()} == want


@pytest.mark.parametrize("small", [32, 2])
def test_longer_lines_may_differ_more(spark, small, monkeypatch):
    """Bands against brute force: the shorter line's band decides; the default bands, and narrow ones at their borders."""
    monkeypatch.setattr(line_dedup, "SMALL_KEY", small)
    rng, narrow = random.Random(5), ((0, 1), (12, 2), (18, 3))
    lines = ["".join(rng.choice("abcd e") for _ in range(n)) for n in (40, 70, 100, 130, 160, 200) for _ in range(2)]
    lines += ["".join(x[0] for x in _mutated(rng, list(s), k)) for s in lines for k in (1, 2, 3, 4, 5, 6)]
    near = {}
    for max_edits, some in ((line_dedup.MAX_EDITS, lines), (narrow, [s[:n] for s in lines for n in (11, 12, 13, 17, 18, 20)])):
        docs = spark.createDataFrame([(i, x) for i, x in enumerate(some)], "doc_id long, text string")
        hashes = {r.l: r.h for r in docs.select(F.col("text").alias("l"), F.xxhash64("text").alias("h")).collect()}
        order = sorted(set(some), key=lambda s: (len(s), hashes[s]))
        allowed = lambda s: [e for low, e in max_edits if low <= len(s)][-1]  # noqa: E731, B023
        want = {hashes[y] for j, y in enumerate(order) if any(
            len(y) - len(x) <= allowed(x) and _distance(x, y) <= allowed(x) for x in order[:j])}
        near[max_edits] = {r._h for r in line_dedup.near_lines(docs, "doc_id", "text", max_edits, 1).collect()}
        assert near[max_edits] == want and want


def test_repeated_lines(spark, documents):
    line, near, own = "this line of boilerplate is everywhere", "this line of boilerplate is everywherE", "a line of some length that only {} has"
    rows = [(i, f"{own.format('abcdefgh'[i] * 9)}\n{line}\n{own.format('ijklmnop'[i] * 9)}") for i in range(4)]
    rows += [(4, f"{own.format('q' * 9)}\n{near}\n{own.format('r' * 9)}\nhi\nhi"), (5, rows[0][1]), (6, None), (7, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, drop int")
    dropped = line_dedup.repeated_lines(docs)
    got = {r._id: r.drop for r in dropped.collect()}
    # Of the two spellings one stays, once; document 5 is a copy and is left whole.
    assert 5 not in got and {i: d for i, d in got.items() if i in (1, 2, 3)} == {1: [1], 2: [1], 3: [1]}
    assert sum(1 in d for d in got.values()) in (4, 5)
    clean = {r.doc_id: r.text for r in line_dedup.without_lines(docs, dropped).collect()}
    assert clean[1] == "\n".join(rows[1][1].split("\n")[::2]) and clean[6] is None and clean[7] == "" and clean[5] == rows[5][1]
    assert line_dedup.without_lines(docs, dropped).columns == docs.columns
    odd = line_dedup.without_lines(documents, line_dedup.repeated_lines(documents))
    assert odd.count() == documents.count() and line_dedup.repeated_lines(documents.limit(0)).count() == 0


def test_only_whole_copies_keep_repeated_lines(spark, tmp_path):
    shared, own, more = "a passage that several of the documents carry", "what document {} alone has to say here", "a second passage of many documents"
    rows = [
        (1, shared + "\n" + own.format("one")), (2, "\n".join([shared, more, own.format("seventy-two")])),
        (3, "\n".join([own.format("thirty-three")] * 5)), (4, shared), (5, f"{shared}\n{more}"),
        (6, "\n".join([shared, more, own.format("seventy-two")])), (7, "\n".join([own.format("thirty-three")] * 5)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: rows[0][1], 2: f"{more}\n{own.format('seventy-two')}", 3: own.format("thirty-three"), 4: "", 5: ""}
    clean = {r.doc_id: r.text for r in stages.drop_repeated_lines(spark, docs, SMALL).collect()}
    assert clean == want | {6: want[2], 7: want[3]}
    docs.withColumn("source", F.lit("a")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_exact, r.n_lines_kept) for r in QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, 2), 2: (1, 2), 3: (4, 1), 4: (1, 1), 5: (2, 1), 6: (3, 1), 7: (5, 1)}


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "mixing", "packing"]
    calm = stages.drop_toxic(spark, docs, SMALL)
    lines = stages.drop_repeated_lines(spark, docs, SMALL)
    apart = stages.drop_near_duplicates(spark, docs, SMALL)
    mixed = stages.mix_sources(spark, docs, SMALL)
    for out in (calm, lines, apart, mixed):
        assert out.columns == docs.columns
    assert lines.count() == docs.count() and calm.count() > 0.8 * docs.count()
    near = _near([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in apart.select("doc_id").collect()) == sorted(i for i, (_, c) in near.items() if i == c)
    source = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()}
    target = {source[r.doc_id][0]: r.target for r in QUERIES["op9_mixing"](spark, SMALL).collect()}
    words, most = defaultdict(int), defaultdict(int)
    for r in mixed.select("doc_id").collect():
        name, size = source[r.doc_id]
        words[name] += size
        most[name] = max(most[name], size)
    # Whole documents: the last begun of each reading of a source may reach beyond the target.
    assert all(t - 1 <= words[n] <= t + most[n] + 1 for n, t in target.items())


def test_mix_is_written_in_training_order(spark, tmp_path):
    """Of equal sources one is read twice; its second reading lies where the schedule puts it."""
    docs = spark.createDataFrame([(i, "word " * 10, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    places = {}
    for source, ramp, readings in (("a", 0.5, 2), ("b", 0.0, 1)):
        dones = [j / (20 * readings) for j in range(20 * readings)]
        places[source] = [2 * d / (1 + ramp + ((1 + ramp) ** 2 - 4 * ramp * d) ** 0.5) for d in dones]
    stages.mix_sources(spark, docs, SMALL).write.parquet(f"{tmp_path}/mixed")
    ids = [i for f in sorted(tmp_path.glob("mixed/part-*.parquet")) for i in pq.read_table(f)["doc_id"].to_pylist()]
    first = [i for i in ids if i % 2 == 0]
    assert len(ids) == 60 and first[:20] == first[20:] and len(set(first)) == 20
    turns = {s: iter(p) for s, p in places.items()}
    written = [next(turns["ab"[i % 2]]) for i in ids]
    assert all(x <= y + 1e-9 for x, y in zip(written, written[1:]))


def test_stages_on_odd_documents(spark, documents, tmp_path):
    docs = documents.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text"))
    apart = stages.drop_near_duplicates(spark, docs, SMALL)
    assert sorted(str(r.doc_id) for r in apart.collect()) == sorted(["1", "10", "4", "5", "6", "7", "9"])
    assert stages.mix_sources(spark, docs, SMALL).columns == docs.columns
    for stage in (stages.drop_repeated_lines, stages.drop_near_duplicates, stages.mix_sources, stages.pack):
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_pipeline(spark):
    pieces = corpus_pipeline.run(spark, SMALL)
    assert pieces.count() > 0 and pieces.filter("length > doc_tokens OR offset <> 0").count() == 0


def test_stages_keep_columns_of_any_name(spark):
    """Names that stages and operators use inside keep the caller's values, whatever a stage does to the text."""
    names = ["_key", "_begun", "_position", "_n", "_own", "_whole", "_first", "_dropped_id", "_dropped_lines", "doc", "key", "own", "t", "n",
             "whole", "reading", "position", "gone", "_id", "_text"]
    lines = ["a line that many documents share word for word", "another one that is shared by several of them too"]
    rows = [(i, f"{lines[i % 2]}\nthis is only in document number {i} and nowhere else {i * i}" if i % 5 else None, "ab"[i % 2]) for i in range(24)]
    rows += [(3, "three again with other words than those of the first", "a"), (None, "a document that has no number at all", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select(
        "*", *[F.concat_ws(":", F.lit(c), "doc_id").alias(c) for c in names])
    for stage in (stages.drop_repeated_lines, stages.drop_near_duplicates, stages.mix_sources):
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[c] == (f"{c}:{r.doc_id}" if r.doc_id is not None else c) for r in found for c in names)
    assert stages.pack(spark, docs, SMALL).count() >= len(rows)
