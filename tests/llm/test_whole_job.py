import collections
import hashlib
import math
import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from skein.llm import entropy_mix, katz_lm, line_edit_join, secret_crf


def test_katz_scores_a_bigram_that_training_saw_once_as_seen(spark):
    rows = [(1, "a b c d"), (3, "a c b d"), (5, "d a e f"), (7, "a b g h"), (9, "c e h g")]
    docs = spark.createDataFrame([*rows, (2, "e f")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in katz_lm.score_documents(docs, F.col("doc_id") % 2 == 1).collect()}
    lines = [t.split() + [""] for _, t in rows]
    count, pairs = {}, {}
    for line in lines:
        for h, w in zip([None, *line], line, strict=False):
            count[w] = count.get(w, 0) + 1
            pairs[h, w] = pairs.get((h, w), 0) + 1
    of = lambda c: {r: sum(v == r for v in c.values()) for r in range(1, katz_lm.K + 2)}
    uni, d = katz_lm.Unigrams(sum(count.values()), len(count), of(count)), katz_lm.good_turing(of(pairs))

    def p(h, w):
        whole = len(rows) if h is None else count[h]
        seen = {b: c for (a, b), c in pairs.items() if a == h}
        if not seen:
            return float(uni.probability(count[w]))
        share = sum((d[c] if c <= katz_lm.K else 1) * c for c in seen.values()) / whole
        rest = max(1 - share, 0.5 / (whole + 1))
        if w in seen:
            return (1 - rest) / share * (d[seen[w]] if seen[w] <= katz_lm.K else 1) * seen[w] / whole
        return rest / (1 - sum(float(uni.probability(count[x])) for x in seen)) * float(uni.probability(count[w]))

    assert pairs["e", "f"] == pairs["f", ""] == 1
    assert math.isclose(got[2], sum(math.log10(p(h, w)) for h, w in [(None, "e"), ("e", "f"), ("f", "")]), rel_tol=1e-9)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_with_a_changed_word_are_near(spark):
    one = "Ening thheeaan. That ha thnt to of of nd inntble and so on it goes here."
    docs = [(1, one), (2, one.replace("thnt to of", "thnt into of")), (3, one.replace("thheeaan", "thxxyyan")), (4, one.replace("nd inntble and so on", "of quite another kind"))]
    out = {r.doc_id: r.n_near for r in line_edit_join.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: 0, 2: 1, 3: 1, 4: 0}


def test_lines_go_by_the_edits_their_length_allows(spark):
    rng, rows = random.Random(11), []
    base = ["".join(rng.choice("abcdefé ") for _ in range(rng.randint(20, 75))) for _ in range(40)]
    for _ in range(220):
        line = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 7])):
            at = rng.randrange(len(line))
            line[at : at + rng.choice([0, 1])] = rng.choice(["", "x", "y"])
        rows.append("".join(line))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: (r.n_equal, r.n_near) for r in line_edit_join.dedup_lines(docs).collect()}
    for i, line in enumerate(rows):
        before = [] if len(line) < 20 else [o for o in rows[:i] if len(o) >= 20]
        near = any(edits(line, o) <= min(6, max(2, min(len(line), len(o)) // 10)) for o in before)
        assert out[i] == ((1, 0) if line in before else (0, int(near))), (i, line)


def pipeline_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline_keeps_documents_whose_own_lines_are_short(spark):
    head = "A license line that many documents share."
    docs = pipeline_docs(spark, [(1, head + "\nfirst", "s"), (2, head + "\nEn, de asja con.", "s"), (3, head + "\nfirst\n ", "s"), (4, head, "s"), (5, "first\nown", "s"), (6, "", "s")])
    out = {r.doc_id: r.text for r in corpus_pipeline.remove_lines(spark, docs, "").collect()}
    assert out == {1: head + "\nfirst", 2: "En, de asja con.", 5: "own", 6: ""}


def test_pipeline_keeps_one_row_of_each_group_of_near_copies(spark):
    words = [f"w{k}" for k in range(60)]
    near, other, clean, third = " ".join(words), " ".join([*words[:-1], "x"]), "a clean text that shares its id with a copy", " ".join(words[::-1])
    rows = [(1, near, "s"), (1, near, "s"), (1, other, "s"), (2, other, "s"), (2, clean, "s"), (None, near, "s"), (None, third, "s"), (None, third, "t"), (None, third + " y", "s"), (3, "", "s"), (3, "", "s"), (9, "the same row twice and more", "s"), (9, "the same row twice and more", None)]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.remove_near_duplicates(spark, pipeline_docs(spark, rows), "").collect()]
    ids = lambda *texts: [i for i, t in got if t in texts]
    assert ids(near, other) == [1]
    assert ids(clean) == [2] and ids(third, third + " y") == [None] and ids("the same row twice and more") == [9] and ids("") == [3, 3]
    assert len(got) == 6


def test_pipeline_mixes_rows_without_an_id(spark):
    rows = [(None if k % 3 == 0 else k // 2, f"text {k} of some words", "a" if k % 2 else "b" if k % 4 else None) for k in range(48)]
    docs = pipeline_docs(spark, rows)
    out = corpus_pipeline.mix(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    got = collections.Counter(map(tuple, out.collect()))
    assert set(got) <= set(map(tuple, docs.collect()))  # texts differ
    by_source = collections.Counter()
    for r, n in got.items():
        by_source[r[3]] += 5 * n
    targets = {r.source: (r.target, r.taken) for r in entropy_mix.mix_sources(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()}
    assert len(targets) == 3 and all(abs(target - by_source[s]) < 5 and taken == by_source[s] for s, (target, taken) in targets.items())
    assert any(r[0] is None for r in got)


def test_short_lines_that_repeat_go(spark, tmp_path):
    texts = [(1, "Les.\n\nown"), (2, "Les.\nLes!\n \n"), (3, "Les!\nA line of more than twenty signs.")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.n_equal, r.n_near, r.kept_sha256) for r in line_edit_join.op5_line_edit_join(spark, str(tmp_path)).collect()}
    kept = {1: (0, "Les.\n\nown"), 2: (1, "Les!\n \n"), 3: (1, "A line of more than twenty signs.")}
    assert out == {i: (n, 0, hashlib.sha256(t.encode()).hexdigest()) for i, (n, t) in kept.items()}


def test_secret_field_learns_from_long_lines_and_decides_alone(spark):
    line = "x " * 3000 + "api_key = 'sk{}Q2hf73Kd92mfK2lq0' " + "y " * 30
    late = "some words\n" * 80 + "api_key = 'sk{}Q2hf73Kd92mfK2lq0'"
    for text in (line, late):
        docs = spark.createDataFrame([(i, text.format(i)) for i in range(40)], "id long, text string")
        field = secret_crf.train_field(docs)
        assert secret_crf.Scanner(field).scan("my key = sk_live4eC39HqLyjWDarjtT1zdp7dc") == [(9, 3, 40)]
    field.viterbi = lambda e: np.array([secret_crf.O, secret_crf.B, secret_crf.O, secret_crf.B])
    assert secret_crf.Scanner(field).scan("pwd correcthorse is abc") == [(4, 3, 16), (20, 3, 23)]


def test_near_lines_across_classes_of_length(spark):
    rng, rows = random.Random(3), []
    for size in (28, 31, 39, 41, 50, 58, 61, 88, 91, 139, 142, 208, 322, 730):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(size)]
        rows.append("".join(base))
        for _ in range(12):
            line = list(base)
            for _ in range(rng.randint(1, 8)):
                at = rng.choice([0, len(line), rng.randrange(len(line))])
                line[at : at + rng.choice([0, 1])] = rng.choice(["", "X", "Y"])
            rows.append("".join(line))
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: r.n_near for r in line_edit_join.dedup_lines(docs).collect()}
    want = {i: int(any(abs(len(x) - len(y)) <= 6 and edits(x, y) <= min(6, max(2, min(len(x), len(y)) // 10)) for y in rows[:i]) and x not in rows[:i]) for i, x in enumerate(rows)}
    assert out == want and 60 < sum(want.values()) < len(rows) - 14


def test_lines_that_share_a_key_only_are_not_paired(spark, monkeypatch):
    rng, pairs, near = random.Random(5), [], line_edit_join._near
    monkeypatch.setattr(line_edit_join, "_near", lambda p, *rest: pairs.append(p.distinct().count()) or near(p, *rest))
    rows = ["the same beginning: " + "".join(rng.choice("eniatrsodh ") for _ in range(45)) for _ in range(150)]
    rows.append(rows[7][:40] + "xyz" + rows[7][42:])
    out = {r.doc_id: r.n_near for r in line_edit_join.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert out == {i: int(i == 150) for i in range(151)}
    assert sum(pairs) < 1500  # of 11,325


def test_sketches_and_trimming_leave_near_lines_near(spark):
    rng, rows = random.Random(8), []
    for _ in range(150):
        a = [rng.choice(" eniatrsodhulcmwfgé😀,T") for _ in range(rng.choice([0, 3, 20, 64, 300]))]
        b = list(a)
        for _ in range(rng.randint(0, 7)):
            at = rng.randint(0, len(b))
            b[at : at + rng.choice([0, 1])] = rng.choice(["", "e", "😀", "z"])
        rows.append(("".join(a), "".join(b)))
    differ = sum(F.bit_count(line_edit_join.sketch(F.col("a"), x).bitwiseXOR(line_edit_join.sketch(F.col("b"), x))) for x in line_edit_join.LETTERS)
    m = line_edit_join._trimmed(F.struct("a", "b"))
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", differ.alias("differ"), m.alias("m")).collect():
        d = edits(r.a, r.b)
        assert r.differ <= 2 * d and edits(r.m.a, r.m.b) == d


def test_katz_tables_are_stored_packed_and_whole(spark, monkeypatch):
    stored, store = [], katz_lm._store
    monkeypatch.setattr(katz_lm, "_store", lambda df, where: stored.append(store(df, where)) or stored[-1])
    lines = ["a b c d a b", "a c b d", "", "e a b f"]
    katz_lm.score_documents(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), F.col("doc_id") < 9).collect()
    words, pairs = collections.Counter(), collections.Counter()
    for line in lines:
        tokens = line.split() + [""]
        words.update(tokens)
        pairs.update(zip([None, *tokens], tokens, strict=False))
    one, two = (katz_lm.table_rows(x[1]).collect() for x in stored)
    assert sorted(r.y for r in one) == sorted(words.values()) and len({r.x for r in one}) == len(words)
    assert sorted(r.z for r in two) == sorted(pairs.values()) and len({(r.x, r.y) for r in two}) == len(pairs)
    count, n = {r.x: r.y for r in one}, lambda w: len(lines) if w is None else words[w]
    assert sorted((count.get(r.x, len(lines)), count[r.y], r.z) for r in two) == sorted((n(h), words[w], k) for (h, w), k in pairs.items())
    assert stored[1][1].agg(F.sum("x")).first()[0] == len(pairs)
    monkeypatch.setattr(katz_lm, "TABLE_ROWS", 3)
    x = np.arange(7) * 5 - 3
    parts = [b.to_pylist()[0] for b in katz_lm._table_rows(2, x, x + 1, x + 2)]
    y, z = (np.concatenate([katz_lm._numbers(r["b"], np.int64).reshape(2, -1)[k] for r in parts]) for k in (0, 1))
    assert [r["x"] for r in parts] == [3, 3, 1] and (y == x + 1).all() and (z == x + 2).all()
    assert (np.concatenate([np.cumsum(katz_lm._numbers(r["a"], np.int64)) for r in parts]) == x).all()


def test_tilts_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(2)
    rows = [(f"s{k % 3}", 1 + k // 3, rng.randint(1, 9)) for k in range(600)]
    targets = spark.createDataFrame([(f"s{k}", w * sum(z * n for s, z, n in rows if s == f"s{k}")) for k, w in enumerate((0.3, 1.7, 2.6))], "s string, target double")
    got = set()
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        classes = spark.createDataFrame(rows, "source string, size long, n long").repartition(seed + 2)
        got.add(tuple(sorted(map(tuple, entropy_mix.newton_tilts(classes, targets).collect()))))
    assert len(got) == 1
