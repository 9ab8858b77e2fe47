"""Registered queries against plain Python (or SQL) over the same whole tables, where they have no SQL of their own."""

import hashlib
import math
import re
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from skein.llm import entropy_mix, jaccard_join, language_id, line_edit_join, quality_rules, secret_crf

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def test_op2_covers_all_and_predicts_held_out_languages(spark, documents):
    out = {r.doc_id: r for r in language_id.op2_language_id(spark, SF).collect()}
    assert set(out) == {d["doc_id"] for d in documents}
    known = {d["lang"] for d in documents if d["lang"] and zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2}
    right = total = 0
    for d in documents:
        r = out[d["doc_id"]]
        assert r.held_out == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) and 0 <= r.score <= 1
        blank = not any(c.isalpha() for c in d["text"] or "")
        assert r.lang_pred == "und" if blank else r.lang_pred in known
        if r.held_out and d["lang"] and not blank:
            right, total = right + (r.lang_pred == d["lang"]), total + 1
    assert right >= 0.8 * total > 0


def test_op5_against_the_edit_distance_of_all_pairs(spark):
    con = duckdb.connect()
    con.sql(f"""CREATE TABLE l AS SELECT doc_id, CAST(no AS INT) AS no, line, length(line) AS n FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM '{SF}/documents.parquet')""")
    con.sql("CREATE TABLE f AS SELECT line, n, min(struct_pack(d := doc_id, k := no)) AS first FROM l WHERE regexp_matches(line, '\\S') GROUP BY ALL")
    allowed = "least(6, greatest(2, least(a.n, b.n) // 10))"
    # SQL's distance is one of bytes, at most twice that of characters in these texts; what it leaves is decided in Python.
    close = con.sql(f"SELECT a.line, b.line, {allowed} FROM f a JOIN f b ON a.first < b.first AND a.n >= 20 AND b.n >= 20 AND abs(a.n - b.n) <= {allowed} AND levenshtein(a.line, b.line) <= 2 * {allowed}").fetchall()
    con.execute("CREATE TABLE near (line VARCHAR)")
    for line in {y for x, y, most in close if edits(x, y) <= most}:
        con.execute("INSERT INTO near VALUES (?)", [line])
    want = {r[0]: r[1:] for r in con.sql("""SELECT l.doc_id, count(*), count(*) FILTER (f.line IS NOT NULL AND struct_pack(d := l.doc_id, k := l.no) > f.first),
        count(*) FILTER (f.line IS NOT NULL AND struct_pack(d := l.doc_id, k := l.no) = f.first AND near.line IS NOT NULL) FROM l LEFT JOIN f USING (line) LEFT JOIN near USING (line) GROUP BY l.doc_id""").fetchall()}
    got = {r.doc_id: (r.n_lines, r.n_equal, r.n_near) for r in line_edit_join.op5_line_edit_join(spark, SF).collect()}
    assert {k: v for k, v in got.items() if k in want} == want and sum(v[1] for v in want.values()) > 0


def test_op6_against_all_pairs(spark, documents):
    sets = {}
    for d in documents:
        w = WORD.findall((d["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[d["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op6_jaccard_join(spark, SF).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in ids}


def test_op7_targets_and_takes(spark, documents):
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in documents}
    source = {d["doc_id"]: d["source"] for d in documents}
    names = sorted({s for s in source.values() if s is not None}) + ([None] if None in source.values() else [])
    whole = {s: sum(n for i, n in size.items() if source[i] == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, closed = {}, set()
    while True:
        rest = sum(whole.values()) - sum(3 * whole[s] for s in closed)
        level = rest / sum(weight[s] for s in names if s not in closed)
        above = {s for s in names if s not in closed and level * weight[s] > 3 * whole[s]}
        if not above:
            break
        closed |= above
    target = {s: 3.0 * whole[s] if s in closed else level * weight[s] for s in names}
    rows = entropy_mix.op7_entropy_mix(spark, SF).collect()
    taken = dict.fromkeys(names, 0)
    for r in rows:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == whole[s] and math.isclose(r.target, target[s], rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] += r.taken
    # Documents are whole: a source of a few documents comes as near as one of them allows.
    largest = {s: max(n for i, n in size.items() if source[i] == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= max(0.01 * target[s], largest[s]) for s in names)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, entropy_mix.op7_entropy_mix(spark, SF).collect()))


def test_entropy_balancing_is_solved_by_tilts_that_vary_with_size(spark):
    import random

    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), f"s{i % 5}" if i % 5 else None) for i in range(400)]
    out = entropy_mix.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    for s, own in by.items():
        # The gradient of the dual is zero, and rates are one exponential tilt of the sizes, cut at the cap.
        assert math.isclose(sum(r.size * r.rate for r in own), own[0].target, rel_tol=1e-8), s
        tilts = {round(math.log(r.rate) / r.size, 9) for r in own if r.rate < 3 - 1e-9}
        assert len(tilts) <= 1
    assert max(len({round(r.rate, 9) for r in own}) for own in by.values()) > 10


def test_op9_base_spans_and_digests(spark):
    where = "/root/testdata/sf0.01"
    documents = pq.read_table(f"{where}/documents.parquet").to_pylist()
    kinds = {"assign": re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    got = {r.doc_id: r for r in secret_crf.op9_secret_crf(spark, where).collect()}
    assert set(got) == {d["doc_id"] for d in documents}
    some = 0
    for d in documents:
        spans = []
        for k, (kind, pattern) in enumerate(kinds.items()):
            for m in pattern.finditer(d["text"] or ""):
                if len(m[1] if kind == "assign" else m[0]) >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                    spans.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        base = [s for *_, s in sorted(spans)]
        r = got[d["doc_id"]]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in kinds)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""}
        some += len(base)
    assert some


def test_op10_counts_and_base_rule(spark, documents):
    got = {r.doc_id: r for r in quality_rules.op10_quality_rules(spark, SF).collect()}
    for d in documents:
        text = d["text"] or ""
        words = WORD.findall(text)
        seen = {}
        for i in range(len(words) - 2):
            seen.setdefault(tuple(words[i : i + 3]), []).append(i)
        covered = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[d["doc_id"]]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and (not r.base_failed or not r.kept)
    # The verdict of the method: cutoffs chosen on labels reject no more than the rows that fail a chosen rule.
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    full = quality_rules.apply_quality_rules(docs, labels)
    assert full.filter("not base_failed and (kept <> (size(failed_rules) = 0))").count() == 0
    assert full.filter(F.col("kept")).count() > 0
