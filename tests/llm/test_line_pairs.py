"""Which pairs the join of near lines makes: all near ones, seldom twice, and few others."""

import collections
import random

from pyspark.sql import functions as F
from skein.llm import line_edit_join

from tests.llm.test_whole_job import edits


def variants(seed, count, words=60):
    """A line whose words are changed here and there: most of its variants share many keys, and few are near."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("eniatrsodh") for _ in range(rng.randint(3, 8)))
    base, rows = [word() for _ in range(words)], []
    for _ in range(count):
        line = list(base)
        for _ in range(rng.randint(1, 3)):
            line[rng.randrange(words)] = word()
        rows.append(" ".join(line))
    return rows


def near(rows):
    allowed = lambda x, y: min(6, max(2, min(len(x), len(y)) // 10))
    return {i: int(x not in rows[:i] and any(abs(len(x) - len(y)) <= 6 and edits(x, y) <= allowed(x, y) for y in rows[:i])) for i, x in enumerate(rows)}


def test_lines_that_meet_in_many_keys_are_few_pairs(spark, monkeypatch):
    made, judge = [], line_edit_join._near
    monkeypatch.setattr(line_edit_join, "_near", lambda p, *rest: made.append((p.count(), p.distinct().count())) or judge(p, *rest))
    rows = variants(4, 70, 28)
    out = {r.doc_id: r.n_near for r in line_edit_join.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert out == near(rows)
    count, distinct = made[1]
    assert distinct > 100 and count < 1.5 * distinct  # some meet in a moved segment too


def test_lines_are_near_where_nothing_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_edit_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(line_edit_join, "BROADCAST_CHARS", 0)
    rows = variants(6, 40, 11) + variants(7, 25, 5) + ["a line of its own that is near to none"]
    out = {r.doc_id: r.n_near for r in line_edit_join.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert out == near(rows) and sum(out.values()) > 0


def test_each_move_of_a_segment_has_one_meeting():
    for reach in range(8):
        at, roles = line_edit_join.places(reach), line_edit_join.roles(reach)
        meetings = [at[b] - at[a] for a in range(len(at)) for b in range(a, len(at)) if roles[a][1] & roles[b][0]]
        assert sorted(meetings) == list(range(reach + 1))
        assert all(bool(x[1] & y[0]) == bool(y[1] & x[0]) for x in roles for y in roles)


def test_only_lines_that_may_be_a_pair_contest_a_key(spark):
    rng = random.Random(1)
    line = lambda size, signs: "".join(rng.choice(signs) for _ in range(size))

    def contested(*rows):
        lines = line_edit_join._lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), 20)
        got = line_edit_join.contested_keys(line_edit_join.segment_keys(lines), line_edit_join.role_table(None, 20))
        return collections.Counter(r.key for r in got.collect())

    x, y = line(150, "abcde"), line(150, "vwxyz")
    assert contested(x, y[:61] + x[61:78] + y[78:]) == {}  # the second place of the segment from 60, in both: not the segment
    assert contested(x, x) == {}
    x, y = line(78, "abcde"), line(78, "vwxyz")
    assert contested(x, x[:10] + y[10:]) == {}  # a segment of the class below, of which is neither
    assert set(contested(x, x[:11] + y[11:]).values()) == {2}
    assert set(contested(x[:76], x[:10] + y[10:]).values()) == {2}


def test_half_sketches_differ_by_two_bits_an_edit(spark):
    rng, rows = random.Random(9), []
    for k in range(400):
        a = [rng.choice(" eniatrsodhulcmwfgé😀,T") for _ in range(rng.choice([0, 1, 20, 65, 300]))]
        b = list(a)
        for _ in range(rng.randint(0, 7)):
            at = rng.randint(0, len(b)) // (1 + k % 3)
            b[at : at + rng.choice([0, 1])] = rng.choice(["", "e", "😀", "z"]) if k % 2 else rng.choice("eq")
        rows.append(("".join(a), "".join(b)))
    sketched = lambda c: [(r.s0, r.s1) for r in line_edit_join.half_sketches(spark.createDataFrame([(i, r[c], len(r[c])) for i, r in enumerate(rows)], "i long, line string, size int")).orderBy("i").collect()]
    for (a, b), x, y in zip(rows, sketched(0), sketched(1), strict=True):
        assert sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True)) <= 2 * edits(a, b) + abs(len(a) - len(b)) % 2, (a, b)
