"""Line dedup by a segment-partition edit join.

A line goes if an earlier line (by doc_id, nulls first, then place, then text) of the input is equal or within the edits that their
length allows (or a flat `threshold`). Lines are dealt to classes of length; the class of the shorter of two lines sets the edits t
and the size of t + 1 segments: the first ones are counted from the start of a line, the last ones from its end. Of two lines
within t edits, some segment i of one lies unchanged in the other, moved by at most i from the start and t - i from the end. A segment gives
the hashes of the few substrings of it whose places differ by every such move (`places`), so both lines give one hash in common
wherever it lies: 15 keys a line at 6 edits. One pair of places stands for each move (`roles`), and one of two lines must be of the class
that is read, so lines that only meet otherwise are no pair of that key. Keys are shuffled once, and those without such a pair go where
they arrive. The sketches of a line's halves count letters; an edit moves two counts by one, so pairs whose sketches differ by more are never
made, and a pair that has several unmoved segments in common is made in one of them. The lines of a key are first held against its earliest line, and only those that are not near to that one against the
others. Pairs are verified by the banded bit-parallel edit distance: a band of 2t + 1 bits moves along the diagonal.

Only DataFrame functions. Equal lines are known by two 64-bit hashes; occurrences of equal lines collapse before they are shuffled.
"""

from __future__ import annotations

import functools
import gc
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, let, parts_for, table

MIN_CHARS = 20
#: Two lines are near within an edit for each CHARS_PER_EDIT characters of the shorter, at least LEAST and at most MOST: a changed word is.
LEAST, MOST, CHARS_PER_EDIT = 2, 6, 10
#: Least lengths of the classes of length; edits are the same within a class, and no class is narrower than the most edits. Those of short lines
#: are narrow: a longer substring has fewer lines in common, which counts for more than the lines that read two classes.
CLASSES = (20, 30, 40, 50, 60, 70, 77, 91, 112, 140, 210, 320, 480, 720)
#: Rows of two longs that may be broadcast; beyond it the joins are shuffled.
BROADCAST_ROWS = 1_000_000
#: Bits of a key; two that meet by chance only make a pair more.
KEY_BITS = 40
#: Bits of h1 beside a key. Lines that share them are told apart by h1 and h2 later, but two that meet only each other count as one there (a chance of 2^-48 for a pair).
LINE_BITS = 48
#: A line's two sketches, of its halves, count these single bytes, a frequent and a rare one together; lines of other scripts have weaker sketches and so more pairs to verify.
LETTERS = (" eniatrsodhulcm", "wfgbypvkjqz.,IT")
COUNTED = [x + y for x, y in zip(LETTERS[0], reversed(LETTERS[1]), strict=True)]
#: Characters of texts that may be broadcast; beyond it the texts of pairs are shuffled.
BROADCAST_CHARS = 50_000_000


def edits_allowed(length: Column, threshold: int | None) -> Column:
    """How many edits two lines may be apart, by the length of the shorter."""
    return F.lit(threshold) if threshold is not None else F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.floor(length / CHARS_PER_EDIT))).cast("int")


def places(reach: int) -> list[int]:
    """The smallest set of places of its form, of which two differ by each of 0 to reach: 0 to m - 1, and each m-th from 2m - 1."""
    sets = [[*range(m), *range(2 * m - 1, reach + m, m)] for m in range(1, reach + 2)]
    return min(sets, key=lambda x: (len(x), x[-1]))


def roles(reach: int) -> list[tuple[int, int]]:
    """For each of the places: its bit, and the bits of those it meets. A whole segment in common, moved by any number, shows in one such meeting."""
    at = places(reach)
    meets = [0] * len(at)
    for move in range(reach + 1):
        a, b = next((a, b) for a in range(len(at)) for b in range(a, len(at)) if at[b] - at[a] == move)
        meets[a] |= 1 << b
        meets[b] |= 1 << a
    return [(1 << k, m) for k, m in enumerate(meets)]


def substrings(threshold: int | None, min_chars: int) -> list[tuple[int, int, int, int, int, int, tuple[int, int, int]]]:
    """Class, length that lines of the class above must be under, segment, place (negative: from the end), size, class that reads it, and its role with 1 if that is the same class."""
    lows = [min_chars, *(x for x in CLASSES if x > min_chars)]
    out = []
    for c, low in enumerate(lows):
        edits = threshold if threshold is not None else min(MOST, max(LEAST, low // CHARS_PER_EDIT))
        block = low // (edits + 1)
        for i in range(edits + 1):
            at = places(min(i, edits - i))
            if block <= at[-1]:
                raise ValueError(f"lines of {low} characters are too short for {edits} edits")
            begin = i * block if i <= edits - i else -(edits + 1 - i) * block
            for a, role in zip(at, roles(min(i, edits - i)), strict=True):
                out += [(c, lows[u] + edits if u > c else 2**31 - 1, i, begin + a, block - at[-1], u, (*role, int(u == c))) for u in (c, c + 1) if u < len(lows)]
    return out


def segment_keys(lines: DataFrame, threshold: int | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """h (bits of h1 of the line) and key: hashes of substrings, of which two lines within the edits allowed share one; above KEY_BITS the number of the role in `role_table`."""
    lows = [min_chars, *(x for x in CLASSES if x > min_chars)]
    number = {r: k for k, r in enumerate(role_table(threshold, min_chars))}
    # An expression and no table: equal plans are known as equal, so that keys are shuffled once.
    read = lambda u, size: f"array({', '.join(f'struct({c} as c, {i} as i, {at} as at, {chars} as chars, {number[role]}L as role)' for c, under, i, at, chars, of, role in substrings(threshold, min_chars) if of == u and size < under)})"
    under = [next((x[1] for x in substrings(threshold, min_chars) if x[5] == k and not x[6][2]), 0) for k in range(len(lows))]  # lines shorter than that read the class below too
    reads = [read(k, size) for k in range(len(lows)) for size in (0, 2**31 - 2)][1:]
    which = sum((F.when(F.col("size") >= at, 1).otherwise(0) for k in range(1, len(lows)) for at in (lows[k], under[k])), F.lit(0))
    out = lines.select("h", "size", "line", F.explode(F.get(F.expr(f"array({', '.join(reads)})"), which)).alias("r")).select("h", "size", "line", "r.*")
    at = F.when(F.col("at") < 0, F.col("size") + F.col("at")).otherwise(F.col("at"))
    key = F.xxhash64("c", "i", F.substr("line", at + 1, F.col("chars"))).bitwiseAND(F.lit(2**KEY_BITS - 1))
    return out.select("h", key.bitwiseOR(F.shiftleft("role", KEY_BITS)).alias("key"))


def role_table(threshold: int | None, min_chars: int) -> list[tuple[int, int, int]]:
    """Bit of the place, bits of the places it meets, 1 if the line is of the class that is read."""
    return sorted({x[-1] for x in substrings(threshold, min_chars)})


def contested_keys(keys: DataFrame, table: list[tuple[int, int, int]]) -> DataFrame:
    """h, key and role of the rows that meet another line's in their key, each once."""
    role = F.shiftright("key", KEY_BITS).cast("int")
    of = lambda role, k: F.get(F.expr(f"array({', '.join(str(x[k]) for x in table)})"), role)
    own = max(x[0] for x in table) * 2  # the bit of a line of the class that is read
    low = F.col("key").bitwiseAND(F.lit(2**KEY_BITS - 1))
    keys = keys.repartition(low).select("h", low.alias("key"), role.alias("role"))
    shared = keys.groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most"), F.bit_or(of(F.col("role"), 0).bitwiseOR(of(F.col("role"), 2) * own)).alias("there"))
    shared = shared.filter((F.col("least") != F.col("most")) & (F.col("there") >= own)).select("key", "there")
    both = keys.join(shared.hint("shuffle_hash"), "key")  # a semi-join would go below the shuffle, and make a second one
    return both.filter(of(F.col("role"), 1).bitwiseAND(F.col("there")) != 0).select("h", "key", "role").distinct()


def _meet(x: str, y: str, table: list[tuple[int, int, int]]) -> Column:
    """Whether two roles in one key are a pair's."""
    n = len(table)
    meet = ", ".join(str(bool(p[1] & q[0] and p[2] | q[2])).lower() for p in table for q in table)
    return F.get(F.expr(f"array({meet})"), F.col(x) * n + F.col(y))


def _counted(x: Column, letters: Sequence[str]) -> Column:
    without = lambda some: functools.reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), some, x)
    of = [(F.octet_length(x) - F.octet_length(without(some))).cast("long").bitwiseAND(F.lit(7)) for some in letters]
    return functools.reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(n, 4 * k) for k, n in enumerate(of)])


def _coded(n: Column) -> Column:
    ones = F.lit(0x111111111111111)
    a, b, d = n.bitwiseAND(ones), F.shiftright(n, 1).bitwiseAND(ones), F.shiftright(n, 2).bitwiseAND(ones)
    bits = [d.bitwiseXOR(a.bitwiseOR(b)), d.bitwiseXOR(b), d.bitwiseXOR(a.bitwiseAND(b)), d]
    return functools.reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(x, k) for k, x in enumerate(bits)])


def sketch(line: Column, letters: Sequence[str]) -> Column:
    """60 bits: how often each of 15 letters (or the letters of each of 15 strings) stands in a line, modulo 8, in a code that changes one bit a step.

    An edit takes one character and adds one at most, so sketches (of different letters, together) of lines within t edits differ in at most 2t bits.
    """
    return let(_counted(line, letters), _coded)


def half_sketches(lines: DataFrame) -> DataFrame:
    """s0 and s1 instead of line: sketches of its halves. Together they differ, for lines within t edits, in at most 2t bits, and one more if their sizes differ by an odd number.

    Cut both lines where the half of the first ends in their alignment. What stands between that cut and the half of the second is in one sketch
    too many and in the other too few; it is at most half as long as characters are added and taken, and half a character more where the sizes' difference is odd.
    """
    half = F.floor(F.col("size") / 2).cast("int")
    # Columns by steps, as each is read many times.
    lines = lines.withColumns({"s0": F.substr("line", F.lit(1), half), "s1": F.substr("line", half + 1, F.col("size"))}).drop("line")
    lines = lines.withColumns({c: _counted(F.col(c), COUNTED) for c in ("s0", "s1")})
    return lines.withColumns({c: _coded(F.col(c)) for c in ("s0", "s1")})


def _may_be_near(x: str, y: str, threshold: int | None) -> Column:
    """Whether the lengths and the sketches of two lines leave it open that they are within the edits allowed."""
    sizes = F.col(f"{x}size"), F.col(f"{y}size")
    edits = edits_allowed(F.least(*sizes), threshold)
    differ = [F.bit_count(F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}"))) for k in ("s0", "s1")]
    return (F.abs(sizes[0] - sizes[1]) <= edits) & (functools.reduce(lambda p, q: p + q, differ) <= 2 * edits + F.abs(sizes[0] - sizes[1]) % 2)


def banded_distance(longer: Column, shorter: Column, threshold: int = MOST) -> Column:
    """The edit distance of two strings if it is at most threshold, else more than threshold; longer has the more characters.

    Bit k of a column's vectors is row j + k - threshold; the score follows the diagonal that ends in the last cell.
    """
    m = (1 << (2 * threshold + 1)) - 1

    def run(p: Column) -> Column:
        a, b = p["a"], p["b"]
        gap = F.size(a) - F.size(b)

        def step(s: Column, j: Column) -> Column:
            c = F.get(b, j)  # from 0; row r of the band is character j + k - threshold of a
            match = F.lit(0)
            for k in range(2 * threshold + 1):
                match = match + F.when(F.coalesce(F.get(a, j + (k - threshold)) == c, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0))

            def vertical(x: Column) -> Column:
                vp, vn = s["vp"], s["vn"]
                d0 = (((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn)).bitwiseAND(F.lit(m))
                return F.struct(d0.alias("d0"), vn.bitwiseOR(F.lit(m).bitwiseXOR(d0.bitwiseOR(vp))).alias("hp"), d0.bitwiseAND(vp).alias("hn"))

            def follow(h: Column) -> Column:
                half = F.shiftright(h["d0"], 1)
                bit = F.when(gap == 0, F.shiftright(h["d0"], threshold))
                for g in range(1, threshold + 1):
                    bit = bit.when(gap == g, F.shiftright(h["d0"], threshold + g))
                return F.struct(
                    h["hn"].bitwiseOR(F.lit(m).bitwiseXOR(half.bitwiseOR(h["hp"]))).alias("vp"),
                    half.bitwiseAND(h["hp"]).alias("vn"),
                    (s["score"] + 1 - bit.bitwiseAND(F.lit(1))).alias("score"),
                )

            return F.transform(F.transform(F.array(match), vertical), follow)[0]

        start = F.struct(F.lit(m & ~((1 << threshold) - 1)).alias("vp"), F.lit(0).alias("vn"), gap.alias("score"))
        places = F.when(F.size(b) > 0, F.sequence(F.lit(0), F.size(b) - 1)).otherwise(F.array().cast("array<int>"))
        return F.when(gap > threshold, gap).otherwise(F.aggregate(places, start, step)["score"])

    chars = F.array(F.struct(F.filter(F.split(longer, ""), lambda x: x != "").alias("a"), F.filter(F.split(shorter, ""), lambda x: x != "").alias("b")))
    return F.transform(chars, run)[0]


def _trimmed(pair: Column) -> Column:
    """a and b without what both begin and end with, in whole steps of 16 characters: the edit distance stays."""
    size = lambda p: F.least(F.length(p["a"]), F.length(p["b"]))
    steps = lambda p: F.transform(F.sequence(F.lit(0), F.floor(size(p) / 16).cast("int")), lambda k: k * 16)
    head = lambda p: F.array_max(F.filter(steps(p), lambda k: F.substr(p["a"], F.lit(1), k) == F.substr(p["b"], F.lit(1), k)))
    end = lambda x, k: F.substr(x, F.length(x) - k + 1, k)
    tail = lambda p: F.array_max(F.filter(steps(p), lambda k: end(p["a"], k) == end(p["b"], k)))
    behind = lambda p: let(head(p), lambda k: F.struct(F.substr(p["a"], k + 1, F.length(p["a"]) - k).alias("a"), F.substr(p["b"], k + 1, F.length(p["b"]) - k).alias("b")))
    before = lambda p: let(tail(p), lambda k: F.struct(F.substr(p["a"], F.lit(1), F.length(p["a"]) - k).alias("a"), F.substr(p["b"], F.lit(1), F.length(p["b"]) - k).alias("b")))
    return let(let(pair, behind), before)


def _judged(line: Column, size: Column, min_chars: int, equal_chars: int | None) -> Column:
    """Lines of at least min_chars characters, and others that are not blank of at least equal_chars."""
    return (size >= min_chars) | F.lit(equal_chars is not None) & (size >= F.lit(equal_chars)) & line.rlike(r"\S")


def _owner(doc_id: Column, text: Column) -> Column:
    """A number that orders rows by doc_id (nulls first), with room for the place of a line (31 bits), then by 31 bits of a hash of the text."""
    key = F.coalesce(doc_id.cast("decimal(38,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(38,0)"))
    return (key * F.lit(str(2**62)).cast("decimal(38,0)") + F.xxhash64(text).bitwiseAND(F.lit(2**31 - 1)).cast("decimal(38,0)")).cast("decimal(38,0)")


def _at(no: Column) -> Column:
    return (no.cast("decimal(38,0)") * F.lit(2**31).cast("decimal(38,0)")).cast("decimal(38,0)")


def _lines(docs: DataFrame, min_chars: int, equal_chars: int | None = None) -> DataFrame:
    """The judged lines: place, no, line, size, h1, h2; places order the lines of all documents."""
    out = docs.select(_owner(F.col("doc_id"), F.col("text")).alias("owner"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    out = out.withColumn("size", F.length("line")).filter(_judged(F.col("line"), F.col("size"), min_chars, equal_chars))
    place = (F.col("owner") + _at(F.col("no"))).cast("decimal(38,0)")
    out = out.select(place.alias("place"), "no", "line", "size", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"))
    return out.withColumn("h", F.col("h1").bitwiseAND(F.lit(2**LINE_BITS - 1)))


def _release(spark: SparkSession) -> None:
    """Spark removes the files of a shuffle when the driver collects the plan that made it; a cut plan is not used again."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _near(pairs: DataFrame, lines: DataFrame, known: DataFrame, threshold: int | None) -> DataFrame:
    """id of the later lines (b) of pairs (a, b) of ids that are within the edits allowed; known has the ids' hashes."""
    most = MOST if threshold is None else threshold
    pairs = cut(pairs.distinct())
    ids = cut(known.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id").select("id", "h1", "h2"))
    few = ids.count() <= BROADCAST_ROWS
    texts = cut(lines.select("h1", "h2", "line").join(F.broadcast(ids) if few else ids, ["h1", "h2"]).select("id", "line").distinct())
    few = (texts.agg(F.sum(F.length("line"))).first()[0] or 0) <= BROADCAST_CHARS
    xs, ys = texts.selectExpr("id as a", "line as x"), texts.selectExpr("id as b", "line as y")
    parts = parts_for(pairs.sparkSession, 0)
    both = pairs.repartition(parts).join(F.broadcast(xs), "a").join(F.broadcast(ys), "b") if few else pairs.join(xs, "a").join(ys, "b")
    x, y = F.col("x"), F.col("y")
    both = both.filter((F.abs(F.length(x) - F.length(y)) <= most) & (F.levenshtein(x, y, most) >= 0))  # many pairs fail this; what follows is dear
    longer, shorter = F.when(F.length(x) >= F.length(y), x).otherwise(y), F.when(F.length(x) >= F.length(y), y).otherwise(x)
    middle = let(F.struct(longer.alias("a"), shorter.alias("b")), _trimmed)
    both = both.select("b", F.length(shorter).alias("size"), middle.alias("m"))
    near = both.filter(banded_distance(F.col("m.a"), F.col("m.b"), most) <= edits_allowed(F.col("size"), threshold))
    out = cut(near.select(F.col("b").alias("id")).distinct())
    _release(out.sparkSession)
    return out


def near_lines(docs: DataFrame, threshold: int | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2 of the lines of at least min_chars characters that have an earlier one, not equal, within the edits allowed."""
    lines = _lines(docs, min_chars)
    roles_ = role_table(threshold, min_chars)
    contested = cut(contested_keys(segment_keys(lines, threshold, min_chars), roles_))
    _release(docs.sparkSession)
    wanted = contested.select("h").distinct()
    few = wanted.count() <= BROADCAST_ROWS
    sketched = lambda x: half_sketches(x.select("h", "h1", "h2", "place", "size", "line"))
    # An inner join, where both are shuffled: a semi-join would go below the sketches, and texts would be shuffled.
    known = sketched(lines.join(F.broadcast(wanted), "h", "left_semi")) if few else sketched(lines).join(wanted, "h")
    known = cut(known.groupBy("h1", "h2").agg(F.min("place").alias("place"), *(F.min(c).alias(c) for c in ("size", "s0", "s1"))))
    # Ids are in the order of places.
    known = cut(known.repartitionByRange("place").sortWithinPartitions("place").withColumn("id", F.monotonically_increasing_id()).drop("place"))
    own = ["id", "size", "s0", "s1", "role"]
    sketches = known.select(F.col("h1").bitwiseAND(F.lit(2**LINE_BITS - 1)).alias("h"), *own[:-1])
    group = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pair = lambda x, y: [F.col(f"{x}id").alias("a"), F.col(f"{y}id").alias("b")]
    may_be = lambda x, y: (F.col(f"{x}id") < F.col(f"{y}id")) & _meet(f"{x}role", f"{y}role", roles_) & _may_be_near(x, y, threshold)
    members = contested.join(sketches, "h").select("key", *own).repartition("key")
    grouped = members.select("key", *own, *(F.first(c).over(group).alias(f"x_{c}") for c in own))
    near = _near(grouped.filter(may_be("x_", "")).select(*pair("x_", "")), lines, known, threshold)
    # Two lines that meet in several keys are a pair of the smallest one where both have the first place of a segment of their class.
    smaller = Window.partitionBy("h").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    plain = [k for k, (bit, _, same) in enumerate(roles_) if bit == 1 and same]
    members = contested.withColumn("before", F.collect_list(F.when(F.col("role").isin(plain), F.col("key"))).over(smaller)).join(sketches, "h").select("key", "before", *own).repartition("key")
    grouped = members.select("key", "before", *own, F.count("*").over(group).alias("n"), F.first("id").over(group).alias("x_id"))
    rest = grouped.filter((F.col("n") > 2) & (F.col("x_id") < F.col("id"))).select("key", "before", *own)  # without the earliest of each key
    later = rest.join(near, "id", "left_anti").select("key", *(F.col(c).alias(f"y_{c}") for c in ("before", *own))).repartition("key")
    first = ~F.arrays_overlap("z_before", "y_before")
    pairs = rest.select("key", *(F.col(c).alias(f"z_{c}") for c in ("before", *own))).join(later, "key").filter(may_be("z_", "y_") & first).select(*pair("z_", "y_"))
    near = near.union(_near(pairs, lines, known, threshold)).distinct()
    return cut(known.join(near, "id", "left_semi").select("h1", "h2"))


def dedup_lines(docs: DataFrame, threshold: int | None = None, min_chars: int = MIN_CHARS, equal_chars: int | None = None) -> DataFrame:
    """The rows of docs (doc_id a whole number) with further columns n_lines, n_equal and n_near (lines that go because an earlier one is equal, or near) and kept_text.

    Lines shorter than min_chars are near to none; they stay, but those of equal_chars or more that are not blank and equal an
    earlier line go, if it is given. Null texts have no lines and stay null; empty ones have one, which stays. Lines are
    judged on the input, not on what is left. Rows that repeat doc_id and text count as one row, and get the same result.
    """
    names = docs.columns
    firsts = _lines(docs, min_chars, equal_chars).groupBy("h1", "h2").agg(F.min("place").alias("place"), F.min_by("no", "place").alias("no"))
    near = near_lines(docs, threshold, min_chars).withColumn("near", F.lit(True))
    first = F.struct("no", "h1", F.coalesce("near", F.lit(False)).alias("near"))
    owner = (F.col("place") - _at(F.col("no"))).cast("decimal(38,0)")
    by_doc = firsts.join(near, ["h1", "h2"], "left").groupBy(owner.alias("__owner")).agg(F.collect_list(first).alias("__firsts"))
    out = docs.withColumn("__key", _owner(F.col("doc_id"), F.col("text"))).join(by_doc, F.col("__key") == F.col("__owner"), "left")

    def judge(x: Column) -> Column:
        all_places = F.sequence(F.lit(0), F.size(x) - 1)
        judged = F.filter(all_places, lambda i: _judged(F.get(x, i), F.length(F.get(x, i)), min_chars, equal_chars))
        own = F.filter(F.coalesce("__firsts", F.array()), lambda f: F.xxhash64(F.get(x, f["no"])) == f["h1"])

        def result(f: Column) -> Column:
            gone = F.array_except(judged, F.transform(F.filter(f, lambda k: ~k["near"]), lambda k: k["no"]))
            near = F.size(F.filter(f, lambda k: k["near"]))
            finish = lambda g: F.struct(
                (F.size(g) - near).cast("long").alias("equal"), near.cast("long").alias("near"),
                F.when(F.size(g) > 0, F.array_join(F.transform(F.array_except(all_places, g), lambda i: F.get(x, i)), "\n")).alias("kept"),
            )
            return let(gone, finish)

        return let(own, result)

    lines = F.split("text", "\n")
    out = out.withColumn("__r", F.when(F.col("text").isNotNull(), let(lines, judge)))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    counts = [zero(F.size(lines).cast("long")).alias("n_lines"), zero(F.col("__r.equal")).alias("n_equal"), zero(F.col("__r.near")).alias("n_near")]
    return out.select(*[F.col(f"`{c}`") for c in names], *counts, F.coalesce("__r.kept", "text").alias("kept_text"))


def op5_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), equal_chars=1)
    return out.select("doc_id", "n_lines", "n_equal", "n_near", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op5_line_edit_join": op5_line_edit_join}
ORACLES: dict[str, str] = {}
