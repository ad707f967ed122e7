"""Near-duplicate detection with bottom-k sketches.

One hash function orders all shingles. A document keeps its ``SKETCH`` smallest hashes; inverted lists of
the retained values bring together documents whose sketches overlap; the sketch of a pair's union
estimates its similarity and filters; the full shingle sets decide.

Classes. Documents with equal sets are one class from the start, so exact copies cost one row.

Lists. Enumerating all pairs of a list grows with the square of its length, so links are found in steps:

1. Each class is tried with the leader that it shares the most lists with. Confirmed links give components.
2. In lists of at most ``LIST`` members, all pairs that are not yet in one component are tried.
3. Longer lists come from passages that many documents share, or from large groups of copies. A linked
   pair meets in a shorter list if either end has more values in shorter lists than the pair can lack in
   common (``least_short``). Documents with fewer are compared by their full sets, among each other: each
   document lists its rarest shingles, as many as it can lack in common with a linked one, and one more.
   Linked documents share a listed shingle, whatever their hashes, at places that let them share enough.
   These lists are worked off in rounds of leaders against members of other components (``_by_rounds``).
   Nothing is capped. The first leader of a group of copies is the member with the fewest shingles of its
   own, so a group with a centre is united in one round, linear in its rows. What stays quadratic is a list
   with many members that the places let be linked, that pass the sketches, and that are not linked: each
   such pair must be looked at by any exact method.

The chance that a linked pair is met by no list is about ``MISSED`` at most, by a binomial tail: step 2 misses a
pair only if all its values in shorter lists are own ones, and the lists of step 3 meet all pairs. The sketches
that filter the pairs met, in all steps, allow five deviations. Sets are 63-bit hashes of shingles; two shingles of
one hash count as one.

A null or empty text, or one without words, has an empty set and is linked with nothing. Rows with equal
keys are one document: links of either count. A row with a null key is linked with nothing and kept.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_texts, checkpoint, discard, fewer_tasks, hot_keys, salted_join, small, unused, written
from .graph import connected_components

WORDS = 5
PERCENT = 85
SKETCH = 32  #: values kept for estimates
LISTED = 24  #: the smallest of them, which get inverted lists
LIST = 16
MISSED = 2e-6
#: Comparisons of places left for each row of the lists at which the last round takes all members as leaders.
WORK = 500
#: Rounds with fewer leaders than these are always taken, as they unite most of a group of copies.
FIRST_ROUNDS = 4
#: Rows of narrow tables that a whole set stands for, where the number of tasks is chosen.
SET_ROWS = 25
#: An estimate of the similarity below this, at 32 values, is more than five deviations under 0.85.
LEAST_ESTIMATE = 17 / 32

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles of a text."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    with np.errstate(over="ignore"):
        if n < size:
            x = np.uint64(n)
            for v in h:
                x = (x + v) * _M[0]
            return _mix(np.array([x], np.uint64)).astype(np.int64)
        s = np.zeros(n - size + 1, np.uint64)
        for i in range(size):
            s = (s + h[i : n - size + 1 + i]) * _M[i % 5]
        return np.unique(_mix(s).astype(np.int64))


def _fingerprint(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sketches(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, class (a hash of the whole set; null for an empty one) and sketch."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("class", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))]

    def make():
        def run(texts):
            sets = [shingle_set(t, size) for t in texts]
            return [[len(s) for s in sets], [_fingerprint(s) if len(s) else None for s in sets], [s[:SKETCH] for s in sets]]

        return run

    return append_columns(docs, ["text"], fields, make).drop("text")


def estimate(a: list[int], b: list[int], n_a: int, n_b: int, percent: int = PERCENT) -> bool:
    """Whether a pair's union sketch leaves it in play; exact where both sketches are whole sets."""
    a, b = set(a), set(b)
    union = a | b
    if n_a <= SKETCH and n_b <= SKETCH:
        return 100 * len(a & b) >= percent * len(union)
    least = sorted(union)[:SKETCH]
    return sum(1 for x in least if x in a and x in b) >= LEAST_ESTIMATE * len(least) * percent / PERCENT


def _likely(pairs: DataFrame, classes: DataFrame, percent: int, hot: DataFrame | None) -> DataFrame:
    """The pairs (a, b), a table of their own, that the union sketch leaves, with all their columns."""
    side = lambda c: classes.select(F.col("class").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    both = salted_join(pairs, side("a"), "a", "b", hot).join(side("b"), "b")
    fields = [T.StructField("likely", T.BooleanType())]
    make = lambda: lambda sa, sb, na, nb: [[estimate(*x, percent) for x in zip(sa, sb, na, nb)]]
    return append_columns(fewer_tasks(both, pairs.count()), ["sa", "sb", "na", "nb"], fields, make).where("likely").select(*pairs.columns)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Whole sets of classes; ``wanted`` has a class and one of its documents."""
    texts = docs.join(small(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    fields = [T.StructField("class", T.LongType()), T.StructField("set", T.BinaryType())]

    def make():
        def run(texts):
            sets = [shingle_set(t, size) for t in texts]
            return [[_fingerprint(s) if len(s) else None for s in sets], [s.tobytes() for s in sets]]

        return run

    return append_columns(texts, ["text"], fields, make).select("class", "set").where("class is not null").dropDuplicates(["class"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, hot: DataFrame | None) -> DataFrame:
    """The pairs, a table of their own, whose whole sets are similar enough, with all their columns."""
    both = salted_join(pairs, sets.select(F.col("class").alias("a"), F.col("set").alias("sa")), "a", "b", hot)
    both = both.join(sets.select(F.col("class").alias("b"), F.col("set").alias("sb")), "b")

    def linked(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (len(x) + len(y) - common)

    make = lambda: lambda sa, sb: [[linked(a, b) for a, b in zip(sa, sb)]]
    return append_columns(fewer_tasks(both, SET_ROWS * pairs.count()), ["sa", "sb"], [T.StructField("linked", T.BooleanType())], make).where("linked").select(*pairs.columns)


def least_short(percent: int) -> int:
    """The least number, out of ``LISTED`` values, that a linked pair lacks in common with a chance below ``MISSED``."""
    p, tail = 1 - percent / 100, 0.0
    for m in range(LISTED, 0, -1):
        tail += comb(LISTED, m) * p**m * (1 - p) ** (LISTED - m)
        if tail >= MISSED:
            return min(m + 1, LISTED)
    return 1


def _sized(percent: int, a: str = "na", b: str = "nb"):
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _with_roots(rows: DataFrame, links: DataFrame, many: int) -> DataFrame:
    """Rows with the component of their class."""
    roots = connected_components(links, many).select(F.col("node").alias("class"), "root")
    return rows.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))


def near_duplicate_links(docs: DataFrame, found: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between classes, enough of them to give all components."""
    docs = docs.where("doc_id is not null")
    named = found.where("class is not null and doc_id is not null")
    classes = checkpoint(named.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), found.count())
    many = classes.count()
    places = classes.select("class", "n", F.explode(F.slice("sketch", 1, LISTED)).alias("value"))
    leaders = checkpoint(places.groupBy("value").agg(F.count("*").alias("length"), F.min(F.struct("class", "n")).alias("leader")).where("length > 1"), LISTED * many)
    joined = salted_join(places, leaders, "value", "class", hot_keys(leaders.select("value", F.col("length").alias("n")), "value"))
    lists = written(fewer_tasks(joined, LISTED * many), "lists")
    discard(leaders)

    def confirm(pairs: DataFrame, led: bool) -> DataFrame:
        """The linked ones of pairs (a, b); many of them may have the same ``a`` if they are ``led``."""
        pairs = checkpoint(pairs.distinct(), many)
        hot = _hot_leaders(pairs) if led else None
        likely = checkpoint(_likely(pairs, classes, percent, hot))
        wanted = likely.select(F.col("a").alias("class")).union(likely.select(F.col("b"))).distinct().join(classes.select("class", "doc_id"), "class")
        sets = written(fewer_tasks(_sets(docs, wanted, size), SET_ROWS * many), "sets")
        linked = checkpoint(_linked(likely, sets, percent, hot))
        discard(pairs, likely, sets)
        return linked

    # Documents given more than once link the classes of their texts.
    twice = named.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a != b").select("doc_id", "a")
    links = named.join(twice, "doc_id").where("a != class").select("a", F.col("class").alias("b"))

    # 1. Each class with one leader.
    star = lists.select(F.col("leader.class").alias("a"), F.col("class").alias("b"), F.col("leader.n").alias("na"), F.col("n").alias("nb")).where("a != b").where(_sized(percent))
    most = star.groupBy("b", "a").agg(F.count("*").alias("shared")).groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
    links = checkpoint(links.unionByName(confirm(most.select("a", "b"), True)), many)

    # 2. Shorter lists in full, between components.
    short = checkpoint(_with_roots(lists.where(F.col("length") <= LIST).select("value", "class", "n"), links, many), LISTED * many)
    links = checkpoint(links.unionByName(confirm(_across(short, percent), False)), many)

    # 3. Documents with too many long lists, by their rarest shingles.
    share = lists.groupBy("class").agg(F.count_if(F.col("length") > LIST).alias("long"), F.max("n").alias("n"))
    hot = checkpoint(share.where(F.col("long") * LISTED > (LISTED - least_short(percent)) * F.least("n", F.lit(LISTED))).select("class", "n"), many)
    discard(lists, short)
    held = hot.agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).first()
    if not held["sets"]:
        return links
    wanted = classes.join(hot, "class", "left_semi").select("class", "doc_id")
    sets = written(fewer_tasks(_sets(docs, wanted, size), SET_ROWS * held["sets"]), "sets")
    rare = checkpoint(_with_roots(_rarest(sets, percent, held["shingles"]), links, many), held["shingles"])
    links = checkpoint(links.unionByName(_by_rounds(rare, classes, sets, percent)), many)
    discard(classes, sets)
    return links


def _hot_leaders(pairs: DataFrame) -> DataFrame | None:
    return hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), "a")


def _across(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list that are in different components and near enough in size. Lists are short."""
    side = lambda c: lists.select("value", F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("root").alias(f"r{c}"))
    return side("a").join(side("b"), "value").where("a < b and ra != rb").where(_sized(percent)).select("a", "b")


def _rarest(sets: DataFrame, percent: int, shingles: int) -> DataFrame:
    """Each set's rarest shingles, as many as it can lack in common with a linked set and one more, without those that no other set has: value, class, n, pos."""
    fields = [T.StructField("values", T.ArrayType(T.LongType()))]
    values = append_columns(sets, ["set"], fields, lambda: lambda s: [[np.frombuffer(x, np.int64) for x in s]])
    values = values.select("class", F.size("values").cast("long").alias("n"), F.explode("values").alias("value"))
    lengths = checkpoint(values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), shingles)
    counted = salted_join(values, lengths.select("value", F.col("n").alias("length")), "value", "class", hot_keys(lengths, "value"), how="left").withColumn("length", F.coalesce("length", F.lit(1)))
    order = Window.partitionBy("class").orderBy("length", "value")
    ranked = counted.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    return ranked.where("length > 1").select("value", "class", "n", "pos")


def _by_rounds(rare: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that tie all linked classes of the lists of ``rare`` (value, class, n, pos, root) together.

    A round tries each list's first members by place, those with the fewest shingles of their own, with all members that
    are in other components and that the places leave in reach. Tried leaders leave the list, and so does a list of one
    component. A round has four times as many leaders a list as the one before. After the first two, once what is left to
    compare is at most ``WORK`` times the lists' rows, all members outside a list's largest component are leaders. Pairs
    are tried once.
    """
    links, tried, leaders, rows = [], None, 1, rare.count()
    while True:
        parts = rare.groupBy("value", "root").agg(F.count("*").alias("k"))
        open_lists = checkpoint(parts.groupBy("value").agg(F.sum("k").alias("n"), F.max_by("k", F.struct("k", "root")).alias("largest"), F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1"), rows)
        size = open_lists.agg(F.sum("n").alias("rows"), F.sum(F.col("n").cast("double") * (F.col("n") - F.col("largest"))).alias("work")).first()
        if not size["rows"]:
            discard(rare, open_lists)
            break
        hot = hot_keys(open_lists.select("value", "n"), "value")
        rows = size["rows"]
        left = checkpoint(salted_join(rare, open_lists.select("value", "main"), "value", "class", hot), rows)
        discard(rare)
        last = leaders > FIRST_ROUNDS and size["work"] <= WORK * rows
        first = left.where("root != main")
        if not last:
            order = Window.partitionBy("value").orderBy("pos", "class")
            first = left.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= leaders)
        first = checkpoint(first.groupBy("value").agg(F.collect_list(F.struct("class", "n", "pos", "root")).alias("leaders")), rows)
        star = salted_join(left, first, "value", "class", hot).withColumn("l", F.explode(F.filter("leaders", lambda l: _in_reach(l, percent, last))))
        pairs = star.select(F.col("l.class").alias("a"), F.col("class").alias("b"), F.col("l.root").alias("ra"), F.col("root").alias("rb")).distinct()
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = checkpoint(pairs, int(size["work"]) if last else leaders * rows)
        led = _hot_leaders(pairs)
        likely = checkpoint(_likely(pairs, classes, percent, led))
        found = checkpoint(_linked(likely, sets, percent, led))
        links.append(found.select("a", "b"))
        discard(open_lists, likely)
        if last:
            discard(left, first, pairs)
            break
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        joined = checkpoint(connected_components(found.select(F.col("ra").alias("a"), F.col("rb").alias("b")), rows).select(F.col("node").alias("root"), F.col("root").alias("now")))
        led = first.select("value", F.explode("leaders.class").alias("class"))
        rare = left.drop("main").join(led, ["value", "class"], "left_anti")
        by_root = hot_keys(left.groupBy("root").agg(F.count("*").alias("n")), "root")
        rare = checkpoint(salted_join(rare, joined, "root", "class", by_root, how="left").withColumn("root", F.coalesce("now", "root")).drop("now"), rows)
        discard(left, first, joined)
        leaders *= 4
    return reduce(DataFrame.unionByName, links) if links else classes.select(F.col("class").alias("a"), F.col("class").alias("b")).limit(0)


def _in_reach(leader, percent: int, once: bool):
    """Whether a row (class, n, pos, root, main) is to be tried with a leader of its list: in another component, near
    enough in size, and able to share enough if no shingle before these places is common. Of two leaders, one is tried with the other."""
    n, other = F.col("n"), leader["n"]
    most = F.least(other - leader["pos"], n - F.col("pos")) + 1
    fits = (leader["root"] != F.col("root")) & (100 * F.least(n, other) >= percent * F.greatest(n, other)) & (most * (100 + percent) >= (n + other) * percent)
    return fits & ((F.col("root") == F.col("main")) | (leader["class"] < F.col("class"))) if once else fits


def without_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` (doc_id and text among its columns) with one document of each group: that with the smallest key.

    Of rows that repeat a key one stays; rows with a null key all stay.
    """
    found = near_duplicates(docs, size=size, percent=percent)
    key = unused(docs, "gone")
    gone = small(found.where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct())
    left = docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")
    twice = checkpoint(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(key)))
    if twice.isEmpty():
        return left
    once = left.join(twice, F.col("doc_id") == F.col(key), "left_anti")
    return once.unionByName(left.join(twice, F.col("doc_id") == F.col(key), "left_semi").dropDuplicates(["doc_id"]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest key reachable) and kept."""
    texts = as_texts(docs, id_col, text_col)
    found = checkpoint(sketches(texts, size))
    links = near_duplicate_links(texts, found, size, percent)
    # Only classes of several rows or with links need a look-up; all others are their own component.
    rows = found.count()
    roots = connected_components(links, rows).select(F.col("node").alias("class"), "root")
    classes = found.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    classes = checkpoint(classes.join(roots, "class", "left").where("n > 1 or root is not null"), rows)
    least = checkpoint(classes.where("root is not null").groupBy("root").agg(F.min("least").alias("all"), F.count("*").alias("n")), rows)
    named = salted_join(classes, least.drop("n"), "root", "class", hot_keys(least, "root"), how="left").select("class", F.coalesce("all", "least").alias("least"))
    out = salted_join(found.drop("sketch"), named, "class", "doc_id", hot_keys(classes, "class"), how="left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
