"""License scans by ordered signature rules, in DataFrame functions alone.

A text becomes its words (ASCII letters and digits and all characters beyond ASCII, A-Z lower-cased), joined
by single spaces. Plain searches find documents that hold any of the rules' stems; only those go on. A rule's keyword gates its regex. Matches are marked in the text, so that splitting it at spaces gives
their first and last words. A detection is suppressed if another one contains it and has the higher priority,
or the same and more words, or as many and an earlier rule. Texts of few detections compare them in place; for those of
more than ``FEW_FOUND`` the same is done by a sweep, as running maxima over the detections in order.

The rules are those of ``license_rules``, after the base ones.

Null and empty texts have no words and no labels; first_word and last_word are null where nothing is found.
Repeated rows give repeated results; columns other than key and text are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import license_rules
from .common import as_texts, written


@dataclass(frozen=True)
class Signature:
    label: str
    pattern: str  #: over words joined by single spaces
    keyword: str  #: stands in every match
    priority: int
    base: bool = False


#: The phrases that are looked for in any case.
BASE = (
    Signature("cc-by", "cc by", "cc by", 3, True),
    Signature("gpl", "general public license", "general public license", 3, True),
    Signature("reserved", "all rights reserved", "all rights reserved", 1, True),
)



def signatures() -> tuple[Signature, ...]:
    """All rules in order."""
    return (*BASE, *(Signature(label, pattern, keyword, priority) for priority, keyword, label, pattern in license_rules.rows()))


_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Any text that a rule matches holds one of these, in any case,
STEMS = ("licens", "licenc", "copyright", "reserved", "warrant", "unencumbered", "proprietary", "shareware", "freeware", "redistribution", "creative", "apache", "bsd", "gpl", "zlib", "wtfpl", "beerware", "cecill", "openrail", "hereby", "permission")
#: or one of these where its pattern is found, too.
PHRASES = (
    ("public", f"public{_GAP}domain"),
    ("provided", f"provided{_GAP}as{_GAP}is"),
    ("basis", f"as{_GAP}is{_GAP}basis"),
    ("evaluation", f"evaluation{_GAP}purposes"),
    ("commercial", f"commercial{_GAP}use"),
    ("research", f"research{_GAP}(?:purposes|use)"),
    ("commons", f"commons{_GAP}clause|data{_GAP}commons"),
    ("rail", f"open{_GAP}rail"),
    ("cc", f"(?<![0-9a-z])cc(?:0|{_GAP}by)(?![0-9a-z])"),
    ("asl", f"asl{_GAP}2{_GAP}0"),
    ("perl", f"as{_GAP}perl"),
    ("mpl", f"mpl{_GAP}(?:v(?:{_GAP})?)?2{_GAP}0"),
    ("attribution", f"mit{_GAP}no{_GAP}attribution"),
    # Short names count only as what something is under: in other languages they are words.
    *((w, f"under{_GAP}(?:the{_GAP})?(?:terms{_GAP}of{_GAP}(?:the{_GAP})?)?{w}(?![0-9a-z])") for w in ("mit", "isc", "psf", "mpl")),
)


def _may_match(low: Column) -> Column:
    """Whether a lower-cased text may hold a match; plain searches come first, as most texts hold none of the words."""
    plain = [F.contains(low, F.lit(s)) for s in STEMS]
    return reduce(Column.__or__, plain + [F.contains(low, F.lit(w)) & low.rlike(p) for w, p in PHRASES])


#: Beyond so many detections in a text, suppression is worked out by a sweep.
FEW_FOUND = 200

#: Runs of characters that part words; with A-Z as letters, as in texts whose case is still as given.
_PARTS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _places(joined: Column, pattern: Column) -> Column:
    """First and last words of a rule's matches: they are marked with two control characters, which no words hold."""
    marked = F.split(F.trim(F.regexp_replace(joined, F.concat(F.lit(" ("), pattern, F.lit(")(?= )")), F.lit(" \x01$1\x02"))), " ")
    numbered = F.transform(marked, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    starts = F.transform(F.filter(numbered, lambda x: x["w"].startswith("\x01")), lambda x: x["i"])
    ends = F.transform(F.filter(numbered, lambda x: x["w"].endswith("\x02")), lambda x: x["i"])
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def scan_licenses(docs: DataFrame, rules: tuple[Signature, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, base (detections of base rules) and kept (detections that stand), as arrays
    of label, first, last (words from 0), priority."""
    rules = rules if rules is not None else signatures()
    table = F.array(
        *(
            F.struct(F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"), F.lit(r.keyword).alias("keyword"), F.lit(r.priority).alias("priority"), F.lit(i).alias("rank"), F.lit(r.base).alias("base"))
            for i, r in enumerate(rules)
        )
    )
    text = F.coalesce("text", F.lit(""))
    gated = F.when(_may_match(F.col("low")), F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("text", _UPPER, _LOW), _PARTS, " ")), F.lit(" ")))
    out = as_texts(docs, id_col, text_col).select("doc_id", "text", F.regexp_count(text, F.lit(_WORD)).cast("long").alias("n_words"), F.lower("text").alias("low"))
    out = out.select("doc_id", "n_words", gated.alias("joined"))

    def detect(rule: Column) -> Column:
        return F.transform(
            _places(F.col("joined"), rule["pattern"]),
            lambda p: F.struct(rule["label"].alias("label"), p["first"].cast("long").alias("first"), p["last"].cast("long").alias("last"), rule["priority"].alias("priority"), rule["rank"].alias("rank"), rule["base"].alias("base")),
        )

    hits = F.flatten(F.transform(F.filter(table, lambda r: F.contains(F.col("joined"), r["keyword"])), detect))
    found = written(out.select("doc_id", "n_words", F.when(F.col("joined").isNotNull(), hits).alias("found")), "detections")

    def beats(e: Column, d: Column) -> Column:
        longer, as_long = (e["last"] - e["first"]) > (d["last"] - d["first"]), (e["last"] - e["first"]) == (d["last"] - d["first"])
        return (e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (longer | (as_long & (e["rank"] < d["rank"]))))

    stands = lambda d: ~F.exists("found", lambda e: (e["first"] <= d["first"]) & (e["last"] >= d["last"]) & beats(e, d))
    plain = lambda ds: F.transform(ds, lambda d: F.struct(d["label"].alias("label"), d["first"].alias("first"), d["last"].alias("last"), d["priority"].alias("priority")))
    few = found.where(F.coalesce(F.size("found"), F.lit(0)) <= FEW_FOUND)
    few = few.select("doc_id", "n_words", plain(F.filter("found", lambda d: d["base"])).alias("base"), plain(F.filter("found", stands)).alias("kept"))
    many = found.where(F.size("found") > FEW_FOUND)
    if many.isEmpty():
        return few
    # The table is written, so a row's number is the same whenever it is read.
    numbered = many.withColumn("row", F.monotonically_increasing_id())
    swept = numbered.select("row", "doc_id", "n_words", F.explode("found").alias("d")).select("row", "doc_id", "n_words", "d.*")
    before = Window.partitionBy("row").orderBy("first", F.desc("last"), F.desc("priority"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    # Those before a detection begin no later, so one reaches as far if the farthest end of its priority and above does.
    ends = reduce(lambda c, p: F.when(F.col("priority") == p, F.max(F.when(F.col("priority") >= p, F.col("last"))).over(before)).otherwise(c), sorted({r.priority for r in rules}), F.lit(None).cast("long"))
    swept = swept.withColumn("stands", ~F.coalesce(ends >= F.col("last"), F.lit(False)))
    detection = F.struct("label", "first", "last", "priority")
    many = swept.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list(F.when(F.col("base"), detection)).alias("base"), F.collect_list(F.when(F.col("stands"), detection)).alias("kept"))
    return few.unionByName(many.drop("row"))


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = scan_licenses(docs, None, id_col, text_col)
    starts = F.transform("base", lambda d: d["first"])
    names = lambda c: F.transform(c, lambda d: d["label"])
    none = F.array().cast("array<string>")
    base, kept = F.coalesce(names("base"), none), F.coalesce(names("kept"), none)
    top = F.coalesce(F.array_max(F.transform("kept", lambda d: d["priority"])), F.lit(0))
    return found.select(
        "doc_id",
        "n_words",
        F.when(F.col("base").isNull(), 0).otherwise(F.size("base")).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, kept)), ",").alias("labels"),
        (top / F.lit(10.0)).alias("score"),
    )
