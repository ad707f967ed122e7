"""Column functions: normalisation of addresses, hashes, amounts, names, dates, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of addresses and of transaction hashes.
ADDRESS = "0x[0-9a-fA-F]{40}"
TX_HASH = "0x[0-9a-fA-F]{64}"
#: Fixed value: base-58 alphabet, without 0, O, I and l.
BASE58 = "1-9A-HJ-NP-Za-km-z"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_match(c: Column | str, pattern: str) -> Column:
    """First match in lower case; null where there is none."""
    found = F.lower(F.regexp_extract(_c(c), f"({pattern})", 1))
    return F.when(found != "", found)


def normalize_address(c: Column | str) -> Column:
    return first_match(c, ADDRESS)


def normalize_tx(c: Column | str) -> Column:
    return first_match(c, TX_HASH)


def normalize_node(c: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(_c(c), F.lit(""))))


def mentions(c: Column | str, pattern: str) -> Column:
    """Distinct matches in lower case, in the order of their first place."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(c), F.lit(f"({pattern})"), F.lit(1)), F.lower))


def is_evm_address(c: Column | str) -> Column:
    return _c(c).rlike("^0x[0-9a-fA-F]{40}$")


def is_tron_address(c: Column | str) -> Column:
    return _c(c).rlike(f"^T[{BASE58}]{{33}}$")


def is_solana_address(c: Column | str) -> Column:
    return _c(c).rlike(f"^[{BASE58}]{{32,44}}$") & ~is_evm_address(c) & ~is_tron_address(c)


def is_tron_hash(c: Column | str) -> Column:
    return _c(c).rlike("^[0-9a-fA-F]{64}$")


def non_empty(c: Column | str) -> Column:
    """A text, or null where it is empty."""
    return F.nullif(_c(c), F.lit(""))


def first_non_empty(*cs: Column | str) -> Column:
    return F.coalesce(*(non_empty(c) for c in cs))


def numeric_amount(c: Column | str) -> Column:
    """A positive finite number; anything else is 0."""
    x = _c(c).try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf")), x).otherwise(F.lit(0.0))


def edge_amount(value_eth: Column | str, amount: Column | str, token: Column | str) -> Column:
    """Native value first; else the amount as text, scaled from base units where there is no token and it is a whole number of 10^12 or more."""
    a = non_empty(amount)
    whole = a.try_cast("decimal(38,0)")
    scaled = F.when(non_empty(token).isNull() & a.rlike("^[0-9]+$") & (whole >= F.lit(10**12)), (whole.cast("double") / F.lit(1e18)).cast("string"))
    return F.coalesce(_c(value_eth).cast("string"), scaled, a)


def stable_hash(*cs: Column | str) -> Column:
    """First 16 hex digits of SHA-256 over a JSON list of plain strings."""
    body = F.concat_ws('", "', *(_c(c) for c in cs))
    return F.substring(F.sha2(F.concat(F.lit('["'), body, F.lit('"]')), 256), 1, 16)


def short_id(c: Column | str) -> Column:
    """Addresses as 8...6 characters, hashes as 10...8, others cut at 32."""
    x = _c(c)
    cut = lambda a, b: F.concat(F.substring(x, 1, a), F.lit("..."), F.right(x, F.lit(b)))
    return F.when(x.rlike(f"^{ADDRESS}$"), cut(8, 6)).when(x.rlike(f"^{TX_HASH}$"), cut(10, 8)).when(F.length(x) > 32, F.substring(x, 1, 32)).otherwise(x)


def slug(c: Column | str, sep: str = "_") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", sep), f"^{sep}+|{sep}+$", "")


def compact_case_id(c: Column | str) -> Column:
    """01-2022-Name-2022 becomes name_2022."""
    return slug(F.regexp_replace(_c(c), "^[0-9]+-(?:[0-9]{4}-)?", ""))


def first_number(c: Column | str) -> Column:
    """First number in a text; commas may group its digits."""
    found = F.regexp_extract(_c(c), "([0-9][0-9,]*(?:[.][0-9]+)?)", 1)
    return F.regexp_replace(found, ",", "").try_cast("double")


def date_window(c: Column | str, before: int = 2, after: int = 3) -> Column:
    """Seconds of the days from ``before`` ahead of an ISO date to ``after`` beyond it; end exclusive."""
    day = F.unix_timestamp(_c(c).try_cast("date").cast("timestamp"))
    return F.when(day.isNotNull(), F.struct((day - before * 86400).alias("start"), (day + after * 86400).alias("end")))


def version_parts(c: Column | str) -> Column:
    """A name.v<major>[_<minor>] as parsed, major, minor, text; orders as a struct, unparsable ones first."""
    x = _c(c)
    major = F.regexp_extract(x, "[.]v([0-9]+)(?:_[0-9]+)?$", 1)
    minor = F.regexp_extract(x, "[.]v[0-9]+_([0-9]+)$", 1)
    return F.struct((major != "").alias("parsed"), F.coalesce(major.try_cast("int"), F.lit(0)).alias("major"), F.coalesce(minor.try_cast("int"), F.lit(0)).alias("minor"), x.alias("text"))


def padded(c: Column | str, width: int) -> Column:
    """A number as text with zeros ahead, at least so wide."""
    text = _c(c).cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def canonical_edge_id(c: Column | str) -> Column:
    """eth:007, 7 and "7" are the same edge."""
    digits = F.regexp_extract(F.trim(_c(c).cast("string")), "^(?:eth:)?0*([0-9]+)$", 1)
    return F.when(digits != "", digits)


def is_true(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_c(c).cast("string"))).isin("true", "1", "yes"), F.lit(False))


def grade_rank(c: Column | str, grades: str = "ABCDU") -> Column:
    """Place of a grade from 1; unknown ones come last."""
    at = F.instr(F.lit(grades), _c(c))
    return F.when(_c(c).isNull() | (F.length(_c(c)) != 1) | (at == 0), len(grades)).otherwise(at)


#: Parameters that only track visits.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid", "ref", "ref_src", "spm")


def normalize_url(c: Column | str, drop_query: bool = False) -> Column:
    """Lower-case scheme and host; without user, default port, www., fragment, closing slash and tracking parameters."""
    x = F.regexp_replace(F.trim(_c(c)), "#.*$", "")
    scheme = F.lower(F.regexp_extract(x, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(x, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "^([^/?]*)", 1), "^[^@]*@", ""), ":(?:80|443)$", ""))
    host = F.regexp_replace(host, "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&")
    kept = F.filter(params, lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(scheme, F.lit("://"), host, path, F.lit("") if drop_query else query)


def tokens(c: Column | str) -> Column:
    """Search tokens: hex strings, runs of two and more of a-z 0-9 _ : -, CJK characters and their pairs."""
    low = F.lower(_c(c))
    plain = F.regexp_extract_all(low, F.lit("(0x[0-9a-f]+|[a-z0-9_:-]{2,}|[\\u4e00-\\u9fff])"), F.lit(1))
    runs = F.regexp_extract_all(low, F.lit("([\\u4e00-\\u9fff]{2,})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    return F.concat(plain, pairs)
