"""Text functions as Spark Columns: normalisation, tokens, terms, snippets, dates, keys."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Corporate words dropped from organisation names, and the token alphabet.
CORPORATE = ("주식회사", "유한회사", "사단법인", "재단법인")
TOKEN = "[0-9A-Za-z가-힣]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Trimmed; blank counts as missing."""
    t = F.trim(_col(c))
    return F.when(t != "", t)


def normalize_org(c: Column | str) -> Column:
    """organisation names without brackets, corporate words and signs, in capitals; null if nothing is left."""
    t = F.regexp_replace(_col(c), r"\([^)]*\)|\[[^\]]*\]", "")
    t = F.regexp_replace(t, "|".join(CORPORATE), "")
    return F.nullif(F.upper(F.regexp_replace(t, "[^0-9A-Za-z가-힣]", "")), F.lit(""))


def tokens(c: Column | str) -> Column:
    """lower-case tokens."""
    return F.transform(F.regexp_extract_all(_col(c), F.lit(TOKEN), 0), F.lower)


def term_counts(a: Column | str) -> Column:
    """a token array as an array of (term, tf), by sorting it and measuring runs; nothing leaves the row."""

    def runs(s: Column) -> Column:
        # s is bound to the sorted array: an expression in a lambda would be computed for every element.
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.get(F.transform(F.array(starts), lambda b: F.zip_with(b, F.concat(F.slice(b, 2, F.size(b)), F.array(F.size(s))), lambda x, y: F.struct(F.get(s, x).alias("term"), (y - x).cast("long").alias("tf")))), 0)

    a = _col(a)
    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.when(F.size(a) > 0, F.get(F.transform(F.array(F.array_sort(a)), runs), 0)).otherwise(none)


def counted_terms(a: Column | str) -> Column:
    """F3 for many texts: token arrays as arrays of (term, frequency as weight), a batch of rows at once. Null: none."""
    return F.arrow_udf(_counted, "array<struct<term:string,weight:double>>")(_col(a))


def _counted(a: pa.Array) -> pa.Array:
    tokens_ = a.flatten().dictionary_encode()
    code, kinds = tokens_.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(tokens_.dictionary))
    row = np.repeat(np.arange(len(a)), pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False))
    pairs, n = np.unique(row * kinds + code, return_counts=True)
    terms = pa.StructArray.from_arrays([tokens_.dictionary.take(pa.array(pairs % kinds)), pa.array(n, pa.float64())], ["term", "weight"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs, np.arange(len(a) + 1) * kinds), pa.int32()), terms)


def collapse(c: Column | str) -> Column:
    """runs of white space (Unicode) become one space; trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def fold(c: Column | str) -> Column:
    """collapsed and lower-case."""
    return F.lower(collapse(c))


def compact(c: Column | str) -> Column:
    """F8: folded without spaces; the key of titles."""
    return F.replace(fold(c), F.lit(" "), F.lit(""))


def unique_strings(a: Column | str) -> Column:
    """collapsed, blanks dropped, first occurrences in order. D1 without duplicates."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(_col(a), F.array().cast("array<string>")), collapse), lambda x: x.isNotNull() & (x != "")))


def string_list(a: Column | str) -> Column:
    """Items trimmed, blanks dropped, order and repeats kept, null to empty."""
    return F.filter(F.transform(F.coalesce(_col(a), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def keywords(a: Column | str) -> Column:
    """phrases split at white space into distinct tokens, case kept."""
    return F.array_distinct(F.filter(F.flatten(F.transform(_col(a), lambda x: F.split(collapse(x), " "))), lambda x: x != ""))


def term_pattern(terms: list[str] | tuple[str, ...]) -> str | None:
    """longest first, whole words for ASCII terms, any case."""
    own = sorted({" ".join(t.split()) for t in terms if t.strip()}, key=lambda t: (-len(t), t))
    if not own:
        return None
    parts = [rf"\b{re.escape(t)}\b" if t.isascii() else re.escape(t) for t in own]
    return "(?iU)(?:" + "|".join(parts) + ")"


def strip_terms(c: Column | str, terms: list[str] | tuple[str, ...]) -> Column:
    """the text without the terms."""
    pattern = term_pattern(terms)
    return collapse(_col(c) if pattern is None else F.regexp_replace(_col(c), pattern, " "))


def domain_terms(a: Column | str, forbidden: list[str] | tuple[str, ...]) -> Column:
    """each value without the forbidden terms; empty ones go, first occurrences stay."""
    return F.array_distinct(F.filter(F.transform(_col(a), lambda x: strip_terms(x, forbidden)), lambda x: x != ""))


def query_terms(c: Column | str, lexicon: list[str] | tuple[str, ...]) -> Column:
    """the lexicon's terms that the folded text contains, longest first, then alphabetically."""
    own = sorted(set(lexicon), key=lambda t: (-len(t), t))
    return F.filter(F.array(*map(F.lit, own)), lambda t: F.contains(fold(c), F.lower(t)))


def fallback_tokens(c: Column | str) -> Column:
    """distinct white-space tokens of two characters at least."""
    return F.array_distinct(F.filter(F.split(collapse(c), " "), lambda x: F.length(x) >= 2))


def most_specific(a: Column | str) -> Column:
    """longest without spaces first, then fewer spaces, then by text."""
    key = F.transform(_col(a), lambda x: F.struct((-F.length(F.replace(x, F.lit(" "), F.lit("")))).alias("l"), F.regexp_count(x, F.lit(" ")).alias("s"), x.alias("t")))
    return F.transform(F.array_sort(key), lambda x: x["t"])


def is_generic(c: Column | str, phrases: list[str], singles: list[str]) -> Column:
    """a known phrase, or nothing but generic words."""
    t = fold(c)
    words = F.split(t, " ")
    known = F.array(*map(F.lit, singles)) if singles else F.array().cast("array<string>")
    return (t == "") | t.isin(phrases) | F.forall(words, lambda w: F.array_contains(known, w))


def year(c: Column | str) -> Column:
    """the first four characters as a year."""
    return F.substring(_col(c), 1, 4).try_cast("int")


def rfc3339(c: Column | str) -> Column:
    """spreadsheet serials to dates, months to their first day, other values as they are."""
    c = _col(c)
    return (
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(c, F.lit("T00:00:00Z")))
        .when(c.rlike(r"^\d{4}-\d{2}$"), F.concat(c, F.lit("-01T00:00:00Z")))
        .when(c.rlike(r"^\d{1,6}$"), F.concat(F.date_add(F.lit("1899-12-30").cast("date"), c.try_cast("int")).cast("string"), F.lit("T00:00:00Z")))
        .otherwise(c)
    )


def truncate(c: Column | str, most: int) -> Column:
    """collapsed and cut to most characters, dots included."""
    t = collapse(c)
    if most <= 3:
        return F.substring(t, 1, most)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("..."))).otherwise(t)


def snippet(text: Column | str, found: Column | str, metadata: dict[str, Column] | None = None, longest: int = 1000) -> Column:
    """a metadata line, and the text around the first keyword that is found, or its beginning."""
    t, found = collapse(text), _col(found)
    first = F.get(F.filter(F.transform(found, lambda k: F.position(F.lower(k), F.lower(t))), lambda p: p > 0), F.lit(0))
    start = F.greatest(F.lit(1), first - 200)
    end = F.least(F.length(t), first - 1 + 600)
    window = F.when(first.isNotNull(), F.concat(F.when(start > 1, "...").otherwise(""), F.substr(t, start, end - start + 1), F.when(end < F.length(t), "...").otherwise("")))
    body = F.when((F.size(found) > 0) & (F.length(t) > 500), F.coalesce(window, F.concat(F.substring(t, 1, longest), F.lit("...")))).otherwise(F.substring(t, 1, longest))
    meta = F.nullif(F.concat_ws(" ", *(F.when(v != "", F.concat(F.lit(f"[{k}: "), v, F.lit("]"))) for k, v in (metadata or {}).items())), F.lit(""))
    return F.nullif(F.concat_ws("\n", meta, F.nullif(body, F.lit(""))), F.lit(""))


def multiline(c: Column | str) -> Column:
    """lines trimmed, joined by commas."""
    return F.array_join(F.filter(F.transform(F.split(_col(c), "\n"), lambda x: F.trim(x)), lambda x: x != ""), ", ")


def date_key(c: Column | str) -> Column:
    """sortable date text; missing first."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit("0000-00-00"))


def token_estimate(c: Column | str) -> Column:
    """a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.bround(F.length(_col(c)) / 4).cast("int"))


def seed32(c: Column | str) -> Column:
    """the first 32 bits of the SHA-256 digest."""
    return F.conv(F.substring(F.sha2(_col(c), 256), 1, 8), 16, 10).cast("long")


def contextual(c: Column | str, phrases: tuple[tuple[str, str], ...]) -> Column:
    """F16: the canonical names whose patterns the folded text matches."""
    return F.filter(F.array(*(F.when(fold(c).rlike(f"(?U){p}"), F.lit(n)) for n, p in phrases)), lambda x: x.isNotNull())


def mask_vector(a: Column | str) -> Column:
    """What a log shows of a long numeric list."""
    a = _col(a)
    return F.when(F.size(a) > 100, F.format_string("<Dense Vector: %d dimensions>", F.size(a))).otherwise(F.to_json(a))


def int_or_zero(c: Column | str) -> Column:
    """D3: blank counts as 0; text that is no number is null (the row is invalid)."""
    return F.when(F.coalesce(F.trim(_col(c)), F.lit("")) == "", 0).otherwise(F.trim(_col(c)).try_cast("int"))


def int_or_null(c: Column | str) -> Column:
    """D4."""
    return blank_to_null(c).try_cast("int")


def display_title(korean: Column | str, english: Column | str) -> Column:
    """D6."""
    return F.coalesce(F.nullif(_col(korean), F.lit("")), F.nullif(_col(english), F.lit("")), F.lit("Untitled project"))


def branch_of(point_id: Column | str, branches: tuple[str, ...] = ("basic", "art", "pat", "pjt")) -> Column:
    """the first branch that the id ends with or holds."""
    c = _col(point_id)
    return reduce(lambda out, b: F.when(F.endswith(c, F.lit(f"_{b}")) | F.contains(c, F.lit(f"_{b}_")), b).otherwise(out), reversed(branches), F.lit(None).cast("string"))
