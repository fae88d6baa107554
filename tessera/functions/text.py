"""Text functions as native column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as in the data's producers: Unicode, not just ASCII (fixed values).
WS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def round_half_up(x: Column) -> Column:
    """Rounds halves toward plus infinity, unlike round()."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def blank_to_null(x: Column) -> Column:
    return F.when(F.trim(x) != "", x)


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, WS + "+", " "))


def sanitize(x: Column) -> Column:
    """Markup to blanks, the usual entities decoded in their order, white space collapsed; null as empty."""
    s = F.coalesce(x, F.lit(""))
    s = F.when(s.contains("<"), F.regexp_replace(s, "<[^>]*>", " ")).otherwise(s)
    decoded = s
    for entity, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        decoded = F.regexp_replace(decoded, f"(?i){entity}", sign)
    return collapse(F.when(s.contains("&"), decoded).otherwise(s))


def strip_markup(x: Column) -> Column:
    """Markup and every entity to a blank, runs of blanks collapsed."""
    s = F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "&[^;\\s]{1,10};", " "), r"\s{2,}", " "))


def decode_entities(x: Column) -> Column:
    for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return x


#: What normal_company and normal_title take away (fixed values).
LEGAL_END = r"(?i)\s*(?<![A-Za-z0-9_])(inc\.?|ltd\.?|llc\.?|corp\.?|gmbh|s\.?a\.?|b\.?v\.?)\s*[,.|]*\s*$"
PICTURES, ROUND_NOTE, SQUARE_NOTE = r"[\x{1F300}-\x{1FFFF}]", r"(?i)\s*\((?:m/w/d|remote|all\s+levels?|anywhere|f/m/d|all\s+genders?)\)", r"(?i)\s*\[(?:remote|contract|full[- ]?time|part[- ]?time)\]"


def normal_company(x: Column) -> Column:
    """Without the legal form and the punctuation at the end."""
    s = F.regexp_replace(F.coalesce(x, F.lit("")), LEGAL_END, "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[,.|]+$", ""), WS + "{2,}", " "))


def normal_title(x: Column) -> Column:
    """Without pictures, and without notes in brackets on gender, place or contract."""
    s = F.coalesce(x, F.lit(""))
    for pattern in (PICTURES, ROUND_NOTE, SQUARE_NOTE):
        s = F.regexp_replace(s, pattern, "")
    return F.trim(F.regexp_replace(s, WS + "{2,}", " "))


def dedupe_key(title: Column, company: Column) -> Column:
    one = lambda x: F.regexp_replace(F.lower(x), WS + "+", " ")
    return F.concat(one(normal_company(company)), F.lit("::"), one(normal_title(title)))


def utf16_units(x: Column) -> Column:
    """The UTF-16 code units of a text as an array of numbers."""
    h = F.hex(F.encode(x, "UTF-16BE"))
    n = (F.length(h) / 4).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))


@F.pandas_udf(T.StringType())
def lossy_fnv(texts: pd.Series) -> pd.Series:
    """FNV over UTF-16 units whose multiplication runs in doubles, as the stored hashes were made; 8 hex digits.

    All texts of a batch advance by one unit in each numpy step; a null text stays null."""
    raw = [np.frombuffer(("" if t is None else t).encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    order = np.argsort(-size, kind="stable")
    h = np.full(len(raw), 2166136261, np.uint64)
    units = np.zeros((len(raw), int(size.max(initial=0))), np.uint16)
    for row, i in enumerate(order):
        units[row, : size[i]] = raw[i]
    falling = -size[order]
    for k in range(units.shape[1]):
        n = int(np.searchsorted(falling, -k, "left"))  # texts of more than k units
        signed = (h[:n].astype(np.uint32) ^ units[:n, k]).view(np.int32)
        h[:n] = np.mod(signed.astype(np.float64) * 16777619.0, 4294967296.0).astype(np.uint64)
    out = np.empty(len(raw), object)
    out[order] = [f"{x:08x}" for x in h.tolist()]
    return pd.Series(out).where(texts.notna().to_numpy(), None)


def fnv1a32(x: Column) -> Column:
    """Exact 32-bit FNV-1a over UTF-16 units, as a number."""
    step = lambda h, c: ((h.bitwiseXOR(c)) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint"))
    return F.aggregate(utf16_units(x), F.lit(2166136261).cast("bigint"), step)


@F.pandas_udf(T.LongType())
def fnv1a32_of_many(texts: pd.Series) -> pd.Series:
    """fnv1a32 of long texts: those of a batch advance by one unit in each numpy step; null stays null."""
    raw = [np.frombuffer(("" if t is None else t).encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    order = np.argsort(-size, kind="stable")
    units = np.zeros((int(size.max(initial=0)), len(raw)), np.uint32)
    for row, i in enumerate(order):
        units[: size[i], row] = raw[i]
    h, falling = np.full(len(raw), 2166136261, np.uint32), -size[order]
    for k in range(len(units)):
        n = int(np.searchsorted(falling, -k, "left"))
        h[:n] = (h[:n] ^ units[k, :n]) * np.uint32(16777619)
    out = np.empty(len(raw), np.int64)
    out[order] = h
    return pd.Series(out).where(texts.notna().to_numpy(), None)


def word_hash(x: Column) -> Column:
    """A 32-bit hash of the first 50 words of more than two characters, each of the first ten taken three times."""
    kept = F.slice(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9_]+"), lambda w: F.length(w) > 2), 1, 50)
    joined = F.array_join(F.transform(kept, lambda w, i: F.repeat(w, F.when(i < 10, 3).otherwise(1).cast("int"))), "")
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(fnv1a32_of_many(joined))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def words(x: Column) -> Column:
    return F.filter(F.split(collapse(x), " "), lambda t: t != "")


def dice(a: Column, b: Column) -> Column:
    """Dice's coefficient of the bigram multisets, white space left out: equal texts 1, a text under two signs 0."""
    bare = lambda x: F.regexp_replace(F.lower(x), WS + "+", "")
    a, b = bare(a), bare(b)
    # A bigram with its number of occurrences so far makes multisets plain sets.
    grams = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))
    numbered = lambda g: F.transform(g, lambda t, i: F.concat(t, F.lit("\x00"), F.size(F.filter(F.slice(g, 1, i + 1), lambda u: u == t)).cast("string")))
    shared = F.size(F.array_intersect(numbered(grams(a)), numbered(grams(b))))
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2.0 * shared / (F.length(a) + F.length(b) - 2))


def truncate(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def base_domain(name: Column) -> Column:
    """The last two labels."""
    parts = F.split(F.regexp_replace(F.lower(name), r"^\*\.", ""), r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2), ".")


def host_label(url: Column) -> Column:
    return F.split_part(domain(url), F.lit("."), F.lit(1))


def chunks(x: Column, most: int = 200, overlap: int = 40) -> Column:
    """Pieces of at most `most` characters that end between words where they can, each begun `overlap` characters before
    the one before it ended, so that the last overlap of a longer text is a piece of its own; white space collapsed."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: [p for a, b in windows(s, most, overlap) if (p := s[a:b].strip(" "))])

    return cut(collapse(F.coalesce(x, F.lit(""))))


def windows(s: str, most: int, overlap: int):
    """Yields (start, end) of the pieces of chunks()."""
    if len(s) <= most:
        yield 0, len(s)
        return
    start = 0
    while start < len(s):
        blank = s.rfind(" ", start + overlap + 1, start + most + 1)
        end = min(len(s), start + most) if start + most >= len(s) or blank < 0 else blank
        yield start, end
        start = end - overlap if end - overlap > start else end


def escape_signs(x: Column) -> Column:
    """Signs with a meaning in markup, each after a backslash."""
    return F.regexp_replace(x, r"([_*\[\]()~`>#+\-=|{}.!\\])", r"\\$1")


def name_of_slug(x: Column) -> Column:
    """Words of a slug with a capital first letter, the rest as it is."""
    parts = F.filter(F.split(F.regexp_replace(x, "[-_]+", " "), " "), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), " ")


def slug_variants(x: Column) -> Column:
    """Ways to write a name in an address: joined, with hyphens, without its legal form, its first word."""
    low = F.lower(normal_company(x))
    joined, hyphens = F.regexp_replace(low, "[^a-z0-9]+", ""), F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.array_distinct(F.filter(F.array(joined, hyphens, F.split_part(hyphens, F.lit("-"), F.lit(1))), lambda s: s != ""))


def ago(then: Column, now: Column) -> Column:
    """The time passed in whole minutes, hours or days."""
    m = F.floor((F.unix_micros(now) - F.unix_micros(then)) / 60_000_000)
    many = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(m < 1, "just now").when(m < 60, many(m, "minute")).when(m < 1440, many(F.floor(m / 60), "hour")).otherwise(many(F.floor(m / 1440), "day"))


def bar(n: Column, most: Column, width: int = 20) -> Column:
    """A bar of `width` signs at most, at least one for a number above 0."""
    size = F.when(n > 0, F.greatest(F.lit(1), round_half_up(F.try_divide(n, most) * width))).otherwise(0).cast("int")
    return F.repeat(F.lit("█"), size)


def message_parts(x: Column, most: int) -> Column:
    """Lines of a text gathered to parts of at most `most` characters; a longer line is a part of its own."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def gather(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: _parts(s, most))

    return gather(F.coalesce(x, F.lit("")))


def _parts(s: str, most: int) -> list[str]:
    parts: list[list[str]] = []
    size = 0
    for line in s.split("\n"):
        if parts and size + 1 + len(line) <= most:
            parts[-1].append(line)
            size += 1 + len(line)
        else:
            parts.append([line])
            size = len(line)
    return ["\n".join(p) for p in parts]


@F.pandas_udf(T.StringType())
def times31(texts: pd.Series) -> pd.Series:
    """The 32-bit signed hash h * 31 + unit over UTF-16 units, without its sign, in base 36; null stays null.

    All texts of a batch advance by one unit in each numpy step."""
    raw = [np.frombuffer(("" if t is None else t).encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    h = np.zeros(len(raw), np.uint32)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        h[live] = h[live] * np.uint32(31) + np.array([raw[i][k] for i in live], np.uint32)
    out = pd.Series([np.base_repr(abs(int(x)), 36).lower() for x in h.view(np.int32)], dtype=object)
    return out.where(texts.notna().to_numpy(), None)


def named_domains(x: Column, most: int = 5) -> Column:
    """The first distinct domains named in a text, in addresses or by themselves."""
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"(?:https?://(?:www\.)?)?([a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|io|ai|dev|org|net|co|example))(?![a-z0-9-])"), F.lit(1))
    return F.slice(F.array_distinct(found), 1, most)
