"""Text expressions, native. White space is that of Unicode with the byte-order mark; letters fold by Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadspark.constants import CHARS_PER_TOKEN, COUNTRY_ALIASES, STOPWORDS

SPACE = r"(?U)[\s\x{FEFF}]+"
#: An edge of a run of ASCII word characters; Java's \b takes other letters in.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    return pattern.replace(r"\b", EDGE)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def non_empty(c: Column) -> Column:
    return F.when(c != "", c)


def trim_to(c: Column, most: int) -> Column:
    """Collapsed text; a longer one is cut and ends in an ellipsis; null for nothing."""
    t = collapse(c)
    return F.when(t != "", F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))))


def clean_title(c: Column) -> Column:
    first = strip(F.get(F.split(c, r"(?U)[\s\x{FEFF}]+[|–—·-][\s\x{FEFF}]+", 2), F.lit(0)))
    return F.when(F.length(first).between(2, 99), first).otherwise(non_empty(F.substring(strip(c), 1, 100)))


def clean_company_name(c: Column) -> Column:
    t = F.regexp_replace(c, SPACE, " ")
    t = F.regexp_replace(t, r"(?U)^[\s|–—·,-]+|[\s|–—·,-]+$", "")
    t = strip(F.regexp_replace(t, r"(?iU)\s*[-–—|]\s*(home|homepage|startseite|official site|offizielle seite)$", ""))
    return F.when(F.length(t).between(2, 200), t)


def meaningful_words(c: Column) -> Column:
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(STOPWORDS)))


def token_overlap(wanted: Column, text: Column) -> Column:
    """Share of the wanted text's meaningful words that the other text has."""
    w = meaningful_words(wanted)
    return F.when(F.size(w) > 0, F.size(F.array_intersect(w, meaningful_words(F.coalesce(text, F.lit(""))))) / F.size(w)).otherwise(0.0)


def joined(*parts: Column) -> Column:
    """Parts that aren't null, arrays spread out, with spaces."""
    return F.concat_ws(" ", *parts)


def keyword_hits(haystack: Column, keywords: Column) -> Column:
    return F.size(F.filter(keywords, lambda k: (strip(k) != "") & F.contains(haystack, F.lower(k))))


def canonical_country(c: Column) -> Column:
    k = F.lower(strip(c))
    out = k
    for name, aliases in COUNTRY_ALIASES.items():
        out = F.when(k.isin(aliases), F.lit(name)).otherwise(out)
    return out


def _either_contains(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def matches_country(value: Column, candidates: Column) -> Column:
    v = canonical_country(value)
    return F.coalesce(F.exists(candidates, lambda c: _either_contains(v, canonical_country(c))), F.lit(False))


def matches_any(value: Column, candidates: Column) -> Column:
    v = F.lower(strip(value))
    return F.coalesce(F.exists(candidates, lambda c: _either_contains(v, F.lower(strip(c)))), F.lit(False))


def employee_bounds(count: Column, given: Column) -> Column:
    """struct(low, high) from an exact count or a written range; high is infinite for an open one; null if unknown."""
    numbers = F.transform(F.regexp_extract_all(given, F.lit(r"(\d[\d,.]*)"), F.lit(1)), lambda n: F.regexp_replace(n, "[,.]", "").try_cast("double"))
    is_open = (F.size(numbers) == 1) & given.rlike(r"(?i)\+|over|more than|mehr als")
    high = F.when(is_open, F.lit(float("inf"))).otherwise(F.array_max(numbers))
    ranged = F.when(F.size(numbers) > 0, F.struct(F.array_min(numbers).alias("low"), high.alias("high")))
    return F.when(count.isNotNull(), F.struct(count.cast("double").alias("low"), count.cast("double").alias("high"))).otherwise(ranged)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), c.cast("double")))


def round2(c: Column) -> Column:
    """Halves go up, as doubles stand."""
    return F.floor(c * 100 + F.lit(0.5)) / F.lit(100.0)


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / F.lit(CHARS_PER_TOKEN)).cast("int")


def clamp_to_tokens(c: Column, tokens: int) -> Column:
    """At most so many tokens, cut after a sentence if one ends in the last 15 percent."""
    most = int(tokens * CHARS_PER_TOKEN)
    head = F.substring(c, 1, most)
    at = F.length(head) - F.instr(F.reverse(head), " .") - 1  # place of the last ". ", from 0
    cut = F.when((F.instr(F.reverse(head), " .") > 0) & (at > most * 0.85), F.substring(head, F.lit(1), at + 1)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(cut)


def without_blanks(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull() & (x != ""))
