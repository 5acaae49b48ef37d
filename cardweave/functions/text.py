"""Text, JSON and set expressions over columns; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What keys of an attribute that names an article or a brand contain.
ARTICLE_KEYS = ("артикул", "модель", "партномер", "oem", "код товара", "sku")
BRAND_KEYS = ("бренд", "производитель", "марка")

MAP = "map<string,string>"
JSON_OPTIONS = {"allowSingleQuotes": "false"}


def let(x: Column, of: Callable[[Column], Column]) -> Column:
    """of(x) with x computed once: a lambda would compute it anew for each element that it sees."""
    return F.element_at(F.transform(F.array(x), of), 1)


def blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def normalise(x: Column) -> Column:
    """Lower case, ё as е, runs of letters and digits joined by one space; null is ''."""
    return F.array_join(F.regexp_extract_all(F.translate(F.lower(blank(x)), "ё", "е"), F.lit("[0-9a-zа-яё]+"), 0), " ")


def name_signature(x: Column) -> Column:
    """The normaliser of name groups: without folding ё."""
    return F.trim(F.regexp_replace(F.lower(blank(x)), "[^0-9a-zа-яё]+", " "))


def token_set(x: Column) -> Column:
    """Distinct tokens of a normalised text."""
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(x, " ")))


def grams(x: Column, n: int = 3) -> Column:
    """Distinct n-grams of a normalised text without its spaces; a short text is its own only gram."""

    def of(s: Column) -> Column:
        many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n))))
        return F.when(s == "", F.array().cast("array<string>")).when(F.length(s) <= n, F.array(s)).otherwise(many)

    return let(F.replace(x, F.lit(" "), F.lit("")), of)


def parse_json(x: Column) -> Column:
    """A JSON object as a map, null for anything else."""
    return F.when(x.rlike(r"(?s)^\s*\{.*\}\s*$"), F.from_json(x, MAP, JSON_OPTIONS))


def _last_wins(entries: Column) -> Column:
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"])
    return F.filter(entries, lambda e, i: ~later(e, i))


def json_text(x: Column) -> Column:
    """'k v k v' of a JSON object; anything else as it is; null is ''. A null value reads None."""
    pairs = F.transform(F.map_entries(parse_json(x)), lambda e: F.concat_ws(" ", e["key"], F.coalesce(e["value"], F.lit("None"))))
    return F.coalesce(F.array_join(pairs, " "), x, F.lit(""))


def json_entries(x: Column) -> Column:
    """A JSON object's attributes as entries of normalised keys and values; empty ones go."""
    empty = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.transform(F.coalesce(F.map_entries(parse_json(x)), empty), lambda e: F.struct(normalise(e["key"]).alias("key"), normalise(e["value"]).alias("value")))
    return F.filter(entries, lambda e: (e["key"] != "") & (e["value"] != ""))


def attributes(entries: Column) -> Column:
    """The map of json_entries(); of equal keys the last stays. entries is a column: it is read again for each entry."""
    return F.map_from_entries(_last_wins(entries))


def value_tokens(attrs: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.map_values(attrs), lambda v: F.split(v, " "))))


def tokens_of_keys(attrs: Column, needles: tuple[str, ...]) -> Column:
    """Tokens of the values whose key contains one of needles."""
    return value_tokens(F.map_filter(attrs, lambda k, v: k.rlike("|".join(needles))))


def digit_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike("[0-9]"))


def word_terms(x: Column) -> Column:
    """Words of two characters or more of the lower-cased text, and pairs of adjacent ones."""

    def of(words: Column) -> Column:
        n = F.size(words) - 1
        pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
        return F.when(n > 0, F.concat(words, pairs)).otherwise(words)

    return let(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_]{2,}"), 0), of)


def char_terms(x: Column, shortest: int = 2, longest: int = 5) -> Column:
    """Character n-grams within words, each padded by a space on both sides."""
    words = F.transform(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def parts(padded: Column, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, n))

    def of(padded: Column) -> Column:
        size = F.length(padded)
        each = []
        for n in map(F.lit, range(shortest, longest + 1)):
            each.append(F.when(size >= n, parts(padded, n)).otherwise(F.array().cast("array<string>")))
        return F.concat(*each)

    return F.flatten(F.transform(words, of))
