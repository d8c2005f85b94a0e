"""Text functions: comparable keys, folding by ordered rules, vocabulary matches, numbers and dates in prose.

All are Column -> Column and stay in generated code, but for ``norm_key``, whose canonical decomposition Spark lacks; it
is one Arrow batch function. Rules and vocabularies are parameters, given in the order in which they apply.
Null in gives null out unless a docstring says otherwise. Names in brackets are rows of the operator inventory.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that count as an apostrophe and are dropped from keys.
APOSTROPHES = "'’‘ʼ`´′"
_ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ"
_PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy"


@F.pandas_udf(T.StringType())
def norm_key(values):
    """Comparable key: apostrophes dropped, decomposed, accents stripped, & read as "and", others than a-z0-9 one space. [STR01]"""
    import re
    import unicodedata

    drop = str.maketrans("", "", APOSTROPHES)

    def one(value):
        if value is None:
            return None
        plain = unicodedata.normalize("NFKD", value.translate(drop))
        plain = "".join(c for c in plain if not unicodedata.combining(c)).lower().replace("&", " and ")
        return re.sub("[^a-z0-9]+", " ", plain).strip()

    return values.map(one, na_action="ignore")


def latin_key(c: Column) -> Column:
    """norm_key for Latin-1 text, within generated code. [STR01]"""
    plain = F.lower(F.translate(F.translate(c, APOSTROPHES, ""), _ACCENTED, _PLAIN))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "&", " and "), "[^a-z0-9]+", " "))


def slugify(c: Column) -> Column:
    """Lower case, runs of other characters than a-z0-9 one dash, none at the ends. [STR02]"""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def collapsed(c: Column) -> Column:
    """White space collapsed and trimmed; null stays null. [STR03]"""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Replacements (pattern, replacement) one after the other, in the given order. [STR04, STR06, STR07, STR22]"""
    return functools.reduce(lambda x, rule: F.regexp_replace(x, *rule), rules, c)


#: Tidying of titles that came out of joining and cutting.
TIDY = ((r"\s+", " "), (r"\s+([,;:)])", "$1"), (r"([(])\s+", "$1"), (r"([,;:])\1+", "$1"), (r"\(\s*\)", ""), (r"^[\s,;:–-]+", ""), (r"[\s,;:–-]+$", ""))


def split_title(c: Column, places: Sequence[str] = ()) -> Column:
    """"Name (From - To), 20% off" -> struct(trip, promotion, port_from, port_to).

    A pair in brackets of which a part is one of ``places`` (as norm-like lower case) isn't a pair of ports. [STR05]
    """
    pair = r"\(([^()–-]+?)\s*[–-]\s*([^()–-]+?)\)"
    a, b = F.trim(F.regexp_extract(c, pair, 1)), F.trim(F.regexp_extract(c, pair, 2))
    ports = (a != "") & ~F.lower(a).isin(*places) & ~F.lower(b).isin(*places) if places else a != ""
    promotion = F.regexp_extract(c, r"(?i)([^,(]*\b[0-9]+\s*%\s*(?:off|discount)\b.*|\bspecial offer\b.*)$", 1)
    bare = F.regexp_replace(c, r"(?i)([^,(]*\b[0-9]+\s*%\s*(?:off|discount)\b.*|\bspecial offer\b.*)$", "")
    trip = fold(F.when(ports, F.regexp_replace(bare, pair, "")).otherwise(bare), TIDY)
    return F.struct(trip.alias("trip"), F.nullif(F.trim(promotion), F.lit("")).alias("promotion"), F.when(ports, a).alias("port_from"), F.when(ports, b).alias("port_to"))


def parts(c: Column) -> Column:
    """Parts between commas, ampersands and "and", trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, r"\s*(?:,|&|\band\b)\s*"), F.trim), lambda x: x != "")


def is_vocabulary_list(c: Column, vocabulary: Sequence[str]) -> Column:
    """Two parts or more, each in the vocabulary (keys as of latin_key). [STR08]"""
    known = F.array(*[F.lit(v) for v in vocabulary])
    return (F.size(parts(c)) >= 2) & F.forall(parts(c), lambda x: F.array_contains(known, latin_key(x)))


def joined_list(items: Column, last: str = " & ") -> Column:
    """"A, B & C" of an array; null items are left out. [STR09, STR34]"""
    kept = F.array_compact(items)
    n = F.size(kept)
    head = F.array_join(F.slice(kept, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n <= 1, F.array_join(kept, "")).otherwise(F.concat(head, F.lit(last), F.element_at(kept, -1)))


def display_title(c: Column, errors: Sequence[tuple[str, str]] = (), spellings: Sequence[tuple[str, str]] = (), vocabulary: Sequence[str] = ()) -> Column:
    """Known errors mended, spellings folded, place lists with house separators, then tidied. [STR10]"""
    x = fold(fold(c, errors), spellings)
    if vocabulary:
        x = F.when(is_vocabulary_list(x, vocabulary), joined_list(parts(x))).otherwise(x)
    return fold(x, TIDY)


def aliased(c: Column, aliases: Mapping[str, str], unknown: str | None = None) -> Column:
    """The alias of the lower-case value, else the value; null and blank give ``unknown``. [STR11]"""
    x = F.trim(c)
    if aliases:
        known = F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair])
        x = F.coalesce(F.try_element_at(known, F.lower(x)), x)
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(unknown)) if unknown is not None else F.nullif(x, F.lit(""))


def vocabulary_matches(c: Column, hints: Sequence[tuple[str, str]], names: Sequence[tuple[str, str]] = ()) -> Column:
    """Canonical names whose (key, name) key stands in the text as whole words; hints first, then names, each once. [STR12, STR17, JOI17]"""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (*hints, *names)])
    # The key stands in an array, so that it is made once a text and not once a pair.
    key = F.array(F.concat(F.lit(" "), latin_key(c), F.lit(" ")))
    named = lambda text: F.transform(F.filter(pairs, lambda p: F.contains(text, F.concat(F.lit(" "), p["k"], F.lit(" ")))), lambda p: p["v"])
    return F.array_distinct(F.flatten(F.transform(key, named)))


def matches_of_list(items: Column, entries: Mapping[str, str], hints: Sequence[tuple[str, str]]) -> Column:
    """Names of a curated list: an entry's own alias, else the vocabulary's matches in it; each once, in order. [STR13]"""
    own = F.create_map(*[F.lit(v) for pair in entries.items() for v in pair]) if entries else None

    def one(x: Column) -> Column:
        found = vocabulary_matches(x, hints)
        return F.when(F.try_element_at(own, latin_key(x)).isNotNull(), F.array(F.try_element_at(own, latin_key(x)))).otherwise(found) if own is not None else found

    return F.array_distinct(F.flatten(F.transform(items, one)))


def matches_of_sections(intro: Column, sections: Column, hints: Sequence[tuple[str, str]], day_pattern: str = r"(?i)^day\b") -> Column:
    """Names in the intro, in all headings, and in the text of sections whose heading is a day. [STR14]"""
    texts = F.flatten(F.transform(sections, lambda s: F.when(F.rlike(s["heading"], F.lit(day_pattern)), F.array(s["heading"], s["body"])).otherwise(F.array(s["heading"]))))
    return F.array_distinct(F.flatten(F.transform(F.concat(F.array(intro), F.coalesce(texts, F.array())), lambda t: vocabulary_matches(F.coalesce(t, F.lit("")), hints))))


def ordered_union(a: Column, b: Column) -> Column:
    """a, then what of b has a key that a lacks. [STR15, SET09]"""
    keys = F.transform(a, latin_key)
    return F.concat(a, F.filter(b, lambda x: ~F.array_contains(keys, latin_key(x))))


def first_rule(c: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern found in the text. [STR16, STR27, EXT33]"""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(F.rlike(c, F.lit(pattern)), F.lit(label)).otherwise(out)
    return F.when(c.isNotNull(), out)


def families(c: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns the text matches. [STR28]"""
    return functools.reduce(lambda a, b: a + b, [F.rlike(c, F.lit(p)).cast("int") for p in patterns], F.lit(0))


def classify_label(c: Column, rules: Sequence[tuple[str, str]], tail: str, components: Sequence[str], combined: str, longest: int = 60) -> Column:
    """Code of a label: none if blank or too long; a tail word with two component families or more is combined; else the first rule. [STR27, STR28, STR29]"""
    x = collapsed(c)
    return F.when((x == "") | (F.length(x) > longest), None).when(F.rlike(x, F.lit(tail)) & (families(x, components) >= 2), F.lit(combined)).otherwise(first_rule(x, rules))


def bounded_number(c: Column, patterns: Sequence[str], low: int, high: int) -> Column:
    """The first group of the first pattern that matches with a number within the bounds. [STR18, STR33, EXT24, EXT35]"""
    found = [F.regexp_extract(c, p, 1).try_cast("int") for p in patterns]
    return F.coalesce(*[F.when(x.between(low, high), x) for x in found])


def first_integer(c: Column) -> Column:
    """The first run of digits, 0 if there is none. [STR19]"""
    return F.coalesce(F.regexp_extract(c, r"([0-9]+)", 1).try_cast("int"), F.lit(0))


def last_segment(c: Column, tokens: Mapping[str, str]) -> Column:
    """What the last segment of a URL or path stands for, null if unknown. [STR20]"""
    known = F.create_map(*[F.lit(v) for pair in tokens.items() for v in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(c, r"([^/]+)/?$", 1)))


def loose_key(c: Column) -> Column:
    """Accents, the word "and" and all but a-z0-9 dropped. [STR21]"""
    return F.regexp_replace(F.regexp_replace(F.lower(F.translate(c, _ACCENTED, _PLAIN)), r"\band\b", ""), "[^a-z0-9]", "")


def iso_day(c: Column) -> Column:
    """The date that a timestamp text begins with, null if it is none. [STR23, STR24]"""
    return F.try_to_date(F.regexp_extract(c, r"^\s*([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd")


def number(c: Column) -> Column:
    """A number with thousands separators, and perhaps a full stop behind it. [STR25]"""
    return F.regexp_replace(F.regexp_replace(F.trim(c), ",", ""), r"\.$", "").try_cast("double")


GLYPHS = {"€": "EUR", "$": "USD", "£": "GBP"}


def money_text(c: Column, default: str = "EUR") -> Column:
    """struct(amount, currency) of the first amount with a glyph or a three-letter code; without one, the default. [STR26]"""
    pattern = r"(€|\$|£|[A-Z]{3})?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(€|\$|£|[A-Z]{3})?"
    mark = F.coalesce(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(c, pattern, 3), F.lit("")))
    known = F.create_map(*[F.lit(v) for pair in GLYPHS.items() for v in pair])
    return F.struct(number(F.regexp_extract(c, pattern, 2)).alias("amount"), F.coalesce(F.try_element_at(known, mark), mark, F.lit(default)).alias("currency"))


def tier_for(code: Column, required: Column, optional_codes: Sequence[str], gratuity_codes: Sequence[str]) -> Column:
    """Tier of a stated charge: customary for gratuities, else mandatory where required and not by nature optional. [STR30]"""
    return F.when(code.isin(*gratuity_codes), "customary").when(code.isin(*optional_codes) | ~F.coalesce(required, F.lit(False)), "optional").otherwise("mandatory")


def without_noise(slug: Column, noise: Sequence[str]) -> Column:
    """A slug's words less the noise words. [STR31]"""
    return F.array_join(F.array_except(F.split(slug, "-"), F.array(*[F.lit(n) for n in noise])), "-")


def split_slug(path: Column) -> Column:
    """"name-123" -> struct(slug, id); id null where there is none. [STR32]"""
    last = F.regexp_extract(path, r"([^/]+)/?$", 1)
    return F.struct(F.regexp_replace(last, "-[0-9]+$", "").alias("slug"), F.nullif(F.regexp_extract(last, "-([0-9]+)$", 1), F.lit("")).alias("id"))


def strip_fence(c: Column) -> Column:
    """Body of a log entry between its code fences, else the entry. [STR35]"""
    body = F.regexp_extract(c, r"(?s)```[a-z]*\n(.*?)\n?```", 1)
    return F.trim(F.when(F.rlike(c, F.lit("```")), body).otherwise(c))


def noted_unit(note: Column, basis: Column, lender: Column) -> Column:
    """A note that says whose unit was taken; an earlier such remark is replaced. [STR36]"""
    bare = F.trim(F.regexp_replace(F.coalesce(note, F.lit("")), r"\s*\[unit [^\]]*\]", ""))
    return F.trim(F.concat(bare, F.lit(" [unit "), basis, F.lit(" as stated by "), lender, F.lit("]")))


def visible_text(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, block ends as commas, tags off, entities read, white space collapsed. [EXT09]"""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?i)</(p|div|li|tr|h[1-6]|td|th)\s*>|<br\s*/?>", ", ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(collapsed(x), r"(?:\s*,)+", ","), "^[, ]+|[, ]+$", "")
