"""Text and path expressions: folding, keys, scripts, natural order, similarity, lenient readings.

All but ``nfc`` are built-in expressions, so they stay inside code generation. A null argument
gives null unless said otherwise.
"""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HAN_KANA = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def nfc(c: Column) -> Column:
    """NFC; plain ASCII is NFC already."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(_nfc(c))


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only: other scripts keep their case."""
    return F.translate(c, UPPER, LOWER)


def fold(c: Column) -> Column:
    return nfc(F.lower(c))


# paths -------------------------------------------------------------------------------------------


def root_of(key: Column) -> Column:
    return F.substring_index(key, "/", 1)


def rest_of(key: Column) -> Column:
    """What follows the first slash; empty without one."""
    return F.when(F.instr(key, "/") > 0, F.regexp_replace(key, r"^[^/]*/", "")).when(key.isNotNull(), "")


def base_name(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def dir_of(key: Column) -> Column:
    return F.regexp_replace(key, r"/?[^/]*$", "")


def stem(key: Column) -> Column:
    """Base name without its last extension; a leading dot isn't one."""
    return F.regexp_replace(base_name(key), r"(?<=.)\.[^.]*$", "")


def extension(key: Column) -> Column:
    """Lower-case extension, null without one."""
    return F.nullif(F.lower(F.regexp_extract(base_name(key), r"(?<=.)\.([^.]+)$", 1)), F.lit(""))


def platform_dir(key: Column) -> Column:
    """root/platform of root/platform/...; null for shallower keys."""
    parts = F.split(key, "/")
    return F.when(F.size(parts) >= 3, F.concat_ws("/", parts[0], parts[1]))


def in_directory(key: Column, name: str) -> Column:
    """Whether a directory on the way (not the file itself) has this name, ASCII case aside."""
    parts = F.split(ascii_lower(key), "/")
    return F.array_contains(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), name.lower())


def ancestors(key: Column) -> Column:
    """All directories above a key, the topmost first."""
    parts = F.split(key, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


# titles ------------------------------------------------------------------------------------------


def tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def sort_title(c: Column) -> Column:
    return F.upper(tidy(c))


def has_cjk(c: Column) -> Column:
    return c.rlike(HAN_KANA)


def sortable(c: Column) -> Column:
    return ~has_cjk(c)


def language_of(title: Column, region: Column) -> Column:
    """Language by script first, then by region: kana is Japanese, Hangul Korean, Han by region, else Latin names by region."""
    return (
        F.when(title.rlike(r"[\p{IsHiragana}\p{IsKatakana}]"), "ja")
        .when(title.rlike(r"\p{IsHangul}"), "ko")
        .when(title.rlike(r"\p{IsHan}"), F.when(region == "Japan", "ja").otherwise("zh"))
        .when(title.rlike(r"\p{IsCyrillic}"), "ru")
        .when(title.rlike(r"\p{L}"), "en")
        .otherwise("unknown")
    )


def natural_key(c: Column, digits: int = 20) -> Column:
    """Text that sorts numbers inside names by value."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"\d+|\D+"), F.lit(0)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.regexp_replace(x, r"^0+(?=\d)", ""), digits, "0")).otherwise(x)), "")


DISC_MARK = r"(?i)[ _-]*[\(\[]?\b(?:disc|disk|cd|side|part|vol)[ ._-]*([0-9]{1,2}|[a-d])[\)\]]?\s*$"


def disc_family(name: Column) -> Column:
    """Name without a disc mark at its end."""
    return F.regexp_replace(name, DISC_MARK, "")


def has_disc_mark(name: Column) -> Column:
    return name.rlike(DISC_MARK)


def name_key(c: Column) -> Column:
    """Key to match names by: full width to half width, letters and digits only, lower case."""
    return F.lower(F.regexp_replace(F.translate(nfc(c), _WIDE, _NARROW), r"[^\p{IsAlphabetic}\p{N}]", ""))


def alnum(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9A-Za-z]", "")


def worth_querying(key: Column) -> Column:
    """Whether a name key says enough to look for: two Han or kana characters, or four ASCII letters."""
    return (F.length(F.regexp_replace(key, HAN_KANA.replace("[", "[^", 1), "")) >= 2) | (F.length(F.regexp_replace(key, "[^A-Za-z]", "")) >= 4)


def bigrams(c: Column) -> Column:
    """Character bigrams with repeats; a text of one character is its own only gram.

    Taken from parts of 1,000, as finding a place in a long text takes time in proportion to it.
    """
    n = F.length(c)
    of = lambda part: F.transform(F.sequence(F.lit(1), F.length(part) - 1), lambda i: F.substring(part, i, F.lit(2)))
    parts = F.transform(F.sequence(F.lit(1), n - 1, F.lit(1000)), lambda k: F.substring(c, k, F.lit(1001)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(c)).otherwise(F.flatten(F.transform(parts, of)))


def dice_of_grams(a: Column, b: Column) -> Column:
    """Multiset Dice coefficient of two gram lists."""
    count = lambda xs, g: F.size(F.filter(xs, lambda x: x == g))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, g: acc + F.least(count(a, g), count(b, g)))
    return F.when(F.size(a) + F.size(b) > 0, 2.0 * both / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(1.0)).otherwise(dice_of_grams(bigrams(a), bigrams(b)))


# tags of catalogue names ---------------------------------------------------------------------------


def work_title(name: Column) -> Column:
    """Title before the first tag group."""
    return F.trim(F.regexp_extract(name, r"^([^(\[]*)", 1))


def tag_groups(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(r"[(\[]([^)\]]*)[)\]]"), F.lit(1))


def tag_year(name: Column) -> Column:
    """Year at the start of the first round group."""
    return F.nullif(F.regexp_extract(name, r"^[^(]*\(([0-9]{4})", 1), F.lit("")).try_cast("int")


def tag_publisher(name: Column) -> Column:
    """Second round group, of names whose first is a date."""
    return F.nullif(F.trim(F.regexp_extract(name, r"^[^(]*\([0-9x]{4}[^)]*\)\(([^)]*)\)", 1)), F.lit(""))


def revision(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(?i)\((?:rev ([0-9a-z]+(?:\.[0-9]+)*)|v([0-9]+(?:\.[0-9]+)*))\)", 0), F.lit(""))


def region(name: Column, known: list[str]) -> Column:
    """First round group, if all its parts are known regions."""
    first = F.regexp_extract(name, r"^[^(]*\(([^)]*)\)", 1)
    parts = F.transform(F.split(first, ","), lambda x: F.trim(x))
    return F.when((first != "") & F.forall(parts, lambda x: x.isin(known)), F.array_join(parts, ", "))


def serial_key(c: Column, least: int = 4) -> Column:
    """ASCII letters and digits in upper case; null if short or without a letter."""
    key = F.upper(alnum(c))
    return F.when((F.length(key) >= least) & key.rlike("[A-Z]"), key)


# lenient readings: malformed text is a missing value -----------------------------------------------


def read_year(c: Column) -> Column:
    return F.when(c.rlike(r"^[0-9]{4}$"), c).try_cast("int")


def read_rating(c: Column) -> Column:
    """0..1, or a percentage; null out of range."""
    number = F.when(c.rlike(r"^[0-9]+(\.[0-9]+)?%$"), F.regexp_replace(c, "%", "").try_cast("double") / 100).when(c.rlike(r"^[0-9]+(\.[0-9]+)?$"), c.try_cast("double"))
    return F.when(number.between(0, 1), number)


def read_size(c: Column) -> Column:
    """Bytes of ``64 MiB`` and the like."""
    number = F.nullif(F.regexp_extract(c, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGT]i?)?B?\s*$", 1), F.lit("")).try_cast("double")
    unit = F.regexp_extract(c, r"^\s*[0-9.]+\s*([KMGT]i?)?B?\s*$", 1)
    power = F.when(unit.startswith("K"), 1).when(unit.startswith("M"), 2).when(unit.startswith("G"), 3).when(unit.startswith("T"), 4).otherwise(0)
    factor = F.pow(F.when(unit.endswith("i"), 1024.0).otherwise(1000.0), power)
    return F.floor(number * factor).cast("long")


def read_players(c: Column) -> Column:
    """struct(least, most) of ``4`` or ``1-4``."""
    parts = F.split(F.regexp_replace(c, r"\s", ""), "-")
    least, most = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.size(parts) - 1).try_cast("int")
    return F.when((F.size(parts) <= 2) & (least <= most), F.struct(least.alias("least"), most.alias("most")))


def read_partial_date(c: Column) -> Column:
    """struct(year, month, day) of ``1994``, ``1994-05``, ``1994-05-17`` or ``19940517T000000``; parts not there are null."""
    flat = F.regexp_replace(F.regexp_replace(c, r"T.*$", ""), "-", "")
    part = lambda at, n: F.nullif(F.substring(flat, at, n), F.lit("")).try_cast("int")
    year, month, day = part(1, 4), part(5, 2), part(7, 2)
    good = flat.rlike(r"^[0-9]{4}([0-9]{2}([0-9]{2})?)?$") & F.coalesce(month.between(1, 12), F.lit(True)) & F.coalesce(day.between(1, 31), F.lit(True))
    return F.when(good, F.struct(year.alias("year"), month.alias("month"), day.alias("day")))


def mark_of(name: Column) -> Column:
    """Chinese by a fan's translation, told by a square group, before an official one, told by a round group of languages; else null."""
    groups = lambda pattern: F.transform(F.regexp_extract_all(name, F.lit(pattern), F.lit(1)), F.lower)
    fan = F.exists(groups(r"\[([^\]]*)\]"), lambda g: g.rlike(r"^(?:tr\s+zh(?:-\S*)?(?:\s|$)|t[+-]chi)"))
    language = r"\s*[a-z]{2}(?:-[a-z0-9]+)?\s*"
    official = F.exists(groups(r"\(([^)]*)\)"), lambda g: g.rlike(rf"^{language}(?:,{language})*$") & g.rlike(r"(?:^|,)\s*zh(?:-[a-z0-9]+)?\s*(?:,|$)"))
    return F.when(fan, "fan").when(official, "official")


def translation_group(name: Column) -> Column:
    """Who translated, of the first square group ``tr zh ...`` or ``tr chi ...``; null if it names nobody."""
    groups = F.transform(F.regexp_extract_all(name, F.lit(r"\[([^\]]*)\]"), F.lit(1)), lambda g: F.trim(F.regexp_replace(g, r"(?U)\s+", " ")))
    first = F.get(F.filter(groups, lambda g: g.rlike(r"^tr (?:zh\S*|chi)(?: |$)")), F.lit(0))
    return F.nullif(F.regexp_replace(first, r"^tr \S+ ?", ""), F.lit(""))


def fold_platform(c: Column) -> Column:
    """A platform's name without case, white space and ``-._``."""
    return F.regexp_replace(fold(c), r"(?U)[\s\-._]", "")


PATCHES = ["ips", "ups", "bps", "aps", "ppf", "xdelta", "xdelta3", "vcdiff", "rup", "dps", "ebp"]  # fixed values


def patch_extension(key: Column) -> Column:
    """Extension of a patch, null for anything else."""
    return F.when(extension(key).isin(PATCHES), extension(key))


@cache
def _cases() -> dict[str, str]:
    """Characters by the first character of their lower case."""
    out: dict[str, str] = {}
    for ch in (chr(n) for n in range(0x20000) if not 0xD800 <= n < 0xE000):
        if ch.lower() != ch:
            out[ch.lower()[0]] = out.get(ch.lower()[0], "") + ch
    return out


def _glob(pattern: str) -> str:
    """Java pattern of a small glob: ``#`` a digit, ``@`` a letter of A-Z, ``*`` anything, case ignored; ValueError if empty or with over four ``*``."""
    if not pattern or pattern.count("*") > 4:
        raise ValueError(f"not a pattern: {pattern!r}")
    units = {"#": "[0-9]", "@": "[A-Za-z]", "*": ".*"}
    alike = lambda low: "[" + re.escape(low) + _cases().get(low, "") + "]"
    return "".join(units.get(ch) or alike(ch.lower()[0]) for ch in pattern)


def matches_glob(c: Column, pattern: str) -> Column:
    """Whether a whole text matches a small glob."""
    return c.rlike(rf"(?s)^{_glob(pattern)}\z")


def without_glob_suffix(c: Column, pattern: str) -> Column:
    """What stands before the longest end that matches a small glob and starts the text or follows a blank, bracket or mark; null if none does."""
    found = rf"(?s)^(|.*?(?:(?U:\s)|[-()\[\]{{}}_.、（［【）］】])){_glob(pattern)}\z"
    return F.when(c.rlike(found), F.regexp_extract(c, found, 1))


def format_rating(v: Column) -> Column:
    """A rating from 0 to 1 in tenths, as short as can be: ``0.7``, ``1``."""
    tenths = F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 10 + F.lit(0.5)) / 10
    return F.regexp_replace(tenths.cast("string"), r"\.0$", "")


def utf16_units(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def common_prefix(texts_min: Column, texts_max: Column) -> Column:
    """Common prefix of all texts of a group, from the least and the greatest of them."""
    n = F.least(F.length(texts_min), F.length(texts_max))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substring(texts_min, F.lit(1), i) == F.substring(texts_max, F.lit(1), i)))
    return F.substring(texts_min, F.lit(1), F.coalesce(F.array_max(same), F.lit(0)))
