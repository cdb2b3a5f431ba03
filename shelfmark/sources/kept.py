"""Frontend files kept whole: own values go into files that others wrote, everything else stays as it is.

A file's text is cut into segments, entries and what lies between, whose texts one after the other are
the file's. Own values join entries by key; an entry takes over values that differ and keeps
everything it says besides: other fields, comments, order, blanks and line ends. Entries that the
file doesn't have follow its own. So import, export and import again give the same table, and bytes
that aren't ours don't change. Files are a row each (they are lists for people, not data sets);
segments spread over all tasks.
"""

from __future__ import annotations

import re
from html import escape, unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIST, LINES = "list", "lines"  # XML game lists, and ``key: value`` lines
# Java patterns of segments: an entry, or a comment that may hold one.
_CUTS = {LIST: r"(?s)<!--.*?-->|<game(?:\s[^>]*)?>.*?</game>", LINES: r"(?m)^game:[^\n]*(?:\n(?!game:|collection:)[^\n]*)*\n?"}
_KEYS = {LIST: r"(?s)^<game.*?<path>\s*(.*?)\s*</path>", LINES: r"(?m)^files?:[ \t]*(?:\r?\n[ \t]+)?([^\r\n]*?)[ \t]*(?:\r?$|\r?\n)"}
# Characters that XML 1.0 has no place for, and lines that would read as empty ones (fixed values of the formats).
_CANT = {LIST: "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", LINES: "\\x00|(?m:^[ \\t]*\\.[ \\t]*$)"}
# Fields that a format has a place for (fixed values of the formats); any other is lost in it.
CARRIES = {
    LIST: ("path", "name", "desc", "image", "video", "marquee", "rating", "releasedate", "developer", "publisher", "genre", "players", "lang", "region", "favorite", "hidden", "sortname"),
    LINES: ("game", "file", "sort-by", "summary", "description", "rating", "release", "developer", "publisher", "genre", "tag", "players"),
}


def segments(files: DataFrame, kind: str) -> DataFrame:
    """(file, ordinal, text, key) for files (file, text): consecutive parts; a key for entries that state one, else null."""
    cut = _CUTS[kind]
    both = files.select("file", F.regexp_extract_all("text", F.lit(cut), F.lit(0)).alias("found"), F.split("text", cut, -1).alias("between"))
    parts = F.flatten(F.zip_with("between", "found", lambda a, b: F.array(a, b)))  # one more between than found
    each = both.select("file", F.posexplode(parts).alias("ordinal", "text")).where("text is not null and text <> ''")
    key = F.nullif(F.regexp_extract("text", _KEYS[kind], 1), F.lit(""))
    key = F.when(F.col("text").rlike(r"^<game[\s>]" if kind == LIST else r"^game:"), key)
    if kind == LIST:
        for sign, means in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            key = F.replace(key, F.lit(sign), F.lit(means))
    return each.withColumn("key", key)


def _field_of_list(text: str, field: str, value: str | None) -> str:
    found = re.search(rf"(?s)(\s*)<{re.escape(field)}(?:\s[^>]*)?(?:/>|>(.*?)</{re.escape(field)}>)", text)
    if value is None:
        return text if not found else text[: found.start()] + text[found.end() :]
    if found and unescape(found[2] or "").strip() == value.strip():
        return text
    new = f"<{field}>{escape(value, False)}</{field}>"
    if found:
        return text[: found.start()] + found[1] + new + text[found.end() :]
    body = text[: text.rindex("</game>")].rstrip()
    indent = re.match(r"<game[^>]*>(\s*)<", text)  # as the entry's first element has it
    return body + (indent[1] if indent else "") + new + text[len(body) :]


def _field_of_lines(text: str, field: str, value: str | None) -> str:
    end = "\r\n" if "\r\n" in text else "\n"
    found = re.search(rf"(?m)^{re.escape(field)}:[^\n]*(?:\n[ \t]+[^\n]*)*(?:\n|\Z)", text)
    if found and value is not None:
        first, *more = found[0].rstrip("\r\n").replace("\r\n", "\n").split("\n")
        said = "\n".join([*filter(None, [first.partition(":")[2].strip()]), *("" if m.strip() == "." else m.strip() for m in more)])
        if said == value.strip():
            return text
    lines = [] if value is None else value.strip().split("\n")
    new = "" if value is None else f"{field}: " + f"{end}  ".join([lines[0], *(m.strip() or "." for m in lines[1:])]) + end
    if found:
        return text[: found.start()] + new + text[found.end() :]
    if not new:
        return text
    body = text.rstrip("\r\n \t")
    blank = text[len(body) :]
    cut = blank.find("\n") + 1
    return body + (blank[:cut] or end) + new + blank[cut:]


def put(text: str, kind: str, values: dict[str, str | None]) -> str:
    """An entry with these values; a null takes the field out, a value that is there already changes nothing."""
    for field, value in values.items():
        text = (_field_of_list if kind == LIST else _field_of_lines)(text, field, value)
    return text


def merged(files: DataFrame, own: DataFrame, kind: str) -> DataFrame:
    """(file, text, changed, added): files (file, text) with own values (file, key, field, value, ordinal) in them.

    An entry whose key (its path) isn't in the file is added after the last one, in order of ordinal; its
    own field for the key comes first. A file that isn't there yet, so has a null or empty text, is made
    new. Cases: of several entries of one key all take the values; of several values of one field the greatest;
    null keys and fields are left out; values no format can hold (see ``losses``) must be left out before.
    """
    parts = segments(files.select("file", F.coalesce("text", F.lit("")).alias("text")), kind)
    mine = own.where("file is not null and key is not null and field is not null").groupBy("file", "key", "field").agg(F.max("value").alias("value"), F.min("ordinal").alias("ordinal"))
    # as many as an entry has fields
    mine = mine.groupBy("file", "key").agg(F.sort_array(F.collect_list(F.struct("ordinal", "field", "value"))).alias("fields"))

    @F.pandas_udf("string")
    def taken(texts: pd.Series, fields: pd.Series) -> pd.Series:
        return pd.Series([t if f is None else put(t, kind, {x["field"]: x["value"] for x in f}) for t, f in zip(texts, fields, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def made(keys: pd.Series, fields: pd.Series) -> pd.Series:
        def one(key, f):
            values = {x["field"]: x["value"] for x in f if x["value"] is not None}
            if kind == LIST:
                inner = {"path": key, **{a: b for a, b in values.items() if a != "path"}}
                return "\t<game>\n" + "".join(f"\t\t<{a}>{escape(b, False)}</{a}>\n" for a, b in inner.items()) + "\t</game>\n"
            named = {"game": values.get("game", key), "file": key, **{a: b for a, b in values.items() if a not in ("game", "file")}}
            return "\n" + put("", LINES, named).lstrip("\n")

        return pd.Series([one(k, f) for k, f in zip(keys, fields, strict=True)], dtype=object)

    old = parts.join(mine, ["file", "key"], "left").select("file", "ordinal", "text", taken("text", "fields").alias("new"), F.lit(0).alias("added"))
    there = parts.where("key is not null").select("file", "key").distinct()
    extra = mine.join(there, ["file", "key"], "left_anti").withColumn("at", F.col("fields")[0]["ordinal"])
    more = extra.select("file", F.struct(F.col("at"), F.col("key"), made("key", "fields").alias("text")).alias("e"))
    more = more.groupBy("file").agg(F.sort_array(F.collect_list("e")).alias("e")).select("file", F.array_join(F.transform("e", lambda x: x["text"]), "").alias("more"), F.size("e").alias("added"))
    whole = old.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("ordinal", "new"))).alias("p"), F.count(F.when(F.col("new") != F.col("text"), 1)).alias("changed"))
    both = whole.select("file", F.array_join(F.transform("p", lambda x: x["new"]), "").alias("old"), "changed").join(more, "file", "full")
    text, new = F.coalesce("old", F.lit("")), F.coalesce("more", F.lit(""))
    if kind == LIST:
        fresh = F.concat(F.lit('<?xml version="1.0"?>\n<gameList>\n'), new, F.lit("</gameList>\n"))
        at = F.length(text) - F.locate(">tsiLemag/<", F.reverse(text)) - 10  # what stands before the last end of the root
        inside = F.concat(F.substring(text, F.lit(1), at), new, F.substring(text, at + 1, F.length(text)))
        joined = F.when(text == "", fresh).when(F.contains(text, F.lit("</gameList>")), inside).otherwise(F.concat(text, new))
    else:
        joined = F.when(text == "", F.regexp_replace(new, r"^\n", "")).when(text.rlike(r"\n\z"), F.concat(text, new)).otherwise(F.concat(text, F.lit("\n"), new))
    out = F.when(new == "", text).otherwise(joined)
    merged_ = both.select("file", out.alias("text"), F.coalesce("changed", F.lit(0)).alias("changed"), F.coalesce("added", F.lit(0)).alias("added"))
    asked = files.select("file").distinct()
    return asked.join(merged_, "file", "full").select("file", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("changed", F.lit(0)).alias("changed"), F.coalesce("added", F.lit(0)).alias("added"))


def losses(own: DataFrame, kind: str) -> DataFrame:
    """Own values (.., field, value) that a format can't carry, with (why): no place for the field, or characters it can't hold."""
    why = F.when(~F.col("field").isin(*CARRIES[kind]), "no such field").when(F.col("value").rlike(_CANT[kind]), "characters")
    return own.withColumn("why", why).where("why is not null")


def round_trips(files: DataFrame, kind: str) -> DataFrame:
    """(file, identical, line): whether a file, read and written with its own values, is the same; the first line that isn't."""
    parts = segments(files.select("file", F.coalesce("text", F.lit("")).alias("text")), kind).select("file", "ordinal", "text")
    back = parts.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "").alias("back"))
    both = files.join(back, "file", "left").withColumn("back", F.coalesce("back", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    pairs = F.zip_with(F.split("text", "\n"), F.split("back", "\n"), lambda a, b: a.eqNullSafe(b))
    return both.select("file", (F.col("text") == F.col("back")).alias("identical"), F.nullif(F.coalesce(F.array_position(pairs, False), F.lit(0)), F.lit(0)).alias("line"))


def export_states(targets: DataFrame, snapshots: DataFrame, force: bool = False) -> DataFrame:
    """(file, state, write): new, aligned with the last snapshot, changed by others since, or never seen; only the first two are written, unless forced.

    ``targets`` has (file, text), a null text for a file that isn't there; ``snapshots`` (file, at, text).
    """
    last = snapshots.groupBy(F.col("file").alias("_f")).agg(F.max_by("text", "at").alias("_t"))
    both = targets.join(last, F.col("file") == F.col("_f"), "left")
    state = F.when(F.col("text").isNull(), "new").when(F.col("_f").isNull(), "unknown").when(F.col("text").eqNullSafe(F.col("_t")), "aligned").otherwise("changed")
    out = both.withColumn("state", state)
    return out.select("file", "state", (F.lit(force) | F.col("state").isin("new", "aligned")).alias("write"))
