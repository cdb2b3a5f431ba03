"""What file names say: their kind by extension, and the title under the marks that collectors put around it.

``parsed`` takes a name apart step by step, and each step is a column expression that records what it
took and by which rule, so a reader sees where a title came from and which marks no rule knows.
Word lists are a table of rules (``NameRules``), read from a file or given; none is built in. Names are
compared in lower case; give them in NFC, as keys of a catalogue are.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# Extensions by what they are (fixed values), in the order in which they are asked for.
CONTAINERS = "zip 7z rar cbz zst".split()
COMPRESSED_IMAGES = "chd cso ciso zso dax jso pbp rvz wia wbfs gcz wux".split()
BARE_FILES = (
    "nes unf unif fds sfc smc swc fig gb gbc sgb gba agb nds dsi srl ids n64 z64 v64 ndd md gen smd 32x sms gg sg pce sgx ws wsc ngp ngc lnx lyx a26 a78 col int vec vb min jag j64 rom prg d64 adf "
    "3ds cci cxi cia 3dsx xci nsp vpk pkg wad dol elf self sfo edat xex xbe wud wup tik tmd nsz xcz iso img gcm cue bin gdi cdi mdf mds nrg ccd sub toc raw ape wv"
).split()
MEDIA = "jpg jpeg png gif webp bmp tga ico mp4 mkv avi webm mov mpg mp3 ogg wav flac xml json lpl dat yml yaml toml".split()
DOCUMENTS = "txt md doc docx pdf nfo diz html htm mht mhtml rtf chm url xls xlsx ppt pptx epub log csv".split()
PROGRAMS = "exe dll msi dmg apk deb appimage so dylib bat cmd sh ps1 jar lnk com scr ocx sys".split()
PARTIAL = "part crdownload download opdownload partial aria2 ut td xltd dtapart unconfirmed filepart tmp temp bak old !qb".split()
JUNK_NAMES = [".ds_store", "thumbs.db", "ehthumbs.db", "desktop.ini", ".directory", ".localized", "icon\r"]
METADATA_NAMES = ["metadata.pegasus.txt", "metadata.txt", "gamelist.xml", "miyoogamelist.xml", "collections.txt"]
_SEGMENT = r"\.(part[0-9]+\.rar|r[0-9]{2}|z[0-9]{2}|(7z|zip|rar)\.[0-9]{3}|[0-9]{3})$"
_LATER = r"\.(part0*([2-9]|[1-9][0-9]+)\.rar|r[0-9]{2}|z[0-9]{2}|(7z|zip|rar)\.(?!001$)[0-9]{3})$"


def classified(key: Column) -> Column:
    """(category, suspect, later_part): container, compressed image, bare file, media or unclassified; why a file is suspect; whether it continues another."""
    name = F.lower(T.base_name(key))
    ext = T.extension(key)
    junk = name.isin(JUNK_NAMES) | F.startswith(name, F.lit("._"))
    kinds = [(CONTAINERS, "container"), (COMPRESSED_IMAGES, "compressed image"), (BARE_FILES, "bare file"), (MEDIA, "media")]
    suspects = [(DOCUMENTS, "document"), (PROGRAMS, "program"), (PARTIAL, "partial download")]
    category = F.when(junk, "unclassified").when(name.isin(METADATA_NAMES), "media")
    for some, kind in kinds:
        category = category.when(ext.isin(some), kind)
    category = category.when(ext.isin([e for some, _ in suspects for e in some]), "unclassified").when(name.rlike(_SEGMENT), "container").otherwise("unclassified")
    earlier = [e for some, _ in kinds for e in some]
    suspect = F.when(junk, "system junk").when(name.isin(METADATA_NAMES) | ext.isin(earlier), None)
    for some, why in suspects:
        suspect = suspect.when(ext.isin(some), why)
    return F.when(key.isNotNull(), F.struct(category.alias("category"), suspect.alias("suspect"), F.coalesce(name.rlike(_LATER), F.lit(False)).alias("later_part")))


@dataclass(frozen=True)
class NameRules:
    """Word lists and small globs; what a list is for is said by its name."""

    team_words: tuple[str, ...] = ()  # a mark that holds one is a translator's
    team_names: tuple[str, ...] = ()  # a mark that is one
    languages: tuple[str, ...] = ()
    versions: tuple[str, ...] = ()  # globs
    sizes: tuple[str, ...] = ()  # globs
    noise: tuple[str, ...] = ()  # marks that say nothing
    title_noise: tuple[str, ...] = ()  # words at either end of a title
    genres: tuple[str, ...] = ()
    platforms: tuple[str, ...] = ()
    numbering: tuple[str, ...] = ()  # signs after a number in front


# Keys of a rule file (fixed values).
KEYS = {"team_words": "汉化组词", "team_names": "汉化组名", "languages": "语言地区", "versions": "版本模式", "sizes": "容量模式", "noise": "记号噪音", "title_noise": "正题噪音词", "genres": "分类词", "platforms": "平台前缀", "numbering": "编号分隔"}


def name_rules(text: str, base: NameRules | None = None) -> NameRules:
    """Rules of a TOML text; lists are added to those of ``base`` unless the file says not to inherit."""
    raw = tomllib.loads(text)
    if raw.get("版本") != 1:
        raise ValueError(f"a rule file of version {raw.get('版本')}")
    if not raw.get("继承内置", True):
        base = None
    return NameRules(**{f.name: tuple(dict.fromkeys([*raw.get(KEYS[f.name], []), *(getattr(base, f.name) if base else ())])) for f in fields(NameRules)})


_GROUP = r"\[[^\]]*+\]|\([^)]*+\)|【[^】]*+】|（[^）]*+）"
_EDGE = r"[\s\-_.,:;~·、，：；～+＋－＿．]"
_BETWEEN = r"[ 　\-_/|·、,，]"
_CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}]"
_HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]"
_STEP = "array<struct<what:string,why:string>>"


def _any_glob(c: Column, globs: tuple[str, ...]) -> Column:
    return reduce(or_, [T.matches_glob(c, g) for g in globs], F.lit(False))


def _among(c: Column, words: tuple[str, ...]) -> Column:
    return F.lower(c).isin([w.lower() for w in words]) if words else F.lit(False)


def _quoted(words) -> str:
    """A Java pattern of any of these words, longest first."""
    return "|".join(r"\Q" + w.lower() + r"\E" for w in sorted(words, key=lambda w: (-len(w), w)))


def parsed(df: DataFrame, name: str, rules: NameRules) -> DataFrame:
    """The rows with (title, chinese, latin, team, version, languages, year, taken, unknown) of a file name.

    In this order: up to three extensions; groups in brackets of four kinds, each told apart as a
    translator's, a year, a version, a language, a size, noise, a platform, a number, a genre or unknown (an
    open bracket without its end, and a name that is one group, stay); a number in front; a genre before a
    colon; a platform in front; an id at the end; up to four segments after a dash; up to four words of
    noise at the ends. ``taken`` lists what went and why. Null names have nulls, empty ones an empty title.
    Names with an underscore and one letter are taken.
    """
    s, x = F.col("_s"), F.col("_x")
    if not df.columns:
        return df

    def take(rows: DataFrame, found: Column, what: Column, why: Column | str, rest: Column) -> DataFrame:
        """One step: where found, what goes is recorded and the rest stays."""
        why = F.lit(why) if isinstance(why, str) else why
        rows = rows.withColumn("_f", F.coalesce(found, F.lit(False))).withColumn("_w", F.when(F.col("_f"), F.struct(what.alias("what"), why.alias("why")))).withColumn("_r", F.when(F.col("_f"), rest).otherwise(s))
        return rows.withColumn("_x", F.when(F.col("_f"), F.concat(x, F.array("_w"))).otherwise(x)).withColumn("_s", F.col("_r")).drop("_f", "_w", "_r")

    rows = df.withColumn("_s", F.trim(F.col(name))).withColumn("_x", F.array().cast(_STEP))
    ext = r"(?s)^(.*\S.*)(\.(?:(?=[0-9]*[A-Za-z])[0-9A-Za-z]{1,5}|[0-9]{3}))$"
    for _ in range(3):
        rows = take(rows, s.rlike(ext), F.regexp_extract(s, ext, 2), "extension", F.regexp_extract(s, ext, 1))
    # marks: the part up to an open bracket that never closes
    rows = rows.withColumn("_head", F.regexp_extract(s, rf"(?s)^(?:[^\[(【（]++|{_GROUP})*+", 0))
    rows = rows.withColumn("_tail", F.substring(s, F.length("_head") + 1, F.length(s))).withColumn("_g", F.regexp_extract_all("_head", F.lit(_GROUP), F.lit(0)))
    rows = rows.withColumn("_b", F.regexp_replace("_head", _GROUP, ""))
    last = F.get("_g", F.size("_g") - 1)
    alone = (F.size("_g") > 0) & F.startswith(s, F.concat_ws("", "_g")) & (F.trim(F.substring(s, F.length(F.concat_ws("", "_g")) + 1, F.length(s))) == "")
    rows = rows.withColumn("_alone", F.coalesce(alone, F.lit(False)))
    inner = lambda g: F.trim(F.substring(g, F.lit(2), F.length(g) - 2))
    rows = rows.withColumn("_m", F.filter(F.transform(F.when(F.col("_alone"), F.slice("_g", F.lit(1), F.size("_g") - 1)).otherwise(F.col("_g")), inner), lambda g: g != ""))

    def kind(g: Column) -> Column:
        key = F.lower(g)
        team = reduce(or_, [F.contains(key, F.lit(w.lower())) for w in rules.team_words], _among(g, rules.team_names))
        return (
            F.when(team, "team")
            .when(g.rlike("^(19[7-9][0-9]|20[0-9]{2}|2100)$"), "year")
            .when(_any_glob(g, rules.versions), "version")
            .when(_among(g, rules.languages), "language")
            .when(_any_glob(g, rules.sizes), "size")
            .when(_among(g, rules.noise), "mark")
            .when(_among(g, rules.platforms), "platform")
            .when(g.rlike("^[0-9]+$"), "number")
            .when(_among(g, rules.genres), "genre")
            .otherwise("unknown")
        )

    rows = rows.withColumn("_x", F.concat(x, F.transform("_m", lambda g: F.struct(g.alias("what"), kind(g).alias("why"))))).withColumn("_s", F.concat(F.when(F.col("_alone"), F.substring(last, F.lit(2), F.length(last) - 2)).otherwise(""), "_b", "_tail"))
    of = lambda why: F.transform(F.filter(x, lambda t: t["why"] == why), lambda t: t["what"])
    rows = rows.withColumn("_v", F.get(of("version"), F.lit(0)))  # a mark's; a segment after a dash is taken off only
    rows = rows.drop("_head", "_tail", "_g", "_b", "_alone", "_m").withColumn("_s", F.trim(F.regexp_replace(s, rf"(?<={_HAN})[.．](?={_HAN})", "")))
    if rules.numbering:
        signs = _quoted(rules.numbering)
        number = rf"(?s)^([0-9]{{1,4}}(?:{signs})\s*)(?=\S)(?![0-9]+$)(.+)$"
        rows = take(rows, s.rlike(number), F.regexp_extract(s, number, 1), "number", F.regexp_extract(s, number, 2))
    genre = r"(?s)^([^：:]*)[：:]+\s*(\S.*)$"
    rows = take(rows, _among(F.trim(F.regexp_extract(s, genre, 1)), rules.genres) & s.rlike(genre), F.regexp_extract(s, genre, 1), "genre", F.regexp_extract(s, genre, 2))
    if rules.platforms:
        front = rf"(?s)^(?i:({_quoted(rules.platforms)}))(?={_CJK}|{_BETWEEN})[ \-_　]*(.{{2,}})$"
        rows = take(rows, s.rlike(front), F.regexp_extract(s, front, 1), "platform", F.regexp_extract(s, front, 2))
    id_ = r"(?s)^(.*\S.*)[ _　]([0-9A-Fa-f]{8,})$"
    rows = take(rows, s.rlike(id_), F.regexp_extract(s, id_, 2), "number", F.trim(F.regexp_extract(s, id_, 1)))
    tail = r"(?s)^(.*\S.*)[-_－]\s*([^-_－]*[^-_－\s])\s*$"
    for _ in range(4):
        word = F.regexp_extract(s, tail, 2)
        why = F.when(_among(word, rules.languages), "language").when(_among(word, rules.genres), "genre").when(_among(word, rules.title_noise), "noise").when(_any_glob(word, rules.versions), "version").when(_any_glob(word, rules.sizes), "size")
        rows = take(rows.withColumn("_why", why), s.rlike(tail) & F.col("_why").isNotNull(), word, F.col("_why"), F.rtrim(F.regexp_extract(s, tail, 1))).drop("_why")
    if rules.title_noise:
        words, trim = _quoted(rules.title_noise), lambda c: F.regexp_replace(c, rf"^{_EDGE}+|{_EDGE}+$", "")
        end, front = rf"(?s)^(.+?)(?i:({words}))$", rf"(?s)^(?i:({words}))(.+)$"
        for _ in range(4):
            # of all words the longest; at the end before the front
            at_end, in_front = F.regexp_extract(s, end, 2), F.regexp_extract(s, front, 1)
            is_end = F.length(at_end) >= F.length(in_front)
            rest = trim(F.when(is_end, F.regexp_extract(s, end, 1)).otherwise(F.regexp_extract(s, front, 2)))
            rows = rows.withColumn("_rest", rest)
            rows = take(rows, (s.rlike(end) | s.rlike(front)) & (F.length("_rest") >= 2), F.lower(F.when(is_end, at_end).otherwise(in_front)), "noise", F.col("_rest")).drop("_rest")
    rows = rows.withColumn("title", F.regexp_replace(s, rf"^{_EDGE}+|{_EDGE}+$", ""))
    parts = F.split("title", _BETWEEN)
    chinese = F.concat_ws("", F.transform(F.filter(parts, lambda p: p.rlike(_CJK)), F.trim))
    latin = F.array_join(F.filter(F.transform(parts, F.trim), lambda p: (p != "") & ~p.rlike(_CJK)), " ")
    return rows.select(
        *df.columns, "title", F.when(F.col(name).isNotNull(), F.nullif(chinese, F.lit(""))).alias("chinese"), F.when(F.length(F.regexp_replace(latin, "[^A-Za-z]", "")) >= 3, latin).alias("latin"),
        F.get(of("team"), F.lit(0)).alias("team"), F.col("_v").alias("version"), of("language").alias("languages"), F.get(of("year"), F.lit(0)).cast("int").alias("year"), x.alias("taken"), of("unknown").alias("unknown"),
    )
