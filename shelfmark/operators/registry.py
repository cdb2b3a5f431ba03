"""First match of ordered patterns, and the plan of what to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Java patterns of the three signs of a small glob (fixed values): a digit, a letter, anything.
_SIGNS = {"#": "[0-9]", "@": "[A-Za-z]", "*": ".*"}


def _literal(pattern: Column) -> Column:
    """What stands before a pattern's first sign, in lower case."""
    return F.lower(F.regexp_extract(pattern, r"(?s)^[^#@*]*", 0))


def _regexp(pattern: Column) -> Column:
    """A small glob as a Java pattern of whole texts, case ignored."""
    quoted = F.regexp_replace(F.lower(pattern), r"[\\\[\](){}.+?^$|&~-]", r"\\$0")
    for sign, means in _SIGNS.items():
        quoted = F.replace(quoted, F.lit(sign), F.lit(means))
    return F.concat(F.lit(r"(?s)\A"), quoted, F.lit(r"\z"))


def first_match(names: DataFrame, mappings: DataFrame) -> DataFrame:
    """(source, name, state, platform, convention, note): what the first pattern of a source that matches a name says.

    ``mappings`` has (source, place, pattern, platform, convention, note); the least place wins. A
    mapping without a platform excludes, and its note says why. A name that nothing matches is
    unmapped. A pattern's literal beginning is its key: a name meets only patterns whose
    beginning it has, by an equi join on the source and that many of its letters, for each length
    there is (as many as a pattern is long at most). Signs: ``#`` a digit, ``@`` a letter, ``*``
    anything; case is ignored and the whole name must match.

    Cases: repeated names are one; null names and sources, and null or empty patterns, match nothing;
    of two mappings of one place the one with the lesser pattern wins; other columns are ignored.
    """
    asked = names.select("source", "name").where("source is not null and name is not null").distinct()
    rules = mappings.where("pattern <> '' and source is not null").select(F.col("source").alias("_source"), "place", "pattern", "platform", "convention", "note")
    rules = rules.withColumn("_key", _literal(F.col("pattern"))).withColumn("_regexp", _regexp(F.col("pattern")))
    lengths = sorted(r[0] for r in rules.select(F.length("_key")).distinct().collect())  # as many as a pattern has letters
    folded = F.lower("name")
    cut = [F.when(F.length(folded) >= n, F.substring(folded, 1, n)) for n in lengths]
    keyed = asked.withColumn("_cut", F.explode(F.filter(F.array(*cut) if cut else F.array().cast("array<string>"), lambda x: x.isNotNull())))
    met = keyed.join(rules, (F.col("source") == F.col("_source")) & (F.col("_cut") == F.col("_key"))).where(F.regexp_like(folded, F.col("_regexp")))
    best = met.groupBy("source", "name").agg(F.min(F.struct("place", "pattern", "platform", "convention", "note")).alias("_m"))
    out = asked.join(best, ["source", "name"], "left")
    state = F.when(F.col("_m").isNull(), "unmapped").when(F.col("_m.platform").isNull(), "excluded").otherwise("mapped")
    shown = lambda c, when: F.when(F.col("state") == when, F.col(f"_m.{c}")).alias(c)
    return out.withColumn("state", state).select("source", "name", "state", shown("platform", "mapped"), shown("convention", "mapped"), shown("note", "excluded"))


def unknown_platforms(mappings: DataFrame, platforms: DataFrame) -> DataFrame:
    """(platform): names that mappings speak of and the list of platforms (platform) doesn't hold."""
    return mappings.select("platform").where("platform is not null").distinct().join(platforms.select("platform"), "platform", "left_anti")


def fetch_plan(available: DataFrame, known: DataFrame, sources: DataFrame, mappings: DataFrame, refused: Column | None = None, full: bool = False) -> DataFrame:
    """(source, name, url, fingerprint, platform, convention, action, note): what to do about everything a source offers.

    ``available`` has (source, name, url, fingerprint), ``known`` (source, name, fingerprint) what
    was fetched before, ``sources`` (source, bundle, convention). In this order: ``refused`` places
    (a condition on the columns of available) are not gone to; a bundle, whose parts have mappings of
    their own, or a mapped name is fetched, or up to date if its fingerprint is known and the same
    (never if it has none, or with ``full``); what is left is excluded or unmapped. A mapping's
    convention goes before its source's.

    Cases: offers are kept as often as they come; sources that aren't listed are no bundles; of several
    known fingerprints of a name any may agree; an offer without a name is unmapped, unless in a bundle.
    """
    told = first_match(available, mappings).withColumnsRenamed({"source": "_source", "name": "_name", "note": "_note", "convention": "_convention"})
    kinds = sources.groupBy(F.col("source").alias("_from")).agg(F.max(F.coalesce("bundle", F.lit(False))).alias("_bundle"), F.max("convention").alias("_default"))
    before = known.select(F.col("source").alias("_ks"), F.col("name").alias("_kn"), F.col("fingerprint").alias("_kf")).where("_kf is not null").distinct().withColumn("_same", F.lit(True))
    stop = F.coalesce(refused, F.lit(False)) if refused is not None else F.lit(False)
    offers = available.select("source", "name", "url", "fingerprint", stop.alias("_stop"))
    both = offers.join(told, (F.col("source") == F.col("_source")) & (F.col("name") == F.col("_name")), "left").join(kinds, F.col("source") == F.col("_from"), "left")
    both = both.join(before, (F.col("source") == F.col("_ks")) & (F.col("name") == F.col("_kn")) & (F.col("fingerprint") == F.col("_kf")), "left")
    bundle = F.coalesce("_bundle", F.lit(False))
    wanted = bundle | F.coalesce(F.col("state") == "mapped", F.lit(False))
    current = F.lit(not full) & F.coalesce("_same", F.lit(False))
    action = F.when(F.col("_stop"), "refused").when(wanted & current, "up to date").when(wanted, "fetch").when(F.col("state") == "excluded", "excluded").otherwise("unmapped")
    mapped = lambda c: F.when(~bundle & (F.col("state") == "mapped"), c)
    out = both.withColumn("action", action)
    return out.select("source", "name", "url", "fingerprint", mapped(F.col("platform")).alias("platform"), mapped(F.coalesce("_convention", "_default")).alias("convention"), "action", F.when(F.col("action") == "excluded", F.col("_note")).alias("note"))
