"""Rules given as a table: path globs and prefixes by the tens of thousands.

Short rule sets are literals in the plan (``family.owners``, ``enrich.family_datasheet``,
``changes.is_interesting``). A long one is a table and is never looped over: each rule is
filed under the longer of its literal head and literal tail, a text offers its own heads
and tails of the lengths that occur, and both meet in an equi-join. Rules that share a literal but have
single-character wildcards beside it (``**/12?page=2``, ``**/13?page=2``) differ in the characters behind
those, which have a fixed place: a text takes the shapes of such rules from the literal it met, and
a second equi-join is on all characters at a fixed place. Only what meets is held against the whole pattern. A rule and a text share one key at most, so they meet once. The plan has
the same size for any number of rules.

A rule that begins and ends with a wildcard (``**``, ``*/en/*``) has no literal to be filed under and
is held against every text, as it would be as a literal; adaptive execution splits that key
on the side of the texts. The lengths that occur come to the driver: one number each, no
more than the longest rule has characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partslake.functions import text as T
from partslake.functions.arrays import exploded
from partslake.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def escaped(literal: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.regexp_replace(literal, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def glob_regex(glob: Column) -> Column:
    """Pattern of a path glob: ``**`` any text, ``*`` within a segment, ``?`` one character."""
    pieces = F.regexp_extract_all(glob, F.lit(r"\*\*|\*|\?|[^*?]+"), F.lit(0))
    meaning = lambda p: F.when(p == "**", ".*").when(p == "*", "[^/]*").when(p == "?", "[^/]").otherwise(escaped(p))
    return F.concat(F.lit("^"), F.array_join(F.transform(pieces, meaning), ""), F.lit(r"\z"))


def _filed(rules: DataFrame, head: Column, tail: Column | None = None, by_tail: Column | None = None) -> DataFrame:
    """Rules with ``_tail`` (the key is one), ``_n`` (its length) and ``_key``, the longer of the two unless ``by_tail`` says which."""
    tail = F.lit("") if tail is None else tail
    by_tail = F.char_length(tail) > F.char_length(head) if by_tail is None else by_tail
    return rules.withColumns({"_tail": by_tail, "_key": F.when(by_tail, tail).otherwise(head)}).withColumn("_n", F.char_length("_key"))


def _offered(rows: DataFrame, text: Column, filed: DataFrame) -> DataFrame:
    """``rows`` with one row per key, ``_tail`` and ``_key``, that a rule for the text can be filed under."""
    lengths = filed.filter("_n is not null").groupBy("_tail").agg(F.collect_set("_n").alias("n")).collect()
    sides = {r["_tail"]: sorted(r["n"]) for r in lengths}

    def keys(tail: bool) -> Column:
        fits = F.filter(F.lit(sides.get(tail, [])).cast("array<int>"), lambda n: n <= F.char_length(text))
        cut = (lambda n: F.substring(text, F.char_length(text) - n + 1, n)) if tail else (lambda n: F.substring(text, F.lit(1), n))
        return F.transform(fits, lambda n: F.struct(F.lit(tail).alias("_tail"), cut(n).alias("_key")))

    offered = F.when(text.isNotNull(), F.concat(keys(False), keys(True)))
    return exploded(rows, rows.columns, offered, "_k").select(*rows.columns, "_k.*")


def _masked(text: Column, shape: Column, tail: Column) -> Column:
    """The first or last characters of ``text``, as many as ``shape`` has, with ``?`` where that has it."""
    n = F.char_length(shape)
    cut = F.substring(text, F.when(tail, F.char_length(text) - n + 1).otherwise(F.lit(1)), n)
    places = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(shape, i, F.lit(1)) == "?")
    return F.when(n == 0, "").otherwise(F.aggregate(places, cut, lambda c, i: F.overlay(c, F.lit("?"), i, F.lit(1))))


def candidates_of(paths: DataFrame, entries: DataFrame) -> DataFrame:
    """Path, pattern, owner and ``_regex``: entries of which a path has all characters at a fixed place from its begin, or its end."""
    entries = entries.select("pattern", "owner").filter("pattern is not null")
    # what stands before the first * and behind the last one has a fixed place
    parts = entries.withColumns({"_head": F.regexp_extract("pattern", r"^[^*]*", 0), "_last": F.regexp_extract("pattern", r"[^*]*\z", 0)})
    head, tail = F.regexp_extract("_head", r"^[^?]*", 0), F.regexp_extract("_last", r"[^?]*\z", 0)
    weight = lambda part, run: F.struct(F.char_length(F.replace(F.col(part), F.lit("?"), F.lit(""))), F.char_length(run))
    filed = _filed(parts, head, tail, weight("_last", tail) > weight("_head", head))
    part = F.when(F.col("_tail"), F.col("_last")).otherwise(F.col("_head"))
    part = F.when(F.contains(part, F.lit("?")), part).otherwise("")  # without ? it is the key itself
    filed = filed.withColumn("_part", part).withColumn("_shape", F.regexp_replace("_part", "[^?]", "x"))
    # read three times
    filed = cut_lineage(filed.withColumn("_regex", glob_regex(F.col("pattern"))).drop("_head", "_last"))
    offered = _offered(paths.select("path"), F.col("path"), filed)
    shaped = offered.join(filed.select("_tail", "_key", "_shape").distinct(), ["_tail", "_key"])
    shaped = shaped.filter(F.char_length("path") >= F.char_length("_shape")).withColumn("_part", _masked(F.col("path"), F.col("_shape"), F.col("_tail")))
    return shaped.join(filed.drop("_n"), ["_tail", "_key", "_shape", "_part"]).select("path", "pattern", "owner", "_regex")


def owners_of(paths: DataFrame, entries: DataFrame) -> DataFrame:
    """Like ``family.owners``, of ``entries (pattern, owner)`` in a table: path, pattern, owner.

    A path that stands in several rows comes out for each; entries that stand twice, likewise. Null
    paths and patterns match nothing; the empty pattern matches the empty path.
    """
    met = candidates_of(paths, entries)
    return met.filter(F.regexp_like("path", F.col("_regex"))).select("path", "pattern", "owner")


def datasheets_of(parts: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``parts`` with ``url``, like ``enrich.family_datasheet``, of ``prefixes (prefix, url)`` in a table.

    The longest prefix wins, then the smallest, then the smallest url; ``x`` stands for a digit and
    A-Z match either case. Null where none matches. Equal parts are looked up once.
    """
    folded = lambda c: F.translate(c, UPPER, LOWER)
    prefixes = prefixes.select("prefix", F.col("url").alias("_url")).filter("prefix is not null")
    filed = _filed(prefixes, folded(F.regexp_extract("prefix", "^[^x]*", 0)))
    filed = filed.withColumn("_regex", F.concat(F.lit("(?i)^"), F.replace(escaped(F.col("prefix")), F.lit("x"), F.lit("[0-9]"))))
    once = parts.select(F.col("part").alias("_part")).filter("_part is not null").distinct()
    met = _offered(once, folded(F.col("_part")), filed).join(filed.drop("_n"), ["_tail", "_key"])
    met = met.filter(F.regexp_like("_part", F.col("_regex")))
    rank = F.struct(-F.char_length("prefix"), "prefix", F.coalesce("_url", F.lit("")))
    best = met.groupBy("_part").agg(F.min_by("_url", rank).alias("url"))
    return parts.join(best, F.col("part") == F.col("_part"), "left").drop("_part")


def interest_of(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``files`` with a ``file`` that a rule ``(kind, value)`` names.

    Kinds are those of ``changes.is_interesting``: ``path`` the whole file, ``suffix`` the last suffix of its name with
    the dot, ``prefix`` what it begins with. Each file comes as often as it stands in ``files``.
    """
    rules = rules.select("kind", "value").filter("value is not null")
    begins = _filed(rules.filter("kind = 'prefix'"), F.col("value")).select("_tail", "_key", "_n").distinct()
    suffix = F.regexp_extract(T.basename(F.col("file")), r".(\.[^.]+)$", 1)
    once = files.select("file").filter("file is not null").distinct()
    own = [F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in (("path", F.col("file")), ("suffix", suffix))]
    exact = exploded(once, ["file"], F.array(*own), "k").select("file", "k.*").join(rules, ["kind", "value"], "left_semi")
    begun = _offered(once, F.col("file"), begins).join(begins, ["_tail", "_key"], "left_semi")
    return files.join(exact.select("file").union(begun.select("file")), "file", "left_semi").select(*files.columns)
