"""Part-number families and path ownership.

Two part numbers are siblings if what follows their common alphanumeric prefix, of at
least four characters, is in both nothing or a package suffix: a letter, an optional
digit, an optional letter. A suffix has at most three characters, so every part number has
at most four possible stems, and siblings meet in an equi-join on the stem.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partslake.functions import text as T
from partslake.functions.arrays import exploded

MIN_STEM = 4
SUFFIX = r"(?U)^[A-Z]\d?[A-Z]?\z"
ALNUM = r"^[\p{L}\p{N}]+\z"


def stems(upper: Column) -> Column:
    """Possible ``(stem, next)`` of an upper-cased part number; ``next`` is the first
    character after the stem, empty for the number itself."""
    n = F.char_length(upper)
    options = []
    for k in range(4):
        stem = F.substring(upper, F.lit(1), n - k)
        rest = F.substring(upper, n - k + 1, F.lit(k)) if k else F.lit("")
        good = (n - k >= MIN_STEM) & stem.rlike(ALNUM)
        if k:
            good = good & rest.rlike(SUFFIX)
        options.append(
            F.when(good, F.struct(stem.alias("stem"), F.substring(rest, 1, 1).alias("next")))
        )
    return F.filter(F.array(*options), lambda o: o.isNotNull())


def stemmed(ids: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct upper-cased part numbers with their stems.

    Copies collapse first, so one stem has at most one row per possible suffix however
    many rows share it.
    """
    upper = F.upper("part")
    once = (
        ids.filter(F.coalesce("part", F.lit("")) != "")
        .select(*keys, upper.alias("upper"))
        .distinct()
    )
    return exploded(once, [*keys, "upper"], stems(F.col("upper")), "s").select(
        *keys, "upper", "s.stem", "s.next"
    )


def _meet(a: DataFrame, b: DataFrame, on: Sequence[str], extra: Column | None = None) -> DataFrame:
    """Rows of two stemmed tables that are siblings. The differing next character makes
    the stem the longest common prefix, so a pair meets on exactly one stem."""
    left, right = a.alias("a"), b.alias("b")
    cond = F.col("a.next") != F.col("b.next")
    for c in [*on, "stem"]:
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    if extra is not None:
        cond = cond & extra
    return left.join(right, cond)


def family_pairs(parts: DataFrame) -> DataFrame:
    """All unordered sibling pairs ``(a, b)``, upper-cased, ``a < b``."""
    s = stemmed(parts)
    return _meet(s, s, [], F.col("a.upper") < F.col("b.upper")).select(
        F.col("a.upper").alias("a"), F.col("b.upper").alias("b")
    )


def find_siblings(probes: DataFrame, parts: DataFrame) -> DataFrame:
    """Siblings of each probe ``(probe_id, part)`` among ``(pos, part)``, input position kept."""
    pairs = _meet(stemmed(probes), stemmed(parts), []).select(
        F.col("a.upper").alias("probe_upper"), F.col("b.upper").alias("upper")
    )
    wanted = probes.select("probe_id", "part", F.upper("part").alias("probe_upper")).join(
        pairs, "probe_upper"
    )
    found = parts.select("pos", F.col("part").alias("sibling"), F.upper("part").alias("upper"))
    return wanted.join(found, "upper").select("probe_id", "part", "pos", "sibling")


def sibling_pages(probes: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages ``(path)`` whose stem is a sibling of the probe."""
    named = pages.select(F.col("path").alias("pos"), T.stem(F.col("path")).alias("part"))
    return find_siblings(probes, named).select("probe_id", "part", F.col("pos").alias("path"))


def batch_siblings(stock: DataFrame, deltas: DataFrame) -> DataFrame:
    """Siblings of each new part of a batch among stock and earlier deltas of the batch."""
    seen = (
        stock.select("bin", "part", F.lit(-1).cast("long").alias("seq"))
        .unionByName(deltas.select("bin", "part", F.col("seq").cast("long").alias("seq")))
        .groupBy("bin", "part")
        .agg(F.min("seq").alias("seq"))
    )
    s = exploded(
        seen.filter(F.coalesce("part", F.lit("")) != ""),
        ["bin", "part", "seq"],
        stems(F.upper("part")),
        "s",
    ).select("bin", "part", "seq", "s.stem", "s.next")
    return _meet(
        s.filter("seq >= 0"), s, ["bin"], F.col("b.seq") < F.col("a.seq")
    ).select(
        F.col("a.bin").alias("bin"),
        F.col("a.part").alias("part"),
        F.col("a.seq").alias("seq"),
        F.col("b.part").alias("sibling"),
        (F.col("b.seq") < 0).alias("in_stock"),
    )


def glob_pattern(glob: str) -> str:
    """Regex of a path glob: ``**`` any text, ``*`` within a segment, ``?`` one character."""
    wild = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    pieces = re.split(r"(\*\*|\*|\?)", glob)
    return "^" + "".join(wild.get(p, re.escape(p)) for p in pieces) + r"\z"


def owners(paths: DataFrame, entries: Sequence[tuple[str, str]]) -> DataFrame:
    """Every ownership entry ``(pattern, owner)`` a path matches; entries are configuration."""
    hits = F.array(
        *[
            F.when(
                F.col("path").rlike(glob_pattern(pattern)),
                F.struct(F.lit(pattern).alias("pattern"), F.lit(owner).alias("owner")),
            )
            for pattern, owner in entries
        ]
    )
    return exploded(paths, ["path"], F.filter(hits, lambda h: h.isNotNull()), "h").select(
        "path", "h.pattern", "h.owner"
    )
