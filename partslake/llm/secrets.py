r"""Secret scans with a trigram inverted index.

From each rule's regex follows which trigrams a match must hold: a list of alternatives,
each a set of trigrams (of lower-cased text). The index holds postings (trigram, document)
for the trigrams that any rule asks for; intersecting them gives the candidates of a rule,
and only those are searched with the regex. A rule without mandatory trigrams searches all.
Everything here is DataFrame functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partslake.llm.common import only


@dataclass(frozen=True)
class Rule:
    """A match counts if the text of ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# The three base kinds, in their order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # as [0-9a-f]+ of 16 or more: a run is matched from its start
)
# Between the lines of a key: whitespace, or a line end written as an escape.
_GAP = r"(?:[\x20\x09-\x0D]|\\[nr])"
_LABEL = r"(?:[A-Z]+ ){0,4}PRIVATE KEY(?: BLOCK)?+-----"
# The whole block of a private key: its headers and lines of base64 to the END line. Without one, the
# lines of 16 characters or more and a shorter one that is padded, so that text behind a key stays. Repeats are
# possessive: one pass, no backtracking into a long key.
PRIVATE_KEY = (
    rf"-----BEGIN {_LABEL}(?:{_GAP}*+(?:Proc-Type|DEK-Info|Version|Comment):[^\n\\]*+)*+"
    rf"(?:(?:{_GAP}*+[A-Za-z0-9+/=]++)*+{_GAP}*+-----END {_LABEL}"
    rf"|(?:{_GAP}++[A-Za-z0-9+/=]{{16,}}+)*+(?:{_GAP}++[A-Za-z0-9+/]++={{1,2}}+)?+)"
)
# Kinds that the index makes cheap to add: public formats with a fixed start.
ADDED = (
    Rule("private_key", PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED
# Alternatives and characters of a class beyond which a part of a regex asks for nothing.
_WIDEST = 32


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, one of which must be wholly present; None if a match needs no trigram."""
    c = re._constants

    def join(left: list[tuple[str, ...]], right: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
        """The last stretch of one runs on into the first stretch of the next."""
        if len(left) * len(right) > _WIDEST:
            return [("", "")]
        return [(*a[:-1], a[-1] + b[0], *b[1:]) for a, b in product(left, right)]

    def cut(found: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
        return [(*f, "") for f in found]

    def of(nodes) -> list[tuple[str, ...]]:
        """Alternatives of a part, each the literal stretches in it, split where anything may stand."""
        out = [("",)]
        for op, arg in nodes:
            if op is c.LITERAL:
                part = [(chr(arg).lower(),)]
            elif op is c.IN and all(k is c.LITERAL for k, _ in arg) and len(arg) <= _WIDEST:
                part = sorted({(chr(v).lower(),) for _, v in arg})
            elif op is c.SUBPATTERN:
                part = of(arg[3])
            elif op is c.BRANCH:
                part = [alternative for branch in arg[1] for alternative in of(branch)]
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[:2] == (0, 1):
                part = [("",), *of(arg[2])]
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] > 0:
                part = of(arg[2]) if arg[1] == 1 else [("", *f, "") for f in of(arg[2])]
            elif op in (c.AT, c.ASSERT, c.ASSERT_NOT):
                continue
            else:
                part = [("", "")]
            joined = join(out, part)
            out = joined if len(out) * len(part) <= _WIDEST else cut(out)
        return out

    query = {frozenset(s[i : i + 3] for s in stretches for i in range(len(s) - 2)) for stretches in of(re._parser.parse(pattern))}
    return None if frozenset() in query else sorted(query, key=sorted)


def build_index(docs: DataFrame, key: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (gram, *key) of the trigrams that the rules ask for."""
    grams = sorted({g for r in rules for alternative in trigram_query(r.pattern) or () for g in alternative})
    low = docs.select(*key, F.lower("text").alias("_low"))
    present = F.array(*[F.when(F.contains(F.col("_low"), F.lit(g)), F.lit(g)) for g in grams])
    return low.select(*key, F.explode(F.array_compact(present)).alias("gram"))


def candidates(index: DataFrame, key: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key`` and ``_rules``, the kinds whose trigram query the document meets.

    Intersects the posting lists of each alternative: postings meet by document, which has
    one posting per trigram asked for at most, and an alternative needs all of its own.
    """
    asked = [(r.kind, sorted(a)) for r in rules for a in trigram_query(r.pattern) or ()]
    # repeated rows have each posting several times
    met = [F.forall(F.array(*map(F.lit, a)), lambda g: F.array_contains("_grams", g)) for _, a in asked]
    kinds = F.array(*[F.when(m, F.lit(kind)) for (kind, _), m in zip(asked, met)])
    lists = index.groupBy(*key).agg(F.collect_set("gram").alias("_grams"))
    return lists.select(*key, F.array_distinct(F.array_compact(kinds)).alias("_rules")).filter(F.size("_rules") > 0)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind) of the leftmost matches that do not overlap.

    Offsets are code points. Between two matches lies a piece of the text split by the regex.
    """
    pattern = F.lit(rule.pattern)
    match, tested = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    lengths = F.arrays_zip(gaps.alias("gap"), F.transform(match, F.length).alias("size"), F.transform(tested, F.length).alias("tested"))
    empty = F.array().cast("array<struct<start:long,order:int,end:long,kind:string>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        span = F.struct(begin.cast("long").alias("start"), F.lit(order).alias("order"), end.cast("long").alias("end"), F.lit(rule.kind).alias("kind"))
        found = F.when(x["tested"] >= rule.least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(end.cast("long").alias("at"), found.alias("found"))

    return F.aggregate(lengths, start, step, lambda acc: acc["found"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``_spans``: (start, order, end, kind) of all matches, by start, then rule.

    Every row comes back once, in all its columns; a null text has no span. Rows are told
    apart by id and text, so repeated rows and null ids are scanned like others.
    """
    key = ["_id", "_hash"]
    keyed = docs.withColumn("_id", F.col("doc_id")).withColumn("_hash", F.xxhash64("text"))
    found = candidates(build_index(only(keyed, *key, "text"), key, rules), key, rules)
    found = found.select(F.col("_id").alias("_cid"), F.col("_hash").alias("_chash"), "_rules")
    joined = keyed.join(found, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_hash") == F.col("_chash")), "left")
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:long,order:int,end:long,kind:string>>")
    parts = []
    for order, rule in enumerate(rules):
        if trigram_query(rule.pattern) is None:
            asked = text.rlike(rule.pattern)
        else:
            asked = F.coalesce(F.array_contains("_rules", rule.kind), F.lit(False))
        parts.append(F.when(asked, spans_of(text, rule, order)).otherwise(none))
    return joined.withColumn("_spans", F.array_sort(F.concat(*parts))).drop(*key, "_cid", "_chash", "_rules")


def _listed(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, digest of the base spans, and all spans."""
    base = F.filter("_spans", lambda s: s["order"] < len(BASE))
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(only(docs, "doc_id", "text"), rules).select(
        "doc_id", *[count(r.kind) for r in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans")
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each stretch covered by spans replaced by ``mark`` in ``text``.

    Overlapping or touching spans become one mark. ``n_chars``, where present, is counted anew.
    """
    text = F.col("text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        apart = (s["start"] > acc["at"]) | (acc["at"] == 0)
        out = F.when(apart, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def close(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))

    new = F.when(F.size("_spans") > 0, F.aggregate("_spans", start, step, close)).otherwise(text)
    out = scan(docs, rules).withColumn("text", new)
    if "n_chars" in docs.columns:
        changed = F.when(F.size("_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.select(*docs.columns)
