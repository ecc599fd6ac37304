"""Change-set scanning: risky lines, secrets, settings, severity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partslake.functions import rules as R
from partslake.functions import text as T
from partslake.functions.arrays import exploded
from partslake.operators.quality import any_of, can_match
from partslake.operators.workitems import lookup
from partslake.sources.markdown import changed_lines

FINDING = ["change_id", "file", "rule", "severity", "detail", "snippet"]


def is_interesting(path: Column) -> Column:
    suffix = F.regexp_extract(T.basename(path), r".(\.[^.]+)$", 1)
    hit = path.isin(*R.INTERESTING_PATHS) | suffix.isin(*R.INTERESTING_SUFFIXES)
    for prefix in R.INTERESTING_PREFIXES:
        hit = hit | path.startswith(prefix)
    return hit


def of_interest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changed files ``(change_id, status, file)`` to read closely, and deletions as findings."""
    near = files.filter(is_interesting(F.col("file")))
    deleted = near.filter(F.col("status") == "D").select(
        "change_id",
        "file",
        F.lit("file-deleted").alias("rule"),
        F.lit("LOW").alias("severity"),
        F.lit("file removed by incoming change").alias("detail"),
        F.lit("").alias("snippet"),
    )
    return near.filter(F.col("status") != "D"), deleted


def _first_hits(diffs: DataFrame, rules: Sequence[R.Rule], skip_comments: bool) -> DataFrame:
    """First added line per file and rule: ``(change_id, file, rule, severity, pattern, line, match)``.

    A diff is one row and its lines an array in it, so the first match needs no shuffle.
    """
    added = changed_lines(F.col("diff"), "+")
    if skip_comments:
        added = F.filter(added, lambda s: ~T.strip(s).rlike(r"^(?:#|//)"))
    lines = diffs.filter(any_of(F.col("diff"), rules)).select(
        "change_id", "file", "diff", added.alias("lines")
    )

    def first_with(rule: R.Rule) -> Column:
        found = F.filter("lines", lambda s: can_match(s, rule) & s.rlike(rule.pattern))
        # a rule whose texts the diff lacks costs no pass over its lines
        return F.when(can_match(F.col("diff"), rule), F.get(found, F.lit(0)))

    hits = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(r.severity).alias("severity"),
                F.lit(r.pattern).alias("pattern"),
                first_with(r).alias("line"),
            )
            for r in rules
        ]
    )
    return exploded(
        lines, ["change_id", "file"], F.filter(hits, lambda h: h["line"].isNotNull()), "h"
    ).select("change_id", "file", "h.*")


def scan_rules(diffs: DataFrame, rules: Sequence[R.Rule] = R.CHANGE_RULES) -> DataFrame:
    """Findings on added lines of ``(change_id, file, diff)``, comment lines skipped."""
    return _first_hits(diffs, rules, skip_comments=True).select(
        "change_id",
        "file",
        "rule",
        "severity",
        F.concat(F.lit("matched "), F.col("rule")).alias("detail"),
        F.substring(T.strip(F.col("line")), 1, 200).alias("snippet"),
    )


def mask(secret: Column) -> Column:
    """The first 4 characters of a secret longer than 8, stars for the rest."""
    n = F.char_length(secret)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(secret, 1, 4), F.repeat(F.lit("*"), n - 4))
    )


def scan_secrets(diffs: DataFrame, rules: Sequence[R.Rule] = R.SECRET_RULES) -> DataFrame:
    """Findings of secrets on added lines, comments included, value masked."""
    found = _first_hits(diffs, rules, skip_comments=False).withColumn(
        # the pattern column has one value per rule; few rows get here
        "match", F.regexp_substr("line", F.col("pattern"))
    )
    return found.select(
        "change_id",
        "file",
        "rule",
        "severity",
        F.concat(F.lit("matched "), F.col("rule"), F.lit(", value redacted")).alias("detail"),
        F.substring(
            T.strip(F.replace(F.col("line"), F.col("match"), mask(F.col("match")))), 1, 200
        ).alias("snippet"),
    )


SETTINGS_SCHEMA = (
    "struct<permissions: struct<allow: array<string>, deny: array<string>>,"
    " hooks: map<string, array<struct<hooks: array<struct<command: string>>>>>,"
    " env: map<string, string>>"
)


def grade_allow(entry: Column) -> Column:
    """Severity of a new allow entry: wildcards on a shell are worst, unless audited."""
    broad = entry.rlike(r"^Bash\([^)]*\*[^)]*\)") & (
        ~F.contains(entry, F.lit("/")) | entry.endswith("*)")
    )
    audited = entry.rlike(rf"(?U)^Bash\((?:{'|'.join(R.AUDITED_COMMANDS)})\b")
    return F.when(broad & ~audited, "CRITICAL").otherwise("HIGH")


def _is_json(text: str) -> Column:
    """One whole JSON value and nothing behind it.

    The parser lets text behind a value pass. As the one element of a list and as the one
    value of an object, whatever stands behind it breaks the one or the other.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), F.col(text), F.lit("}")))
    whole = (F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1) & named.isNotNull()
    return F.coalesce(whole, F.lit(False))


def _quoted(value: Column) -> Column:
    """A text as the reports show it: in single quotes, in double ones if it holds a single one."""
    bare = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    single = F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"'))
    inner = F.when(single, bare).otherwise(F.replace(bare, F.lit("'"), F.lit("\\'")))
    mark = F.when(single, F.lit('"')).otherwise(F.lit("'"))
    return F.coalesce(F.concat(mark, inner, mark), F.lit("None"))


def settings_diff(changes: DataFrame) -> DataFrame:
    """Findings between ``old`` and ``new`` settings JSON of ``(change_id, file, old, new)``."""
    none = F.array().cast("array<string>")
    text = lambda c: F.when(F.coalesce(T.strip(F.col(c)), F.lit("")) == "", "{}").otherwise(F.col(c))
    parsed = (
        changes.select("change_id", "file", text("old").alias("old"), text("new").alias("new"))
        .withColumn("broken", ~_is_json("old") | ~_is_json("new"))
        .withColumn("o", F.from_json("old", SETTINGS_SCHEMA))
        .withColumn("n", F.from_json("new", SETTINGS_SCHEMA))
    )

    def entries(side: str, kind: str) -> Column:
        return F.coalesce(F.col(f"{side}.permissions.{kind}"), none)

    def hooks(side: str) -> Column:
        per_event = F.transform(
            F.map_entries(F.col(f"{side}.hooks")),
            lambda e: F.transform(
                F.filter(
                    F.flatten(
                        F.transform(
                            F.coalesce(e["value"], F.array()), lambda x: F.coalesce(x["hooks"], F.array())
                        )
                    ),
                    lambda h: F.coalesce(h["command"], F.lit("")) != "",
                ),
                lambda h: F.concat(e["key"], F.lit(": "), h["command"]),
            ),
        )
        return F.coalesce(F.flatten(per_event), none)

    def findings(values: Column, rule: str, severity, prefix: str) -> Column:
        return F.transform(
            values,
            lambda v: F.struct(
                F.lit(rule).alias("rule"),
                severity(v).alias("severity"),
                F.concat(F.lit(prefix), v).alias("detail"),
            ),
        )

    high = lambda v: F.lit("HIGH")
    medium = lambda v: F.lit("MEDIUM")
    empty_map = F.create_map().cast("map<string,string>")
    env_old = F.coalesce(F.col("o.env"), empty_map)
    env_new = F.coalesce(F.col("n.env"), empty_map)
    added_env = F.transform(
        F.array_except(F.map_keys(env_new), F.map_keys(env_old)),
        lambda k: F.concat(k, F.lit("="), F.coalesce(F.try_element_at(env_new, k), F.lit("null"))),
    )
    changed_env = F.transform(
        F.filter(
            F.array_intersect(F.map_keys(env_new), F.map_keys(env_old)),
            lambda k: ~F.try_element_at(env_new, k).eqNullSafe(F.try_element_at(env_old, k)),
        ),
        lambda k: F.concat(
            k,
            F.lit(": "),
            _quoted(F.try_element_at(env_old, k)),
            F.lit(" -> "),
            _quoted(F.try_element_at(env_new, k)),
        ),
    )
    found = F.when(
        F.col("broken"),
        findings(
            F.array(F.lit("could not parse settings")), "settings-json-parse", medium, ""
        ),
    ).otherwise(
        F.concat(
            findings(
                F.array_except(entries("n", "allow"), entries("o", "allow")),
                "permissions-allow-added",
                grade_allow,
                "new allow entry: ",
            ),
            findings(
                F.array_except(entries("o", "deny"), entries("n", "deny")),
                "permissions-deny-removed",
                high,
                "deny entry removed: ",
            ),
            findings(F.array_except(hooks("n"), hooks("o")), "hook-added", high, "new hook command: "),
            findings(added_env, "env-var-added", medium, "new env var: "),
            findings(changed_env, "env-var-changed", medium, "env var changed: "),
        )
    )
    return exploded(parsed, ["change_id", "file"], found, "f").select(
        "change_id", "file", "f.rule", "f.severity", "f.detail", F.lit("").alias("snippet")
    )


# Script paths a skill text or an allow entry names.
SCRIPT_REF = r"(?U)\b(?:scripts|\.claude/skills|\.claude/hooks)/[\w./-]+\.(?:py|sh|bash|js|mjs|cjs|ts)\b"
ALLOWED_SCRIPT = r"(?U)(?:scripts|\.claude/[\w-]+)/[\w./-]+\.(?:py|sh|bash|js|mjs|cjs|ts)"


def new_script_refs(changes: DataFrame, pattern: str = SCRIPT_REF) -> DataFrame:
    """Script paths the new text names and the old one did not."""
    refs = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))
    return changes.select(
        "change_id", "file", F.explode(F.array_except(refs("new"), refs("old"))).alias("ref")
    ).select(
        "change_id",
        "file",
        F.lit("skill-new-script-ref").alias("rule"),
        F.lit("HIGH").alias("severity"),
        F.concat(F.lit("skill now references: "), F.col("ref")).alias("detail"),
        F.lit("").alias("snippet"),
    )


# Fixed value: the detail of a finding.
TRUSTED_CHANGED = "this script is referenced by an allow-list entry — its behaviour change is auto-approved"


def trusted_changed(files: DataFrame, allow: DataFrame, pattern: str = ALLOWED_SCRIPT) -> DataFrame:
    """Changed files named by an allow entry ``(entry)``."""
    named = allow.select(
        F.explode(F.regexp_extract_all("entry", F.lit(pattern), F.lit(0))).alias("file")
    ).distinct()
    return files.join(named, "file", "left_semi").select(
        "change_id",
        "file",
        F.lit("trusted-script-modified").alias("rule"),
        F.lit("HIGH").alias("severity"),
        F.lit(TRUSTED_CHANGED).alias("detail"),
        F.lit("").alias("snippet"),
    )


def scan_changes(files: DataFrame, allow: DataFrame) -> DataFrame:
    """All findings of a change set, each check on the files it is for.

    ``files`` is ``(change_id, status, file, diff, old, new)``, ``allow`` is ``(entry)``. Secrets
    are looked for in every file that is still there. Of the files of interest, settings go
    to their own diff alone, skill texts to script references and the rules, all others
    to the rules and the allow list; a deleted one is a finding.
    """
    there = files.filter(F.col("status") != "D")
    near, deleted = of_interest(files)
    settings = F.col("file").isin(*R.SETTINGS_FILES)
    skill = F.col("file").startswith(R.SKILL_FOLDER) & F.col("file").endswith(R.SKILL_FILE)
    scanned = near.filter(~settings)
    found = [
        scan_secrets(there),
        settings_diff(near.filter(settings)),
        new_script_refs(near.filter(skill)),
        scan_rules(scanned),
        trusted_changed(scanned.filter(~skill), allow),
        deleted,
    ]
    return reduce(DataFrame.unionByName, [f.select("change_id", "file", "rule", "severity", "detail", "snippet") for f in found])


def severity_rollup(
    changes: DataFrame, findings: DataFrame, reviews: DataFrame | None = None
) -> DataFrame:
    """Worst severity per change, CLEAN without findings, and whether it blocks.

    ``reviews`` is ``(change_id, text)``; its first ``SEVERITY:`` line counts if known.
    """
    seen = findings.select("change_id", "severity")
    if reviews is not None:
        said = F.upper(F.regexp_extract("text", r"(?mU)^SEVERITY:\s*(\w+)", 1))
        seen = seen.unionByName(
            reviews.select("change_id", said.alias("severity")).filter(
                F.col("severity").isin(*R.SEVERITY_RANK)
            )
        )
    rank = F.coalesce(lookup(R.SEVERITY_RANK, F.col("severity")), F.lit(0))
    worst = seen.groupBy("change_id").agg(
        F.max_by("severity", rank).alias("worst"), F.count(F.lit(1)).alias("findings")
    )
    return changes.select("change_id").distinct().join(worst, "change_id", "left").select(
        "change_id",
        F.coalesce("worst", F.lit("CLEAN")).alias("severity"),
        F.coalesce("findings", F.lit(0)).alias("findings"),
        F.coalesce("worst", F.lit("CLEAN")).isin("HIGH", "CRITICAL").alias("blocking"),
    )
