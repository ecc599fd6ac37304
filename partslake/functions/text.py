"""Column functions over text: lines, table cells, part links, sort keys.

All are built-in expressions over one value; a document is handled inside its row, so
none of them shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as a line break, and as blank.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
BLANKS = "".join(
    chr(c)
    for c in (
        0x20, 0x09, 0x0A, 0x0D, 0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)

BLANK_CLASS = (
    r"[ \t\n\r\x0B\x0C\x1C-\x1F\x{85}\xA0\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
OUTER_BLANK = rf"^{BLANK_CLASS}|{BLANK_CLASS}\z"

PARTS_LINK = r"\[([^\]]+)\]\(parts/([^)]+\.md)\)"
SOURCE_TOKEN = r"^[a-z][a-z0-9_-]*\z"
SEPARATOR_CELL = r"^:?-{3,}:?\z"


def has_outer_blanks(text: Column) -> Column:
    return text.rlike(OUTER_BLANK)


def strip(text: Column) -> Column:
    """Text without outer blanks of any kind. Names its input once, so nesting stays small."""
    # a run of blanks is looked at from its first one only, so long runs stay linear
    return F.regexp_replace(text, rf"^{BLANK_CLASS}++|(?<!{BLANK_CLASS}){BLANK_CLASS}++\z", "")


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""
    body = F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(body, LINE_BREAK, -1)
    )


def split_cells(line: Column) -> Column:
    """Cells of a pipe-table line: all outer pipes go, then every pipe splits."""
    return F.transform(F.split(F.btrim(strip(line), F.lit("|")), r"\|", -1), strip)


def is_table_line(line: Column) -> Column:
    return line.rlike(r"(?Us)^\s*\|(?:.*\|)?\s*\z")


def is_separator_line(line: Column) -> Column:
    """A table line whose non-empty cells are dashes, with at least one such cell."""
    cells = split_cells(line)
    return is_table_line(line) & F.aggregate(
        cells,
        F.lit(0),
        lambda seen, c: F.when(seen < 0, seen)
        .when(c == "", seen)
        .when(c.rlike(SEPARATOR_CELL), F.lit(1))
        .otherwise(F.lit(-1)),
        lambda seen: seen > 0,
    )


def part_link(cell: Column) -> Column:
    """Visible text and page of a Part cell: ``(part, page, target)``.

    ``part`` and ``page`` need the link at the start of the cell, ``target`` is the
    first link anywhere in it.
    """
    cell = strip(cell)
    visible = F.regexp_extract(cell, "^" + PARTS_LINK, 1)
    page = F.regexp_extract(cell, "^" + PARTS_LINK, 2)
    target = F.regexp_extract(cell, PARTS_LINK, 2)
    return F.struct(
        F.when(visible == "", cell).otherwise(visible).alias("part"),
        F.nullif(page, F.lit("")).alias("page"),
        F.nullif(target, F.lit("")).alias("target"),
    )


@cache
def _unlike_lower() -> dict[str, str]:
    """Letters whose case folding is not their lower case, with it."""
    letters = map(chr, (*range(0xD800), *range(0xE000, 0x110000)))
    return {c: c.casefold() for c in letters if c.casefold() != c.lower()}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def fold(text: Column) -> Column:
    """Case-folded sort key. Texts with a letter that folds otherwise go letter by letter."""
    odd = _unlike_lower()
    pairs = F.create_map(*[F.lit(x) for pair in odd.items() for x in pair])

    def folded(t: Column) -> Column:
        letters = F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), F.lower(c)))
        lower = F.replace(F.lower(t), F.lit("ς"), F.lit("σ"))  # at the end of a word
        plain = F.octet_length(t) == F.length(t)
        return F.when(plain, F.lower(t)).when(t.rlike("[" + "".join(odd) + "]"), F.array_join(letters, "")).otherwise(lower)

    return bound(text, folded)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def folder(path: Column) -> Column:
    """Name of the directory a file lies in."""
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def try_int(text: Column) -> Column:
    """Integer of a text such as ``12`` or ``-3``; anything else is null."""
    clean = strip(text)
    return F.when(clean.rlike(r"^[+-]?[0-9]+\z"), F.regexp_replace(clean, r"^\+", "")).try_cast(
        "long"
    )
