"""Label and title normalisation as Column expressions.

One class of white space is spelled out, so that every engine removes the same characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, separators 1C-1F, zero-width characters and the byte-order mark.
WS_SET = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}-\x{200D}\x{FEFF}"
WS = f"[{WS_SET}]"

#: Removed from a label one after the other: note references, white space, and leading numbers of all kinds.
LABEL_STEPS = (
    rf"<주석?{WS}*[0-9,{WS_SET}]+>",
    rf"\(주석?{WS}*[0-9,{WS_SET}]+\)",
    rf"{WS}+",
    r"^[\x{2160}-\x{216B}]+\.?",
    r"^[IVXivx]+\.",
    r"^[0-9]+\.",
    r"^[가-힣]\.",
    r"^\([0-9]+\)",
    r"^\.+|\.+$",
)

#: A row label's leading number, (가) or 가. with what follows it.
ROW_PREFIX = rf"^(?:[\(\[]?[0-9①-⑳]{{1,3}}[\)\]]?[\.{WS_SET}]*|\({WS}*[가나다라마바사아자차카타파하]{WS}*\)[\.{WS_SET}]*|[가나다라마바사아자차카타파하][\.\)][\.{WS_SET}]*)"


#: The characters of WS one by one.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x200B, 0x200E), 0xFEFF]))


def trim(c: Column) -> Column:
    """Without white space at either end; looks at the ends only, which a pattern does not."""
    return F.btrim(c, F.lit(WS_CHARS))


def label(c: Column) -> Column:
    """A statement line's name as the catalogue has it."""
    for step in LABEL_STEPS:
        c = F.regexp_replace(c, step, "")
    return c


def title(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", "")


def title_core(c: Column) -> Column:
    """The title without its leading number."""
    return F.regexp_replace(title(c), r"^[0-9\-]+\.", "")


def _without_prefix(c: Column) -> Column:
    rest = F.regexp_replace(c, ROW_PREFIX, "")
    return F.when(rest == "", c).otherwise(rest)


def row_label(c: Column) -> Column:
    """A row's name for the depreciation rules: prefixes go until none is left, but never the whole label."""
    start = trim(F.translate(c, " 　 ", ""))
    # A prefix takes at least one character, so there are no more of them than the label has characters.
    steps = F.sequence(F.lit(1), F.greatest(F.length(start), F.lit(1)))
    return F.when(start.rlike(ROW_PREFIX), F.aggregate(steps, start, lambda acc, _: _without_prefix(acc))).otherwise(start)


def nospace(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def contains_any(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    return F.coalesce(F.greatest(F.lit(False), *(c.contains(w) for w in words)), F.lit(False))


def report_year(c: Column) -> Column:
    """The fiscal year in a report's name, e.g. (2023.12)."""
    return F.nullif(F.regexp_extract(c, r"\(([0-9]{4})\.[0-9]{2}\)", 1), F.lit("")).cast("int")


def filename_part(c: Column, default: str = "trace") -> Column:
    """Characters that file names cannot have, and white space, become one underscore."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), rf'[\\/:*?"<>|{WS_SET}]+', "_"), r"^[._]+|[._]+$", "")
    return F.when(clean == "", F.lit(default)).otherwise(clean)


def name_lines(c: Column) -> Column:
    """Non-empty trimmed lines of an input field."""
    return F.filter(F.transform(F.split(c, r"\r\n|\r|\n"), trim), lambda x: x != "")


def json_block(c: Column) -> Column:
    """The body of the first fenced block, if there is one, else the whole text."""
    body = F.regexp_extract(c, r"(?s)```(?:json)?[\x09-\x0D\x20]*(.*?)[\x09-\x0D\x20]*```", 1)
    return F.when(body != "", body).otherwise(trim(c))


def reply(c: Column, schema: str = "map<string,string>") -> Column:
    """A model's reply as values by name, out of its first fenced block or the whole text; null where that is no JSON object."""
    return F.from_json(json_block(c), schema)
