"""Text expressions: tokens, Markdown chunks, citations, packed lists, display formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Stop lists and limits the retrieval and the search have to reproduce.
STOP_WORDS = [
    "the", "a", "an", "of", "for", "and", "or", "is", "are", "to", "in", "on", "by",
    "with", "as", "at", "from", "this", "that", "it", "its", "be", "each", "when",
    "which", "was", "were", "has", "have", "not", "but", "all", "any", "can", "id",
]
SEARCH_STOP_WORDS = [
    "the", "and", "for", "что", "which", "what", "does", "hold", "holds",
    "have", "has", "are", "is", "of", "in", "on", "a", "an", "to", "with", "que", "qual", "quais",
    "como", "onde", "tem", "sao", "são", "é", "e", "de", "da", "do", "das", "dos", "um", "uma",
]
SEARCH_MIN_TERM = 3
DESCRIPTION_CHARS = 1000
_SEARCH_RUN = r"[a-z0-9_À-ſ]+"
_CAMEL_CASE = "[a-z0-9](?=[A-Z])"

# Every line boundary str.splitlines knows, so documents from any platform chunk alike.
_LINE_END = r"\r\n|[\r\x0B\f\x1C-\x1E\x85  ]"


def tokenize(text: Column) -> Column:
    """Lower-case words of a text, camelCase split, stop words and single characters dropped."""
    spaced = F.regexp_replace(text, _CAMEL_CASE, "$0 ")
    words = F.regexp_extract_all(F.lower(spaced), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 1))


def search_runs(text: Column) -> Column:
    """Maximal runs of search characters in a text, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(_SEARCH_RUN), F.lit(0))


def search_terms(query: Column) -> Column:
    """Terms of a search query. Duplicates stay, they weigh double."""
    return F.filter(
        search_runs(query),
        lambda w: (F.length(w) >= SEARCH_MIN_TERM) & ~w.isin(SEARCH_STOP_WORDS),
    )


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, _LINE_END, "\n")


def heading_title(line: Column) -> Column:
    return strip(F.regexp_replace(line, "^#+", ""))


def markdown_sections(text: Column) -> Column:
    """array<struct<heading, body>>: one per heading line that has lines below it.

    A document is one row, so cutting it at its heading lines needs no shuffle. Text
    above the first heading is dropped, an empty heading drops its section, and a heading
    directly followed by another one yields nothing.
    """
    # The final line break ends the last line, it does not open another one.
    whole = F.regexp_replace(unix_lines(text), r"\n\z", "")
    cuts = F.filter(F.split(whole, r"\n(?=#)"), lambda s: s.startswith("#") & s.contains("\n"))
    sections = F.transform(
        cuts,
        lambda s: F.struct(
            heading_title(F.substring_index(s, "\n", 1)).alias("heading"),
            strip(F.substr(s, F.instr(s, "\n") + 1)).alias("body"),
        ),
    )
    return F.filter(sections, lambda s: s["heading"] != "")


def citation(system: Column, heading: Column) -> Column:
    return F.concat(system, F.lit(": "), heading)


def passage(heading: Column, body: Column) -> Column:
    return F.concat(F.lit("## "), heading, F.lit("\n"), body)


def split_packed(packed: Column, separator: str = ";") -> Column:
    """Split a packed list, trim its items, drop blank ones."""
    items = F.transform(F.split(F.coalesce(packed, F.lit("")), separator), strip)
    return F.filter(items, lambda item: item != "")


def is_filled(text: Column) -> Column:
    """NULL and '' are missing, blanks are not."""
    return F.coalesce(text != "", F.lit(False))


def localized(english: Column, portuguese: Column, language: Column) -> Column:
    return F.coalesce(F.when((language == "pt") & is_filled(portuguese), portuguese), english)


def sql_text(text: Column) -> Column:
    """Single-quoted SQL literal that reads back as the same text, whatever the text holds."""
    safe = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.concat(F.lit("'"), safe, F.lit("'"))


def quoted_name(*parts: Column) -> Column:
    return F.concat_ws(".", *[F.concat(F.lit("`"), F.replace(p, F.lit("`"), F.lit("``")), F.lit("`")) for p in parts])


def markdown_cell(text: Column) -> Column:
    return F.replace(F.when(is_filled(text), text).otherwise(F.lit("-")), F.lit("|"), F.lit("\\|"))


def human_bytes(size: Column, whole_bytes: bool = False) -> Column:
    """'-' for nothing, else one decimal in the largest fitting unit, TB at most."""
    value = size.cast("double")
    # Exact halves round to even, as everywhere else in the reports.
    tenth = lambda v: F.bround(v, 1)
    smallest = F.format_string("%.0f B" if whole_bytes else "%.1f B", value)
    scaled = [
        (1 << 20, "KB", 1 << 10), (1 << 30, "MB", 1 << 20), (1 << 40, "GB", 1 << 30),
    ]
    label = F.when(F.coalesce(size, F.lit(0)) == 0, F.lit("-")).when(value < 1024, smallest)
    for limit, unit, divisor in scaled:
        label = label.when(value < limit, F.format_string(f"%.1f {unit}", tenth(value / float(divisor))))
    return label.otherwise(F.format_string("%.1f TB", tenth(value / float(1 << 40))))


def plural(count: Column, singular: str) -> Column:
    return F.concat(
        count.cast("string"), F.lit(" " + singular), F.when(count > 1, F.lit("s")).otherwise(F.lit(""))
    )
