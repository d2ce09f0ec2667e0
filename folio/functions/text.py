"""Text functions and predicates of page lines, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.arrays import let

# Word lists and patterns of the page model.
HYPHENS = "-‐"
DASHES = "-–— "
CONJUNCTIONS = ("und", "oder", "bzw", "sowie", "beziehungsweise", "and", "or")
TOC_HEADINGS = ("inhalt", "inhaltsverzeichnis", "contents", "table of contents")
FOOTNOTE_MARKER = r"^(\*|†|\(\p{N}|\p{N}+(\)|\p{L}))"
PUBLISHER_WORDS = (
    "verlag", "verlags", "press", "publishing", "publishers", "publisher", "editions", "éditions", "editore", "editorial",
    "gmbh", "ltd", "inc", "isbn", "©", "copyright", "übersetzt", "translated", "herausgegeben", "edited", "aus dem", "printed",
)
UNSAFE_IN_NAMES = r'[/:\\?*|"<>\x00-\x1f\x7f]'
ENDS_SENTENCE = r"[.!?:“”\"')’]$"


def composed(text: Column) -> Column:
    """The text in composed form (NFC), null for null; for texts as they come in, as lengths and comparisons expect it."""
    return F.when(text.isNotNull(), F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(False)))


def characters(text: Column) -> Column:
    """Characters as a reader counts them: a letter with its marks, a joined emoji, a flag or a line end of two bytes is one.

    Extended grapheme clusters of the JVM's regular expressions; the pattern runs only where they may differ from code points.
    """
    plain = (F.octet_length(text) == F.length(text)) & ~F.contains(text, F.lit("\r\n"))
    return F.when(plain, F.length(text)).otherwise(F.regexp_count(text, F.lit(r"\X")))


def normalized(text: Column) -> Column:
    """Lower case, everything but letters, marks and numbers as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))


#: Small Greek letters with an iota below, and their capitals of one character.
_IOTA = "".join(chr(c) for c in [*range(0x1F80, 0x1F88), *range(0x1F90, 0x1F98), *range(0x1FA0, 0x1FA8), 0x1FB3, 0x1FC3, 0x1FF3])
_IOTA_CAPITALS = "".join(chr(c) for c in [*range(0x1F88, 0x1F90), *range(0x1F98, 0x1FA0), *range(0x1FA8, 0x1FB0), 0x1FBC, 0x1FCC, 0x1FFC])


def capitals(text: Column) -> Column:
    """Each character as its one capital: ß is ẞ, and what only several letters could spell, like ŉ, stays."""
    text = F.replace(text, F.lit("ß"), F.lit("ẞ"))
    one = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, _IOTA, _IOTA_CAPITALS))
    return F.when(F.length(F.upper(text)) == F.length(text), F.upper(text)).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def snapshot_words(text: Column) -> Column:
    """Lower-case runs of letters and numbers of at least four characters, repeats kept."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: (F.length(w) >= 4) & (characters(w) >= 4))


def starts_with_number(text: Column) -> Column:
    """One to four leading digits and no fifth."""
    digits = F.length(F.regexp_extract(text, r"^\p{N}+", 0))
    return (digits >= 1) & (digits <= 4)


def ends_with_number(text: Column) -> Column:
    """One to four trailing digits, any of ``.) `` aside, after something else."""
    bare = F.trim(text, F.lit(".) "))
    digits = F.length(F.regexp_extract(bare, r"\p{N}+$", 0))
    return (digits >= 1) & (digits <= 4) & (F.length(bare) > digits)


def is_all_caps(text: Column) -> Column:
    """At least four letters, four fifths of them capitals, few other characters and at most two digits."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    letters, digits, spaces = count(r"\p{L}"), count(r"\p{N}"), count(r"\s")
    rest = characters(text) - letters - spaces
    return (letters >= 4) & (5 * rest <= 2 * characters(text)) & (digits <= 2) & (5 * count(r"\p{Lu}") >= 4 * letters)


def starts_with_footnote_marker(text: Column) -> Column:
    return F.regexp_like(text, F.lit(FOOTNOTE_MARKER))


def is_excluded_title(text: Column) -> Column:
    """Lines that are no titles: a publisher's words, a year, or fewer than two letters."""
    low = F.lower(text)
    words = F.regexp_like(low, F.lit("|".join(PUBLISHER_WORDS)))
    year = F.regexp_like(low, F.lit(r"\b(1[5-9]|20)[0-9][0-9]\b"))
    return words | year | (F.regexp_count(text, F.lit(r"\p{L}")) < 2)


def continues(previous: Column, following: Column) -> Column:
    """Whether a paragraph runs on: a hyphen at the end, or no closing mark and a lower-case start."""
    hyphen = F.regexp_like(previous, F.lit(f"[{HYPHENS}]$"))
    return hyphen | (~F.regexp_like(previous, F.lit(ENDS_SENTENCE)) & F.regexp_like(following, F.lit(r"^\p{Ll}")))


def _small_number(bare: Column) -> Column:
    number = F.when(F.regexp_like(bare, F.lit(r"^[0-9]{1,4}$")), bare).try_cast("int")
    return F.when(number > 0, number)


def page_number(text: Column) -> Column:
    """The positive number of a line that is nothing else than one to four digits, dashes and spaces aside."""
    return _small_number(F.trim(text, F.lit(DASHES)))


def header_number(text: Column) -> Column:
    """The number at the start or end of a running head of two to seven words."""
    tokens = F.filter(F.split(text, " "), lambda t: t != "")
    lettered = lambda part: F.exists(part, lambda t: F.regexp_like(t, F.lit(r"\p{L}")))
    n = F.size(tokens)
    first, last = page_number(F.get(tokens, 0)), page_number(F.get(tokens, n - 1))
    rest, before = F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))), F.slice(tokens, 1, F.greatest(n - 1, F.lit(0)))
    found = F.coalesce(F.when(lettered(rest), first), F.when(lettered(before), last))
    return F.when((n >= 2) & (n <= 7), found)


def without_toc_numbers(text: Column) -> Column:
    """A contents entry without its leading and trailing numbers."""
    head = F.when(starts_with_number(text), F.regexp_replace(text, r"^[\p{N}. ]*", "")).otherwise(text)
    return let(head, lambda t: F.when(ends_with_number(t), F.regexp_replace(t, r"[\p{N}. ]*$", "")).otherwise(t))


def file_system_safe(text: Column) -> Column:
    """A name that any file system takes: at most 80 characters, no reserved ones, no dots or spaces at the ends."""
    spaced = F.regexp_replace(F.regexp_replace(text, UNSAFE_IN_NAMES, " "), r"\s+", " ")
    return F.trim(F.left(F.trim(spaced), F.lit(80)), F.lit(". "))


def title_or_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def html_escape(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def comment_safe(text: Column) -> Column:
    return F.replace(html_escape(text), F.lit("--"), F.lit("- -"))


def page_marker(number: Column, printed: Column) -> Column:
    """The placeholder that survives a converter."""
    return F.concat(F.lit("@@SEITE "), number.cast("string"), F.coalesce(F.concat(F.lit(" S"), printed), F.lit("")), F.lit("@@"))


def page_comment(number: Column, printed: Column) -> Column:
    scan = number.cast("string")
    return F.when(printed.isNull(), F.concat(F.lit("<!-- Seite "), scan, F.lit(" -->"))).otherwise(
        F.concat(F.lit("<!-- Seite "), printed, F.lit(", Scan "), scan, F.lit(" -->"))
    )


def note_marker(text: Column) -> Column:
    return F.concat(F.lit("@@NOTIZ "), text, F.lit("@@"))


def restore_markers(text: Column) -> Column:
    """Placeholders back to comments; a converter may have put a backslash in front."""
    text = F.regexp_replace(text, r"\\?@@SEITE ([0-9]+) S(\S+?)@@", r"<!-- Seite $2, Scan $1 -->")
    text = F.regexp_replace(text, r"\\?@@SEITE ([0-9]+)@@", r"<!-- Seite $1 -->")
    return F.regexp_replace(text, r"\\?@@NOTIZ (.+?)@@", r"<!-- $1 -->")


def natural_key(name: Column) -> Column:
    """A sort key under which 9 stands before 10: runs of digits as nineteen, longer ones behind them by length and value."""

    def part(token: Column) -> Column:
        digits = F.regexp_replace(token, "^0+(?=[0-9])", "")
        length = F.length(digits)
        long = F.concat(F.lit(":"), F.lpad(length.cast("string"), 9, "0"), digits)
        return F.when(~F.regexp_like(token, F.lit("^[0-9]")), token).when(length <= 19, F.lpad(digits, 19, "0")).otherwise(long)

    return F.array_join(F.transform(F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]+"), F.lit(0)), part), "")


def short_camera_name(name: Column, megapixels: Column, prefixes: tuple[str, ...] = ("Kamera von ", "Camera of "), wrapped: Column | None = None) -> Column:
    """A camera's name without what its system puts before the device's, and its megapixels; ``wrapped`` takes the place of the bare device name.

    ``wrapped`` is a format with one %s, null where the device name stands alone.
    """
    bare = F.lit(None).cast("string")
    for p in reversed(prefixes):
        bare = F.when(F.startswith(name, F.lit(p)), F.trim(F.substring(name, F.lit(len(p) + 1), F.length(name)), F.lit('„“" '))).otherwise(bare)
    if wrapped is not None:
        bare = F.coalesce(F.replace(wrapped, F.lit("%s"), bare), bare)
    return F.concat(F.coalesce(bare, name), F.lit(" · "), F.format_string("%.1f MP", megapixels.cast("double")))


def issue_text(kind: Column, first: Column, last: Column) -> Column:
    """An issue of the page sequence in words."""
    span = F.when(first == last, F.concat(F.lit("page "), first.cast("string"))).otherwise(F.concat(F.lit("pages "), first.cast("string"), F.lit("–"), last.cast("string")))
    return (
        F.when(kind == "missing", F.concat(span, F.lit(" missing"))).when(kind == "duplicate", F.concat(F.lit("duplicate of scan "), first.cast("string")))
        .when(kind == "outOfOrder", F.concat(F.lit("out of order after page "), first.cast("string")))
    )


def display_name(title: Column, directory: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), directory)


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_iso_timestamp(text: Column) -> Column:
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
