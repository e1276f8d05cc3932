"""Column expressions for cleaning, normalising and composing catalogue text."""

from pyspark.sql import Column, functions as F

BLANK = r"[\s\p{Z}\x{FEFF}]"

# Media type served for each file extension.
CONTENT_TYPES = {
    "pdf": "application/pdf",
    "epub": "application/epub+zip",
    "mobi": "application/x-mobipocket-ebook",
    "djvu": "image/vnd.djvu",
    "txt": "text/plain",
    "cbz": "application/x-cbz",
    "cbr": "application/x-cbr",
    "azw3": "application/x-mobi8-ebook",
    "fb2": "application/x-fictionbook+xml",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"

# Characters removed by the two cleaning modes.
STRICT_JUNK = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FFFD}\x{10000}-\x{10FFFF}]"
LENIENT_JUNK = r"[\x00\x{FFFD}]"

MAX_FILENAME_CHARS = 200


def trim_blanks(c: Column) -> Column:
    """Trim every Unicode blank, where Spark's trim removes plain spaces only."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def present(c: Column) -> Column:
    """True for a request field that was given, i.e. neither NULL nor ''."""
    return F.coalesce(c != "", F.lit(False))


def first_present(*cols: Column) -> Column:
    """First column that is neither NULL nor '', else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def clean_strict(c: Column) -> Column:
    """Drop control characters, U+FFFD and everything outside the basic plane."""
    return F.regexp_replace(or_empty(c), STRICT_JUNK, "")


def clean_lenient(c: Column) -> Column:
    """Drop only NUL and U+FFFD."""
    return F.regexp_replace(or_empty(c), LENIENT_JUNK, "")


def compose_text(
    title: Column, author: Column, description: Column, genres: Column, max_chars: int | None = None
) -> Column:
    """Text to embed: the non-empty parts joined by ' | ', cut to `max_chars` where the model has such a limit."""
    parts = [F.nullif(c, F.lit("")) for c in (title, author, description, genres)]
    whole = F.concat_ws(" | ", *parts)
    return whole if max_chars is None else F.substring(whole, 1, max_chars)


def normalize_isbn(c: Column) -> Column:
    return F.regexp_replace(c, rf"-|{BLANK}", "")


def is_isbn_query(c: Column) -> Column:
    return normalize_isbn(c).rlike("^[0-9]{10,13}$")


def float_prefix(c: Column, default: float | None = None) -> Column:
    """Leading decimal number of a string; zero and no number both give the default."""
    digits = F.regexp_extract(c, rf"^{BLANK}*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1)
    number = F.nullif(digits.try_cast("double"), F.lit(0.0))
    return number if default is None else F.coalesce(number, F.lit(default))


def int_prefix(c: Column, default: int | None = None) -> Column:
    """Leading integer of a string; zero and no number both give the default."""
    digits = F.regexp_extract(c, rf"^{BLANK}*([+-]?[0-9]+)", 1)
    number = F.nullif(digits.try_cast("bigint"), F.lit(0))
    return number if default is None else F.coalesce(number, F.lit(default))


def words(c: Column) -> Column:
    """Lower-case words of a request, split on blanks, duplicates kept."""
    return F.filter(F.split(F.lower(c), f"{BLANK}+"), lambda w: w != "")


def main_title(c: Column) -> Column:
    """Lower-case title without the subtitle that follows ':' or an em dash."""
    return trim_blanks(F.element_at(F.split(F.lower(or_empty(c)), r"[:\x{2014}]"), 1))


def title_words(c: Column) -> Column:
    return F.filter(F.split(main_title(c), r"[\s\p{Z}\x{FEFF},\-]+"), lambda w: w != "")


def _titled(title: Column, author: Column) -> Column:
    return F.when(present(author), F.concat(title, F.lit(" - "), author)).otherwise(title)


def served_filename(title: Column, author: Column, extension: Column, md5: Column) -> Column:
    """File name offered when a collected document is served."""
    def keep(c: Column) -> Column:
        return trim_blanks(F.regexp_replace(c, r"[^a-zA-Z0-9_\- .()]", ""))

    stem = _titled(keep(first_present(title, md5)), keep(or_empty(author)))
    return F.concat(stem, F.lit("."), first_present(extension, F.lit("bin")))


def suggested_filename(title: Column, author: Column, extension: Column, md5: Column) -> Column:
    """Shorter file name proposed for a download, at most 200 characters before the extension."""
    def keep(c: Column) -> Column:
        return trim_blanks(F.regexp_replace(or_empty(c), r"[^a-zA-Z0-9_\- ]", ""))

    stem = _titled(first_present(keep(title), md5), keep(author))
    return F.concat(
        F.substring(stem, 1, MAX_FILENAME_CHARS), F.lit("."), first_present(extension, F.lit("bin"))
    )


def content_type(extension: Column) -> Column:
    pairs = [F.lit(x) for kv in CONTENT_TYPES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension), F.lit(DEFAULT_CONTENT_TYPE))


def decode_entities(c: Column) -> Column:
    """Decode the four named entities, then decimal character references."""
    # The named entities that occur in outlines.
    for name, char in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]:
        c = F.replace(c, F.lit(name), F.lit(char))
    # Split keeps the text around each reference: pair every piece with the reference before it.
    pieces = F.split(c, "&#[0-9]+;")
    codes = F.concat(F.array(F.lit("")), F.regexp_extract_all(c, F.lit("&#([0-9]+);"), F.lit(1)))
    decoded = F.zip_with(
        codes, pieces,
        lambda code, text: F.concat(
            F.when(code == "", F.lit("")).otherwise(utf16_unit(code)), text
        ),
    )
    return F.when(c.contains("&#"), F.array_join(decoded, "")).otherwise(c)


def utf16_unit(code: Column) -> Column:
    """The character with this decimal number, taken modulo 65536 as one 16-bit unit."""
    unit = F.pmod(code.cast("decimal(38,0)"), F.lit(65536)).cast("int")
    return F.decode(F.unhex(F.lpad(F.hex(unit), 4, "0")), "UTF-16BE")
