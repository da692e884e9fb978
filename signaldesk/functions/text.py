"""String expressions: normalising, hashing, light HTML handling."""

from __future__ import annotations

import json
import unicodedata
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from signaldesk.constants import ANNUAL_FORMS, LEGAL_SUFFIXES, METADATA_TOKENS, REASON_LABELS
from signaldesk.functions.dates import col


# ---- forms, keys, labels -------------------------------------------------
def normalize_form(form) -> Column:
    return F.regexp_replace(F.trim(F.upper(col(form))), "/A$", "")


def comparable_group(form) -> Column:
    return F.when(normalize_form(form).isin(*ANNUAL_FORMS), "annual").otherwise("interim")


def pad_key(cik, width: int = 10) -> Column:
    digits = F.coalesce(col(cik).cast("string").try_cast("bigint"), F.lit(0)).cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def reason_label(reason) -> Column:
    labels = F.create_map(*[F.lit(v) for pair in REASON_LABELS.items() for v in pair])
    return F.coalesce(labels[col(reason)], F.initcap(F.replace(col(reason), F.lit("-"), F.lit(" "))))


# ---- urls and hashes -------------------------------------------------------
def canonical_url(url) -> Column:
    """Drop query, fragment and ``;params`` of the last path segment."""
    bare = F.regexp_replace(col(url), r"[?#].*$", "")
    return F.regexp_replace(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*/.*|/.*);[^/]*$", "$1")


def content_hash(url, title) -> Column:
    return F.sha2(F.concat_ws("|", col(url), col(title)), 256)


def resolve_url(base, href) -> Column:
    """Join a link to its page's address (absolute, scheme-, root- or folder-relative)."""
    base, href = col(base), col(href)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://.*/)", 1)
    in_root = F.length(folder) <= F.length(root)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(F.when(in_root, F.concat(root, F.lit("/"))).otherwise(folder), href))
    )


# ---- text normalising --------------------------------------------------------
def squeeze(text) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def entity_text(text) -> Column:
    """Lower case, runs of anything but a-z0-9 become one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9]+", " "))


_LATIN_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_LATIN_TO = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def sponsor_text(name) -> Column:
    """Entity text after folding Latin accents, dropping other non-ASCII and spelling out ``&``."""
    folded = F.translate(F.coalesce(col(name), F.lit("")), _LATIN_FROM, _LATIN_TO)
    ascii_only = F.regexp_replace(folded, r"[^\x00-\x7F]", "")
    return entity_text(F.replace(ascii_only, F.lit("&"), F.lit(" and ")))


# By rule: every letter or digit of the basic plane whose compatibility form is ASCII but for marks.
_FOLDED = {chr(c): a for c in range(0x80, 0x10000)
           if unicodedata.category(chr(c))[0] in "LN" and (a := unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()).isalnum()}
_FOLD_FROM = "".join(c for c, a in _FOLDED.items() if len(a) == 1)
_FOLD_TO = "".join(a for a in _FOLDED.values() if len(a) == 1)
_FOLD_LONG = {c: a for c, a in _FOLDED.items() if len(a) > 1 and unicodedata.category(c)[0] == "L"}   # ligatures and double letters


def sponsor_text_full(name) -> Column:
    """As ``sponsor_text``, for all letters that have an ASCII form: Vietnamese, full-width, ligatures."""
    text = F.coalesce(col(name), F.lit(""))
    folded = F.translate(text, _FOLD_FROM, _FOLD_TO)
    long = folded
    for letter, plain in _FOLD_LONG.items():
        long = F.replace(long, F.lit(letter), F.lit(plain))
    folded = F.when(folded.rlike("[" + "".join(_FOLD_LONG) + "]"), long).otherwise(folded)
    return entity_text(F.replace(F.regexp_replace(folded, r"[^\x00-\x7F]", ""), F.lit("&"), F.lit(" and ")))


def compact_name(name) -> Column:
    return F.replace(sponsor_text(name), F.lit(" "), F.lit(""))


def core_compact_name(name) -> Column:
    """Compact name without trailing legal-form words (kept when nothing else is left)."""
    base = sponsor_text(name)
    suffix = "|".join(LEGAL_SUFFIXES)
    trimmed = F.regexp_replace(base, f"( ({suffix}))+$", "")
    trimmed = F.when(trimmed.rlike(f"^({suffix})$"), base).otherwise(trimmed)
    return F.replace(trimmed, F.lit(" "), F.lit(""))


# ---- light HTML -----------------------------------------------------------------
# Names of the language's standard table; the blank that does not break is a plain one here.
_ENTITIES = json.dumps({name: chr(code) for name, code in name2codepoint.items()} | {"nbsp": " ", "apos": "'"})


def unescape(text) -> Column:
    """Decodes named, decimal and hexadecimal entities, each once; what is none stays as it is."""
    parts = F.split(col(text), "&")
    names = F.from_json(F.lit(_ENTITIES), "map<string,string>")

    def decoded(part: Column) -> Column:
        name = F.regexp_extract(part, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,15});", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 8)).cast("bigint")
        usable = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.when(usable, F.when(code == 160, " ").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
        found = F.coalesce(char, F.try_element_at(names, name))
        return F.coalesce(F.concat(found, F.substr(part, F.length(name) + 2)), F.concat(F.lit("&"), part))

    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(F.size(parts) > 1, F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(rest, decoded), ""))).otherwise(col(text))


def strip_markup(markup) -> Column:
    """Visible text of an HTML string: drops scripts, styles, comments and tags."""
    bare = F.regexp_replace(col(markup), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


def inline_text(markup) -> Column:
    """Unescape, strip markup if any is left, and collapse spaces.

    Text without tags passes the stripping unchanged, so one chain serves both.
    """
    given = F.coalesce(col(markup), F.lit(""))
    return squeeze(strip_markup(unescape(given)))


# ---- extracted text cleaning --------------------------------------------------------
def is_noise_line(line: Column) -> Column:
    """Lines that carry no prose: bare links, page numbers, tagging metadata.

    The costly tests run only on lines that hold the character they need.
    """
    lowered = F.lower(line)
    tokens = F.filter(F.split(line, r"\s+"), lambda t: F.length(t) > 0)
    names = F.size(F.filter(tokens, lambda t: t.rlike(r"(?i)^[a-z][\w.-]*:[\w.-]+$")))
    marks = F.size(F.filter(tokens, lambda t: t.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{8,10})$")))
    with_colon = (
        line.rlike(r"(?i)^(https?://\S+\s*)+$")
        | lowered.rlike(r"^(https?://fasb\.org/|https?://xbrl\.)")
        | ((names >= 1) & (F.size(tokens) == 1))
        | ((names >= 2) & ((names + marks) >= F.size(tokens) * 0.6))
    )
    short = (F.length(line) <= 5) & (line.rlike(r"^\d{1,4}$") | lowered.isin(*METADATA_TOKENS))
    return short | F.when(line.contains(":"), with_colon).otherwise(False)


def plain_characters(text) -> Column:
    """Unify line ends, no-break spaces and dashes; drop zero-width spaces."""
    return F.translate(col(text), "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029\u00a0\u2011\u2013\u2014\u200b", "\n" * 9 + " ---")


def text_lines(text) -> Column:
    """Non-empty lines with single spaces inside and none at the ends (two passes over the whole text)."""
    edges = F.regexp_replace(plain_characters(text), r"\s*\n\s*", "\n")
    flat = F.regexp_replace(F.regexp_replace(edges, r"^\s+|\s+$", ""), r"[ \t]+", " ")
    return F.filter(F.split(flat, "\n"), lambda x: F.length(x) > 0)


def drop_repeats(lines: Column) -> Column:
    """Remove elements equal to the one before them."""
    shifted = F.concat(F.array(F.lit(None).cast("string")), lines)
    return F.array_compact(F.zip_with(lines, shifted, lambda now, before: F.when(~now.eqNullSafe(before), now)))


def clean_extracted(text) -> Column:
    lines = F.filter(text_lines(text), lambda x: ~is_noise_line(x))
    return F.array_join(drop_repeats(lines), "\n")


# ---- finders ---------------------------------------------------------------------------
def item_numbers(text) -> Column:
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"\b\d\.\d{2}\b"), F.lit(0))
    return F.sort_array(F.array_distinct(found))


MONTH_DAY_YEAR = (
    r"(?i)\b((?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|"
    r"Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},\s+\d{4})\b"
)


def date_text(text) -> Column:
    return F.nullif(F.regexp_extract(col(text), MONTH_DAY_YEAR, 1), F.lit(""))


def committee_name(title) -> Column:
    raw = F.trim(col(title))
    named = F.regexp_extract(
        raw, r"(?i)meeting of the ([^.]+?)(?: meeting announcement| advisory committee|$)", 1)
    named = F.regexp_replace(named, r"^[ \-,:]+|[ \-,:]+$", "")
    loose = F.trim(F.regexp_extract(raw, r"([A-Za-z][A-Za-z\s&-]+Advisory Committee)", 1))
    return (
        F.when(named.rlike("(?i)advisory committee"), named)
        .when(named != "", F.concat(named, F.lit(" Advisory Committee")))
        .when(loose != "", loose)
    )


def filing_urls(cik, accession, document) -> dict[str, Column]:
    number = F.coalesce(col(cik).cast("string").try_cast("bigint"), F.lit(0)).cast("string")
    base = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), number, F.lit("/"),
                    F.replace(col(accession), F.lit("-"), F.lit("")))
    index = F.concat(base, F.lit("/"), col(accession), F.lit("-index.htm"))
    doc = F.nullif(col(document), F.lit(""))
    return {
        "filing_url": index,
        "original_document_url": F.coalesce(F.concat(base, F.lit("/"), doc), index),
        "submission_text_url": F.concat(base, F.lit("/"), col(accession), F.lit(".txt")),
    }
