"""Text normalisation as column expressions: no Python runs per row."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratiform.functions.names import LIGATURES


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and their base letter; combining marks map to nothing."""
    letters, bases = [], []
    for code in range(0xC0, 0x180):
        letter = chr(code)
        base, *rest = unicodedata.normalize("NFKD", letter)
        if rest and base.isascii() and base.isalpha() and all(map(unicodedata.combining, rest)):
            letters.append(letter)
            bases.append(base)
    # Stroked and dotless letters have no decomposition.
    letters += ["Ø", "ø", "Đ", "đ", "Ł", "ł", "ı"]
    bases += ["O", "o", "D", "d", "L", "l", "i"]
    marks = "".join(chr(code) for code in range(0x300, 0x370))
    return "".join(letters) + marks, "".join(bases)


FOLD_FROM, FOLD_TO = _fold_table()
BLANKS = "\t\n\x0b\f\r\u00a0\u202f"
PUNCTUATION = "-.'’‘,;:/()[]"


def _spelled(text: Column) -> Column:
    """Ligatures spelled out. Pure ASCII text, seen by its length in bytes, is left as it is."""
    spelled = text
    for letter, ascii_letters in LIGATURES.items():
        spelled = F.replace(spelled, F.lit(letter), F.lit(ascii_letters))
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(spelled)


def fold_accents(text: Column, to_space: str = "") -> Column:
    """Base letters only, and a space for every sign in ``to_space``: one pass over the text."""
    return F.translate(_spelled(text), to_space + FOLD_FROM, " " * len(to_space) + FOLD_TO)


def squeeze_spaces(text: Column) -> Column:
    """Runs of spaces become one space, by plain replacements, which cost less than a pattern."""
    mark = "\ue000"
    marked = F.replace(text, F.lit(" "), F.lit(f" {mark}"))
    return F.replace(F.replace(marked, F.lit(f"{mark} "), F.lit("")), F.lit(mark), F.lit(""))


def normalize_label(text: Column) -> Column:
    """Matching key of a label: folded, upper case, punctuation and spaces squeezed, blank -> null."""
    words = F.upper(fold_accents(text, BLANKS + PUNCTUATION))
    return F.nullif(F.trim(squeeze_spaces(words)), F.lit(""))


# Pay situation -> accepted spellings.
SITUATIONS = {
    "en_activite": ["EN ACTIVITE", "ACTIVITE", "EN ACTIVITÉ", "ACTIVITÉ"],
    "regul_indemnites": ["REGUL. INDEMNITES", "REGUL INDEMNITES", "REGULARISATION INDEMNITES"],
    "demi_solde": ["DEMI-SOLDE", "DEMI SOLDE", "DEMISOLDE", "1/2 SOLDE"],
}


def normalize_category(
    text: Column,
    synonyms: Mapping[str, Iterable[str]] = SITUATIONS,
    default: str = "autre",
) -> Column:
    """Category whose list holds the folded, squeezed text; everything else is ``default``.

    One lookup in a constant map, so the text is folded once per row.
    """
    category_of: dict[str, str] = {}
    for category, spellings in synonyms.items():
        for spelling in spellings:
            category_of.setdefault(spelling, category)
    lookup = F.create_map(*[F.lit(part) for pair in category_of.items() for part in pair])
    key = F.trim(squeeze_spaces(F.upper(fold_accents(text, BLANKS))))
    return F.coalesce(F.try_element_at(lookup, key), F.lit(default))


def trim_upper(text: Column) -> Column:
    return F.trim(F.upper(text))


def blank_to_null(text: Column, *also: str) -> Column:
    """Empty or white text becomes null; so do the extra marker texts given."""
    trimmed = F.nullif(F.trim(text), F.lit(""))
    for marker in also:
        trimmed = F.nullif(trimmed, F.lit(marker))
    return trimmed


def metadata_path(column: str = "_metadata.file_path") -> Column:
    """The file path of Spark's metadata column, where special signs are percent-encoded."""
    return F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B")))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    name = file_name(path)
    extension = F.substring_index(name, ".", -1)
    return F.when(extension == name, name).otherwise(F.left(name, F.length(name) - F.length(extension) - 1))


def file_extension(path: Column) -> Column:
    name = file_name(path)
    extension = F.substring_index(name, ".", -1)
    return F.when(extension == name, "").otherwise(F.lower(extension))
