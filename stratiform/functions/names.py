"""Column-name rules. They work on header metadata only, never on rows."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence

EMPTY_NAME = "colonne_vide"

# Letters that have no accent decomposition, and their ASCII spelling.
LIGATURES = {
    "Œ": "OE",
    "œ": "oe",
    "Æ": "AE",
    "æ": "ae",
    "ß": "SS",
}

_SOURCE_PREFIX = re.compile(r"^[A-Z_]+[0-9]+\.")
_NUMERIC_NAME = re.compile(r"[0-9]+")


def _ascii(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def _join_words(text: str, separators: str) -> str:
    """Upper-case words between separators, stripped of other signs, joined by ``_``."""
    words = (re.sub("[^A-Z0-9]", "", word) for word in re.split(separators, text.upper()))
    return "_".join(word for word in words if word) or EMPTY_NAME


def normalize_name(raw: str | None) -> str:
    """ASCII upper-case name; letters without a decomposition (``Œ``) are dropped."""
    return _join_words(_ascii(raw or ""), r"[\s\-/._]+")


def normalize_name_prefixed(raw: str | None) -> str:
    """As ``normalize_name`` after removing a ``SHEET1.`` prefix; ligatures are spelled out.

    Only the plain space separates words here: other white space disappears.
    """
    text = _SOURCE_PREFIX.sub("", raw or "")
    for letter, spelled in LIGATURES.items():
        text = text.replace(letter, spelled)
    return _join_words(_ascii(text), r"[ \-/._]+")


def light_name(raw: str) -> str:
    """Spaces and dots become ``_``; nothing else changes."""
    return raw.strip().replace(" ", "_").replace(".", "_")


NAME_STYLES = {
    "ascii": normalize_name,
    "prefix_strip": normalize_name_prefixed,
    "light": light_name,
    "raw": lambda name: name or EMPTY_NAME,
}


def dedupe_names(names: Sequence[str], start: int = 1, pattern: str = "{}_{}") -> list[str]:
    """Make names unique, ignoring case: the 2nd occurrence gets suffix ``start``.

    A suffixed name never takes a name that some column already has.
    """
    taken = {name.casefold() for name in names}
    seen: set[str] = set()
    next_suffix: dict[str, int] = {}
    unique = []
    for name in names:
        key = name.casefold()
        if key in seen:
            suffix = next_suffix.get(key, start)
            while pattern.format(name, suffix).casefold() in taken:
                suffix += 1
            next_suffix[key] = suffix + 1
            name = pattern.format(name, suffix)
            taken.add(name.casefold())
        seen.add(key)
        unique.append(name)
    return unique


def clean_names(names: Iterable[str | None], style: str = "ascii", start: int = 1) -> list[str]:
    return dedupe_names([NAME_STYLES[style](name) for name in names], start=start)


# Standard column -> ordered patterns over normalised headers. The first
# standard column with a matching pattern wins.
STANDARD_COLUMNS = {
    "cle_unique": ["MATRICULE.*CODE.*ORGANISME", r"MATRICULE.*\|\|.*CODE"],
    "matricule": ["^MATRICULE$", "^MATRIC$"],
    "nom": ["^NOM$", "^NOM_PRENOM$", "^NOM_ET_PRENOM$"],
    "date_naissance": ["DATE.*NAISSANCE", "DATE_NAISS", "NAISSANCE"],
    "sexe": ["^SEXE$"],
    "situation_matrimoniale": ["SITUATION.*MATRIMONIALE", "STATUT.*MATRIMONIAL"],
    "nombre_enfant": ["NOMBRE.*ENFANT", "NBR.*ENFANT"],
    "situation": ["^SITUATION$", "SITUATION_ADMINISTRATIVE"],
    "date_debut_situation": ["DATE.*DEBUT.*SITUATION", "DATE_SITUATION"],
    "montant_brut": ["MONTANT_BRUT", "SALAIRE_BRUT", "REMUNERATION_BRUTE", "^BRUT$"],
    "montant_net": ["MONTANT_NET", "SALAIRE_NET", "REMUNERATION_NETTE", "^NET$"],
    "retenue_pension": ["RETENUE.*PENSION", "^PENSION$", "COTISATION.*PENSION"],
    "impot": ["^IMPOT$", "^IGR$", "IMPOT.*REVENU"],
    "charge_patronale": ["CHARGE.*PATRONALE", "CHARGES.*PATRONALES"],
    "organisme": ["^ORGANISME$", "MINISTERE", "DIRECTION"],
    "lieu_affectation": ["LIEU.*AFFECTATION", "^AFFECTATION$"],
    "service": ["^SERVICE$"],
    "emploi": ["^EMPLOI$", "^CORPS$", "CORPS.*EMPLOI"],
    "fonction": ["^FONCTION$"],
    "grade": ["CLASSE.*ECHELON", "CLASSE_ECHELON"],
    "statut_fonctionnaire": ["^GRADE$"],
    "poste": ["^POSTE$", "LIBELLE.*POSTE"],
    "prise_service": ["PRISE.*SERVICE", "DATE.*PRISE.*SERVICE"],
    "date_retraite": ["DATE.*RETRAITE"],
    "age_retraite": ["AGE.*RETRAITE"],
    "mois_annee": ["MOIS.*ANNEE", "^PERIODE$"],
}

# Provenance columns keep their own (lower-case) name and bypass the mapping.
PROVENANCE = ("PERIODE", "FICHIER_SOURCE")


def standard_name(
    raw: str,
    mapping: dict[str, list[str]] = STANDARD_COLUMNS,
    bypass: Iterable[str] = PROVENANCE,
) -> str:
    name = normalize_name_prefixed(raw)
    if name not in bypass:
        for standard, patterns in mapping.items():
            if re.search("|".join(f"(?:{p})" for p in patterns), name, re.IGNORECASE):
                return standard
    return name.lower()


def map_names(
    names: Sequence[str],
    mapping: dict[str, list[str]] = STANDARD_COLUMNS,
    bypass: Iterable[str] = PROVENANCE,
) -> list[tuple[str, str]]:
    """``(source, standard)`` pairs; a repeated standard name becomes ``name_dup2`` and so on."""
    bypass = tuple(bypass)
    standard = [standard_name(name, mapping, bypass) for name in names]
    return list(zip(names, dedupe_names(standard, start=2, pattern="{}_dup{}")))


def numeric_code_names(names: Iterable[str], whole: bool = True) -> list[str]:
    """Names made of digits (``whole``) or only starting with digits."""
    match = _NUMERIC_NAME.fullmatch if whole else _NUMERIC_NAME.match
    return [name for name in names if match(name)]


def existing(wanted: Iterable[str], columns: Iterable[str]) -> list[str]:
    """The wanted columns that are present, in the order asked for."""
    present = set(columns)
    return [name for name in wanted if name in present]
