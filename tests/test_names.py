import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from stratiform.functions import names


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("Montant Brut", "MONTANT_BRUT"),
        ("  date.naissance ", "DATE_NAISSANCE"),
        ("Classe/Échelon", "CLASSE_ECHELON"),
        ("N°--Matricule__1", "N_MATRICULE_1"),
        ("Œuvre N°", "UVRE_N"),
        ("Straße", "STRAE"),
        ("a\tb\nc", "A_B_C"),
        ("§", names.EMPTY_NAME),
        ("", names.EMPTY_NAME),
        (None, names.EMPTY_NAME),
    ],
)
def test_normalize_name(raw, clean):
    assert names.normalize_name(raw) == clean


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("FEUILLE1.Montant net", "MONTANT_NET"),
        ("A_B12.x", "X"),
        ("feuille1.x", "FEUILLE1_X"),
        ("Œuvre N°", "OEUVRE_N"),
        ("a\tb", "AB"),
        ("MATRICULE||CODE_ORGANISME", "MATRICULECODE_ORGANISME"),
        (None, names.EMPTY_NAME),
    ],
)
def test_normalize_name_prefixed(raw, clean):
    assert names.normalize_name_prefixed(raw) == clean


def test_light_name():
    assert names.light_name(" Date de.prise ") == "Date_de_prise"


@given(st.text(max_size=30))
def test_normal_names_stay_as_they_are(raw):
    once = names.normalize_name(raw)
    assert names.normalize_name(once) in (once, names.EMPTY_NAME) or once == names.EMPTY_NAME
    assert once == names.EMPTY_NAME or re.fullmatch("[A-Z0-9]+(_[A-Z0-9]+)*", once)


@given(st.lists(st.sampled_from(["X", "x", "X_1", "X_2", "Y", "Y_1"]), max_size=12))
def test_dedupe_is_unique_and_keeps_first_names(raw):
    out = names.dedupe_names(raw)
    assert len(out) == len(raw)
    assert len({name.casefold() for name in out}) == len(out)
    for i, name in enumerate(raw):
        if name.casefold() not in {r.casefold() for r in raw[:i]}:
            assert out[i] == name


def test_dedupe_suffixes():
    assert names.dedupe_names(["A", "A", "A"]) == ["A", "A_1", "A_2"]
    assert names.dedupe_names(["A", "A", "A"], start=2) == ["A", "A_2", "A_3"]
    assert names.dedupe_names(["A", "A_1", "A"]) == ["A", "A_1", "A_2"]
    assert names.dedupe_names(["a", "a"], start=2, pattern="{}_dup{}") == ["a", "a_dup2"]


@pytest.mark.parametrize("raw", ["MONTANT BRUT", "SALAIRE BRUT", "REMUNERATION BRUTE", "Brut", "Rémunération-brute"])
def test_gross_pay_spellings(raw):
    assert names.standard_name(raw) == "montant_brut"


@pytest.mark.parametrize(
    "raw, standard",
    [
        ("LIEU_NAISSANCE", "date_naissance"),
        ("Grade", "statut_fonctionnaire"),
        ("Classe/Échelon", "grade"),
        ("MOIS ANNEE", "mois_annee"),
        ("PERIODE", "periode"),
        ("FICHIER_SOURCE", "fichier_source"),
        ("Code Organisme", "code_organisme"),
        ("MATRICULE||CODE_ORGANISME", "cle_unique"),
        ("Libellé inconnu", "libelle_inconnu"),
    ],
)
def test_standard_names(raw, standard):
    assert names.standard_name(raw) == standard


def test_repeated_standard_names():
    pairs = names.map_names(["MONTANT_BRUT", "MONTANT_BRUT_F2", "Nom"])
    assert pairs == [("MONTANT_BRUT", "montant_brut"), ("MONTANT_BRUT_F2", "montant_brut_dup2"), ("Nom", "nom")]
    assert len(names.STANDARD_COLUMNS) == 26


def test_numeric_codes_and_existing():
    assert names.numeric_code_names(["101", "101_F2", "A1"]) == ["101"]
    assert names.numeric_code_names(["101", "101_F2", "A1"], whole=False) == ["101", "101_F2"]
    assert names.existing(["b", "z", "a"], ["a", "b"]) == ["b", "a"]
