"""The layer jobs: staging files -> Bronze -> Silver -> checks -> Gold, driven by plain settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.functions.casts import cast_code_columns, cast_columns
from stratiform.functions.names import STANDARD_COLUMNS
from stratiform.functions.text import normalize_category
from stratiform.operators import drift, quality
from stratiform.operators.cleaning import drop_duplicate_rows, drop_null_rows, first_per_key
from stratiform.operators.enrich import CodeLookup, enrich_codes
from stratiform.operators.gold import GoldSpec, headcount, headcount_by_sex, layer_counts, panel_summary, payroll_mass
from stratiform.operators.headers import map_columns, rename_map
from stratiform.operators.versions import VersionedDataset
from stratiform.session import checkpointed
from stratiform.sinks.files import write_csv, write_report
from stratiform.sinks.tables import ensure_database, overwrite_table, validate_table_name
from stratiform.sources.cells import error_report
from stratiform.sources.files import read_binary
from stratiform.sources.mixed import read_mixed_reported
from stratiform.sources.workbook import decoded, two_sheets_of, workbook_headers, workbook_preview
from stratiform.streaming.incremental import ingest_drifting, workbook_reader

AMOUNTS = ["montant_brut", "montant_net", "retenue_pension", "impot", "charge_patronale"]


def save(df: DataFrame, table: str, path: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    validate_table_name(table)
    ensure_database(df.sparkSession, table.split(".")[-2])
    return overwrite_table(df, table, path, partition_by)


def pre_analysis(spark: SparkSession, source: str, token: str = "matricule") -> dict[str, DataFrame]:
    """Reports on the monthly workbooks before ingestion, by file name.

    Only the first rows of each sheet are decoded; the headers are stored once for all reports.
    """
    files = read_binary(spark, source, "*.{xlsx,xls}")
    headers = checkpointed(workbook_headers(files, token))
    first = headers.filter("sheet_no = 1")
    return {
        "inventaire_fichiers": headers.groupBy("fichier", "sheet_no").agg(
            F.count(F.lit(1)).alias("nb_colonnes"),
            F.concat_ws("|", F.sort_array(F.collect_list(F.struct("position", "colonne")))["colonne"]).alias("colonnes"),
        ),
        "colonnes_uniques": drift.distinct_columns(headers),
        "colonnes_f1_uniques": drift.distinct_columns(first),
        "codes_f2_uniques": drift.numeric_code_columns(headers.filter("sheet_no = 2")),
        "stats_par_periode": drift.columns_per_sheet(headers),
        "stats_f1": drift.column_count_stats(first),
        "changements_f1": drift.schema_drift(first),
        "erreurs": error_report(workbook_preview(files)),
    }


def bronze_files(spark: SparkSession, source: str, table: str, errors: str | None = None, **options) -> DataFrame:
    """Files of any supported format, as text with provenance, in one write; files left out go to the table ``errors``."""
    rows, bad = read_mixed_reported(spark, source, **options)
    if errors:
        save(bad, errors)
    return save(rows, table)


def bronze_payroll(spark: SparkSession, source: str, table: str, errors: str | None = None) -> DataFrame:
    """Monthly two-sheet workbooks, the second sheet's codes joined to the agents; files left out go to ``errors``."""
    rows = decoded(read_binary(spark, source, "*.{xlsx,xls}"))
    if errors:
        save(error_report(rows), errors)
    return save(two_sheets_of(rows), table)


def bronze_payroll_new(
    spark: SparkSession, source: str, target: str, errors: str, state: str, files_per_batch: int = 12
) -> tuple[DataFrame, DataFrame]:
    """The workbooks that arrived since the last run, added to those at ``target``; bad ones are listed at ``errors``."""
    return ingest_drifting(spark, source, target, errors, state, workbook_reader(pairs=True), files_per_batch=files_per_batch)


@dataclass(frozen=True)
class SilverSpec:
    """Settings of a generic Bronze -> Silver step, applied in this order."""

    rename: Mapping[str, str] = field(default_factory=dict)
    doubles: Sequence[str] = ()
    ints: Sequence[str] = ()
    dates: Mapping[str, str] = field(default_factory=dict)
    decimal_comma: bool = False
    where: str | None = None
    key: Sequence[str] = ()
    key_order: Sequence[str] = ()


def silver(bronze: DataFrame, spec: SilverSpec) -> DataFrame:
    rows = cast_columns(rename_map(bronze, spec.rename), spec.doubles, spec.ints, spec.dates, spec.decimal_comma)
    if spec.where:
        rows = rows.filter(spec.where)
    return first_per_key(rows, spec.key, spec.key_order) if spec.key else rows


def silver_payroll(
    bronze: DataFrame,
    lookups: Sequence[CodeLookup] = (),
    mapping: Mapping[str, list[str]] = STANDARD_COLUMNS,
    kept: Sequence[str] = ("en_activite", "regul_indemnites", "demi_solde"),
    decimal_comma: bool = False,
) -> DataFrame:
    """Standard names, paid situations only, codes from the dictionaries, numeric amounts."""
    rows, _ = map_columns(bronze, mapping)
    if "situation" in rows.columns:
        rows = rows.withColumns(
            {"situation_brute": F.col("situation"), "situation_normalisee": normalize_category(F.col("situation"))}
        ).filter(F.col("situation_normalisee").isin(list(kept)))
    rows = enrich_codes(rows, lookups)
    return cast_code_columns(cast_columns(rows, doubles=AMOUNTS, decimal_comma=decimal_comma))


def validate(
    table: DataFrame, columns: Sequence[str], keys: Sequence[str], amounts: Sequence[str], category: str | None = None
) -> dict[str, DataFrame]:
    """Reports by file name; each is one scan and stays lazy until written."""
    reports = {
        "completude_colonnes_cles": quality.null_rate(table, columns),
        "doublons": quality.duplicate_keys_top(table, keys),
        "stats_colonnes_numeriques": quality.numeric_profile(table, amounts),
    }
    if category:
        reports["distribution"] = quality.distribution(table, category)
    return reports


def validate_payroll(
    table: DataFrame,
    columns: Sequence[str],
    watched: Sequence[str],
    agent: str = "matricule",
    period: str = "periode",
    category: str = "situation_normalisee",
    amounts: tuple[str, str] = ("montant_net", "montant_brut"),
) -> dict[str, DataFrame]:
    """The whole set of controls of a payroll table, by file name.

    Completeness of ``columns``; null rates by year of the ``watched`` columns, for those that are nearly empty in one year and
    nearly full in another; every agent and period found more than once; net above gross; distribution of the categories; and the
    extent of the table. A control whose columns the table lacks is left out.
    """
    found = set(table.columns)
    reports = {"completude_colonnes_cles": quality.completeness(table, columns)}
    if period in found:
        by_year = quality.null_rate_by_year(table, watched, period)
        suspect = quality.suspect_columns(table, watched, period).select("colonne")
        reports["na_par_annee_colonnes_surveillees"] = by_year.join(suspect, "colonne", "left_semi")
    if {agent, period} <= found:
        reports["doublons_matricule_periode"] = quality.duplicate_keys(table, [agent, period], [agent])
        reports["resume"] = panel_summary(table, agent, period)
    if set(amounts) <= found:
        reports["coherence_montants"] = quality.net_above_gross(table, *amounts)
    if category in found:
        reports["distribution"] = quality.distribution(table, category)
    return reports


def save_reports(reports: Mapping[str, DataFrame], folder: str) -> list[str]:
    return [name for name, report in reports.items() if write_report(report, f"{folder}/{name}")]


PAYROLL_GOLD = (
    GoldSpec("gold.masse_salariale", payroll_mass, "masse_salariale_par_periode_organisme"),
    GoldSpec("gold.effectifs", headcount_by_sex, "effectifs_par_periode"),
)

EXTRACT_GOLD = (
    GoldSpec(
        "gold.employes_par_organisme",
        lambda df: headcount(
            df, ["ORGANISME"], {"nb_emplois_distincts": "EMPLOI", "nb_grades_distincts": "GRADE"}
        ),
    ),
    GoldSpec("gold.employes_par_grade", lambda df: headcount(df, ["GRADE"], {"nb_organismes": "ORGANISME"})),
    GoldSpec(
        "gold.employes_par_service", lambda df: headcount(df, ["SERVICE", "ORGANISME"], {"nb_emplois": "EMPLOI"})
    ),
    GoldSpec("gold.employes_par_echelon", lambda df: headcount(df, ["CLASSE/ECHELON", "GRADE"])),
)


def gold(source: DataFrame, specs: Sequence[GoldSpec], export_folder: str | None = None) -> DataFrame:
    """Build and write every Gold table once; exports and counts read what was written."""
    written = {}
    for spec in specs:
        written[spec.table] = save(spec.build(source), spec.table)
        if export_folder and spec.csv:
            write_csv(written[spec.table], f"{export_folder}/{spec.csv}", sep=",")
    return layer_counts(written)


def publish_extract(dataset: VersionedDataset, bronze: DataFrame, checks=(), branch: str = "transform-silver") -> bool:
    """Clean an extract on a branch, audit it there, and show it on main only if it passes.

    A new data set begins with an empty main, so that what is audited first is not yet shown.
    """
    if not dataset.branches():
        dataset.commit(bronze.limit(0))
    dataset.create_branch(branch)
    dataset.commit(drop_null_rows(drop_duplicate_rows(bronze)), "overwrite", branch)
    published, _ = dataset.publish(branch, checks)
    return published
