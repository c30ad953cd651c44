"""Delimited text and Parquet readers, file listings and header probes."""

from __future__ import annotations

import codecs
import csv
import io
import sys
from collections.abc import Iterator, Sequence
from functools import partial, reduce
from itertools import dropwhile
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.functions.names import clean_names
from stratiform.functions.text import file_extension, file_name, metadata_path
from stratiform.operators.headers import add_provenance, union_all
from stratiform.session import checkpointed, ship_package
from stratiform.sources.cells import decode_files, table_of

#: Columns that Spark reads of a CSV file unless told otherwise.
SPARK_COLUMNS = 20_480


def list_files(spark: SparkSession, path: str | Sequence[str], extensions: Sequence[str] = ()) -> DataFrame:
    """``(path, fichier, extension, taille, modifie_le)`` of all files below a path.

    Only listing columns are read, so no file is opened.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path if isinstance(path, str) else list(path))
        .select(
            "path",
            file_name(F.col("path")).alias("fichier"),
            file_extension(F.col("path")).alias("extension"),
            F.col("length").alias("taille"),
            F.col("modificationTime").alias("modifie_le"),
        )
    )
    return files.filter(F.col("extension").isin([e.lower() for e in extensions])) if extensions else files


def read_binary(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """``(path, content)`` of whole files, for the decoders that run in executors."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content")


def read_parquet(spark: SparkSession, *paths: str, merge: bool = False) -> DataFrame:
    """A file, or a partitioned folder; ``merge`` unites the columns of files that differ."""
    return spark.read.option("mergeSchema", str(merge).lower()).parquet(*paths)


def _open(path: str):
    """The file behind a path as Spark names it, for reading a few bytes of it."""
    from pyarrow import fs

    scheme, separator, rest = path.partition(":")
    if not separator or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + (rest or scheme).lstrip("/"))
    system, name = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{quote(rest, safe='/:@')}")
    return system.open_input_file(name)


def _records(text, sep: str) -> Iterator[list[str]]:
    """Records of a text stream without its byte order mark; blank lines are none."""
    csv.field_size_limit(sys.maxsize)
    lines = (line if i else line.lstrip("\ufeff") for i, line in enumerate(text))
    return (record for record in csv.reader(lines, delimiter=sep) if record)


def _header(stream, sep: str, encoding: str) -> tuple[list[str], bool]:
    """The first record of a text file with a filled cell, read on until it ends, and whether it is the very first."""
    first = True
    for record in _records(io.TextIOWrapper(stream, encoding, "replace", newline=""), sep):
        if "".join(record).strip():
            return record, first
        first = False
    return [], True


_PROBED = (
    "path string, extension string, noms array<string>, types array<string>, lignes bigint, en_tete boolean, erreur string"
)


def _probe(sep: str, encoding: str):
    """Reads the Parquet footer, or the first records of a text file: never the data."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for files in batches:
            found = []
            for path, extension in zip(files["path"], files["extension"]):
                names, types, rows, first, error = None, None, None, None, None
                try:
                    with _open(path) as stream:
                        if extension == "parquet":
                            footer = pq.ParquetFile(stream)
                            names, rows = footer.schema_arrow.names, footer.metadata.num_rows
                            types = [str(kind) for kind in footer.schema_arrow.types]
                        else:
                            names, first = _header(stream, sep, encoding)
                            error = None if names else "no header: the file has no filled record"
                except Exception as problem:  # a bad file is reported, not fatal
                    error = f"{type(problem).__name__}: {problem}"
                found.append((path, extension, names, types, rows, first, error))
            columns = [c.split()[0] for c in _PROBED.split(", ")]
            yield pd.DataFrame(found, columns=columns).astype({"lignes": "Int64", "en_tete": "boolean"})

    return probe


def probe_headers(spark: SparkSession, path: str | Sequence[str], sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """``(path, extension, noms, types, lignes, en_tete, erreur)`` of each Parquet or CSV file below a path.

    ``types`` and ``lignes`` are those of a Parquet footer; ``en_tete`` says whether a CSV file begins with its header,
    and not with a record of empty cells.
    """
    return probe_files(list_files(spark, path, ["parquet", "csv"]).filter("taille > 0"), sep, encoding)


def probe_files(files: DataFrame, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """``probe_headers`` of files that are listed already, as ``(path, extension)``."""
    ship_package(files.sparkSession)
    return files.select("path", "extension").mapInPandas(_probe(sep, encoding), _PROBED)


def file_errors(
    spark: SparkSession, path: str | Sequence[str], sep: str = ",", encoding: str = "utf-8", probed: DataFrame | None = None
) -> DataFrame:
    """``(path, error)`` of the Parquet and CSV files whose header could not be read; ``probed``: their headers, if known."""
    probed = probe_headers(spark, path, sep, encoding) if probed is None else probed
    return probed.where("erreur IS NOT NULL").select("path", F.col("erreur").alias("error"))


def _text_reader(spark: SparkSession, sep: str, encoding: str, multiline: bool):
    return (
        spark.read.option("header", "true")
        .option("sep", sep)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", str(multiline).lower())
    )


def _as_listed(path):
    """A path as the listing spells it."""
    return F.regexp_replace(path, "^file:///", "file:/")


def _with_line_breaks(spark: SparkSession, path: str | Sequence[str], encoding: str) -> DataFrame:
    """``path`` of the CSV files that may hold line breaks inside quotes: those with a line of oddly many quotes.

    One pass over the text, in splits. Encodings of more than one byte a sign say nothing by lines, so all their files count.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path if isinstance(path, str) else list(path))
    rows = text.select(_as_listed(metadata_path()).alias("path"), "value")
    if not codecs.lookup(encoding).name.startswith(("utf-16", "utf-32")):
        rows = rows.where((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1)
    return rows.select("path").distinct()


def _layouts(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str,
    encoding: str,
    multiline: bool | None,
    probed: DataFrame | None = None,
) -> list:
    """The CSV files of each distinct header, apart by how they must be read.

    ``sauts``: line breaks inside quotes, so that a file is read whole. ``en_tete`` false: records of empty cells come
    before the header, which Spark would take for it.
    """
    probed = probe_headers(spark, path, sep, encoding) if probed is None else probed
    probed = probed.filter("extension = 'csv' AND erreur IS NULL")
    if multiline is None:
        broken = _with_line_breaks(spark, path, encoding).withColumn("sauts", F.lit(True))
        probed = probed.join(broken, "path", "left").withColumn("sauts", F.coalesce("sauts", F.lit(False)))
    else:
        probed = probed.withColumn("sauts", F.lit(multiline))
    files = probed.groupBy("noms", "sauts", "en_tete").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return sorted(files.collect(), key=lambda layout: layout.paths)


def decode_csv(content: bytes, sep: str = ",", encoding: str = "utf-8") -> Iterator[tuple]:
    """A CSV file as the rows of one sheet, from the first record with a filled cell on; empty cells are None."""
    text = io.TextIOWrapper(io.BytesIO(content), encoding, "replace", newline="")
    records = dropwhile(lambda record: not "".join(record).strip(), _records(text, sep))
    for number, record in enumerate(records, 1):
        yield "", 1, number, [cell or None for cell in record]


def _csv_cells(spark: SparkSession, paths: Sequence[str], sep: str, encoding: str) -> DataFrame:
    """Cell rows of CSV files whose header stands below records of empty cells; each is decoded by one task."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return checkpointed(decode_files(files, partial(decode_csv, sep=sep, encoding=encoding)))


def _csv_frame(spark: SparkSession, layout, sep: str, encoding: str) -> DataFrame:
    """The data rows of a layout that begins with its header, columns by position: names may repeat."""
    raw = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(len(layout.noms), 1))])
    reader = _text_reader(spark, sep, encoding, layout.sauts).option("maxColumns", SPARK_COLUMNS + len(layout.noms))
    return reader.schema(raw).csv(layout.paths)


def read_csv_strings(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = ",",
    encoding: str = "utf-8",
    style: str | None = None,
    provenance: bool = False,
    multiline: bool | None = None,
    probed: DataFrame | None = None,
) -> DataFrame:
    """Every CSV file below a path as text columns, united by name.

    Files are read once per distinct header, so months with other columns never shift
    values. ``style`` also cleans the names; ``provenance`` adds the file and its stem.
    Line breaks inside quotes belong to their cell; files that may hold some are found first (``multiline`` None)
    and read whole, the others in splits. Records of empty cells above the header are no data.
    Cells beyond the header have no column: ``surplus_cells`` counts them, and ``file_errors`` lists the files left out.
    ``probed`` holds the headers of a bounded batch of files, if they are known.
    """
    frames = []
    for layout in _layouts(spark, path, sep, encoding, multiline, probed):
        if not layout.en_tete:
            rows = _csv_cells(spark, layout.paths, sep, encoding)
            few = probed is not None
            frames.append(table_of(rows, rows, 1, style or "raw", token=None, provenance=provenance, few=few))
            continue
        # Names only become final after cleaning: positions keep duplicates apart.
        frame = _csv_frame(spark, layout, sep, encoding)
        names = clean_names(layout.noms, style) if style else layout.noms
        if provenance:
            frame = add_provenance(frame)
            names = [*names, "PERIODE", "FICHIER_SOURCE"]
        frames.append(frame.toDF(*names))
    if not frames:
        raise FileNotFoundError(f"no readable CSV file below {path}")
    return union_all(frames)


def surplus_cells(
    spark: SparkSession, path: str | Sequence[str], sep: str = ",", encoding: str = "utf-8", multiline: bool | None = None
) -> DataFrame:
    """``(path, lignes, cellules)`` of the CSV files with filled cells beyond their header: such rows, and such cells."""

    def beyond(columns: int):
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                records = (next(_records(io.StringIO(text, newline=""), sep), []) for text in rows["_record"])
                rows["cellules"] = [sum(cell != "" for cell in record[columns:]) for record in records]
                yield rows[["path", "cellules"]]

        return count

    frames = []
    for layout in _layouts(spark, path, sep, encoding, multiline):
        columns = len(layout.noms)
        if not layout.en_tete:
            over = F.filter(F.slice("cells", columns + 1, F.greatest(F.size("cells"), F.lit(1))), lambda c: c.isNotNull())
            rows = _csv_cells(spark, layout.paths, sep, encoding).where("error IS NULL")
            frames.append(rows.select("path", F.size(over).cast("long").alias("cellules")))
            continue
        raw = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(columns, 1))]).add("_record", "string")
        # Spark marks the rows whose cells don't match the columns; only those are taken apart again.
        reader = _text_reader(spark, sep, encoding, layout.sauts).option("maxColumns", SPARK_COLUMNS + columns)
        rows = reader.option("columnPruning", "false").option("columnNameOfCorruptRecord", "_record").schema(raw).csv(layout.paths)
        odd = rows.select(metadata_path().alias("path"), "_record", *raw.names[:1]).where("_record IS NOT NULL")
        frames.append(odd.mapInPandas(beyond(columns), "path string, cellules bigint"))
    if not frames:
        return spark.createDataFrame([], "path string, lignes bigint, cellules bigint")
    found = reduce(DataFrame.unionAll, frames).where("cellules > 0")
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("lignes"), F.sum("cellules").alias("cellules"))


def read_parquet_strings(
    spark: SparkSession,
    path: str | Sequence[str],
    style: str,
    sep: str = ",",
    encoding: str = "utf-8",
    provenance: bool = True,
    probed: DataFrame | None = None,
) -> DataFrame:
    """Every Parquet file below a path as text columns, united by cleaned name.

    Files are read once per distinct schema, so a column whose type, spelling or place changes between files keeps its
    values. Damaged files are left out; ``file_errors`` lists them. ``probed``: their headers, if known.
    """
    probed = probe_headers(spark, path, sep, encoding) if probed is None else probed
    probed = probed.filter("extension = 'parquet' AND erreur IS NULL")
    layouts = probed.groupBy("noms", "types").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    frames = []
    for layout in sorted(layouts.collect(), key=lambda layout: layout.paths):
        rows = spark.read.parquet(*layout.paths)
        texts = [
            F.col(f"`{old}`").cast("string").alias(new) for old, new in zip(rows.columns, clean_names(rows.columns, style))
        ]
        with_origin = add_provenance(rows).select(*texts, "PERIODE", "FICHIER_SOURCE") if provenance else rows.select(*texts)
        frames.append(with_origin)
    if not frames:
        raise FileNotFoundError(f"no readable Parquet file below {path}")
    return union_all(frames)


def read_csv_inferred(
    spark: SparkSession, path: str, sep: str = ";", encoding: str = "utf-8", multiline: bool = False
) -> DataFrame:
    """CSV with types guessed from the data; this reads the files twice."""
    return _text_reader(spark, sep, encoding, multiline).option("inferSchema", "true").csv(path)


def file_inventory(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """``(fichier, cle, nb_lignes, nb_colonnes, colonnes)`` of each Parquet or CSV file."""
    probed = checkpointed(probe_headers(spark, path, sep, encoding).filter("erreur IS NULL"))
    counts = [probed.where("lignes IS NOT NULL").select("path", "lignes")]
    for layout in _layouts(spark, path, sep, encoding, None):
        if layout.en_tete:
            # One column is enough to count records.
            origin = _csv_frame(spark, layout, sep, encoding).select(_as_listed(metadata_path()).alias("path"))
        else:
            origin = _csv_cells(spark, layout.paths, sep, encoding).where("error IS NULL")
            filled = F.exists("cells", lambda c: c.isNotNull())
            first = origin.groupBy("path").agg(F.min(F.when(filled, F.col("row_no"))).alias("header_row"))
            origin = origin.join(first, "path").where("row_no > header_row").select("path")
        counts.append(origin.groupBy("path").agg(F.count(F.lit(1)).alias("lignes")))
    counts = reduce(DataFrame.unionAll, counts)
    return probed.drop("lignes").join(counts, "path", "left").select(
        file_name(F.col("path")).alias("fichier"),
        F.col("path").alias("cle"),
        F.coalesce("lignes", F.lit(0)).alias("nb_lignes"),
        F.size("noms").cast("long").alias("nb_colonnes"),
        F.concat_ws("|", "noms").alias("colonnes"),
    )
