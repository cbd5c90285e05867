"""File sources and sinks: S1 latest dated CSV, S2 metadata CSV, S3 upload CSV, S7 snapshot export.

Uploads and metadata are read as lines in as many tasks as the files have splits, cut into records (quoted line breaks
included) and parsed by ``from_csv`` with an all-string schema; file listing uses the ``binaryFile`` source with only the
``path`` column selected, so no file content is read to pick a file.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapforge.constants import KEY_COL, READ_NULL_TOKENS, VERSION_COL
from snapforge.functions.names import _normalize_name_py
from snapforge.functions.text import null_tokens
from snapforge.operators.keys import assign_row_keys
from snapforge.session import ship_package

# RFC 4180: a quote within a quoted cell is doubled, and a quoted cell may hold line breaks
QUOTING = {"quote": '"', "escape": '"'}
# the writer keeps leading/trailing blanks (Spark trims them by default) and quotes cells with line breaks
WRITE_OPTIONS = {**QUOTING, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


FILE_ORDER = ["__sf_file", "__sf_place"]


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Column labels of a CSV with a header (reads one line)."""
    first = spark.read.options(sep=sep, header="false", multiLine="true", **QUOTING).csv(path).limit(1).collect()
    if not first:
        raise ValueError(f"empty CSV: {path}")
    return [c if c is not None else f"_c{i}" for i, c in enumerate(first[0])]


def read_text_csv(
    spark: SparkSession, path: str, sep: str = ";", columns: Sequence[str] | None = None, in_order: bool = False
) -> DataFrame:
    """Header CSV (RFC 4180) with every column as string and no schema inference, each split of a file read by a task of its own.

    A row with more cells than the header fails the read. ``in_order`` adds the columns of
    ``FILE_ORDER``: the file, and a number that grows within it. Records end at line feeds (a carriage return before
    one is dropped) outside quoted cells; empty lines are no records.
    """
    cols = list(columns) if columns is not None else _header(spark, path, sep)
    bad, cells = "__corrupt", [f"c{i}" for i in range(len(cols))]
    schema = ", ".join(f"{c} string" for c in [*cells, bad])
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, **QUOTING}
    # the first record of each file is its header
    found = csv_records(spark, path, sep).where("place > 0").select("file", "place", F.from_csv("record", schema, options).alias("r"))
    df = found.select("r.*", F.col("file").alias(FILE_ORDER[0]), F.col("place").alias(FILE_ORDER[1]))
    # a short row (its missing cells are null) is also marked, but only cells beyond the header would be lost
    surplus = F.col(bad).isNotNull() & F.col(cells[-1]).isNotNull()
    last = F.when(surplus, F.raise_error(F.concat(F.lit("more cells than the header: "), F.col(bad)))).otherwise(F.col(cells[-1]))
    kept = [*[F.col(c).alias(name) for c, name in zip(cells[:-1], cols[:-1], strict=True)], last.cast("string").alias(cols[-1])]
    return df.select(*kept, *(FILE_ORDER if in_order else []))


def csv_records(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """(file, place, record): the records of CSV files, quoted line breaks and all, in many tasks.

    Files are read as lines, by split. Whether a split begins inside a quoted cell depends on all that is before it, so each split is
    first walked for both cases, and the two outcomes of the splits of a file are chained (a few bytes a split). Knowing
    how it begins, each split then cuts its own records; only a record that goes over a split's end is put together
    from its pieces. ``place`` is 0 for a file's first record and grows within the file."""
    ship_package(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line")
    )
    walk = _Walk(sep)

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[str, int], tuple[bool, bool]] = {}  # a row a split
        for split, some in _lines(batches):
            out, inside = rows.get(split, (False, True))
            for line in some:
                if b'"' in line:
                    out, inside = walk(line, out), walk(line, inside)
            rows[split] = out, inside
        cols = [[f for f, _ in rows], [b for _, b in rows], [o for o, _ in rows.values()], [i for _, i in rows.values()]]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file", "block", "after_out", "after_in"])

    ends = lines.mapInArrow(outcomes, "file string, block long, after_out boolean, after_in boolean")
    # a split ends as it began, or the other way round, or in one way however it began; after the last one of
    # the third kind it is the number of turns that tells
    fixed, turns = F.col("after_out") == F.col("after_in"), F.col("after_out") & ~F.col("after_in")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = ends.withColumns({
        "set": F.coalesce(F.last(F.when(fixed, F.col("after_out")), True).over(before), F.lit(False)),
        "since": F.coalesce(F.sum(fixed.cast("int")).over(before), F.lit(0)), "turn": turns.cast("int"),
    })
    counted = Window.partitionBy("file", "since").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = known.select("file", "block", (F.col("set") != (F.coalesce(F.sum("turn").over(counted), F.lit(0)) % 2 == 1)).alias("inside"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut(batches, walk)

    schema = "file string, block long, place long, piece int, text binary"
    pieces = lines.join(F.broadcast(begins), ["file", "block"]).mapInArrow(cut, schema)  # a row a split
    whole = pieces.where("piece = 0").select("file", "place", "text")
    # an open record and the pieces in the splits behind it
    order = Window.partitionBy("file").orderBy("block", "piece").rowsBetween(Window.unboundedPreceding, 0)
    parts = pieces.where("piece <> 0").withColumn("place", F.last("place", True).over(order))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"].cast("string"))
    put = parts.groupBy("file", "place").agg(F.array_join(joined, "\n").cast("binary").alias("text"))
    text = F.regexp_replace(F.col("text").cast("string"), "\r$", "")
    return whole.unionByName(put).select("file", "place", text.alias("record")).where("record <> ''")


class _Walk:
    """Whether a line ends inside a quoted cell, given whether it begins in one."""

    def __init__(self, sep: str) -> None:
        s = re.escape(sep.encode())
        cell = b'(?:"[^"]*(?:""[^"]*)*+"(?!")(?:(?!' + s + b")[\\s\\S])*+|(?!\")(?:(?!" + s + b")[\\s\\S])*+)"
        self.cells = re.compile(cell + b"(?:" + s + cell + b")*+")
        self.close = re.compile(b'[^"]*(?:""[^"]*)*+"(?!")')
        self.rest = re.compile(b"(?:(?!" + s + b")[\\s\\S])*+(?:" + s + cell + b")*+")

    def __call__(self, line: bytes, inside: bool) -> bool:
        if b'"' not in line:
            return inside
        if not inside:
            return self.cells.fullmatch(line) is None
        end = self.close.match(line)
        return end is None or self.rest.fullmatch(line, end.end()) is None


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """((file, block), lines) of neighbouring rows of one split."""
    for batch in batches:
        files, blocks, lines = (batch.column(c).to_pylist() for c in ("file", "block", "line"))
        for split, some in itertools.groupby(zip(files, blocks, lines, strict=True), key=lambda r: r[:2]):
            yield split, [line for _, _, line in some]


def _cut(batches: Iterator[pa.RecordBatch], walk: _Walk) -> Iterator[pa.RecordBatch]:
    """Rows (file, block, place, piece, text): whole records (piece 0), the beginning of one that the split doesn't end (2), and
    what the split has of a record from before it (1, place null). A record's place is its split's offset and the number of its first line in it."""
    rows: list[tuple] = []
    now, inside, open_, number, place = None, False, [], 0, None

    def batch() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file", "block", "place", "piece", "text"])

    def leave() -> None:
        if open_:
            rows.append((*now, place, 1 if place is None else 2, b"\n".join(open_)))
            open_.clear()

    for one in batches:
        columns = (one.column(c).to_pylist() for c in ("file", "block", "line", "inside"))
        for file, block, line, begins in zip(*columns, strict=True):
            if (file, block) != now:
                leave()
                now, inside, number, place = (file, block), begins, 0, None
            elif not open_:
                place = None
            if not open_ and not inside:
                place = block + number
            open_.append(line)
            number += 1
            inside = walk(line, inside)
            if not inside:
                rows.append((file, block, place, 1 if place is None else 0, b"\n".join(open_)))
                open_.clear()
        yield batch()
    leave()
    yield batch()


def write_text_csv(df: DataFrame, path: str, sep: str = ";", single_file: bool = False, mode: str = "errorifexists") -> None:
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).options(sep=sep, header="true", **WRITE_OPTIONS).csv(path)


# --- S1 ---------------------------------------------------------------------------
def latest_dated_path(spark: SparkSession, base_dir: str, prefix: str) -> str:
    """S1 (choice): of ``{prefix}_YYYYMMDD.csv`` files or folders under ``base_dir``, the one
    with the greatest valid date; invalid dates are skipped; error when none is valid.
    Only the chosen path (one row) comes back to the driver."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base_dir).select("path")
    )
    pattern = "(.*/\\Q" + prefix + "\\E_(\\d{8})\\.csv)(/|$)"
    named = listing.select(
        F.regexp_extract("path", pattern, 1).alias("target"),
        F.try_to_date(F.regexp_extract("path", pattern, 2), "yyyyMMdd").alias("d"),
    ).where((F.col("target") != "") & F.col("d").isNotNull())
    best = named.orderBy(F.col("d").desc(), F.col("target").desc()).select("target").limit(1).collect()
    if not best:
        raise FileNotFoundError(f"no {prefix}_YYYYMMDD.csv with a real date below {base_dir}")
    return best[0][0]


def read_latest_dated_csv(spark: SparkSession, base_dir: str, prefix: str, sep: str = ";") -> DataFrame:
    """Read the latest dated CSV as all-string columns."""
    return read_text_csv(spark, latest_dated_path(spark, base_dir, prefix), sep)


# --- S2 ---------------------------------------------------------------------------
def read_metadata(spark: SparkSession, path: str, sep: str = ";", with_pos: bool = False) -> DataFrame:
    """Metadata / config CSV: header, ``;``, all strings. ``with_pos`` adds the row
    position (file order) used for "metadata order"."""
    if not with_pos:
        return read_text_csv(spark, path, sep)
    rows = read_text_csv(spark, path, sep, in_order=True)
    return assign_row_keys(rows, start=1, order=FILE_ORDER, key_col="pos", first=False).drop(*FILE_ORDER)


# --- S3 ---------------------------------------------------------------------------
def read_upload(
    spark: SparkSession, path: str, sep: str = ";", tokens: Sequence[str] = READ_NULL_TOKENS, row_col: str = "__ROW"
) -> DataFrame:
    """S3: an uploaded CSV as all-string columns: null tokens applied, column labels
    normalised (spaces -> ``_``, lower-case; audit names kept), rows numbered 1..n in ``row_col``
    by file name and place in the file."""
    raw = read_text_csv(spark, path, sep, in_order=True)
    names = [_normalize_name_py(c, upload=True) for c in raw.columns[:-2]]
    cells = [null_tokens(F.col(f"`{c}`"), tokens).alias(n) for c, n in zip(raw.columns, names)]
    rows = assign_row_keys(raw.select(*cells, *FILE_ORDER), start=1, order=FILE_ORDER, key_col=row_col, first=False)
    return rows.drop(*FILE_ORDER)


# --- S7 ---------------------------------------------------------------------------
def export_snapshot_csv(
    snapshot: DataFrame, base_dir: str, table: str, sep: str = ";", single_file: bool = False
) -> str:
    """Write the snapshot without ``__KEY`` as ``{table}_version_{v}.csv`` (header, UTF-8).
    Returns the written path; only the version number reaches the driver."""
    v = snapshot.agg(F.max(VERSION_COL)).first()[0]
    path = f"{base_dir.rstrip('/')}/{table}_version_{v}.csv"
    write_text_csv(snapshot.drop(KEY_COL), path, sep, single_file=single_file)
    return path
