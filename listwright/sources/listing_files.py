"""Listing files of any header, read as one table.

The list of files is itself a table (path and length, from Spark's file source,
batch or stream). It is cut into byte ranges, and each task reads its ranges: the
file's own header first, then the range's lines, so a file of any size spreads
over many tasks and neither paths nor headers pass through the driver. Rows come
back as Arrow batches under the names asked for.

With ``isolate`` a file that cannot be read costs its own rows only: what went
wrong is a row of its own (``error``), and :func:`split_errors` takes the file's
other rows out, whichever task read them.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.config import COLUMN_ORDER, HEADER_SYNONYMS, NA_VALUES
from listwright.session import materialize

RANGE_BYTES = 1 << 26
READ_BYTES = 1 << 22
ROWS_OUT = 10_000
FIELDS_OUT = 2_000_000  # of a batch of wide rows
# A header is looked for this far, and a line that is longer is no line.
HEADER_LIMIT = 1 << 26

ORDINAL = T.StructType([T.StructField("block", T.LongType()), T.StructField("line", T.LongType())])
ERROR = T.StructType([T.StructField("stage", T.StringType()), T.StructField("message", T.StringType())])
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_uri(path: Column) -> Column:
    """A path in the spelling that ``_metadata.file_path`` has."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def listing_files(spark: SparkSession, folder: str, glob: str, processed: DataFrame | list[str] | None = None) -> DataFrame:
    """``path, length`` of the files of a folder without those ``processed`` (``source_file``) before. Contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
        .select(file_uri(F.col("path")).alias("path"), "length")
    )
    if processed is None:
        return files
    done = processed if isinstance(processed, DataFrame) else spark.createDataFrame([(x,) for x in processed], "source_file string")
    return files.join(done.select(file_uri(F.col("source_file")).alias("path")).distinct(), "path", "left_anti")


def file_stream(spark: SparkSession, folder: str, glob: str, files_per_batch: int) -> DataFrame:
    """``path, length`` of files as they arrive; the file source's checkpoint knows which were read."""
    return (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", str(files_per_batch))
        .load(folder).select(file_uri(F.col("path")).alias("path"), "length")
    )


def canonical_names(names: list[str]) -> list[str]:
    """The column that each field of a header belongs to."""
    plain = [x.strip().lower() for x in names]
    return [HEADER_SYNONYMS.get(x, x) for x in plain]


def numbered_names(names: list[str]) -> list[str]:
    """The names as written; one that comes again gets a number, so no column is lost."""
    seen: dict[str, int] = {}
    out = []
    for x in names:
        out.append(f"{x}.{seen[x]}" if x in seen else x)
        seen[x] = seen.get(x, 0) + 1
    return out


NAMING = {"canonical": canonical_names, "written": numbered_names}


def arrow_uri(path: str) -> str:
    """A path as Spark lists it, in the spelling Arrow file systems take."""
    scheme, rest = path.split(":", 1)
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    return f"{scheme}:{rest if rest.startswith('//') else '//' + rest}"


class Broken(Exception):
    """A file that cannot be read; ``stage`` says where."""

    def __init__(self, stage: str, message: str):
        super().__init__(f"{stage}: {message}")
        self.stage, self.message = stage, message


_LINE_END = re.compile(rb"\r\n|\r|\n")
_QUOTE_OR_END = re.compile(rb'["\r\n]')


def first_record(read, step: int = 65_536, limit: int = HEADER_LIMIT) -> tuple[bytes, int]:
    """A file's header and where its lines begin; ``read(n)`` gives the next bytes."""
    data, at, quoted = b"", 0, False
    while True:
        more = read(step)
        data += more
        for m in _QUOTE_OR_END.finditer(data, at):
            if m.group() == b'"':
                quoted = not quoted
            elif not quoted:
                if m.group() == b"\r" and m.end() == len(data):
                    data += read(1)
                return data[: m.start()], m.end() + (data[m.start() : m.end() + 1] == b"\r\n")
        at = len(data)
        if not more:
            return data, at
        if at > limit:
            raise Broken("header", f"no end of the header within {limit} bytes")


def lines_between(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and text of the lines that begin in ``[start, end)``; the last one may end behind it."""
    at = max(0, start - 1)
    stream.seek(at)
    data, more = b"", True
    # The line that the range begins within belongs to the one before.
    skip = start > 0
    while more or data:
        got = stream.read(READ_BYTES) if more else b""
        more = len(got) > 0
        data += got
        done = 0
        for m in _LINE_END.finditer(data):
            # An end at the end of what was read may be half of a pair.
            if more and m.end() == len(data) and m.group() == b"\r":
                break
            if skip:
                skip = False
            elif at + done >= end:
                return
            else:
                yield at + done, data[done : m.start()]
            done = m.end()
        data, at = data[done:], at + done
        if at >= end and not skip:
            return
        if len(data) > HEADER_LIMIT:
            raise Broken("read", f"a line of more than {HEADER_LIMIT} bytes")
        if not more:
            if data and not skip and at < end:
                yield at, data
            return


def records_of(stream, start: int, end: int, strict: bool) -> Iterator[tuple[int, list[str]]]:
    """Place and fields of the lines of a range; lines without text are left out."""
    for at, line in lines_between(stream, start, end):
        if strict and b"\0" in line:
            raise Broken("read", f"not a text file: a zero byte in the line at {at}")
        try:
            text = line.decode("utf-8", "strict" if strict else "replace")
        except UnicodeDecodeError as e:
            raise Broken("read", f"not UTF-8: {e.reason} in the line at {at}") from None
        if not text.strip():
            continue
        if strict and line.count(b'"') % 2:
            raise Broken("read", f"a quote that is not closed in the line at {at}")
        yield at, next(csv.reader([text]), [])


def long_records(stream, start: int) -> Iterator[tuple[int, list[str]]]:
    """Fields of the records of a whole file, which may hold line breaks within quotes."""
    import io

    stream.seek(start)
    text = io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="")
    for k, fields in enumerate(csv.reader(text)):
        if any(x.strip() for x in fields) or len(fields) > 1:
            yield k, fields


def header_of(stream, strict: bool = False) -> tuple[list[str], int]:
    """Names in a file's header and where its lines begin."""
    csv.field_size_limit(HEADER_LIMIT)
    raw, begin = first_record(stream.read)
    try:
        text = raw.decode("utf-8-sig", "strict" if strict else "replace")
    except UnicodeDecodeError as e:
        raise Broken("header", f"not UTF-8: {e.reason}") from None
    if strict and ("\0" in text or not text.strip()):
        raise Broken("header", "not a text file" if "\0" in text else "no header")
    return next(csv.reader(text.splitlines(keepends=True)), []), begin


def batch_rows(width: int) -> int:
    """Rows that a task holds at a time: fewer of a wide header, as each field takes a place."""
    return max(1, min(ROWS_OUT, FIELDS_OUT // max(1, width)))


KNOWN = frozenset([*HEADER_SYNONYMS.values(), *COLUMN_ORDER])


def scan(
    files: DataFrame, columns: list[str], naming: str = "canonical", na_values: list[str] = NA_VALUES, multi_line: bool = False,
    on_bad_lines: str = "skip", isolate: bool = False, tasks: int | None = None,
) -> DataFrame:
    """``columns`` of all ``files`` (``path, length``), with ``source_file``, ``ordinal`` and ``error``.

    A column that a file's header lacks is NULL there; several fields of one name
    are coalesced in the header's order. Short lines are filled with NULL, too
    long ones are skipped (``on_bad_lines="error"``: they end the job). Without
    ``isolate`` a file that cannot be read ends the job.
    """
    if on_bad_lines not in ("skip", "error"):
        raise ValueError("on_bad_lines must be 'skip' or 'error', for lines with too many fields")
    missing, name_all = frozenset(na_values), NAMING[naming]
    schema = T.StructType([
        *[T.StructField(c, T.StringType()) for c in columns],
        T.StructField("source_file", T.StringType()), T.StructField("ordinal", ORDINAL), T.StructField("error", ERROR),
    ])
    arrow = pa.schema([
        *[pa.field(str(k), pa.string()) for k in range(len(columns))], pa.field("source_file", pa.string()),
        pa.field("ordinal", pa.struct([("block", pa.int64()), ("line", pa.int64())])),
        pa.field("error", pa.struct([("stage", pa.string()), ("message", pa.string())])),
    ])

    def batch_of(rows: list[list[str]], places: list[int], sources: dict[str, list[int]], width: int, path: str, start: int) -> pa.RecordBatch:
        fields = list(zip(*[r + [None] * (width - len(r)) for r in rows], strict=True)) if rows else [()] * width
        out = []
        for c in columns:
            own = [fields[k] for k in sources.get(c, ())]
            if not own:
                out.append(pa.nulls(len(rows), pa.string()))
                continue
            values = [None if v in missing else v for v in own[0]]
            for other in own[1:]:
                values = [(None if w in missing else w) if v is None else v for v, w in zip(values, other, strict=True)]
            out.append(pa.array(values, pa.string()))
        n = len(rows)
        ordinal = pa.StructArray.from_arrays([pa.array([start] * n, pa.int64()), pa.array(places, pa.int64())], names=["block", "line"])
        return pa.RecordBatch.from_arrays([*out, pa.array([path] * n, pa.string()), ordinal, pa.nulls(n, arrow.field("error").type)], schema=arrow)

    def read(path: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        filesystem, local = fs.FileSystem.from_uri(arrow_uri(path))
        with filesystem.open_input_file(local) as stream:
            names, begin = header_of(stream, isolate)
            if not names:
                return
            named = name_all(names)
            if isolate and naming == "canonical" and not KNOWN.intersection(named):
                raise Broken("header", "no known column: " + ", ".join(named)[:200])
            sources: dict[str, list[int]] = {}
            for k, c in enumerate(named):
                sources.setdefault(c, []).append(k)
            some = long_records(stream, begin) if multi_line else records_of(stream, max(start, begin), end, isolate)
            most = batch_rows(len(names))
            rows: list[list[str]] = []
            places: list[int] = []
            for place, fields in some:
                if len(fields) > len(names):
                    if on_bad_lines == "error":
                        raise Broken("read", f"more than {len(names)} fields: {','.join(fields)[:200]}")
                    continue
                rows.append(fields)
                places.append(place)
                if len(rows) == most:
                    yield batch_of(rows, places, sources, len(names), path, start)
                    rows, places = [], []
            yield batch_of(rows, places, sources, len(names), path, start)

    def read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(batch.column(x).to_pylist() for x in ("path", "start", "end")), strict=True):
                if not isolate:
                    try:
                        yield from read(path, start, end)
                    except Broken as e:
                        raise ValueError(f"{e} in {path}") from None
                    continue
                try:
                    yield from read(path, start, end)
                except (Broken, OSError, csv.Error, pa.ArrowException) as e:
                    stage, message = (e.stage, e.message) if isinstance(e, Broken) else ("open" if isinstance(e, OSError) else "read", f"{type(e).__name__}: {e}"[:500])
                    yield pa.RecordBatch.from_pylist([{"source_file": path, "ordinal": None, "error": {"stage": stage, "message": message}}], schema=arrow)

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Names may repeat in another spelling, so the batches are built by number.
        for batch in read_ranges(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=schema.names)

    size = F.lit(1 << 62) if multi_line else F.lit(RANGE_BYTES)
    start = F.explode(F.array(F.lit(0)) if multi_line else F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(RANGE_BYTES).cast("long")))
    ranges = files.select("path", start.alias("start")).select("path", "start", (F.col("start") + size).alias("end"))
    tasks = tasks or 4 * files.sparkSession.sparkContext.defaultParallelism
    # A number of tasks, as Spark would put paths, which are small, into one.
    return ranges.repartition(tasks, "path", "start").mapInArrow(renamed, schema)


def range_tasks(files: DataFrame) -> int:
    """Tasks for all bytes of the files: one a range, four a core at least."""
    total = files.agg(F.sum(F.greatest(F.ceil(F.col("length") / RANGE_BYTES), F.lit(1)))).first()[0] or 0
    return int(min(max(total, 1), max(4 * files.sparkSession.sparkContext.defaultParallelism, total // 4 + 1)))


def without_broken(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a stored scan the rows of files that were read to their end, and ``source_file, stage, error`` of the others.

    One error a file counts, the first by stage and message.
    """
    broken = stored.where("error IS NOT NULL").groupBy("source_file").agg(F.min("error").alias("error"))
    broken = broken.select("source_file", F.col("error.stage").alias("stage"), F.col("error.message").alias("error"))
    return stored.where("error IS NULL").drop("error").join(broken, "source_file", "left_anti"), broken


def split_errors(found: DataFrame, name: str = "listing-rows") -> tuple[DataFrame, DataFrame]:
    """:func:`without_broken` of a scan, which is stored first, so no file is read twice."""
    return without_broken(materialize(found, name))


def column_names(files: DataFrame, naming: str = "canonical", tasks: int | None = None, isolate: bool = False) -> list[str]:
    """The different columns of all headers, by their first place and name. Only names leave the tasks."""
    name_all = NAMING[naming]

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        met: dict[str, int] = {}
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    filesystem, local = fs.FileSystem.from_uri(arrow_uri(path))
                    with filesystem.open_input_file(local) as stream:
                        own = name_all(header_of(stream, isolate)[0])
                except (Broken, OSError):
                    if not isolate:
                        raise
                    continue
                if isolate and naming == "canonical" and not KNOWN.intersection(own):
                    continue
                for k, x in enumerate(own):
                    met[x] = min(k, met.get(x, k))
        yield pa.RecordBatch.from_pydict({"name": list(met), "place": list(met.values())}, schema=pa.schema([("name", pa.string()), ("place", pa.int64())]))

    tasks = tasks or 4 * files.sparkSession.sparkContext.defaultParallelism
    found = files.select("path").repartition(tasks, "path").mapInArrow(names, "name string, place long")
    return [r["name"] for r in found.groupBy("name").agg(F.min("place").alias("place")).orderBy("place", "name").collect()]
