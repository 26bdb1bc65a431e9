"""Statement files: scan, cleaning, validation, key check.

A quoted field may hold line breaks, so where a record ends depends on all quotes before it. A file is still read
by many tasks: each joins the lines of its part of the file into chunks and tells whether a chunk has an odd number
of quotes. Sums of these over the chunks before tell every chunk whether it starts within a field, and it is then
cut into records by itself. Only records that go over the end of a chunk are put together from their pieces.
"""

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylens.fixed_values import REQUIRED_HEADERS, STATEMENT_HEADERS
from paylens.functions.dates import parse_statement_date
from paylens.functions.text import strip_to_null
from paylens.schema import AMOUNT, TRANSACTIONS
from paylens.sources.tables import written

# Bytes of text that are cut into records at once.
CHUNK_BYTES = 1 << 20
EXAMPLES = 5

_CHUNKS_DDL = "path string, start long, seq int, odd boolean, text string"
_CHUNKS = pa.schema(
    [("path", pa.string()), ("start", pa.int64()), ("seq", pa.int32()), ("odd", pa.bool_()), ("text", pa.string())]
)
_RECORDS_DDL = "path string, start long, seq int, place int, part int, record string"
_RECORDS = pa.schema(
    [
        ("path", pa.string()),
        ("start", pa.int64()),
        ("seq", pa.int32()),
        ("place", pa.int32()),
        ("part", pa.int32()),
        ("record", pa.string()),
    ]
)
# A record is whole, or a piece of one that goes on in the next chunk, came from the one before, or both.
_WHOLE, _FIRST, _LATER = 0, 1, 2
# The column that names a row's file, where it is asked for.
FILE = "statement_file"
# Where a chunk or record lies in its file.
_PLACE = ("start", "seq", "place")


def _chunked(chunk_bytes: int):
    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lines of each part of a file, in order, in chunks."""
        held: list[str] = []
        size = seq = 0
        last = None

        def cut() -> pa.RecordBatch:
            nonlocal held, size, seq
            text = "\n".join(held)
            row = {"path": last[0], "start": last[1], "seq": seq, "odd": text.count('"') % 2 == 1, "text": text}
            held, size, seq = [], 0, seq + 1
            return pa.RecordBatch.from_pylist([row], schema=_CHUNKS)

        for batch in batches:
            lines, paths, starts = batch.columns
            new = pc.or_(pc.not_equal(paths[1:], paths[:-1]), pc.not_equal(starts[1:], starts[:-1]))
            cuts = [0, *(pc.indices_nonzero(new).to_numpy() + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                own = (paths[a].as_py(), starts[a].as_py())
                if own != last:
                    if held:
                        yield cut()
                    last, seq = own, 0
                for line in lines.slice(a, b - a).to_pylist():
                    held.append(line)
                    size += len(line) + 1
                    if size >= chunk_bytes:
                        yield cut()
        if held:
            yield cut()

    return chunked


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of chunks that start within a quoted field or not, and pieces of those that are not whole."""
    for batch in batches:
        for path, start, seq, inside, text in zip(*(c.to_pylist() for c in batch.columns)):
            records, parts, held = [], [], []
            later = inside
            for line in text.split("\n"):
                if '"' in line and line.count('"') % 2:
                    inside = not inside
                held.append(line)
                if not inside:
                    records.append("\n".join(held))
                    parts.append(_LATER if later else _WHOLE)
                    held, later = [], False
            if held:
                records.append("\n".join(held))
                parts.append(_LATER if later else _FIRST)
            n = len(records)
            columns = ([path] * n, [start] * n, [seq] * n, range(n), parts, records)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORDS)], schema=_RECORDS)


def _states(chunks: DataFrame) -> DataFrame:
    """Of each chunk whether it starts within a quoted field. Quotes that do not match are an error."""
    known = chunks.select("path", "start", "seq", F.col("odd").cast("int").alias("odd"))
    files = known.groupBy("path").agg((F.sum("odd") % 2).alias("left")).where("left = 1")
    open_files = [r.path for r in files.select("path").limit(EXAMPLES).collect()]
    if open_files:
        raise ValueError(f"quotes without a match in {open_files}")
    before = Window.partitionBy("path").orderBy("start", "seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    return known.select("path", "start", "seq", inside.alias("inside"))


def _whole(chunks: DataFrame) -> DataFrame:
    """Records that lie in one chunk, with their place."""
    cut = chunks.select("path", "start", "seq", "inside", "text").mapInArrow(_cut_records, _RECORDS_DDL)
    return cut.where(F.col("part") == _WHOLE).select("path", *_PLACE, "record")


def _joined(chunks: DataFrame) -> DataFrame:
    """Records that go beyond a chunk, put together; only chunks that start or end within a field have pieces."""
    some = chunks.where("inside OR odd").select("path", "start", "seq", "inside", "text")
    pieces = some.mapInArrow(_cut_records, _RECORDS_DDL).where(F.col("part") != _WHOLE)
    in_order = Window.partitionBy("path").orderBy(*_PLACE)
    number = F.sum((F.col("part") == _FIRST).cast("int")).over(in_order)
    return (
        pieces.withColumn("number", number)
        .groupBy("path", "number")
        .agg(F.array_sort(F.collect_list(F.struct(*_PLACE, "record"))).alias("pieces"))
        .select(
            "path",
            *[F.col("pieces")[0][c].alias(c) for c in _PLACE],
            F.array_join(F.transform("pieces", lambda p: p["record"]), "\n").alias("record"),
        )
    )


def _records(whole: DataFrame, joined: DataFrame) -> DataFrame:
    """Records that are not empty, without the mark at the start of a file and what ends lines elsewhere."""
    found = whole.unionByName(joined)
    at_start = (F.col("start") == 0) & (F.col("seq") == 0) & (F.col("place") == 0)
    record = F.regexp_replace("record", r"\r\z", "")
    record = F.when(at_start, F.regexp_replace(record, "^\ufeff", "")).otherwise(record)
    return found.withColumn("record", record).where("record <> ''")


def _fields(record: Column, n: int) -> Column:
    """The fields of a record, n of them; those that it does not have are null."""
    schema = ", ".join(f"_{i} string" for i in range(n))
    options = {"sep": ";", "quote": '"', "escape": '"', "multiLine": "true"}
    return F.transform(F.array(F.from_csv(record, schema, options)), lambda r: F.array(*[r[f"_{i}"] for i in range(n)]))[0]


def read_statements(
    spark: SparkSession, paths: str | list[str], chunk_bytes: int = CHUNK_BYTES, with_file: bool = False
) -> DataFrame:
    """Raw rows, all text, columns taken by exact header name; a missing header gives nulls.

    The first record of each file names its columns, in any order. A quoted field may hold line breaks, quotes are
    doubled within it, and empty lines are skipped. A file of any size is read by as many tasks as it has splits,
    once: its text is written to the scratch folder, cut into records from there. A file whose quotes do not match
    is an error. With `with_file` the column `FILE` holds the file's address. The driver sees the longest header's
    length.
    """
    lines = spark.read.text(paths, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    )
    chunks = written(lines.mapInArrow(_chunked(chunk_bytes), _CHUNKS_DDL), "chunks")
    states = written(_states(chunks), "states")
    chunks = chunks.join(states, ["path", "start", "seq"])
    firsts = states.groupBy("path").agg(F.min(F.struct("start", "seq")).alias("at")).select("path", "at.*")
    # The first record lies in the first chunk, or is one of those that go beyond it.
    joined = _joined(chunks)
    candidates = _records(_whole(chunks.join(firsts, ["path", "start", "seq"], "left_semi")), joined)
    place = F.struct(*_PLACE)
    headers = candidates.groupBy("path").agg(
        F.min_by("record", place).alias("header"), F.min(place).alias("header_at")
    )
    headers = written(headers, "headers")
    separators = F.length("header") - F.length(F.replace("header", F.lit(";"), F.lit("")))
    widest = headers.agg(F.max(separators)).first()[0]
    if widest is None:
        names = [*STATEMENT_HEADERS, FILE] if with_file else [*STATEMENT_HEADERS]
        return spark.createDataFrame([], ", ".join(f"`{h}` string" for h in names))
    names = _fields(F.col("header"), widest + 1)
    at = [F.array_position(names, F.lit(h)).cast("int").alias(h) for h in STATEMENT_HEADERS]
    columns = headers.select("path", "header_at", F.struct(*at).alias("at"))
    rows = _records(_whole(chunks), joined).join(columns, "path").where(place > F.col("header_at"))
    rows = rows.select("path", "at", _fields(F.col("record"), widest + 1).alias("fields"))
    # Place 0: the file has no such column.
    columns = [F.get("fields", F.col("at")[h] - 1).alias(h) for h in STATEMENT_HEADERS]
    return rows.select(*columns, *([F.col("path").alias(FILE)] if with_file else []))


def check_statements(raw: DataFrame) -> DataFrame:
    """Typed columns plus `errors`, an array of what is wrong with the row (empty if nothing)."""
    text = {h: strip_to_null(F.col(f"`{h}`")) for h in STATEMENT_HEADERS}
    typed = dict(text)
    typed["KUUPÄEV"] = parse_statement_date(text["KUUPÄEV"])
    # Decimal comma or point; underscores between digits are dropped.
    plain = F.replace(F.replace(text["SUMMA"], F.lit(","), F.lit(".")), F.lit("_"), F.lit(""))
    typed["SUMMA"] = plain.try_cast(AMOUNT)

    missing = [F.when(text[h].isNull(), F.lit(f"{h} missing")) for h in REQUIRED_HEADERS]
    invalid = [
        F.when(text[h].isNotNull() & typed[h].isNull(), F.lit(f"{h} invalid"))
        for h in ("KUUPÄEV", "SUMMA")
    ]
    return raw.select(
        *[typed[h].alias(name) for h, name in STATEMENT_HEADERS.items()],
        F.array_compact(F.array(*missing, *invalid)).alias("errors"),
        *[F.col(f"`{h}`").alias(f"raw_{name}") for h, name in STATEMENT_HEADERS.items()],
        *[FILE for c in raw.columns if c == FILE],
    )


def is_valid() -> Column:
    """Whether a checked row has no errors: all required values are there and typed.

    The same as empty `errors`, but cheap where a filter is moved below the checks.
    """
    present = [F.col(STATEMENT_HEADERS[h]).isNotNull() for h in REQUIRED_HEADERS]
    return reduce(lambda a, b: a & b, present)


def valid_rows(checked: DataFrame) -> DataFrame:
    """Rows without errors, in the shape of the transactions table; search text is still null."""
    columns = [c for c in TRANSACTIONS.fieldNames() if c != "search_text"]
    return checked.where(is_valid()).select(
        *columns, F.lit(None).cast("string").alias("search_text"), *[c for c in checked.columns if c == FILE]
    )


def rejected_rows(checked: DataFrame) -> DataFrame:
    """Rows with errors, as they were read."""
    return checked.where(~is_valid()).select(
        *[F.col(f"raw_{name}").alias(name) for name in STATEMENT_HEADERS.values()], "errors"
    )


def duplicate_ids(transactions: DataFrame) -> DataFrame:
    """Ids held by more than one row, with how many hold them."""
    return (
        transactions.groupBy("tx_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    )
