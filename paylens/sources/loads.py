"""Loading statement files by what is in them.

A manifest tells of each file of the last load its size, time, what its lines hash to, and the folder with its rows.
The next load reads only files that are new or have changed; rows of files that are no longer given drop out. Every
file's rows, and how often each counterparty was charged each amount on each day, lie in folders of their own, so no
load rewrites what another has written. A sketch of the ids of each load tells whether new ids may repeat old ones;
old ids are read only then.
"""

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paylens.functions.text import search_text
from paylens.operators.levels import levels
from paylens.schema import TRANSACTIONS
from paylens.sources.sketches import may_hold, sketch
from paylens.sources.statements import EXAMPLES, FILE, check_statements, duplicate_ids, is_valid, read_statements, valid_rows
from paylens.sources.tables import written

_MANIFEST_DDL = "version int, path string, length long, modified timestamp, hash decimal(38,0), folder string"
_KEY = "file"


@dataclass(frozen=True)
class Loaded:
    """What a load did: files read, files taken over, rows and rejected rows of those read."""

    read: int
    kept: int
    rows: int
    rejects: int


def _given_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The files as they are listed; no content is read. `path` is what a reader takes, `address` what rows tell."""
    listed = spark.read.format("binaryFile").load(paths)
    meta = F.col("_metadata")
    return listed.select(
        "path", meta["file_path"].alias("address"), "length", F.col("modificationTime").alias("modified")
    )


def _hashes(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """What the lines of each file hash to, whatever splits it is read in; a file without a line has none."""
    lines = spark.read.text(paths, lineSep="\n").groupBy(F.col("_metadata.file_path").alias("address"))
    hashed = lines.agg(F.sum(F.xxhash64("value").cast("decimal(20,0)")).cast("decimal(38,0)").alias("hash"))
    return {r.address: r.hash for r in hashed.collect()}


def manifest(spark: SparkSession, base_path: str) -> list:
    """The newest manifest, a row for each file; none before the first load."""
    try:
        known = spark.read.schema(_MANIFEST_DDL).parquet(f"{base_path}/manifest")
    except AnalysisException:
        return []
    newest = known.agg(F.max("version").alias("version")).first().version
    return known.where(F.col("version") == newest).orderBy("path").collect()


def _folders(base_path: str, kind: str, files: list) -> list[str]:
    return [f"{base_path}/{kind}/{r.folder}" for r in files if r.folder is not None]


def loaded_rows(spark: SparkSession, base_path: str) -> DataFrame:
    """The rows of all files of the last load."""
    folders = _folders(base_path, "rows", manifest(spark, base_path))
    return spark.read.schema(TRANSACTIONS).parquet(*folders) if folders else spark.createDataFrame([], TRANSACTIONS)


def loaded_levels(spark: SparkSession, base_path: str) -> DataFrame:
    """The states of all files of the last load (see `operators.levels`); they add up to that of all rows."""
    ddl = "counterparty string, amount decimal(18,2), booking_date date, c long"
    folders = _folders(base_path, "levels", manifest(spark, base_path))
    return spark.read.schema(ddl).parquet(*folders) if folders else spark.createDataFrame([], ddl)


def _old_ids(spark: SparkSession, base_path: str, files: list) -> DataFrame:
    """Ids of files that are taken over, from their rows."""
    return spark.read.schema("tx_id string").parquet(*_folders(base_path, "rows", files))


def _check_ids(spark: SparkSession, base_path: str, new: DataFrame, kept: list) -> None:
    repeated = duplicate_ids(new).limit(EXAMPLES).collect()
    kept = [r for r in kept if r.folder is not None]
    if kept and not repeated:
        loads = sorted({r.folder.split("/")[0] for r in kept})
        sketches = spark.read.schema("bucket int, bitmap binary").parquet(*[f"{base_path}/sketches/{x}" for x in loads])
        hits = written(may_hold(sketches, new), "hits")
        if not hits.isEmpty():
            repeated = _old_ids(spark, base_path, kept).join(hits, "tx_id", "left_semi").limit(EXAMPLES).collect()
    if repeated:
        raise ValueError(f"repeated transaction ids, among them: {sorted({r.tx_id for r in repeated})}")


def load_files(spark: SparkSession, paths: str | list[str], base_path: str, strict: bool = True) -> Loaded:
    """Makes the table under `base_path` hold the rows of the given files, with their search texts.

    Files of the last load with the same size and time, or else with the same lines, are not read again. If
    `strict`, a rejected row fails the load; otherwise rejects are left out. Repeated ids, and no row at all, always
    fail it. After a failure the table is as it was. The driver sees a row for each file, as it does in listing them.
    """
    known = {r.path: r for r in manifest(spark, base_path)}
    version = max((r.version for r in known.values()), default=0) + 1
    given = _given_files(spark, paths).orderBy("path").collect()
    doubtful = [g for g in given if g.path not in known or (known[g.path].length, known[g.path].modified) != (g.length, g.modified)]
    hashes = _hashes(spark, [g.path for g in doubtful]) if doubtful else {}
    kept, fresh = [], []
    for g in given:
        old = known.get(g.path)
        if g not in doubtful:
            kept.append(old)
        elif old is not None and old.length == g.length and old.hash == hashes.get(g.address):
            kept.append(old)
        else:
            fresh.append(g)

    load, seen, files = f"load-{version:06d}-{uuid.uuid4().hex}", Observation(), {}
    rows = rejects = 0
    if fresh:
        keys = [(g.address, f"n{k}") for k, g in enumerate(fresh)]
        named = spark.createDataFrame(keys, f"{FILE} string, {_KEY} string")
        checked = check_statements(read_statements(spark, [g.path for g in fresh], with_file=True))
        counts = (F.count(F.lit(1)).alias("rows"), F.count_if(~is_valid()).alias("rejects"))
        text = search_text(F.col("counterparty"), F.col("description"))
        valid = valid_rows(checked.observe(seen, *counts)).withColumn("search_text", text)
        path = f"{base_path}/rows/{load}"
        valid.join(F.broadcast(named), FILE).drop(FILE).write.partitionBy(_KEY).parquet(path)
        rows, rejects = seen.get["rows"], seen.get["rejects"]
        if strict and rejects:
            raise ValueError(f"{rejects} rows rejected")
        if rows > rejects:
            new = spark.read.schema(f"{TRANSACTIONS.toDDL()}, {_KEY} string").parquet(path)
            _check_ids(spark, base_path, new, kept)
            levels(new, _KEY).write.partitionBy(_KEY).parquet(f"{base_path}/levels/{load}")
            sketch(new).write.parquet(f"{base_path}/sketches/{load}")
            held = {r[_KEY] for r in new.select(_KEY).distinct().collect()}
            files = {address: f"{load}/{_KEY}={key}" for address, key in keys if key in held}

    told = [
        (version, r.path, r.length, next(g.modified for g in given if g.path == r.path), r.hash, r.folder) for r in kept
    ] + [(version, g.path, g.length, g.modified, hashes.get(g.address), files.get(g.address)) for g in fresh]
    if not any(t[-1] for t in told):
        raise ValueError("the statement is empty")
    spark.createDataFrame(told, _MANIFEST_DDL).coalesce(1).write.mode("append").parquet(f"{base_path}/manifest")
    return Loaded(len(fresh), len(kept), rows - rejects, rejects)
