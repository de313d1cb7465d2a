"""A write-ahead log as a table (pos, type, txn, version, ts, data, checksum), and its replay as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entry types, and when a checkpoint is due.
ENTRY_TYPES = ("BEGIN", "COMMIT", "ROLLBACK", "OP", "CHECKPOINT")
CHECKPOINT_SECONDS, CHECKPOINT_BYTES, CHECKPOINT_AGE = 300, 1 << 20, 1800


def xor_bytes(data: Column) -> Column:
    """XOR of all bytes of a text's UTF-8 or of a binary; 0 of nothing.  The bytes are taken apart once."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))
    return F.coalesce(F.aggregate(pairs, F.lit(0), lambda a, b: a.bitwiseXOR(F.conv(b, 16, 10).cast("int"))), F.lit(0))


def checksum() -> Column:
    """Checksum of an entry: its text form, byte by byte."""
    body = F.concat_ws("|", F.col("pos").cast("string"), "type", F.col("txn").cast("string"), F.col("version").cast("string"), "data")
    return xor_bytes(body)


def seal(log: DataFrame) -> DataFrame:
    return log.withColumn("checksum", checksum())


def corrupt(log: DataFrame) -> DataFrame:
    """Entries whose checksum isn't that of their content."""
    return log.where(~F.col("checksum").eqNullSafe(checksum()))


def append(log: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries (without pos and checksum) added at the end, in the order of ``ts`` and ``txn``; one batch is small."""
    from ..sources.storage import with_row_index

    last = log.agg(F.coalesce(F.max("pos"), F.lit(0)))
    placed = with_row_index(entries, "ts", "txn").withColumn("pos", last.scalar() + F.col("row_index") + 1).drop("row_index")
    return log.unionByName(seal(placed).select(log.columns))


def transactions(log: DataFrame) -> DataFrame:
    """(txn, state, ops, version): every transaction as the log leaves it; rows are counted, not collected."""
    def has(t: str) -> Column:
        return F.coalesce(F.bool_or(F.col("type") == t), F.lit(False))

    found = log.groupBy("txn").agg(
        has("BEGIN").alias("_begun"), has("COMMIT").alias("_done"), has("ROLLBACK").alias("_undone"),
        F.count(F.when(F.col("type") == "OP", True)).cast("long").alias("ops"),
        F.max(F.when(F.col("type") == "COMMIT", F.col("version"))).alias("version"),
    )
    state = (
        F.when(~F.col("_begun"), "unknown").when(F.col("_done"), "committed").when(F.col("_undone"), "rolled_back").otherwise("pending")
    )
    return found.select("txn", state.alias("state"), "ops", "version")


def pending(log: DataFrame) -> DataFrame:
    """Transactions that were begun and neither committed nor rolled back."""
    return transactions(log).where("state = 'pending'").select("txn", "ops")


def pending_entries(log: DataFrame) -> DataFrame:
    """The operations of pending transactions."""
    return log.where("type = 'OP'").join(pending(log).select("txn"), "txn", "left_semi")


def unknown(log: DataFrame) -> DataFrame:
    """Transactions with entries and no beginning: a log that has one can't be replayed."""
    return transactions(log).where("state = 'unknown'").select("txn")


def last_committed(log: DataFrame) -> DataFrame:
    """One row, version: that of the last commit in the order of the log; null without one."""
    commit = F.col("type") == "COMMIT"
    return log.agg(F.max_by(F.when(commit, F.col("version")), F.when(commit, F.col("pos"))).alias("version"))


def recover(log: DataFrame) -> dict:
    """What a restart needs to know."""
    states = {r["state"]: r["n"] for r in transactions(log).groupBy("state").agg(F.count("*").alias("n")).collect()}
    if states.get("unknown"):
        raise ValueError(f"{states['unknown']} transactions have no beginning")
    return {"last_committed": last_committed(log).first()["version"], "pending": states.get("pending", 0), "corrupt": corrupt(log).count()}


def checkpoint_due(seconds_since: float | Column, log_bytes: int | Column, age_seconds: float | Column) -> bool | Column:
    """Whether a checkpoint is due, for numbers or, row by row, for columns."""
    return (seconds_since >= CHECKPOINT_SECONDS) | (log_bytes >= CHECKPOINT_BYTES) | (age_seconds >= CHECKPOINT_AGE)


def compact(log: DataFrame) -> DataFrame:
    """Entries after the last checkpoint; all of them without one."""
    mark = log.agg(F.coalesce(F.max(F.when(F.col("type") == "CHECKPOINT", F.col("pos"))), F.lit(-1)))
    return log.where(F.col("pos") > mark.scalar())


def backup(log: DataFrame, path: str) -> None:
    log.write.mode("errorifexists").parquet(path)


def repair(log: DataFrame) -> DataFrame:
    """The entries before the first corrupt one, which is as far as the log can be trusted."""
    bad = corrupt(log).agg(F.coalesce(F.min("pos"), F.lit((1 << 63) - 1)))
    return log.where(F.col("pos") < bad.scalar())


def statistics(log: DataFrame) -> DataFrame:
    """Entries, bytes, first and last position by type."""
    return log.groupBy("type").agg(
        F.count("*").cast("long").alias("entries"), F.sum(F.octet_length("data")).cast("long").alias("bytes"),
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
    )


def checkpoint_statistics(log: DataFrame) -> DataFrame:
    """One row: position, version and time of the last checkpoint, and the last position of the log."""
    mark = F.col("type") == "CHECKPOINT"
    last = F.max_by(F.when(mark, F.struct("version", "ts")), F.when(mark, F.col("pos")))
    found = log.agg(F.max(F.when(mark, F.col("pos"))).alias("checkpoint_pos"), last.alias("_x"), F.max("pos").alias("log_pos"))
    return found.select("checkpoint_pos", F.col("_x.version").alias("checkpoint_version"), F.col("_x.ts").alias("checkpoint_time"), "log_pos")
