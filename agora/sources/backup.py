"""Backups as a data source: one JSON document of four tables, plain or gzipped, told by its first bytes.

Each table is a partition of its own, which goes through the document piece by piece and keeps one
record at a time, so that no file is ever a single row.  ``normalized`` coerces the records.
"""

from __future__ import annotations

import codecs
import json
import zlib
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TABLES = ("jobs", "jobItems", "jobEvents", "manualReviewTargets")
#: Bytes that are read at a time.
PIECE = 1 << 20
_DECODER = json.JSONDecoder()
_BLANK = " \t\r\n"


def _bytes(path: str) -> Iterator[bytes]:
    """A file's bytes, unpacked if it begins as gzip does, whatever its name."""
    if "://" in path or path.startswith("file:"):
        store, name = pyarrow.fs.FileSystem.from_uri(path)
    else:
        store, name = pyarrow.fs.LocalFileSystem(), path
    with store.open_input_stream(name, compression=None) as held:
        piece = held.read(PIECE)
        unpack = zlib.decompressobj(31) if piece[:2] == b"\x1f\x8b" else None
        while piece:
            while unpack and piece:
                yield unpack.decompress(piece)
                piece = unpack.unused_data
                if unpack.eof:
                    unpack = zlib.decompressobj(31) if piece else unpack
                    if not piece:
                        break
            if not unpack:
                yield piece
            piece = held.read(PIECE)


class _Text:
    """A document's text as far as it is needed: what has been read is let go."""

    def __init__(self, pieces: Iterator[bytes]):
        self.decode, self.pieces, self.held, self.at = codecs.getincrementaldecoder("utf-8-sig")(), pieces, "", 0

    def more(self) -> bool:
        """Reads on; False at the end."""
        for piece in self.pieces:
            if text := self.decode.decode(piece):
                self.held, self.at = self.held[self.at :] + text, 0
                return True
        return False

    def peek(self) -> str:
        """The next character that is not blank; empty at the end."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in _BLANK:
                self.at += 1
            if self.at < len(self.held):
                return self.held[self.at]
            if not self.more():
                return ""

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise ValueError(f"Backup file is not valid JSON: {wanted!r} expected")
        self.at += 1

    def value(self):
        """The next value, of which no more is held than itself and a piece."""
        self.peek()
        while True:
            try:
                found, end = _DECODER.raw_decode(self.held, self.at)
                # a number may go on in the next piece
                if isinstance(found, (dict, list, str)) or self.held[end : end + 1] in (*_BLANK, ",", "]", "}") or not self.more():
                    self.at = end
                    return found
            except json.JSONDecodeError:
                if not self.more():
                    raise ValueError("Backup file is not valid JSON") from None


def records(pieces: Iterator[bytes], table: str) -> Iterator[str]:
    """The records of a table of a backup as JSON; records that are no objects are empty ones, other members are skipped."""
    text = _Text(pieces)
    if not text.peek():
        raise ValueError("Backup file is empty")
    text.take("{")
    while text.peek() not in ("}", ""):
        name = text.value()
        text.take(":")
        if text.peek() == "[" and name in TABLES:
            text.take("[")
            while text.peek() != "]":
                record = text.value()
                if name == table:
                    yield json.dumps(record if isinstance(record, dict) else {}, ensure_ascii=False)
                if text.peek() == ",":
                    text.take(",")
            text.take("]")
        else:
            text.value()
        if text.peek() == ",":
            text.take(",")
    text.take("}")


class _Table(InputPartition):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.tables = options["path"].split(","), (options.get("tables") or ",".join(TABLES)).split(",")

    def partitions(self) -> list[_Table]:
        return [_Table(path, table) for path in self.paths for table in self.tables]

    def read(self, partition: _Table) -> Iterator[tuple]:
        for n, record in enumerate(records(_bytes(partition.path), partition.table)):
            yield partition.table, n, record


class Backup(DataSource):
    """``spark.read.format("agora_backup").load(path)``: rows (table, position, record as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "agora_backup"

    def schema(self) -> str:
        return "table string, position long, record string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str, *tables: str) -> DataFrame:
    """(table, position, record) of a backup, of the named tables alone if there are any."""
    spark.dataSource.register(Backup)
    reader = spark.read.format("agora_backup").option("path", path)
    return (reader.option("tables", ",".join(tables)) if tables else reader).load()


def _text(name: str, default: str = "") -> Column:
    """A member as text; missing, empty and false ones are the default."""
    held = F.get_json_object("record", f"$.{name}")
    return F.when(held.isNull() | held.isin("", "0", "false"), F.lit(default)).otherwise(held)


def _whole(name: str) -> Column:
    """A number without its fraction; 0 where there is none."""
    held = F.get_json_object("record", f"$.{name}").try_cast("double")
    return F.coalesce(F.when(held < 0, F.ceil(held)).otherwise(F.floor(held)).cast("long"), F.lit(0).cast("long"))


def _flag(name: str) -> Column:
    held = F.lower(F.trim(F.get_json_object("record", f"$.{name}")))
    return F.coalesce(held.isin("true", "1", "yes", "y", "on"), F.lit(False))


def _names(name: str) -> Column:
    held = F.from_json(F.get_json_object("record", f"$.{name}"), "array<string>")
    return F.coalesce(F.filter(F.transform(held, lambda v: F.trim(v)), lambda v: v != ""), F.array().cast("array<string>"))


def _moment(name: str, default: Column) -> Column:
    return F.coalesce(F.get_json_object("record", f"$.{name}").try_cast("timestamp"), default)


def normalized(rows: DataFrame, table: str, now: Column | None = None) -> DataFrame:
    """The records of one table with its defaults: numbers 0, texts by their kind, times those of creation, or ``now``.

    ``record`` stays, for members that have no default.
    """
    mine = rows.where(F.col("table") == table).withColumn("created_at", _moment("created_at", F.current_timestamp() if now is None else now))
    since = F.col("created_at")
    if table == "jobs":
        counts = {f"{k}_count": _whole(f"{k}_count") for k in ("pending", "queued", "running", "completed", "failed", "detected")}
        more = {"id": _text("id"), "status": _text("status", "queued"), "candidate_mode": F.when(_text("candidate_mode") != "", _text("candidate_mode")).otherwise(_text("candidateMode", "default")), "source_job_ids": _names("source_job_ids"), "total_urls": _whole("total_urls"), "scan_delay_ms": _whole("scan_delay_ms"), "screenshot_delay_ms": _whole("screenshot_delay_ms"), **counts, "updated_at": _moment("updated_at", since), "finished_at": F.get_json_object("record", "$.finished_at").try_cast("timestamp")}
    elif table == "jobItems":
        reviews = F.get_json_object("record", "$.candidate_reviews")
        more = {
            "id": _text("id"), "job_id": _text("job_id"), "row_number": _whole("row_number"), "attempts": _whole("attempts"), "status": _text("status", "queued"), "input_url": _text("input_url"), "normalized_url": _text("normalized_url"), "analysis_source": _text("analysis_source", "automated"),
            "manual_capture_required": _flag("manual_capture_required"), "candidate_reviews": F.when(reviews.startswith("["), reviews).otherwise("[]"), "updated_at": _moment("updated_at", since),
            **{n: F.get_json_object("record", f"$.{n}").try_cast("timestamp") for n in ("manual_captured_at", "started_at", "completed_at")},
        }
    elif table == "jobEvents":
        more = {"id": _text("id"), "job_id": _text("job_id"), "level": _text("level", "info"), "scope": _text("scope", "job"), "event_type": _text("event_type"), "message": _text("message")}
    else:
        more = {"id": _text("id"), "updated_at": _moment("updated_at", since)}
    return mine.withColumns(more).drop("table")
