"""Payload files as a Spark data source: one payload a row, with what is wrong with it instead of an error.

Files are JSON lines {"seq": ..., "payload": "..."} under `source=<name>/stamp=<text>` folders, as `write` puts them. A test of source
or stamp is pushed down, so that files of other sources are not opened. A line, a payload or a file that can't be read becomes a row
with `error`: one bad source doesn't fail the others.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "source string, stamp string, seq long, payload string, error string"
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


@dataclass
class PayloadFile(InputPartition):
    path: str
    source: str
    stamp: str


def fault(payload: str | None) -> str | None:
    """What is wrong with a payload of JSON or XML; null if nothing is."""
    try:
        if (payload or "").lstrip().startswith("<"):
            ElementTree.fromstring(payload)
        else:
            json.loads(payload or "")
    except (ValueError, ElementTree.ParseError) as e:
        return f"{type(e).__name__}: {e}"[:300]
    return None


class PayloadReader(DataSourceReader):
    def __init__(self, path: str, pushed: bool):
        self.path, self.pushed, self.tests = path, pushed, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Keeps comparisons of source and stamp with a value; the others stay with Spark."""
        for f in filters:
            if self.pushed and type(f) in _TESTS and f.attribute in (("source",), ("stamp",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[PayloadFile]:
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        out = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            parts = dict(p.split("=", 1) for p in info.path.split("/")[:-1] if "=" in p)
            one = PayloadFile(info.path, parts.get("source", ""), parts.get("stamp", ""))
            if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")) and all(_TESTS[kind](getattr(one, name), value) for name, kind, value in self.tests):
                out.append(one)
        return sorted(out, key=lambda p: p.path)

    def read(self, partition: PayloadFile | None) -> Iterator[tuple]:
        if partition is None:  # no file passed the tests
            return
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        where = (partition.source, partition.stamp)
        try:
            with system.open_input_stream(partition.path) as raw:
                for line in _lines(raw):
                    try:
                        row = json.loads(line)
                        payload, seq = row.get("payload"), row.get("seq")
                        yield (*where, seq, payload, fault(payload))
                    except (ValueError, AttributeError) as e:
                        yield (*where, None, None, f"{type(e).__name__}: {e}"[:300])
        except OSError as e:
            yield (*where, None, None, f"{type(e).__name__}: {e}"[:300])


def _lines(raw) -> Iterator[bytes]:  # noqa: ANN001
    """Lines of a stream of bytes, one block at a time."""
    rest = b""
    while block := raw.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x for x in whole if x.strip())
    if rest.strip():
        yield rest


class PayloadSource(DataSource):
    """`spark.read.format("payloads").load(folder)`."""

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PayloadReader:  # noqa: ANN001
        return PayloadReader(self.options["path"], self.options.get("pushed", "false") == "true")


def read(spark: SparkSession, path: str, source: str | None = None, since: str | None = None) -> DataFrame:
    """(source, stamp, seq, payload, error) of all payloads under a folder, or of one source, or from a stamp on.

    Spark keeps one set of pushed filters for each load, so a loaded table that a plan reads twice under different filters would be
    read wrongly. Filters are therefore pushed only here, to a load of their own; those on the table that is returned stay with Spark."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PayloadSource)
    tests = [F.col("source") == source] * (source is not None) + [F.col("stamp") >= since] * (since is not None)
    out = spark.read.format("payloads").option("pushed", str(bool(tests)).lower()).load(path)
    for t in tests:
        out = out.where(t)
    # what is asked of this table later must not reach the scan with these
    return out.withColumn("stamp", F.concat("stamp", F.lit(""))).withColumn("source", F.concat("source", F.lit(""))) if tests else out


def write(payloads: DataFrame, path: str) -> None:
    """payloads (source, stamp, seq, payload) as files under a folder; what the folder holds stays."""
    payloads.select("source", "stamp", "seq", "payload").write.mode("append").partitionBy("source", "stamp").json(path)
