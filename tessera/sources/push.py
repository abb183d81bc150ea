"""A push source as a Python data source: messages arrive at their own pace and are read by offset."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Lines(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


class PushSource(DataSource):
    """Options: ``messages``, a file of JSON lines that all executors can read, and ``per_second``."""

    @classmethod
    def name(cls) -> str:
        return "pushed"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return PushReader(schema, self.options["messages"], float(self.options.get("per_second", 100)))


class PushReader(DataSourceStreamReader):
    """What has arrived is a line number that grows with time up to the number of lines."""

    def __init__(self, schema: T.StructType, path: str, per_second: float):
        self.schema, self.path, self.per_second = schema, path.removeprefix("file://"), per_second
        with open(self.path, encoding="utf-8") as f:
            self.lines = sum(1 for _ in f)
        self.start = time.time()
        self.known = 0  # lines that had arrived before a restart

    def initialOffset(self) -> dict:
        return {"line": 0}

    def latestOffset(self) -> dict:
        return {"line": min(self.lines, self.known + int((time.time() - self.start) * self.per_second))}

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        if start["line"] > self.known:
            self.known, self.start = start["line"], time.time()
        return [Lines(start["line"], end["line"])]

    def read(self, partition: Lines) -> Iterator[tuple]:
        names, parse = [f.name for f in self.schema.fields], {f.name: _parser(f.dataType) for f in self.schema.fields}
        with open(self.path, encoding="utf-8") as f:
            for i, line in enumerate(f):
                if i >= partition.end:
                    break
                if i >= partition.first:
                    message = _object(line)
                    yield tuple(parse[n](message.get(n)) for n in names)


def _object(line: str) -> dict:
    """The JSON object of a line; a line that isn't one gives a row of nulls, as in the JSON reader."""
    try:
        value = json.loads(line)
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def _parser(kind: T.DataType):
    """From what JSON gives to what a column of the type takes; what doesn't fit is null."""
    if isinstance(kind, T.ArrayType):
        item = _parser(kind.elementType)
        return lambda v: [item(x) for x in v] if isinstance(v, list) else None
    if isinstance(kind, T.StructType):
        fields = [(f.name, _parser(f.dataType)) for f in kind.fields]
        return lambda v: tuple(p(v.get(n)) for n, p in fields) if isinstance(v, dict) else None
    if isinstance(kind, T.StringType):
        return lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return lambda v: float(v) if isinstance(v, (int, float)) else None
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return lambda v: v if isinstance(v, int) else None
    if isinstance(kind, T.BooleanType):
        return lambda v: v if isinstance(v, bool) else None
    raise TypeError(f"no column of {kind.simpleString()} can be read from a message")
