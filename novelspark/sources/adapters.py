"""Archives as Spark data sources: a named adapter lists its parts, tasks read them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

ITEM_SCHEMA = "chip_id string, lat double, lon double, datetime timestamp, sensor string, source_dataset string, group_id string, extra map<string,string>"

#: Whether a value that all rows of a part have can pass a filter; a null passes none of these.
_HOLDS = {
    EqualTo: lambda v, f: v is not None and v == f.value,
    In: lambda v, f: v is not None and v in f.value,
    GreaterThan: lambda v, f: v is not None and v > f.value,
    GreaterThanOrEqual: lambda v, f: v is not None and v >= f.value,
    LessThan: lambda v, f: v is not None and v < f.value,
    LessThanOrEqual: lambda v, f: v is not None and v <= f.value,
    IsNotNull: lambda v, f: v is not None,
}

#: The option that tells a source whether the session takes filters.
_PUSHED = "filters-pushed"

_ADAPTERS: dict[str, type[DataSource]] = {}


def adapter(
    name: str,
    parts: Callable[[dict], list],
    read: Callable[[dict, object], Iterator[tuple | pa.RecordBatch]],
    schema: str = ITEM_SCHEMA,
    facts: Callable[[dict, object], dict] | None = None,
) -> type[DataSource]:
    """Registers a source: parts(options) on the driver, read(options, part) yields rows or Arrow batches in a task.

    facts(options, part): what holds for all rows of a part, {column: value}. Filters on these columns then drop parts
    before any task reads them, where the session has spark.sql.python.filterPushdown.enabled when the source is loaded;
    Spark applies every filter to the rows as well.
    A stream of the source reads each part once, in the order in which parts() lists them: its offset is the number of
    parts read, so parts() must only add new ones at the end.
    """

    class Part(InputPartition):
        pass

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options, self.held = options, []

        def partitions(self) -> list[InputPartition]:
            out = []
            for p in parts(self.options):
                known = facts(self.options, p) if facts else {}
                if all(_HOLDS[type(f)](known[f.attribute[0]], f) for f in self.held if f.attribute[0] in known):
                    out.append(Part(p))
            return out

        def read(self, partition: InputPartition) -> Iterator[tuple | pa.RecordBatch]:
            yield from read(self.options, partition.value)

    class PushingReader(Reader):
        def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
            self.held = [f for f in filters if type(f) in _HOLDS and len(f.attribute) == 1]
            yield from filters

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.options = options

        def initialOffset(self) -> dict:
            return {"parts": 0}

        def latestOffset(self) -> dict:
            return {"parts": len(parts(self.options))}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [Part(p) for p in parts(self.options)[start["parts"] : end["parts"]]]

        def read(self, partition: InputPartition) -> Iterator[tuple | pa.RecordBatch]:
            yield from read(self.options, partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            options = dict(self.options)
            return (PushingReader if options.pop(_PUSHED, "false") == "true" and facts else Reader)(options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return StreamReader(dict(self.options))

    _ADAPTERS[name] = Source
    return Source


def load(spark: SparkSession, name: str, **options) -> DataFrame:
    """The archive of a registered adapter; an unknown name is an error."""
    if name not in _ADAPTERS:
        raise KeyError(f"no adapter {name}; there are {', '.join(sorted(_ADAPTERS)) or 'none'}")
    spark.dataSource.register(_ADAPTERS[name])
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(name).options(**options).option(_PUSHED, pushed).load()


def load_stream(spark: SparkSession, name: str, **options) -> DataFrame:
    """The same as a stream of the parts that come."""
    if name not in _ADAPTERS:
        raise KeyError(f"no adapter {name}; there are {', '.join(sorted(_ADAPTERS)) or 'none'}")
    spark.dataSource.register(_ADAPTERS[name])
    return spark.readStream.format(name).options(**options).load()
