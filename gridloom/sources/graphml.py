"""GraphML files as tables of nodes and edges, through Spark's Python data source interface; one file is one partition."""

from __future__ import annotations

import glob
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NS = "{http://graphml.graphdrawing.org/xmlns}"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class GraphmlReader(DataSourceReader):
    def __init__(self, path: str, part: str):
        self.path, self.part = path, part

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in sorted(glob.glob(self.path))] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        keys: dict[str, str] = {}
        for _, el in ElementTree.iterparse(partition.path, events=("end",)):
            if el.tag == f"{NS}key":
                keys[el.get("id")] = el.get("attr.name")
            elif el.tag in (f"{NS}node", f"{NS}edge"):
                data = {keys.get(d.get("key"), d.get("key")): d.text for d in el.iter(f"{NS}data")}
                num = lambda k: float(data[k]) if data.get(k) not in (None, "") else None
                if el.tag == f"{NS}node" and self.part == "nodes":
                    yield (partition.path, el.get("id"), num("x"), num("y"))
                elif el.tag == f"{NS}edge" and self.part == "edges":
                    yield (partition.path, el.get("source"), el.get("target"), num("length"), data.get("highway"))
                el.clear()


class Graphml(DataSource):
    """Options: path (a glob), part ('nodes' or 'edges')."""

    @classmethod
    def name(cls) -> str:
        return "graphml"

    def schema(self) -> str:
        if self.options.get("part", "edges") == "nodes":
            return "file string, id string, x double, y double"
        return "file string, u string, v string, length double, highway string"

    def reader(self, schema) -> GraphmlReader:
        return GraphmlReader(self.options["path"], self.options.get("part", "edges"))


def read_graphml(spark: SparkSession, path: str, part: str = "edges"):
    spark.dataSource.register(Graphml)
    return spark.read.format("graphml").option("path", path).option("part", part).load()
