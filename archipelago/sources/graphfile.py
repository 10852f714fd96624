"""The versioned binary graph file, as bytes and as a Spark data source.

Fixed values of the format, little-endian:
  header   magic 0x31474944, version 4, islands, edges         (4 x u32)
  edge     a, b (u32); point a, point b (6 x f32); horizontal, vertical (f32);
           open a->b, open b->a (u8)
  island   id (u32); centre, least and greatest corner (9 x f32); mass (f32);
           suppressed (u8); polygons (u32 count, u64 each); edges (u32 count,
           u32 each)
"""

from __future__ import annotations

import struct
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import batched
from math import hypot, isfinite

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from archipelago.storage import store

MAGIC, VERSION = 0x31474944, 4
HEADER, EDGE, ISLAND, COUNT = struct.Struct("<4I"), struct.Struct("<2I8f2B"), struct.Struct("<I10fB"), struct.Struct("<I")


class GraphFileError(ValueError):
    """``status``: malformed_data, invalid_magic or unsupported_version."""

    def __init__(self, status: str, detail: str):
        super().__init__(f"{status}: {detail}")
        self.status = status


@dataclass(frozen=True)
class ReadLimits:
    islands: int = 1_000_000
    elements: int = 16_000_000
    allocation: int = 256 << 20


def _edge_bytes(e: dict) -> bytes:
    return EDGE.pack(e["island_a"], e["island_b"], *(e[f"{p}{k}"] for p in "ab" for k in "xyz"), e["horizontal"], e["vertical_delta_ab"], e["trav_ab"], e["trav_ba"])


def _island_bytes(i: dict) -> bytes:
    box = [i[f"{p}_{k}"] for p in ("center", "min", "max") for k in "xyz"]
    return b"".join((
        ISLAND.pack(i["id"], *box, i["mass_score"], i["suppressed"]),
        struct.pack(f"<I{len(i['polygons'])}Q", len(i["polygons"]), *i["polygons"]),
        struct.pack(f"<I{len(i['edge_indices'])}I", len(i["edge_indices"]), *i["edge_indices"]),
    ))


def encode(islands: list[dict], edges: list[dict]) -> bytes:
    """Islands in id order with ``polygons`` and ``edge_indices``, then edges."""
    return b"".join((HEADER.pack(MAGIC, VERSION, len(islands), len(edges)), *map(_edge_bytes, edges), *map(_island_bytes, islands)))


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: struct.Struct) -> tuple:
        if self.at + form.size > len(self.data):
            raise GraphFileError("malformed_data", "truncated")
        values = form.unpack_from(self.data, self.at)
        self.at += form.size
        return values

    def array(self, kind: str, limits: ReadLimits, spent: list[int]) -> list[int]:
        n = self.take(COUNT)[0]
        form = struct.Struct(f"<{n}{kind}") if n <= limits.elements else None
        if form is None:
            raise GraphFileError("malformed_data", "too many elements")
        spent[0] += form.size
        if spent[0] > limits.allocation:
            raise GraphFileError("malformed_data", "allocation budget")
        return list(self.take(form))


def _require(holds: bool, detail: str) -> None:
    if not holds:
        raise GraphFileError("malformed_data", detail)


def _near(a: float, b: float) -> bool:
    return abs(a - b) <= 1e-4 * max(1.0, abs(a), abs(b))


def checked(data: bytes, limits: ReadLimits = ReadLimits()) -> tuple[Iterator[dict], Iterator[dict]]:
    """Islands and edges of a file; bytes after the end are ignored.  Edges are checked
    at once, islands as they come: only what one check needs of others is held."""
    reader = _Reader(data)
    magic, version, n_islands, n_edges = reader.take(HEADER)
    if magic != MAGIC:
        raise GraphFileError("invalid_magic", hex(magic))
    if version != VERSION:
        raise GraphFileError("unsupported_version", str(version))
    _require(n_islands <= limits.islands and n_edges <= limits.elements, "counts")
    spent = [n_islands * ISLAND.size + n_edges * EDGE.size]
    _require(spent[0] <= limits.allocation, "allocation budget")
    touching = [array("I") for _ in range(n_islands)]
    for n in range(n_edges):
        a, b, *values, ab, ba = reader.take(EDGE)
        _require(a < n_islands and b < n_islands and a != b, "edge ends")
        _require(ab <= 1 and ba <= 1 and bool(ab or ba), "edge directions")
        _require(all(map(isfinite, values)), "edge coordinates")
        (ax, ay, az, bx, by, bz, far, rise) = values
        _require(far >= 0 and _near(far, hypot(bx - ax, bz - az)) and _near(rise, by - ay), "edge geometry")
        for end in (a, b):
            touching[end].append(n)

    def edges() -> Iterator[dict]:
        for n in range(n_edges):
            a, b, *values, ab, ba = EDGE.unpack_from(data, HEADER.size + n * EDGE.size)
            points = dict(zip([f"{p}{k}" for p in "ab" for k in "xyz"], values[:6], strict=True))
            yield {"edge_index": n, "island_a": a, "island_b": b, **points, "horizontal": values[6], "vertical_delta_ab": values[7], "trav_ab": bool(ab), "trav_ba": bool(ba)}

    def islands() -> Iterator[dict]:
        owned: set[int] = set()
        for n in range(n_islands):
            key, *values, mass, hidden = reader.take(ISLAND)
            _require(key == n, "island id")
            _require(all(map(isfinite, values)) and isfinite(mass), "island coordinates")
            _require(all(values[3 + k] <= values[6 + k] for k in range(3)), "island bounds")
            _require(0 <= mass <= 1 and hidden <= 1, "island mass")
            polygons = reader.array("Q", limits, spent)
            for ref in polygons:
                _require(0 < ref < 1 << 63 and ref not in owned, "polygon")
                owned.add(ref)
            indices = reader.array("I", limits, spent)
            _require(indices == touching[n].tolist(), "adjacency")
            box = dict(zip([f"{p}_{k}" for p in ("center", "min", "max") for k in "xyz"], values, strict=True))
            yield {"id": n, **box, "mass_score": mass, "suppressed": bool(hidden), "polygons": polygons, "edge_indices": indices}

    return islands(), edges()


def decode(data: bytes, limits: ReadLimits = ReadLimits()) -> tuple[list[dict], list[dict]]:
    """Islands and edges of a file, checked throughout."""
    islands, edges = checked(data, limits)
    return list(islands), list(edges)


ISLAND_DDL = "id bigint, " + ", ".join(f"{p}_{k} double" for p in ("center", "min", "max") for k in "xyz") + ", mass_score double, suppressed boolean, polygons array<bigint>, edge_indices array<int>"
EDGE_DDL = "edge_index int, island_a bigint, island_b bigint, " + ", ".join(f"{p}{k} double" for p in "ab" for k in "xyz") + ", horizontal double, vertical_delta_ab double, trav_ab boolean, trav_ba boolean"


#: Bytes of a file that go through the driver at once, and rows of a batch read.
CHUNK, BATCH = 1 << 20, 10_000


def _packed(rows: DataFrame, order: str, pack: Callable[[dict], bytes]) -> DataFrame:
    """``rows`` in ``order``, packed by tasks into chunks of ``CHUNK`` bytes or a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        give = lambda parts: pa.RecordBatch.from_pydict({"data": pa.array([b"".join(parts)], pa.binary())})
        for batch in batches:
            for row in batch.to_pylist():
                held.append(pack(row))
                size += len(held[-1])
                if size >= CHUNK:
                    yield give(held)
                    held, size = [], 0
        if held:
            yield give(held)

    return rows.orderBy(order).mapInArrow(run, "data binary")


def graph_chunks(islands: DataFrame, edges: DataFrame, polygon_island: DataFrame, limits: ReadLimits = ReadLimits()) -> Iterator[bytes]:
    """A graph's file in parts.  The format has one writer and bounded counts, which
    are checked first.  Records are packed by tasks; the driver gets the parts of one
    partition at a time, never the graph."""
    n_islands, n_edges = islands.count(), edges.count()
    if n_islands > limits.islands or n_edges > limits.elements or polygon_island.count() > limits.elements:
        raise ValueError("the graph is larger than a graph file may be; keep it as Parquet")
    owned = polygon_island.groupBy(F.col("island").alias("id")).agg(F.sort_array(F.collect_list("poly_ref")).alias("polygons"))
    ends = edges.select("edge_index", F.explode(F.array("island_a", "island_b")).alias("id"))
    touching = ends.groupBy("id").agg(F.sort_array(F.collect_set("edge_index")).alias("edge_indices"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    facts = [c for c in islands.columns if c not in ("polygons", "edge_indices")]
    rows = islands.join(owned, "id", "left").join(touching, "id", "left").select(*facts, none("polygons", "array<bigint>"), none("edge_indices", "array<int>"))
    yield HEADER.pack(MAGIC, VERSION, n_islands, n_edges)
    for part in (_packed(edges, "edge_index", _edge_bytes), _packed(rows, "id", _island_bytes)):
        # written first: an order is worked out once, and its partitions come one by one
        for row in store(part.withColumn("n", F.monotonically_increasing_id()), "graph-file").orderBy("n").toLocalIterator():
            yield bytes(row["data"])


def graph_bytes(islands: DataFrame, edges: DataFrame, polygon_island: DataFrame, limits: ReadLimits = ReadLimits()) -> bytes:
    """:func:`graph_chunks` as one value, for graphs that fit into memory."""
    return b"".join(graph_chunks(islands, edges, polygon_island, limits))


def write_graph(path: str, *graph: DataFrame) -> None:
    """Write the file through Spark's file system, whatever ``path`` names."""
    sc = graph[0].sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(sc._jsc.hadoopConfiguration())
    out = None
    try:
        for data in graph_chunks(*graph):
            out = out or files.create(where, True)  # not before the counts are checked
            for at in range(0, len(data), CHUNK):
                out.write(bytearray(data[at : at + CHUNK]))
    finally:
        if out is not None:
            out.close()


def read_graph(spark: SparkSession, path: str, limits: ReadLimits = ReadLimits()) -> tuple[DataFrame, DataFrame]:
    """``islands`` (with polygons and edge indices) and ``edges`` of a file, decoded
    by a task, as the file's records are found and checked one after the other; its
    memory is bounded by ``limits``.  What is wrong with a file shows when rows are asked for."""

    def rows(edges_wanted: bool, ddl: str) -> DataFrame:
        names = [f.split(" ")[0] for f in ddl.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(0):
                    islands, edges = checked(data.as_buffer(), limits)
                    if edges_wanted:
                        deque(islands, maxlen=0)  # no edge of a file whose islands are wrong
                    for part in batched(edges if edges_wanted else islands, BATCH):
                        yield pa.RecordBatch.from_pydict({c: [r[c] for r in part] for c in names}, schema=schema)

        schema = to_arrow_schema(StructType.fromDDL(ddl))
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ddl)

    return rows(False, ISLAND_DDL), rows(True, EDGE_DDL)


class GraphFileSource(DataSource):
    """``spark.read.format("islandgraph").option("table", "edges").load(path)``.

    ``table`` is ``islands`` or ``edges``; ``path`` must be a mounted one.  The
    limits are the options ``maxislands``, ``maxelements``, ``maxallocation``.
    """

    @classmethod
    def name(cls) -> str:
        return "islandgraph"

    def schema(self) -> str:
        return EDGE_DDL if self.options.get("table", "islands") == "edges" else ISLAND_DDL

    def reader(self, schema) -> DataSourceReader:
        return _GraphFileReader(dict(self.options))


class _GraphFileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.options["path"])]

    def read(self, partition: InputPartition):
        given = {k.lower(): v for k, v in self.options.items()}
        d = ReadLimits()
        limits = ReadLimits(int(given.get("maxislands", d.islands)), int(given.get("maxelements", d.elements)), int(given.get("maxallocation", d.allocation)))
        with open(partition.value.removeprefix("file://"), "rb") as file:
            islands, edges = decode(file.read(), limits)
        edges_wanted = given.get("table", "islands") == "edges"
        ddl = EDGE_DDL if edges_wanted else ISLAND_DDL
        for row in edges if edges_wanted else islands:
            yield tuple(row[f.split(" ")[0]] for f in ddl.split(", "))
