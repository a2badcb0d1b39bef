"""FlatGeobuf files: header, packed R-tree, features, by the format's public description; a writer, and a Spark data source to read.

A file holds the magic bytes, a size-prefixed header, the tree (40 bytes a node: four doubles, then for a leaf the place of its feature, for an inner
node the number of its first child; root first) and size-prefixed features in the order of a Hilbert curve. The reader splits the leaves
over tasks. With a bbox the driver descends from the root to the nodes of some thousand leaves, only those that meet the box become tasks, and each
task descends from there: of the tree, too, only what meets the box is read.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cartolith.functions.geometry import Geometry, box
from cartolith.functions.text import canonical, write_feature
from cartolith.operators import aggregate
from cartolith.operators.entities import geometry

# Fixed values of the format.
MAGIC = b"fgb\x03fgb\x00"
NODE_SIZE, NODE, NODE_BYTES = 16, "<4dQ", 40
GEOMETRY = ["Unknown", "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection"]
COLUMN = {"bool": 2, "long": 7, "double": 10, "string": 11, "json": 12}
WIDTHS = {0: "b", 1: "B", 2: "?", 3: "h", 4: "H", 5: "i", 6: "I", 7: "q", 8: "Q", 9: "f", 10: "d"}
LEAVES_PER_TASK = 50_000


# ---- flat buffers


class Builder:
    """Grows a buffer towards its front; places are counted from its end."""

    def __init__(self) -> None:
        self.b = b""

    def _pad(self, size: int, after: int = 0) -> None:
        self.b = bytes(-(len(self.b) + after) % size) + self.b

    def vector(self, form: str, values: list) -> int:
        raw = struct.pack(f"<{len(values)}{form}", *values)
        self._pad(4, len(raw))
        self._pad(struct.calcsize(form), len(raw))
        self.b = struct.pack("<I", len(values)) + raw + self.b
        return len(self.b)

    def text(self, s: str) -> int:
        raw = s.encode()
        self._pad(4, len(raw) + 1)
        self.b = struct.pack("<I", len(raw)) + raw + b"\0" + self.b
        return len(self.b)

    def _offset(self, place: int) -> None:
        self.b = struct.pack("<I", len(self.b) + 4 - place) + self.b

    def places(self, items: list[int]) -> int:
        self._pad(4, 4 * len(items))
        for place in reversed(items):
            self._offset(place)
        self.b = struct.pack("<I", len(items)) + self.b
        return len(self.b)

    def table(self, fields: dict[int, tuple[str, int | float]]) -> int:
        """fields: number to (form, value); form "@" is the place of another object."""
        start, at = len(self.b), {}
        for k, (form, value) in sorted(fields.items(), key=lambda x: -struct.calcsize("I" if x[1][0] == "@" else x[1][0])):
            size = struct.calcsize("I" if form == "@" else form)
            self._pad(size)
            if form == "@":
                self._offset(int(value))
            else:
                self.b = struct.pack(f"<{form}", value) + self.b
            at[k] = len(self.b)
        self._pad(4)
        self.b = bytes(4) + self.b
        place = len(self.b)
        n = max(fields, default=-1) + 1
        self.b = struct.pack(f"<{n + 2}H", 4 + 2 * n, place - start, *(place - at[k] if k in at else 0 for k in range(n))) + self.b
        i = len(self.b) - place
        self.b = self.b[:i] + struct.pack("<i", i) + self.b[i + 4 :]
        return place

    def finish(self, root: int) -> bytes:
        """The size-prefixed buffer."""
        self._pad(8, 4)
        self._offset(root)
        return struct.pack("<I", len(self.b)) + self.b


class Table:
    """Reads a table of a buffer."""

    def __init__(self, b: bytes, at: int):
        self.b, self.at = b, at
        vt = at - struct.unpack_from("<i", b, at)[0]
        size = struct.unpack_from("<H", b, vt)[0]
        self.fields = struct.unpack_from(f"<{(size - 4) // 2}H", b, vt + 4)

    @classmethod
    def root(cls, b: bytes) -> Table:
        return cls(b, struct.unpack_from("<I", b)[0])

    def _place(self, k: int) -> int:
        return self.at + self.fields[k] if k < len(self.fields) and self.fields[k] else 0

    def value(self, k: int, form: str, default: int = 0) -> int | float:
        p = self._place(k)
        return struct.unpack_from(f"<{form}", self.b, p)[0] if p else default

    def _target(self, k: int) -> int:
        p = self._place(k)
        return p + struct.unpack_from("<I", self.b, p)[0] if p else 0

    def vector(self, k: int, form: str) -> list:
        p = self._target(k)
        return list(struct.unpack_from(f"<{struct.unpack_from('<I', self.b, p)[0]}{form}", self.b, p + 4)) if p else []

    def text(self, k: int) -> str:
        return bytes(self.vector(k, "B")).decode()

    def table(self, k: int) -> Table | None:
        p = self._target(k)
        return Table(self.b, p) if p else None

    def tables(self, k: int) -> list[Table]:
        p = self._target(k)
        n = struct.unpack_from("<I", self.b, p)[0] if p else 0
        return [Table(self.b, q + struct.unpack_from("<I", self.b, q)[0]) for q in range(p + 4, p + 4 + 4 * n, 4)]


# ---- geometry and properties


def _flat(lines: list) -> tuple[list[float], list[int]]:
    xy, ends = [], []
    for line in lines:
        xy += [v for p in line for v in (p[0], p[1])]
        ends.append(len(xy) // 2)
    return xy, ends


def put_geometry(b: Builder, g: Geometry) -> int:
    kind, c = g
    code = GEOMETRY.index(kind)
    if kind in ("MultiPolygon", "GeometryCollection"):
        parts = b.places([put_geometry(b, part if kind == "GeometryCollection" else ("Polygon", part)) for part in c])
        return b.table({6: ("B", code), 7: ("@", parts)})
    lines = [[c]] if kind == "Point" else [c] if kind in ("LineString", "MultiPoint") else c
    if kind == "Point" and not c:
        lines = []
    xy, ends = _flat(lines)
    fields: dict[int, tuple[str, int | float]] = {1: ("@", b.vector("d", xy)), 6: ("B", code)}
    if len(ends) > 1:
        fields[0] = ("@", b.vector("I", ends))
    return b.table(fields)


def get_geometry(t: Table, code: int = 0) -> Geometry:
    kind = GEOMETRY[int(t.value(6, "B")) or code]
    if kind == "GeometryCollection":
        return (kind, [get_geometry(p) for p in t.tables(7)])
    if kind == "MultiPolygon":
        return (kind, [get_geometry(p, 3)[1] for p in t.tables(7)])
    v = t.vector(1, "d")
    ps = [[v[i], v[i + 1]] for i in range(0, len(v), 2)]
    if kind == "Point":
        return (kind, ps[0] if ps else [])
    if kind in ("LineString", "MultiPoint"):
        return (kind, ps)
    ends = t.vector(0, "I") or ([len(ps)] if ps else [])
    return (kind, [ps[a:e] for a, e in zip([0, *ends], ends, strict=False)])


def put_properties(props: dict, columns: list[tuple[str, str]]) -> bytes:
    """Column number and value of each; nulls are left out."""
    out = b""
    for i, (name, kind) in enumerate(columns):
        v = props.get(name)
        if v is None:
            continue
        out += struct.pack("<H", i)
        if kind in ("string", "json"):
            raw = (v if kind == "string" else canonical(v)).encode()
            out += struct.pack("<I", len(raw)) + raw
        else:
            out += struct.pack("<" + WIDTHS[COLUMN[kind]], v)
    return out


def get_properties(raw: bytes, columns: list[tuple[str, int]]) -> dict:
    out, at = {}, 0
    while at < len(raw):
        name, kind = columns[struct.unpack_from("<H", raw, at)[0]]
        at += 2
        if kind in WIDTHS:
            out[name] = struct.unpack_from("<" + WIDTHS[kind], raw, at)[0]
            at += struct.calcsize(WIDTHS[kind])
        else:
            n = struct.unpack_from("<I", raw, at)[0]
            text = raw[at + 4 : at + 4 + n]
            out[name] = json.loads(text) if kind == 12 else text.decode("utf-8", "replace")
            at += 4 + n
    return out


# ---- tree


def level_bounds(n: int, size: int = NODE_SIZE) -> list[tuple[int, int]]:
    """First and last-plus-one node of each level, leaves first; the root is node 0."""
    counts = [n]
    while counts[-1] > 1:
        counts.append(-(-counts[-1] // size))
    end, out = sum(counts), []
    for k in counts:
        out.append((end - k, end))
        end -= k
    return out


def build_tree(leaves: list[tuple[tuple[float, float, float, float], int]]) -> bytes:
    """The packed tree over (box, place) in order; every node lies within its parent."""
    if not leaves:
        return b""
    level, parts, bounds = leaves, [], level_bounds(len(leaves))
    for i, (first, _) in enumerate(bounds):
        parts.append(b"".join(struct.pack(NODE, *b, o) for b, o in level))
        if i + 1 < len(bounds):
            groups = [level[k : k + NODE_SIZE] for k in range(0, len(level), NODE_SIZE)]
            level = [((min(b[0] for b, _ in g), min(b[1] for b, _ in g), max(b[2] for b, _ in g), max(b[3] for b, _ in g)), first + NODE_SIZE * k) for k, g in enumerate(groups)]
    return b"".join(reversed(parts))


def search_tree(tree: bytes, n: int, want: tuple[float, float, float, float]) -> Iterator[tuple[int, int]]:
    """(number, place) of the leaves that meet a box."""
    if not n:
        return
    first_leaf, todo = level_bounds(n)[0][0], [(0, len(level_bounds(n)) - 1)]
    bounds = level_bounds(n)
    while todo:
        i, level = todo.pop()
        x0, y0, x1, y1, o = struct.unpack_from(NODE, tree, i * NODE_BYTES)
        if x0 > want[2] or x1 < want[0] or y0 > want[3] or y1 < want[1]:
            continue
        if level == 0:
            yield i - first_leaf, o
        else:
            todo += [(c, level - 1) for c in range(o, min(o + NODE_SIZE, bounds[level - 1][1]))]


# ---- files


def write_flatgeobuf(df: DataFrame, path: str, compat: bool = False) -> None:
    """Entities as one file on the driver's disk. Sorting and the schema run in Spark; the rows stream to the driver in order, and only the
    tree's leaves (40 bytes a feature) are held there."""
    rows = df.where("box is not null")
    kinds = sorted((r["name"], r["type"]) for r in aggregate.schema_infer(aggregate.properties(rows), compat).collect())
    kind = aggregate.geometry_type(rows).first()["gtype"]
    leaves: list[tuple[tuple, int]] = []
    with tempfile.TemporaryFile() as body:
        for r in aggregate.hilbert_sort(rows).select("lon", "lat", "box", "wkb", "props").toLocalIterator():
            g = geometry(r["lon"], r["lat"], tuple(r["box"]), r["wkb"])
            b = Builder()
            place = put_geometry(b, g)
            props = put_properties(json.loads(r["props"]), kinds)
            fields: dict[int, tuple[str, int | float]] = {0: ("@", place)}
            if props:
                fields[1] = ("@", b.vector("B", list(props)))
            leaves.append((box(g), body.tell()))
            body.write(b.finish(b.table(fields)))
        if not leaves:
            raise ValueError("NoInputGiven")
        b = Builder()
        columns = []
        for name, t in kinds:
            text = b.text(name)
            columns.append(b.table({0: ("@", text), 1: ("B", COLUMN[t])}))
        fields = {0: ("@", b.text("L1")), 2: ("B", GEOMETRY.index(kind)), 8: ("Q", len(leaves)), 9: ("H", NODE_SIZE)}
        ends = [f(x[0][i] for x in leaves) for i, f in enumerate((min, min, max, max))]
        fields[1] = ("@", b.vector("d", ends))
        if columns:
            fields[7] = ("@", b.places(columns))
        header = b.finish(b.table(fields))
        body.seek(0)
        with open(path + ".part", "wb") as out:
            out.write(MAGIC + header + build_tree(leaves))
            shutil.copyfileobj(body, out)
    os.replace(path + ".part", path)


def _apart(a: tuple, b: tuple) -> bool:
    return a[0] > b[2] or a[2] < b[0] or a[1] > b[3] or a[3] < b[1]


class File:
    def __init__(self, path: str):
        self.f = open(path, "rb")  # noqa: SIM115
        if self.f.read(8)[:3] != MAGIC[:3]:
            raise ValueError("not a FlatGeobuf file")
        size = struct.unpack("<I", self.f.read(4))[0]
        h = Table.root(self.f.read(size))
        self.kind, self.n, self.node = int(h.value(2, "B")), int(h.value(8, "Q")), int(h.value(9, "H", 16))
        self.envelope = h.vector(1, "d")
        self.columns = [(c.text(0), int(c.value(1, "B"))) for c in h.tables(7)]
        self.tree_at = 12 + size
        self.nodes = level_bounds(self.n, self.node)[0][1] if self.node and self.n else 0
        self.data = self.tree_at + self.nodes * NODE_BYTES

    def leaves(self, lo: int, hi: int) -> Iterator[tuple[tuple, int]]:
        """(box, place) of the leaves lo:hi."""
        self.f.seek(self.tree_at + (level_bounds(self.n, self.node)[0][0] + lo) * NODE_BYTES)
        raw = self.f.read((hi - lo) * NODE_BYTES)
        for x0, y0, x1, y1, o in struct.iter_unpack(NODE, raw):
            yield (x0, y0, x1, y1), o

    def search(self, want: tuple, down_to: int = 0, within: tuple[int, int] | None = None) -> Iterator[tuple[int, int]]:
        """(number within its level, place) of the nodes of a level (0: leaves) that meet a box, in order; within: leaves from and to, or all."""
        bounds = level_bounds(self.n, self.node)
        lo, hi = within or (0, self.n)
        todo = [(len(bounds) - 1, 0, 1)]
        while todo:
            level, a, b = todo.pop()
            under = self.node**level
            a, b = max(a, lo // under), min(b, -(-hi // under))
            self.f.seek(self.tree_at + (bounds[level][0] + a) * NODE_BYTES)
            below = []
            for i, (x0, y0, x1, y1, place) in enumerate(struct.iter_unpack(NODE, self.f.read(max(b - a, 0) * NODE_BYTES)), a):
                if not _apart((x0, y0, x1, y1), want):
                    if level == down_to:
                        yield i, place
                    else:
                        first, end = bounds[level - 1]
                        below.append((level - 1, i * self.node, min((i + 1) * self.node, end - first)))
            todo.extend(reversed(below))

    def feature(self, place: int) -> str:
        self.f.seek(self.data + place)
        t = Table.root(self.f.read(struct.unpack("<I", self.f.read(4))[0]))
        return write_feature(get_geometry(t.table(0), self.kind), canonical(get_properties(bytes(t.vector(1, "B")), self.columns)))

    def all(self) -> Iterator[str]:
        """Features one after the other: of a file without a tree."""
        place, end = 0, os.fstat(self.f.fileno()).st_size - self.data
        while place < end:
            self.f.seek(self.data + place)
            size = struct.unpack("<I", self.f.read(4))[0]
            yield self.feature(place)
            place += 4 + size


class FlatGeobufSource(DataSource):
    """spark.read.format("flatgeobuf").option("bbox", "minx,miny,maxx,maxy").load(path): one Feature per row, for entities.parse."""

    @classmethod
    def name(cls) -> str:
        return "flatgeobuf"

    def schema(self) -> str:
        return "line_no long, feature string"

    def reader(self, schema: object) -> DataSourceReader:
        want = self.options.get("bbox")
        ends = tuple(float(x) for x in want.split(",")) if want else None
        if ends is not None and len(ends) != 4:
            raise ValueError("InvalidInput: a bbox has four numbers")
        return _Reader(self.options["path"], ends)


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, path: str, want: tuple | None):
        self.path, self.want = path, want

    def partitions(self) -> list[_Range]:
        file = File(self.path)
        if not file.nodes:
            return [_Range(0, -1)]
        if self.want is not None:
            level = 0
            while file.node ** (level + 1) <= LEAVES_PER_TASK and level + 1 < len(level_bounds(file.n, file.node)):
                level += 1
            under, out, held = file.node**level, [], 0
            for i, _ in file.search(self.want, level):
                if not out or held + under > LEAVES_PER_TASK:
                    out.append(_Range(i * under, 0))
                    held = 0
                out[-1].hi, held = min(file.n, (i + 1) * under), held + under
            return out or [_Range(0, 0)]
        return [_Range(lo, min(file.n, lo + LEAVES_PER_TASK)) for lo in range(0, file.n, LEAVES_PER_TASK)]

    def read(self, part: _Range) -> Iterator[tuple]:
        file, w = File(self.path), self.want
        if part.hi < 0:
            for i, text in enumerate(file.all()):
                g = json.loads(text)
                b = box((g["geometry"]["type"], g["geometry"].get("coordinates", []))) if w and g["geometry"]["type"] != "GeometryCollection" else None
                if b is None or not _apart(b, w):
                    yield (i, text)
            return
        found = file.search(w, 0, (part.lo, part.hi)) if w is not None else ((i, place) for i, (_, place) in enumerate(list(file.leaves(part.lo, part.hi)), part.lo))
        for i, place in list(found):
            yield (i, file.feature(place))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FlatGeobufSource)


def read_flatgeobuf(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("flatgeobuf")
    if bbox is not None:
        reader = reader.option("bbox", ",".join(map(str, bbox)))
    return reader.load(path).select("line_no", F.col("feature").alias("value"))
