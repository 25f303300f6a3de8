"""Geometry columns: schema, readers and writers, accessors.

A geometry is its type name and its atomic elements in depth-first order, empty ones included. Each
element has its path in the collection, its kind and its rings of coordinates; a point is [[p]], an
empty element [].
"""

from __future__ import annotations

import json
import math
import re
import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

ELEMENT = "struct<path:array<int>,kind:int,rings:array<array<struct<x:double,y:double>>>>"
GEOM = f"struct<type:string,elements:array<{ELEMENT}>>"
_COORDINATE = T.StructType([T.StructField(k, T.DoubleType()) for k in "xy"])
_ELEMENT = T.StructType(
    [T.StructField("path", T.ArrayType(T.IntegerType())), T.StructField("kind", T.IntegerType()), T.StructField("rings", T.ArrayType(T.ArrayType(_COORDINATE)))]
)
GEOM_TYPE = T.StructType([T.StructField("type", T.StringType()), T.StructField("elements", T.ArrayType(_ELEMENT))])
PARSED = T.StructType([T.StructField("geom", GEOM_TYPE), T.StructField("error", T.StringType())])

POINT, LINE, POLYGON = 0, 1, 2

# Type names of the standard with kind of their parts (None: any) and WKB codes.
TYPES = {
    "Point": (POINT, 1), "LineString": (LINE, 2), "Polygon": (POLYGON, 3), "MultiPoint": (POINT, 4),
    "MultiLineString": (LINE, 5), "MultiPolygon": (POLYGON, 6), "GeometryCollection": (None, 7),
}
_BY_TAG = {name.upper(): name for name in TYPES} | {"LINEARRING": "LineString"}
_BY_CODE = {code: name for name, (_, code) in TYPES.items()}
_TOKEN = re.compile(r"\s*([A-Za-z]+|[(),]|[-+]?(?:\d+/\d+|\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?|inf(?:inity)?|nan))", re.I)


class GeometryFormatError(ValueError):
    """Text or bytes that do not hold a geometry."""


def _element(path: list[int], kind: int, rings: list) -> dict:
    return {"path": path, "kind": kind, "rings": [[{"x": x, "y": y} for x, y in ring] for ring in rings]}


def _tokens(text: str) -> list[str]:
    text, out, at = re.sub(r"^\s*SRID\s*=\s*\d+\s*;", "", text, flags=re.I), [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise GeometryFormatError(f"unexpected character at {at}")
        out.append(m[1])
        at = m.end()
    return out


def read_wkt(text: str, ordinate=float) -> dict:
    """Well-known text (EWKT prefix, Z/M ordinates dropped, EMPTY anywhere) as a geometry; ``ordinate`` reads a number (fractions.Fraction: "n/d" too)."""
    todo = _tokens(text)[::-1]
    elements: list[dict] = []

    def take(what: str | None = None) -> str:
        if not todo:
            raise GeometryFormatError("text ends early")
        t = todo.pop()
        if what is not None and t != what:
            raise GeometryFormatError(f"expected {what}, found {t}")
        return t

    def empty() -> bool:
        if todo and todo[-1].upper() == "EMPTY":
            todo.pop()
            return True
        return False

    def number():
        try:
            return ordinate(take())
        except (ValueError, ZeroDivisionError) as e:
            raise GeometryFormatError(str(e)) from None

    def coordinate() -> tuple:
        xy = [number(), number()]
        while todo and todo[-1] not in ("(", ")", ","):
            number()
        return xy[0], xy[1]

    def listed(item) -> list:
        if empty():
            return []
        take("(")
        out = [item()]
        while todo and todo[-1] == ",":
            todo.pop()
            out.append(item())
        take(")")
        return out

    def maybe_bracketed() -> list:
        if empty():
            return []
        if todo and todo[-1] == "(":
            take("(")
            p = coordinate()
            take(")")
            return [p]
        return [coordinate()]

    def part(kind: int):
        if kind == POINT:
            p = listed(coordinate)
            if len(p) > 1:
                raise GeometryFormatError("a point has one coordinate")
            return [p] if p else []
        if kind == LINE:
            line = listed(coordinate)
            return [line] if line else []
        return listed(lambda: listed(coordinate))

    def geometry(path: list[int]) -> str:
        tag = take().upper()
        name = _BY_TAG.get(tag)
        if name is None and tag[-1:] in "ZM":
            name = _BY_TAG.get(tag.rstrip("ZM"))
        if name is None:
            raise GeometryFormatError(f"unknown type {tag}")
        if todo and todo[-1].upper() in ("Z", "M", "ZM"):
            todo.pop()
        kind = TYPES[name][0]
        if name == "GeometryCollection":
            count = iter(range(1 << 30))
            listed(lambda: geometry([*path, next(count)]))
        elif name.startswith("Multi"):
            items = listed(maybe_bracketed if kind == POINT else lambda: part(kind))
            for i, rings in enumerate(items):
                elements.append(_element([*path, i], kind, ([rings] if rings else []) if kind == POINT else rings))
        else:
            elements.append(_element(path, kind, part(kind)))
        return name

    name = geometry([])
    if todo:
        raise GeometryFormatError(f"text goes on after the geometry: {todo[-1]}")
    return {"type": name, "elements": elements}


def format_double(x: float) -> str:
    """Shortest text that reads back as the same double; whole numbers without a fraction."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Inf" if x > 0 else "-Inf"
    s = repr(float(x))
    return s[:-2] if s.endswith(".0") else s


def _tree(g: dict) -> list:
    """Parts of a geometry nested as its paths say: [type name or kind, children or rings]."""
    root: dict = {}
    for e in g["elements"]:
        at = root
        for k in e["path"]:
            at = at.setdefault(k, {})
        at["e"] = e
    return root


def to_wkt(g: dict) -> str:
    """Well-known text; nested collections keep their depth, a nested multi-type is written as a collection."""
    name = g["type"]
    ring = lambda r: "(" + ", ".join(f"{format_double(p['x'])} {format_double(p['y'])}" for p in r) + ")"

    def body(e: dict) -> str:
        if not len(e["rings"]):
            return "EMPTY"
        return ring(e["rings"][0]) if e["kind"] != POLYGON else "(" + ", ".join(map(ring, e["rings"])) + ")"

    def nested(at: dict) -> str:
        if "e" in at:
            return f"{('POINT', 'LINESTRING', 'POLYGON')[at['e']['kind']]} {body(at['e'])}"
        return "GEOMETRYCOLLECTION " + ("(" + ", ".join(nested(at[k]) for k in sorted(at)) + ")" if at else "EMPTY")

    if name == "GeometryCollection":
        return nested(_tree(g))
    if name.startswith("Multi"):
        return f"{name.upper()} " + ("(" + ", ".join(map(body, g["elements"])) + ")" if len(g["elements"]) else "EMPTY")
    return f"{name.upper()} {body(g['elements'][0])}"


def read_json(text: str) -> dict:
    """A typed-JSON geometry ({type, coordinates | geometries}) ; a bare array is a legacy multi-polygon."""
    elements: list[dict] = []

    def walk(g, path: list[int]) -> str:
        name = g.get("type")
        if name not in TYPES:
            raise GeometryFormatError(f"unknown type {name}")
        xy = lambda ps: [(float(p[0]), float(p[1])) for p in ps]
        kind = TYPES[name][0]
        if name == "GeometryCollection":
            for i, child in enumerate(g["geometries"]):
                walk(child, [*path, i])
            return name
        c = g["coordinates"]
        wrap = {POINT: lambda v: [xy([v])] if v else [], LINE: lambda v: [xy(v)] if v else [], POLYGON: lambda v: [xy(r) for r in v]}[kind]
        if name.startswith("Multi"):
            elements.extend(_element([*path, i], kind, wrap(v)) for i, v in enumerate(c))
        else:
            elements.append(_element(path, kind, wrap(c)))
        return name

    g = json.loads(text)
    if isinstance(g, list):
        g = {"type": "MultiPolygon", "coordinates": g} if len(g) != 1 else {"type": "Polygon", "coordinates": g[0]}
    try:
        return {"type": walk(g, []), "elements": elements}
    except (KeyError, TypeError, IndexError, AttributeError) as e:
        raise GeometryFormatError(f"not a geometry: {e}") from None


def to_json(g: dict) -> str:
    xy = lambda r: [[p["x"], p["y"]] for p in r]

    def coordinates(e: dict):
        rings = [xy(r) for r in e["rings"]]
        return rings if e["kind"] == POLYGON else (rings[0][0] if e["kind"] == POINT else rings[0]) if rings else []

    def nested(at: dict) -> dict:
        if "e" in at:
            return {"type": ("Point", "LineString", "Polygon")[at["e"]["kind"]], "coordinates": coordinates(at["e"])}
        return {"type": "GeometryCollection", "geometries": [nested(at[k]) for k in sorted(at)]}

    name = g["type"]
    if name == "GeometryCollection":
        return json.dumps(nested(_tree(g)))
    parts = [coordinates(e) for e in g["elements"]]
    return json.dumps({"type": name, "coordinates": parts if name.startswith("Multi") else parts[0]})


def read_wkb(data: bytes) -> dict:
    """Well-known binary, two-dimensional, either byte order; a point of NaNs is empty."""
    elements: list[dict] = []

    def walk(at: int, path: list[int]) -> tuple[int, str]:
        order = "<" if data[at] == 1 else ">"
        (code,) = struct.unpack_from(f"{order}I", data, at + 1)
        at += 5
        name = _BY_CODE.get(code)
        if name is None:
            raise GeometryFormatError(f"unknown code {code}")

        def count(at: int) -> tuple[int, int]:
            return at + 4, struct.unpack_from(f"{order}I", data, at)[0]

        def coordinates(at: int, n: int) -> tuple[int, list]:
            v = struct.unpack_from(f"{order}{2 * n}d", data, at)
            return at + 16 * n, list(zip(v[::2], v[1::2]))

        if name == "Point":
            at, p = coordinates(at, 1)
            elements.append(_element(path, POINT, [] if math.isnan(p[0][0]) and math.isnan(p[0][1]) else [p]))
        elif name == "LineString":
            at, n = count(at)
            at, line = coordinates(at, n)
            elements.append(_element(path, LINE, [line] if line else []))
        elif name == "Polygon":
            at, n = count(at)
            rings = []
            for _ in range(n):
                at, k = count(at)
                at, r = coordinates(at, k)
                rings.append(r)
            elements.append(_element(path, POLYGON, rings))
        else:
            at, n = count(at)
            for i in range(n):
                at, _ = walk(at, [*path, i])
        return at, name

    try:
        end, name = walk(0, [])
    except (struct.error, IndexError) as e:
        raise GeometryFormatError(str(e)) from None
    if end != len(data):
        raise GeometryFormatError("bytes go on after the geometry")
    return {"type": name, "elements": elements}


def to_wkb(g: dict) -> bytes:
    def part(e: dict) -> bytes:
        head = struct.pack("<BI", 1, (1, 2, 3)[e["kind"]])
        pack = lambda r: b"".join(struct.pack("<2d", p["x"], p["y"]) for p in r)
        rings = list(e["rings"])
        if e["kind"] == POINT:
            return head + (pack(rings[0]) if rings else struct.pack("<2d", math.nan, math.nan))
        if e["kind"] == LINE:
            line = rings[0] if rings else []
            return head + struct.pack("<I", len(line)) + pack(line)
        return head + struct.pack("<I", len(rings)) + b"".join(struct.pack("<I", len(r)) + pack(r) for r in rings)

    def nested(at: dict) -> bytes:
        if "e" in at:
            return part(at["e"])
        return struct.pack("<BII", 1, 7, len(at)) + b"".join(nested(at[k]) for k in sorted(at))

    name = g["type"]
    if name == "GeometryCollection":
        return nested(_tree(g))
    if name.startswith("Multi"):
        return struct.pack("<BII", 1, TYPES[name][1], len(g["elements"])) + b"".join(map(part, g["elements"]))
    return part(g["elements"][0])


def _reader(read):
    def parse(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            try:
                out.append((None if v is None else read(v), None))
            except (GeometryFormatError, json.JSONDecodeError) as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["geom", "error"], dtype=object)

    return F.pandas_udf(parse, PARSED)


def _writer(write, kind: T.DataType):
    """By Arrow: rings of unlike lengths have no form in pandas."""
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def text(values: pa.Array) -> pa.Array:
        return pa.array([None if r is None or r["type"] is None else write(r) for r in values.to_pylist()], arrow)

    return F.arrow_udf(text, kind)


st_parse_wkt = _reader(read_wkt)
st_parse_json = _reader(read_json)
st_parse_wkb = _reader(lambda b: read_wkb(bytes(b)))
st_astext = _writer(to_wkt, T.StringType())
st_asjson = _writer(to_json, T.StringType())
st_asbinary = _writer(to_wkb, T.BinaryType())


def _with_nans(g: Column) -> Column:
    """Arrow turns the NaNs of Python rows into nulls; ordinates are never null, so they are NaNs again."""
    nan = F.lit(float("nan"))
    return F.when(g.isNotNull(), st_mapcoords(g, lambda x, y: (F.coalesce(x, nan), F.coalesce(y, nan))))


def st_geomfromtext(text: Column) -> Column:
    """The geometry, null where the text holds none."""
    return _with_nans(st_parse_wkt(text)["geom"])


def st_geomfromjson(text: Column) -> Column:
    return _with_nans(st_parse_json(text)["geom"])


def st_geomfromwkb(data: Column) -> Column:
    return _with_nans(st_parse_wkb(data)["geom"])


def _flat(g: Column) -> Column:
    """All coordinates of a geometry in one array."""
    return F.flatten(F.flatten(F.transform(g["elements"], lambda e: e["rings"])))


def st_isempty(g: Column) -> Column:
    return F.size(_flat(g)) == 0


def st_numcoords(g: Column) -> Column:
    return F.size(_flat(g))


def st_dim(g: Column) -> Column:
    """Dimension of the type: of a collection, the largest of its elements, -1 without any."""
    of_parts = F.coalesce(F.array_max(F.transform(g["elements"], lambda e: e["kind"])), F.lit(-1))
    fixed = F.create_map(*(F.lit(x) for name, (kind, _) in TYPES.items() if kind is not None for x in (name, kind)))
    return F.coalesce(F.try_element_at(fixed, g["type"]), of_parts).cast("int")


def _same(p: Column, q: Column) -> Column:
    return (p["x"] == q["x"]) & (p["y"] == q["y"]) & ~F.isnan(p["x"]) & ~F.isnan(p["y"])


def _zero_length(line: Column) -> Column:
    return F.forall(line, lambda p: _same(p, F.get(line, F.lit(0))))


def st_realdim(g: Column) -> Column:
    """Dimension of what is not empty, a line without length counting as a point; -1 if all is empty."""
    of = lambda e: F.when(F.size(e["rings"]) == 0, -1).when((e["kind"] == LINE) & _zero_length(F.get(e["rings"], F.lit(0))), 0).otherwise(e["kind"])
    return F.coalesce(F.array_max(F.transform(g["elements"], of)), F.lit(-1)).cast("int")


def st_hasnonfinite(g: Column) -> Column:
    bad = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    return F.exists(_flat(g), lambda p: bad(p["x"]) | bad(p["y"]))


def st_mapcoords(g: Column, move) -> Column:
    """Apply ``move(x, y) -> (x, y)`` to every coordinate."""

    def point(p: Column) -> Column:
        x, y = move(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    def element(e: Column) -> Column:
        rings = F.transform(e["rings"], lambda r: F.transform(r, point))
        return F.struct(e["path"].alias("path"), e["kind"].alias("kind"), rings.alias("rings"))

    return F.struct(g["type"].alias("type"), F.transform(g["elements"], element).alias("elements"))


def st_maxabs(g: Column) -> Column:
    """Largest size of an ordinate."""
    return F.array_max(F.transform(_flat(g), lambda p: F.greatest(F.abs(p["x"]), F.abs(p["y"]))))


def polygon(*rings: list[tuple[Column, Column]]) -> Column:
    """A polygon column from coordinate columns; rings are given closed."""
    ring = lambda r: F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in r))
    element = F.struct(F.array().cast("array<int>").alias("path"), F.lit(POLYGON).alias("kind"), F.array(*map(ring, rings)).alias("rings"))
    return F.struct(F.lit("Polygon").alias("type"), F.array(element).alias("elements"))


def linestring(points: Column) -> Column:
    """A line column from an array of (x, y) structs."""
    element = F.struct(F.array().cast("array<int>").alias("path"), F.lit(LINE).alias("kind"), F.array(points).alias("rings"))
    return F.struct(F.lit("LineString").alias("type"), F.array(element).alias("elements"))


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return polygon([(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)])
