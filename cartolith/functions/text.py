"""Geometry text: well-known text and GeoJSON, read and written."""

from __future__ import annotations

import json
import re
from json.encoder import encode_basestring as _quoted

from cartolith.functions.geometry import Geometry
from cartolith.functions.numbers import json_text, plain_text

NESTING = {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}
WORDS = {None: "null", False: "false", True: "true"}
NAMES = {k.upper(): k for k in (*NESTING, "GeometryCollection")}
TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


# A number written as plain_text and json_text write it but for a last ".0": up to 15 digits, so each text is another double's shortest.
_NUMBER = r"-?(?:0\.(?:0|0{0,3}[1-9](?:[0-9]{0,9}[1-9])?)|[1-9][0-9]{0,4}\.(?:0|[0-9]{0,9}[1-9]))"
PLAIN_LINE = re.compile(rf"LINESTRING\({_NUMBER} {_NUMBER}(?:,{_NUMBER} {_NUMBER})+\)")


def plain_line(text: str) -> tuple[str, list[float]] | None:
    """(write_wkt of it, its numbers) of a line of plain numbers, without a token at a time; None of others, which read_wkt reads."""
    if not PLAIN_LINE.fullmatch(text):
        return None
    return text.replace(".0 ", " ").replace(".0,", ",").replace(".0)", ")"), list(map(float, text[11:-1].replace(",", " ").split(" ")))


def read_wkt(text: str) -> list[Geometry]:
    """All items of a text; ValueError if it isn't well-known text. Z and M values are left out."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError("not well-known text")
        tokens.append(m[1])
        at = m.end()
    i = 0

    def peek() -> str:
        return tokens[i].upper() if i < len(tokens) else ""

    def take(want: str | None = None) -> str:
        nonlocal i
        if i >= len(tokens) or want and tokens[i].upper() != want:
            raise ValueError("not well-known text")
        i += 1
        return tokens[i - 1]

    def position() -> list[float]:
        out = []
        while peek() not in (",", ")", "(", ""):
            out.append(float(take()))
        if len(out) < 2:
            raise ValueError("a position needs two numbers")
        return out[:2]

    def nested(depth: int, loose: bool = False) -> list:
        if peek() == "EMPTY":
            take()
            return []
        take("(")
        out = []
        while True:
            if depth == 1:
                if loose and peek() == "(":
                    take("(")
                    out.append(position())
                    take(")")
                else:
                    out.append(position())
            else:
                out.append(nested(depth - 1))
            if take() == ")":
                return out
            if tokens[i - 1] != ",":
                raise ValueError("not well-known text")

    def item() -> Geometry:
        kind = NAMES.get(take().upper())
        if kind is None:
            raise ValueError("an unknown type of geometry")
        if peek() in ("Z", "M", "ZM"):
            take()
        if kind == "GeometryCollection":
            if peek() == "EMPTY":
                take()
                return (kind, [])
            take("(")
            parts = [item()]
            while take() == ",":
                parts.append(item())
            if tokens[i - 1] != ")":
                raise ValueError("not well-known text")
            return (kind, parts)
        if kind == "Point":
            out = nested(1)
            if len(out) > 1:
                raise ValueError("a point has one position")
            return (kind, out[0] if out else [])
        return (kind, nested(NESTING[kind], kind == "MultiPoint"))

    out = []
    while i < len(tokens):
        out.append(item())
    if not out:
        raise ValueError("no geometry")
    return out


def _list(parts: list[str]) -> str:
    return "(" + ",".join(parts) + ")"


def _floats(c: list) -> str | None:
    """repr of a list of positions of two doubles each, if none of its numbers has an exponent: they are all written at once."""
    flat = [v for p in c for v in p]
    if len(flat) != 2 * len(c) or set(map(type, flat)) != {float} or set(map(len, c)) != {2}:
        return None
    text = repr([*map(list, c)])
    return None if "e" in text or "n" in text else text


def write_wkt(g: Geometry) -> str:
    def body(kind: str, c: list) -> str:
        if not c:
            return " EMPTY"
        if kind == "Point":
            return _list([" ".join(map(plain_text, c[:2]))])
        if kind == "LineString":
            if text := _floats(c):
                return "(" + f"{text[2:-2]})".replace("], [", ",").replace(", ", " ").replace(".0 ", " ").replace(".0,", ",").replace(".0)", ")")
            return _list([" ".join(map(plain_text, p[:2])) for p in c])
        if kind == "Polygon":
            return _list([body("LineString", r).strip() for r in c])
        return _list([body(kind[5:], part).strip() for part in c])

    kind, c = g
    if kind == "GeometryCollection":
        return kind.upper() + (_list([write_wkt(part) for part in c]) if c else " EMPTY")
    return kind.upper() + body(kind, c)


def _finite(c: object, depth: int) -> list:
    if not isinstance(c, list):
        raise ValueError("coordinates are not a list")
    if depth == 0:
        if len(c) < 2 or any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in c):
            raise ValueError("a position needs two numbers")
        return [float(c[0]), float(c[1])]
    return [_finite(x, depth - 1) for x in c]


def geometry_of(value: object) -> Geometry:
    """Of a parsed GeoJSON geometry; ValueError if it is none."""
    if not isinstance(value, dict):
        raise ValueError("a geometry is an object")
    kind = value.get("type")
    if kind == "GeometryCollection":
        parts = value.get("geometries")
        if not isinstance(parts, list):
            raise ValueError("a collection needs geometries")
        return (kind, [geometry_of(x) for x in parts])
    if kind not in NESTING:
        raise ValueError("an unknown type of geometry")
    return (kind, _finite(value.get("coordinates"), NESTING[kind]))


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces."""
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, dict):
        return "{" + ",".join([f"{_quoted(k)}:{canonical(value[k])}" for k in sorted(value)]) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return json_text(value)
    return WORDS[value] if value is None or isinstance(value, bool) else str(value)


def _coordinates(c: list) -> str:
    return "[" + ",".join(json_text(x) if isinstance(x, (int, float)) else _coordinates(x) for x in c) + "]"


def write_geometry(g: Geometry) -> str:
    kind, c = g
    if kind == "GeometryCollection":
        return '{"geometries":[' + ",".join(map(write_geometry, c)) + '],"type":"GeometryCollection"}'
    text = _floats(c) if kind == "LineString" and c else None
    return f'{{"coordinates":{text.replace(" ", "") if text else _coordinates(c)},"type":"{kind}"}}'


def write_feature(g: Geometry, props: str = "{}", bbox: tuple | None = None) -> str:
    """props: canonical JSON of the properties."""
    head = f'"bbox":{_coordinates(list(bbox))},' if bbox else ""
    return f'{{{head}"geometry":{write_geometry(g)},"properties":{props},"type":"Feature"}}'


def read_geojson(text: str) -> list[tuple[str, Geometry | None, str, str | None, str | None]]:
    """(kind, geometry, properties, raw, error) of each geometry or feature; raw is null where the line itself is meant."""
    value = json.loads(text)
    kind = value.get("type") if isinstance(value, dict) else None
    features = value.get("features") if kind == "FeatureCollection" else [value] if kind == "Feature" else None
    if features is None:
        return [("GeoJSON Geometry", geometry_of(value), "{}", None, None)]
    if not isinstance(features, list):
        raise ValueError("a collection needs features")
    out = []
    for f in features:
        if not isinstance(f, dict) or f.get("type") != "Feature":
            raise ValueError("not a feature")
        raw = canonical(f) if kind == "FeatureCollection" else None
        props = canonical(f.get("properties") or {})
        if f.get("geometry") is None:
            out.append(("GeoJSON Feature", None, props, raw, "a feature without a geometry"))
        else:
            out.append(("GeoJSON Feature", geometry_of(f["geometry"]), props, raw, None))
    return out
