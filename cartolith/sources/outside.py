"""Ends of the engine outside the cluster: a map page, and the place of this machine."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame

from cartolith.functions.text import write_feature
from cartolith.operators.aggregate import feature_collection

PAGE = """<!doctype html>
<meta charset="utf-8"><title>Features</title>
<svg id="map" width="960" height="480" viewBox="-180 -90 360 180" style="border:1px solid #999"></svg>
<script>
const data = %s;
const map = document.getElementById("map");
function draw(g) {
  if (!g) return;
  if (g.type === "GeometryCollection") return g.geometries.forEach(draw);
  const at = p => p[0] + "," + -p[1];
  const depth = { Point: 0, MultiPoint: 1, LineString: 1, MultiLineString: 2, Polygon: 2, MultiPolygon: 3 }[g.type];
  const lines = depth === 0 ? [[g.coordinates]] : depth === 1 ? [g.coordinates] : depth === 2 ? g.coordinates : g.coordinates.flat();
  for (const line of lines) {
    const e = document.createElementNS("http://www.w3.org/2000/svg", g.type.endsWith("Point") ? "path" : "polyline");
    if (g.type.endsWith("Point")) e.setAttribute("d", line.map(p => "M" + at(p) + "h0.01").join(""));
    else e.setAttribute("points", line.map(at).join(" "));
    e.setAttribute("style", "fill:none;stroke:#c30;stroke-width:0.6;stroke-linecap:round");
    map.appendChild(e);
  }
}
data.features.forEach(f => draw(f.geometry));
</script>
"""


def write_map(df: DataFrame, path: str | None = None) -> str:
    """Entities as an HTML page on the driver's disk; its path. The page is not opened."""
    text = feature_collection(df).first()["collection"].replace("</", "<\\/")
    path = path or os.path.join(tempfile.gettempdir(), f"map_{int(time.time())}.html")
    with open(path, "w", encoding="utf-8") as f:
        f.write(PAGE % text)
    return path


def _fetch(url: str) -> str:
    with urllib.request.urlopen(url, timeout=10) as r:
        return r.read().decode()


def whereami(fetch: Callable[[str], str] = _fetch, url: str = "http://ip-api.com/json") -> str | None:
    """The GeoJSON Feature of this machine's public address; None, with a note on stderr, for an answer without a place."""
    try:
        answer = json.loads(fetch(url))
        return write_feature(("Point", [float(answer["lon"]), float(answer["lat"])]))
    except (KeyError, TypeError, ValueError) as e:
        print(f"no place in the answer: {e}", file=sys.stderr)
        return None
