"""Writers: atomic small files, CSV with JSON cells, Markdown, GeoJSON, manifests, page snapshots."""

from __future__ import annotations

import hashlib
import html
import io
import json
import os
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from landweave.sources.files import names, read_bytes


def write_text(path: str | Path, text: str) -> None:
    """A small file, whole or not at all: written beside, flushed, renamed. The path may be a URI."""
    if ":/" in str(path):
        from pyarrow import fs

        system, inside = fs.FileSystem.from_uri(str(path))
        beside = f"{inside.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        system.create_dir(inside.rpartition("/")[0], recursive=True)
        with system.open_output_stream(beside) as out:
            out.write(text.encode())
        system.move(beside, inside)
        return
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_json(path: str | Path, data: object) -> None:
    write_text(path, json.dumps(data, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def flat(df: DataFrame) -> DataFrame:
    """Maps, structs and arrays as JSON text, for formats without them."""
    nested = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("map", "struct", "array"))}
    return df.withColumns(nested) if nested else df


def write_csv(df: DataFrame, path: str, *, one_file: bool = False) -> None:
    """CSV with a header; ``one_file`` is for small reports only."""
    rows = flat(df)
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_parquet(df: DataFrame, path: str, *, by: Sequence[str] = ()) -> None:
    """Parquet, partitioned by columns so that readers prune files."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def table_columns(rows: Sequence[Mapping[str, object]], first: Sequence[str]) -> list[str]:
    """The given columns, then all others of the rows by name."""
    return [*first, *sorted({k for r in rows for k in r} - set(first))]


def markdown_line(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One Markdown table row per row: pipes escaped, line breaks as ``<br>``, null as nothing."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", "<br>")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))


def markdown_table(df: DataFrame, columns: Sequence[str], most: int = 10_000) -> str:
    """A report table as Markdown; more than ``most`` rows are refused, as a report is small."""
    lines = [r["line"] for r in markdown_line(df, columns).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"more than {most} rows")
    if not lines:
        return "No rows.\n"
    head = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join([*head, *lines]) + "\n"


def write_report(df: DataFrame, folder: str, name: str, columns: Sequence[str], title: str) -> None:
    """A small table as CSV and as Markdown."""
    write_csv(df.select(*columns), f"{folder}/{name}.csv", one_file=True)
    write_text(f"{folder}/{name}.md", f"# {title}\n\n{markdown_table(df, columns)}")


def geojson_features(df: DataFrame, geometry: str, properties: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One GeoJSON feature per row from WKT polygons, as text; ``write.text`` keeps it distributed."""
    body = F.regexp_replace(F.col(geometry), r"^\s*(MULTI)?POLYGON\s*", "")
    pairs = F.regexp_replace(body, r"(-?[\d.eE+-]+)\s+(-?[\d.eE+-]+)", "[$1, $2]")
    nested = F.translate(pairs, "()", "[]")
    kind = F.when(F.col(geometry).startswith("MULTI"), "MultiPolygon").otherwise("Polygon")
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return df.select(*keep, F.concat(F.lit('{"type": "Feature", "properties": '), props, F.lit(', "geometry": {"type": "'), kind, F.lit('", "coordinates": '), nested, F.lit("}}")).alias("value"))


def file_digests(df_spark, folder: str) -> DataFrame:  # noqa: ANN001
    """``name, bytes, sha256`` of all files of a folder, hashed where they lie."""
    files = df_spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_manifest(path: str, parts: Mapping[str, str], **facts: object) -> None:
    """Facts of a run with the SHA-256 of small artifacts, on any file system."""
    digests = {n: hashlib.sha256(read_bytes(p)).hexdigest() for n, p in parts.items()}
    write_json(path, {**facts, "sha256": digests})


# ---- JSON as folders of parts ------------------------------------------------------------------


def _parts(df: DataFrame, key: str, item: Column, path: str, frame: tuple[str, str], rows: int) -> None:
    n = df.count()
    buckets = max(1, -(-n // rows))
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
    # a bucket has about so many rows at any size of the table
    held = df.select(bucket, F.struct(F.col(key).alias("key"), item.alias("item")).alias("e")).groupBy("bucket").agg(F.array_sort(F.collect_list("e")).alias("items"))
    text = F.concat(F.lit(frame[0]), F.array_join(F.transform("items", lambda e: e["item"]), ",\n"), F.lit(frame[1]))
    held.select("bucket", text.alias("value")).write.mode("overwrite").partitionBy("bucket").text(path)


def _object(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns))


def write_json_map(df: DataFrame, key: str, path: str, *, columns: Sequence[str] = (), rows: int = 10_000) -> None:
    """``{"key": {...}, ...}`` in parts: a folder of JSON objects of about ``rows`` members each, which readers take for one.

    Null keys are left out, null fields as well.
    """
    known = df.where(F.col(key).isNotNull())
    name = F.regexp_replace(F.to_json(F.array(F.col(key).cast("string"))), r"^\[|\]$", "")
    _parts(known, key, F.concat(name, F.lit(": "), _object(known.select(*(columns or known.columns)))), path, ("{", "}"), rows)


def write_json_list(df: DataFrame, key: str, path: str, *, rows: int = 10_000) -> None:
    """``[{...}, ...]`` in parts, in the order of ``key`` within a part."""
    _parts(df, key, _object(df), path, ("[", "]"), rows)


def write_geojson(df: DataFrame, key: str, geometry: str, properties: Sequence[str], path: str, *, rows: int = 10_000) -> None:
    """Feature collections in parts."""
    features = geojson_features(df, geometry, properties, keep=[key])
    _parts(features, key, F.col("value"), path, ('{"type": "FeatureCollection", "features": [', "]}"), rows)


# ---- arrays and maps ---------------------------------------------------------------------------


def write_npz(df: DataFrame, key: str, vector: str, path: str) -> DataFrame:
    """``file, n``: keys and vectors as ``.npz`` files of arrays ``key`` and ``vector``, one per batch of rows, named by their keys.

    A batch that is written again has the same name and content. Null keys and vectors are left out.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, inside = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        system.create_dir(inside, recursive=True)
        for batch in batches:
            if len(batch):
                held = io.BytesIO()
                np.savez_compressed(held, key=batch["key"].to_numpy(), vector=np.stack(batch["vector"].to_numpy()))
                name = hashlib.md5("\n".join(map(str, batch["key"])).encode()).hexdigest() + ".npz"
                with system.open_output_stream(f"{inside}/{name}") as out:
                    out.write(held.getvalue())
                yield pd.DataFrame({"file": [name], "n": [len(batch)]})

    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    return rows.mapInPandas(write, "file string, n long")


#: What draws a shape and a point on the canvas of a page, once the bounds ``x0, x1, y0, y1`` are known.
_DRAWING = """
const k = Math.cos((y0 + y1) / 2 * Math.PI / 180);
const c = document.getElementById("map"), g = c.getContext("2d"), s = Math.min(c.width / ((x1 - x0) * k || 1), c.height / (y1 - y0 || 1));
const at = p => [(p[0] - x0) * k * s, c.height - (p[1] - y0) * s];
const shape = f => {
  const rings = f.geometry.type === "Polygon" ? f.geometry.coordinates : f.geometry.coordinates.flat();
  const hue = [...JSON.stringify(f.properties[colour] ?? "")].reduce((h, ch) => (h * 31 + ch.charCodeAt(0)) % 360, 7);
  g.beginPath();
  for (const r of rings) { r.forEach((p, i) => i ? g.lineTo(...at(p)) : g.moveTo(...at(p))); g.closePath(); }
  g.fillStyle = `hsla(${hue}, 60%, 60%, 0.6)`; g.strokeStyle = "#444"; g.lineWidth = 0.3; g.fill("evenodd"); g.stroke();
};
const mark = m => { const [x, y] = at(m); g.fillStyle = "#b00"; g.fillRect(x - 1, y - 1, 3, 3); };
"""


def _page(title: str, script: str, parts: Sequence[str] = ()) -> str:
    drawn = "".join(f'<script src="{html.escape(p)}"></script>\n' for p in parts)
    return f'<!doctype html>\n<meta charset="utf-8">\n<title>{html.escape(title)}</title>\n<canvas id="map" width="1200" height="900"></canvas>\n<script>\n{script}</script>\n{drawn}'


def map_page(df: DataFrame, geometry: str, properties: Sequence[str], title: str, *, points: DataFrame | None = None, most: int = 50_000) -> str:
    """A page that draws polygons (WKT) and points (``lon, lat, title``) with nothing but itself; no tiles, no libraries.

    A page of one file is for looking at: more than ``most`` shapes are refused, ``write_map_parts`` takes any number.
    """
    shapes = [r["value"] for r in geojson_features(df, geometry, properties).limit(most + 1).collect()]
    marks = [[r["lon"], r["lat"], r["title"]] for r in points.select("lon", "lat", "title").limit(most + 1).collect()] if points is not None else []
    if len(shapes) > most or len(marks) > most:
        raise ValueError(f"more than {most} shapes")
    safe = lambda text: text.replace("</", "<\\/")
    bounds = """
const all = shapes.flatMap(f => f.geometry.type === "Polygon" ? f.geometry.coordinates : f.geometry.coordinates.flat());
const xs = all.flat().map(p => p[0]).concat(marks.map(m => m[0])), ys = all.flat().map(p => p[1]).concat(marks.map(m => m[1]));
const least = v => v.reduce((a, b) => Math.min(a, b), Infinity), most = v => v.reduce((a, b) => Math.max(a, b), -Infinity);
const x0 = least(xs), x1 = most(xs), y0 = least(ys), y1 = most(ys);"""
    colour = json.dumps(properties[-1] if properties else "")
    data = f"const shapes = [{safe(','.join(shapes))}], marks = {safe(json.dumps(marks, ensure_ascii=False))}, colour = {colour};"
    return _page(title, f"{data}{bounds}{_DRAWING}shapes.forEach(shape);\nmarks.forEach(mark);\n")


def write_map(df: DataFrame, geometry: str, properties: Sequence[str], path: str, title: str, *, points: DataFrame | None = None) -> None:
    """The page as a file, whole or not at all."""
    write_text(path, map_page(df, geometry, properties, title, points=points))


def write_map_parts(df: DataFrame, geometry: str, properties: Sequence[str], path: str, title: str, *, points: DataFrame | None = None, rows: int = 50_000) -> None:
    """The page for any number of shapes: a folder of ``index.html`` and of parts of at most ``rows`` shapes or points each.

    The parts are written where the rows lie; the page draws one after the other. Only the bounds
    and the names of the parts reach the driver. ``index.html`` comes last, so a page that is
    there is whole. A null or empty geometry is a shape without rings; points without a place are left out.
    """
    wkt = F.regexp_replace(F.coalesce(F.col(geometry), F.lit("POLYGON EMPTY")), "EMPTY", "()")
    number = lambda n: F.transform(F.regexp_extract_all(F.col(geometry), F.lit(r"(-?[\d.eE+-]+)\s+(-?[\d.eE+-]+)"), n), lambda t: t.cast("double"))
    kinds = {"shapes": (df.withColumn(geometry, wkt), F.array_min(number(1)), F.array_max(number(1)), F.array_min(number(2)), F.array_max(number(2)))}
    if points is not None:
        kinds["marks"] = (points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()), F.col("lon"), F.col("lon"), F.col("lat"), F.col("lat"))
    bounds, parts = [], []
    for name, (found, west, east, south, north) in kinds.items():
        seen = Observation()
        found = found.observe(seen, F.min(west).alias("x0"), F.max(east).alias("x1"), F.min(south).alias("y0"), F.max(north).alias("y1"))
        if name == "shapes":
            lines = geojson_features(found, geometry, properties).select(F.concat(F.lit("shape("), "value", F.lit(");")))
        else:
            called = F.regexp_replace(F.to_json(F.array("title")), r"^\[|\]$", "")
            lines = found.select(F.concat(F.lit("mark(["), F.concat_ws(", ", F.col("lon").cast("string"), F.col("lat").cast("string"), called), F.lit("]);")))
        lines.write.mode("overwrite").option("maxRecordsPerFile", rows).text(f"{path}/{name}")
        bounds.append(seen.get)
        parts += [f"{name}/{n}" for n in names(f"{path}/{name}") if n.startswith("part-")]
    edge = lambda of, n: of((b[n] for b in bounds if b.get(n) is not None), default=0.0)
    x0, x1, y0, y1 = edge(min, "x0"), edge(max, "x1"), edge(min, "y0"), edge(max, "y1")
    colour = json.dumps(properties[-1] if properties else "")
    write_text(f"{path}/index.html", _page(title, f"const x0 = {x0}, x1 = {x1}, y0 = {y0}, y1 = {y1}, colour = {colour};{_DRAWING}", parts))
