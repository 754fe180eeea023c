"""Parsing and writing of texts: coordinates, tags, map extracts, tracks, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"(-?\d+(?:[.]\d+)?)"


def parse_lat_lon(text: Column) -> Column:
    """struct(lat, lon) of "lat, lon" (comma, semicolon or space between, decimal comma
    allowed with a semicolon or space), or null if out of range or something else."""
    plain = F.when(text.contains(";") | ~text.rlike(r"\d\s*,\s*-?\d+\.|\.\d+\s*,"), F.regexp_replace(text, r"(\d),(\d)", "$1.$2")).otherwise(text)
    pattern = rf"^\s*{NUMBER}\s*[,;\s]\s*{NUMBER}\s*$"
    lat, lon = (F.nullif(F.regexp_extract(plain, pattern, k), F.lit("")).try_cast("double") for k in (1, 2))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def tag_map(text: Column) -> Column:
    """``k=v,k=v`` as a map; ``%xx%`` escapes of separators are undone."""
    pairs = F.filter(F.split(text, ","), lambda p: F.instr(p, "=") > 0)
    undo = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "%20%", " "), "%2c%", ","), "%3d%", "=")
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(undo(F.substring_index(p, "=", 1)), undo(F.regexp_replace(p, "^[^=]*=", "")))))


def read_opl(lines: DataFrame, column: str = "value") -> DataFrame:
    """(kind, id, tags, nodes, members) of the ways and relations in OPL text lines."""
    field = lambda letter: F.nullif(F.regexp_extract(F.col(column), rf"(?:^| ){letter}(\S*)", 1), F.lit(""))
    rows = lines.where(F.col(column).rlike("^[wr]"))
    kind = F.substring(F.col(column), 1, 1)
    nodes = F.expr(f"regexp_extract_all({column}, 'n(\\\\d+)x(-?[0-9.]+)y(-?[0-9.]+)', 0)")
    points = F.transform(nodes, lambda p: F.struct(F.regexp_extract(p, r"n(\d+)", 1).cast("bigint").alias("node"), F.regexp_extract(p, r"x(-?[0-9.]+)", 1).cast("double").alias("lon"), F.regexp_extract(p, r"y(-?[0-9.]+)", 1).cast("double").alias("lat")))
    members = F.transform(F.expr(f"regexp_extract_all({column}, '(?:M|,)([nwr]\\\\d+)@', 1)"), lambda m: F.struct(F.substring(m, 1, 1).alias("type"), F.regexp_replace(m, "^[nwr]", "").cast("bigint").alias("id")))
    return rows.select(kind.alias("kind"), F.regexp_extract(column, r"^[wr](\d+)", 1).cast("bigint").alias("id"), tag_map(F.coalesce(field("T"), F.lit(""))).alias("tags"), points.alias("nodes"), members.alias("members"))


def is_unpaved(tags: Column) -> Column:
    """A way without a hard surface."""
    surface = F.trim(F.substring_index(F.coalesce(F.try_element_at(tags, F.lit("surface")), F.lit("")), ";", 1))
    highway, grade = F.try_element_at(tags, F.lit("highway")), F.try_element_at(tags, F.lit("tracktype"))
    #: Surfaces of open ground.
    soft = surface.isin("unpaved", "compacted", "fine_gravel", "gravel", "pebblestone", "dirt", "earth", "ground", "grass", "mud", "sand", "woodchips", "rock", "clay", "soil", "stone")
    return F.coalesce(soft | ((surface == "") & ((highway.isin("path", "bridleway")) | ((highway == "track") & (F.coalesce(grade, F.lit("")) != "grade1")))), F.lit(False))


def geojson_line(coords: Column) -> Column:
    return F.to_json(F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")))


def gpx(name: Column, points: Column) -> Column:
    """A GPX 1.1 document of an array of (lat, lon, ele)."""
    safe = F.replace(F.replace(F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    point = lambda p: F.format_string('<trkpt lat="%.7f" lon="%.7f"><ele>%.1f</ele></trkpt>', p["lat"], p["lon"], p["ele"])
    head = '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="switchback" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'
    return F.concat(F.lit(head), safe, F.lit("</name><trkseg>"), F.array_join(F.transform(points, point), ""), F.lit("</trkseg></trk></gpx>"))


def track_json(points: Column) -> Column:
    """Parallel arrays of a track with six decimals of degrees and one of metres."""
    part = lambda name, digits: F.transform(points, lambda p: F.round(p[name], digits)).alias(name)
    return F.to_json(F.struct(part("lat", 6), part("lon", 6), part("ele", 1)))
