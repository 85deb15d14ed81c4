"""Survey text files, flight logs, camera libraries, rational-model sidecars, project documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import european_float

# The names that files may give a column of each role, as letters and digits. In Lo systems x and y change places.
ALIASES = {
    "id": ["id", "point", "pointid", "pointno", "pointnum", "pointnumber", "pointname", "name", "station", "stationid", "stationno", "no", "nr", "number", "label", "pt", "ptid", "ptno", "beacon", "mark", "target", "gcp", "gcpid", "code", "descriptor"],
    "x": ["x", "easting", "east", "e", "lon", "long", "longitude", "ylo", "xcoord"],
    "y": ["y", "northing", "north", "n", "lat", "latitude", "xlo", "ycoord"],
    "z": ["z", "elevation", "elev", "height", "h", "alt", "altitude", "ortho", "orthoheight", "zcoord"],
    "image": ["image", "imagename", "photo", "frame", "img", "picture", "file", "filename", "photoid"],
    "col": ["col", "column", "sample", "px", "pixel", "ximage", "i"],
    "row": ["row", "line", "py", "yimage", "j"],
    "omega": ["omega", "om", "roll", "w"],
    "phi": ["phi", "ph", "pitch", "p"],
    "kappa": ["kappa", "ka", "kap", "yaw", "heading", "k"],
    "sigma": ["sigma", "sd", "stddev", "accuracy", "precision", "weight"],
    "type": ["type", "kind", "class", "use", "role", "check"],
}
CHECK_WORDS = ("check", "chk", "c", "0", "false")
COMMENTS = ("#", "//", ";;")
SNIFF_LINES = 50


def _key(text: str) -> str:
    return re.sub("[^a-z0-9]", "", text.strip().lower())


def match_columns(header: list[str], roles: list[str]) -> dict[str, int]:
    """Role to column place: for each role the leftmost column with one of its names that no role before it took."""
    keys, out = [_key(h) for h in header], {}
    for role in roles:
        free = [k for k, key in enumerate(keys) if key in ALIASES[role] and k not in out.values()]
        if free:
            out[role] = free[0]
    if "image" in roles and "image" not in out and "id" in map(_key, header):  # flight logs that call the photo its id
        out["image"] = keys.index("id")
    return out


def _number(text: str) -> bool:
    flat = re.sub(r"\s", "", text)
    flat = flat.replace(",", ".") if flat.count(",") == 1 and "." not in flat else flat
    return bool(re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", flat))


def sniff(lines: list[str]) -> dict:
    """Delimiter, header and number of columns from the first lines: the delimiter that cuts most lines alike."""
    rows = [x.lstrip("﻿") for x in lines]
    rows = [x for x in rows if x.strip() and not x.lstrip().startswith(COMMENTS)]
    if not rows:
        return {"sep": ",", "header": None, "columns": 0}
    best = (0, 0, ",")
    for rank, sep in enumerate(("\t", ";", "|", ",", " ")):
        counts = [len(r.split() if sep == " " else r.split(sep)) for r in rows]
        usual = max(set(counts), key=counts.count)
        if usual > 1:
            best = max(best, (counts.count(usual), -rank, sep))
    sep = best[2]
    cut = lambda r: [c.strip().strip('"') for c in (r.split() if sep == " " else r.split(sep))]
    first = cut(rows[0])
    second = cut(rows[1]) if len(rows) > 1 else []
    header = bool(second) and sum(map(_number, first)) <= 1 and sum(map(_number, second)) >= 2  # a single line is data
    return {"sep": sep, "header": first if header else None, "columns": len(first)}


def read_table(spark: SparkSession, path: str, roles: list[str], mapping: dict[str, int] | None = None) -> tuple[DataFrame, dict]:
    """Rows ``line, role..`` as strings (``line`` is the true line number in a single file), and what was sniffed.

    The sniff looks at the first lines only; the rows are those of the whole file.
    """
    text = spark.read.text(path)
    said = text.filter(F.trim(F.regexp_replace("value", "^﻿", "")) != "")
    for mark in COMMENTS:
        said = said.filter(~F.ltrim(F.regexp_replace("value", "^﻿", "")).startswith(mark))
    head = [r["value"] for r in said.limit(SNIFF_LINES).collect()]
    kind = sniff(head)
    places = mapping or (match_columns(kind["header"], roles) if kind["header"] else {r: k for k, r in enumerate(roles) if k < kind["columns"]})
    from ..operators.ranks import global_rank

    numbered = text.withColumns({"__at": F.monotonically_increasing_id()})
    numbered = global_rank(numbered, ["__at"], "line").withColumn("line", F.col("line") + 1)
    value = F.regexp_replace("value", "^﻿", "")
    plain = numbered.select("line", value.alias("value")).filter(F.trim("value") != "")
    for mark in COMMENTS:
        plain = plain.filter(~F.ltrim("value").startswith(mark))
    if kind["header"]:
        first = plain.agg(F.min("line").alias("first"))
        plain = plain.crossJoin(F.broadcast(first)).filter("line > first")
    cells = F.split(F.trim("value"), r"\s+") if kind["sep"] == " " else F.split("value", re.escape(kind["sep"]), -1)
    out = plain.select("line", *[(F.trim(F.regexp_replace(F.get(cells, F.lit(places[r])), '"', "")) if r in places else F.lit(None).cast("string")).alias(r) for r in roles])
    return out, kind | {"mapping": places}


def read_control(spark: SparkSession, path: str, mapping: dict[str, int] | None = None, check_words=CHECK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Control points ``id, x, y, z, is_check`` and rejects ``line, reason``. A missing id is made from the line, a missing height is 0."""
    rows, _ = read_table(spark, path, ["id", "x", "y", "z", "type"], mapping)
    parsed = rows.select("line", "id", european_float(F.col("x")).alias("x"), european_float(F.col("y")).alias("y"), european_float(F.col("z")).alias("z"), F.lower("type").isin(*check_words).alias("c"))
    bad = parsed.filter("x is null or y is null")
    good = parsed.filter("x is not null and y is not null")
    points = good.select(F.coalesce(F.nullif("id", F.lit("")), F.format_string("G%04d", "line")).alias("id"), "x", "y", F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("c", F.lit(False)).alias("is_check"))
    return points, bad.select("line", F.when(F.col("x").isNull() & F.col("y").isNull(), "no coordinates").when(F.col("x").isNull(), "no x").otherwise("no y").alias("reason"))


def read_exterior(spark: SparkSession, path: str, units: str = "auto", mapping: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Exterior orientations ``image, x, y, z, omega, phi, kappa`` in radians, and rejects. ``auto``: degrees if an angle is over 6.5."""
    names = ["image", "x", "y", "z", "omega", "phi", "kappa"]
    rows, _ = read_table(spark, path, names, mapping)
    parsed = rows.select("line", "image", *[european_float(F.col(c)).alias(c) for c in names[1:]])
    missing = sum((F.col(c).isNull().cast("int") for c in names), F.lit(0))
    good, bad = parsed.filter(missing == 0), parsed.filter(missing > 0).select("line", F.lit("incomplete").alias("reason"))
    if units == "auto":
        most = good.agg(F.max(F.greatest(*[F.abs(c) for c in names[4:]])).alias("most"))
        good = good.crossJoin(F.broadcast(most))
        turn = lambda c: F.when(F.col("most") > 6.5, F.radians(c)).otherwise(F.col(c))
    else:
        turn = F.radians if units == "degrees" else F.col
    return good.select("image", "x", "y", "z", *[turn(c).alias(c) for c in names[4:]]), bad


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Camera library ``label, camera`` (a JSON string) of a file with ``cameras``."""
    raw = spark.read.option("wholetext", True).text(path)
    rows = raw.select(F.explode(F.from_json("value", "struct<version:int,cameras:array<struct<label:string,camera:string>>>")["cameras"]).alias("c"))
    return rows.select("c.label", "c.camera")


def save_camera(library: DataFrame, label: str, camera_json: str) -> DataFrame:
    """The library with a camera put in or replaced, ordered by label."""
    new = library.sparkSession.range(1).select(F.lit(label).alias("label"), F.lit(camera_json).alias("camera"))
    return library.filter(F.col("label") != label).unionByName(new).orderBy("label")


RPC_FIELDS = ["line_off", "samp_off", "lat_off", "long_off", "height_off", "line_scale", "samp_scale", "lat_scale", "long_scale", "height_scale"]
RPC_LISTS = {"line_num": ["linenumcoef", "linenumcoeff"], "line_den": ["linedencoef", "linedencoeff"], "samp_num": ["sampnumcoef", "sampnumcoeff"], "samp_den": ["sampdencoef", "sampdencoeff"]}


def read_rpc(spark: SparkSession, path: str) -> DataFrame:
    """Rational models of sidecar text files, one row a file: ``file``, ten scalars, four lists of twenty.

    Keys may be spelled with or without marks, and stand before ``=`` or ``:``.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    cut = lines.select("file", F.regexp_replace(F.lower(F.regexp_extract("value", r"^\s*([^=:]+?)\s*[=:]", 1)), "[^a-z0-9]", "").alias("k"), F.regexp_extract("value", r"[=:]\s*([-+0-9.eE]+)", 1).try_cast("double").alias("v"))
    cut = cut.filter("k <> '' and v is not null")
    split = cut.withColumns({"stem": F.regexp_extract("k", r"^(.*?coeff?)(\d+)$", 1), "i": F.regexp_extract("k", r"coeff?(\d+)$", 1).try_cast("int")})
    scalar = [F.max(F.when(F.col("k") == f.replace("_", ""), F.col("v"))).alias(f) for f in RPC_FIELDS]
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("stem").isin(*names), F.struct("i", "v")))), lambda s: s["v"]).alias(n) for n, names in RPC_LISTS.items()]
    return split.groupBy("file").agg(*scalar, *lists)


def read_project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Project document as tables ``images, gcps, tie_points, observations``; keys that are missing give empty tables."""
    schema = (
        "images array<struct<id:string,name:string,exterior:array<double>>>, gcps array<struct<id:string,x:double,y:double,z:double,isCheck:boolean>>, "
        "tiePoints array<struct<id:string,source:string>>, observations array<struct<imageId:string,pointId:string,col:double,row:double>>"
    )
    doc = spark.read.option("multiLine", True).schema(schema).json(path)
    return {n: doc.select(F.explode(c).alias("r")).select("r.*") for n, c in {"images": "images", "gcps": "gcps", "tie_points": "tiePoints", "observations": "observations"}.items()}
