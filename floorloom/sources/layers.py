"""Layers as files: readers, staged writers, contracts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def read(spark: SparkSession, path: str, layer: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{layer}.parquet")


def counts(layers: dict[str, DataFrame]) -> dict[str, int]:
    return {name: df.count() for name, df in layers.items()}


def lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, value without nulls; an error if nothing is left."""
    found = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value)
    if found.isEmpty():
        raise ValueError(f"no {key} with a {value}")
    return found


def require(df: DataFrame, name: str, fields: set[str]) -> DataFrame:
    """``df`` if it has the fields, else an error that names those it lacks."""
    if lacking := fields - set(df.columns):
        raise ValueError(f"{name} lacks {sorted(lacking)}")
    return df


def metadata(df: DataFrame, layer: str) -> DataFrame:
    """layer, field, type, nullable, width and precision (of decimals; null for others), geometry (the kind of one), sorted by field."""
    kinds = {"array<struct<x:double,y:double,z:double>>": "LineString", "struct<x:double,y:double,z:double>": "Point", "struct<x:double,y:double>": "Point"}
    digits = lambda t: (t.precision, t.scale) if isinstance(t, DecimalType) else (None, None)
    rows = [(layer, f.name, f.dataType.simpleString(), f.nullable, *digits(f.dataType), kinds.get(f.dataType.simpleString())) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return df.sparkSession.createDataFrame(rows, "layer string, field string, type string, nullable boolean, width int, precision int, geometry string")


def require_layers(layers: dict[str, DataFrame], fields: dict[str, set[str]]) -> dict[str, DataFrame]:
    """``layers`` if all that ``fields`` names are there with their fields; else an error that names what is lacking."""
    if lacking := sorted(set(fields) - set(layers)):
        raise ValueError(f"lacking layers: {lacking}")
    return {name: require(df, name, fields.get(name, set())) for name, df in layers.items()}


def lacking(spark: SparkSession, layers: dict[str, DataFrame], fields: dict[str, set[str]]) -> DataFrame:
    """layer, field: what ``require_layers`` would refuse; field is null where the whole layer is lacking."""
    rows = [(n, None) for n in fields if n not in layers] + [(n, f) for n, want in fields.items() if n in layers for f in want - set(layers[n].columns)]
    return spark.createDataFrame(sorted(rows, key=str), "layer string, field string")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def install(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Written beside the target, then renamed to it: readers see all of it or nothing.

    Without ``overwrite`` a target that exists, or appears meanwhile, stays and is an error.  With it the old target is set aside by a rename, comes
    back if the new one cannot take its place, and is deleted only after that.
    """
    spark = df.sparkSession
    stage = f"{path}.stage-{uuid.uuid4().hex}"
    if not overwrite and exists(spark, path):
        raise FileExistsError(path)
    df.write.parquet(stage)
    fs, target = _fs(spark, path)
    source = _fs(spark, stage)[1]
    aside = None
    if overwrite and fs.exists(target):
        aside = _fs(spark, f"{path}.old-{uuid.uuid4().hex}")[1]
        if not fs.rename(target, aside):
            fs.delete(source, True)
            raise OSError(f"{path} cannot be set aside")
    if fs.exists(target) or not fs.rename(source, target):
        if aside is not None and not fs.exists(target):
            fs.rename(aside, target)
        fs.delete(source, True)
        raise FileExistsError(path)
    if aside is not None:
        fs.delete(aside, True)


def drop(spark: SparkSession, path: str) -> None:
    """The layer is gone, whether it was there or not."""
    fs, target = _fs(spark, path)
    if fs.exists(target):
        fs.delete(target, True)


def put(df: DataFrame, path: str) -> None:
    """Appended to the layer if there is one, which must have the same fields; else the layer is created."""
    if exists(df.sparkSession, path):
        there = dict(df.sparkSession.read.parquet(path).dtypes)
        if there != dict(df.dtypes):
            raise ValueError(f"{path} has other fields")
        append(df, path)
    else:
        install(df, path)


def create_as(spark: SparkSession, sql: str, path: str, schema: str, overwrite: bool = False, **views: DataFrame) -> DataFrame:
    """A new layer from a query over ``views``, with the fields and types of ``schema``; what was written."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    rows = spark.sql(sql, **views) if views else spark.sql(sql)
    lacking = {f.name for f in fields} - set(rows.columns)
    if lacking:
        raise ValueError(f"the query lacks {sorted(lacking)}")
    install(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields)), path, overwrite)
    return spark.read.parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def ledger(df: DataFrame, path: str) -> None:
    """CSV with a header and plain line ends; the folder must not exist."""
    df.write.mode("error").option("header", True).option("lineSep", "\n").csv(path)


def documents(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of one JSON object a line, by a schema; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def stats(df: DataFrame, path: str, *columns: str) -> None:
    """One JSON document per row, keys sorted; the folder must not exist, and numbers must be finite."""
    numbers = [c for c, t in df.dtypes if c in columns and t in ("double", "float")]
    for c in numbers:
        if not df.where(F.isnan(c) | (F.abs(c) == float("inf"))).isEmpty():
            raise ValueError(f"{c} has numbers that JSON does not")
    df.select(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("error").text(path)


def collection(df: DataFrame, properties: list[str], line: str, source: str, target: str) -> DataFrame:
    """value: one GeoJSON feature per row, its line (points x, y, z) taken from the reference system ``source`` to ``target``."""
    from floorloom.functions import geometry as G

    moved = F.col(line) if source == target else G.reprojected(F.col(line), target)
    places = F.transform(moved, lambda p: F.array(p["x"], p["y"]))
    shape = F.struct(F.when(F.size(places) == 1, "Point").otherwise("LineString").alias("type"), F.when(F.size(places) > 1, F.to_json(places)).otherwise(F.to_json(F.get(places, F.lit(0)))).alias("coordinates"))
    head = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties")))
    body = F.concat(F.lit(',"geometry":{"type":"'), shape["type"], F.lit('","coordinates":'), shape["coordinates"], F.lit("}}"))
    return df.select(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), body).alias("value"))


def geojson(df: DataFrame, properties: list[str], x: str, y: str) -> DataFrame:
    """value: one GeoJSON feature per row, with a point geometry."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(x), F.col(y)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def refuse_links(spark: SparkSession, path: str) -> None:
    """An error if a symbolic link lies below ``path``: what it leads to is not part of the folder."""
    fs, top = _fs(spark, path)
    if fs.getUri().getScheme() == "file":
        import os

        for folder, names, files in os.walk(top.toUri().getPath()):
            for name in names + files:
                if os.path.islink(os.path.join(folder, name)):
                    raise ValueError(f"symbolic link {name}")
        return
    found = fs.listFiles(top, True)
    while found.hasNext():
        status = found.next()
        if status.isSymlink():
            raise ValueError(f"symbolic link {status.getPath().getName()}")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of every file below a folder; a symbolic link in it is an error."""
    refuse_links(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def dimension(spark: SparkSession, rows: dict[str, dict]) -> DataFrame:
    """A use-type mapping, as read from configuration, as a small table."""
    return spark.createDataFrame([(k, r.get("category"), r.get("accessible"), r.get("gender")) for k, r in rows.items()], "use_type string, category string, accessible boolean, gender string")


def yaml_dimension(spark: SparkSession, text: str) -> DataFrame:
    """A use-type mapping from YAML of two levels (a use type, below it its flags), as a small table."""
    found: dict[str, dict] = {}
    plain = lambda x: x.strip().strip("\"'")
    current = None
    for number, line in enumerate(text.splitlines(), 1):
        body = line.split(" #")[0].rstrip()
        if not body or body.lstrip().startswith("#"):
            continue
        key, colon, value = body.rpartition(":") if body.endswith(":") else body.partition(": ")
        if not colon:
            raise ValueError(f"line {number} is no mapping")
        if body[0] != " ":
            if value:
                raise ValueError(f"line {number}: a use type has its flags below it")
            current = plain(key)
            if current in found:
                raise ValueError(f"line {number}: {current} is there already")
            found[current] = {}
        elif current is None:
            raise ValueError(f"line {number}: flags of no use type")
        else:
            flag = plain(value)
            found[current][plain(key)] = {"true": True, "false": False}.get(flag, flag)
    return dimension(spark, found)
