"""Canonical forms, digests and sealed manifests."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _number(x: float) -> str:
    """ECMAScript's shortest form of a finite double."""
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(x)
    mantissa, _, power = text.partition("e")
    if power:
        p = int(power)
        if -7 < p < 0:
            return f"{x:.{max(0, -p + len(mantissa.replace('-', '').replace('.', '')) - 1)}f}"
        return f"{mantissa.removesuffix('.0')}e{'+' if p > 0 else '-'}{abs(p)}"
    return f"{x:.20f}".rstrip("0") if abs(x) < 1e-4 else text


def canonical(value) -> str:
    """RFC 8785: keys by UTF-16 code units, shortest numbers, minimal escapes."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    return text.map(lambda x: canonical(json.loads(x)) if x is not None else None)


def chain_id(ends: Column, ids: Column) -> Column:
    """First 16 hex digits of a digest of the sorted ends and sorted ids."""
    return F.substring(F.sha2(F.concat_ws("|", F.array_join(F.array_sort(ends).cast("array<string>"), "|"), F.array_join(F.array_sort(ids), ",")), 256), 1, 16)


def hash_of(entries: Column, suffix: str) -> Column:
    """sha256 of the first entry (path, sha256) whose path, with forward slashes, ends in ``suffix``."""
    return F.get(F.filter(entries, lambda e: F.replace(e["path"], F.lit("\\"), F.lit("/")).endswith(suffix)), F.lit(0))["sha256"]


def json_safe(value: Column, text: Column) -> Column:
    """``text`` of a finite number; non-finite ones as a tagged object."""
    tag = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
    return F.when(tag.isNotNull(), F.concat(F.lit('{"nonfinite":"'), tag, F.lit('"}'))).otherwise(text)


def directory_digest(files: DataFrame, by: str) -> DataFrame:
    """Files, bytes and digest of each directory from rows (by, name, content).

    Lines are small next to contents, which are digested where they are; a directory's lines meet in one row.
    """
    lines = files.select(by, F.col("name"), F.concat("name", F.lit("\0"), F.sha2("content", 256), F.lit("\n")).alias("line"), F.octet_length("content").cast("long").alias("size"))
    grouped = lines.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.array_sort(F.collect_list(F.struct("name", "line"))).alias("l"))
    return grouped.select(by, "files", "bytes", F.sha2(F.array_join(F.transform("l", lambda x: x["line"]), ""), 256).alias("digest"))


STATES = ("extracting", "extracted", "deriving", "derived", "complete")


class Manifest:
    """A run's record: stages with the digests of inputs and outputs, advanced in order and sealed at the end."""

    def __init__(self, run: str, runtime: dict):
        self.doc = {"run": run, "state": STATES[0], "runtime": runtime, "stages": []}

    def advance(self, state: str) -> None:
        if state != "failed" and (self.doc["state"] == "failed" or STATES.index(state) != STATES.index(self.doc["state"]) + 1):
            raise ValueError(f"no step from {self.doc['state']} to {state}")
        self.doc["state"] = state

    def stage(self, name: str, inputs: dict[str, str], outputs: dict[str, str]) -> None:
        known = {k: h for s in self.doc["stages"] for k, h in s["outputs"].items()}
        for k, h in inputs.items():
            if known.get(k, h) != h:
                raise ValueError(f"{name}: input {k} is not what an earlier stage made")
        if clash := set(outputs) & set(known):
            raise ValueError(f"{name}: outputs exist: {sorted(clash)}")
        self.doc["stages"].append({"name": name, "inputs": inputs, "outputs": outputs})

    def sealed(self) -> dict:
        return self.doc | {"seal": hashlib.sha256(canonical(self.doc).encode()).hexdigest()}


def verify_seal(doc: dict) -> bool:
    rest = {k: v for k, v in doc.items() if k != "seal"}
    return doc.get("seal") == hashlib.sha256(canonical(rest).encode()).hexdigest()


def row_text(df: DataFrame) -> Column:
    """A row as text: its columns by name, doubles to six places as whole numbers, times in microseconds, nulls as ``~``."""

    def cell(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        whole = lambda x: F.when(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) > 1e12), x.cast("string")).otherwise(F.floor(x.cast("double") * 1000000).cast("bigint").cast("string"))
        if kind in ("double", "float"):
            text = whole(c)
        elif kind.startswith("timestamp"):
            text = F.unix_micros(c.cast("timestamp")).cast("string")
        elif kind in ("array<double>", "array<float>"):
            text = F.array_join(F.transform(c, whole), ",")
        else:
            text = c.cast("string")
        return F.coalesce(text, F.lit("~"))

    return F.concat_ws("\x1f", *(cell(n, k) for n, k in sorted(df.dtypes)))


def content_digest(df: DataFrame) -> DataFrame:
    """One row, digest: SHA-256 of a table's rows whatever their order.

    Rows are digested, sorted and digested again in parts by the leading half of the digits of their number, and the parts' digests once more:
    a part and the list of parts have about as many entries as the root of the number of rows.
    """
    hashed = df.select(F.sha2(row_text(df), 256).alias("h"))
    n = F.broadcast(df.agg(F.count(F.lit(1)).alias("_n")))  # one row
    split = hashed.crossJoin(n).select("h", F.substring(F.col("h"), F.lit(1), F.floor(F.length(F.hex("_n")) / 2).cast("int")).alias("p"))
    parts = split.groupBy("p").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"])
    return parts.agg(F.sha2(F.array_join(every, ""), 256).alias("digest"))


def runtime() -> dict[str, str]:
    """What made a result: versions of interpreter, Spark and machine, and a digest of this package's code."""
    import platform
    from pathlib import Path

    import pyspark

    root = Path(__file__).resolve().parent.parent
    code = hashlib.sha256(b"".join(f"{p.relative_to(root)}\0{hashlib.sha256(p.read_bytes()).hexdigest()}\n".encode() for p in sorted(root.rglob("*.py")))).hexdigest()
    return {"python": platform.python_version(), "spark": pyspark.__version__, "machine": platform.machine(), "system": platform.system(), "code": code}


class Stages:
    """A DAG of stages over tables in one folder.

    A stage names its inputs and its output.  Stages run in the order that their inputs ask for; inputs are digested and compared with what the stage
    that made them recorded, outputs must not exist, and are digested after they were written.
    """

    def __init__(self, spark, folder: str, run: str = "run"):
        self.spark, self.folder, self.stages = spark, folder, {}
        self.manifest = Manifest(run, runtime())
        self.digests: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def source(self, name: str, df: DataFrame) -> None:
        """A table from outside, as the input of stages."""
        self.stages[name] = ((), lambda: df)

    def stage(self, name: str, inputs: tuple[str, ...], make) -> None:
        """``make(**inputs)`` gives the table ``name``."""
        if name in self.stages:
            raise ValueError(f"stage {name} is there already")
        self.stages[name] = (tuple(inputs), make)

    def order(self) -> list[str]:
        done: list[str] = []
        left = dict(self.stages)
        while left:
            ready = sorted(n for n, (inputs, _) in left.items() if set(inputs) <= set(done))
            if not ready:
                raise ValueError(f"stages wait for each other or for nothing: {sorted(left)}")
            done += ready
            for n in ready:
                del left[n]
        return done

    def digest(self, name: str) -> str:
        return content_digest(self.spark.read.parquet(self.path(name))).first()["digest"]

    def run(self) -> dict:
        """Runs all stages; the sealed manifest."""
        from floorloom.sources.layers import install

        for name in self.order():
            inputs, make = self.stages[name]
            for i in inputs:
                if self.digest(i) != self.digests[i]:
                    raise ValueError(f"{name}: input {i} was changed after it was made")
            install(make(**{i: self.spark.read.parquet(self.path(i)) for i in inputs}), self.path(name))
            self.digests[name] = self.digest(name)
            self.manifest.stage(name, {i: self.digests[i] for i in inputs}, {name: self.digests[name]})
        for state in STATES[1:]:
            self.manifest.advance(state)
        return self.manifest.sealed()


def tagged_set(values: Column) -> Column:
    """A set as JSON with its type, its members' JSON sorted; ``values`` are JSON texts."""
    return F.concat(F.lit('{"items":['), F.array_join(F.array_sort(F.array_distinct(values)), ","), F.lit('],"type":"set"}'))


def tagged_map(entries: Column) -> Column:
    """A mapping as JSON with its type, so that no key of it can be taken for a tag; ``entries`` are structs (k, v) of JSON texts."""
    pairs = F.transform(entries, lambda e: F.concat(F.lit("["), e["k"], F.lit(","), e["v"], F.lit("]")))
    return F.concat(F.lit('{"entries":['), F.array_join(F.array_sort(pairs), ","), F.lit('],"type":"mapping"}'))


def tagged_geometry(kind: str, coordinates: Column) -> Column:
    """A geometry as JSON with its type; ``coordinates`` is JSON text."""
    entries = F.array(F.struct(F.lit('"coordinates"').alias("k"), coordinates.alias("v")), F.struct(F.lit('"type"').alias("k"), F.lit(f'"{kind}"').alias("v")))
    return F.concat(F.lit('{"type":"geometry","value":'), tagged_map(entries), F.lit("}"))


def replayed(expected: DataFrame, found: DataFrame, keys: list[str], digest: str, now: str) -> DataFrame:
    """Keys and same: recorded answers against those of today, on data whose digest must be the recorded one."""
    if digest != now:
        raise ValueError("the data is not what the evidence was recorded on")
    rest = [c for c in expected.columns if c not in keys]
    a = expected.select(*keys, F.struct(*rest).alias("_a"))
    b = found.select(*keys, F.struct(*rest).alias("_b"))
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce(F.col("_a").eqNullSafe(F.col("_b")), F.lit(False)).alias("same"))
