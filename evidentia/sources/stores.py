"""Typed run stores, write-once files, manifests and saved responses.

Paths go through Hadoop's file systems, so a store may lie anywhere that Spark reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from evidentia.functions.hashing import digest
from evidentia.operators.contracts import grain_violations, schema_problems


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(b & 0xFF for b in stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file; the same bytes again are nothing, other bytes are refused."""
    p, fs = _fs(spark, path)
    if fs.exists(p):
        if read_text(spark, path) != text:
            raise FileExistsError(f"{path} holds other bytes")
        return False
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def table_digest(df: DataFrame) -> str:
    """An order-free digest of a table: the count and the sums of its rows' hashes."""
    h = F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    row = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return digest({"n": row["n"], "s": str(row["s"]), "x": row["x"], "columns": [f"{f.name} {f.dataType.simpleString()}" for f in df.schema]})


def publish(tables: dict[str, DataFrame], path: str, schemas: dict[str, StructType], grains: dict[str, list[str]], record: dict) -> dict:
    """Write a run: tables into a sibling folder, the manifest last, then one rename. An existing run is refused, as is a table that breaks its contract."""
    spark = next(iter(tables.values())).sparkSession
    target, fs = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(f"{path} is published already")
    draft = f"{path.rstrip('/')}.draft-{uuid.uuid4().hex}"
    hashes = {}
    for name, df in tables.items():
        if problems := schema_problems(df, schemas[name]):
            raise ValueError(f"{name}: {problems[0]}")
        df.write.parquet(f"{draft}/{name}")
        stored = spark.read.schema(schemas[name]).parquet(f"{draft}/{name}")
        if grains.get(name) and grain_violations(stored, grains[name]).limit(1).count():
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(draft), True)
            raise ValueError(f"{name}: rows of one key")
        hashes[name] = table_digest(stored)
    manifest = record | {"tables": hashes}
    manifest |= {"content_hash": digest(manifest)}
    write_once(spark, f"{draft}/run.json", json.dumps(manifest, sort_keys=True))
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(draft), target):
        raise OSError(f"{path} could not be published")
    return manifest


def read_run(spark: SparkSession, path: str, schemas: dict[str, StructType], verify: bool = True) -> tuple[dict, dict[str, DataFrame]]:
    """A published run: its manifest and its tables, refused where a schema or a digest differs."""
    manifest = json.loads(read_text(spark, f"{path}/run.json"))
    if manifest["content_hash"] != digest({k: v for k, v in manifest.items() if k != "content_hash"}):
        raise ValueError("the manifest's hash differs")
    tables = {}
    for name, schema in schemas.items():
        df = spark.read.parquet(f"{path}/{name}")
        if problems := schema_problems(df, schema):
            raise ValueError(f"{name}: {problems[0]}")
        if verify and table_digest(df) != manifest["tables"][name]:
            raise ValueError(f"{name}: the digest differs")
        tables[name] = df
    return manifest, tables


def next_version(content: dict, versions: list[dict]) -> int:
    """The version of a frozen manifest: that of identical content, else one more than the highest."""
    name = digest(content)
    for v in versions:
        if v["content_hash"] == name:
            return v["version"]
    return max([v["version"] for v in versions], default=0) + 1


def toml_text(record: dict) -> str:
    """A flat or once-nested record as TOML; what is None is left out."""

    def value(x) -> str:
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, (int, float)):
            return repr(x)
        if isinstance(x, list):
            return "[" + ", ".join(value(v) for v in x) + "]"
        return json.dumps(str(x), ensure_ascii=False)

    plain = [f"{k} = {value(v)}" for k, v in record.items() if v is not None and not isinstance(v, dict) and not (isinstance(v, list) and v and isinstance(v[0], dict))]
    for k, v in record.items():
        if isinstance(v, dict):
            plain += ["", f"[{k}]", *[f"{a} = {value(b)}" for a, b in v.items() if b is not None]]
        elif isinstance(v, list) and v and isinstance(v[0], dict):
            for x in v:
                plain += ["", f"[[{k}]]", *[f"{a} = {value(b)}" for a, b in x.items() if b is not None]]
    return "\n".join(plain) + "\n"


def read_toml(spark: SparkSession, path: str, content_hash: str | None = None) -> dict:
    """A TOML record, refused where its bytes do not have the stated hash."""
    import hashlib
    import tomllib

    text = read_text(spark, path)
    if content_hash and hashlib.sha256(text.encode()).hexdigest() != content_hash:
        raise ValueError("the file's hash differs")
    return tomllib.loads(text)


def newest(retrievals: DataFrame, key: str = "url", at: str = "retrieved_at") -> DataFrame:
    """The newest retrieval of each URL, ties by content hash."""
    order = Window.partitionBy(key).orderBy(F.desc(at), "content_sha256")
    return retrievals.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def verified(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Stored bytes against their metadata: ok, quarantined (another hash) or missing."""
    held = files.select(F.col("path"), F.sha2("content", 256).alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("content_sha256"), "ok").otherwise("quarantined")
    return metadata.join(held, "path", "left").withColumn("status", status).drop("actual")


def cited(citations: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Citations against the artifacts that they name: verified, hash_mismatch or missing_artifact."""
    a = artifacts.select("artifact_sha256", F.col("canonical_sha256").alias("stored"))
    status = F.when(F.col("stored").isNull(), "missing_artifact").when(F.col("stored") != F.col("canonical_sha256"), "hash_mismatch").otherwise("verified")
    return citations.join(a.dropDuplicates(["artifact_sha256"]), "artifact_sha256", "left").withColumn("status", status).drop("stored")


def robots_decision(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether each URL's path may be fetched: the longest matching rule decides, a tie allows, none allows."""
    path = F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit("/"))
    u = urls.withColumns({"host": F.parse_url("url", F.lit("HOST")), "path": F.when(path == "", "/").otherwise(path)})
    pairs = u.join(rules, "host", "left").withColumn("hit", F.col("path").startswith(F.col("prefix")))
    best = pairs.groupBy(*u.columns).agg(F.max(F.when(F.col("hit"), F.struct(F.length("prefix").alias("n"), F.col("allow").cast("int").alias("a")))).alias("b"))
    return best.select("url", F.coalesce(F.col("b.a") == 1, F.lit(True)).alias("allowed"))
