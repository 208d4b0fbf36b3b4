"""Readers and writers of tables beside bars: CSV, JSON, Parquet, ledgers and run registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A table by the path's suffix; CSV has a header."""
    kind = next((k for k in ("parquet", "csv", "json", "jsonl") if path.rstrip("/").endswith(f".{k}")), "parquet")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    return reader.json(path) if kind in ("json", "jsonl") else reader.parquet(path)


def write(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    kind = next((k for k in ("csv", "json") if path.rstrip("/").endswith(f".{k}")), "parquet")
    out = df.write.mode(mode)
    if by:
        out = out.partitionBy(*by)
    if kind == "csv":
        flat(df).write.mode(mode).option("header", True).csv(path)
    elif kind == "json":
        out.json(path)
    else:
        out.option("compression", "zstd").parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Structs as columns ``a_b``; arrays and maps as JSON."""
    out: list[Column] = []
    again = False
    for f in df.schema:
        if isinstance(f.dataType, T.StructType):
            again = True
            out += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}_{g.name}") for g in f.dataType]
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append(F.to_json(f"`{f.name}`").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    df = df.select(*out)
    return flat(df) if again else df


def page(df: DataFrame, rules: Column, columns: list[str], order: list[str], offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of a filtered, projected scan; the filter and the columns reach the files."""
    return df.where(rules).select(*columns).orderBy(*order).offset(offset).limit(limit)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; of a key in both, the new one."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An append-only JSON-lines ledger; a row that breaks the schema is an error."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def append_ledger(rows: DataFrame, path: str, schema: T.StructType) -> None:
    missing = {f.name for f in schema if not f.nullable} - set(rows.columns)
    if missing:
        raise ValueError(f"ledger columns missing: {sorted(missing)}")
    rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("append").json(path)


def latest_run(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The newest run of each key, by last generation or else creation."""
    newest = Window.partitionBy(*keys).orderBy(F.coalesce("last_generated_at", "created_at").desc(), F.desc("run_id"))
    return runs.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")


def surplus_runs(runs: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """Runs beyond the newest ``keep`` of each key, but never one with an alias."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.where("alias is null").withColumn("_k", F.row_number().over(newest)).where(F.col("_k") > keep).drop("_k")


def orphans(registered: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in one table and not in the other, and in which."""
    a = registered.join(found, keys, "left_anti").select(*keys, F.lit("registered").alias("only_in"))
    return a.unionByName(found.join(registered, keys, "left_anti").select(*keys, F.lit("found").alias("only_in")))


def write_arrow(df: DataFrame, path: str, most: int = 1 << 20) -> int:
    """A reference table of at most ``most`` rows as an Arrow IPC file; more are an error, as it is gathered on the driver."""
    import pyarrow as pa

    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows are too many for one Arrow file; write Parquet")
    fs, at = _file_system(path)
    table = df.toArrow()
    with fs.open_output_stream(at) as out, pa.ipc.new_file(out, table.schema) as f:
        f.write_table(table)
    return n


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    import pyarrow as pa

    fs, at = _file_system(path)
    with fs.open_input_file(at) as f:
        return spark.createDataFrame(pa.ipc.open_file(f).read_all())


def _file_system(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def save_json(payload: object, path: str) -> None:
    """A small object as one JSON file, in one form whatever the order of its keys."""
    from barloom.functions.names import stable_json

    fs, at = _file_system(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at, compression=None) as f:
        f.write(stable_json(payload).encode())


def load_json(path: str) -> object:
    import json

    fs, at = _file_system(path)
    with fs.open_input_stream(at, compression=None) as f:
        return json.loads(f.read())


def checkpoint(state: dict, folder: str, number: int, keep: int = 3) -> list[int]:
    """Save the state of a search under its trial's number, and delete all but the newest ``keep``; the numbers that are left."""
    import pyarrow.fs as pafs

    save_json(state, f"{folder}/checkpoint-{number:08d}.json")
    fs, at = _file_system(folder)
    found = sorted((f for f in fs.get_file_info(pafs.FileSelector(at)) if f.base_name.startswith("checkpoint-")), key=lambda f: f.base_name)
    for old in found[:-keep]:
        fs.delete_file(old.path)
    return [int(f.base_name[11:19]) for f in found[-keep:]]


def save_model(model, path: str, about: dict) -> None:
    """A fitted Spark model with a JSON file of what it is beside it."""
    model.write().overwrite().save(f"{path}/model")
    save_json(about, f"{path}/about.json")


# What a candidate's record must say.
CANDIDATE = ("candidate_id", "evaluation_id", "rule_digest", "seed", "input_digest", "command", "expected")


def record_candidate(spark: SparkSession, meta: dict, path: str) -> bool:
    """Append a candidate to a ledger of JSON lines, with where it came from in a sidecar; False if the pair of ids is there already."""
    missing = [k for k in CANDIDATE if k not in meta]
    if missing or meta["expected"] not in ("pass", "fail"):
        raise ValueError(f"candidate record: missing {missing}, expected {meta.get('expected')!r}")
    ids = (meta["candidate_id"], meta["evaluation_id"])
    fs, at = _file_system(path)
    side = f"{path.rstrip('/')}-provenance/{ids[0]}-{ids[1]}.json"
    if fs.get_file_info(_file_system(side)[1]).type.name != "NotFound":
        return False
    save_json(meta, side)
    spark.createDataFrame([(*ids, meta["rule_digest"], str(meta.get("attempt_index", 0)))], "candidate_id string, evaluation_id string, rule_digest string, attempt_index string").coalesce(1).write.mode("append").json(path)
    return True


def schema_hash(columns: list[str]) -> str:
    import hashlib
    import json

    return hashlib.sha256(json.dumps(columns).encode()).hexdigest()
