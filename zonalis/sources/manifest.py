"""Ensemble manifests, parameter tables, and reading and writing the tables of a workflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from zonalis.functions.columns import member_index
from zonalis.functions.lineage import exists


def member_manifest(files: DataFrame, min_files: int, max_files: int) -> DataFrame:
    """(snapshot, member, n_files, files): members with at least min_files files, the first max_files sorted."""
    found = files.groupBy("snapshot", "member").agg(F.count(F.lit(1)).alias("n_files"), F.sort_array(F.collect_list("path")).alias("files"))
    return found.where(F.col("n_files") >= min_files).withColumn("files", F.slice("files", 1, max_files))


def member_intersect(manifest: DataFrame, snapshots: list) -> DataFrame:
    """Members that are valid in every one of the snapshots."""
    rows = manifest.where(F.col("snapshot").isin(*snapshots))
    return rows.groupBy("member").agg(F.count_distinct("snapshot").alias("n")).where(F.col("n") == len(set(snapshots))).select("member")


def member_exclude(members: DataFrame, bad: DataFrame) -> DataFrame:
    return members.join(bad.select("member").distinct(), "member", "left_anti")


def member_param_filter(members: DataFrame, params: DataFrame, param, least: float) -> DataFrame:
    """Members whose value of one parameter reaches the threshold."""
    good = params.where((F.col("param") == param) & (F.col("value") >= least)).select("member")
    return members.join(good, "member", "left_semi")


def with_member_index(names: DataFrame, name: str = "name") -> DataFrame:
    return names.withColumn("idx", member_index(F.col(name)))


def params_attach(members: DataFrame, params: DataFrame, check: bool = True) -> DataFrame:
    """Members with their parameter rows; with check, a member without any, or with a NULL or missing one, is an error."""
    out = members.join(params, "member", "left")
    if check:
        names = params.select("param").distinct().count()
        have = out.groupBy("member").agg(F.count_distinct(F.when(F.col("value").isNotNull(), F.col("param"))).alias("n"))
        missing = [r["member"] for r in have.where(F.col("n") < names).orderBy("member").limit(10).collect()]
        if missing:
            raise ValueError(f"members without parameters: {missing}")
    return out


def params_collect(records: DataFrame, first: str, second: str, names: list[str], index: str = "idx") -> DataFrame:
    """Parameter table from one nested settings record per member.

    Two JSON sub-records are merged, records that lack a name are skipped, and index gaps become
    rows of NULLs, so that positions stay aligned.
    """
    kind = "map<string,double>"
    merged = F.map_concat(F.from_json(first, kind), F.from_json(second, kind))
    rows = records.withColumn("m", merged).where(F.forall(F.array(*map(F.lit, names)), lambda n: F.map_contains_key("m", n)))
    rows = rows.select(F.col(index).cast("long").alias("idx"), *(F.col("m")[n].alias(n) for n in names))
    last = rows.agg(F.max("idx").alias("last"))
    every = last.select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("idx"))
    return every.join(rows, "idx", "left")


def default_run(names: DataFrame, name: str = "name") -> DataFrame:
    """The control run: a case in every snapshot whose name has no member suffix; unique says if it is the only one."""
    rows = names.where(member_index(F.col(name)).isNull())
    n = names.select("snapshot").distinct()
    good = rows.groupBy(name).agg(F.count_distinct("snapshot").alias("n")).join(n.agg(F.count(F.lit(1)).alias("all")), F.col("n") == F.col("all"), "left_semi")
    return good.select(name, (F.count(F.lit(1)).over(Window.partitionBy()) == 1).alias("unique"))


def field_scan(field: DataFrame, variables: list[str], derived: dict[str, list[str]] | None = None) -> DataFrame:
    """Only the raw fields that the variables need: those named, and the inputs of derived ones."""
    derived = derived or {}
    needed = {x for v in variables for x in derived.get(v, [v])}
    return field.where(F.col("variable").isin(*sorted(needed)))


def obs_scan_optional(config: DataFrame, obs: DataFrame, require_all: bool = False) -> DataFrame:
    """Observations of each configured (snapshot, variable), times obs_scale; one NULL row where there are none."""
    out = config.join(obs, ["snapshot", "variable"], "left").withColumn("value", F.col("value") * F.col("obs_scale"))
    if require_all and not out.where("ncol is null").isEmpty():
        raise ValueError("observations are missing")
    return out.select("snapshot", "variable", "ncol", "value")


#: Columns by which stage tables are laid out, where they have them.
LAYOUT = ("level", "snapshot", "variable")


def _parts(df: DataFrame) -> list[str]:
    return [c for c in LAYOUT if c in df.columns]


def _record(df: DataFrame, name: str, parts: list[str]) -> DataFrame:
    """(name, part, n, digest): what a partition of a table holds, whatever the order of its rows."""
    part = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in parts))) if parts else F.lit("{}")
    row = F.xxhash64(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}))
    return df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("digest")).select(F.lit(name).alias("name"), "part", "n", "digest")


def zrg_persist(tables: dict[str, DataFrame], path: str, mode: str = "both") -> dict[str, str]:
    """Writes stage tables as Parquet below path; mode 'both', 'ppe' (no observations) or 'obs' (only them).

    Tables are laid out by level, snapshot and variable. Only partitions that a table has rows for are replaced;
    those of other levels, and tables that the mode leaves out, stay as they are. Each call ends with a commit
    record of the partitions it wrote (rows and a digest of them); zrg_load holds tables against it.
    """
    if mode not in ("both", "ppe", "obs"):
        raise ValueError(f"unknown mode {mode}")
    written, records = {}, None
    for name, df in tables.items():
        if mode != "both" and (mode == "obs") != name.startswith("obs"):
            continue
        parts, at = _parts(df), f"{path}/{name}"
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(at)
        record = _record(df, name, parts)
        written[name] = at
        records = record if records is None else records.unionByName(record)
    if records is not None:
        spark = records.sparkSession
        before = zrg_commits(spark, path)
        last = before.agg(F.coalesce(F.max("commit"), F.lit(-1)).alias("m")).first()["m"] if before is not None else -1
        records.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/commit={last + 1}")
    return written


def zrg_commits(spark: SparkSession, path: str) -> DataFrame | None:
    """(name, part, n, digest, commit), or None where nothing was committed."""
    return spark.read.parquet(f"{path}/commits") if exists(spark, f"{path}/commits") else None


def zrg_load(spark: SparkSession, path: str, name: str, schema: str, check: bool = True) -> DataFrame:
    """One stage table as it was committed; with check, a partition that its last commit does not describe is an error."""
    df = spark.read.schema(schema).parquet(f"{path}/{name}")
    df = df.select(*(x.name for x in StructType.fromDDL(schema)))
    if check:
        commits = zrg_commits(spark, path)
        if commits is None:
            raise ValueError(f"nothing was committed at {path}")
        last = commits.where(F.col("name") == name).groupBy("part").agg(F.max_by(F.struct("n", "digest"), "commit").alias("want"))
        have = _record(df, name, _parts(df)).select("part", F.struct("n", "digest").alias("have"))
        bad = [r["part"] for r in last.join(have, "part", "full").where(~F.col("want").eqNullSafe(F.col("have"))).select("part").orderBy("part").limit(10).collect()]
        if bad:
            raise ValueError(f"{name}: partitions differ from their commit: {bad}")
    return df


def result_text(results: DataFrame) -> DataFrame:
    """Ranked result rows as text lines 'rank,[params],cost'."""
    return results.select(F.concat_ws(",", F.col("rank").cast("string"), F.concat(F.lit("["), F.array_join(F.transform("x", lambda v: v.cast("string")), ", "), F.lit("]")), F.col("cost").cast("string")).alias("line"))


def result_scan(lines: DataFrame, line: str = "line", source: Column | None = None) -> DataFrame:
    """Parses such lines; seed from a file name '…seed<N>…' if a source column is given. Vectors may be separated by commas or spaces."""
    c = F.col(line)
    vector = F.regexp_replace(F.regexp_replace(F.regexp_extract(c, r"\[(.*)\]", 1), r"^\s+|\s+$", ""), r"[,\s]+", ",")
    out = lines.select(F.regexp_extract(c, r"^\s*(\d+),", 1).cast("int").alias("rank"), F.from_json(F.concat(F.lit("["), vector, F.lit("]")), "array<double>").alias("x"),
                       F.regexp_extract(c, r"\]\"?,\s*([-+0-9.eE]+)\s*$", 1).cast("double").alias("cost"),
                       *([F.regexp_extract(source, r"seed(\d+)", 1).cast("int").alias("seed")] if source is not None else []))
    return out.where(F.col("x").isNotNull())


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All result files below a path, with the seed of each from its name."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    return result_scan(lines, "value", F.col("file"))


def run_signature(**settings: Column) -> Column:
    """Hash of the settings that a stored result must share to be used again."""
    return F.sha2(F.to_json(F.struct(*(c.alias(k) for k, c in sorted(settings.items())))), 256)


def resume_missing_starts(starts: DataFrame, done: DataFrame) -> DataFrame:
    """Starts without a stored result of the same signature and a cost."""
    return starts.join(done.where(F.col("cost").isNotNull()).select("start_idx", "signature"), ["start_idx", "signature"], "left_anti")
