"""Readers of manifests, artifacts, archives and registries. Malformed input becomes rows of flags or quarantine; it never stops a read."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import magic, member_path_problems

MANIFEST = "file_id string, object_id string, split string, relative_path string, extension string, size_bytes bigint, sha256 string, stage string, section string, pdf_pages int, annotation_status string, exclusion_reason string, duplicate_group string"
TOKENS = "tokens array<struct<id:int,text:string,bbox:array<double>,conf:double,source:string,line_id:int,layer:string>>"
HIDDEN = "TEST_HIDDEN"
MAX_MEMBERS, MAX_RATIO, MAX_BYTES = 10_000, 200, 1 << 31


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; strict stops at a malformed line, else it is left in _corrupt."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def manifest(spark: SparkSession, path: str, vocabularies: dict[str, tuple[str, ...]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, flags): rows of the manifest as they are, and a flag for each malformed row, unknown word and repeated id."""
    rows = jsonl(spark, path, MANIFEST)
    good = rows.where("_corrupt is null and file_id is not null").drop("_corrupt")
    flags = rows.where("_corrupt is not null or file_id is null").select(F.lit(None).cast("string").alias("file_id"), F.lit("MALFORMED_ROW").alias("code"), F.coalesce("_corrupt", F.lit("")).alias("detail"))
    for c, words in (vocabularies or {}).items():
        flags = flags.unionByName(good.where(F.col(c).isNotNull() & ~F.col(c).isin(*words)).select("file_id", F.lit("UNKNOWN_WORD").alias("code"), F.concat(F.lit(c + "="), F.col(c)).alias("detail")))
    repeated = good.groupBy("file_id").agg(F.count("*").alias("n")).where("n > 1").select("file_id", F.lit("REPEATED_ID").alias("code"), F.col("n").cast("string").alias("detail"))
    return good, flags.unionByName(repeated)


def visible(files: DataFrame, policy: DataFrame, split: str = HIDDEN) -> DataFrame:
    """Files of objects that are not in the hidden split: (split, object_id) rows of the policy."""
    return files.join(policy.where(F.col("split") == split).select("object_id").distinct(), "object_id", "left_anti")


def split_policy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((split, object_id), excluded file ids) of a policy document."""
    doc = spark.read.schema("splits map<string,array<string>>, excluded_file_ids array<string>").option("multiLine", True).json(path)
    return doc.select(F.explode("splits").alias("split", "ids")).select("split", F.explode("ids").alias("object_id")), doc.select(F.explode("excluded_file_ids").alias("file_id"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, relative_path) of a checksum list."""
    line = F.col("value")
    return spark.read.text(path).where(line.rlike("^[0-9a-f]{64} [ *]")).select(F.substring(line, 1, 64).alias("sha256"), F.expr("substring(value, 67)").alias("relative_path"))


def checksum_flags(files: DataFrame, sums: DataFrame) -> DataFrame:
    """(relative_path, code): MISSING_SUM, EXTRA_SUM, DIFFERENT_SUM."""
    a, b = files.select("relative_path", F.col("sha256").alias("_a")), sums.select("relative_path", F.col("sha256").alias("_b"))
    code = F.when(F.col("_b").isNull(), "MISSING_SUM").when(F.col("_a").isNull(), "EXTRA_SUM").when(F.col("_a") != F.col("_b"), "DIFFERENT_SUM")
    return a.join(b, "relative_path", "full_outer").select("relative_path", code.alias("code")).where("code is not null")


#: Header names under which a registry may have its columns.
ALIASES = {"name": ("name", "file", "file_name", "имя", "файл"), "stage": ("stage", "стадия"), "section": ("section", "раздел")}


def registry_csv(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(name, stage, section) of a registry, whatever its header calls them; absent columns are null, names are normalised."""
    raw = spark.read.option("header", True).option("encoding", encoding).csv(path)
    by = {c.strip().lower(): c for c in raw.columns}
    pick = lambda k: next((F.col(f"`{by[a]}`") for a in ALIASES[k] if a in by), F.lit(None).cast("string"))
    return raw.select(F.lower(F.trim(pick("name"))).alias("name"), pick("stage").alias("stage"), pick("section").alias("section")).where("name is not null")


def binaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, media_type, content) of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", magic(F.col("content")).alias("media_type"), "content")


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zipfile

    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            rows = []
            try:
                infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
                packed = sum(i.compress_size for i in infos) or 1
                total = sum(i.file_size for i in infos)
                if len(infos) > MAX_MEMBERS or total > MAX_BYTES or total / packed > MAX_RATIO:
                    rows.append((path, None, None, "ARCHIVE_TOO_LARGE"))
                else:
                    rows += [(path, i.filename, i.file_size, None) for i in infos if not i.is_dir()]
            except zipfile.BadZipFile:
                rows.append((path, None, None, "NOT_AN_ARCHIVE"))
            yield pd.DataFrame(rows, columns=["path", "member", "size", "problem"]).astype({"size": "Int64"})


def archive_members(files: DataFrame) -> DataFrame:
    """(path, member, size, problem) of zip archives, within bounds on members, bytes and ratio; unsafe names are named in unsafe."""
    out = files.select("path", "content").mapInPandas(_members, "path string, member string, size bigint, problem string")
    return out.withColumn("unsafe", member_path_problems(F.coalesce("member", F.lit("-"))))


def page_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, page_no, token fields) of page documents whose paths end in <file_id>/p<page>.json[.gz]."""
    at = F.input_file_name()
    docs = spark.read.schema(TOKENS).option("recursiveFileLookup", True).json(path)
    keyed = docs.select(F.regexp_extract(at, r"([^/]+)/p(\d+)\.json", 1).alias("file_id"), F.regexp_extract(at, r"([^/]+)/p(\d+)\.json", 2).try_cast("int").alias("page_no"), "tokens")
    return keyed.select("file_id", "page_no", F.explode_outer("tokens").alias("t")).select("file_id", "page_no", "t.*")


def artifacts(rows: DataFrame, files: DataFrame, key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine): artifacts whose file and sha256 stand in the manifest; the others with a reason."""
    known = files.select(key, F.col("sha256").alias("_sha"))
    both = rows.join(known, key, "left")
    reason = F.when(F.col("_sha").isNull(), "UNKNOWN_FILE").when(~F.col("sha256").eqNullSafe(F.col("_sha")), "OTHER_CONTENT")
    marked = both.withColumn("reason", reason).drop("_sha")
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON predictions of a file or a folder tree; sidecar files are passed over."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").json(path)
    return rows.where(~F.input_file_name().endswith(".sidecar.json"))


def expect(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine with the names of the rules that fail); a rule that is unknown fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    marked = rows.withColumn("failed", failed)
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)


def registry_json(spark: SparkSession, path: str) -> DataFrame:
    """(name, stage, section) of a registry in JSON, whatever it calls them; absent fields are null."""
    raw = spark.read.option("multiLine", True).json(path)
    by = {c.strip().lower(): c for c in raw.columns}
    pick = lambda k: next((F.col(f"`{by[a]}`").cast("string") for a in ALIASES[k] if a in by), F.lit(None).cast("string"))
    return raw.select(F.lower(F.trim(pick("name"))).alias("name"), pick("stage").alias("stage"), pick("section").alias("section")).where("name is not null")


def archive_member(files: DataFrame, member: str, most: int = MAX_BYTES) -> DataFrame:
    """(path, content, problem) of one member of each zip archive: its name must be safe and its size within `most`; otherwise a problem and no content."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zipfile

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        info = z.getinfo(member)
                        rows.append((path, None, "TOO_LARGE") if info.file_size > most else (path, z.read(info), None))
                except zipfile.BadZipFile:
                    rows.append((path, None, "NOT_AN_ARCHIVE"))
                except KeyError:
                    rows.append((path, None, "NO_MEMBER"))
            yield pd.DataFrame(rows, columns=["path", "content", "problem"])

    out = files.select("path", "content").mapInPandas(read, "path string, content binary, problem string")
    unsafe = F.size(member_path_problems(F.lit(member))) > 0
    return out.select("path", F.when(~unsafe, F.col("content")).alias("content"), F.when(unsafe, "UNSAFE_NAME").otherwise(F.col("problem")).alias("problem"))


def typed_jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): rows of JSON lines, and an error for each line that is no JSON of the schema (MALFORMED) or lacks a required field (MISSING_<field>)."""
    rows = jsonl(spark, path, schema)
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"MISSING_{c.upper()}")) for c in required])) if required else F.array().cast("array<string>")
    codes = F.when(F.col("_corrupt").isNotNull(), F.array(F.lit("MALFORMED"))).otherwise(lacking)
    marked = rows.withColumn("_codes", codes)
    return marked.where(F.size("_codes") == 0).drop("_codes", "_corrupt"), marked.select(F.explode("_codes").alias("code"), "_corrupt").withColumnRenamed("_corrupt", "line")


def token_words(tokens: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """(file_id, page_no, word_no, text, x0, y0, x1, y1) of the tokens' words in page units; a token of several words gives each its share of the width."""
    parts = F.split(F.trim("text"), r"\s+")
    rows = tokens.where(F.trim("text") != "").withColumn("_n", F.size(parts)).select("file_id", "page_no", "id", "bbox", width, height, "_n", F.posexplode(parts).alias("word_no", "text"))
    step = (F.col("bbox")[2] - F.col("bbox")[0]) / F.col("_n")
    left = F.col("bbox")[0] + F.col("word_no") * step
    return rows.select("file_id", "page_no", "id", "word_no", "text", (left * F.col(width)).alias("x0"), (F.col("bbox")[1] * F.col(height)).alias("y0"), ((left + step) * F.col(width)).alias("x1"), (F.col("bbox")[3] * F.col(height)).alias("y1"))


def region_tokens(store: DataFrame, file_id: str, page_no: int, region: tuple[float, float, float, float]) -> DataFrame:
    """Tokens of a page whose centre lies in a region; file and page reach the partitions of a stored table as filters."""
    x, y = (F.col("bbox")[0] + F.col("bbox")[2]) / 2, (F.col("bbox")[1] + F.col("bbox")[3]) / 2
    return store.where((F.col("file_id") == file_id) & (F.col("page_no") == page_no)).where(x.between(region[0], region[2]) & y.between(region[1], region[3]))


def run_predictions(spark: SparkSession, run: str, schema: str) -> DataFrame:
    """Predictions of a run's folder: its `submission` folder where there is one, else every JSON of the tree but sidecars; `source` names the file."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        rows = predictions(spark, f"{run.rstrip('/')}/submission", schema)
    except (AnalysisException, Py4JJavaError):
        rows = predictions(spark, run, schema)
    return rows.withColumn("source", F.element_at(F.split(F.input_file_name(), "/"), -1))


def checked_index(index: DataFrame, found: DataFrame, most_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, problem) of an index against the files that are there: MISSING, NOT_LISTED, OTHER_CONTENT, OTHER_SIZE, TOO_LARGE."""
    a = index.select("path", F.col("sha256").alias("_a"), F.col("size").alias("_n"))
    both = a.join(found.select("path", F.col("sha256").alias("_b"), F.col("size").alias("_m")), "path", "full_outer")
    problem = F.when(F.col("_b").isNull(), "MISSING").when(F.col("_a").isNull(), "NOT_LISTED").when(F.col("_m") > most_bytes, "TOO_LARGE").when(F.col("_n") != F.col("_m"), "OTHER_SIZE").when(F.col("_a") != F.col("_b"), "OTHER_CONTENT")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def loaded_manifest(spark: SparkSession, path: str, excluded: DataFrame | None = None, policy: DataFrame | None = None, vocabularies: dict[str, tuple[str, ...]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, flags) of a manifest without excluded files and hidden objects; of a repeated id the first path counts."""
    files, flags = manifest(spark, path, vocabularies)
    rest = [c for c in files.columns if c != "file_id"]
    files = files.groupBy("file_id").agg(F.min_by(F.struct(*rest), F.struct("relative_path", "sha256")).alias("_r")).select("file_id", "_r.*")
    if excluded is not None:
        files = files.join(excluded.select("file_id").distinct(), "file_id", "left_anti")
    return (visible(files, policy) if policy is not None else files), flags
