"""File sources (SRC1-SRC5, SRC8-SRC10).

Rows are read with Spark readers; the driver only ever sees file names and
header lines, a chunk at a time, never rows.
CSV columns are read as strings and cast with ``try_cast`` later -- schema
inference is never used.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from fnmatch import fnmatch
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.functions.scalars import contains_ci
from stepwise.session import scratch_path, write_and_reload

FILE_COL = "source_file"


def _file_table(spark: SparkSession, root: str, glob: str = "*", with_content: bool = False) -> DataFrame:
    r = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
         .option("pathGlobFilter", glob).load(root))
    cols = ["path", "length", "modificationTime"] + (["content"] if with_content else [])
    return r.select(*cols)


# SRC1 ------------------------------------------------------------------------
def read_csv_any_encoding(spark: SparkSession, root: str, glob: str = "*.csv",
                          fallback: str = "ISO-8859-1", header: bool = True) -> DataFrame:
    """Read CSV files as UTF-8 when valid, else with ``fallback`` -- decided
    per file with ``is_valid_utf8`` on the bytes (Spark itself never raises on
    bad bytes, it replaces them)."""
    files = _file_table(spark, root, glob, with_content=True).select(
        "path", F.expr("is_valid_utf8(content)").alias("utf8"))
    groups: dict[bool, list[str]] = {}
    for r in files.collect():   # (file name, flag) pairs only -- one pass over the bytes
        groups.setdefault(bool(r["utf8"]), []).append(r["path"])
    if not groups:
        raise ValueError(f"no file {glob} below {root}")
    parts = []
    for ok, paths in groups.items():
        if paths:
            parts.append(spark.read.option("header", header).option("encoding", "UTF-8" if ok else fallback)
                         .csv(paths).withColumn(FILE_COL, F.input_file_name()))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# SRC2 / SRC3 / SRC4 ----------------------------------------------------------
def _one_scheme(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\w+):/+", "$1:/")


def _plain_path(c: Column) -> Column:
    """The path of ``_metadata.file_path`` as a file listing gives it, without URL encoding."""
    return _one_scheme(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))))


def file_headers(spark: SparkSession, root: str, glob: str = "*.csv", max_line: int = 1 << 20, chunk: int = 10_000) -> DataFrame:
    """Rows (path, header) of the files below ``root``: the first line of each, null where there is none.

    Only the first buffer of a file is read, and at most ``max_line`` bytes, so what is
    read does not grow with the size of a file.  (Readers of whole files cannot do this:
    a task that takes one line still has its input drained.)  The driver opens the
    files on a few threads and hands them on ``chunk`` by chunk; it never holds more.
    Files are plain text, not compressed."""
    path = scratch_path(spark, "file-headers")
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def first_line(name: str) -> tuple[str, str | None]:
        p = jvm.org.apache.hadoop.fs.Path(name)
        stream = p.getFileSystem(conf).open(p)
        try:
            some = jvm.org.apache.commons.io.input.BoundedInputStream(stream, max_line)
            line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(some, "UTF-8")).readLine()
        finally:
            stream.close()
        return name, line if line and line.strip() else None

    def names() -> Iterator[str]:
        # Spark's readers leave out empty files, so the folder is listed itself
        top = jvm.org.apache.hadoop.fs.Path(root)
        fs = top.getFileSystem(conf)
        for found in fs.globStatus(top) or ():
            files = fs.listFiles(found.getPath(), True)
            while files.hasNext():
                name = files.next().getPath().toString()
                below = name[len(found.getPath().toString()):].strip("/").split("/")
                if fnmatch(name.rsplit("/", 1)[1], glob) and not any(x[:1] in ("_", ".") and "=" not in x for x in below):
                    yield name

    todo = names()
    schema = "path string, header string"
    spark.createDataFrame([], schema).write.parquet(path)
    with ThreadPoolExecutor(max_workers=16) as pool:
        while some := list(islice(todo, chunk)):
            spark.createDataFrame(list(pool.map(first_line, some)), schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).withColumn("path", _one_scheme(F.col("path")))


def header_names(header: Column, sep: str = ",") -> Column:
    """Column names of a header line, without quotes, blanks and a byte-order mark."""
    clean = F.regexp_replace(header, "^\ufeff|\r$", "")
    return F.transform(F.split(clean, F.lit("\\Q" + sep + "\\E")), lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', "")))


def bad_files(headers: DataFrame, required: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """Rows (path, reason) of the files that are passed over: no header, or required columns are absent."""
    names = header_names(F.col("header"), sep)
    lacking = F.array_except(F.array(*[F.lit(c) for c in required]).cast("array<string>"), names)
    reason = F.when(F.col("header").isNull(), F.lit("no header line")).when(F.size(lacking) > 0, F.concat(F.lit("lacks "), F.array_join(lacking, ", ")))
    return headers.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def read_labelled(spark: SparkSession, root: str, pattern: str, label_regex: str,
                  label: str = "label", expected: Sequence[str] | None = None,
                  required: Sequence[str] = (), sep: str = ",", headers: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Read every file matching ``pattern`` below ``root``; tag rows with a label
    extracted from the file path; files may differ in their columns (schema eras), a
    column that a file lacks is null.  Files of :func:`bad_files` are passed over.

    All files are one scan by position; each row finds its columns through its file's
    header.  The driver sees the distinct column names, not the files.  Returns the
    frame and the expected labels with no file (warnings)."""
    headers = file_headers(spark, root, pattern) if headers is None else headers
    good = headers.join(bad_files(headers, required, sep).select("path"), "path", "left_anti").select(
        F.col("path").alias("_path"), header_names(F.col("header"), sep).alias("_names"))
    good = write_and_reload(good, "headers")   # one row per file
    width = good.agg(F.max(F.size("_names"))).first()[0] or 0
    names = [r[0] for r in good.select(F.explode("_names").alias("n"), F.posexplode("_names").alias("i", "m")).where("n = m")
             .groupBy("n").agg(F.min("i").alias("i")).orderBy("i", "n").collect()]   # distinct column names
    found = set()
    if expected:
        tags = good.select(F.regexp_extract("_path", label_regex, 1).alias("t")).where(F.col("t").isin(list(expected))).distinct()
        found = {r[0] for r in tags.collect()}   # at most the expected ones
    missing = [e for e in (expected or []) if e not in found]
    if not width:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [FILE_COL, label])), missing
    cells = [f"_c{i}" for i in range(width)]
    rows = (spark.read.schema(", ".join(f"{c} string" for c in cells)).option("header", True).option("sep", sep).option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern).csv(root).withColumn(FILE_COL, F.col("_metadata.file_path")))
    rows = rows.withColumn("_path", _plain_path(F.col(FILE_COL))).join(good, "_path").withColumn("_cells", F.array(*cells))
    # a position of 0 is a column that the file does not have
    at = {c: F.array_position("_names", F.lit(c)).cast("int") for c in names}
    out = rows.select(*[F.when(at[c] > 0, F.try_element_at("_cells", F.nullif(at[c], F.lit(0)))).alias(c) for c in names], FILE_COL)
    return out.withColumn(label, F.regexp_extract(_plain_path(F.col(FILE_COL)), label_regex, 1)), missing


# SRC5 ------------------------------------------------------------------------
def census(spark: SparkSession, root: str, kinds: Mapping[str, str], season_regex: str) -> tuple[DataFrame, DataFrame]:
    """Walk the tree (metadata only), classify each file by the first
    matching path pattern, count files and first/last season per kind, and
    pick one representative file per (kind, season)."""
    files = _file_table(spark, root)
    kind = None
    for name, rx in kinds.items():
        cond = F.col("path").rlike(rx)
        kind = F.when(cond, F.lit(name)) if kind is None else kind.when(cond, F.lit(name))
    tagged = files.withColumn("kind", kind.otherwise(F.lit("other"))).withColumn(
        "season", F.regexp_extract("path", season_regex, 1))
    summary = tagged.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"),
                                         F.min(F.nullif("season", F.lit(""))).alias("first_season"),
                                         F.max(F.nullif("season", F.lit(""))).alias("last_season"))
    reps = tagged.groupBy("kind", "season").agg(F.min("path").alias("representative"))
    return summary, reps


# SRC8 ------------------------------------------------------------------------
#: Logical nodes a parsed query may consist of; commands and inserts are none of them.
_QUERY_NODES = {
    "Aggregate", "AsOfJoin", "Deduplicate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit",
    "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "RepartitionByExpression", "Sample", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving",
    "UnresolvedInlineTable", "UnresolvedOrderBy", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTVFAliases",
    "UnresolvedTableValuedFunction", "UnresolvedWith", "Unpivot", "View", "Window", "WithWindowDefinition",
}


def read_only_sql(spark: SparkSession, text: str, args: Mapping | None = None) -> DataFrame:
    """Ad hoc SQL over registered views with bound parameters
    (``:name`` markers).  Spark's parser reads the text, and only a plan made of
    query nodes is accepted: no command, no insert, no second statement."""
    from pyspark.errors import ParseException
    body = text.strip().rstrip(";").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    except ParseException as e:
        raise ValueError("only a single read-only query is allowed") from e
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() not in _QUERY_NODES:
            raise ValueError(f"only a single read-only query is allowed, not {node.nodeName()}")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return spark.sql(body, args=dict(args or {}))


# SRC9 ------------------------------------------------------------------------
def browse(df: DataFrame, filters: Mapping[str, str], limit: int = 100, max_limit: int = 500,
           order: Sequence[str] | None = None) -> DataFrame:
    """Per-column case-insensitive ``contains`` filters joined by AND, capped
    at ``max_limit`` rows (a display table, the limit is the feature);
    ``order`` makes the shown rows deterministic."""
    conds = [contains_ci(F.col(c), v) for c, v in filters.items() if v]
    out = df.where(reduce(lambda a, b: a & b, conds)) if conds else df
    if order:
        out = out.orderBy(*order)
    return out.limit(min(limit, max_limit))


# SRC10 -----------------------------------------------------------------------
def list_slices(spark: SparkSession, root: str, regex: str) -> DataFrame:
    """Distinct (epoch, step) slices named by files below ``root``, newest first."""
    files = _file_table(spark, root)
    s = files.select(F.regexp_extract("path", regex, 1).cast("int").alias("epoch"),
                     F.regexp_extract("path", regex, 2).cast("int").alias("step")).where("epoch IS NOT NULL")
    return s.distinct().orderBy(F.col("epoch").desc(), F.col("step").desc())
