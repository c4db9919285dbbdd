"""Readers and writers of the tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge import config
from prosegauge.functions.text import n_words

#: Below so many bytes a table counts as small.
SMALL_BYTES = 1 << 30

#: Bytes of a table of pages that one task takes; sorting their tokens holds many times as much.
PAGE_BYTES = 4 << 20

#: Names of files in a batch of a listing, and bytes of their contents in a batch that is read.
LISTED_ROWS, READ_BYTES = 10_000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def table_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Bytes of the files of a table, from their listing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(sf_dir, f"{name}.parquet"))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def parts_of_small(spark: SparkSession, sf_dir: str, name: str, small: int = SMALL_BYTES) -> int | None:
    """Twice the cores for a table under `small` bytes, else None.

    A small table may be a single split, which would keep one core busy; a large one
    is better left as its files are split.
    """
    return 2 * spark.sparkContext.defaultParallelism if table_bytes(spark, sf_dir, name) < small else None


def parts_by_size(spark: SparkSession, sf_dir: str, name: str, each: int | None = None) -> int:
    """A part for every `each` bytes of a table, twice the cores at least: what a task holds does not grow with the table."""
    size = -(-table_bytes(spark, sf_dir, name) // (each or PAGE_BYTES))
    return max(2 * spark.sparkContext.defaultParallelism, size)


def spread(df: DataFrame, parts: int | None) -> DataFrame:
    """Deal rows out to `parts` partitions, or leave them where they are."""
    return df if parts is None else df.repartition(parts)


def load_documents(spark: SparkSession, sf_dir: str, *columns: str, parts: int | None = None) -> DataFrame:
    """Documents as (doc_id, text) and the named extra columns, dealt out to `parts` partitions if asked for."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns), parts)


def load_named_texts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of named texts (an array or one object per line)."""
    schema = "name string, text string, note string"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _arrow_folder(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """A folder as Spark names it and as a URI for Arrow; None for patterns, single files and stores that Arrow cannot open."""
    import pyarrow as pa
    import pyarrow.fs as pafs

    if set(path) & set("{}[]*?\\"):
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at)
    uri = at.toUri().toASCIIString()
    try:
        fs, base = pafs.FileSystem.from_uri(uri)
        found = fs.get_file_info(base).type
    except (pa.ArrowException, OSError):
        return None
    return (at.toString(), uri) if found == pafs.FileType.Directory else None


def _opened(uri: str, below: bool):
    """For batches of (inside, length): folders, which have no length, make room for what stands in them, or for all files below."""

    def opened(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(uri)
        # What Spark's own readers pass over.
        hidden = lambda name: name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
        for batch in batches:
            inside, length = batch.columns
            files = batch.filter(length.is_valid())
            yield pa.RecordBatch.from_arrays([files.column(0).cast(pa.string()), files.column(1)], names=["inside", "length"])
            folders = inside.filter(length.is_null()).to_pylist()
            while folders:
                inside = folders.pop()
                names, sizes = [], []
                for x in fs.get_file_info(pafs.FileSelector(f"{base}/{inside}" if inside else base)):
                    if x.type == pafs.FileType.NotFound or hidden(x.base_name):
                        continue
                    name = f"{inside}/{x.base_name}" if inside else x.base_name
                    if below and x.type == pafs.FileType.Directory:
                        folders.append(name)
                    else:
                        names.append(name)
                        sizes.append(x.size)
                for i in range(0, len(names), LISTED_ROWS):
                    some = slice(i, i + LISTED_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(names[some], pa.string()), pa.array(sizes[some], pa.int64())], names=["inside", "length"])

    return opened


def _contents(uri: str):
    """For batches of (inside, status): the content of the files that are ok, in batches of some READ_BYTES."""

    def contents(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            begin, held, read = 0, 0, []
            for at, (inside, status) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True), 1):
                if status == "ok":
                    with fs.open_input_stream(f"{base}/{inside}", compression=None) as file:
                        read.append(file.read())
                    held += len(read[-1])
                else:
                    read.append(None)
                if held >= READ_BYTES or at == batch.num_rows:
                    names, statuses = (c.slice(begin, at - begin).cast(pa.string()) for c in batch.columns)
                    yield pa.RecordBatch.from_arrays([names, statuses, pa.array(read, pa.binary())], names=["inside", "status", "content"])
                    begin, held, read = at, 0, []

    return contents


def load_text_files(
    spark: SparkSession, path: str, types: dict[str, str] | None = None, most_bytes: int | None = None, parts: int | None = None
) -> DataFrame:
    """Text files as (path, text, status).

    A file counts as text by its extension or, where the caller knows it, by
    its MIME type (`types` maps an extension to one).  Other files and files
    over a caller's limit of bytes are listed with a status and no text.  Only the
    content of files that are returned is read: names and sizes filter the listing.
    Tasks list a folder, each folder in one task, and deal its files out by name to
    `parts` tasks that read them, twice the cores if not given; the driver holds no file.
    A pattern, a single file or a store that Arrow cannot open goes through Spark's reader, whose
    listing stands on the driver, and which passes over empty files.
    """
    extensions = list(config.TEXT_EXTENSIONS) + [
        e for e, mime in (types or {}).items() if mime.startswith("text/")
    ]
    small = F.lit(True) if most_bytes is None else F.col("length") <= most_bytes
    readable = lambda name: F.col(name).rlike(f"(?i)\\.(?:{'|'.join(extensions)})\\z")
    folder = _arrow_folder(spark, path)
    if folder is not None:
        place, uri = folder
        tasks = 2 * spark.sparkContext.defaultParallelism
        named = "inside string, length bigint"
        found = spark.range(0, 1, 1, 1).select(F.lit("").alias("inside"), F.lit(None).cast("bigint").alias("length"))
        found = found.mapInArrow(_opened(uri, False), named)
        # The folders of two levels are dealt out; from there a task goes on to the end.
        for below in (False, True):
            found = found.repartition(tasks, "inside").mapInArrow(_opened(uri, below), named)
        status = F.when(~small, "too_large").when(~readable("inside"), "unsupported").otherwise("ok")
        files = found.repartition(parts or tasks, "inside").select("inside", status.alias("status"))
        return files.mapInArrow(_contents(uri), "inside string, status string, content binary").select(
            F.concat(F.lit(place.rstrip("/") + "/"), "inside").alias("path"), F.decode("content", "UTF-8").alias("text"), "status"
        )
    any_case = lambda name: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    texts = (
        reader.option("pathGlobFilter", "*.{" + ",".join(map(any_case, extensions)) + "}")
        .load(path)
        .filter(small)
        .select("path", F.decode("content", "UTF-8").alias("text"), F.lit("ok").alias("status"))
    )
    # A reader keeps its options, so the listing of everything starts anew.
    everything = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    status = F.when(~small, "too_large").when(~readable("path"), "unsupported")
    others = everything.select("path", F.lit(None).cast("string").alias("text"), status.alias("status"))
    others = others.filter(F.col("status").isNotNull())
    if parts is not None:
        texts, others = texts.coalesce(parts), others.coalesce(parts)
    return texts.unionByName(others)


def load_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages reached over http or https."""
    return table(spark, sf_dir, "pages").filter(F.col("url").rlike("^https?:"))


MODES = ("auto", "selection", "page")


def scope_of(mode: str, passage: Column, text: Column, most: int | None = None) -> Column:
    """What a mode scores, as (scope, scope_status, scope_text).

    `auto` takes the passage when it has enough words, `selection` insists on
    it, `page` ignores it.  `most` is a caller's limit of characters for passages.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    chosen = F.coalesce(passage, F.lit(""))
    words = n_words(chosen)
    wants: Column = {"selection": F.lit(True), "auto": words >= config.MIN_WORDS, "page": F.lit(False)}[mode]
    too_large = F.lit(False) if most is None else F.length(chosen) > most
    status = (
        F.when(too_large, "too_large")
        .when(wants & (words == 0), "nothing_selected")
        .otherwise("ok")
    )
    return F.struct(
        F.when(wants, "selection").otherwise("page").alias("scope"),
        status.alias("scope_status"),
        F.when(status == "ok", F.when(wants, chosen).otherwise(text)).alias("scope_text"),
    )


def choose_scope(
    df: DataFrame, mode: str, passage: str = "passage", text: str = "text", most: int | None = None
) -> DataFrame:
    """Add `scope`, `scope_text` and `scope_status`, see `scope_of`."""
    chosen = scope_of(mode, F.col(passage), F.col(text), most)
    return df.withColumns({name: chosen[name] for name in ("scope", "scope_status", "scope_text")})


def write_results(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Analysis records as parquet, one folder per band.

    Rows are not moved before writing; each task writes at most one file per
    band.
    """
    df.write.mode(mode).partitionBy("band").parquet(path)


def results_json(df: DataFrame) -> DataFrame:
    """Each record as one JSON string, ready for a text sink."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_results_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    results_json(df).write.mode(mode).text(path)
