"""Reading one-text-per-file folders.

Spark's listing skips names that start with ``.`` and also those that start
with ``_``; a folder with such names needs them renamed.  Files are read whole
(a text is one row), in UTF-8, not recursively.

Millions of small files cost more to list than to read.  ``pack`` lists them once
and writes containers of ``(path, text)``; their number follows the bytes and not
the files.  ``read_projects`` and ``read_samples`` read either form alike.
"""

from __future__ import annotations

import sys
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .materialize import materialize

# The folder names of the two classes.
FLAKY_FOLDER = "flakyMethods"
NON_FLAKY_FOLDER = "nonFlakyMethods"

# Fixed values: <project>/case<N>/{f,nf}.<class>.<method>
SAMPLE_PATH = r"([^/]+)/(case[^/]+)/(f|nf)\.(.+)\.([^./]+)$"


# Tasks for each partition of a shuffle that read files.  Spark counts a file as 4 MB
# at least, which makes a task of every 32 small ones.
READ_TASKS = 4


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """All files of a folder (or glob): ``(path, text)``.

    The path is the identity of a row, so listing order means nothing.  A glob of
    folders is listed folder by folder; one of files is looked up file by file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    n = READ_TASKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = files.load(path).coalesce(n)
    return found.select("path", F.decode("content", "UTF-8").alias("text"))


def write_texts(texts: DataFrame, folder: str, folders: list[str]) -> None:
    """Write ``texts(*folders, text)`` as one file per text, ended by a line break, in a
    folder for each value of ``folders``, named as Spark names those of a partitioned table.

    A writer of Spark's makes, checks, moves and commits every file, which costs far more
    than its bytes.  The tasks put them in place themselves; a repeated task writes the
    same files once more."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select(*(F.col(c).cast("string").alias(c) for c in folders), "text").repartition(n)
    run = uuid.uuid4().hex

    def write(batches):
        yield _write_batches(batches, folder, folders, run)

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


#: What Spark escapes in the name of a partition's folder.
_ESCAPED = {chr(c): f"%{c:02X}" for c in [*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^")]}
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _folder_name(column: str, value: str | None) -> str:
    def escaped(name: str) -> str:
        return "".join(_ESCAPED.get(c, c) for c in name)

    return f"{escaped(column)}={escaped(value) if value else _NO_VALUE}"


def _write_batches(batches, folder: str, folders: list[str], run: str) -> pa.RecordBatch:
    system, root = fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else "file://" + folder)
    part, made, n = TaskContext.get().partitionId(), set(), 0
    for batch in batches:
        *values, texts = (batch.column(c).to_pylist() for c in (*folders, "text"))
        for *names, text in zip(*values, texts):
            place = "/".join([root, *map(_folder_name, folders, names)])
            if place not in made:
                system.create_dir(place, recursive=True)
                made.add(place)
            with system.open_output_stream(f"{place}/part-{part:05d}-{run}-{n}.txt") as out:
                out.write(f"{text or ''}\n".encode())
            n += 1
    return pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})


def pack(texts: DataFrame, folder: str) -> None:
    """Write ``texts(path, text)`` as containers: one for each task of their scan,
    which takes many small files at once.  Nothing is shuffled."""
    texts.select("path", "text").write.parquet(folder)


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, text)`` of containers."""
    return spark.read.schema("path string, text string").parquet(folder)


def in_listing_order(texts: DataFrame) -> DataFrame:
    """Add ``position`` (1, 2, …), the place of each row in the order of paths.

    The sort is by ranges of paths, so no task holds all rows.  The sorted rows are
    written first: a task that is repeated cannot number them in another way.
    """
    number = F.monotonically_increasing_id()  # partition, and row within it
    ordered = texts.repartitionByRange("path").sortWithinPartitions("path")
    ordered = ordered.withColumn("_number", number)
    table = materialize(ordered, "listing").withColumn("_part", F.shiftright("_number", 33))
    # One row for each partition, so one task may add them up.
    sizes = table.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    offsets = materialize(offsets, "offsets")
    place = F.col("_off") + F.col("_number").bitwiseAND((1 << 33) - 1) + 1
    return table.join(offsets, "_part").withColumn("position", place).select(
        *texts.columns, "position"
    )


def path_part(path: Column, from_end: int) -> Column:
    """A component of a path, counted from its end (1 is the file name)."""
    return F.element_at(F.split(path, "/"), -from_end)


def with_project_and_label(
    texts: DataFrame, flaky: str = FLAKY_FOLDER, non_flaky: str = NON_FLAKY_FOLDER
) -> DataFrame:
    """``(project, label, file, text)`` from ``…/project/class folder/file``;
    files under other folders are left out."""
    folder = path_part(F.col("path"), 2)
    label = F.when(folder == flaky, 1).when(folder == non_flaky, 0)
    return (
        texts.withColumn("label", label)
        .where(F.col("label").isNotNull())
        .select(
            path_part(F.col("path"), 3).alias("project"),
            "label",
            path_part(F.col("path"), 1).alias("file"),
            "text",
        )
    )


def read_projects(
    spark: SparkSession, base: str, project: str = "*", packed: bool = False
) -> DataFrame:
    """Both classes of one project, or of all projects below ``base`` in one
    scan with ``project`` as a column; ``packed`` reads containers in ``base``."""
    if packed:
        found = with_project_and_label(read_packed(spark, base))
        return found if project == "*" else found.where(F.col("project") == project)
    texts = read_texts(spark, f"{base}/{project}/{{{FLAKY_FOLDER},{NON_FLAKY_FOLDER}}}/*")
    return with_project_and_label(texts)


def combine_classes(flaky: DataFrame, non_flaky: DataFrame) -> DataFrame:
    """Put the two classes together with labels 1 and 0."""
    return flaky.withColumn("label", F.lit(1)).unionByName(
        non_flaky.withColumn("label", F.lit(0))
    )


def parse_sample_paths(texts: DataFrame) -> DataFrame:
    """``(project, case_id, label, class_name, method, text)`` of inspection
    samples, from their paths."""

    def part(group: int) -> Column:
        return F.regexp_extract("path", SAMPLE_PATH, group)

    return texts.where(F.col("path").rlike(SAMPLE_PATH)).select(
        part(1).alias("project"),
        part(2).alias("case_id"),
        F.when(part(3) == "f", 1).otherwise(0).alias("label"),
        part(4).alias("class_name"),
        part(5).alias("method"),
        "text",
    )


def read_samples(spark: SparkSession, base: str, packed: bool = False) -> DataFrame:
    if packed:
        return parse_sample_paths(read_packed(spark, base))
    return parse_sample_paths(read_texts(spark, f"{base}/*/case*/*"))


def paired_samples(samples: DataFrame) -> DataFrame:
    """Flaky and non-flaky sample of the same case, side by side."""
    keys = ["project", "case_id"]

    def side(label: int, prefix: str) -> DataFrame:
        rows = samples.where(F.col("label") == label)
        return rows.select(
            *keys,
            *[F.col(c).alias(prefix + c) for c in ("class_name", "method", "text")],
        )

    return side(1, "flaky_").join(side(0, "stable_"), keys)


# Workers get these functions by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
