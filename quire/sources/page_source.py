"""A data source of PDF pages: partitions of (file, share of its pages), read by seeking, with filters on page pushed down.

    spark.dataSource.register(PdfPages)
    spark.read.format("quire_pdf_pages").option("path", folder).load().where("page <= 3")

A file of more than part_bytes is dealt out in so many shares as it has parts of that size; who gets one opens the file,
reads its cross-references and page tree, and only the objects of that share of the pages. A partition holds many small
files and shares, and of shares of one file as few as there are partitions for them. No bytes of a file ever leave the task
that read them; planning looks at names and sizes only. pages() has the executors list the folder and write what each
partition is to read, so that the driver sees no names; a plain read of the format lists the folder where it is planned."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from quire.session import materialise, open_fs, scratch_path

NAME = "quire_pdf_pages"
#: Bytes of files that make a partition, and of which a great file's parts are.
PART_BYTES = 8 << 20
_LEAST_BYTES = 1 << 16


@dataclass
class Wanted:
    """The page numbers that pushed filters leave."""

    low: float = 1
    high: float = float("inf")
    only: set[int] | None = None
    any: bool = False

    def narrow(self, f: Filter) -> bool:
        """Whether f is about page and has been taken in."""
        if getattr(f, "attribute", None) != ("page",) or getattr(f, "value", None) is None:
            return False
        if isinstance(f, (EqualTo, In)):
            values = {f.value} if isinstance(f, EqualTo) else {v for v in f.value if v is not None}
            self.only = values if self.only is None else self.only & values
        elif isinstance(f, GreaterThan):
            self.low = max(self.low, f.value + 1)
        elif isinstance(f, GreaterThanOrEqual):
            self.low = max(self.low, f.value)
        elif isinstance(f, LessThan):
            self.high = min(self.high, f.value - 1)
        elif isinstance(f, LessThanOrEqual):
            self.high = min(self.high, f.value)
        else:
            return False
        self.any = True
        return True

    def of(self, count: int) -> list[int]:
        if self.only is not None:
            return sorted(p for p in self.only if max(1, self.low) <= p <= min(count, self.high))
        return list(range(max(1, int(self.low)), int(min(count, self.high)) + 1))


#: A file's path, and which of how many shares of its pages (0 of 1: all).
Part = tuple[str, int, int]


@dataclass
class Dealt(InputPartition):
    """What one task reads: parts, or the folder of the plan that names them."""

    parts: list[Part] = field(default_factory=list)
    plan: str | None = None

    def named(self) -> list[Part]:
        if self.plan is None:
            return self.parts
        from pyarrow import fs, parquet

        store, base = open_fs(self.plan)
        if store.get_file_info(base).type != fs.FileType.Directory:
            return []  # no part fell to this task
        found = [f.path for f in store.get_file_info(fs.FileSelector(base)) if f.is_file and f.path.endswith(".parquet")]
        tables = [parquet.ParquetFile(store.open_input_file(path)).read(["path", "number", "shares"]).to_pydict() for path in sorted(found)]
        return [part for t in tables for part in zip(t["path"], t["number"], t["shares"])]


def partitions_of(size: int, parts: int, part_bytes: int, slots: int) -> int:
    """Partitions for so many bytes in so many parts: each of a part's size, or less where there would be too few for the slots."""
    size += parts << 12  # an empty file costs its opening
    full = min(max(part_bytes, PART_BYTES), max(_LEAST_BYTES, size // (2 * slots)))
    return max(1, -(-size // full), min(parts, 4 * slots))


class PageReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", ".pdf")
        self.images = str(options.get("images", "false")).lower() == "true"
        self.part_bytes = max(1, int(options.get("part_bytes", PART_BYTES)))
        self.slots = max(1, int(options.get("slots", 1)))
        self.plan, self.planned = options.get("plan"), int(options.get("partitions", 0))
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.wanted.narrow(f):
                yield f

    def partitions(self) -> list[Dealt]:
        if self.plan:
            return [Dealt(plan=f"{self.plan}/slot={n}") for n in range(self.planned)]
        from pyarrow import fs

        store, base = open_fs(self.path)
        prefix = self.path[: len(self.path) - len(base)] if self.path.endswith(base) else ""
        found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and f.path.endswith(self.suffix))
        shares = [(prefix + path, max(1, -(-size // self.part_bytes))) for path, size in found]
        parts = [(path, number, of) for path, of in shares for number in range(of)]
        count = partitions_of(sum(size for _, size in found), len(parts), self.part_bytes, self.slots)
        return [Dealt(parts[n::count]) for n in range(count)]

    def read(self, partition: Dealt) -> Iterator[pa.RecordBatch]:
        from quire.sources import loader, ranged

        def rows() -> Iterator[dict]:
            for path, number, shares in partition.named():
                source = ranged.opened(path)
                # the head of a file is told once, by its first share; a filter on page leaves heads out
                for row in loader.decode_one(source, self.wanted.of, self.images, number == 0 and not self.wanted.any, (number, shares)):
                    yield {"path": path} | row
                source.close()

        yield from loader.batches(rows(), "path")


class PdfPages(DataSource):
    """Rows of loader.PAGES, keyed by path: a head for each file, a row for each page, a row for each image object.

    Options: path (a folder), suffix (.pdf), images (false), part_bytes, slots (tasks that run at once); plan and partitions
    (a folder that names the parts of each partition, and their number) instead of looking into path."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        from quire.sources import loader

        return f"path string, {loader.PAGES}"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options, schema)


def pages(spark: SparkSession, folder: str, images: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """The pages of all files of a folder, listed now by the executors; filters on page reach the reader."""
    from quire.sources import loader

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark refuses to plan a reader that can push otherwise
    spark.dataSource.register(PdfPages)
    slots, plan = spark.sparkContext.defaultParallelism, scratch_path(spark, "page-plan")
    parts = materialise(loader.shares_of(loader.under(spark, folder), part_bytes), "page-parts")
    size, number = parts.agg(F.coalesce(F.sum(F.when(F.col("number") == 0, F.col("length"))), F.lit(0)), F.count("*")).first()
    count = partitions_of(size, number, part_bytes, slots)
    # shares of one file follow one another through the partitions
    slot = F.pmod(F.pmod(F.xxhash64("path"), F.lit(count)) + F.col("number"), F.lit(count)).alias("slot")
    parts.select("path", "number", "shares", slot).repartition(loader.tasks_of(spark), "slot").write.partitionBy("slot").parquet(plan)
    read = spark.read.format(NAME).option("path", folder).option("images", str(images).lower()).option("part_bytes", str(part_bytes)).option("slots", str(slots))
    return read.option("plan", plan).option("partitions", str(count)).load()
