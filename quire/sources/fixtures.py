"""Layout relations derived from the plain tables, so that operators can be compared with SQL on the same rows.

Documents' lines become pages of five lines, their words positioned runs; embeddings become painted operations
and image objects; page urls become requested sources.
"""

from __future__ import annotations

import uuid

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import layout
from quire.session import bound_batches, open_fs, scratch_path

ROOT = "/srv/root"
#: Page specifications by id.
SPECS = ["5", "1-3", "1-3,5,7-9", "3,1,2,1,3", " 1 - 3 , 5 ", "2-", "1-3-5", "-5", "5-3", "0", "1,,2", "1,", "1 2", "1-50000", "0-5", "4,4-6,2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of a page in these relations, and of a block of pages.
PAGE_LINES = 5
_BLOCK_LINES = PAGE_LINES * layout.PAGE_BLOCK


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one exchange of the texts, in blocks of pages; what is exploded from them and grouped by doc_id, block and more stays in it
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    numbers = F.sequence(F.lit(0), F.expr(f"cast((size(lines) - 1) div {_BLOCK_LINES} as int)"))
    blocks = docs.select("doc_id", "lines", F.explode(numbers).alias("block"))
    cut = blocks.select("doc_id", "block", F.slice("lines", F.col("block") * _BLOCK_LINES + 1, _BLOCK_LINES).alias("lines")).repartition("doc_id", "block")
    return cut.select("doc_id", "block", F.posexplode("lines").alias("at", "line")).select("doc_id", "block", (F.col("block") * _BLOCK_LINES + F.col("at")).alias("pos"), "line")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, block, page, seq, str, y."""
    words = _lines(spark, sf_dir).select("doc_id", "block", "pos", F.posexplode(F.split("line", " ", -1)).alias("wpos", "word"))
    blank = (F.col("doc_id") % 13 == 0) & (F.col("pos") % 5 == 2)
    lost = (F.col("doc_id") % 11 == 0) & (F.col("wpos") == 3)
    shift = F.when(F.col("doc_id") % 7 == 0, 1000.0).otherwise(0.0)
    height = F.lit(700.0) - 20 * (F.col("pos") % 5) + (F.col("wpos") % 4) * 0.25 - 0.5 - shift
    return words.select(
        "doc_id",
        "block",
        F.expr("pos div 5 + 1").cast("int").alias("page"),
        (F.col("pos").cast("long") * 100000 + F.col("wpos")).alias("seq"),
        F.when(blank, F.lit("\t\u00a0")).otherwise(F.concat("word", F.lit(" "))).alias("str"),
        F.when(~lost, height).alias("y"),
    )


def _placed(doc_id: int, text: str) -> list[list[tuple[str, float, float]]]:
    """The runs of a document by page, as runs() has them; those without a height are left out."""
    lines = text.split("\n")
    pages: list[list[tuple[str, float, float]]] = [[] for _ in range((len(lines) - 1) // 5 + 1 + (doc_id % 3 == 0))]
    lost = 3 if doc_id % 11 == 0 else -1
    for pos, line in enumerate(lines):
        words, top = line.split(" "), 700.0 - 20 * (pos % 5) - 0.5 - (1000 if doc_id % 7 == 0 else 0)
        if doc_id % 13 == 0 and pos % 5 == 2:
            shown = ["\t\xa0"] * len(words)
        else:
            shown = [word + " " for word in words]
        heights = (top, top + 0.25, top + 0.5, top + 0.75)
        pages[pos // 5] += [(word, 10.0 * wpos, heights[wpos % 4]) for wpos, word in enumerate(shown) if wpos != lost]
    return pages


_folders: dict[tuple[str, str], str] = {}
#: Files of one folder, about; more documents are more folders, which tasks list each.
_FOLDER_FILES = 1000


def pdf_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder in the shared space with a PDF file <folder>/<doc_id>.pdf for each document, whose runs are those of runs(); written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _folders:
        folder = scratch_path(spark, "pdf")

        def write(frames):
            from quire.sources import pdf_writer

            fs, base = open_fs(folder)
            made, written, task = set(), 0, TaskContext.get().partitionId()
            for frame in frames:
                for doc_id, text, number in zip(frame["doc_id"], frame["text"], frame["folder"]):
                    if number < 0:
                        number, written = f"{task}-{written // _FOLDER_FILES}", written + 1
                    if number not in made:
                        fs.create_dir(f"{base}/{number}", recursive=True)
                        made.add(number)
                    target = f"{base}/{number}/{doc_id}.pdf"
                    part = f"{target}.{uuid.uuid4().hex}.part"  # renamed when whole, so that a repeated task does no harm
                    with fs.open_output_stream(part) as sink:
                        sink.write(pdf_writer.write(_placed(int(doc_id), text)))
                    fs.move(part, target)
                yield frame[["doc_id"]]

        bound_batches(spark)
        docs, tasks = table(spark, sf_dir, "documents"), int(spark.conf.get("spark.sql.shuffle.partitions"))
        docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
        rows = [n for _, n in docs.groupBy(F.spark_partition_id()).count().collect()]
        slots = spark.sparkContext.defaultParallelism
        if 2 * slots * max(rows, default=0) <= sum(rows):  # the scan's own tasks are as good: each writes to folders of its own
            docs = docs.withColumn("folder", F.lit(-1))
        else:
            folders = max(4 * tasks, -(-sum(rows) // _FOLDER_FILES))
            docs = docs.withColumn("folder", F.pmod(F.xxhash64("doc_id"), F.lit(folders))).repartition(tasks, "folder")
        docs.mapInPandas(write, "doc_id long").write.format("noop").mode("overwrite").save()
        _folders[key] = folder
    return _folders[key]


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, num_pages: the pages of the runs, and a blank last one for every third document."""
    lines = F.size(F.split("text", "\n", -1))
    pages = F.expr("(n - 1) div 5 + 1") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("n")).select("doc_id", pages.cast("long").alias("num_pages"))


def _listed_spec(number: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in SPECS]), (number % len(SPECS)).cast("int"))


def page_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spec_id, spec: a listed specification and a range made of the document's length, which may begin at 0."""
    first = F.col("n_chars") % 9
    own = F.concat(F.lit(","), first.cast("string"), F.lit("-"), (first + F.col("doc_id") % 4).cast("string"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("spec_id"), F.concat(_listed_spec(F.col("doc_id")), own).alias("spec"))


def charset_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spec_id, spec: figures of an url, its beginning, a listed specification, or nothing."""
    i = F.col("page_id")
    figures = F.concat(F.regexp_replace("url", "[^0-9-]", ""), F.lit(", 1"))
    spec = F.when(i % 13 == 0, F.lit("")).when(i % 3 == 0, figures).when(i % 3 == 1, F.substring("url", 1, 12)).otherwise(_listed_spec(i))
    return table(spark, sf_dir, "pages").select(i.alias("spec_id"), spec.alias("spec"))


def page_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spec_id, pages: numbers made of the first five components, some not whole, some below 1, some arrays empty."""
    v, first = F.col("vec_id"), F.slice("embedding", 1, 5)
    whole = F.transform(first, lambda e: F.floor(F.abs(e.cast("double")) * 40).cast("double") + 1)
    signed = F.transform(first, lambda e: F.floor(e.cast("double") * 20).cast("double") + 4)
    halves = F.transform(first, lambda e: F.floor(F.abs(e.cast("double")) * 20) / 2 + 1)
    pages = F.when(v % 11 == 0, F.array().cast("array<double>")).when(v % 3 == 0, whole).when(v % 3 == 1, signed).otherwise(halves)
    return table(spark, sf_dir, "embeddings").select(v.alias("spec_id"), pages.alias("pages"))


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_idx, doc_id, spec: the turns of three conversations ask one document each, every seventh for all of it."""
    conv, turn = F.col("conv_id"), F.col("turn")
    spec = F.when(turn % 7 != 3, _listed_spec(conv + 5 * turn))
    return table(spark, sf_dir, "conversations").select((conv * 1000 + turn).alias("src_idx"), F.expr("conv_id div 3").alias("doc_id"), spec.alias("spec"))


def spec_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, num_pages, spec: document d asks for specification d modulo 16."""
    listed = F.array(*[F.lit(s) for s in SPECS])
    return doc_pages(spark, sf_dir).withColumn("spec", F.get(listed, (F.col("doc_id") % 16).cast("int")))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.when(F.col("vec_id") % 6 == 0, F.lit("g_")).otherwise(F.lit("img_"))
    return table(spark, sf_dir, "embeddings").withColumn("name", F.concat(prefix, F.col("vec_id").cast("string")))


def paint_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, op_pos, fn, obj_name, y."""
    v = F.col("vec_id")
    return _named(spark, sf_dir).select(
        (v % 200).alias("doc_id"),
        F.lit(1).alias("page"),
        F.expr("vec_id div 200").alias("op_pos"),
        F.when(v % 5 == 4, 31).when(v % 5 == 3, 92).otherwise(89).alias("fn"),
        F.when(v % 17 != 0, F.col("name")).alias("obj_name"),
        F.when(v % 4 != 0, (700 - 20 * (v % 5)).cast("double")).alias("y"),
    )


def image_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, doc_id, page, name, width, height, kind, data (array<int>)."""
    v = F.col("vec_id")
    common = F.col("name").startswith("g_") & (v % 12 == 0)
    data = F.transform("embedding", lambda e: F.floor(F.abs(e.cast("double")) * 255).cast("int"))
    return _named(spark, sf_dir).where(v % 29 != 0).select(
        F.when(common, F.lit("common")).otherwise(F.lit("page")).alias("scope"),
        (v % 200).alias("doc_id"),
        F.lit(1).alias("page"),
        "name",
        F.when(v % 19 != 0, 8).alias("width"),
        F.lit(8).alias("height"),
        F.when(v % 4 != 0, (v % 4).cast("int")).alias("kind"),
        F.when(v % 23 != 0, data).alias("data"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_idx, path, url, pages_spec."""
    i = F.col("page_id")
    odd = F.array(*[F.lit(p) for p in ("../x.pdf", "/abs/x.pdf", "a/../b/./c.pdf", "", "../root-sibling/x.pdf")])
    own = F.concat(F.lit("docs/"), i.cast("string"), F.lit(".pdf"))
    path = F.when((i % 5).isin(1, 2), own).when(i % 5 == 4, F.get(odd, F.expr("page_id div 5 % 5").cast("int")))
    specs = F.array(*[F.lit(s) for s in SPECS])
    return table(spark, sf_dir, "pages").select(i.alias("src_idx"), path.alias("path"), F.when((i % 5).isin(0, 2), F.col("url")).alias("url"), F.get(specs, (i % 16).cast("int")).alias("pages_spec"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path: the confined paths of sources, some missing."""
    from quire.operators.paths import path_status

    found = sources(spark, sf_dir).select("src_idx", path_status(F.col("path"), ROOT).alias("p"))
    return found.where("src_idx % 4 <> 1 and p.resolved is not null").select(F.col("p.resolved").alias("path")).distinct()


def doc_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, metadata map<string,string>; none for every seventeenth document."""
    pairs = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("n_chars"), F.col("n_chars").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 17 != 0, pairs).alias("metadata"))


def doc_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, info (variant): texts, whole numbers, flags and lists; none for every seventeenth document."""
    told = F.struct("lang", "n_chars", (F.col("n_chars") > 1000).alias("is_long"), F.array("source", "lang").alias("tags"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 17 != 0, F.parse_json(F.to_json(told))).alias("info"))


def logos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, index, width, height, kind, data (array<int>): three of four images are one of a few that their label names."""
    v = F.col("vec_id")
    shared = F.transform(F.sequence(F.lit(1), F.lit(256)), lambda i: (F.col("label") * 37 + i * 7) % 256)
    own = F.transform("embedding", lambda e: F.floor(F.abs(e.cast("double")) * 255).cast("int"))
    return table(spark, sf_dir, "embeddings").select((v % 200).alias("doc_id"), F.lit(1).alias("page"), F.expr("cast(vec_id div 200 as int)").alias("index"), F.lit(8).alias("width"), F.lit(8).alias("height"), (1 + F.col("label") % 3).cast("int").alias("kind"), F.when(v % 4 != 0, shared).otherwise(own).alias("data"))


def page_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, message."""
    return doc_pages(spark, sf_dir).where("doc_id % 31 = 5 and num_pages >= 2").select("doc_id", F.lit(2).alias("page"), F.lit("Failed to get page 2").alias("message"))
