"""Files of document folders: graphs by part, papers, previews, signatures, and documents written back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespan.sources import rdf

#: Parts of a document's folder, by what its files' paths look like below it.
DOCUMENT_PARTS = (("top", r"/output_top[^/]*\.ttl$"), ("main", r"/output_[^/]*\.ttl$"), ("species", r"/ontospecies_output/[^/]*\.ttl$"), ("integrated", r"/cbu_derivation/integrated/[^/]*\.ttl$"))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, modified) of all files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def document_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed rows with their part: of each document folder <folder>/<doc>/ the output files but the top-level one, the species
    files and the integrated ones. doc is the folder's name."""
    read = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.ttl").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    part = F.coalesce(*(F.when(F.col("path").rlike(p), F.lit(name)) for name, p in DOCUMENT_PARTS))
    files = read.select(F.regexp_extract("path", rf"/{root}/([^/]+)/", 1).alias("folder"), part.alias("part"), "path", "text").where("part <> 'top' and folder <> ''")
    # blank nodes are named by file, so that those of two files never meet
    parsed = rdf.parsed(files.select(F.concat_ws("|", "folder", "part", "path").alias("doc"), "text"))
    ids = F.split("doc", r"\|")
    return parsed.withColumn("part", ids[1]).withColumn("doc", ids[0])


def repaired(text: str) -> str:
    """Turtle with the usual slips mended: quotes inside of literals on one line, a last statement without its dot."""
    lines = []
    for line in text.splitlines():
        m = re.match(r'^(\s*\S*\s*\S+\s+")(.*)("\s*(?:@[A-Za-z-]+|\^\^\S+)?\s*[.;,]\s*)$', line)
        if m and re.search(r'(?<!\\)"', m[2]) and not re.search(r'"\s*[;,]\s*\S', m[2]):
            line = m[1] + re.sub(r'(?<!\\)"', r"\\" + '"', m[2]) + m[3]
        lines.append(line)
    mended = "\n".join(lines).rstrip()
    return mended if not mended or mended.endswith(".") else mended.rstrip(";,") + " ."


def lenient(files: DataFrame) -> DataFrame:
    """Rows of `rdf.parsed` from (doc, text); a text with errors is tried once more as `repaired`."""
    return rdf.parsed(files, repaired)


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """(doi, hash) of the papers <doi>.pdf but supplements *_si.pdf, in order without regard to case."""
    doi = F.regexp_extract("name", r"(?i)^(.*)\.pdf$", 1)
    names = listing(spark, folder).where(F.col("name").rlike(r"(?i)\.pdf$") & ~F.col("name").rlike(r"(?i)_si\.pdf$"))
    return names.select(doi.alias("doi")).distinct().withColumn("hash", F.substring(F.sha2("doi", 256), 1, 8)).orderBy(F.lower("doi"), "doi")


def previews(spark: SparkSession, folder: str, pattern: str = "*", n_bytes: int = 256, n_chars: int = 500) -> DataFrame:
    """(path, length, head, text): the first bytes of each file in hexadecimal, and its first characters where they are UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    text = F.expr(f"try_validate_utf8(cast(substring(content, 1, {4 * n_chars}) as string))")
    return files.select("path", "length", F.hex(F.substring("content", 1, n_bytes)).alias("head"), F.substring(text, 1, n_chars).alias("text"))


def signature(spark: SparkSession, folder: str, pattern: str = "*") -> str:
    """SHA-256 over the names and contents of the files below a folder, in order of their paths: equal for equal folders. One
    short row a file reaches the driver's digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    below = F.substring_index("path", folder.rstrip("/") + "/", -1)
    each = files.select(F.struct(below.alias("name"), F.sha2("content", 256).alias("sha")).alias("f"))
    return each.agg(F.sha2(F.to_json(F.sort_array(F.collect_list("f"))), 256)).first()[0]


def resources(spark: SparkSession, folder: str, skip: str = r"/(\.[^/]+|__pycache__|node_modules)/") -> DataFrame:
    """(task, path, name): files below <folder>/<task>/ whose path does not match `skip`."""
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    found = listing(spark, folder).where(~F.col("path").rlike(skip))
    return found.select(F.regexp_extract("path", rf"/{root}/([^/]+)/", 1).alias("task"), "path", "name")


def chosen_variants(names: DataFrame, files: DataFrame, prefix: str = "", suffix: str = ".ttl") -> DataFrame:
    """(name, path): for each name the file called like it, else like its lower case, else with hyphens for underscores."""
    tried = F.array(F.col("name"), F.lower("name"), F.translate("name", "_", "-"), F.translate(F.lower("name"), "_", "-"))
    variants = names.select("name").distinct().select("name", F.posexplode(tried).alias("rank", "variant"))
    wanted = variants.select("name", "rank", F.concat(F.lit(prefix), "variant", F.lit(suffix)).alias("file"))
    return wanted.join(files.select(F.col("name").alias("file"), "path"), "file").groupBy("name").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def write_documents(documents: DataFrame, folder: str, by: str = "doc") -> None:
    """Records as lines of JSON, in one folder a value of `by`."""
    documents.repartition(by).write.mode("overwrite").partitionBy(by).json(folder)


def missing_deposits(records: DataFrame, doc: str = "doc", ccdc: str = "ccdc") -> DataFrame:
    """(doc, n, n_missing) of documents with a record whose deposit number is missing; `write.csv` makes the report."""
    gone = F.lower(F.trim(F.coalesce(F.col(ccdc), F.lit("")))).isin("", "n/a", "na")
    counted = records.groupBy(doc).agg(F.count("*").alias("n"), F.sum(gone.cast("int")).alias("n_missing"))
    return counted.where("n_missing > 0")
