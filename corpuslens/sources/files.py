"""Readers of annotated-corpus files, and of the dictionaries that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpuslens.functions.arabic import spaced_root
from corpuslens.operators.ordered import last_before
from corpuslens.sources.stored import materialise

#: Lines of a run whose heads are kept together, and the most runs that are sent to all tasks.
CHUNK, MOST_CHUNKS = 256, 200_000

PASSAGES = T.StructType([T.StructField("_index", T.LongType()), T.StructField("_name", T.StringType()), T.StructField("aya", T.ArrayType(T.StructType([T.StructField("_index", T.LongType()), T.StructField("_text", T.StringType())])))])


def read_xml(spark: SparkSession, path: str, row_tag: str = "sura") -> DataFrame:
    """Passages of an XML text whose groups and passages carry index, name and text as attributes."""
    groups = spark.read.format("xml").option("rowTag", row_tag).schema(PASSAGES).load(path)
    return groups.select(F.col("_index").alias("grp"), F.col("_name").alias("grp_name"), F.explode("aya").alias("a")).select(
        F.concat_ws(":", "grp", "a._index").alias("pid"), "grp", F.col("a._index").alias("ord"), "grp_name", F.col("a._text").alias("text"))


def read_json_text(spark: SparkSession, path: str) -> DataFrame:
    """Passages of a JSON array of groups with nested verses."""
    schema = "id long, name string, total_verses long, verses array<struct<id:long,text:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("id").alias("grp"), F.col("name").alias("grp_name"), F.explode("verses").alias("v")).select(
        F.concat_ws(":", "grp", "v.id").alias("pid"), "grp", F.col("v.id").alias("ord"), "grp_name", F.col("v.text").alias("text"))


def read_optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON file, or none if there is no such file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def check_counts(passages: DataFrame, groups: int, rows: int) -> DataFrame:
    """One row: the counts found and whether they are those expected."""
    return passages.agg(F.countDistinct("grp").alias("groups"), F.count("*").alias("passages")).withColumn("ok", (F.col("groups") == groups) & (F.col("passages") == rows))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Morphological segments of a tab-separated file with places like 1:2:3:1 (group, passage, word, segment); # begins a comment."""
    rows = spark.read.schema("loc string, form string, pos_class string, features string").option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    at = F.split(F.regexp_replace("loc", r"[()]", ""), ":")
    return rows.where(F.col("loc").rlike(r"^\(?\d+:\d+:\d+:\d+\)?$")).select(
        F.concat_ws(":", at[0], at[1]).alias("pid"), at[2].cast("int").alias("word"), at[3].cast("int").alias("seg"), "form", "pos_class", "features")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0) and value of the lines of each text file below path.

    A file is read in as many splits as it has, whose lines stay together in order; they are numbered by what the splits
    before have, of which only a row each is dealt out.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("value"))
    stored = materialise(rows, "lines")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = stored.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first")).select("file", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("add"))
    return stored.join(F.broadcast(splits), ["file", "split"]).select("file", (F.col("at") + F.col("add")).alias("line"), "value")


def open_entries(lines: DataFrame, head: Column) -> DataFrame:
    """lines with entry: the number of the line that begins the entry a line belongs to, one for which ``head`` holds; null before the first.

    The heads of each run of CHUNK lines, and the one that is open before it, are found first and carried from run to run;
    lines meet those of their run, so neither a file nor an entry is gathered.
    """
    chunk = F.floor(F.col("line") / CHUNK)
    heads = lines.groupBy("file", chunk.alias("__chunk")).agg(F.array_sort(F.collect_list(F.when(head, F.col("line")))).alias("__heads"))
    heads = last_before(heads.withColumn("__last", F.array_max("__heads")), [F.col("__chunk")], "__last", "__open", within="file")
    heads = materialise(heads.select(F.col("file").alias("__file"), F.col("__chunk").alias("__of"), "__heads", "__open"), "heads", True)
    if heads.count() <= MOST_CHUNKS:
        heads = F.broadcast(heads)
    placed = lines.join(heads, (F.col("file") == F.col("__file")) & (chunk == F.col("__of")))
    own = F.array_max(F.filter("__heads", lambda h: h <= F.col("line")))
    return placed.select(*lines.columns, F.coalesce(own, "__open").alias("entry"))


def page_marker(line: Column) -> Column:
    """vol and page of a page milestone; null on other lines."""
    vol, page = (F.regexp_extract(line, r"PageV(\d+)P(\d+)", i) for i in (1, 2))
    return F.when(vol != "", F.struct(vol.cast("int").alias("vol"), page.cast("int").alias("page")))


#: How a dictionary's layout marks the line that begins an entry, and the root in it.
HEADS = {"bare": r"^#\s*([ء-ي]{2,6})\s*$", "colon": r"^#\s*([ء-ي]{2,6})\s*:", "section": r"^###\s*\|+\s*([ء-ي]{2,6})\s*$"}


#: What the file format marks in a text that isn't part of it: milestones, page ends, tags, counts in brackets, and single signs.
NOISE = {"milestone": r"\bms\d+\b", "page": r"PageV\d+P\d+", "tag": r"@[A-Z]+@", "count": r"\(\s*\d+\s*\)", "sign": r"[#~\[\]{}|^@%*=]"}


def dictionary_entries(lines: DataFrame, layout: str) -> DataFrame:
    """file, root, full text and first page of each entry of numbered lines.

    Layouts: ``bare`` (a line with the root alone), ``colon`` (root, colon, definition), ``section`` (a heading with the
    root) and ``spaced`` (the root's letters apart, in brackets). A root's first entry counts. An entry's page is the first
    milestone after its head, or else the last before it. A file's lines need not meet in one task, an entry's do.
    """
    head = spaced_root(F.col("value")) if layout == "spaced" else F.nullif(F.regexp_extract("value", HEADS[layout], 1), F.lit(""))
    marked = lines.where("value not rlike '^#META#'").select("file", "line", "value", head.alias("head"), page_marker(F.col("value")).alias("page"))
    placed = open_entries(marked, F.col("head").isNotNull()).where("entry is not null")
    # heads and milestones alone: the last page before each head
    marks = marked.where("head is not null or page is not null").select("file", "line", "head", "page")
    before = last_before(marks, [F.col("line")], "page", "last_page", within="file").where("head is not null").select("file", F.col("line").alias("entry"), F.coalesce("page", "last_page").alias("last_page"))
    body = F.when(F.col("head").isNotNull(), F.regexp_replace("value", HEADS.get(layout, "^$"), "")).otherwise(F.col("value"))
    entries = placed.groupBy("file", "entry").agg(
        F.max("head").alias("root"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", body.alias("body")))), lambda x: x["body"]), " ").alias("body"),
        F.min_by("page", F.when(F.col("page").isNotNull(), F.col("line"))).alias("page"))
    cited = entries.join(before, ["file", "entry"], "left").withColumn("cite", F.coalesce("page", "last_page"))
    clean = cited.select("file", "entry", "root", F.trim(F.regexp_replace(F.regexp_replace("body", "|".join(NOISE.values()), " "), r"\s+", " ")).alias("full"), "cite").where("length(full) >= 4")
    first = clean.groupBy("file", "root").agg(F.min_by(F.struct("full", "cite"), "entry").alias("x"))
    return first.select("file", "root", "x.full", "x.cite")


def dictionary_meta(lines: DataFrame) -> DataFrame:
    """file and the title, author, dates and publisher of its header lines; placeholders don't count, the first value does."""
    key, value = F.regexp_extract("value", r"^#META#\s+([0-9]+\.\w+)\s*::\s*(.*)$", 1), F.trim(F.regexp_extract("value", r"^#META#\s+([0-9]+\.\w+)\s*::\s*(.*)$", 2))
    rows = lines.select("file", "line", key.alias("key"), value.alias("v")).where("key != '' and v not in ('NODATA', 'NOTGIVEN', 'NOCODE', 'NULL', '')")
    pick = lambda end, ok=".": F.min_by("v", F.when(F.col("key").endswith(end) & F.col("v").rlike(ok), F.col("line")))
    return rows.groupBy("file").agg(pick("BookTITLE").alias("title"), F.coalesce(pick("AuthorAKA"), pick("AuthorNAME")).alias("author"), pick("AuthorDIED", r"\d").alias("died"), pick("EdEDITOR").alias("editor"), pick("EdPUBLISHER").alias("publisher"), pick("EdYEAR").alias("year"), pick("BookVOLS", r"^\d+$").cast("int").alias("vols"))


def concise_gloss(full: Column, least: int = 10, most: int = 240, words: int = 28) -> Column:
    """The text up to the first strong boundary between ``least`` and ``most`` characters, else the first weak one, else so many words."""
    upto = lambda marks: F.nullif(F.regexp_extract(full, f"^(.{{{least},{most}}}?)[{marks}]", 1), F.lit(""))
    return F.trim(F.coalesce(upto(".۔؛!"), upto("،;"), F.array_join(F.slice(F.split(full, r"\s+"), 1, words), " ")))


def capped(full: Column, most: int = 600) -> Column:
    """At most so many characters, up to the last full stop if that lies beyond half of them."""
    cut = F.substring(full, 1, most)
    upto = F.regexp_extract(cut, r"(?s)^.*\.", 0)
    return F.when(F.length(full) <= most, full).when(F.length(upto) > most / 2 + 1, upto).otherwise(F.trim(cut))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """Path, bytes and SHA-256 of each file below path."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
