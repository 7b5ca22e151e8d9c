"""Writers and row formats for results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpuslens.functions.typed import shard_of


def flat(df: DataFrame) -> DataFrame:
    """Arrays as words with spaces between, other nested values as JSON: what a CSV cell can hold."""
    def cell(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType)):
            return F.array_join(F.transform(F.col(f.name), lambda x: x.cast("string")), " ").alias(f.name)
        return (F.to_json(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f.name)).alias(f.name)

    return df.select(*map(cell, df.schema))


def union_of_keys(rows: DataFrame, column: str, order: list[Column]) -> list[str]:
    """The keys that any of a column of JSON objects has, as they first come in ``order``: a header, so their number is that of its cells."""
    keys = rows.select(F.struct(*order).alias("at"), F.posexplode(F.json_object_keys(column)).alias("i", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct("at", "i")).alias("first"))
    return [r.key for r in first.orderBy("first").select("key").collect()]


def spread(rows: DataFrame, column: str, order: list[Column]) -> DataFrame:
    """Rows with a cell for each key that any of their JSON objects has: arrays as words, other nested values as JSON, null where a row lacks the key."""
    keys = union_of_keys(rows, column, order)
    fields = F.try_variant_get(F.try_parse_json(column), "$", "map<string,variant>")

    def cell(key: str) -> Column:
        value = F.try_element_at(fields, F.lit(key))
        words = F.array_join(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))), " ")
        return F.coalesce(words, F.try_variant_get(value, "$", "string"), F.to_json(value)).alias(key)

    kept = [c for c in rows.columns if c != column]
    clash = set(kept) & set(keys)
    if clash:
        raise ValueError(f"keys that are columns too: {sorted(clash)}")
    return rows.select(*kept, *map(cell, keys))


def write_csv(df: DataFrame, path: str, spreadsheet: bool = False) -> None:
    """CSV with a header; for spreadsheets with a byte order mark and CRLF."""
    rows = flat(df)
    if spreadsheet and df.columns:
        rows = rows.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    rows.write.option("header", True).option("escape", '"').option("lineSep", "\r\n" if spreadsheet else "\n").csv(path)


def write_shards(df: DataFrame, path: str, column: str, shards: int = 64) -> None:
    """Rows in a folder for each shard, which the hash of a column's value names."""
    df.withColumn("shard", shard_of(F.col(column), shards)).repartition("shard").write.partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, column: str, value: str, shards: int = 64) -> DataFrame:
    """The rows of a value, from the only folder that may have them."""
    return look_up(spark, path, column, spark.createDataFrame([(value,)], f"`{column}` string"), shards)


def look_up(spark: SparkSession, path: str, column: str, values: DataFrame, shards: int = 64) -> DataFrame:
    """The rows of the values (a table with ``column``, repeats counting once), from the folders of their hashes alone.

    Few values are sent to the scan, which then prunes its folders; the folders of many are gathered first, a number each.
    """
    asked = values.select(F.col(column).cast("string").alias("__value"), shard_of(F.col(column).cast("string"), shards).alias("__shard")).where("__value is not null").distinct()
    wanted = [r[0] for r in asked.select("__shard").distinct().collect()]
    stored = spark.read.parquet(path).where(F.col("shard").isin(*wanted) if wanted else F.lit(False))
    return stored.join(asked, (F.col("shard") == F.col("__shard")) & (F.col(column).cast("string") == F.col("__value"))).drop("shard", "__shard", "__value")


def write_bundle(df: DataFrame, path: str, method: str, params: dict[str, str]) -> None:
    """A line of JSON for each row, each with the method and parameters that made it."""
    given = F.create_map(*[F.lit(x) for kv in params.items() for x in kv]) if params else F.create_map().cast("map<string,string>")
    df.select(F.lit("v1").alias("schema"), F.lit(method).alias("method"), given.alias("params"), F.struct(*df.columns).alias("data")).write.json(path)


def concordance(tokens: DataFrame, hit: Column, window: int = 5) -> DataFrame:
    """A row for each hit with the words around it: pid, pos, left, hit, right."""
    w = Window.partitionBy("pid").orderBy("pos")
    side = lambda a, b: F.array_join(F.collect_list("orig").over(w.rowsBetween(a, b)), " ")
    rows = tokens.select("pid", "grp", "ord", "pos", "orig", hit.alias("is_hit"), side(-window, -1).alias("left"), side(1, window).alias("right"))
    return rows.where("is_hit").select("pid", "grp", "ord", "pos", "left", F.col("orig").alias("hit"), "right")


def bibtex(title: Column, author: Column, year: Column, key: Column) -> Column:
    return F.format_string("@book{%s,\n  title = {%s},\n  author = {%s},\n  year = {%s}\n}", key, title, author, year)


def ris(title: Column, author: Column, year: Column) -> Column:
    return F.concat_ws("\n", F.lit("TY  - BOOK"), F.concat(F.lit("TI  - "), title), F.concat(F.lit("AU  - "), author), F.concat(F.lit("PY  - "), year), F.lit("ER  - "))


def _given(label: str, value: Column, form: str) -> Column:
    """A field of a citation, or null (which concat_ws leaves out) if its value is null or empty."""
    return F.when(F.length(value.cast("string")) > 0, F.format_string(form, F.lit(label), value.cast("string")))


def _place(c: dict[str, Column]) -> Column:
    return F.concat_ws(", ", F.concat(F.lit("s.v. "), c["root"]), F.concat(F.lit("vol. "), c["volume"].cast("string")), F.concat(F.lit("p. "), c["page"].cast("string")))


ENTRY = ("root", "lexicon", "title", "author", "died", "editor", "publisher", "year", "volume", "page")


def entry_bibtex(**given: Column) -> Column:
    """BibTeX of an entry of a printed dictionary; columns named as in ENTRY, those not given are left out."""
    c = {k: given.get(k, F.lit(None).cast("string")) for k in ENTRY}
    title = F.coalesce(F.nullif(c["title"], F.lit("")), c["lexicon"])
    author = F.when(c["died"].isNotNull(), F.concat(c["author"], F.lit(" (d. "), c["died"].cast("string"), F.lit(")"))).otherwise(c["author"])
    plain = lambda v: F.regexp_replace(v.cast("string"), "[{}]", "")
    values = {"author": author, "title": title, "editor": c["editor"], "publisher": c["publisher"], "year": c["year"], "volume": c["volume"], "pages": c["page"], "note": _place(c)}
    fields = F.concat_ws(",\n", *[_given(k, plain(v), "  %s = {%s}") for k, v in values.items()])
    name = F.substring(F.regexp_replace(F.lower(F.coalesce(c["lexicon"], F.lit("lexicon"))), "[^a-z0-9]+", ""), 1, 16)
    key = F.concat(F.coalesce(F.nullif(name, F.lit("")), F.lit("lex")), F.lit("_"), F.regexp_replace(F.coalesce(c["root"], F.lit("root")), r"[^A-Za-z\u0600-\u06FF]", ""), F.coalesce(F.regexp_replace(c["year"].cast("string"), "[^0-9]", ""), F.lit("")))
    return F.concat(F.lit("@book{"), key, F.lit(",\n"), fields, F.lit("\n}\n"))


def entry_ris(**given: Column) -> Column:
    """The same in RIS."""
    c = {k: given.get(k, F.lit(None).cast("string")) for k in ENTRY}
    title = F.coalesce(F.nullif(c["title"], F.lit("")), c["lexicon"])
    values = {"AU": c["author"], "TI": title, "A2": c["editor"], "PB": c["publisher"], "PY": F.regexp_replace(c["year"].cast("string"), "[^0-9]", ""), "VL": c["volume"], "SP": c["page"], "KW": c["root"], "N1": _place(c)}
    return F.concat(F.concat_ws("\r\n", F.lit("TY  - BOOK"), *[_given(k, v, "%s  - %s") for k, v in values.items()], F.lit("ER  - ")), F.lit("\r\n"))


def result_bibtex(author: str, key: Column, title: Column, note: Column, url: Column, year: Column) -> Column:
    """BibTeX of a result of an analysis by a corporate author; the address leads back to the query."""
    plain = lambda v: F.regexp_replace(v, "[{}]", "")
    fields = F.concat_ws(",\n", F.lit("  author = {{" + author + "}}"), _given("title", plain(title), "  %s = {%s}"), _given("note", plain(note), "  %s = {%s}"), _given("howpublished", url, "  %s = {\\url{%s}}"), _given("year", year, "  %s = {%s}"))
    return F.concat(F.lit("@misc{"), F.coalesce(key, F.lit("result")), F.lit(",\n"), fields, F.lit("\n}\n"))


def result_ris(author: str, title: Column, note: Column, url: Column, year: Column, keywords: Column) -> Column:
    """The same in RIS; keywords is an array."""
    words = F.array_join(F.transform(F.filter(keywords, lambda k: F.length(k) > 0), lambda k: F.concat(F.lit("KW  - "), k)), "\r\n")
    return F.concat(F.concat_ws("\r\n", F.lit("TY  - DATA"), F.lit("AU  - " + author), _given("TI", title, "%s  - %s"), _given("N1", note, "%s  - %s"), _given("UR", url, "%s  - %s"), _given("PY", year, "%s  - %s"), F.nullif(words, F.lit("")), F.lit("ER  - ")), F.lit("\r\n"))
