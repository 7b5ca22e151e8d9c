"""The graph of words and passages around a centre."""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions.association import rarity_weight
from corpuslens.sources.stored import materialise

from .tokens import mode_key, postings, without_stops


def expand(tokens: DataFrame, centre: str, words: list[str], *, branch: int = 10, rare_most: int | None = None, stops: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, parent, level, df) and links (source, target, kind, weight) of a passage, its words, and for each expanded word the passages that share most words with the centre.

    The first expanded word that reaches a passage is its parent; another makes a loop link. Beyond ``branch`` passages a
    word has an overflow node with the number left out. Passages are ranked by a count before anything is gathered.
    """
    keys = postings(without_stops(tokens, stops))
    df = keys.groupBy("key").agg(F.count("*").alias("df"))
    own = keys.where(F.col("pid") == centre).select("key").join(df, "key")
    if rare_most is not None:
        own = own.where(F.col("df") <= rare_most)
    spark = tokens.sparkSession
    expanded = spark.createDataFrame(list(enumerate(words)), "i int, key string").join(own, "key")
    shared = keys.join(own.select("key"), "key", "left_semi").where(F.col("pid") != centre).groupBy("pid").agg(F.count("*").alias("shared"))
    reached = keys.join(expanded.select("key", "i"), "key").where(F.col("pid") != centre).join(shared, "pid")
    ranked = reached.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("shared"), "grp", "ord")))
    kept = ranked.where(F.col("rank") <= branch).withColumn("first", F.row_number().over(Window.partitionBy("pid").orderBy("i")))
    more = ranked.groupBy("key", "i").agg(F.count("*").alias("n")).where(F.col("n") > branch)
    node = lambda df_, id_, kind, parent, level, n: df_.select(id_.alias("id"), F.lit(kind).alias("kind"), parent.alias("parent"), F.lit(level).alias("level"), n.cast("long").alias("df"))
    none = F.lit(None).cast("string")
    nodes = (
        node(spark.range(1), F.lit(centre), "passage", none, 0, F.lit(None))
        .unionByName(node(own, F.col("key"), "word", F.lit(centre), 1, F.col("df")))
        .unionByName(node(kept.where("first = 1"), F.col("pid"), "passage", F.col("key"), 2, F.col("shared")))
        .unionByName(node(more, F.concat(F.lit("more:"), F.col("key")), "more", F.col("key"), 2, F.col("n") - branch))
    )
    link = lambda df_, a, b, kind, weight: df_.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("kind"), weight.alias("weight"))
    kept_df = kept.join(df, "key")
    links = (
        link(own, F.lit(centre), F.col("key"), "tree", rarity_weight("df"))
        .unionByName(link(kept_df.where("first = 1"), F.col("key"), F.col("pid"), "tree", rarity_weight("df")))
        .unionByName(link(kept_df.where("first > 1"), F.col("key"), F.col("pid"), "loop", rarity_weight("df")))
    )
    return nodes, links


class Graph(NamedTuple):
    """nodes (id, kind, parent, level, n), links (source, target, kind, weight), and whether the budget ended it early.

    Kinds of nodes are passage (n: distinct words shared with the centre), word (n: passages that have it) and more (n:
    passages left out behind a word); kinds of links are tree and loop.
    """

    nodes: DataFrame
    links: DataFrame
    truncated: bool


def _first(df: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The first rows by path, and how many there are: at most ``most``, the graph's budget."""
    n = df.count()
    return (df, n) if n <= most else (df.orderBy("path").limit(most), most)


def grow(tokens: DataFrame, centre: str, levels: int, *, mode: str = "exact", branch: int = 10, rare_most: int | None = None, stops: tuple[str, ...] = (), words: DataFrame | None = None, passages: DataFrame | None = None, budget: int = 5000) -> Graph:
    """The graph around a passage, level by level: its words, the passages that have these, their words, and so on.

    Each level is a table made from the one before and from what was visited. A word belongs to a passage (its node is
    ``key@passage``) and leads to the ``branch`` other passages that share most words with the centre (ties in reading
    order); how many more there are has a node of its own. A passage belongs to the word that reached it first, in the
    order of the levels before; other words, and words that lead back to a passage, get loop links. ``words`` (key, pid)
    and ``passages`` (pid) say what is expanded, by default everything above the last level. After ``budget`` expanded nodes
    the rest is left out and the graph is truncated. Of each word only the best passages are kept, once for all nodes of it.
    """
    spark = tokens.sparkSession
    key = mode_key(mode)
    own = materialise(without_stops(tokens, stops, mode).groupBy("pid", key.alias("key")).agg(F.min("pos").alias("idx")), "graph-words")
    posts = postings(tokens, mode)
    about = tokens.where(F.col("pid") == centre).select(key.alias("key")).distinct()
    shared = tokens.withColumn("key", key).join(about, "key", "left_semi").groupBy("pid").agg(F.countDistinct("orig").alias("shared"))
    df = posts.groupBy("key").agg(F.count("*").alias("df"))
    # the best passages of each word, one more than a node keeps, since its own passage may be among them
    scored = posts.join(shared, "pid", "left").select("key", "pid", F.coalesce("shared", F.lit(0)).alias("shared"), "grp", "ord")
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("shared"), "grp", "ord", "pid"))).where(F.col("rank") <= branch + 1)
    best = materialise(best.join(df, "key").select("key", "pid", "shared", "rank", "df"), "graph-best")
    counted = materialise(df, "graph-df")

    frontier = spark.createDataFrame([(centre, 0)], "pid string, at int").select("pid", F.array("at").alias("path"))
    visited = frontier.select("pid")
    none = F.lit(None).cast("string")
    nodes = [frontier.select(F.col("pid").alias("id"), F.lit("passage").alias("kind"), none.alias("parent"), F.lit(0).alias("level"), none.cast("long").alias("n"))]
    links, left, truncated = [], budget, False
    for level in range(1, levels + 1):
        if level % 2:  # words of passages
            open_ = frontier if passages is None or level == 1 else frontier.join(passages.select("pid").distinct(), "pid", "left_semi")
            open_, n = _first(open_, left)
            found = open_.join(own, "pid").join(counted, "key")
            if rare_most is not None:
                found = found.where(F.col("df") <= rare_most)
            found = found.select("key", "pid", F.concat("path", F.array("idx")).alias("path"), "df", F.concat_ws("@", "key", "pid").alias("id"))
            frontier = materialise(found, "graph-level")
            nodes.append(frontier.select("id", F.lit("word").alias("kind"), F.col("pid").alias("parent"), F.lit(level).alias("level"), F.col("df").alias("n")))
            links.append(frontier.select(F.col("pid").alias("source"), F.col("id").alias("target"), F.lit("tree").alias("kind"), rarity_weight("df").alias("weight")))
        else:  # passages of words
            open_ = frontier if words is None else frontier.join(words.select("key", "pid").distinct(), ["key", "pid"], "left_semi")
            open_, n = _first(open_, left)
            to = best.select("key", F.col("pid").alias("to"), "shared", "rank")
            # a word's own passage takes no place
            reached = open_.join(to, "key").withColumn("own", F.max(F.when(F.col("to") == F.col("pid"), F.col("rank"))).over(Window.partitionBy("id")))
            reached = reached.where(F.col("to") != F.col("pid")).withColumn("rank", F.col("rank") - F.when(F.col("rank") > F.col("own"), 1).otherwise(0)).where(F.col("rank") <= branch)
            reached = reached.join(visited.select(F.col("pid").alias("to"), F.lit(True).alias("seen")), "to", "left")
            nth = F.row_number().over(Window.partitionBy("to").orderBy("path"))  # as many rows as words of this level that lead to a passage
            reached = materialise(reached.withColumn("first", F.col("seen").isNull() & (nth == 1)).select("id", "to", "df", "shared", "first", F.concat("path", F.array("rank")).alias("path")), "graph-level")
            frontier = reached.where("first").select(F.col("to").alias("pid"), "path")
            visited = visited.unionByName(frontier.select("pid"))
            nodes.append(reached.where("first").select(F.col("to").alias("id"), F.lit("passage").alias("kind"), F.col("id").alias("parent"), F.lit(level).alias("level"), F.col("shared").alias("n")))
            links.append(reached.select(F.col("id").alias("source"), F.col("to").alias("target"), F.when(F.col("first"), "tree").otherwise("loop").alias("kind"), rarity_weight("df").alias("weight")))
            more = open_.where(F.col("df") - 1 > branch) if rare_most is None else open_.limit(0)
            nodes.append(more.select(F.concat(F.lit("more:"), "id").alias("id"), F.lit("more").alias("kind"), F.col("id").alias("parent"), F.lit(level).alias("level"), (F.col("df") - 1 - branch).alias("n")))
            links.append(more.select(F.col("id").alias("source"), F.concat(F.lit("more:"), "id").alias("target"), F.lit("tree").alias("kind"), rarity_weight("df").alias("weight")))
        left -= n
        truncated = left <= 0
        if truncated or not n:
            break
    return Graph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, links) if links else spark.createDataFrame([], "source string, target string, kind string, weight double"), truncated)


def descendants(links: DataFrame, root: str, most_levels: int = 200) -> DataFrame:
    """id and depth of everything below a node of a tree (source, target), by a recursive query."""
    name = f"links_{uuid.uuid4().hex}"
    links.select("source", "target").createOrReplaceTempView(name)
    found = links.sparkSession.sql(
        f"with recursive below(id, depth) as (select target, 1 from {name} where source = :root union all select l.target, b.depth + 1 from below b join {name} l on l.source = b.id where b.depth < {int(most_levels)}) select id, min(depth) as depth from below group by id",
        args={"root": root})
    links.sparkSession.catalog.dropTempView(name)
    return found


def path_to(links: DataFrame, node: str, most_levels: int = 200) -> DataFrame:
    """id and step of the nodes from a node up to the root of its tree."""
    name = f"links_{uuid.uuid4().hex}"
    links.select("source", "target").createOrReplaceTempView(name)
    found = links.sparkSession.sql(
        f"with recursive up(id, step) as (select :node, 0 union all select l.source, u.step + 1 from up u join {name} l on l.target = u.id where u.step < {int(most_levels)}) select id, min(step) as step from up group by id",
        args={"node": node})
    links.sparkSession.catalog.dropTempView(name)
    return found
