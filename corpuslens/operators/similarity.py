"""Similar passages, cohesion, distributional neighbours, shared phrases and sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpuslens.sources.stored import materialise

from .ordered import numbered
from .tokens import postings

#: Pairs whose ids are sent to all tasks at most.
MOST_SENT = 1_000_000
#: Keys (and contexts) that a side of a tile of vectors has at most: a task holds three such squares of doubles.
TILE = 1024


def roots_of(tokens: DataFrame) -> DataFrame:
    return postings(tokens.where("root is not null").withColumn("key", F.col("root")))


def weighted(tokens: DataFrame) -> DataFrame:
    """(key, pid, grp, ord, w): distinct roots of each passage with idf = ln(passages / passages with it)."""
    rows = roots_of(tokens)
    n = tokens.select("pid").distinct().agg(F.count("*").alias("n"))
    idf = rows.groupBy("key").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("key", F.log(F.col("n") / F.col("df")).alias("w"))
    return rows.join(idf, "key")


def similar(tokens: DataFrame, pid: str, top: int = 10) -> DataFrame:
    """The passages with the greatest idf-weighted cosine of shared roots; a passage without weight has magnitude 1."""
    w = weighted(tokens)
    centre = w.where(F.col("pid") == pid).select("key", F.col("w").alias("cw"))
    size = lambda c: F.coalesce(F.nullif(F.sqrt(F.sum(F.col(c) * F.col(c))), F.lit(0.0)), F.lit(1.0))
    shared = w.join(centre, "key").where(F.col("pid") != pid).groupBy("pid", "grp", "ord").agg(F.sum(F.col("w") * F.col("cw")).alias("dot"), F.count("*").alias("shared"))
    magnitude = w.groupBy("pid").agg(size("w").alias("mag"))
    own = centre.agg(size("cw").alias("own"))
    scored = shared.join(magnitude, "pid").join(F.broadcast(own)).select("pid", "grp", "ord", "shared", (F.col("dot") / (F.col("mag") * F.col("own"))).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), "grp", "ord").limit(top).select("pid", "shared", "score")


def _pairs(tokens: DataFrame, condition: Column) -> DataFrame:
    """Pairs of passages of a group (a before b) with the idf-weighted cosine of their roots; a join by group and root."""
    w = weighted(tokens)
    mag = w.groupBy("pid").agg(F.sum(F.col("w") * F.col("w")).alias("m"))
    x = w.select("grp", "key", F.col("pid").alias("pid_a"), F.col("ord").alias("a"), "w")
    y = w.select("grp", "key", F.col("pid").alias("pid_b"), F.col("ord").alias("b"))
    dot = x.join(y, ["grp", "key"]).where((F.col("a") < F.col("b")) & condition).groupBy("grp", "pid_a", "pid_b", "a", "b").agg(F.sum(F.col("w") * F.col("w")).alias("dot"), F.count("*").alias("shared"))
    scored = dot.join(mag.select(F.col("pid").alias("pid_a"), F.col("m").alias("ma")), "pid_a").join(mag.select(F.col("pid").alias("pid_b"), F.col("m").alias("mb")), "pid_b")
    return scored.select("grp", "a", "b", "shared", F.coalesce(F.col("dot") / F.nullif(F.sqrt(F.col("ma") * F.col("mb")), F.lit(0.0)), F.lit(0.0)).alias("score"))


def cohesion(tokens: DataFrame) -> DataFrame:
    """The cosine of each passage of dense order and the next of its group, 0 where they share no root."""
    next_ = tokens.select("grp", F.col("ord").alias("a")).distinct()
    follows = next_.join(next_.select("grp", (F.col("a") - 1).alias("a"), F.lit(1).alias("_")), ["grp", "a"], "left_semi")
    near = _pairs(tokens, F.col("b") == F.col("a") + 1)
    return follows.join(near.drop("b"), ["grp", "a"], "left").select("grp", "a", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("score", F.lit(0.0)).alias("score"))


def echoes(tokens: DataFrame, distance: int = 2, top: int = 40) -> DataFrame:
    """The most similar pairs of each group's passages that are at least ``distance`` apart."""
    far = _pairs(tokens, F.col("b") - F.col("a") >= distance).where("score > 0")
    return far.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(F.round("score", 9)), "a", "b"))).where(F.col("rank") <= top)


def shared_roots(tokens: DataFrame, one: str, two: str) -> DataFrame:
    r = roots_of(tokens)
    return r.where(F.col("pid") == one).select("key").intersect(r.where(F.col("pid") == two).select("key"))


def ppmi(tokens: DataFrame, least: int = 3, most_share: float = 0.25, only: list[str] | None = None) -> DataFrame:
    """(key, other, w, k, df, other_df): positive PMI of keys that share passages, both with a df in the band.

    ``only`` leaves out the vectors of all other keys before anything is joined; contexts and frequencies stay whole. The band bounds what a passage contributes: the square of its distinct roots of middle frequency.
    Keys are numbered, and of two keys a passage has, only the lesser is counted with the greater: the rest is the mirror image.
    """
    rows = materialise(roots_of(tokens).select("key", "pid"), "roots")
    n = tokens.select("pid").distinct().agg(F.count("*").alias("n"))
    df = rows.groupBy("key").agg(F.count("*").alias("df")).join(F.broadcast(n)).where((F.col("df") >= least) & (F.col("df") <= most_share * F.col("n")))
    codes = numbered(df.select("key", "df"), [F.col("key")], "id")
    kept = materialise(rows.join(codes, "key").select("pid", F.col("id").alias("a"), "key"), "kept")
    used = kept.select("pid").distinct().agg(F.count("*").alias("n"))
    wanted = kept if only is None else kept.where(F.col("key").isin(only))
    met = wanted.select("pid", "a").join(kept.select(F.col("a").alias("b"), "pid"), "pid").where("a < b" if only is None else "a != b")
    joint = met.groupBy("a", "b").agg(F.count("*").alias("k"))
    if only is None:
        joint = joint.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "k").select("p.a", "p.b", "k")
    scored = joint.join(codes.select(F.col("id").alias("a"), "key", "df"), "a").join(codes.select(F.col("id").alias("b"), F.col("key").alias("other"), F.col("df").alias("other_df")), "b").join(F.broadcast(used))
    return scored.withColumn("w", F.log2(F.col("k") * F.col("n") / (F.col("df") * F.col("other_df")))).where("w > 0").select("key", "other", "w", "k", "df", "other_df")


def _packed(table: pa.Table) -> pa.Table:
    """A tile of vectors in one row: places in it and weights, in order of contexts."""
    table = table.sort_by("c")
    pack = lambda name, kind: pa.array([table[name].to_numpy().astype(kind).tobytes()])
    return pa.table({"i": table["i"][:1], "m": table["m"][:1], "r": pack("a", np.int32), "c": pack("c", np.int32), "w": pack("w", np.float64)})


def _add_product(x: tuple, y: tuple, to: np.ndarray) -> None:
    """Adds the product of two packed tiles of the same contexts to a square: entry by entry if few meet, else as matrices."""
    side = len(to)
    (xr, xc, xw), (yr, yc, yw) = x, y
    first = np.searchsorted(yc, np.arange(side + 1))
    n = np.diff(first)[xc]
    if n.sum() * 200 < side**3:
        at = np.repeat(first[xc] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        np.add.at(to, (np.repeat(xr, n), yr[at]), np.repeat(xw, n) * yw[at])
        return
    dense = []
    for r, c, w in (x, y):
        dense.append(np.zeros((side, side)))
        dense[-1][r, c] = w
    to += dense[0] @ dense[1].T


def _contenders(sims: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Where a row of similarities has its k greatest, and all that round to the same as the last of them, of those that are ``least`` at least."""
    floor = np.full(len(sims), least)
    if sims.shape[1] > k:
        floor = np.maximum(floor, np.partition(sims, -k, axis=1)[:, -k] - 1e-8)
    return np.nonzero(sims >= floor[:, None])


def _tile_products(unit: DataFrame, side: int, blocks: int, k: int, least: float) -> DataFrame:
    """(a, b, sim) of numbered unit vectors (a, c, w): for each a, its contenders in each range of ``side`` numbers.

    Each tile of the product meets the two rows of tiles that it is made of, tile by tile in order of their contexts.
    """
    own = unit.select(F.floor(F.col("a") / side).cast("int").alias("i"), F.floor(F.col("c") / side).cast("int").alias("m"), F.pmod("a", F.lit(side)).cast("int").alias("a"), F.pmod("c", F.lit(side)).cast("int").alias("c"), "w")
    packed = own.groupBy("i", "m").applyInArrow(_packed, "i int, m int, r binary, c binary, w binary")
    dealt = packed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("i", "o").alias("lo"), F.greatest("i", "o").alias("hi"), "m", "i", "r", "c", "w")
    tiles = blocks * (blocks + 1) // 2
    parts = min(tiles, 4 * int(unit.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number = (F.col("hi") * (F.col("hi") + 1) / 2 + F.col("lo")).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, left, sims = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if tile is None:
                return
            lo, hi = tile
            if lo == hi:
                np.fill_diagonal(sims, -1)
            for at, to, s in ((lo, hi, sims), (hi, lo, sims.T))[: 1 + (lo != hi)]:
                row, column = _contenders(s, k, least)
                yield pa.RecordBatch.from_arrays([pa.array(at * side + row), pa.array(to * side + column), pa.array(s[row, column])], names=["a", "b", "sim"])

        for batch in batches:
            for n in range(batch.num_rows):
                lo, hi, m, i, *entries = (batch.column(c)[n] for c in range(batch.num_columns))
                lo, hi, m, i = lo.as_py(), hi.as_py(), m.as_py(), i.as_py()
                if (lo, hi) != tile:
                    yield from done()
                    tile, left, sims = (lo, hi), None, np.zeros((side, side))
                entries = tuple(np.frombuffer(e.as_buffer(), t) for e, t in zip(entries, (np.int32, np.int32, np.float64), strict=True))
                if i == lo:
                    left = (m, entries)
                if i == hi and left is not None and left[0] == m:
                    _add_product(left[1], entries, sims)
        yield from done()

    return dealt.repartitionById(parts, F.pmod(number, F.lit(parts)).cast("int")).sortWithinPartitions("lo", "hi", "m", "i").mapInArrow(run, "a long, b long, sim double")


def nearest_keys(vectors: DataFrame, k: int = 12, least: float = 0.08, tile: int = TILE) -> DataFrame:
    """The k keys with the greatest cosine of PPMI vectors; syntagmatic if they mostly occur together, else paradigmatic.

    Vectors are brought to length 1 and multiplied by tiles of ``tile`` keys at most; pairs of keys are made within a tile,
    and only those that can be among a key's k leave it. ``least`` must be positive.
    """
    vectors = materialise(vectors, "vectors")
    norms = vectors.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    names = vectors.select("key").union(vectors.select("other")).distinct()
    codes = numbered(names, [F.col("key")], "id")  # in order of keys, so equal similarities go by number
    of = lambda c, name: codes.select(F.col("key").alias(c), F.col("id").alias(name))
    unit = vectors.join(norms, "key").join(of("key", "a"), "key").join(of("other", "c"), "other").select("a", "c", (F.col("w") / F.col("norm")).alias("w"))
    n = max(1, codes.count())
    side = min(tile, max(64, -(-n // 8)))  # eight rows of tiles at least, for many tasks
    near = _tile_products(unit, side, -(-n // side), k, least)
    top = near.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("sim", 9)), "b"))).where(F.col("rank") <= k)
    named = top.join(of("key", "a"), "a").join(of("near", "b"), "b").select("key", "near", "rank", "sim")
    met = vectors.select("key", F.col("other").alias("near"), "k", F.least("df", "other_df").alias("rarer"))
    kind = F.when(F.coalesce(F.col("k") / F.col("rarer"), F.lit(0.0)) >= 0.25, "syntagmatic").otherwise("paradigmatic")
    return named.join(met, ["key", "near"], "left").select("key", "near", "rank", "sim", kind.alias("kind"))


def relatedness(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """The cosine of given pairs (a, b)."""
    norms = vectors.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    x, y = vectors.select(F.col("key").alias("a"), "other", "w"), vectors.select(F.col("key").alias("b"), "other", F.col("w").alias("v"))
    dot = pairs.join(x, "a").join(y, ["b", "other"]).groupBy("a", "b").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    n = lambda c: norms.select(F.col("key").alias(c), F.col("norm").alias(f"n{c}"))
    return pairs.join(dot, ["a", "b"], "left").join(n("a"), "a", "left").join(n("b"), "b", "left").select("a", "b", F.coalesce(F.col("dot") / (F.col("na") * F.col("nb")), F.lit(0.0)).alias("score"))


def _grams(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size("ws") - n), lambda i: F.array_join(F.slice("ws", i + 1, n), " "))


def distinct_ngrams(tokens: DataFrame, n: int) -> DataFrame:
    """(pid, grp, ord, gram): the different runs of n keys of each passage; each passage is one row where it comes with its words (ws)."""
    if "ws" in tokens.columns:
        return tokens.where(F.size("ws") >= n).select("pid", "grp", "ord", F.explode(F.array_distinct(_grams(n))).alias("gram"))
    return ngrams(tokens, n).select("pid", "grp", "ord", "gram").distinct()


def ngrams(tokens: DataFrame, n: int) -> DataFrame:
    """(pid, grp, ord, pos, gram): runs of n keys within a passage; of tokens, or without a shuffle of passages (pid, grp, ord, ws)."""
    if "ws" in tokens.columns:
        return tokens.where(F.size("ws") >= n).select("pid", "grp", "ord", F.posexplode(_grams(n)).alias("pos", "gram"))
    w = Window.partitionBy("pid").orderBy("pos")
    words = [F.lead("key", i).over(w) for i in range(n)]
    return tokens.select("pid", "grp", "ord", "pos", F.when(words[-1].isNotNull(), F.concat_ws(" ", *words)).alias("gram")).where("gram is not null")


def shared_phrases(tokens: DataFrame, pid: str, least: int = 3, seed: int = 2) -> DataFrame:
    """phrase, n_words and the number of other passages that share it with a passage: runs of ``least`` words at least.

    Seeds that both have are joined; on a diagonal (the difference of positions) those that follow one another make a
    maximal run. From each place where a run begins, the phrases as long as some passage's match from there are counted by
    the passages that match as far; any other phrase is within a longer one that as many share. A phrase within a longer
    one goes unless more passages share it.
    """
    grams = ngrams(tokens, seed)
    centre = grams.where(F.col("pid") == pid).select("gram", F.col("pos").alias("at"))
    met = grams.where(F.col("pid") != pid).join(centre, "gram").select(F.col("pid").alias("other"), (F.col("pos") - F.col("at")).alias("diagonal"), "at")
    w = Window.partitionBy("other", "diagonal").orderBy("at")
    runs = met.withColumn("island", F.col("at") - F.row_number().over(w)).groupBy("other", "diagonal", "island").agg(F.min("at").alias("first"), (F.max("at") + seed).alias("end"))
    starts = runs.select(F.col("first").alias("start")).distinct()
    # the places of one passage: bounded by its words
    matched = runs.join(F.broadcast(starts), F.col("start").between(F.col("first"), F.col("end") - least)).groupBy("start", "other").agg(F.max(F.col("end") - F.col("start")).alias("n_words"))
    by_length = matched.groupBy("start", "n_words").agg(F.count("*").alias("n"))
    longest = by_length.select("start", "n_words", F.sum("n").over(Window.partitionBy("start").orderBy(F.desc("n_words"))).alias("others"))
    words = tokens.where(F.col("pid") == pid).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]).alias("ws"))
    phrases = longest.join(F.broadcast(words)).select(F.array_join(F.slice("ws", (F.col("start") + 1).cast("int"), F.col("n_words").cast("int")), " ").alias("phrase"), "n_words", "others").groupBy("phrase").agg(F.max("n_words").cast("int").alias("n_words"), F.max("others").alias("others"))
    wider = phrases.select(F.col("phrase").alias("wide"), F.col("n_words").alias("wide_words"), F.col("others").alias("wide_others"))
    inside = F.concat(F.lit(" "), F.col("wide"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    # the phrases of one passage: bounded by its words
    return phrases.join(F.broadcast(wider), inside & (F.col("wide_words") > F.col("n_words")) & (F.col("wide_others") >= F.col("others")), "left_anti")


@F.pandas_udf(T.IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _common(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


def word_diff(a: Column, b: Column) -> Column:
    """same, changed and ratio of two arrays of words by their longest common subsequence."""
    same = _lcs(a, b)
    return F.struct(same.alias("same"), (F.size(a) + F.size(b) - 2 * same).alias("changed"), (2 * same / F.greatest(F.size(a) + F.size(b), F.lit(1))).alias("ratio"))


def _rows(x, y, keep: set[int] | None = None, of: int = 0, begin: tuple[int, int] | None = None) -> dict[int, int]:
    """What x[i:] shares with ends of y, as bits, for the rows i that are kept: bit p is unset where y's end of p + 1 words shares one more than that of p.

    One row needs the row below it only; ``begin`` (i, bits) is where to go on from, ``of`` the last row wanted.
    """
    places: dict = {}
    for p, w in enumerate(reversed(y)):
        places[w] = places.get(w, 0) | 1 << p
    full = (1 << len(y)) - 1
    i, bits = begin or (len(x), full)
    kept = {i: bits}
    while i > of:
        i -= 1
        met = bits & places.get(x[i], 0)
        bits = ((bits + met) | (bits - met)) & full
        if keep is None or i in keep:
            kept[i] = bits
    return kept


def _common(x, y) -> int:
    """The length of a longest common subsequence."""
    return len(y) - _rows(x, y, {0})[0].bit_count()


def edit_script(x, y) -> list[tuple[str, str]]:
    """The steps from x to y along a longest common subsequence: equal words stay, else a word goes if that loses nothing, else one comes in.

    A row of the table of common lengths is kept as bits, and of the rows only every one in about the root of their number;
    those between two kept rows are made again when the way comes to them. So two texts of n and m words take some
    n * m / 64 steps and sqrt(n) * m bits.
    """
    gap = max(1, int(len(x) ** 0.5))
    coarse = _rows(x, y, {i for i in range(0, len(x) + 1, gap)})
    out: list[tuple[str, str]] = []
    i = j = 0
    left = len(y) - coarse[0].bit_count()
    fine: dict[int, int] = {}
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append(("same", x[i]))
            i, j, left = i + 1, j + 1, left - 1
            continue
        if i + 1 not in fine:
            above = min(k for k in coarse if k > i)
            fine = _rows(x, y, None, i, (above, coarse[above]))
        n = len(y) - j
        if n - (fine[i + 1] & ((1 << n) - 1)).bit_count() == left:
            out.append(("del", x[i]))
            i += 1
        else:
            out.append(("ins", y[j]))
            j += 1
    return [*out, *(("del", w) for w in x[i:]), *(("ins", w) for w in y[j:])]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("word", T.StringType())])))
def diff_operations(a: pd.Series, b: pd.Series) -> pd.Series:
    """The steps from one array of words to the other along a longest common subsequence: same, del and ins, deletions first; null where either is null."""
    return pd.Series([None if x is None or y is None else [{"op": o, "word": w} for o, w in edit_script(list(x), list(y))] for x, y in zip(a, b, strict=True)])


def _edits(most: int) -> Callable[[Column, Column], Column]:
    """Words to leave out and put in to get from one array to the other, or null beyond ``most``: work grows with their length times most."""

    def distance(x, y) -> int | None:
        reach = {1: 0}
        for d in range(most + 1):
            for k in range(-d, d + 1, 2):
                i = reach.get(k + 1, -1) if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else reach.get(k - 1, -1) + 1
                while 0 <= i < len(x) and 0 <= i - k < len(y) and x[i] == y[i - k]:
                    i += 1
                reach[k] = i
                if i >= len(x) and i - k >= len(y):
                    return d
        return None

    @F.pandas_udf(T.IntegerType())
    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return edits


def word_rows(tokens: DataFrame) -> DataFrame:
    """(pid, ws): the words of each passage in order; what has them in a column ``ws`` already is taken as it is, without a shuffle."""
    if "ws" in tokens.columns:
        return tokens.select("pid", "ws").where(F.size("ws") > 0)
    return tokens.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]).alias("ws"))


def _texts(tokens: DataFrame) -> DataFrame:
    return word_rows(tokens).withColumn("text", F.sha2(F.array_join("ws", " "), 256))


def equal_passages(tokens: DataFrame) -> DataFrame:
    """pid of each passage and the first (by pid) with the same words in the same order (same_as), which may be itself; of tokens, or of passages (pid, ws)."""
    texts = _texts(tokens).select("pid", F.unhex("text").alias("text"))
    # each passage meets the one row of its text
    return texts.join(texts.groupBy("text").agg(F.min("pid").alias("same_as")), "text").select("pid", "same_as")


def _segment(n: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Where a segment of a passage of n words begins, from 1, and its length; the last one has what is left over."""
    size = F.floor(n / parts).cast("int")
    return size * i + 1, (size if i < parts - 1 else n - size * (parts - 1))


def near_twins(tokens: DataFrame, seed: int = 4, most_changed: int = 2, least_same: int = 3, classes: bool = False) -> DataFrame:
    """Pairs of passages that share a run of ``seed`` words and differ by few: a, b, same, changed.

    Of a passage cut into one segment more than there may be changes, one is whole in its twin, at most as many words away
    from its place. So passages meet by length, segment and words, however common a run of words is, and only what meets is
    compared. With ``classes`` the first of the passages with the same words stands for them all (equal_passages tells which).
    Takes tokens, or passages (pid, ws).
    """
    words = word_rows(tokens)
    if classes:
        words = _texts(tokens).groupBy(F.unhex("text").alias("text")).agg(F.min(F.struct("pid", "ws")).alias("x")).select("x.pid", "x.ws")
    words = materialise(words.where(F.size("ws") >= max(seed, least_same)).withColumn("n", F.size("ws")), "twin-words")
    parts = most_changed + 1
    own = F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(F.slice("ws", *_segment(F.col("n"), i, parts))).alias("h")) for i in range(parts)])
    held = words.select(F.col("pid").alias("a"), "n", F.explode(own).alias("s")).select("a", "n", "s.*")
    other = words.select(F.col("pid").alias("b"), "ws", F.explode(F.sequence(F.greatest(F.col("n") - most_changed, F.lit(max(seed, least_same))), F.col("n"))).alias("n"))
    begins = lambda i, d: _segment(F.col("n"), i, parts)[0] + d
    at = [F.when(begins(i, d) >= 1, F.struct(F.lit(i).alias("i"), F.xxhash64(F.slice("ws", F.greatest(begins(i, d), F.lit(1)), _segment(F.col("n"), i, parts)[1])).alias("h"))) for i in range(parts) for d in range(-most_changed, most_changed + 1)]
    probes = other.select("b", "n", F.explode(F.array_distinct(F.array_compact(F.array(*at)))).alias("s")).select("b", "n", "s.*")
    pairs = materialise(held.join(probes, ["n", "i", "h"]).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "twin-pairs", True)
    # only the words of passages that met another are dealt out again
    some = pairs.select(F.explode(F.array("a", "b")).alias("pid")).distinct()
    words = words.join(F.broadcast(some) if pairs.count() <= MOST_SENT else some, "pid", "left_semi")
    side = lambda c: words.select(F.col("pid").alias(c), F.col("ws").alias(f"w{c}"))
    edits = _edits(most_changed)
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    found = met.select("a", "b", "wa", "wb", (F.size("wa") + F.size("wb")).alias("n"), edits("wa", "wb").alias("changed")).where("changed is not null")
    runs = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - (seed - 1)), lambda i: F.xxhash64(F.slice(c, i, seed)))
    same = F.floor((F.col("n") - F.col("changed")) / 2).cast("int")
    return found.where(F.arrays_overlap(runs("wa"), runs("wb"))).select("a", "b", same.alias("same"), "changed").where(F.col("same") >= least_same)


def bonds(tokens: DataFrame, most: int = 3, distance: int = 2) -> DataFrame:
    """Rare words that recur in a group at a distance: grp, key, passages, first, last."""
    rows = postings(tokens)
    df = rows.groupBy("key").agg(F.count("*").alias("df")).where(F.col("df") <= most)
    own = rows.join(df, "key").groupBy("grp", "key").agg(F.count("*").alias("passages"), F.min("ord").alias("first"), F.max("ord").alias("last"))
    return own.where((F.col("passages") >= 2) & (F.col("last") - F.col("first") >= distance))


def phrase_bonds(tokens: DataFrame, n: int = 3, most: int = 3, distance: int = 2) -> DataFrame:
    """Rare runs of n words that only one group has, at a distance in it."""
    rows = distinct_ngrams(tokens, n)
    held = rows.groupBy("gram").agg(F.count("*").alias("passages"), F.min("grp").alias("grp"), F.max("grp").alias("hi"), F.min("ord").alias("first"), F.max("ord").alias("last"))
    return held.where((F.col("grp") == F.col("hi")) & F.col("passages").between(2, most) & (F.col("last") - F.col("first") >= distance)).select("grp", "gram", "passages", "first", "last")


def kin(roots: DataFrame, root: str) -> DataFrame:
    """Roots of two to four letters that are anagrams of a root or share at least two letters with it (as multisets)."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    own = F.lit(root)
    n = lambda text, x: F.size(F.filter(letters(text), lambda y: y == x))
    overlap = F.aggregate(F.array_distinct(letters(own)), F.lit(0), lambda s, x: s + F.least(n(own, x), n(F.col("key"), x)))
    rows = roots.where((F.col("key") != root) & F.length("key").between(2, 4)).select("key", overlap.alias("shared"), (F.array_join(F.array_sort(letters(F.col("key"))), "") == F.array_join(F.array_sort(letters(own)), "")).alias("anagram"))
    return rows.where("anagram or shared >= 2")


def seams(tokens: DataFrame, keys: DataFrame, edge: int = 3) -> DataFrame:
    """Groups that follow one another: a, b, the key roots they share (shared_keys) and those of a's last and b's first passages (seam); pairs without any go."""
    groups = tokens.select("grp").distinct().withColumn("i", F.row_number().over(Window.orderBy("grp")))
    pairs = groups.select(F.col("grp").alias("a"), "i").join(groups.select(F.col("grp").alias("b"), (F.col("i") - 1).alias("i")), "i").drop("i")
    passages = tokens.select("grp", "pid", "ord").distinct()
    from_start = F.row_number().over(Window.partitionBy("grp").orderBy("ord"))
    from_end = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("ord")))
    ends = passages.withColumn("s", from_start).withColumn("e", from_end)
    roots = roots_of(tokens).select("pid", "key")
    side = lambda c: ends.where(F.col(c) <= edge).join(roots, "pid").groupBy("grp").agg(F.sort_array(F.collect_set("key")).alias(c))
    top = keys.groupBy("grp").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    of = lambda df, c, name: df.select(F.col("grp").alias(c), F.col(df.columns[-1]).alias(name))
    joined = pairs.join(of(top, "a", "ka"), "a", "left").join(of(top, "b", "kb"), "b", "left").join(of(side("e"), "a", "ea"), "a", "left").join(of(side("s"), "b", "sb"), "b", "left")
    none = F.array().cast("array<string>")
    both = lambda x, y: F.array_join(F.sort_array(F.array_intersect(F.coalesce(x, none), F.coalesce(y, none))), " ")
    return joined.select("a", "b", both("ka", "kb").alias("shared_keys"), both("ea", "sb").alias("seam")).where("shared_keys != '' or seam != ''")


# --- endings -------------------------------------------------------------------------------------------------------------


def endings(tokens: DataFrame, letters: int = 2) -> DataFrame:
    """pid, grp, ord and the last letters of each passage's last word: the Latin-script counterpart of a rhyme key."""
    return tokens.groupBy("pid", "grp", "ord").agg(F.max_by("key", "pos").alias("final")).withColumn("ending", F.right("final", F.lit(letters)))


def ending_scheme(ends: DataFrame) -> DataFrame:
    """Endings of each group by frequency, and whether an ending is the dominant one."""
    counts = ends.where("ending is not null").groupBy("grp", "ending").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "ending"))).withColumn("dominant", F.col("rank") == 1)


def ending_mates(ends: DataFrame, pid: str) -> DataFrame:
    own = ends.where(F.col("pid") == pid).select(F.col("ending").alias("own"))
    return ends.join(F.broadcast(own), F.col("ending") == F.col("own")).where(F.col("pid") != pid).select("pid", "grp", "ord", "ending")


def ending_runs(ends: DataFrame, region: Callable[[Column], Column]) -> DataFrame:
    """Per group: pairs of adjacent passages with the same ending, with endings of the same region, with others; and the longest run of one ending."""
    w = Window.partitionBy("grp").orderBy("ord")
    rows = ends.select("grp", "ord", "ending", F.lag("ending").over(w).alias("last"), F.row_number().over(w).alias("i"))
    same = F.coalesce(F.col("ending") == F.col("last"), F.lit(False))
    near = F.coalesce(region(F.col("ending")) == region(F.col("last")), F.lit(False)) & F.coalesce(region(F.col("ending")) >= 0, F.lit(False))
    rows = rows.select("grp", "i", F.when(F.col("i") == 1, None).when(same, "same").when(near, "near").otherwise("other").alias("kind"), F.sum((~same).cast("int")).over(w).alias("island"))
    islands = rows.groupBy("grp", "island").agg(F.count("*").alias("run"), *[F.sum((F.col("kind") == k).cast("int")).alias(k) for k in ("same", "near", "other")])
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return islands.groupBy("grp").agg(F.sum("run").alias("passages"), F.max("run").alias("longest_run"), *map(zero, ("same", "near", "other")))
