"""Near-duplicate classes with DartMinHash signatures.

The weighted set of a text is its runs of five words with their counts. Darts fall on the plane of weight and rank above
each element at rate one; those below the element's weight hit it. A dart has one of K coordinates, and the dart of least
rank that hits the set in each coordinate is the set's signature there: two sets agree in a coordinate with a probability
equal to their weighted Jaccard similarity. A set throws only the darts of ranks that it needs, about K log K in all,
however many elements it has. Bands of coordinates make candidates, signatures rank them and the texts confirm them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, mix64, rows_of, slices, text_words, total, word_hashes

WORDS = 5
SIMILARITY = 0.8
#: Coordinates of a signature, and how many a band has: a pair at 0.8 shares one of 20 bands but for 3 cases in 100,000.
K, BAND = 80, 4
#: Candidates must agree in this share of the coordinates: at a similarity of 0.8 that is three standard deviations below.
AGREE = 0.65
#: A bucket of so many members is a company, in which all meet; a larger one is dealt into random companies with a mate or two
#: for a member. All members meet the bucket's hub.
COMPANY = 8
#: Once classes are known, all members of a bucket that are of different classes are compared, in tiles of two parts of about
#: this many members, and in a task so many pairs of signatures at once.
TILE, PAIRS = 1024, 1 << 15
#: A part of a bucket has about this many bytes of texts at most.
TILE_BYTES = 4 << 20
#: The texts that pairs are confirmed with are picked by a broadcast of their ids up to this many (16 bytes each), else by a shuffle.
BROADCAST_IDS = 2_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(codes_hash: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, their counts, and each text's offsets. A text of one to four words has one shingle, all of it."""
    n = np.diff(offsets)
    h = np.zeros(len(codes_hash), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WORDS):
            shifted = np.zeros(len(h), np.uint64)
            shifted[: len(h) - i] = codes_hash[i:]
            if i:  # beyond the end of a short text there is nothing
                shifted[np.arange(len(h)) + i >= np.repeat(offsets[1:], n)] = 0
            h = mix64(h * np.uint64(31) + shifted)
    place = np.arange(len(h)) - np.repeat(offsets[:-1], n)
    keep = place < np.repeat(np.maximum(n - WORDS + 1, np.minimum(n, 1)), n)
    # 44 bits of the hash are the element: in one sorted key with the row
    key = np.sort((rows_of(offsets)[keep].astype(np.uint64) << np.uint64(44)) | (h[keep] >> np.uint64(20)))
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    counts, key = np.diff(np.r_[at, len(key)]), key[at]
    return key & np.uint64((1 << 44) - 1), counts, np.searchsorted(key >> np.uint64(44), np.arange(len(offsets)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(elements: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The id of the earliest dart in each of K coordinates for each weighted set (rows of uint64); sets without elements have zeros.

    Weights are counts. Their axis is cut into regions [2^a - 1, 2^(a+1) - 1); above each region darts arrive in order of
    rank at its height's rate, every gap and place a hash of element, region and number, so all sets see the same darts.
    """
    docs = len(offsets) - 1
    out, rank = np.zeros((docs, K), np.uint64), np.full((docs, K), np.inf)
    sums = total(weights.astype(np.int64), offsets)
    level = np.floor(np.log2(weights + 1)).astype(np.int64) + ((weights + 1) & weights > 0)  # regions that begin below the weight
    item = np.repeat(np.arange(len(elements)), level)
    region = np.arange(len(item)) - np.repeat(np.cumsum(level) - level, level)
    owner = rows_of(offsets)[item]
    low, height = 2.0**region - 1, 2.0**region
    with np.errstate(over="ignore"):
        base = mix64(elements[item] + region.astype(np.uint64) * _GOLD)
    weight = weights[item].astype(float)
    reached, seen = np.zeros(len(item)), np.zeros(len(item), np.uint64)
    limit = (np.log(K) + 3) * K / np.maximum(sums, 1)
    todo = np.arange(len(item))
    while len(todo):
        live = todo
        while len(live):
            with np.errstate(over="ignore"):
                dart = mix64(base[live] + (seen[live] + np.uint64(1)) * _GOLD)
            arrives = reached[live] - np.log(_uniform(dart)) / height[live]
            # a dart beyond the limit is not thrown yet: it stays the next of its region
            now = arrives < limit[owner[live]]
            live, dart, arrives = live[now], dart[now], arrives[now]
            reached[live], seen[live] = arrives, seen[live] + np.uint64(1)
            place = mix64(dart ^ _GOLD)
            hit = low[live] + _uniform(mix64(place)) * height[live] < weight[live]
            slot = owner[live[hit]] * K + ((place[hit] >> np.uint64(32)) * np.uint64(K) >> np.uint64(32)).astype(np.int64)
            r, d = arrives[hit], dart[hit]
            better = np.flatnonzero(r < rank.ravel()[slot])
            better = better[np.argsort(-r[better])]  # of several for a slot, the last assigned is the earliest dart
            rank.ravel()[slot[better]], out.ravel()[slot[better]] = r[better], d[better]
        # sets with an empty coordinate throw on
        short = (np.isinf(rank).any(axis=1)) & (sums > 0)
        limit = np.where(short, 2 * limit, 0)
        todo = np.flatnonzero(short[owner])
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two weighted sets (ascending elements, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - common
    return float(common / whole) if whole else 0.0


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, counts, offsets, and a digest of the words of each text in two columns."""
    codes, words, offsets = text_words(texts)
    h = word_hashes(words)[codes]
    with np.errstate(over="ignore"):
        place = (np.arange(len(h)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(np.uint64)
        digest = np.column_stack([mix64(total(mix64(h + (place + np.uint64(1)) * _GOLD * np.uint64(k)), offsets)) for k in (3, 5)])
    return *shingles(h, offsets), digest


SIGNED = "id long, h long, a long, b long, signature binary, bands array<long>"


def signed(docs: DataFrame) -> DataFrame:
    """Of (id, h, text): id and h, the digest of the words, a byte a coordinate, and the hashes of the bands. Texts without words have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            elements, counts, offsets, digest = _sets(batch["text"])
            sig = signatures(elements, counts, offsets)
            some = np.diff(offsets) > 0
            with np.errstate(over="ignore"):
                bands = np.zeros((len(sig), K // BAND), np.uint64)
                for i in range(BAND):
                    bands = mix64(bands * np.uint64(31) + sig[:, i::BAND])
                bands = mix64(bands + np.arange(K // BAND, dtype=np.uint64) * _GOLD).view(np.int64)
            ends = np.r_[0, np.cumsum(np.where(some, K // BAND, 0))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch["id"], batch["h"], pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)),
                pa.array([x.tobytes() for x in (sig & np.uint64(255)).astype(np.uint8)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[some].ravel())),
            ], names=["id", "h", "a", "b", "signature", "bands"])

    return docs.mapInArrow(run, SIGNED)


# --- classes ----------------------------------------------------------------------------------------------------------


def connected(edges: DataFrame, name: str = "classes") -> DataFrame:
    """v and its class c, the least vertex it is connected with, for each vertex of edges (u, v).

    Every round each vertex takes the least class among its neighbours' and its own, then the class of that class, until
    none changes; rounds grow with the logarithm of a class's width. Minima are taken before the shuffle, so a vertex
    with very many edges is no large group.
    """
    both = materialise(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), name, True)
    classes = materialise(both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")).select("v", F.least("v", "m").alias("c")), name, True)
    while True:
        near = both.join(classes, "v").groupBy("u").agg(F.min("c").alias("m"))
        step = materialise(classes.join(near, F.col("v") == F.col("u")).select("v", F.col("c").alias("old"), F.least("c", "m").alias("c")), name, True)
        jump = step.select(F.col("v").alias("of"), F.col("c").alias("then"))
        step = materialise(step.join(jump, F.col("c") == F.col("of")).select("v", "old", F.least("c", "then").alias("c")), name, True)
        classes = step.select("v", "c")
        if step.where("old != c").isEmpty():
            return classes


def _hash(*columns: str | Column) -> Column:
    return F.xxhash64(*columns)


def _candidates(members: DataFrame, hubs: Column, turn: int) -> DataFrame:
    """Pairs (u < v) of bucket members: each with the bucket's hub (that of the greatest ``hubs``), and those of its companies: a few pairs a member."""
    buckets = materialise(members.groupBy("key").agg(F.max(F.struct(hubs.alias("by"), F.col("v").alias("hub"))).alias("top"), F.count("*").alias("n")).where("n > 1").select("key", "top.hub", "n"), "buckets", True)
    placed = members.join(buckets, "key")
    with_hub = placed.where("v != hub").select(F.least("v", "hub").alias("u"), F.greatest("v", "hub").alias("v"))
    salt = F.pmod(_hash("key", "v", F.lit(turn)), F.when(F.col("n") <= COMPANY, 1).otherwise(F.col("n")))
    company = placed.groupBy("key", salt.alias("salt")).agg(F.array_sort(F.collect_set("v")).alias("vs"))
    later = F.transform("vs", lambda x, i: F.struct(x.alias("u"), F.slice("vs", i + 2, F.size("vs")).alias("rest")))
    pairs = company.where(F.size("vs") > 1).select(F.inline(later)).select("u", F.explode("rest").alias("v"))
    return with_hub.unionByName(pairs).distinct()


def _common(sets: tuple[np.ndarray, np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The weighted Jaccard similarities of the sets i and j (ascending i) of the elements, counts and offsets in sets."""
    elements, counts, offsets = sets
    distinct, code = np.unique(elements, return_inverse=True)
    held, sums, out = np.zeros(len(distinct), np.int64), total(counts, offsets), np.zeros(len(i))
    for first, last in zip(at := np.flatnonzero(np.r_[True, i[1:] != i[:-1]]), [*at[1:], len(i)], strict=True):
        own = slice(offsets[i[first]], offsets[i[first] + 1])
        held[code[own]] = counts[own]
        for some in range(first, last, 256):
            js = j[some : min(some + 256, last)]
            n = offsets[js + 1] - offsets[js]
            ends = np.r_[0, np.cumsum(n)]
            theirs = np.repeat(offsets[js] - ends[:-1], n) + np.arange(ends[-1])
            common = total(np.minimum(held[code[theirs]], counts[theirs]), ends)
            out[some : some + len(js)] = common / (sums[i[first]] + sums[js] - common)
        held[code[own]] = 0
    return out


def _across(placed: DataFrame, vertices: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (u < v, similarity) between members (key, v, c) of different classes c in a bucket, one at least for two classes that have any.

    All pairs are compared whose signatures agree enough, each in the first bucket that it shares. A large bucket is dealt
    into parts, and each two parts are a tile, so no task holds all of it. Pairs are met in Python: only links become rows.
    """
    sized = placed.join(vertices.select("v", "signature", "bands"), "v").join(texts.withColumnRenamed("id", "v"), "v")
    sized = materialise(sized, "sized")
    parts = sized.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.octet_length("text")) / TILE_BYTES, F.lit(1))).cast("int").alias("parts"))
    dealt = sized.join(parts, "key").withColumn("part", F.pmod(_hash("v", F.lit(-1)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = dealt.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "c", "v", "part", "signature", "bands", "text")

    def links(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Of whole tiles in order of their classes."""
        key, lo, hi, c, v, part = (batch[i].to_numpy() for i in range(6))
        sig = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint8).reshape(-1, K)
        bands = batch["bands"].flatten().to_numpy().reshape(-1, K // BAND)
        tile = np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
        group = tile | np.r_[True, c[1:] != c[:-1]]
        after = lambda first: np.r_[np.flatnonzero(first), len(key)][np.cumsum(first)]
        begin, end = after(group), after(tile)
        ends = np.cumsum(end - begin)  # a row meets those of its tile's later classes
        found = [np.empty((2, 0), np.int64)]
        for first in range(0, int(ends[-1]), PAIRS):
            pair = np.arange(first, min(first + PAIRS, int(ends[-1])))
            i = np.searchsorted(ends, pair, "right")
            j = end[i] - (ends[i] - pair)
            met = np.flatnonzero((lo[i] == hi[i]) | (part[i] != part[j]))
            met = met[np.count_nonzero(sig[i[met]] == sig[j[met]], axis=1) >= AGREE * K - 1e-9]
            i, j = i[met], j[met]
            shared = (bands[i] == bands[j]).argmax(axis=1)
            found.append(np.stack([i, j])[:, bands[i, shared] == key[i]])
        i, j = np.concatenate(found, axis=1)
        rows, where = np.unique(np.r_[i, j], return_inverse=True)
        s = _common(_sets(batch["text"].take(pa.array(rows)))[:3], where[: len(i)], where[len(i) :]) if len(i) else np.zeros(0)
        i, j, s = i[s >= threshold], j[s >= threshold], s[s >= threshold]
        _, one = np.unique(np.column_stack([c[i], c[j]]), axis=0, return_index=True)
        i, j, s = i[one], j[one], s[one]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(v[i], v[j])), pa.array(np.maximum(v[i], v[j])), pa.array(s)], names=["u", "v", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = lambda x, i: tuple(x[k][i].as_py() for k in range(3))
        held: list[pa.RecordBatch] = []  # the tile that may go on
        for whole in batches:
            for batch in slices(iter([whole]), "text", 2 << 20):
                last = tile(batch, -1)
                cut = batch.num_rows - int(np.logical_and.reduce([batch[k].to_numpy() == last[k] for k in range(3)]).sum())
                if cut or held and tile(held[-1], -1) != last:
                    yield links(pa.concat_batches([*held, batch.slice(0, cut)]))
                    held = []
                held.append(batch.slice(cut))
        if held:
            yield links(pa.concat_batches(held))

    return tiles.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "c").mapInArrow(run, "u long, v long, similarity double").distinct()


def _agreeing(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """The pairs whose signatures agree enough, with the share of coordinates (agree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, K) for c in ("a", "b"))
            agree = (a == b).mean(axis=1)
            keep = pa.array(agree >= AGREE)
            yield pa.RecordBatch.from_arrays([batch["u"].filter(keep), batch["v"].filter(keep), pa.array(agree).filter(keep)], names=["u", "v", "agree"])

    one, two = (vertices.select(F.col("v").alias(of), F.col("signature").alias(s)) for of, s in (("u", "a"), ("v", "b")))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long, agree double")


def _best(pairs: DataFrame) -> DataFrame:
    """The pair of each document that agrees most."""
    ends = pairs.select("u", "v", "agree", F.explode(F.array("u", "v")).alias("end"))
    return ends.groupBy("end").agg(F.max(F.struct("agree", _hash("u", "v").alias("tie"), "u", "v")).alias("x")).select("x.u", "x.v").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """u, v and their similarity, for the pairs whose texts reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "b", 2 << 20):
                both = pa.concat_arrays([batch["a"], batch["b"]])
                elements, counts, offsets, _ = _sets(both)
                n = batch.num_rows
                s = np.array([similarity(*((elements[offsets[i] : offsets[i + 1]], counts[offsets[i] : offsets[i + 1]]) for i in (k, n + k))) for k in range(n)])
                keep = pa.array(s >= threshold)
                yield pa.RecordBatch.from_arrays([batch["u"].filter(keep), batch["v"].filter(keep), pa.array(s, pa.float64()).filter(keep)], names=["u", "v", "similarity"])

    one, two = (texts.select(F.col("id").alias(of), F.col("text").alias(t)) for of, t in (("u", "a"), ("v", "b")))
    return pairs.select("u", "v").join(one, "u").join(two, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long, similarity double")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """id, class_id, n_links and copy_of of each row of docs.

    Documents are linked if the weighted Jaccard similarity of their runs of five words (lower-cased, without marks) is
    at least ``threshold``; a class is what links connect, named by its least id. Texts with the same words are copies:
    ``copy_of`` is the least id among them, and only that one is compared with others. ``n_links`` counts the confirmed
    links by which the class was joined together, at its representatives. Null texts and texts without words are alone.
    Rows with the same id are one document, of whose texts one is compared; rows without an id are in the class of a
    document with the same words, if there is one, else their class is null. Empty tables give an empty result.

    Two documents are candidates if they share a bucket and their signatures agree enough. In the first turn the members of
    a bucket meet a hub and small random companies, in the second the member with most links so far; each document has its
    most promising candidate confirmed. Then the signatures of all members of a bucket that are still of different classes
    are compared, and the texts of every pair that agrees, so that no candidates of different classes stay untried.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    sig = materialise(signed(chosen.select("id", "h", "text")), "signed")
    wordless = F.size("bands") == 0
    first = materialise(sig.where(~wordless & F.col("id").isNotNull()).groupBy("a", "b").agg(F.min("id").alias("v")), "texts", True)
    # of rows that share an id, the one with the greatest hash stands for the document
    vertices = sig.where(~wordless).join(first.select("v").distinct(), F.col("id") == F.col("v")).groupBy("v").agg(F.max(F.struct("h", "signature", "bands")).alias("x")).select("v", "x.h", "x.signature", "x.bands")
    vertices = materialise(vertices, "vertices")
    every = vertices.select("v", F.explode("bands").alias("key"))
    members = materialise(every.join(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key", "left_semi").select("key", "v"), "members", True)
    known = materialise(vertices.join(members.select("v").distinct(), "v", "left_semi").select("v", "h", "signature"), "signatures", True)
    wanted = known.select(F.col("v").alias("id"), "h")
    wanted = F.broadcast(wanted) if known.count() <= BROADCAST_IDS else wanted
    texts = materialise(chosen.join(wanted, ["id", "h"], "left_semi").groupBy("id").agg(F.max("text").alias("text")), "wanted")
    links = checked = None
    for turn in range(2):
        left, by = members, _hash("v", F.lit(turn))
        if turn:
            degree = links.select("u").unionAll(links.select(F.col("v").alias("u"))).groupBy("u").agg(F.count("*").alias("degree"))
            left, by = members.join(degree, F.col("v") == F.col("u"), "left").select("key", "v", F.coalesce("degree", F.lit(0)).alias("degree")), F.struct("degree", _hash("v", F.lit(turn)))
        open_ = _agreeing(_candidates(materialise(left, "left", True) if turn else left, by, turn), known)
        open_ = materialise(open_ if checked is None else open_.join(checked, ["u", "v"], "left_anti"), "agreeing", True)
        tried = materialise(_best(open_), "tried", True)
        new = materialise(_confirmed(tried, texts, threshold), "links", True)
        checked = tried if checked is None else checked.unionByName(tried)
        links = new if links is None else links.unionByName(new)
        if new.isEmpty() and turn == 0:
            break
    classes = connected(links)
    placed = members.join(classes.withColumnRenamed("v", "of"), F.col("v") == F.col("of"), "left").select("key", "v", F.coalesce("c", "v").alias("c"))
    # a bucket that lies in one class has nothing to add
    several = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    placed = materialise(placed.join(several, "key", "left_semi"), "placed", True)
    links = links.unionByName(materialise(_across(placed, vertices, texts, threshold), "links", True))
    classes = connected(links)
    degree = links.select(F.col("u").alias("of")).unionAll(links.select(F.col("v").alias("of"))).groupBy("of").agg(F.count("*").alias("n"))
    joined = degree.join(classes, F.col("of") == F.col("v")).select("of", "c", "n")
    found = first.join(joined, F.col("v") == F.col("of"), "left").select("a", "b", "v", F.coalesce("c", "v").alias("c"), F.coalesce("n", F.lit(0)).alias("n"))
    found = materialise(found, "found", True)
    return sig.select("id", F.when(~wordless, F.col("a")).alias("a"), F.when(~wordless, F.col("b")).alias("b")).join(found, ["a", "b"], "left").select(
        F.col("id").alias(id_col), F.coalesce("c", "id").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("v", "id").alias("copy_of"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class of near duplicates, with the columns of docs.

    Each row is a document, whatever its id: rows are told apart by a 64-bit hash of id and text, so two that share an id
    are near duplicates only if their texts are. Rows with null texts or texts without words are kept, one of those that
    have the same id and text.
    """
    name = "__row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    keyed = docs.withColumn(name, F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("string"), F.col(text_col)))
    classes = near_duplicates(keyed.select(F.col(name), F.col(text_col).alias("text")), id_col=name, threshold=threshold)
    first = classes.where(F.col(name) == F.col("class_id")).select(name).distinct()
    return keyed.join(first, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
