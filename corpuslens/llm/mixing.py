"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source is the stream of its documents' words in order of id, cut into blocks of equal size. The tree halves the exact
block quotas of all sources again and again until each output shard has its quota of every source, as if all blocks drawn
had been shuffled together and dealt out. A keyed permutation ranks a source's blocks; shard after shard takes the next
ranks of each source, so the draws are disjoint without anything that all documents must meet for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, mix64, slices

#: At most so many words a block, unless that made more than MOST_BLOCKS blocks; a source has FEWEST blocks at least if it has as many words.
BLOCK_WORDS, FEWEST, MOST_BLOCKS = 256, 1000, 400_000_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEGMENT = "array<struct<shard:int,slot:bigint,pass:int,first_word:bigint,n_words:int>>"


def n_words(text: Column) -> Column:
    """The number of runs of other characters than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float = 3.0) -> list[float]:
    """Shares of total by weight, none above most times its size: the excess goes to the others by weight until none is above."""
    out, left, open_ = [0.0] * len(sizes), float(total), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit >= most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            return out
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        left, open_ = max(0.0, left), open_ - full
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows of shards, columns of sources: the tree's draw, whose columns sum to the quotas exactly."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    take = int(quotas.sum()) * left // shards
    rng = np.random.Generator(np.random.PCG64([seed, shards]))
    first = rng.multivariate_hypergeometric(quotas, take, method="marginals") if take else np.zeros_like(quotas)
    return np.concatenate([split_quotas(first, left, 2 * seed + 1), split_quotas(quotas - first, shards - left, 2 * seed + 2)])


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0 .. n-1 by element: a Feistel network that is walked until it is back below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    limit = n.astype(np.uint64)
    while len(todo):
        a, b, h, m, k = out[todo] >> half[todo], out[todo] & mask[todo], half[todo], mask[todo], key[todo]
        for i in range(4):
            a, b = b, a ^ (mix64(b + k + mix64(np.uint64(i + 1))) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the words of the source before each row, within the partition; rows come sorted by source."""
    last, held = None, 0
    for batch in batches:
        size, source = batch["__size"].to_numpy(), batch["__source"].dictionary_encode()
        code = source.indices.to_numpy(zero_copy_only=False)
        before = np.cumsum(size) - size
        new = np.r_[True, code[1:] != code[:-1]]
        local = before - before[np.flatnonzero(new)[np.cumsum(new) - 1]]
        if source.dictionary[int(code[0])].as_py() == last:
            local[: np.flatnonzero(~(code == code[0]))[0] if (code != code[0]).any() else len(code)] += held
        last, held = source.dictionary[int(code[-1])].as_py(), int(local[-1] + size[-1])
        columns = [*batch.columns[:4], pa.array(local), *batch.columns[4:]]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:4], "__local", *batch.schema.names[4:]])


def _shards(cuts: np.ndarray, source: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shard that draws each rank of the source's blocks; len(cuts) where none does."""
    out, order = np.zeros(len(rank), np.int64), np.argsort(source, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(source[order])) + 1) if len(order) else []:
        out[own] = np.searchsorted(cuts[:, source[own[0]]], rank[own], "right")
    return out


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """A row for each row of docs: id, size, source_size, target, taken and segments.

    Sources, by code point with null last, weigh ``weights`` in turn and share ``share`` of all words; a source gives
    ``most`` times its size at most. ``segments`` are the parts of the document that output shards draw: the shard, the slot
    within it (ascending slots are the shard's shuffled order), pass over the source, first word and number of words. A
    block is taken because the tree gave some shard the quota that draws it; ``taken`` is the sum of the segments' words. A
    source's taken words miss its target by less than four of its blocks. Without ``shards`` there is one for each 16
    million words, 64 at least.

    A null text has size 0 and is never taken; a null source is a source; repeated rows are each a part of the stream;
    an empty table gives an empty plan. The same rows and seed give the same plan, however they are partitioned.
    The driver holds one number for each source and shard, and for each source and part of the sorted stream that has any
    of it (at most one for each source and one for each part).
    """
    return _drawn(docs, [], id_col=id_col, **options).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "segments")


def _drawn(docs: DataFrame, carry: list[str], *, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0, shards: int | None = None, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The plan with the columns to carry, the i-th of them as __c<i>."""
    spark = docs.sparkSession
    kinds = {f"__c{i}": docs.schema[c].dataType.simpleString() for i, c in enumerate(carry)}
    more = "".join(f", {c} {t}" for c, t in kinds.items())
    sized = (
        docs.select(F.col(id_col).cast("long").alias("__id"), F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string"))).alias("__source"), n_words(F.col(text_col)).alias("__size"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)])
        # ties of the id by content, for a plan that doesn't depend on how rows arrive
        .withColumn("__tie", F.xxhash64("__size", *kinds))
        .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "__source", "__id", "__tie")
        .sortWithinPartitions("__source", "__id", "__tie")
        .select("__id", "__source", "__size", F.spark_partition_id().alias("__part"), *kinds)
    )
    sized = materialise(sized.mapInArrow(_running, "__id long, __source string, __size long, __part int, __local long" + more), "mix-sizes")
    sources: dict[str, int] = {}
    before: dict[tuple[str, int], int] = {}
    for r in sorted(sized.groupBy("__source", "__part").agg(F.sum("__size").alias("n")).collect()):
        before[r["__source"], r["__part"]] = sources.get(r["__source"], 0)
        sources[r["__source"]] = sources.get(r["__source"], 0) + r["n"]
    sizes = list(sources.values())
    shards = shards or max(64, sum(sizes) >> 24)
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], share * sum(sizes), most)
    least = max(1, -(-int(most * sum(sizes)) // MOST_BLOCKS))
    block = np.array([max(least, min(BLOCK_WORDS, n // FEWEST), 1) for n in sizes], np.int64)
    blocks = np.array([-(-n // b) for n, b in zip(sizes, block, strict=True)], np.int64)
    quota = np.array([min(int(most * b), round(g * b / n)) if n else 0 for n, b, g in zip(sizes, blocks, goal, strict=True)], np.int64)
    cuts = np.cumsum(split_quotas(quota, shards, seed), axis=0) if len(sources) else np.zeros((shards, 0), np.int64)
    given = spark.sparkContext.broadcast(({s: i for i, s in enumerate(sources)}, before, np.array(sizes, np.int64), np.array(goal), block, blocks, cuts))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, before, size_of, goal_of, block_of, blocks_of, cut_of = given.value
        for batch in batches:
            names_of = batch["__source"].to_pylist()
            own = np.fromiter((place[s] for s in names_of), np.int64, batch.num_rows)
            start = batch["__local"].to_numpy() + np.fromiter((before[x] for x in zip(names_of, batch["__part"].to_pylist(), strict=True)), np.int64, batch.num_rows)
            size = batch["__size"].to_numpy()
            b = block_of[own]
            first = start // b
            many = np.where(size > 0, (start + size - 1) // b - first + 1, 0)
            row = np.repeat(np.arange(batch.num_rows), many)
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
            src = own[row]
            lo, hi = np.maximum(at * block_of[src], start[row]), np.minimum((at + 1) * block_of[src], start[row] + size[row])
            found = []
            for p in range(int(np.ceil(most))):
                key = mix64((np.uint64(seed) << np.uint64(40)) + (src.astype(np.uint64) << np.uint64(8)) + np.uint64(p))
                rank = permuted(at, blocks_of[src], key) + p * blocks_of[src] if len(at) else at
                shard = _shards(cut_of, src, rank)
                some = np.flatnonzero(shard < len(cut_of))
                slot = (mix64(key[some] ^ mix64(at[some])) >> np.uint64(1)).astype(np.int64)
                found.append(np.column_stack([row[some], np.full(len(some), p), at[some], shard[some], slot, lo[some] - start[row[some]], (hi - lo)[some]]))
            found = np.concatenate(found)
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            ends = np.searchsorted(found[:, 0], np.arange(batch.num_rows + 1))
            taken = np.r_[0, np.cumsum(found[:, 6])]
            parts = pa.StructArray.from_arrays([pa.array(found[:, 3].astype(np.int32)), pa.array(found[:, 4]), pa.array(found[:, 1].astype(np.int32)), pa.array(found[:, 5]), pa.array(found[:, 6].astype(np.int32))], names=["shard", "slot", "pass", "first_word", "n_words"])
            yield pa.RecordBatch.from_arrays([batch["__id"], batch["__size"], pa.array(size_of[own]), pa.array(goal_of[own]), pa.array(taken[ends[1:]] - taken[ends[:-1]]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), parts), *[batch[f"__c{i}"] for i in range(len(carry))]], names=names)

    names = ["id", "size", "source_size", "target", "taken", "segments", *kinds]
    return sized.mapInArrow(draw, "id long, size long, source_size long, target double, taken long, segments " + SEGMENT + more)


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as rows of docs, with the same columns: one row for each document and pass that takes words of it.

    Where a pass takes all of a document, its text stays as it is; else the row has the taken stretches of it, each
    verbatim, in order, with a line end between those that don't touch. Other columns are kept as they are, but a column
    ``n_chars`` is that of the new text. Documents without words are not taken. A row belongs to the shard that draws its
    first block; the rows of a shard lie together, shuffled by that block's slot.
    """
    names = docs.columns
    plan = _drawn(docs, names, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    text = f"__c{names.index(text_col)}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), text, 8 << 20):
                rows, texts, dealt = [], [], []
                for i, (old, size, parts) in enumerate(zip(batch[text].to_pylist(), batch["size"].to_pylist(), batch["segments"].to_pylist(), strict=True)):
                    passes: dict[int, list[list[int]]] = {}
                    for s in parts:
                        if s["pass"] not in passes:
                            dealt.append((s["shard"], s["slot"]))
                        runs = passes.setdefault(s["pass"], [])
                        if runs and runs[-1][1] == s["first_word"]:
                            runs[-1][1] += s["n_words"]
                        else:
                            runs.append([s["first_word"], s["first_word"] + s["n_words"]])
                    spans = None
                    for p in sorted(passes):
                        rows.append(i)
                        if passes[p] == [[0, size]]:
                            texts.append(old)
                            continue
                        spans = spans or [m.span() for m in _WORD.finditer(old)]
                        texts.append("\n".join(old[spans[a][0] : spans[b - 1][1]] for a, b in passes[p]))
                made = batch.take(pa.array(rows, pa.int64()))
                columns = {c: made[f"__c{i}"] for i, c in enumerate(names)} | {text_col: pa.array(texts, pa.string())}
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array(list(map(len, texts)), pa.int64()).cast(columns["n_chars"].type)
                shard, slot = (pa.array([d[k] for d in dealt], kind) for k, kind in ((0, pa.int32()), (1, pa.int64())))
                yield pa.RecordBatch.from_arrays([shard, slot, *columns.values()], names=["shard", "slot", *inner])

    inner = [f"__c{i}" for i in range(len(names))]
    kinds = "".join(f", {c} {docs.schema[name].dataType.simpleString()}" for c, name in zip(inner, names, strict=True))
    mixed = plan.select("size", "segments", *inner).mapInArrow(cut, "shard int, slot long" + kinds)
    return mixed.repartition("shard").sortWithinPartitions("shard", "slot").select(*[F.col(c).alias(name) for c, name in zip(inner, names, strict=True)])


def write_mix(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", **options) -> None:
    """Writes the mix below path, a folder for each output shard, with its blocks' words in the shard's shuffled order."""
    plan = _drawn(docs, [text_col], id_col=id_col, text_col=text_col, **options)
    words = F.regexp_extract_all(F.col("__c0"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = plan.where("taken > 0").select(F.col("id").alias(id_col), words.alias("words"), F.explode("segments").alias("s")).select(
        "s.shard", "s.slot", "s.pass", id_col, F.concat_ws(" ", F.slice("words", (F.col("s.first_word") + 1).cast("int"), F.col("s.n_words"))).alias("text"))
    rows.repartition("shard").sortWithinPartitions("shard", "slot", id_col).write.partitionBy("shard").parquet(path)
