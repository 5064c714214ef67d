"""MinHash near-deduplication with sequential Bayesian verification.

1. Every text becomes its set of word shingles; from it come two independent 64-bit digests of the set
   (built on 128-bit BLAKE2 digests of the words) and the keys of its MinHash bands.  Texts whose sets
   have the same size and digests form a class, which goes on as one representative.
2. Representatives that share a band key are candidates.  Of buckets with the same members one is
   looked at.  A bucket of more than BLOCK members or BLOCK_BYTES bytes is hot: it is dealt into blocks, and its PIVOTS (some
   of its members, picked by hash) go along to every block.
3. The members of a bucket or block meet in one task with signatures and texts.  Pairs not yet connected there
   are compared signature batch by signature batch; a pair goes as soon as the posterior probability
   that its similarity reaches the threshold falls below MISS (uniform prior, Beta posterior).
   Survivors are verified exactly: on the full sets of shingles, told apart by their words' bytes.
   Only links that join two parts are kept: what is connected by links stays connected, and no bucket
   gives out its pairs.
4. In a hot bucket whose members are not all in one component by now, those outside its largest
   component are compared with the members of all its blocks, unless connected already.  The pivots
   make these the few: a group of n near copies costs about n comparisons, not n * n.
5. Components of the links, by star rounds, name each row's smallest id reachable.

Band keys miss a pair at the threshold 0.85 with a probability of 6e-11 (32 bands of 4), at 0.8 of
5e-8; pairs above the threshold are missed less.  MISS adds 1e-10 for each batch.

Defined results
---------------
* Null or empty text, or one without a word: no shingles, linked with nothing, its own component.
* Fewer words than the shingle width: the whole sequence is the only shingle.
* Component ids are the smallest doc_id reachable; a null id counts only where all are null.
* Repeated rows have equal sets and so are linked; rows that share an id are told apart by their text.
* An empty table gives no rows.  Columns besides the two named ones are not looked at, whatever their names.
"""

from __future__ import annotations

from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craterloom.llm.components import components
from craterloom.llm.core import mix, slices, text_bytes, tidy, written
from craterloom.llm.shingles import MinHash, exact_sets, hashed_sets

HASHES, ROWS = 128, 4
BATCH, MISS = 32, 1e-10
BLOCK, BLOCK_BYTES, LEAST, PIVOTS = 2048, 8 << 20, 64, 4

#: Bytes of rows with texts that an executor and its worker hold at once, several times over, for each task.
BATCH_BYTES = 4 << 20


def least_matches(threshold: float, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """After each batch, the fewest matching hashes with which a pair still stands.

    With m of n hashes equal and a uniform prior the similarity is Beta(m + 1, n - m + 1), and the
    probability that it reaches t is that of at most m successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(threshold) + (n + 1 - m) * log(1 - threshold))
        out.append(m)
    return out


def _fingerprint(docs: DataFrame, width: int) -> DataFrame:
    """uid, id, k1, k2 (content), bytes, n, h1, h2 (of the set) and band keys of every row."""
    names = ["uid", "id", "k1", "k2", "bytes", "n", "h1", "h2", "keys"]
    bands = HASHES // ROWS

    def run(batches):
        hasher, part, seen = MinHash(HASHES), TaskContext.get().partitionId(), 0
        salt = np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
        for b in batches:
            data, offsets = text_bytes(b["text"])
            for i, j in slices(offsets):
                sets, others = hashed_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], width)
                h1, h2, keys = [], [], []
                for s, other in zip(sets, others):
                    h1.append(int(mix(s.copy()).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    h2.append(int(mix(other).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    if len(s):
                        rows = hasher.of(s).reshape(bands, ROWS).astype(np.uint64)
                        key = mix((rows * salt).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                        for r in range(ROWS):
                            key = mix(key ^ rows[:, r])
                        keys.append(key.view(np.int64))
                    else:
                        keys.append(None)
                m = j - i
                uid = np.arange(seen, seen + m) + (part << 40)
                seen += m
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid), b["id"].slice(i, m), b["k1"].slice(i, m), b["k2"].slice(i, m), pa.array(np.diff(offsets[i:j + 1])), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names)

    return docs.mapInArrow(tidy(run), "uid long, id long, k1 long, k2 long, bytes long, n long, h1 long, h2 long, keys array<long>")


def _members(docs: DataFrame, width: int) -> DataFrame:
    """A row for each task (bucket, first) that a text is asked for: with its uid, root, signature, set size and text."""
    names = ["bucket", "first", "uid", "root", "sig", "n", "text"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]

    def run(batches):
        hasher = MinHash(HASHES)
        for b in batches:
            data, offsets = text_bytes(b["text"])
            uids, roots, tasks = (b[c].to_pylist() for c in ("uid", "root", "tasks"))
            for i, j in slices(offsets):
                rows, held = [], 0
                for k, s in enumerate(hashed_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], width)[0], i):
                    sig, raw = hasher.of(s).tobytes(), data[offsets[k]:offsets[k + 1]].tobytes()
                    for task in tasks[k]:
                        rows.append((task["bucket"], task["first"], uids[k], roots[k], sig, len(s), raw))
                        held += len(raw) + 600
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.mapInArrow(tidy(run), "bucket long, first boolean, uid long, root long, sig binary, n long, text binary")


class Verifier:
    """Links of one bucket: enough of them to connect all that its links connect."""

    def __init__(self, width: int, percent: int):
        self.width, self.percent = width, percent
        self.least = least_matches(percent / 100)

    def links(self, uids: list[int], sigs: np.ndarray, sizes: np.ndarray, texts: list[bytes], roots: np.ndarray, first: np.ndarray | None) -> list[tuple[int, int]]:
        """roots: what is connected already; first: if given, only pairs of one that is first and one that isn't count."""
        out, n = [], len(uids)
        part = np.unique(roots, return_inverse=True)[1]
        codes = starts = mark = None
        others = None if first is None else np.flatnonzero(~first)
        for i in range(n - 1) if first is None else np.flatnonzero(first).tolist():
            js = np.arange(i + 1, n) if first is None else others
            js = js[part[js] != part[i]]
            # sizes alone may rule a pair out
            low, high = np.minimum(sizes[js], sizes[i]), np.maximum(sizes[js], sizes[i])
            js = js[100 * low >= self.percent * high]
            same = np.zeros(len(js), np.int64)
            for k, least in enumerate(self.least):
                if not len(js):
                    break
                at = slice(k * BATCH, (k + 1) * BATCH)
                same += (sigs[js, at] == sigs[i, at]).sum(1)
                js, same = js[same >= least], same[same >= least]
            if not len(js):
                continue
            if codes is None:
                lengths = np.array([len(t) for t in texts])
                sets = exact_sets(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(lengths)]), self.width)
                known, codes = np.unique(np.concatenate(sets), return_inverse=True)
                starts = np.cumsum(sizes) - sizes
                mark = np.zeros(len(known), bool)
                del sets
            own = codes[starts[i]:starts[i] + sizes[i]]
            mark[own] = True
            for j in js.tolist():
                if part[i] != part[j]:
                    both = int(mark[codes[starts[j]:starts[j] + sizes[j]]].sum())
                    if 100 * both >= self.percent * (int(sizes[i]) + int(sizes[j]) - both):
                        out.append((uids[i], uids[j]))
                        part[part == part[j]] = part[i]
            mark[own] = False
        return out


def _verified(members: DataFrame, width: int, percent: int, across: bool) -> DataFrame:
    """Links a, b of all buckets; a partition's rows come bucket by bucket.  across: only between first members and others."""
    def run(batches):
        verifier, key, held = Verifier(width, percent), None, {}

        def solve():
            order = sorted(held)
            rows = [held[u] for u in order]
            sigs = np.frombuffer(b"".join(r[1] for r in rows), np.uint32).reshape(len(rows), HASHES)
            first = np.array([f for _, f in order]) if across else None
            return verifier.links([u for u, _ in order], sigs, np.array([r[2] for r in rows]), [r[3] for r in rows], np.array([r[0] for r in rows]), first)

        found = []
        for b in batches:
            for bucket, first, uid, *rest in zip(*(b[c].to_pylist() for c in ("bucket", "first", "uid", "root", "sig", "n", "text"))):
                if bucket != key:
                    if len(held) > 1:
                        found += solve()
                    key, held = bucket, {}
                held[uid, first] = rest
            if len(found) > 10_000:
                yield _pairs(found)
                found = []
        if len(held) > 1:
            found += solve()
        if found:
            yield _pairs(found)

    return members.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), "a long, b long")


def _pairs(found):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])


def _task(*key) -> Column:
    return F.struct(F.xxhash64(*key).alias("bucket"), F.lit(False).alias("first"))


def _asked_of_blocks(banded: DataFrame, chosen: DataFrame, hot: bool) -> DataFrame:
    """uid, key, tasks: the buckets and blocks where a member of the chosen buckets is compared first."""
    alone = F.array(F.struct(F.col("key").alias("bucket"), F.lit(False).alias("first")))
    if not hot:
        return banded.join(chosen, "key").select("uid", "key", alone.alias("tasks"))
    picks = [F.min(F.struct(F.xxhash64("uid", F.lit(i)).alias("h"), "uid")).getField("uid") for i in range(PIVOTS)]
    pivots = banded.join(chosen.where("blocks > 1"), "key").groupBy("key").agg(F.array(*picks).alias("pivots"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: _task("key", j))
    tasks = F.when(F.col("blocks") == 1, alone).when(F.expr("array_contains(pivots, uid)"), every).otherwise(F.array(_task("key", F.expr("cast(pmod(uid, blocks) as int)"))))
    return banded.join(chosen.join(pivots, "key", "left"), "key").select("uid", "key", tasks.alias("tasks"))


def _asked_across(banded: DataFrame, chosen: DataFrame, roots: DataFrame) -> DataFrame:
    """uid, key, tasks, root: in hot buckets of several components, what is outside the largest against all."""
    placed = banded.join(chosen.where("blocks > 1"), "key").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("m"))
    split = sizes.groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("all")).where("top.m < all")
    split = split.select("key", F.col("top.root").alias("largest"), F.ceil((F.col("all") - F.col("top.m")) / BLOCK).cast("int").alias("groups"))
    j, i = F.expr("cast(pmod(uid, blocks) as int)"), F.expr("cast(pmod(uid, groups) as int)")
    as_other = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda g: F.struct(F.xxhash64("key", g, j).alias("bucket"), F.lit(False).alias("first")))
    as_first = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.xxhash64("key", i, x).alias("bucket"), F.lit(True).alias("first")))
    tasks = F.when(F.col("root") == F.col("largest"), as_other).otherwise(F.concat(as_other, as_first))
    return placed.join(split, "key").select("uid", "key", "root", tasks.alias("tasks"))


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, text_key (64 bits of the text's content).

    Linked are texts with 100 * intersection >= percent * union of their shingle sets.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"))
    prints = written(_fingerprint(rows, width), "shingles", batch_bytes=BATCH_BYTES)
    classes = written(
        prints.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct("uid", "id", "k1", "k2", "bytes")).alias("rep"), F.min("id").alias("least"), F.first("keys").alias("keys")),
        "classes")
    banded = classes.select(F.col("rep.uid").alias("uid"), F.col("rep.bytes").alias("bytes"), F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(
        F.count("*").alias("size"), F.sum("bytes").alias("bytes"), F.sum(F.xxhash64("uid").cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64("uid", F.lit(7))).alias("s2")
    ).where("size > 1")
    # bands in which the same texts meet are one bucket
    blocks = F.least(F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)), F.ceil(F.col("size") / min(LEAST, BLOCK)))
    chosen = written(buckets.groupBy("size", "bytes", "s1", "s2").agg(F.min("key").alias("key")).select("key", blocks.cast("int").alias("blocks")), "buckets")
    banded = banded.drop("bytes")

    def links(asked: DataFrame, across: bool) -> DataFrame:
        of_text = asked.groupBy("uid").agg(F.first("root").alias("root"), F.flatten(F.collect_list("tasks")).alias("tasks"))
        active = of_text.join(classes.select("rep.*"), "uid")
        same = [rows["id"].eqNullSafe(active["id"]), rows["k1"] == active["k1"], rows["k2"] == active["k2"]]
        texts = rows.join(active, same[0] & same[1] & same[2]).select(active["uid"], active["root"], rows["text"], active["tasks"])
        return written(_verified(_members(texts, width), width, percent, across), "links", batch_bytes=BATCH_BYTES)

    hot = bool(chosen.where("blocks > 1").limit(1).count())
    found = links(_asked_of_blocks(banded, chosen, hot).withColumn("root", F.col("uid")), False)
    roots = components(found)
    if hot:
        roots = components(found.unionByName(links(_asked_across(banded, chosen, roots), True)))
    ids = classes.select("h1", "h2", "n", F.col("rep.uid").alias("node"), "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = written(ids.select("h1", "h2", "n", "root", "least"), "roots")
    named = ids.join(ids.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("h1", "h2", "n", "component_id")
    out = prints.where("n > 0").join(named, ["h1", "h2", "n"]).select("id", "n", "component_id", "k1")
    out = out.unionByName(prints.where("n = 0").select("id", "n", F.col("id").alias("component_id"), "k1"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("k1").alias("text_key"))


def drop_near(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are their component's smallest id."""
    kept = near_groups(docs, width, percent, id_col, text_col).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    rows = docs.select(F.col(id_col).cast("long").alias("own_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own_key"), whole)
    return rows.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_key") == F.col("kept_key")), "left_semi").select("whole.*")


def op9_minhash_bayes(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs, width=3, percent=85).drop("text_key")
