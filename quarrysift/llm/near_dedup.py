"""Operator 3, MinHash near-dedup with sequential Bayesian verification.

1. Each document's set of word shingles is hashed to 64 bits, and a MinHash signature of bands * rows values is taken.
   Documents with equal sets share one representative from here on, so a group of copies costs one row.
2. Representatives that agree in a band are in one bucket; candidates are pairs of a bucket. Each member of buckets is first
   dealt to one star only, that of the smallest member it shares most buckets with, in blocks, and compared within its block.
3. Buckets whose members are all in one group by now, or were all compared with each other, are done. What is left of the others
   is dealt by bucket, in pairs of blocks: members of different groups are compared, each pair in the first bucket that it shares.
4. A task holds two blocks at most. It compares the signatures of its banded candidates batch by batch, drops a pair as soon as
   the posterior probability that its similarity reaches the threshold falls below `miss`, and compares the survivors' sets
   exactly. Pairs that earlier links connect already are not compared; a task returns the links of a spanning forest.
5. The connected components of the links are the groups.
Links and components stay distributed throughout. What is moved is at most a row for each member and star, then for each member,
unfinished bucket and block of it; no pair is ever written but a link.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrysift.llm._common import Scratch, bounded_batches, text_of
from quarrysift.operators.skew import join_groups
from quarrysift.session import spread

CACHE_WORDS = 300_000
#: A block of a star or bucket has about so many members and shingles at most.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1_000_000
#: Up to so many ids and tasks of members these are broadcast (some 20 MB); beyond, they meet the documents in a shuffle join.
BROADCAST_IDS = 1_000_000
#: What a member takes part in: of a star (band -1) or a bucket of a band, the pair of blocks x and y, on the side of the one (0)
#: or the other (1); label is its group so far.
TASK = "struct<group:bigint,band:int,x:int,y:int,side:int,label:bigint>"


def plan_bands(threshold: float, rows: int, miss: float) -> int:
    """How many bands of so many rows miss a pair at the threshold with probability miss at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


class Shingler:
    """Distinct shingle hashes and MinHash signatures of texts; the same on every machine."""

    def __init__(self, words: int, hashes: int, seed: int = 1):
        random = np.random.default_rng(seed)
        self.words, self.known = words, {}
        self.factors = random.integers(0, 2**63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.a = random.integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = random.integers(0, 2**63, hashes, dtype=np.uint64)

    def _word(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        self.known[word] = h
        return h

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def shingles(self, text: bytes) -> np.ndarray:
        """Sorted hashes of the distinct shingles; of fewer words, of the whole sequence; none without a word."""
        words, known, new = text.lower().split(), self.known, self._word  # bytes: A-Z and ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        h = np.array([known.get(w) or new(w) for w in words], np.uint64)
        k = min(self.words, len(h))
        total = h[: len(h) - k + 1] * self.factors[0]
        for i in range(1, k):
            total = total + h[i : len(h) - k + 1 + i] * self.factors[i]
        return np.unique(self._mixed(total + np.uint64(k)))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 256):
            np.minimum(low, (shingles[i : i + 256, None] * self.a + self.b).min(axis=0), out=low)
        return (low >> np.uint64(32)).astype(np.uint32)

    def bands(self, signature: np.ndarray, rows: int) -> np.ndarray:
        """A 64-bit key for each band of so many values, different from band to band."""
        values = signature.reshape(-1, rows).astype(np.uint64)
        total = (self._mixed(values + self.b[:rows]) * self.a[:rows]).sum(axis=1, dtype=np.uint64)
        return self._mixed(total + np.arange(len(total), dtype=np.uint64) * self.a[0]).view(np.int64)


class Verifier:
    """Which counts of equal signature values let a pair live on, by the Beta posterior of its similarity under a flat prior."""

    def __init__(self, threshold_pct: int, hashes: int, batch: int, miss: float):
        self.threshold_pct = threshold_pct
        self.checks = [(n, self._least(n, threshold_pct / 100, miss)) for n in range(batch, hashes + 1, batch)]

    @staticmethod
    def _least(n: int, threshold: float, miss: float) -> int:
        """The least m of n equal values with P(similarity >= threshold | m of n) >= miss. P is a binomial sum: Beta(m + 1, n - m + 1)."""
        below = 0.0  # P(Beta >= t) = P(Binomial(n + 1, t) <= m)
        for m in range(n + 1):
            below += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
            if below >= miss:
                return m
        return n

    def links(self, ids: list, labels: list, sigs: np.ndarray, sets: list[np.ndarray], rows: int, split: int | None, band: int = -1) -> tuple[list[tuple], int]:
        """Links of a spanning forest of the similar pairs, and how many signatures were compared.

        With split, of pairs between the first split members and the rest. Members of one label are connected already. With a
        band, of pairs whose first common band it is.
        """
        n, out, compared = len(ids), [], 0
        parent = {label: label for label in labels}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sizes, own = np.array([len(s) for s in sets]), np.array(labels)
        bands = sigs[:, : sigs.shape[1] // rows * rows].reshape(n, -1, rows)
        for i in range(n if split is None else split):
            others = np.arange(i + 1, n) if split is None else np.arange(split, n)
            low, high = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
            others = others[(own[others] != own[i]) & (100 * low >= self.threshold_pct * high)]  # sets of sizes further apart can't be similar enough
            if len(others):
                shared = (bands[others] == bands[i]).all(axis=2)
                others = others[shared.any(axis=1) if band < 0 else shared[:, band] & ~shared[:, :band].any(axis=1)]
            compared += len(others)
            done, equal = 0, np.zeros(len(others), np.int64)
            for upto, least in self.checks:
                if not len(others):
                    break
                equal = equal + (sigs[others, done:upto] == sigs[i, done:upto]).sum(axis=1)
                live = equal >= least
                others, equal, done = others[live], equal[live], upto
            for j in others[np.argsort(-equal, kind="stable")]:
                a, b = root(labels[i]), root(labels[j])
                if a != b:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= self.threshold_pct * (len(sets[i]) + len(sets[j]) - both):
                        parent[max(a, b)] = min(a, b)
                        out.append((ids[i], ids[j]))
        return out, compared


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node reachable.

    Alternating large-star and small-star steps, each cut by a written table; only a count and a hash sum reach the driver.
    Least neighbours are written before they are joined: a join of two plain shuffles is one whose hot keys Spark can split.
    """
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    state = None
    for i in itertools.count(1):
        # large-star: the larger neighbours of a node go to the smallest one of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-{i}-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: the smaller neighbours of a node, and itself, go to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # the larger node of an edge, which few edges share by now
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        step = scratch.keep(small, f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}", f"{name}-{i}-least")
        edges = step
        now = tuple(step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_dedup(docs: DataFrame, words: int = 5, threshold_pct: int = 80, rows: int | None = None, miss: float = 1e-6, batch: int = 28, id_col: str = "doc_id", text_col: str = "text", owner: Scratch | None = None) -> DataFrame:
    """Groups of documents whose sets of shingles are linked by 100 * intersection >= threshold_pct * union.

    A shingle is `words` words (runs of non-spaces, A-Z in lower case); a text of fewer words is one shingle, a text without
    words (null, empty) has none and is linked with nothing. miss bounds the probability that a pair at the threshold shares
    no band, and of its being dropped by the posterior bound; links are confirmed on the full sets, whose shingles are 64-bit
    hashes. Ids are integers; rows that repeat an id are one document, so their texts are linked. A row without id is in the
    group of an equal set, where one has an id, else in none (component_id null, kept). Returns id_col, n_shingles,
    component_id (the smallest id reachable), kept (id is component_id). Extra columns are ignored; an empty table gives no
    rows; a very long text is one set in one task.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = rows or (7 if threshold_pct >= 85 else 6)
    bands = plan_bands(threshold_pct / 100, rows, miss)
    hashes = bands * rows
    scratch = Scratch(spark, owner)
    source = spread(docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("text")))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words, hashes)
        for b in batches:
            n, prints, out = [], [], []
            for text in b.column(1).to_pylist():
                s = shingler.shingles(text)
                n.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out.append(shingler.bands(shingler.signature(s), rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=["id", "n", "print", "bands"])

    signed = scratch.keep(source.mapInArrow(sign, "id long, n long, print binary, bands array<long>"), "signed")
    # Equal sets: one representative, the smallest id. Its bands are the same as theirs.
    least = scratch.keep(signed.where("print is not null").groupBy("print").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "least")
    rep = join_groups(signed.where("print is not null").select("id", "n", "print"), least, "print", "copies").select("id", "n", "rep")
    rep = scratch.keep(rep.unionByName(signed.where("print is null").select("id", "n", F.lit(None).cast("long").alias("rep"))), "reps")
    # Buckets of two members or more: bucket, band, the member b, the smallest member a. Keys of different bands differ.
    first = signed.where("print is not null").join(least.select("print", F.col("rep").alias("id")), ["print", "id"]).dropDuplicates(["print", "id"])
    buckets = first.select(F.col("id").alias("b"), "n", F.posexplode("bands").alias("band", "bucket"))
    centre = scratch.keep(buckets.groupBy("bucket").agg(F.min("b").alias("a"), F.max("b").alias("z")).where("a <> z").select("bucket", "a"), "centres")
    shared = scratch.keep(buckets.join(centre, "bucket").select("bucket", "band", "a", "b", "n"), "shared")
    # Texts that repeat an id belong together whatever they say.
    several = rep.groupBy("id").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first <> last").select("id", "first")
    same = rep.join(several, "id").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    scratch.drop("signed", "least", "centres")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words, hashes)
        for b in batches:
            sets = [shingler.shingles(t) for t in b.column(1).to_pylist()]
            sigs = pa.array([shingler.signature(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), sigs, pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "tasks", "sig", "set"])

    verifier = Verifier(threshold_pct, hashes, batch, miss)

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        side, ids = t["side"].to_numpy(), t["id"].to_numpy()
        order = np.lexsort((ids, side))
        t, side = t.take(pa.array(order)), side[order]
        ids, within = t["id"].to_pylist(), key[2].as_py() == key[3].as_py()
        sigs = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(len(ids), hashes)
        held = [np.frombuffer(s, np.uint64) for s in t["set"].to_pylist()]
        found, compared = verifier.links(ids, t["label"].to_pylist(), sigs, held, rows, None if within else int(np.searchsorted(side, 1)), key[1].as_py())
        report = [(None, None, compared, len(ids)), *[(x, y, 0, 0) for x, y in found]]
        return pa.table({name: pa.array(list(c), pa.int64()) for name, c in zip(("a", "b", "compared", "held"), zip(*report))})

    def linked(tasks: DataFrame, name: str) -> DataFrame:
        """Links found by tasks (id, tasks: array of TASK): of each (group, band, x, y) the two sides are compared with each other,
        or all members where x = y. A row without a link counts what the task held and compared."""
        tasks = scratch.keep(tasks, f"tasks-{name}")
        total = tasks.agg(F.coalesce(F.sum(F.size("tasks") + 2), F.lit(0))).first()[0]
        texts = source.join(F.broadcast(tasks) if total <= BROADCAST_IDS else tasks, "id").select("id", "text", "tasks")
        sets = texts.mapInArrow(again, f"id long, tasks array<{TASK}>, sig binary, set binary")
        dealt = sets.select("id", "sig", "set", F.explode("tasks").alias("t")).select("id", "sig", "set", "t.*")
        return scratch.keep(dealt.groupBy("group", "band", "x", "y").applyInArrow(compare, "a long, b long, compared long, held long"), f"links-{name}")

    size = lambda n: F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum(n) / BLOCK_SHINGLES)).cast("int")
    task = lambda group, band, x, y, side, label: F.struct(group.alias("group"), band.cast("int").alias("band"), x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(side).cast("int").alias("side"), label.alias("label"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    dealt_to = lambda n: F.pmod(F.xxhash64("b"), n).cast("int")

    # Stars: each member goes to the smallest member it shares most buckets with; the centre to all blocks of its star.
    chosen = shared.where("a <> b").groupBy("b", "a").agg(F.count(F.lit(1)).alias("times"), F.max("n").alias("n"))
    chosen = chosen.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a"), F.max("n").alias("n"))
    stars = scratch.keep(chosen, "chosen")
    blocks = scratch.keep(stars.groupBy("a").agg(size("n").alias("blocks")), "blocks")
    member = scratch.keep(stars.join(blocks, "a").select("b", "a", dealt_to(F.col("blocks")).alias("block")), "members")
    own = member.select(F.col("b").alias("id"), task(F.col("a"), F.lit(-1), F.col("block"), F.col("block"), 0, F.col("b")).alias("t"))
    centres = blocks.select(F.col("a").alias("id"), F.explode(upto(F.col("blocks"))).alias("i"), "a").select("id", task(F.col("a"), F.lit(-1), F.col("i"), F.col("i"), 0, F.col("a")).alias("t"))
    each = lambda tasks: tasks.groupBy("id").agg(F.collect_list("t").alias("tasks"))
    links = linked(each(own.unionByName(centres)), "stars")

    # Buckets that may still hold a link: members of several groups, not all of which were in one block of one star.
    so_far = connected_components(links.where("a IS NOT NULL").select("a", "b"), scratch, "so-far").select(F.col("node").alias("b"), F.col("component").alias("label"))
    star = F.when(F.col("t_a").isNotNull(), F.struct("t_a", "t_block"))
    placed = shared.join(member.select("b", F.col("a").alias("t_a"), F.col("block").alias("t_block")), "b", "left").join(so_far, "b", "left").withColumns({"label": F.coalesce("label", "b"), "star": star})
    placed = scratch.keep(placed, "placed")
    rest, head = F.col("a") != F.col("b"), F.col("a") == F.col("b")
    state = placed.groupBy("bucket").agg(
        F.min("label").alias("l0"), F.max("label").alias("l1"), F.min(F.when(rest, F.col("star"))).alias("s0"), F.max(F.when(rest, F.col("star"))).alias("s1"),
        F.max(F.when(head, F.col("star"))).alias("mine"), F.min("a").alias("head"), size("n").alias("parts"),
    )
    together = (F.col("s0") == F.col("s1")) & ((F.col("s0.t_a") == F.col("head")) | F.col("s0").eqNullSafe(F.col("mine")))
    left = scratch.keep(state.where((F.col("l0") != F.col("l1")) & ~together).select("bucket", "parts"), "left")
    open_ = placed.join(left, "bucket").select("bucket", "band", F.col("b").alias("id"), "label", "parts", dealt_to(F.col("parts")).alias("own"))
    # Pairs of blocks (x <= y): a member is on the one side of those with later blocks, on the other of those with earlier ones.
    pair = lambda o: F.struct(F.least(F.col("own"), o).alias("x"), F.greatest(F.col("own"), o).alias("y"), (F.col("own") > o).cast("int").alias("side"))
    dealt = open_.select("id", "bucket", "band", "label", F.explode(F.transform(upto(F.col("parts")), pair)).alias("p"))
    rest_tasks = dealt.select("id", F.struct(F.col("bucket").alias("group"), F.col("band").cast("int").alias("band"), "p.x", "p.y", "p.side", "label").alias("t"))
    links = links.unionByName(linked(each(rest_tasks), "rest")).where("a IS NOT NULL").select("a", "b")
    groups = connected_components(scratch.keep(links.unionByName(same), "links"), scratch, "groups").withColumnRenamed("node", "rep")
    out = rep.join(scratch.keep(groups, "components"), "rep", "left")
    scratch.drop("shared", "chosen", "blocks", "members", "tasks-stars", "placed", "left", "tasks-rest")
    group = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), group.alias("component_id"), F.col("id").eqNullSafe(group).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """docs with one document, the smallest id, of each group of near copies; columns as they were. Rows without id stay."""
    drop = near_dedup(docs, id_col=id_col, **params).where("NOT kept").select(F.col(id_col).cast("long").alias("__drop")).distinct()
    return docs.select(F.col(id_col).cast("long").alias("__drop"), F.struct("*").alias("row")).join(drop, "__drop", "left_anti").select("row.*")
