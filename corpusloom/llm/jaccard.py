"""Operator 6: exact Jaccard join of word shingles in the metric space of Jaccard distances.

A document's set holds the distinct hashes of its five-word shingles. Distance is 1 - Jaccard, a metric. Two
documents link at distance EPSILON = 1/4 or less.

1. Equal sets are one entity from here on.
2. Pivots: in one total order of all shingles, a set and a smaller one that it links to share k at least of the larger one's first n - ceil(3n/4) + k
   and the smaller one's first n - ceil(6n/7) + k shingles: the smaller set's prefix is the short one. Shingles that many documents hold, or that common words make by chance, are last in the order
   (hashed counts over all documents decide; whatever the counts, the join stays exact). The smallest set with a shingle in its short prefix is a pivot, and known to all
   that hold the shingle in a prefix; a shingle that is in no short prefix, as those of a template, joins nobody. So linked entities know a common pivot, and the number of pivots
   follows the number of neighbourhoods, where pivots drawn at random would be at distance 1 from nearly all documents.
3. Cells: every entity is at home in the cell of the nearest pivot that it knows (with which it shares the most leading shingles), and a boundary
   replica in the cells of the others. It meets the pivot of its home at its exact distance; within EPSILON it is of its class.
4. Windows: by the triangle inequality, a link inside a cell needs distances to the pivot that differ by EPSILON at most (and
   sizes that fit). Entities with nobody of another class in their window leave the cell; a replica, whose distance isn't known, is in all windows.
   What two sets can have in common at most is known from short profiles (counts of their shingles in buckets); texts are read only where that allows a link.
5. Recursion: what is left of a cell elects new pivots among its members outside its largest class; all members meet them
   and pivots leave, having met everybody. If not all of these can be pivots at once, few are, and the cell is divided into the Voronoi cells of these
   (all distances are known now), with replicas at 2 EPSILON from a boundary, where that makes smaller cells; and so on. A cell that can't be divided, since all its
   members are about as far from each other, goes on whole, and profiles say which members meet the pivots.

A cell is worked on in groups of at most GROUP members with a copy of its pivots, so no cell is in one task, and no task holds
more than the sets of one group's pivots. Of the links found in a group only those that join classes go on: at most one for each member.
Classes are connected components, found by min-label rounds with shortcuts; nothing of the documents goes through the driver.

Defined cases: null or empty texts, and texts without words, have the empty set, link with nothing and are their own
class (repeated rows of one doc_id share theirs); fewer than five words give one shingle; a null doc_id sorts
below all others and has a null class; equal texts are one class; very long texts and words are taken whole; other columns, whatever their
names, don't take part and come back from ``keep_one`` as they were; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm import textkit as tk
from corpusloom.llm.sketches import chunk_rows, merge_chunks
from corpusloom.storage import discard, materialize, small_enough

NEED, OF = 75, 100
EPSILON = 1 - NEED / OF
CELLS = 1 << 21
WORD_CELLS = 1 << 18
CHUNKS = 64
#: Ids are broadcast up to this many rows (8 bytes each); beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Linked sets must share one more leading shingle for each so many shingles.
SHARED_OF = 48
#: Members of a cell that meet its pivots in one group; pivots of a cell in one round, and the shingles these may hold together; pivots that divide a cell.
GROUP, PIVOTS, PIVOT_SHINGLES, DIVIDING = 256, 1024, 1 << 21, 16


def _entity(shingles: np.ndarray) -> int:
    """64-bit name of a set: a sum over its members, then mixed with its size."""
    total = (int(shingles.sum(dtype=np.uint64)) + len(shingles) * 0x9E3779B97F4A7C15) % 2**64
    return int(tk.mix(np.array([total], np.uint64)).view(np.int64)[0])


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return tk.shingle_sets(tk.Words(batch.column("text")))


def _word_cells(words: tk.Words) -> np.ndarray:
    return (tk.mix(words.hashes()) & np.uint64(WORD_CELLS - 1)).astype(np.int64)


def name_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, entity (null for the empty set) of every row, and each task's counts of words and shingles.

    One pass: the counts follow a task's rows as chunks (chunk, part; elsewhere null).
    """
    fields = ["doc_id", "n_shingles", "entity", "chunk", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(CELLS + WORD_CELLS, np.uint32)
        for batch in tk.slices(batches):
            words = tk.Words(batch.column("text"))
            h, rows = tk.shingle_hashes(words)
            np.add.at(own, (h & np.uint64(CELLS - 1)).astype(np.int64), np.uint32(1))
            np.add.at(own, CELLS + _word_cells(words), np.uint32(1))
            at = np.searchsorted(rows, np.arange(words.rows + 1))
            sets = [np.unique(h[at[r] : at[r + 1]]) for r in range(words.rows)]
            nulls = pa.nulls(len(sets))
            arrays = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_entity(s) if len(s) else None for s in sets], pa.int64()), nulls.cast(pa.int32()), nulls.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, fields)
        for chunk, part in chunk_rows(own, CHUNKS):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), chunk, part], fields)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.transform(tk.arrow, run, "doc_id long, n_shingles long, entity long, chunk int, part binary")


@dataclass
class Order:
    """The order of all shingles, of fixed size: by level, then by hash. A high level means that many documents hold the shingle.

    ``seen``: by cell of shingles, how far its count is above chance, in logarithmic steps. ``words``: by cell of
    words, the log of its share. A shingle's words tell how often it comes about by chance in ``shingles`` windows.
    """

    seen: np.ndarray
    words: np.ndarray
    shingles: int

    @classmethod
    def of(cls, counts: np.ndarray) -> Order:
        shingles, words = counts[:CELLS].astype(np.float64), counts[CELLS:].astype(np.float64)
        above = (shingles - shingles.mean()) / np.sqrt(shingles.mean() + 1)
        seen = np.where(above > 1, np.minimum(8 * np.log2(1 + np.maximum(above, 0)), 255), 0).astype(np.uint8)
        return cls(seen, np.log2(np.maximum(words, 1) / max(words.sum(), 1)).astype(np.float32), int(shingles.sum()))

    def levels(self, shingles: np.ndarray, log_shares: np.ndarray) -> np.ndarray:
        chance = 4 * (log_shares + np.log2(max(self.shingles, 1)) + 10)
        return np.maximum(self.seen[(shingles & np.uint64(CELLS - 1)).astype(np.int64)], np.clip(chance, 0, 255).astype(np.uint8))


def leading_shingles(docs: DataFrame, sent) -> DataFrame:
    """shingle, entity, size, short: the leading n - ceil(3n/4) + 1 + n // SHARED_OF shingles of each set in the broadcast order; ``short``: it is among the first n - ceil(6n/7) + 1 + n // SHARED_OF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, seen = sent.value, set()
        for batch in tk.slices(batches):
            words = tk.Words(batch.column("text"))
            h, rows, log_shares = tk.shingle_hashes(words, weights=o.words[_word_cells(words)])
            level = o.levels(h, log_shares)
            at = np.searchsorted(rows, np.arange(words.rows + 1))
            found, names, sizes, short = [], [], [], []
            for r in np.flatnonzero(at[1:] > at[:-1]):
                s, first = np.unique(h[at[r] : at[r + 1]], return_index=True)
                name, n = _entity(s), len(s)
                if name in seen:  # copies in one task go on once
                    continue
                if len(seen) < 1_000_000:
                    seen.add(name)
                keep, first_few = (n - -(-part * n // of) + 1 + n // SHARED_OF for part, of in ((NEED, OF), (2 * NEED, OF + NEED)))
                found.append(s[np.argsort(level[at[r] : at[r + 1]][first], kind="stable")[:keep]])
                short.append(np.arange(keep) < first_few)
                names.append(np.full(keep, name))
                sizes.append(np.full(keep, n))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(names)), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(short))], ["shingle", "entity", "size", "short"])

    return docs.select("text").transform(tk.arrow, run, "shingle long, entity long, size int, short boolean")


def _known_pivots(rows: DataFrame) -> DataFrame:
    """Written: cell (its pivot), entity, size, distance (0 for the pivot itself, else null), home: every entity in the cells of the pivots it knows.

    An entity's home is the cell of the pivot with which it shares the most leading shingles; in the others it is a boundary replica.

    A shingle's rows are read in order, so that they aren't held in memory; its first entity, the smallest set that has it in its short prefix, is the pivot.
    Sets smaller than that with the shingle in their long prefixes alone, and shingles in no short prefix, are left out. Linked sets of n and m shingles
    share 1 + min(n, m) // SHARED_OF of their leading ones at least, and the smaller one has 3/4 of the other's size at least: sets
    that share fewer shingles with all others in whose cells somebody is of a fitting size link with nothing.
    """
    order = Window.partitionBy("shingle").orderBy(F.desc("short"), "size", "entity")
    rows = rows.withColumn("p", F.first(F.struct("entity", "size", "short")).over(order)).withColumn("before", F.lag("entity").over(order)).withColumn("next", F.lead("entity").over(order))
    own, is_pivot = F.col("entity"), F.col("entity") == F.col("p.entity")
    once = rows.where(F.col("p.short") & (F.col("size") >= F.col("p.size"))).where(F.when(is_pivot, F.col("next") != own).otherwise(F.col("before") != own))
    known = once.groupBy(F.col("p.entity").alias("cell"), "entity", "size").agg(F.count(F.lit(1)).alias("n"))
    whole = held = materialize(known, "known-pivots")
    cells = whole.select("cell", "entity", "size", "n", F.lit(None).cast("double").alias("distance"))
    unlabelled = cells.select("entity", F.col("entity").alias("class")).limit(0)
    for _ in range(3):  # what leaves makes others leave
        windowed = _in_windows(cells, unlabelled, "n")
        discard(held)
        least = 1 + F.floor(F.ceil(F.first("size") * NEED / OF) / SHARED_OF)
        enough = windowed.groupBy("entity").agg(F.sum("n").alias("n"), least.alias("least")).where("n >= least").select("entity")
        cells = held = materialize(windowed.join(enough, "entity", "left_semi"), "known-pivots")
        discard(windowed)
    # the home's pivot must be one that may link; a pivot that has left only names its cell
    may = cells.where(F.col("cell") == F.col("entity")).select("cell")
    homes = cells.where(F.col("entity") != F.col("cell")).join(may, "cell", "left_semi").groupBy("entity").agg(F.max_by("cell", F.struct("n", "cell")).alias("home"))
    cells = cells.join(homes, "entity", "left")
    out = materialize(cells.select("cell", "entity", "size", F.when(F.col("entity") == F.col("cell"), 0.0).alias("distance"), F.coalesce(F.col("home") == F.col("cell"), F.lit(False)).alias("home")), "cells")
    discard(held)
    return out


def _texts(docs: DataFrame, named: DataFrame, wanted: DataFrame) -> DataFrame:
    """entity, text of the wanted entities: the text of the smallest doc_id that has it."""
    firsts = named.where(F.col("entity").isNotNull()).groupBy("entity").agg(F.min("doc_id").alias("doc_id"))
    firsts = materialize(firsts.join(wanted, "entity", "left_semi"), "wanted")
    ids = firsts.select(F.col("doc_id").alias("id")).distinct()
    ids = F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(ids, rows.doc_id.eqNullSafe(ids.id), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches):
            names = [_entity(s) if len(s) else None for s in _sets(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), batch.column("text").cast(pa.string())], ["entity", "text"])

    # the first document of an entity has it; a repeated id may bring in another text, whose entity isn't wanted
    return _only(rows.transform(tk.arrow, run, "entity long, text string"), wanted).dropDuplicates(["entity"])


def _only(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted entities; few ids are sent to the values, so that the other values aren't shuffled."""
    return values.join(F.broadcast(wanted) if small_enough(wanted, BROADCAST_IDS) else wanted, "entity", "left_semi")


class _Pivots:
    """The pivots of one group and an index of their shingles; which classes the group has joined so far."""

    def __init__(self):
        self.names: list[int] = []
        self.classes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.keys: np.ndarray | None = None
        self.up: dict[int, int] = {}

    def add(self, name: int, klass: int, shingles: np.ndarray) -> None:
        self.names.append(name)
        self.classes.append(klass)
        self.sets.append(shingles)
        self.keys = None

    def meet(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(common, union) with every pivot."""
        if self.keys is None:
            self.sizes = np.array([len(s) for s in self.sets], np.int64)
            keys, owners = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.sizes)
            order = np.argsort(keys, kind="stable")
            self.keys, self.owners = keys[order], owners[order]
        low, high = np.searchsorted(self.keys, shingles, "left"), np.searchsorted(self.keys, shingles, "right")
        n = high - low
        places = np.repeat(high - np.cumsum(n), n) + np.arange(int(n.sum()))
        common = np.bincount(self.owners[places], minlength=len(self.sets))
        return common, len(shingles) + self.sizes - common

    def root(self, klass: int) -> int:
        while self.up.get(klass, klass) != klass:
            self.up[klass] = self.up.get(self.up[klass], self.up[klass])
            klass = self.up[klass]
        return klass

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


_MET = "cell long, entity long, size int, distance double, links array<struct<a:long,b:long>>, near array<struct<pivot:long,distance:double>>"
_MET_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.struct([("pivot", pa.int64()), ("distance", pa.float64())]))]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of groups (cell, part), pivots first: each member's distances to all pivots of its group."""
    held, pivots = None, _Pivots()
    for batch in tk.slices(batches, most=1 << 18):
        sets = list(_sets(batch))
        cells, parts, members, entities, classes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part", "member", "entity", "class"))
        out = []
        for r, s in enumerate(sets):
            if (cells[r], parts[r]) != held:
                held, pivots = (cells[r], parts[r]), _Pivots()
            if not members[r]:
                pivots.add(int(entities[r]), int(classes[r]), s)
                continue
            if not pivots.names:
                continue
            common, union = pivots.meet(s)
            links = [{"a": int(classes[r]), "b": pivots.classes[k]} for k in np.flatnonzero(100 * common >= NEED * union) if pivots.join(int(classes[r]), pivots.classes[k])]
            distance = 1 - common / union
            least = float(distance.min())
            near = np.flatnonzero(distance <= least + 2 * EPSILON + 1e-9)
            near = [{"pivot": pivots.names[k], "distance": float(distance[k])} for k in near] if 1 < len(distance) <= DIVIDING else None
            out.append((int(cells[r]), int(entities[r]), len(s), least, links, near))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), _MET_TYPES, strict=True)], ["cell", "entity", "size", "distance", "links", "near"])


def _dealt(members: DataFrame, pivots: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """The members (cell, entity, class, size) of each cell in groups (cell, part) by a hash, each after a copy of the cell's pivots, with a value for each entity."""
    columns = ["entity", "class", "size"]
    parts = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    dealt = members.join(parts, "cell").select("cell", F.pmod(F.xxhash64("entity"), F.col("parts")).alias("part"), F.lit(True).alias("member"), *columns)
    copies = pivots.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"), *columns)
    rows = dealt.unionByName(copies).join(values, "entity").select("cell", "part", "member", *columns, value)
    return rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "member", "entity")


def meet(members: DataFrame, pivots: DataFrame, texts: DataFrame) -> DataFrame:
    """Every member with all pivots of its cell, at exact distances, see ``_MET``."""
    wanted = members.select("entity").union(pivots.select("entity")).distinct()
    return _dealt(members, pivots, _only(texts, wanted), "text").transform(tk.arrow, _meet, _MET)


def _profiles(texts: DataFrame) -> DataFrame:
    """entity, profile: how many of its shingles fall in each of 2^k buckets, one byte each; empty if a byte is too small.

    Two sets have at most the sum of the buckets' minima in common. There are about as many buckets as shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches):
            out = []
            for s in _sets(batch):
                size = 1 << max(4, len(s).bit_length() - 1)
                counts = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size)
                out.append(counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b"")
            yield pa.RecordBatch.from_arrays([batch.column("entity"), pa.array(out, pa.binary())], ["entity", "profile"])

    return texts.transform(tk.arrow, run, "entity long, profile binary")


def _folded(counts: np.ndarray, size: int) -> np.ndarray:
    """Profiles (one a row) with fewer buckets."""
    return counts.reshape(len(counts), -1, size).sum(1, dtype=np.int32)


class _Profiles:
    """The pivots of one group by their profiles, and which of them may link to a member."""

    def __init__(self):
        self.rows: list[tuple[int, int, int, np.ndarray]] = []
        self.by_size: dict | None = None

    def add(self, name: int, klass: int, size: int, profile: np.ndarray) -> None:
        self.rows.append((name, klass, size, profile))

    def may_link(self, klass: int, size: int, profile: np.ndarray) -> bool:
        if self.by_size is None:
            self.classes, self.sizes = np.array([r[1] for r in self.rows]), np.array([r[2] for r in self.rows])
            lengths = np.array([len(r[3]) for r in self.rows])
            self.by_size = {n: (np.flatnonzero(lengths == n), {n: np.array([r[3] for r in self.rows if len(r[3]) == n]).reshape(-1, n) if n else None}) for n in set(lengths.tolist())}
            self.alive = np.zeros(len(self.rows), bool)
        fits = (self.classes != klass) & (100 * np.minimum(self.sizes, size) >= NEED * np.maximum(self.sizes, size))
        before = self.alive.copy()
        for n, (rows, folds) in self.by_size.items():
            if not fits[rows].any():
                continue
            least = min(n, len(profile))
            if least:
                if least not in folds:
                    folds[least] = _folded(folds[n], least)
                own = _folded(profile[None, :], least)
                common = np.minimum(folds[least], own).sum(1, dtype=np.int64)
                fits[rows] &= (OF + NEED) * common >= NEED * (self.sizes[rows] + size)
        self.alive = before | fits
        return bool(fits.any())

    def names(self) -> list[int]:
        return [] if self.by_size is None else [self.rows[k][0] for k in np.flatnonzero(self.alive)]


def _alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of groups (cell, part), pivots first: the members that may link to a pivot of another class, and those pivots."""
    held, pivots = None, _Profiles()
    for batch in tk.slices(batches, "profile"):
        cells, parts, members, entities, classes, sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part", "member", "entity", "class", "size"))
        profiles = [np.frombuffer(x, np.uint8) for x in batch.column("profile").to_pylist()]
        out = []
        for r, profile in enumerate(profiles):
            if (cells[r], parts[r]) != held:
                out += [(held[0], x) for x in pivots.names()]
                held, pivots = (int(cells[r]), int(parts[r])), _Profiles()
            if not members[r]:
                pivots.add(int(entities[r]), int(classes[r]), int(sizes[r]), profile)
            elif pivots.may_link(int(classes[r]), int(sizes[r]), profile):
                out.append((held[0], int(entities[r])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["cell", "entity"])
    if pivots.names():
        yield pa.RecordBatch.from_arrays([pa.array([held[0]] * len(pivots.names()), pa.int64()), pa.array(pivots.names(), pa.int64())], ["cell", "entity"])


def alive(members: DataFrame, pivots: DataFrame, profiles: DataFrame) -> DataFrame:
    """cell, entity of the members and pivots that their profiles let link to somebody of another class; never misses a link."""
    return materialize(_dealt(members, pivots, profiles, "profile").transform(tk.arrow, _alive, "cell long, entity long").distinct(), "alive")


def components(edges: DataFrame) -> DataFrame:
    """entity, class (smallest entity reachable) of every entity on an edge (a, b): min labels with shortcuts."""
    both = edges.select(F.col("a").alias("entity"), F.col("b").alias("other")).union(edges.select("b", "a"))
    both = materialize(both.distinct(), "links")
    labels = materialize(both.groupBy("entity").agg(F.least(F.col("entity"), F.min("other")).alias("class")), "classes")
    while True:
        near = both.join(labels.select(F.col("entity").alias("other"), "class"), "other").groupBy("entity").agg(F.min("class").alias("near"))
        step = labels.join(near, "entity").select("entity", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        # a label's own label: halves the way that is left
        short = labels.select(F.col("entity").alias("class"), F.col("class").alias("further"))
        step = step.join(short, "class", "left").select("entity", "old", F.least(F.col("class"), F.coalesce("further", "class")).alias("class"))
        step = materialize(step, "classes")
        changed = step.where(F.col("old") != F.col("class")).limit(1).count()
        discard(labels)
        if not changed:
            discard(both)
            return step.drop("old")
        labels = step


def _in_windows(cells: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """The members, with their classes of now, that have somebody of another class in their window of distance and size.

    Windows are EPSILON (of sizes: a factor 4/3) wide bins and their neighbours; a bin is known by its least and greatest class.
    Where the distance is null, the window is of sizes alone.
    """
    own = cells.drop("class").join(labels, "entity", "left").withColumn("class", F.coalesce("class", "entity"))
    own = own.withColumn("d", F.coalesce(F.floor((F.col("distance") + 1e-9) / EPSILON), F.lit(-9))).withColumn("s", F.floor(F.log("size") / F.log(F.lit(OF / NEED)) + 1e-9))
    bins = own.groupBy("cell", "d", "s").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    around = F.explode(F.expr("flatten(transform(if(d < 0, array(-9L, 0L, 1L, 2L, 3L, 4L), array(-9L, d - 1, d, d + 1)), x -> transform(sequence(s - 1, s + 1), y -> struct(x AS d, y AS s))))"))
    wide = bins.select("cell", around.alias("at"), "low", "high").groupBy("cell", F.col("at.d").alias("d"), F.col("at.s").alias("s")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    open_ = own.join(wide, ["cell", "d", "s"]).where((F.col("low") != F.col("class")) | (F.col("high") != F.col("class")))
    return materialize(open_.select("cell", "entity", "size", "distance", "class", *more), "open-cells")


def _elect(cells: DataFrame, turn: int) -> DataFrame:
    """The members with ``pivot`` (is it one in this turn), ``more`` (the cell has more to elect) and ``divide`` (this turn's pivots are to divide it).

    Only members outside a cell's largest class need to meet the others; if there are more than seats, some are drawn. A cell that by chance draws none goes on as it is.
    """
    by_class = cells.groupBy("cell", "class").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("flat").alias("flat"))
    seats = F.greatest(F.lit(DIVIDING // 2), F.least(F.lit(PIVOTS), F.floor(F.lit(PIVOT_SHINGLES) / F.max("size"))))
    by_cell = by_class.groupBy("cell").agg((F.sum("n") - F.max("n")).alias("outside"), F.max_by("class", F.struct("n", "class")).alias("main"), F.max("flat").alias("is_flat"), seats.alias("most"))
    more = F.col("outside") > F.col("most")
    by_cell = by_cell.select("cell", "outside", "main", more.alias("more"), (more & ~F.col("is_flat")).alias("divide"), F.when(more & ~F.col("is_flat"), DIVIDING // 2).otherwise(F.col("most")).alias("seats"))
    drawn = F.pmod(F.xxhash64("entity", F.lit(turn)), F.lit(1 << 30)) < (F.col("seats") / F.col("outside")) * (1 << 30)
    return cells.join(by_cell, "cell").select(*cells.columns, ((F.col("class") != F.col("main")) & drawn).alias("pivot"), "more", "divide")


def _divided(elected: DataFrame, met: DataFrame) -> DataFrame:
    """What goes on of the cells that have more to elect, without this turn's pivots: in Voronoi cells where these are smaller, else whole and ``flat``."""
    left = elected.where("more AND NOT pivot").select("cell", "entity", "size", "distance", "flat", "divide")
    near = met.where(F.col("near").isNotNull()).select("cell", "entity", "near").join(left.where("divide").select("cell", "entity"), ["cell", "entity"], "left_semi")
    asked = left.where("divide").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    few = near.groupBy("cell").agg(F.sum(F.size("near")).alias("copies"), F.count(F.lit(1)).alias("known")).join(asked, "cell")
    few = few.where((F.col("known") == F.col("n")) & (F.col("copies") <= 2 * F.col("n"))).select("cell", "n")
    replicas = near.join(few, "cell").select("cell", "entity", "n", F.explode("near").alias("at"))
    largest = replicas.groupBy("cell", "n", F.col("at.pivot").alias("pivot")).agg(F.count(F.lit(1)).alias("m")).groupBy("cell", "n").agg(F.max("m").alias("m"))
    smaller = largest.where(2 * F.col("m") <= F.col("n")).select("cell")
    new = replicas.join(smaller, "cell", "left_semi").join(left.select("cell", "entity", "size"), ["cell", "entity"])
    new = new.select(F.xxhash64("cell", "at.pivot").alias("cell"), "entity", "size", F.col("at.distance").alias("distance"), F.lit(False).alias("flat"))
    whole = left.join(smaller, "cell", "left_anti").select("cell", "entity", "size", "distance", (F.col("flat") | F.col("divide")).alias("flat"))
    return whole.unionByName(new)


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, entity of every document; entity, class of every linked entity)."""
    raw = materialize(name_sets(docs), "sets")
    named = materialize(raw.where(F.col("chunk").isNull()).select("doc_id", "n_shingles", "entity"), "named")
    counts = merge_chunks(raw.where(F.col("chunk").isNotNull()).select("chunk", "part"), CELLS + WORD_CELLS, CHUNKS)
    discard(raw)  # each task's counts are as large as the order itself
    sent = docs.sparkSession.sparkContext.broadcast(Order.of(counts))
    cells = _known_pivots(leading_shingles(docs, sent))
    sent.destroy()
    texts = materialize(_texts(docs, named, cells.select("entity").distinct()), "texts")
    profiles = materialize(_profiles(texts), "profiles")
    members = cells.where("home").select("cell", "entity", F.col("entity").alias("class"), "size")
    pivots = cells.where(F.col("cell") == F.col("entity")).select("cell", "entity", F.col("entity").alias("class"), "size")
    pivots = pivots.join(members.select("cell").distinct(), "cell", "left_semi")
    near = alive(members, pivots, profiles)
    members, pivots = (materialize(x.join(near, ["cell", "entity"], "left_semi"), "asked") for x in (members, pivots))
    met = materialize(meet(members, pivots, texts), "met")
    discard(near, members, pivots)
    edges = met.select(F.explode("links").alias("l")).select("l.a", "l.b")
    labels = components(edges)
    known = met.select("cell", "entity", F.col("distance").alias("known"))
    written, turn, held = [texts, profiles, met], 0, cells
    cells = cells.join(known, ["cell", "entity"], "left").select("cell", "entity", "size", F.coalesce("distance", "known").alias("distance"), F.lit(False).alias("flat"))
    while True:
        open_ = _in_windows(cells, labels, "flat")
        discard(held)
        if not open_.limit(1).count():
            break
        elected = materialize(_elect(open_, turn), "elected")
        discard(open_)
        # cells that are divided need all distances to their few new pivots; in the others, profiles say who meets
        rest = elected.where("NOT divide")
        near = alive(rest, rest.where("pivot"), profiles)
        asked = materialize(rest.join(near, ["cell", "entity"], "left_semi").unionByName(elected.where("divide")), "asked")
        met = materialize(meet(asked, asked.where("pivot"), texts), "met")
        found = met.select(F.explode("links").alias("l")).select("l.a", "l.b")
        if found.limit(1).count():
            edges = edges.union(found)
            labels = components(edges)
        written.append(met)
        if not elected.where("more").limit(1).count():
            break
        cells = held = materialize(_divided(elected, met), "cells")
        turn += 1
        discard(near, asked, elected)
    discard(*written)
    return named, labels


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    named, labels = link(docs)
    firsts = named.where(F.col("entity").isNotNull()).groupBy("entity").agg(F.min("doc_id").alias("first"))
    firsts = firsts.join(labels, "entity", "left").select("entity", "first", F.coalesce("class", "entity").alias("class"))
    best = firsts.groupBy("class").agg(F.min("first").alias("component_id"))
    of = materialize(firsts.join(best, "class").select("entity", "component_id"), "component-ids")
    return named.join(of, "entity", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among ``ids`` (one column doc_id)."""
    return docs.join(F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids, "doc_id", "left_anti").select(*docs.columns)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class: that with the smallest doc_id, all columns kept.

    Rows that repeat a doc_id are one document: a single row of them stays. Rows with a null doc_id stay.
    """
    found = materialize(judged(docs), "near-duplicates")
    out = without(docs, found.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct())
    again = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where((F.col("rows") > 1) & F.col("doc_id").isNotNull()).select("doc_id")
    again = materialize(again, "repeated-ids")
    if again.limit(1).count():
        single = out.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
        out = without(out, again).unionByName(single)
    return out
