"""Similarity join on word shingles by PartEnum signatures (Arasu, Ganti and Kaushik, 2006), and its components.

Two sets with Jaccard similarity of at least p/q differ in at most d elements, where d (p + q) <= (q - p)(|A| + |B|). Sizes
are cut into bands, each 1/threshold wide, so linked sets lie in the same band or in neighbouring ones; instance j
serves bands j - 1 and j, with k the largest d its sizes allow. The elements' domain is cut into P parts, P > k: two
linked sets agree exactly on P - k parts at least. A set's signatures are the numbers of its parts (the scheme's case of
single first-level parts, which needs the fewest signatures). P is so large that at most P - k - 1 parts are empty, but
with a chance of 1e-7; then an agreeing part with elements exists and empty parts need no signature. Sets with more
empty parts share one more signature among them, so no pair is lost.

Work is done on one set for each text: copies are grouped first and only carry their group's component. Signatures
that no other set has are filtered out by the sketch (see ``parts``). Two linked sets agree on P - k parts, so on
P - k - (its empty parts) that aren't empty, for either of the two; a set may thus leave out its most frequent signatures, one less
than that, and linked sets still share one (prefix filtering). So passages that many texts have draw no texts together
that share little else. Then
  1. in each signature's group the set with most shared signatures is the centre; each set is compared with the centre
     that it shares most signatures with, which is one pair a set, and links give components;
  2. a centre's group has the sets of all signatures that it is the centre of; only groups that still span several
     components are looked at again: sets outside a group's largest component are compared with the rest of the group, in
     blocks of bounded size: first on the parts' numbers and sizes, whose differences bound d from below, then exactly.
Every pair that shares a signature is thus compared, ruled out by a bound, or already in one component. Sets that hang
together only by a chain of signatures never meet.

Defined results: null and empty texts have no shingles, link with nothing and are their own component; texts of fewer
than n words have one shingle, their whole sequence; equal rows link; a null id counts as larger than every other and
its component is null if it has no other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.llm.parts import MESSAGE, Sketch, by_shard, give_back, in_parts, merge_sketches, part_count, squeeze_sorted, table, unsqueeze_sorted
from gridsignal.llm.text import Words, mixed, ngrams, same_row
from gridsignal.operators.graph import connected_components
from gridsignal.session import written

SHINGLE, NUMERATOR, DENOMINATOR = 4, 85, 100
SKETCH = 0
#: A set has hundreds of signatures: so few false alarms each that most sets have none.
SKETCH_WIDTH, SKETCH_DEPTH = 1 << 26, 2
PART_SEED, SUM_SEED, SPARSE = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
NO_ID = (1 << 63) - 1
#: Numbers of sets that are sent to all tasks at most (8 MB).
BROADCAST_ROWS = 1_000_000
#: Shingles that a task keeps unpacked, about.
OPEN_SHINGLES = 4_000_000
#: Bytes of text in a part: a set has hundreds of signatures, so parts are smaller than elsewhere.
SIGNATURE_PART_BYTES = 4 << 20
#: Sets of a block in the second comparison.
BLOCK = 1024
#: Tasks that share a group's rows where groups are too many to be sent to all tasks.
SALTS = 16


@lru_cache
def bands(p: int, q: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest size of each band up to the one that holds ``most``; k and P of each instance (one more than bands)."""
    first = [1]
    while True:
        nxt = first[-1] * q // p + 1
        if nxt > most:
            break
        first.append(nxt)
    first.append(first[-1] * q // p + 1)
    k, parts = [], []
    for j in range(len(first)):
        low, high = first[max(0, j - 1)], first[j] * q // p
        d = (q - p) * 2 * high // (p + q)
        n = d + 1
        while d and math.lgamma(n + 1) - math.lgamma(d + 1) - math.lgamma(n - d + 1) + low * math.log(d / n) > math.log(1e-7):
            n += 1
        k.append(d)
        parts.append(n)
    return np.array(first), np.array(k), np.array(parts)


class ShingleSets:
    """The distinct shingles of each row, sorted: ``number``, ``doc``, ``first`` (one more entry than rows)."""

    def __init__(self, texts: pa.ChunkedArray, n: int):
        words = Words(texts, lower=True)
        rows = len(texts)
        ok = same_row(words, n)
        number, doc = ngrams(words.number, n)[ok], words.doc[: len(ok)][ok]
        counts = words.counts()
        for c in range(1, n):
            short = np.flatnonzero(counts == c)
            if len(short):
                number = np.concatenate([number, mixed(ngrams(words.number, c)[words.first[short]] + np.uint64(c))])
                doc = np.concatenate([doc, short])
        order = np.lexsort((number, doc))
        number, doc = number[order], doc[order]
        new = np.ones(len(number), bool)
        new[1:] = (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])
        self.number, self.doc = number[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(rows + 1))
        self.size = np.diff(self.first)

    def blob(self, row: int) -> bytes:
        """48 bits of each shingle: enough to compare two sets of n shingles with a chance of error of n^2 / 2^48.

        Shingles of the set that agree in these bits take the numbers that follow, so there are as many as shingles.
        """
        short = (self.number[self.first[row] : self.first[row + 1]] >> np.uint64(16)).astype(np.int64)
        at = np.arange(len(short))
        return squeeze_sorted((np.maximum.accumulate(short - at) + at).astype(np.uint64))


class Signatures:
    """Signatures of the non-empty sets in the two instances of their band."""

    def __init__(self, sets: ShingleSets, p: int, q: int):
        self.rows = np.flatnonzero(sets.size > 0)
        first, k, parts = bands(p, q, 1 << int(sets.size.max()).bit_length() if len(self.rows) else 1)
        self.band = np.searchsorted(first, sets.size[self.rows], "right") - 1
        place = np.zeros(len(sets.size), np.int64)
        place[self.rows] = np.arange(len(self.rows))
        row = place[sets.doc]
        number, owner, slot = [], [], []
        self.profile, self.spare = [], []
        for s in (0, 1):
            inst = self.band + s
            width = parts[inst]
            start = np.concatenate([[0], np.cumsum(width)])
            part = ((mixed(sets.number ^ PART_SEED) >> np.uint64(32)) * width[row].astype(np.uint64)) >> np.uint64(32)
            cell = start[row] + part.astype(np.int64)
            count = np.bincount(cell, minlength=start[-1])
            total = np.zeros(start[-1], np.uint64)
            np.add.at(total, cell, mixed(sets.number ^ SUM_SEED))
            of = np.repeat(np.arange(len(self.rows)), width)
            index = np.arange(start[-1]) - start[of]
            own = mixed(total + mixed((inst[of].astype(np.uint64) << np.uint64(32)) | index.astype(np.uint64)))
            full = count > 0
            empty = width - np.bincount(of[full], minlength=len(self.rows))
            # signatures that the set shares with any set it is linked with, less one
            self.spare.append(np.maximum(width - k[inst] - empty - 1, 0))
            sparse = np.flatnonzero(empty > width - k[inst] - 1)
            number += [own[full], mixed(SPARSE ^ inst[sparse].astype(np.uint64))]
            owner += [of[full], sparse]
            slot += [np.full(full.sum(), s), np.full(len(sparse), s)]
            self.profile.append((start, (mixed(total) >> np.uint64(56)).astype(np.uint8), np.minimum(count, 254).astype(np.uint8)))
        self.number, self.owner, self.slot = np.concatenate(number), np.concatenate(owner), np.concatenate(slot)

    def profile_of(self, i: int, slot: int) -> bytes:
        """8 bits of each part's number, then each part's size."""
        start, numbers, counts = self.profile[slot]
        return numbers[start[i] : start[i + 1]].tobytes() + counts[start[i] : start[i + 1]].tobytes()


BASE = "id long, copy_of string, size long, band int, sigs0 array<long>, sigs1 array<long>, spare0 int, spare1 int, profile0 binary, profile1 binary, shingles binary"


def signature_table(docs: DataFrame, text_col: str, n: int, p: int, q: int) -> DataFrame:
    """One row (columns of BASE) for each distinct text; lists and blobs are empty where no signature may be shared.

    ``docs``: id, copy_of (a digest of the text), text. Copies are told apart by their ids, which travel to the parts.
    """
    parts = part_count(docs, text_col, SIGNATURE_PART_BYTES)
    # new columns throughout: a cogroup's two sides may not share any
    chosen = in_parts(docs.groupBy("copy_of").agg(F.min("id").alias("id")).select(F.concat("copy_of", F.lit("")).alias("copy_of"), "id"), parts, "id", "copy_of")
    parted = in_parts(docs, parts, "id", "copy_of")

    def chosen_rows(data: pa.Table, wanted: pa.Table) -> pa.Table:
        data = data.combine_chunks()
        want = set(zip(wanted.column("id").to_pylist(), wanted.column("copy_of").to_pylist(), strict=True))
        keep = []
        for i, key in enumerate(zip(data.column("id").to_pylist(), data.column("copy_of").to_pylist(), strict=True)):
            if key in want:
                want.remove(key)
                keep.append(i)
        return data.take(pa.array(keep, pa.int64()))

    def sketch(data: pa.Table, wanted: pa.Table) -> pa.Table:
        give_back()
        data = chosen_rows(data, wanted)
        if not data.num_rows:
            return table([])
        found = Signatures(ShingleSets(data.column(text_col), n), p, q)
        return table(Sketch(found.number, parts, SKETCH_WIDTH, SKETCH_DEPTH).questions(int(data.column("part")[0].as_py()), SKETCH))

    def rows(data: pa.Table, other: pa.Table) -> pa.Table:
        give_back()
        mask = pc.is_null(other.column("kind"))
        data = chosen_rows(data, other.filter(mask))
        sets = ShingleSets(data.column(text_col), n)
        found = Signatures(sets, p, q)
        shared = Sketch(found.number, parts, SKETCH_WIDTH, SKETCH_DEPTH).repeated(other.filter(pc.invert(mask)), SKETCH) if len(found.number) else np.zeros(0, bool)
        lists, profiles, spares = [], [], []
        at = np.full(data.num_rows, -1, np.int64)
        at[found.rows] = np.arange(len(found.rows))
        for s in (0, 1):
            on = shared & (found.slot == s)
            order = np.argsort(found.owner[on], kind="stable")
            number, owner = found.number[on][order], found.owner[on][order]
            count = np.zeros(data.num_rows, np.int64)
            count[found.rows] = np.bincount(owner, minlength=len(found.rows))
            offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(number.view(np.int64))))
            profiles.append(pa.array([found.profile_of(at[i], s) if count[i] else None for i in range(data.num_rows)], pa.binary()))
            spare = np.zeros(data.num_rows, np.int32)
            spare[found.rows] = found.spare[s]
            spares.append(pa.array(spare))
        some = [len(a) + len(b) > 0 for a, b in zip(lists[0], lists[1], strict=True)]
        band = np.zeros(data.num_rows, np.int32)
        band[found.rows] = found.band
        return pa.table(
            {
                "id": data.column("id").combine_chunks(),
                "copy_of": data.column("copy_of").combine_chunks(),
                "size": pa.array(sets.size, pa.int64()),
                "band": pa.array(band),
                "sigs0": lists[0],
                "sigs1": lists[1],
                "spare0": spares[0],
                "spare1": spares[1],
                "profile0": profiles[0],
                "profile1": profiles[1],
                "shingles": pa.array([sets.blob(i) if s else None for i, s in enumerate(some)], pa.binary()),
            }
        )

    by_part = parted.groupBy("part")
    def merge(asked: pa.Table) -> pa.Table:
        give_back()
        return table(merge_sketches(asked, SKETCH, SKETCH_WIDTH, SKETCH_DEPTH))

    sketches = by_part.cogroup(chosen.groupBy("part")).applyInArrow(sketch, MESSAGE)
    estimates = by_shard(sketches, parts).applyInArrow(merge, MESSAGE)
    both = estimates.select("part", "kind", "n", "a", F.col("shard"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("copy_of"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("kind", "int"), ("n", "int"), ("a", "binary"), ("shard", "int"))]
    both = both.unionByName(chosen.select("part", *none, "id", "copy_of"))
    return by_part.cogroup(both.groupBy("part")).applyInArrow(rows, BASE)


def linked(a: np.ndarray, b: np.ndarray, p: int, q: int) -> bool:
    """Exactly: q x intersection >= p x union."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return q * common >= p * (len(a) + len(b) - common)


def verified(pairs: DataFrame, base: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (src, dst) of set numbers whose sets are linked."""
    sets = base.filter(F.col("shingles").isNotNull()).select(F.col("set").alias("_set"), "size", "shingles")
    both = pairs.join(sets, F.col("src") == F.col("_set")).select("src", "dst", F.col("size").alias("n1"), F.col("shingles").alias("s1"))
    both = both.join(sets, F.col("dst") == F.col("_set")).select("src", "dst", "n1", "s1", F.col("size").alias("n2"), F.col("shingles").alias("s2"))
    # one size rules the other out before the sets are opened
    both = both.filter(F.lit(q) * F.least("n1", "n2") >= F.lit(p) * F.greatest("n1", "n2"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, opened = None, None
        for batch in batches:
            keep = []
            s1, s2 = batch.column("s1"), batch.column("s2")
            n1, n2 = batch.column("n1").to_pylist(), batch.column("n2").to_pylist()
            dst = batch.column("dst").to_pylist()
            for i in range(batch.num_rows):
                if dst[i] != last:
                    last, opened = dst[i], unsqueeze_sorted(s2[i].as_py(), n2[i], np.uint64)
                keep.append(linked(unsqueeze_sorted(s1[i].as_py(), n1[i], np.uint64), opened, p, q))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(compare, "src long, dst long")


def least_difference(numbers: np.ndarray, counts: np.ndarray, others: np.ndarray, other_counts: np.ndarray) -> np.ndarray:
    """Lower bounds of the number of differing elements between one set and others, from their parts."""
    gap = np.abs(counts.astype(np.int16) - other_counts)
    differ = (numbers != others) | (gap > 0)
    # an equal number of elements can't differ in one only
    small = np.where(gap == 0, 2, gap)
    return np.where(differ, small, 0).sum(1)


def by_unit(rows: DataFrame, work, schema: str) -> DataFrame:
    """Apply ``work`` (a table of one unit's rows -> a record batch) to each unit; a task takes many units in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            unit = batch.column("unit").to_numpy()
            edges = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi > lo:
                    if unit[lo] != current and held:
                        yield work(pa.Table.from_batches(held))
                        held.clear()
                    current = unit[lo]
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield work(pa.Table.from_batches(held))

    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, schema)


class Unit:
    """One unit of the second comparison: sets on the left are compared with sets on the right of other components."""

    def __init__(self, rows: pa.Table, p: int, q: int):
        self.p, self.q = p, q
        self.ids, self.size, self.comp, self.on_left, self.own = (rows.column(c).to_numpy() for c in ("set", "size", "component", "left", "own"))
        grid = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("profile")])
        self.numbers, self.counts = grid[:, : grid.shape[1] // 2], grid[:, grid.shape[1] // 2 :]

    def partners(self, i: int) -> np.ndarray:
        """Rows that the bound does not rule out for the left row ``i``."""
        fits = ~self.on_left & (self.comp != self.comp[i]) & (self.q * np.minimum(self.size, self.size[i]) >= self.p * np.maximum(self.size, self.size[i]))
        other = np.flatnonzero(fits if self.own[i] else fits & self.own)
        if len(other):
            low = least_difference(self.numbers[i], self.counts[i], self.numbers[other], self.counts[other])
            other = other[low * (self.p + self.q) <= (self.q - self.p) * (self.size[other] + self.size[i])]
        return other


def with_few(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of rows (with a column ``set``) and a table of groups, each once, without a task for each group.

    Few groups are sent to all tasks; beyond a count of BROADCAST_ROWS each group's rows are dealt to SALTS tasks by their set.
    """
    few = written(few)
    if few.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), on)
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("set"), F.lit(SALTS)).cast("int")).join(few, [*on, "salt"]).drop("salt")


def open_groups(stars: DataFrame, placed: DataFrame) -> DataFrame:
    """(grp, set, component): the members of centres' groups that span several components.

    ``stars``: src, dst (a centre); ``placed``: set, component. A centre's group has all sets that share a signature whose
    centre it is, so any two sets of one signature meet in its centre's group.
    """
    members = stars.select(F.col("dst").alias("grp"), F.col("src").alias("set")).union(stars.select("dst", "dst").distinct())
    members = written(members.join(placed, "set", "left").select("grp", "set", F.coalesce("component", "set").alias("component")))
    spread = members.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("grp")
    return with_few(members, spread, ["grp"])


def remaining_links(members: DataFrame, base: DataFrame, p: int, q: int) -> DataFrame:
    """Links (src, dst) that join sets of different components of a group; enough of them to join all that are linked.

    ``members``: grp, set, component, size, band, profile0, profile1. An instance serves its own band by the first
    profile and the band before by the second; two sets of one band meet in their own instance only. Where a group's
    sets of an instance lie in several components, those outside the largest are compared with all others, in pairs of
    blocks; each pair of blocks is one unit of work. Sets that share no signature differ in every part, so the bound
    rules them out too. A first pass finds the sets that some partner is left for; only these sets' shingles move, and
    a second pass compares them exactly, pairs already joined inside the unit left out.
    """
    slots = F.array(F.struct(F.col("band").alias("inst"), F.lit(True).alias("own"), F.col("profile0").alias("profile")), F.struct((F.col("band") + 1).alias("inst"), F.lit(False).alias("own"), F.col("profile1").alias("profile")))
    members = members.select("grp", "set", "size", "component", F.explode(slots).alias("s")).select("grp", "s.inst", "set", "size", "component", "s.own", "s.profile").filter("profile IS NOT NULL")
    group = ["grp", "inst"]
    kinds = members.groupBy(*group, "component").agg(F.count(F.lit(1)).alias("m"))
    split = kinds.groupBy(*group).agg(F.count(F.lit(1)).alias("kinds"), F.sum("m").alias("all"), F.max(F.struct("m", "component")).alias("largest")).filter("kinds > 1")
    blocks = lambda n: (F.floor(n / BLOCK) + 1).cast("int")
    split = split.select(*group, F.col("largest.component").alias("major"), blocks(F.col("all") - F.col("largest.m")).alias("lefts"), blocks(F.col("all")).alias("rights"))
    members = with_few(members, split, group)
    block = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), F.col("set")), F.col(n)).cast("int")
    left = members.filter("component <> major").withColumn("lb", block("lefts", 1)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("rights") - 1))).withColumn("left", F.lit(True))
    right = members.withColumn("rb", block("rights", 2)).withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).withColumn("left", F.lit(False))
    units = left.unionByName(right).withColumn("unit", F.xxhash64(*group, "lb", "rb")).select("unit", "set", "size", "component", "left", "own", "profile")

    def find(rows: pa.Table) -> pa.RecordBatch:
        unit = Unit(rows, p, q)
        keep = np.zeros(len(unit.ids), bool)
        for i in np.flatnonzero(unit.on_left):
            other = unit.partners(i)
            keep[other] = True
            keep[i] = len(other) > 0
        return pa.concat_batches(rows.to_batches()).filter(pa.array(keep))

    def compare(rows: pa.Table) -> pa.RecordBatch:
        unit = Unit(rows, p, q)
        blobs, opened, held = rows.column("shingles"), {}, 0

        def shingles_of(i: int) -> np.ndarray:
            nonlocal held
            if i not in opened:
                if held > OPEN_SHINGLES:
                    opened.clear()
                    held = 0
                opened[i] = unsqueeze_sorted(blobs[i].as_py(), int(unit.size[i]), np.uint64)
                held += len(opened[i])
            return opened[i]

        root = {c: c for c in unit.comp.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        src, dst = [], []
        for i in np.flatnonzero(unit.on_left):
            for j in unit.partners(i):
                a, b = top(int(unit.comp[i])), top(int(unit.comp[j]))
                if a != b and linked(shingles_of(int(i)), shingles_of(int(j)), p, q):
                    root[a] = b
                    src.append(max(unit.ids[i], unit.ids[j]))
                    dst.append(min(unit.ids[i], unit.ids[j]))
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    fields = "unit long, set long, size long, component long, left boolean, own boolean, profile binary"
    left_over = written(by_unit(units, find, fields))
    named = left_over.select("set").distinct()
    shingles = base.filter(F.col("shingles").isNotNull()).select("set", "shingles")
    if named.count() <= BROADCAST_ROWS:
        shingles = shingles.join(F.broadcast(named), "set", "left_semi")
    return by_unit(left_over.join(shingles, "set"), compare, "src long, dst long").distinct()


def distinctive(base: DataFrame) -> DataFrame:
    """(set, rank, sig): signatures that other sets have too, without each set's most frequent ones.

    A set that shares fewer than ``spare`` + 1 signatures of an instance is linked with nothing there. ``rank`` is the
    number of signatures that a set has left.
    """
    slots = F.array(F.struct(F.lit(0).alias("slot"), F.col("spare0").alias("spare"), F.col("sigs0").alias("sigs")), F.struct(F.lit(1).alias("slot"), F.col("spare1").alias("spare"), F.col("sigs1").alias("sigs")))
    each = base.select("set", F.explode(slots).alias("s")).filter(F.size("s.sigs") > F.col("s.spare")).select("set", "s.slot", "s.spare", F.explode("s.sigs").alias("sig"))
    held = each.groupBy("sig").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    by_set = each.join(held, "sig").groupBy("set", "slot").agg(F.sort_array(F.collect_list(F.struct("members", "sig"))).alias("sigs"), F.first("spare").alias("spare"))
    kept = by_set.filter(F.size("sigs") > F.col("spare")).select("set", F.slice("sigs", F.lit(1), F.size("sigs") - F.col("spare")).alias("sigs"))
    return kept.select("set", F.size("sigs").alias("rank"), F.explode("sigs.sig").alias("sig"))


def text_components(docs: DataFrame, n: int = SHINGLE, p: int = NUMERATOR, q: int = DENOMINATOR) -> DataFrame:
    """One row for each different text of ``docs`` (id, copy_of, text): id (its least), copy_of, size (of its set), group.

    Texts of one ``group`` hang together by links; copies of a text without shingles are linked with nothing.
    """
    base = signature_table(docs, "text", n, p, q)
    # numbered by id and digest, which name a text even where ids repeat
    base = written(base.withColumn("set", F.xxhash64("id", "copy_of")))
    sigs = written(distinctive(base))
    groups = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("rank", "set")).alias("c")).filter("members > 1").select("sig", F.col("c.set").alias("centre"))
    stars = written(sigs.join(groups, "sig").filter("set <> centre").groupBy(F.col("set").alias("src"), F.col("centre").alias("dst")).agg(F.count(F.lit(1)).alias("shared")))
    nearest = stars.groupBy("src").agg(F.max_by("dst", F.struct("shared", -F.col("dst"))).alias("dst"))
    links = written(verified(nearest, base, p, q))
    found = connected_components(links).withColumnRenamed("node", "set")
    profile = base.filter(F.col("shingles").isNotNull()).select("set", "size", "band", "profile0", "profile1")
    members = open_groups(stars, found).join(profile, "set")
    more = remaining_links(members, base, p, q)
    final = connected_components(links.union(more))
    return base.select("set", "id", "copy_of", "size").join(final, F.col("set") == F.col("node"), "left").select("id", "copy_of", "size", F.coalesce("component", "set").alias("group"))


def with_digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, copy_of, text): a null id as the largest number, a null text as an empty one; ``copy_of`` tells texts apart."""
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return docs.withColumn("copy_of", F.md5("text"))


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, p: int = NUMERATOR, q: int = DENOMINATOR) -> DataFrame:
    """One row for each row of ``docs``: id_col, n_shingles, component_id."""
    docs = with_digest(docs, id_col, text_col)
    sets = written(text_components(docs, n, p, q))
    least = sets.groupBy("group").agg(F.min("id").alias("component_id"))
    per_text = sets.join(least, "group").select("copy_of", "size", "component_id")
    out = docs.select("id", "copy_of").join(per_text, "copy_of")
    real = lambda c: F.when(c != NO_ID, c)
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(real(F.col("id")).alias(id_col), F.col("size").alias("n_shingles"), real(component).alias("component_id"))


def op9_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked by 4-word shingles at a Jaccard similarity of 0.85 or more."""
    return similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_partenum_jaccard": op9_partenum_jaccard}
ORACLES = {
    "op9_partenum_jaccard": r"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
         s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
         n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
         c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
         l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * m >= 85 * (p.n + q.n - m)),
         b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
         r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.doc_id)
    SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1
    """
}
