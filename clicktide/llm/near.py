"""Near-duplicates: MinHash signatures and a multi-index Hamming join.

A document is the set of its word shingles; texts of one set are one class from
the start.  Signatures have ``m`` values of ``bits`` bits.  Two sets at or above
the threshold differ in at most ``limit`` values (but for one pair in a million
that lies just on it).  The values are split into so many chunks that, by the
pigeonhole principle, two such signatures differ in at most ``errors`` values of
one chunk; enumerating what a chunk looks like without any ``errors`` of its
values gives keys, of which every such pair shares one.

Links are confirmed on the full sets, in steps that avoid the pairs of a large
group: first every set against the smallest of each of its keys; then, between
components that still share a key, the pairs with signatures within the limit.
Before texts are fetched, pairs are sifted by parity sketches: bits of two sets
differ in no more places than the sets do, so nothing linked is lost.  Keys that
many sets share, as texts of one template do below the threshold, do not pair
their sets at all: these meet through their rarest shingles, of which any two
linked sets share one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktide.llm.common import slices, stored, texts
from clicktide.llm.graph import components
from clicktide.llm.words import BASE, U, mix, raw, shingles, words

MISS = 1e-6  # chance that a pair just on the threshold exceeds the limit
ODD_WORDS = 16  # 64-bit words of a parity sketch
GROUP = 500  # sets that are compared with one set in a task
CROWD = 100  # sets of one key beyond which they meet through rare shingles
CELL_BITS = 18  # counts of shingles lie in so many hashed cells, 2 MB in all
BLOCK = 1 << 12  # cells whose counts travel as one row


@dataclass(frozen=True)
class Near:
    """``shingle`` words, ``percent`` of Jaccard similarity, about ``values`` values of ``bits`` bits."""

    shingle: int = 5
    percent: int = 80
    values: int = 65
    bits: int = 32
    errors: int = 1

    @cached_property
    def limit(self) -> int:
        """Values in which signatures of linked sets may differ."""
        p, m = 1 - self.percent / 100, self.values
        tail = [math.comb(m, d) * p**d * (1 - p) ** (m - d) for d in range(m + 1)]
        return next(t for t in range(m + 1) if sum(tail[t + 1 :]) <= MISS)

    @cached_property
    def chunks(self) -> list[list[int]]:
        n = min(self.values, self.limit // (self.errors + 1) + 1)
        return [list(map(int, c)) for c in np.array_split(np.arange(self.values), n)]

    @cached_property
    def masks(self) -> list[tuple[int, list[int]]]:
        """Chunk and values kept, for every choice of the values in error."""
        out = []
        for c, chunk in enumerate(self.chunks):
            e = min(self.errors, len(chunk) - 1)
            out += [(c, [i for i in chunk if i not in gone]) for gone in combinations(chunk, e)]
        return out

    def signatures(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Signature rows of shingle hashes grouped at ``starts``."""
        sig = np.empty((len(starts), self.values), np.uint32)
        factors = mix(np.arange(self.values, dtype=np.uint64) + U(77)) | U(1)
        for j, a in enumerate(factors):
            least = np.minimum.reduceat(h * a, starts)
            sig[:, j] = mix(least) & U((1 << self.bits) - 1)
        return sig

    def keys(self, sig: np.ndarray) -> np.ndarray:
        """Keys of signature rows, one column per mask."""
        out = np.empty((len(sig), len(self.masks)), np.int64)
        wide = sig.astype(np.uint64)
        for j, (c, kept) in enumerate(self.masks):
            h = np.full(len(sig), U(c * 64 + 1))
            for i in kept:
                h = mix(h * U(BASE) + wide[:, i])
            # what is left out must not look like a value in another place
            out[:, j] = mix(h + U(sum(1 << (i % 61) for i in kept))).view(np.int64)
        return out


SIGNED = "doc_id bigint, n_shingles bigint, set1 bigint, set2 bigint, sig array<int>, odd array<bigint>, text_key bigint"


def parities(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """A row of bits for each of ``n`` texts: whether an odd number of shingles falls on a bit."""
    out = np.zeros(n * ODD_WORDS, np.uint64)
    place = mix(h ^ U(0x2545F4914F6CDD1D)) >> U(32)
    word = doc * ODD_WORDS + ((place >> U(6)) % U(ODD_WORDS)).astype(np.int64)
    np.bitwise_xor.at(out, word, U(1) << (place & U(63)))
    return out.reshape(n, ODD_WORDS).view(np.int64)


def text_key(docs: DataFrame) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(docs["text"].cast("string"))


def signed(docs: DataFrame, how: Near, with_text: bool = False) -> DataFrame:
    """Number of shingles, two hashes of the set, signature (null without shingles), and a hash of the text."""
    more = ["text"] if with_text else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h, doc = shingles(words(*raw(batch.column(1))), how.shingle)
                n = np.bincount(doc, minlength=batch.num_rows)
                some = np.flatnonzero(n)
                set1, set2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                sigs = [None] * len(n)
                if len(some):
                    starts = np.concatenate(([0], np.cumsum(n)))[some]
                    set1[some] = np.add.reduceat(mix(h + U(1)), starts).view(np.int64)
                    set2[some] = np.add.reduceat(mix(h ^ U(0x5851F42D4C957F2D)), starts).view(np.int64)
                    for i, s in zip(some.tolist(), how.signatures(h, starts).view(np.int32)):
                        sigs[i] = s
                odd = pa.FixedSizeListArray.from_arrays(pa.array(parities(h, doc, len(n)).ravel()), ODD_WORDS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(n, pa.int64()), pa.array(set1), pa.array(set2),
                        pa.array(sigs, pa.list_(pa.int32())), odd.cast(pa.list_(pa.int64())), batch.column(2),
                        *(batch.column(c) for c in more),
                    ],
                    names=["doc_id", "n_shingles", "set1", "set2", "sig", "odd", "text_key", *more],
                )

    return texts(docs, text_key(docs).alias("text_key")).mapInArrow(run, SIGNED + "".join(f", {c} string" for c in more))


def _keyed(reps: DataFrame, how: Near) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = how.keys(batch.column(1).flatten().to_numpy().view(np.uint32).reshape(-1, how.values))
            mask = np.tile(np.arange(keys.shape[1], dtype=np.int16), len(keys))
            rep = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(mask), pa.array(rep)], names=["key", "mask", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "key bigint, mask smallint, rep bigint")


def _differ(how: Near, values: list[int]) -> Column:
    """Number of ``values`` in which two signatures differ."""
    total = F.lit(0)
    for i in values:
        total = total + (F.col("sig")[i] != F.col("sig2")[i]).cast("int")
    return total


def confirmed(pairs: DataFrame, bodies: DataFrame, how: Near) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets reach the threshold.

    ``bodies`` has ``rep`` and ``text``.  Texts are grouped by ``a``; a set with
    many partners is compared in groups of about ``GROUP``, each with its own copy.
    """
    pairs = stored(pairs, "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    heads = parts.select("a", F.col("a").alias("rep"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("place"))
    rows = heads.unionByName(dealt.select("a", F.col("b").alias("rep"), "part", F.lit(1).alias("place")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, head = None, np.empty(0, np.uint64)
        for whole in batches:
            for batch in slices(whole, "text"):
                h, doc = shingles(words(*raw(batch.column(4))), how.shingle)
                first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                out: list[tuple[int, int]] = []
                a, rep, part, place = (batch.column(i).to_pylist() for i in range(4))
                for i in range(batch.num_rows):
                    own = h[first[i] : first[i + 1]]
                    if place[i] == 0:
                        current, head = (a[i], part[i]), own
                        continue
                    assert current == (a[i], part[i])
                    at = np.searchsorted(head, own)
                    common = int((head[np.minimum(at, len(head) - 1)] == own).sum()) if len(head) else 0
                    if 100 * common >= how.percent * (len(own) + len(head) - common) and len(own):
                        out.append((a[i], rep[i]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    full = rows.join(bodies, "rep").select("a", "rep", "part", "place", "text")
    ordered = full.repartition("a", "part").sortWithinPartitions("a", "part", "place")
    return stored(ordered.mapInArrow(run, "a bigint, b bigint"), "confirmed")


COUNTED = "block bigint, counts binary"


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - CELL_BITS)).astype(np.int64)


def _as_blocks(total: np.ndarray) -> pa.RecordBatch:
    """Counts of all cells, a row for each block that has any."""
    blocks = total.reshape(-1, BLOCK)
    some = np.flatnonzero(blocks.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some), pa.array([blocks[b].tobytes() for b in some], pa.binary())], names=["block", "counts"])


def _task_counts(bodies: DataFrame, how: Near) -> DataFrame:
    """How often the shingles of each cell occur in a task, at most one row for each block, however many its texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                h, _ = shingles(words(*raw(batch.column(0))), how.shingle)
                total += np.bincount(_cells(h), minlength=len(total))
        yield _as_blocks(total)

    return bodies.select("text").mapInArrow(run, COUNTED)


def _shingle_counts(bodies: DataFrame, how: Near) -> np.ndarray:
    """How often the shingles of each cell occur, an array of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for b, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[b * BLOCK : (b + 1) * BLOCK] += np.frombuffer(counts, np.int64)
        yield _as_blocks(total)

    counted = _task_counts(bodies, how).repartition("block").mapInArrow(add, COUNTED).toArrow()
    out = np.zeros(((1 << CELL_BITS) // BLOCK, BLOCK), np.int64)
    for b, counts in zip(counted.column("block").to_pylist(), counted.column("counts").to_pylist()):
        out[b] = np.frombuffer(counts, np.int64)
    return out.ravel()


def _crowd_pairs(bodies: DataFrame, how: Near) -> DataFrame:
    """Pairs ``a``, ``b`` of sets in different components that may reach the threshold.

    ``bodies`` has ``rep``, ``comp`` and ``text``.  A linked set holds ``percent`` of
    either set.  So with all shingles in one order, two linked sets share one of those
    that come first in both, as many as the rest leaves; the order is from rare to
    frequent, so that what a template repeats comes last and brings no pairs.
    """
    counts = bodies.sparkSession.sparkContext.broadcast(_shingle_counts(bodies, how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h, doc = shingles(words(*raw(batch.column(2))), how.shingle)
                h = h[np.lexsort((h, counts.value[_cells(h)], doc))]
                n = np.bincount(doc, minlength=batch.num_rows)
                place = np.arange(len(h)) - (np.cumsum(n) - n)[doc]
                first = place <= (n * (100 - how.percent) // 100)[doc]
                doc = doc[first]
                rep, comp = (batch.column(c).to_numpy()[doc] for c in (0, 1))
                columns = [h[first].view(np.int64), place[first], n[doc], rep, comp]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rare", "place", "n", "rep", "comp"])

    rare = stored(bodies.select("rep", "comp", "text").mapInArrow(run, "rare bigint, place bigint, n bigint, rep bigint, comp bigint"), "rare-shingles")
    # a shingle of one component brings no pair, however many of its sets have it
    several = rare.groupBy("rare").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("rare")
    rare = stored(rare.join(several, "rare", "left_semi"), "rare-shingles")
    other = rare.select(*(F.col(c).alias(f"{c}2") for c in rare.columns))
    # from the first shingle that both have, at most so many follow in common
    left = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    enough = left * (100 + how.percent) >= (F.col("n") + F.col("n2")) * how.percent
    pairs = rare.join(other, (F.col("rare") == F.col("rare2")) & (F.col("comp") < F.col("comp2")) & enough)
    return pairs.select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct()


def links(reps: DataFrame, docs: DataFrame, how: Near, crowd: int = CROWD) -> DataFrame:
    """Links ``a``-``b`` that make the same components as all links between sets.

    ``reps`` has one row per distinct set: ``rep``, ``n_shingles``, ``sig``, ``odd``.
    """
    keyed = _keyed(reps, how)
    heads = keyed.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = stored(keyed.join(heads, "key"), "shared-keys")
    some = shared.select("rep").distinct()
    bodies = stored(
        texts(docs).withColumnRenamed("doc_id", "rep").join(some, "rep", "left_semi"), "candidates"
    )
    # each set against the smallest one of every key
    star = shared.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    side = reps.select("rep", "n_shingles", "odd")
    other = side.select(F.col("rep").alias("rep2"), F.col("n_shingles").alias("n2"), F.col("odd").alias("odd2"))
    star = star.join(side, F.col("a") == F.col("rep")).join(other, F.col("b") == F.col("rep2")).where(_may_link(how))
    found = confirmed(star.select("a", "b"), bodies, how)
    # then what lies between components
    comp = components(found).withColumnRenamed("node", "rep")
    labelled = shared.select("key", "mask", "rep").join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    labelled = stored(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low < high")
    mixed = stored(mixed.select("key", (F.col("n") > crowd).alias("crowded")), "mixed-keys")
    live = labelled.join(mixed.where("not crowded"), "key", "left_semi").join(reps.select("rep", "n_shingles", "odd", "sig"), "rep")
    live = stored(live, "live-keys")
    other = live.select(
        F.col("key").alias("key2"), F.col("rep").alias("rep2"), F.col("comp").alias("comp2"), F.col("n_shingles").alias("n2"),
        F.col("odd").alias("odd2"), F.col("sig").alias("sig2"),
    )
    within = _differ(how, list(range(how.values))) <= how.limit
    between = (F.col("key") == F.col("key2")) & (F.col("comp") < F.col("comp2")) & _may_link(how) & within & _first_shared(how)
    pairs = live.join(other, between).select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    if not mixed.where("crowded").isEmpty():
        members = labelled.join(mixed.where("crowded"), "key", "left_semi").select("rep", "comp").distinct()
        met = _crowd_pairs(stored(bodies.join(members, "rep"), "crowd"), how)
        side = reps.select("rep", "n_shingles", "odd", "sig")
        other = side.select(
            F.col("rep").alias("rep2"), F.col("n_shingles").alias("n2"), F.col("odd").alias("odd2"), F.col("sig").alias("sig2")
        )
        met = met.join(side, F.col("a") == F.col("rep")).join(other, F.col("b") == F.col("rep2")).where(_may_link(how) & within)
        pairs = pairs.unionByName(met.select("a", "b"))
    pairs = pairs.distinct()
    return found.unionByName(confirmed(pairs, bodies, how))


def _may_link(how: Near) -> Column:
    """What two sets at the threshold fulfil: their sizes, and the places in which their sketches differ."""
    a, b = F.col("n_shingles"), F.col("n2")
    differ = sum((F.bit_count(F.col("odd")[i].bitwiseXOR(F.col("odd2")[i])) for i in range(ODD_WORDS)), F.lit(0))
    # |A xor B| <= (|A| + |B|) (1 - J) / (1 + J)
    return (F.least(a, b) * 100 >= F.greatest(a, b) * how.percent) & (differ * (100 + how.percent) <= (a + b) * (100 - how.percent))


def _first_shared(how: Near) -> Column:
    """Whether the chunk of ``mask`` is the first that both signatures share; each pair then comes once or so."""
    chunk_of = F.array(*[F.lit(c) for c, _ in how.masks])[F.col("mask").cast("int")]
    first = F.lit(len(how.chunks))
    for c in reversed(range(len(how.chunks))):
        first = F.when(_differ(how, how.chunks[c]) <= how.errors, F.lit(c)).otherwise(first)
    return chunk_of == first


def near_duplicates(docs: DataFrame, how: Near = Near(), crowd: int = CROWD) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document.

    Words are runs without ASCII white space, A-Z lower-cased.  A text of fewer
    words than a shingle has itself as its only shingle.  Documents without words,
    null texts and documents without an id are linked with nothing.  The component
    is the smallest id reachable; that document is kept, and one without an id.
    Rows of one id are judged each by its own text; other columns are ignored; an
    empty table gives no rows.
    """
    return classes(docs, how, crowd).select("doc_id", "n_shingles", "component_id", "kept")


def classes(docs: DataFrame, how: Near = Near(), crowd: int = CROWD) -> DataFrame:
    """``near_duplicates`` with ``text_key``, which tells the texts of one id apart, and ``class``.

    ``class`` is one for the texts of a component and null for a text linked with
    none; an id with several texts may be the smallest of several classes.
    """
    rows = stored(signed(docs, how), "signatures")
    linked = rows.where("n_shingles > 0 and doc_id is not null")
    # equal sets are summed up before the shuffle
    sets = stored(
        linked.groupBy("set1", "set2").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("odd").alias("odd"), F.count("*").alias("n")
        ), "sets",
    )
    # an id with several texts names none of their sets, which get ids of their own
    spans = [f(c).alias(f"{f.__name__}_{c}") for c in ("set1", "set2") for f in (F.min, F.max)]
    shared = rows.where("doc_id is not null").groupBy("doc_id").agg(*spans).where("min_set1 < max_set1 or min_set2 < max_set2")
    shared = stored(shared.select("doc_id"), "shared-ids")
    if some := not shared.isEmpty():
        own = F.when(F.col("doc_id").isNotNull(), F.xxhash64("set1", "set2")).otherwise(F.col("rep"))
        sets = stored(sets.join(shared, F.col("rep") == F.col("doc_id"), "left").withColumn("own", own).drop("doc_id"), "sets")
        apart = signed(texts(docs).join(shared, "doc_id", "left_semi"), how, with_text=True).where("n_shingles > 0")
        apart = apart.select(F.xxhash64("set1", "set2").alias("doc_id"), "text").dropDuplicates(["doc_id"])
        docs = texts(docs).join(shared, "doc_id", "left_anti").unionByName(apart)
    else:
        sets = sets.withColumn("own", F.col("rep"))
    reps = sets.select(F.col("own").alias("rep"), "n_shingles", "sig", "odd")
    comp = components(links(reps, docs, how, crowd)).withColumnRenamed("node", "own")
    # only sets that have a class other than their one document
    linked = sets.select("set1", "set2", "own", "rep", "n").join(comp, "own", "left").where("n > 1 or comp is not null" if not some else "true")
    linked = linked.withColumn("class", F.coalesce("comp", "own"))
    if some:
        low = linked.where("comp is not null").groupBy("comp").agg(F.min("rep").alias("low"))
        linked = linked.join(low, "comp", "left").withColumn("comp", F.col("low"))
    linked = linked.select("set1", "set2", "class", F.coalesce("comp", "rep").alias("component_id"))
    out = rows.withColumn("alone", (F.col("n_shingles") == 0) | F.col("doc_id").isNull())
    out = out.join(linked.withColumn("alone", F.lit(False)), ["set1", "set2", "alone"], "left")
    comp_id = F.coalesce(F.when(~F.col("alone"), F.col("component_id")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", comp_id.alias("component_id"), comp_id.eqNullSafe(F.col("doc_id")).alias("kept"), "text_key", "class")
