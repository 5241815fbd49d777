"""Near-duplicates by weighted Jaccard similarity of five-word shingles: BagMinHash signatures, bands, exact checks, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import BROADCAST_ROWS, as_lists, discard, fresh, materialize, portions, small, tidy

SHINGLE = 5
SIMILARITY = 0.8
#: 40 bands of 6 registers miss a pair of similarity 0.8 with probability (1 - 0.8^6)^40, five in a million.
BANDS, BAND_ROWS = 40, 6
#: Bytes of texts or bags that a task works on at once.
PORTION = 1 << 20
#: Words of 64 bits in an odd sketch.
SKETCH = 32
#: How many of a bucket's texts outside its largest class meet the others in the first round, and how many times more in each after it.
ASKED, MORE = 32, 16
#: About how many texts of a bucket one task holds against those.
SLICE = 1024

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64's, whose constants are fixed values)."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def exponential(seed: np.ndarray) -> np.ndarray:
    """Exponential numbers of rate 1, one for each seed."""
    return -np.log(((mix(seed) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)


class Hasher(dict):
    """Word (bytes) -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


class Shingler:
    """Texts -> bags of shingles. Words lie between ASCII white space and are lower-cased."""

    def __init__(self, width: int = SHINGLE, limit: int = 20_000):
        self.width, self.limit, self.known = width, limit, Hasher()

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").lower().encode().split()

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """A 64-bit number for each window of ``width`` words; for fewer words, one for all of them; none without words."""
        if len(self.known) > self.limit:
            self.known.clear()
        n = len(words)
        h = np.fromiter(map(self.known.__getitem__, words), dtype=_U, count=n)
        width = min(self.width, n)
        out = np.zeros(max(0, n - width + 1) if n else 0, dtype=_U)
        for k in range(width):
            out = mix(out ^ h[k : n - width + 1 + k])
        return out


def bag_minhash(bags: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """Signatures (one row of ``registers`` float64 for each bag) of bags given as (shingles, counts).

    Every element has a Poisson process of rate 1 over each unit of weight, the
    same in all bags; a bag sees those below its weight. Each point belongs to a
    random register, and a register keeps its earliest point; two bags agree in a
    register with their weighted Jaccard similarity as probability. Weights are
    discretised to whole counts, so no weight is rounded.

    The levels (0,1], (1,2], (2,4], (4,8] ... are processes of their own, and a
    wide one is split in halves: its first point falls into one of them by a coin,
    the other's first point comes later by an exponential step. A part whose first
    point comes after the bag's latest register is dropped with all that is below
    it, so heavy weights cost little more than light ones.
    """
    h = np.full((len(bags), registers), np.inf)
    latest = np.full(len(bags), np.inf)
    sizes = [len(s) for s, _ in bags]
    if not sum(sizes):
        return h
    doc = np.repeat(np.arange(len(bags)), sizes)
    element = np.concatenate([s for s, _ in bags])
    weight = np.concatenate([c for _, c in bags]).astype(np.int64)
    level, fronts, which = 0, [], np.arange(len(doc))
    while len(which):
        lo, hi = (0, 1) if level == 0 else (1 << (level - 1), 1 << level)
        seed = mix(element[which] ^ mix(np.full(len(which), level + 1, dtype=_U)))
        fronts.append((which, seed, exponential(seed) / (hi - lo), np.full(len(which), lo), np.full(len(which), hi)))
        which, level = which[weight[which] > hi], level + 1
    who, seed, x, lo, hi = (np.concatenate(c) for c in zip(*fronts))
    while len(who):
        w, d = weight[who], doc[who]
        sees = hi <= w
        register = (mix(x.view(_U) ^ element[who]) % _U(registers)).astype(np.int64)
        np.minimum.at(h.reshape(-1), d[sees] * registers + register[sees], x[sees])
        active = np.zeros(len(bags), dtype=bool)
        active[d] = True
        rows = np.flatnonzero(active)
        latest[rows] = h[rows].max(axis=1)
        leaf = hi - lo == 1
        # A unit's next point.
        a = np.flatnonzero(leaf)
        a_seed = mix(seed[a] ^ _U(0xA5A5))
        parts = [(who[a], a_seed, x[a] + exponential(a_seed), lo[a], hi[a])]
        b = np.flatnonzero(~leaf)
        if len(b):
            coin = (mix(seed[b] ^ _U(0x5A5A)) & _U(1)).astype(bool)
            later = x[b] + exponential(mix(seed[b] ^ _U(0x3C3C))) / ((hi[b] - lo[b]) // 2)
            middle = (lo[b] + hi[b]) // 2
            parts.append((who[b], mix(seed[b] ^ _U(0x11)), np.where(coin, later, x[b]), lo[b], middle))
            parts.append((who[b], mix(seed[b] ^ _U(0x22)), np.where(coin, x[b], later), middle, hi[b]))
        who, seed, x, lo, hi = (np.concatenate(c) for c in zip(*parts)) if len(parts) > 1 else parts[0]
        go = (x < latest[doc[who]]) & (lo < weight[who])
        who, seed, x, lo, hi = who[go], seed[go], x[go], lo[go], hi[go]
    return h


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit number for each band, different between bands."""
    bits = np.ascontiguousarray(signatures).view(_U).reshape(len(signatures), bands, rows)
    out = np.broadcast_to(mix(np.arange(bands, dtype=_U)), bits.shape[:2])
    for k in range(rows):
        out = mix(out ^ bits[:, :, k])
    return out


SIGNED = "doc_id long, key_a long, key_b long, size long, bands array<long>"


def sign(docs: DataFrame, bands: int, band_rows: int) -> DataFrame:
    """For each document: its id, 128 bits that equal bags of ordered words share, the number of shingles, band hashes (null without words)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for part in portions(texts, 2048, PORTION):
                keys, bags, sizes = [], [], []
                for text in texts[part].to_pylist():
                    words = shingler.words(text)
                    found = shingler.shingles(words)
                    keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    sizes.append(len(found))
                    bags.append(np.unique(found, return_counts=True))
                key = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
                hashes = band_hashes(bag_minhash(bags, bands * band_rows), bands, band_rows).view(np.int64)
                some = np.array(sizes) > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[some].reshape(-1)), mask=pa.array(~some))
                yield pa.RecordBatch.from_arrays([ids[part], pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(sizes, pa.int64()), lists], ["doc_id", "key_a", "key_b", "size", "bands"])

    return docs.mapInArrow(run, SIGNED)


def odd_sketch(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64 * SKETCH bits: whether an odd number of a bag's shingles fall on each. Bags differ in at least as many shingles as bits."""
    places = (shingles[counts % 2 == 1] >> _U(32)) % _U(64 * SKETCH)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=64 * SKETCH) % 2 == 1).view(np.int64)


def bags_of(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles, counts, odd): sorted distinct shingles as bytes of 8, how often each occurs as bytes of 4, and the odd sketch."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for part in portions(texts, 256, PORTION):
                bags = [np.unique(shingler.shingles(shingler.words(x)), return_counts=True) for x in texts[part].to_pylist()]
                columns = [ids[part], pa.array([s.tobytes() for s, _ in bags], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in bags], pa.binary()), as_lists(np.stack([odd_sketch(*x) for x in bags]))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shingles", "counts", "odd"])

    return docs.mapInArrow(run, "doc_id long, shingles binary, counts binary, odd array<long>")


def overlap(a_shingles: bytes, a_counts: bytes, b_shingles: bytes, b_counts: bytes) -> tuple[int, int]:
    """(size of the multisets' intersection, of their union)."""
    a, b = np.frombuffer(a_shingles, _U), np.frombuffer(b_shingles, _U)
    x, y = np.frombuffer(a_counts, np.uint32).astype(np.int64), np.frombuffer(b_counts, np.uint32).astype(np.int64)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = int(np.minimum(x[i], y[j]).sum())
    return common, int(x.sum() + y.sum()) - common


def overlaps(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """(a, b, common, linked) of the pairs: how many shingles both have, and whether that is enough."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [overlap(*x) for part in portions(batch.column(2), 512, PORTION) for x in zip(*(batch.column(k)[part].to_pylist() for k in range(2, 6)))]
            common, linked = pa.array([c for c, _ in found], pa.int64()), pa.array([c >= similarity * u for c, u in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), common, linked], ["a", "b", "common", "linked"])

    side = lambda n: bags.select(F.col("doc_id").alias(n), F.col("shingles").alias(f"{n}_s"), F.col("counts").alias(f"{n}_c"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_s", "a_c", "b_s", "b_c")
    return both.mapInArrow(run, "a long, b long, common long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(node, class): the smallest node that each linked node reaches. ``links`` has (a, b).

    Each step takes the least class among a node's neighbours and then the class of
    that class; two steps are written at once, until nothing changes. Nothing
    reaches the driver but a count.
    """
    both = materialize(links.union(links.select("b", "a")).toDF("node", "other").distinct(), "links", narrow=True)

    def step(state: DataFrame) -> DataFrame:
        near = both.join(state.select(F.col("node").alias("other"), "class"), "other").groupBy("node").agg(F.min("class").alias("_near"))
        best = state.join(near, "node").select("node", "was", F.least("class", "_near").alias("_best"))
        jump = state.select(F.col("node").alias("_best"), F.col("class").alias("_far"))
        return best.join(jump, "_best", "left").select("node", "was", F.least("_best", F.coalesce("_far", "_best")).alias("class"))

    before, state = None, both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("class"))
    while True:
        state = materialize(step(step(state.withColumn("was", F.col("class")))), "classes", narrow=True)
        if before is not None:
            discard(before)
        if not state.where("class < was").limit(1).count():
            discard(both)
            return state.select("node", "class")
        before, state = state, state.select("node", "class")


def joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (doc_id, class) after more ``links`` (a, b): the components of classes, not of all their texts again."""
    of = lambda n: classes.select(F.col("doc_id").alias(n), F.col("class").alias(f"{n}_class"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b")).where("a <> b")
    found = components(ends).withColumnRenamed("class", "_into")
    moved = classes.join(found, F.col("class") == F.col("node"), "left").select("doc_id", F.coalesce("_into", "class").alias("class"))
    new = found.withColumnRenamed("node", "doc_id").join(classes, "doc_id", "left_anti").select("doc_id", F.col("_into").alias("class"))
    return materialize(moved.union(new), "joined", narrow=True)


def own_shingles(bags: DataFrame) -> DataFrame:
    """(doc_id, own): how many of a document's shingles no other of these documents has."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in ((b, part) for b in batches for part in portions(b.column(1), 512, PORTION)):
            shingles, counts = ([np.frombuffer(x, kind) for x in batch.column(k)[part].to_pylist()] for k, kind in ((1, np.int64), (2, np.uint32)))
            ids = np.repeat(batch.column(0)[part].to_numpy(), [len(x) for x in shingles])
            flat, times = np.concatenate(shingles), np.concatenate(counts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(flat), pa.array(times)], ["doc_id", "shingle", "times"])

    flat = bags.mapInArrow(run, "doc_id long, shingle long, times long")
    alone = flat.groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("_last"), F.min("times").alias("times")).where("doc_id = _last")
    return alone.groupBy("doc_id").agg(F.sum("times").alias("own"))


def may_link(size: Column, room: Column, other_size: Column, other_room: Column, similarity: float) -> Column:
    """Whether two bags can be similar, if at most ``room`` of each one's shingles are found elsewhere at all."""
    common = F.least(room, other_room)
    return common >= (size + other_size - common) * similarity


def one_text_an_id(found: DataFrame) -> DataFrame:
    """``found`` (doc_id, text) with one row an id: of several texts the least, so that no order of rows matters."""
    again = materialize(found.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "again", narrow=True)
    if not again.limit(1).count():
        return found
    again = small(again)
    least = found.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return found.join(again, "doc_id", "left_anti").union(least)


def settled(open_: DataFrame, classes: DataFrame, tried: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """``classes`` (doc_id, class) after the links that are left within buckets.

    ``open_`` has (bucket, doc_id, size, alone, within, beyond, odd, buckets) of
    buckets with more than one class. Two texts of different classes are never both
    in a bucket's largest class, so it is enough that each text outside it is once
    held against the others. That goes in rounds: the first ``ASKED`` of a bucket's
    outsiders, those that have least of their own, meet its texts of other classes;
    what they are linked to joins their class, and the next round asks ``MORE``
    times as many of those that are still outside, until none is left unasked. A pair
    is made in the first bucket that both texts are in only, compared once, and not
    made at all if the bounds rule a link out.
    """
    asked, count = None, ASKED
    while True:
        classed = open_.join(classes, "doc_id", "left").withColumn("class", F.coalesce("class", "doc_id"))
        sizes = classed.groupBy("bucket", "class").agg(F.count("*").alias("n"))
        whole = sizes.groupBy("bucket").agg(F.max(F.struct("n", "class"))["class"].alias("largest"), F.count("*").alias("classes"), F.sum("n").alias("n")).where("classes > 1")
        state = materialize(classed.join(whole.select("bucket", "largest", F.ceil(F.col("n") / SLICE).cast("int").alias("slices")), "bucket"), "state")
        waiting = state.where("class <> largest").select("bucket", "doc_id", "alone")
        waiting = waiting if asked is None else waiting.join(asked, ["bucket", "doc_id"], "left_anti")
        first = F.row_number().over(Window.partitionBy("bucket").orderBy("alone", "doc_id"))
        # One more than are asked, to know whether any are left.
        ranked = materialize(waiting.withColumn("_n", first).where(F.col("_n") <= count + 1).select("bucket", "doc_id", "_n"), "asked", narrow=True)
        now = ranked.where(F.col("_n") <= count).select("bucket", "doc_id")
        last = not ranked.where(F.col("_n") > count).limit(1).count()
        asked = now if asked is None else asked.union(now)
        side = ("doc_id", "size", "class", "within", "beyond", "odd", "buckets")
        left = state.join(now, ["bucket", "doc_id"]).select("bucket", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), *side)
        right = state.select("bucket", F.pmod(F.xxhash64("doc_id"), "slices").cast("int").alias("slice"), *(F.col(c).alias(f"other_{c}") for c in side))
        most = F.least("within", "other_within") + F.least("beyond", "other_beyond")
        differ = sum((F.bit_count(F.col("odd")[k].bitwiseXOR(F.col("other_odd")[k])) for k in range(1, SKETCH)), F.bit_count(F.col("odd")[0].bitwiseXOR(F.col("other_odd")[0])))
        enough = lambda common: common >= (F.col("size") + F.col("other_size") - common) * similarity
        here = F.array_min(F.array_intersect("buckets", "other_buckets")) == F.col("bucket")
        met = left.join(right, ["bucket", "slice"]).where((F.col("class") != F.col("other_class")) & enough(most) & enough((F.col("size") + F.col("other_size") - differ) / 2) & here)
        pairs = met.select(F.least("doc_id", "other_doc_id").alias("a"), F.greatest("doc_id", "other_doc_id").alias("b")).distinct()
        more = materialize(overlaps(pairs.join(tried, ["a", "b"], "left_anti"), bags, similarity), "more", narrow=True)
        tried, found = tried.union(more.select("a", "b")), more.where("linked").select("a", "b")
        if found.limit(1).count():
            classes = joined(classes, found)
        discard(state)
        if last:
            return classes
        count *= MORE


def first_copies(signed: DataFrame, texts: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, copy_of) of each document, whose smallest equal one ``texts`` has by digest.

    Texts without words are copies of nothing and meet no one. A digest of a
    ``limit``-th of all rows or more is broadcast, so that no task gets all its rows.
    """
    key = ["key_a", "key_b"]
    some = signed.where("size > 0").select("doc_id", *key)
    often = F.col("rows") * limit > some.count()
    hot = F.broadcast(texts.where(often).select(*key, "copy_of"))
    rest = some.join(hot.select(*key), key, "left_anti").join(texts.where(~often).select(*key, "copy_of"), key)
    alone = signed.where("size = 0").select("doc_id", F.col("doc_id").alias("copy_of"))
    return some.join(hot, key).select("doc_id", "copy_of").unionByName(rest.select("doc_id", "copy_of")).unionByName(alone)


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, copy_of, class_id): one row per row of ``docs`` with an id.

    ``copy_of`` is the smallest id with the same words in the same order (white
    space and case apart); ``class_id`` is the smallest id that links of weighted
    Jaccard similarity of at least ``similarity`` between five-word shingles
    reach. Texts of under five words have one shingle, all their words. Null texts
    and texts without words are copies of nothing and linked to nothing. Rows
    without an id are left out; equal ids are one document, whose rows come back
    apiece; if their texts differ, the least one counts. Ids are integers; a text that
    is none ends the job with an error. An empty table gives no rows.

    Equal texts collapse first. Each distinct text's bands put it in buckets. A
    text is dropped from a bucket if its shingles that other texts have, too, are
    too few for a link with any text as long as the bucket's shortest or longer. In
    a bucket, each text then meets the one that has the fewest shingles of its own,
    as the source of copies has; the pairs' shingles are compared, and the links'
    components are the classes. What is outside a bucket's largest class is then
    held against the bucket's other classes, see ``settled``: two texts share at
    most the less of what each has in common with the one they met, and the less of
    what each shares with any texts beyond that; and they differ in as many shingles
    as their odd sketches (parities of 2048 hashed places) have different bits, at
    least. So a bucket of many copies costs about a pair a text, and no link between
    its texts is lost.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    found = one_text_an_id(rows)
    signed = materialize(sign(found, bands, band_rows), "signed")
    texts = signed.where("size > 0").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("copy_of"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    texts = materialize(texts, "texts")
    placed = texts.select(F.col("copy_of").alias("doc_id"), "size", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("doc_id").alias("_min"), F.max("doc_id").alias("_max")).where("_min < _max").select("bucket")
    placed = materialize(placed.join(shared, "bucket"), "buckets")
    members = materialize(placed.select("doc_id").distinct(), "members", narrow=True)
    bags = materialize(bags_of(found.join(small(members, 500_000), "doc_id")), "bags")

    every = placed.join(own_shingles(bags), "doc_id", "left").withColumn("room", F.col("size") - F.coalesce("own", F.lit(0))).where(F.col("room") >= F.col("size") * similarity)
    every = materialize(every.select("bucket", "doc_id", "size", "room"), "rooms")
    least = every.groupBy("bucket").agg(F.min("size").alias("least"), F.count("*").alias("_n")).where("_n > 1").select("bucket", "least")
    # The likeliest partner that a text may have there: of as many shingles as its room, or of the bucket's fewest if those are more.
    rooms = materialize(every.join(least, "bucket").where(may_link(F.col("size"), F.col("room"), F.greatest("least", "room"), F.col("room"), similarity)).drop("least"), "possible", narrow=True)
    alone = ((F.col("size") - F.col("room")) / F.col("size")).alias("alone")
    centre = rooms.groupBy("bucket").agg(F.min(F.struct(alone, F.col("doc_id").alias("other"), F.col("size").alias("other_size"), F.col("room").alias("other_room"))).alias("c"))
    fits = may_link(F.col("size"), F.col("room"), F.col("other_size"), F.col("other_room"), similarity)
    pair = [F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")]
    stars = materialize(rooms.join(centre.select("bucket", "c.other", "c.other_size", "c.other_room"), "bucket").withColumn("meets", (F.col("doc_id") != F.col("other")) & fits), "stars", narrow=True)
    tried = materialize(overlaps(stars.where("meets").select(*pair).distinct(), bags, similarity), "tried", narrow=True)
    reached = components(tried.where("linked").select("a", "b")).withColumnRenamed("node", "doc_id")

    classed = stars.join(reached, "doc_id", "left").withColumn("class", F.coalesce("class", "doc_id"))
    several = classed.groupBy("bucket").agg(F.min("class").alias("_min"), F.max("class").alias("_max")).where("_min < _max").select("bucket")
    # What a text shares with its bucket's centre, and what it shares with others beyond that; upper bounds where they have not met.
    met = stars.join(several, "bucket").withColumns({"a": pair[0], "b": pair[1]}).join(tried.select("a", "b", "common"), ["a", "b"], "left")
    met = materialize(met.select("bucket", "doc_id", "size", alone, F.coalesce("common", "room").alias("within"), (F.col("room") - F.coalesce("common", F.lit(0))).alias("beyond")), "met", narrow=True)
    theirs = met.groupBy("doc_id").agg(F.array_sort(F.collect_list("bucket")).alias("buckets"))
    open_ = materialize(met.join(theirs, "doc_id").join(bags.select("doc_id", "odd"), "doc_id"), "open")
    reached = settled(open_, reached, tried.select("a", "b"), bags, similarity).withColumnRenamed("doc_id", "copy_of")
    copies = first_copies(signed, texts)
    out = copies.join(reached, "copy_of", "left").select("doc_id", "copy_of", F.coalesce("class", "copy_of").alias("class_id"))
    if found is not rows:
        out = rows.select("doc_id").join(out, "doc_id")
    discard(members, bags, placed, every, rooms, stars, tried, met, open_)
    return out


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of ``near_classes``: that of the smallest id. Rows without an id stay.

    Where an id is repeated, its row with the least text stays, of those the first as JSON.
    """
    found = materialize(near_classes(docs, doc_id=doc_id, text=text, **options), "classes")
    gone = small(materialize(found.where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone"))
    again = small(materialize(found.groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again"), "again", narrow=True))
    kept = docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")
    if not again.limit(1).count():
        return kept
    repeated = kept.join(again, kept[doc_id] == again["_again"], "left_semi")
    (place,) = fresh(docs, "_place")
    order = Window.partitionBy(doc_id).orderBy(F.asc_nulls_first(text), F.to_json(F.struct(*docs.columns)))
    repeated = repeated.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return kept.join(again, kept[doc_id] == again["_again"], "left_anti").unionByName(repeated)
