"""Packing token sequences into windows: bounded-space best fit within partitions, then a tree of merges."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import arrow_rows, coded_words, give_back, materialize, portions, ranges, tidy, worker_memory

WINDOW = 2048
OPEN_WINDOWS = 16
#: A window with this much room or more is filled up with the head of the next piece; a smaller gap is padded.
MIN_CUT = 32
#: How many partitions' leftover windows one merging task takes.
FAN_IN = 16
END_ID = 1
#: Texts that are encoded at once, and their bytes, unless one alone has more.
TEXTS, STEP = 2048, 1 << 20
#: Words that the tokenizer gets at once.
WORDS = 1000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, is_open boolean, part long"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *((x, pa.int64()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary()), ("is_open", pa.bool_()), ("part", pa.int64())]
)


class Packer:
    """At most ``windows`` open windows of ``size`` tokens.

    A piece is (doc_id, start, ids as bytes of 4 a token, doc_tokens). It goes
    into the fullest window that has room; if none has, a new window opens, or
    the fullest is emitted to make room, filled up first where the gap is worth a cut.
    """

    def __init__(self, emit, size: int, windows: int, min_cut: int):
        self.emit, self.size, self.windows, self.min_cut = emit, size, windows, min_cut
        self.order: list[tuple[int, int]] = []  # (tokens, window), sorted
        self.held: dict[int, list] = {}
        self.count = 0

    def add(self, doc_id, start: int, ids: bytes, total: int) -> None:
        step = 4 * self.size
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            self.emit([(doc_id, start + at // 4, ids[at : at + step], total)], False)
        start, ids = start + whole // 4, ids[whole:]
        while ids:
            n = len(ids) // 4
            at = bisect_right(self.order, (self.size - n, 1 << 62)) - 1
            if at >= 0:
                return self._put(at, (doc_id, start, ids, total))
            if len(self.order) < self.windows:
                return self._open((doc_id, start, ids, total))
            room = self.size - self.order[-1][0]
            if room >= self.min_cut:
                self._put(len(self.order) - 1, (doc_id, start, ids[: 4 * room], total))
                start, ids = start + room, ids[4 * room :]
            else:
                self.emit(self.held.pop(self.order.pop()[1]), False)

    def _open(self, piece) -> None:
        self.count += 1
        self.held[self.count] = [piece]
        insort(self.order, (len(piece[2]) // 4, self.count))

    def _put(self, at: int, piece) -> None:
        used, key = self.order.pop(at)
        self.held[key].append(piece)
        if (used := used + len(piece[2]) // 4) == self.size:
            self.emit(self.held.pop(key), False)
        else:
            insort(self.order, (used, key))

    def leave(self) -> None:
        """Hand out the windows still open, as leftovers."""
        for _, key in reversed(self.order):
            self.emit(self.held.pop(key), True)
        self.order = []

    def close(self) -> None:
        """Fill window after window with what is left; only the last one needs padding."""
        rest = [p for _, key in reversed(self.order) for p in self.held.pop(key)]
        self.order, window, room = [], [], self.size
        for doc_id, start, ids, total in rest:
            while ids:
                head = ids[: 4 * room]
                window.append((doc_id, start, head, total))
                start, ids, room = start + len(head) // 4, ids[len(head) :], room - len(head) // 4
                if not room:
                    self.emit(window, False)
                    window, room = [], self.size
        if window:
            self.emit(window, False)


class _Rows:
    """Collects emitted windows as rows. Sequence ids: the round, the task and a count within it."""

    def __init__(self, first_id: int, part: int, keep_ids: bool):
        self.next, self.part, self.keep_ids, self.rows = first_id, part, keep_ids, []

    def emit(self, pieces, is_open: bool) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next, offset, ids if is_open or self.keep_ids else None, is_open, self.part))
            offset += n
        self.next += 1

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(_SCHEMA)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


class Encoder:
    """Texts -> token ids, word by word, each distinct word once.

    The tokenizer of ``path`` never joins what white space parts, and ends each of
    its own words with a token of a kind that stands nowhere else. So many plain
    words (Latin letters, perhaps one comma or stop) are encoded as one text, which
    is cut after the right number of such tokens; other words are encoded one by
    one. This holds for tokenizers with word ends that drop white space, such as
    word_bpe_49k. Beyond ``limit`` words, or ``WORD_BYTES`` times as many bytes of
    them, those are forgotten that one step alone had: most words of a corpus are
    seen once. Words are kept as an Arrow array, a tenth of what a dict of them takes:
    a worker of each core keeps them beside all that runs before and after.
    """

    WORD_BYTES = 64

    def __init__(self, path: str, limit: int = 400_000, word_end: str = "</w>"):
        # Spark runs a task for each core; threads of the library would only contend.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith(word_end)]] = True
        # Latin letters up to U+024F but U+0130, whose lower case has a combining dot.
        self.plain = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+[,.]?").fullmatch
        self._reset()
        del vocabulary
        give_back()  # what reading the tokenizer took

    def _reset(self) -> None:
        self.known, self.used = pa.array([], pa.string()), 0
        self.first, self.length, self.pool, self.steps = (np.zeros(1 << 16, dtype=t) for t in (np.int64, np.int32, np.uint32, np.int32))

    def _forget(self) -> None:
        """Keep the words of several steps, or none, if they are more than half of all that may be kept."""
        often = np.flatnonzero(self.steps[: len(self.known)] > 1)
        if 2 * len(often) > self.limit:
            return self._reset()
        words, sizes = self.known.take(pa.array(often)), self.length[often]
        ids = self.pool[ranges(self.first[often], sizes)]
        if words.nbytes > self.WORD_BYTES * self.limit:
            return self._reset()
        self._reset()
        self._add(words, sizes, ids)
        self.steps[: len(often)] = 1

    def _alone(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        """(ids of all words, how many each has)."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter((i for x in ids for i in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        parts = np.fromiter((2 if w[-1] in ",." else 1 for w in words), np.int64, len(words))
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != parts.sum():
            return self._alone(words)
        return ids, np.diff(ends[np.cumsum(parts) - 1], prepend=0)

    def _learn(self, words: list[str]) -> None:
        plain, other = [], []
        for w in words:
            (plain if self.plain(w) else other).append(w)
        done = [encode(some[k : k + WORDS]) for encode, some in ((self._together, plain), (self._alone, other)) for k in range(0, len(some), WORDS)]
        sizes, flat = (np.concatenate([x[k] for x in done]) for k in (1, 0))
        self._add(pa.array(plain + other, pa.string()), sizes, flat)

    def _add(self, words: pa.Array, sizes: np.ndarray, flat: np.ndarray) -> None:
        at, end = len(self.known), self.used + len(flat)
        for name, need in (("first", at + len(words)), ("length", at + len(words)), ("steps", at + len(words)), ("pool", end)):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(len(held), need), held.dtype)]))
        self.pool[self.used : end] = flat
        self.length[at : at + len(words)] = sizes
        self.first[at : at + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used = end
        self.known = pa.concat_arrays([self.known, words])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each text's first id and the end)."""
        if len(self.known) > self.limit or self.known.nbytes > self.WORD_BYTES * self.limit:
            self._forget()
        words, at, bounds = coded_words(texts)
        rows, before = pc.index_in(words, self.known), len(self.known)
        if new := [w for w in words.filter(pc.is_null(rows)).to_pylist() if w]:
            self._learn(new)
            rows = pc.coalesce(rows, pc.add(pc.index_in(words, self.known.slice(before)), before))
        rows = pc.fill_null(rows, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(rows):
            self.steps[rows] += 1  # the words are distinct
        rows = rows[at]
        length = self.length[rows]
        ends = np.concatenate([[0], np.cumsum(length)])
        return self.pool[ranges(self.first[rows], length)], ends[bounds]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, open_windows: int = OPEN_WINDOWS,
    min_cut: int = MIN_CUT, fan_in: int = FAN_IN, end_id: int = END_ID, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    A document's ids are its text's tokens and ``end_id``. Documents of ``window``
    ids and more are cut into whole windows and a rest. Each task packs its own
    partition as it reads it, with ``open_windows`` windows in memory; nothing is
    shuffled but the windows left open, which are merged by the same packing,
    ``fan_in`` partitions at a time, until one group is left; what is open then
    is laid end to end. So only the very last sequence may have more padding
    than ``min_cut``. A sequence has at most ``window`` ids, offsets without gaps.

    A null text counts as empty and has the end id alone; empty tables give no
    rows; repeated rows are packed apiece; null ids stay null, and a text as an id that
    is no integer ends the job with an error. ``ids`` (bytes of 4
    an id) is filled where ``keep_ids``.
    """

    @tidy(keeps="encoders")
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = _Rows(part << 32, part, keep_ids)
        packer = Packer(rows.emit, window, open_windows, min_cut)
        end = end_id.to_bytes(4, "little")
        memory = worker_memory("encoders")
        encoder = memory.get(tokenizer_path) or memory.setdefault(tokenizer_path, Encoder(tokenizer_path))
        for batch in batches:
            names = batch.column(0).to_pylist()
            for some in portions(batch.column(1), TEXTS, STEP):
                ids, bounds = encoder.encode(batch.column(1)[some])
                for i, a, b in zip(names[some], bounds, bounds[1:]):
                    packer.add(i, 0, ids[a:b].tobytes() + end, int(b - a) + 1)
            yield rows.take()
        packer.leave()
        yield rows.take()

    def merge(depth: int, last: bool):
        def run(key, table):
            part = key[0].as_py()
            rows = _Rows((depth << 56) + (part << 32), part, keep_ids)
            packer = Packer(rows.emit, window, open_windows, min_cut)
            order = table.sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
            for i, start, ids, total in zip(*(order.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
                packer.add(i, start, ids, total)
            packer.close() if last else packer.leave()
            return pa.Table.from_batches([rows.take()])

        return run

    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with arrow_rows(docs.sparkSession, TEXTS):
        packed = materialize(found.mapInArrow(first, PIECES), "packed")
    done, left, depth = packed.where("not is_open"), packed.where("is_open"), 0
    parts = (packed.agg(F.max("part")).first()[0] or 0) + 1
    while depth == 0 or parts > 1:
        parts, depth = -(-parts // fan_in), depth + 1
        groups = left.withColumn("group", F.floor(F.col("part") / fan_in).cast("long"))
        merged = materialize(groups.groupBy("group").applyInArrow(merge(depth, parts == 1), PIECES), "merged")
        done, left = done.unionByName(merged.where("not is_open")), merged.where("is_open")
    return done.drop("is_open", "part", *([] if keep_ids else ["ids"]))
