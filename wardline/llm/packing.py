"""Vector bin packing of examples into fixed-length sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import need
from wardline.llm.tokens import WordIds, load, word_ids

CAPACITY, MAX_SEGMENTS, MAX_LOSS = 4096, 1024, 4096
#: Examples are packed in groups of about so many ids; a group is all that a task holds.
GROUP_IDS, GROUP_ROWS = 1 << 20, 4096
END_ID = 2
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "loss_tokens long, segment long")


def loss_of(length: np.ndarray | int):
    """Ids of a segment that bear loss: all but the first, which nothing in its segment predicts."""
    return np.maximum(length - 1, 0)


def power_below(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def pack(lengths: np.ndarray, losses: np.ndarray | None = None, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS,
         max_loss: int = MAX_LOSS) -> list[list[tuple[int, int, int]]]:
    """Place examples of ``lengths`` ids under three limits a sequence: ids, segments, ids that bear loss.

    Dot-product heuristic: while a sequence is open, among the examples that fit in all three, take the one whose demand
    (as parts of the limits, weighed by what all examples together still demand of each) has the largest dot product with
    the room that is left. When none fits, cut the largest one so that it fills the ids; the rest of it stays in play. A sequence
    that must close below ``capacity`` gives up its last pieces until it holds a power of two.

    Returns sequences of ``(example, start, length)``. Every id lies in exactly one piece; an example of no ids gives none.
    ``losses``: loss-bearing ids per example if they are not ``loss_of``; such an example is never cut unless it exceeds a
    limit, and a cut piece bears its share, rounded up.
    """
    left = np.asarray(lengths, dtype=np.int64).copy()
    start = np.zeros(len(left), np.int64)
    own = None if losses is None else np.asarray(losses, dtype=np.int64)
    limits = np.array([capacity, max_segments, max_loss], float)

    def loss(i, n):
        return loss_of(n) if own is None else -(-own[i] * n // np.maximum(lengths[i], 1))

    lengths = left.copy()
    sequences: list[list[tuple[int, int, int]]] = []
    alive = np.flatnonzero(left > 0)
    alive = alive[np.argsort(-left[alive], kind="stable")]
    # Whole sequences out of long examples first.
    whole = capacity if own is not None or max_loss + 1 >= capacity else power_below(max_loss + 1)
    for i in alive:
        while left[i] >= capacity and loss(i, whole) <= max_loss:
            sequences.append([(int(i), int(start[i]), whole)])
            start[i] += whole
            left[i] -= whole
    alive = alive[left[alive] > 0]
    if own is None:
        return sequences + _pack_lengths(alive, left, start, capacity, max_segments, max_loss)
    while len(alive):
        room, bin_ = np.array([capacity, max_segments, max_loss]), []
        use = np.stack([left[alive], np.ones(len(alive), np.int64), loss(alive, left[alive])])
        weight = use.sum(1) / limits / limits
        taken = np.zeros(len(alive), bool)
        score = use * weight[:, None] / limits[:, None]
        while room[0] > 0 and room[1] > 0:
            fits = ~taken & (use[0] <= room[0]) & (use[2] <= room[2])
            if fits.any():
                value = room @ score
                value[~fits] = -1.0
                k = int(np.argmax(value))
                cut = int(use[0, k])
            else:
                rest = np.flatnonzero(~taken)
                if not len(rest):
                    break
                k = int(rest[np.argmax(use[0, rest])])
                cut = int(min(room[0], use[0, k]))
                while cut > 0 and loss(alive[k], cut) > room[2]:
                    cut = int(min(cut - 1, room[2] + 1 if own is None else cut * room[2] // max(1, loss(alive[k], cut))))
                if cut <= 0:
                    break
            i = alive[k]
            bin_.append((int(i), int(start[i]), cut))
            room -= np.array([cut, 1, loss(i, cut)])
            start[i] += cut
            left[i] -= cut
            taken[k] = True  # what is left of a cut example goes to a later sequence
        if not bin_:
            raise ValueError("an example exceeds the limits even when cut to one id")
        _round_down(bin_, capacity, left, start)
        sequences.append(bin_)
        alive = alive[left[alive] > 0]
        alive = alive[np.argsort(-left[alive], kind="stable")]
    return sequences


def _round_down(bin_: list[tuple[int, int, int]], capacity: int, left: np.ndarray, start: np.ndarray) -> list[int]:
    """Take pieces off the end of a sequence below ``capacity`` until it holds a power of two; examples that got ids back."""
    total, back_to = sum(n for _, _, n in bin_), []
    if total < capacity and total != power_below(total):
        surplus = total - power_below(total)
        while surplus:
            i, s, n = bin_.pop()
            back = min(n, surplus)
            surplus -= back
            left[i] += back
            start[i] -= back
            back_to.append(i)
            if n > back:
                bin_.append((i, s, n - back))
    return back_to


def _pack_lengths(
    alive: np.ndarray, left: np.ndarray, start: np.ndarray, capacity: int, max_segments: int, max_loss: int,
) -> list[list[tuple[int, int, int]]]:
    """``pack`` where the loss follows from the length: the dot product then grows with the length, whatever room is left, so the
    best example is the longest that fits. Examples wait in one stack a length, and a placement is a binary search."""
    sequences, stacks = [], {}
    for i in alive[::-1].tolist():
        stacks.setdefault(int(left[i]), []).append(i)
    lengths = sorted(stacks)

    def put(i: int) -> None:
        n = int(left[i])
        if n not in stacks:
            stacks[n] = []
            insort(lengths, n)
        stacks[n].append(i)

    def take(at: int) -> int:
        n = lengths[at]
        i = stacks[n].pop()
        if not stacks[n]:
            del stacks[n], lengths[at]
        return i

    while lengths:
        ids, segments, loss, bin_, again = capacity, max_segments, max_loss, [], set()
        while ids > 0 and segments > 0 and lengths:
            fit = min(ids, loss + 1)
            at = bisect_right(lengths, fit) - 1
            if at < 0 and fit <= 0:
                break
            i = take(at)  # the longest that fits or, if none does, the longest of all, which is cut
            n = min(fit, int(left[i]))
            bin_.append((i, int(start[i]), n))
            ids, segments, loss = ids - n, segments - 1, loss - (n - 1)
            start[i] += n
            left[i] -= n
            if left[i]:
                again.add(i)  # what is left of a cut example goes to a later sequence
        if not bin_:
            raise ValueError("an example exceeds the limits even when cut to one id")
        again.update(_round_down(bin_, capacity, left, start))
        for i in sorted(again):
            put(i)
        sequences.append(bin_)
    return sequences


def sign_ids(tokenizer: str, end_id: int = END_ID) -> list[int]:
    """Ids of signs and spaces alone: their text holds no letter and no digit. ``end_id`` is none."""
    made = load(tokenizer)
    texts = [(i, token.removesuffix("</w>")) for token, i in made.get_vocab().items()]
    return sorted(i for i, t in texts if i != end_id and t and not any(c.isalnum() for c in t))


def groups(batches: Iterator[pa.RecordBatch], words: WordIds, end_id: int) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Tokenized rows, gathered up to the size of a group."""
    held, size = [], 0
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        lengths = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
        at = 0
        while at < batch.num_rows:
            stop, chars = at, 0
            while stop < batch.num_rows and stop - at < 512 and chars < 1 << 20:  # a part's words are some 20 times its size
                chars += lengths[stop]
                stop += 1
            part = texts.slice(at, stop - at).to_pylist()
            for doc, row in zip(ids.slice(at, stop - at).to_pylist(), words.many(part)):
                row = np.append(row, np.uint32(end_id)).astype("<u4")
                held.append((doc, row))
                size += len(row)
                if size >= GROUP_IDS or len(held) >= GROUP_ROWS:
                    yield held
                    held, size = [], 0
            at = stop
    if held:
        yield held


def pack_documents(
    docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, end_id: int = END_ID, with_ids: bool = False, quiet: Sequence[int] = (),
    remembered: int | None = None,
) -> DataFrame:
    """Pieces of all documents in sequences: columns ``PIECES``, and ``ids array<int>`` if asked for.

    A document is the ids of its whole text and ``end_id``; null and empty texts are ``end_id`` alone; rows with a null or
    repeated id are documents of their own. Text is tokenized and packed where it is scanned: nothing is shuffled, no id
    leaves its task except in a piece, and a task holds one group of about ``GROUP_IDS`` ids (or one longer document). Each
    group ends in a few sequences whose lengths are powers of two, so nothing needs padding. A sequence is numbered by
    partition and place; a task that runs again gives the same rows.

    ``quiet``: ids that bear no loss. An example's demand then is a vector of its own, ids and loss apart, and the dot product
    chooses; without them loss follows from length, and its choice is the longest that fits. ``remembered``: pieces of text whose ids
    a worker keeps (``tokens.MEMORY``), and once more as many older ones; fewer cost time and save memory, the ids are the same.
    """
    need(docs, [id, text])
    silent = np.unique(np.asarray(quiet, np.int64))

    def bearing(ids: np.ndarray) -> np.ndarray:
        """Whether each id of a segment bears loss: not the first, which nothing predicts, and no quiet one."""
        out = np.ones(len(ids), bool) if not len(silent) else ~muted[np.minimum(ids, len(muted) - 1)]
        out[:1] = False
        return out

    muted = np.zeros(int(silent[-1]) + 2 if len(silent) else 1, bool)
    muted[silent] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sequence = word_ids(tokenizer, remembered), TaskContext.get().partitionId() << 36
        for group in groups(batches, words, end_id):
            rows, parts = [], []
            for bin_ in pack(
                    np.array([len(x) for _, x in group]), np.array([bearing(x).sum() for _, x in group]) if len(silent) else None,
                    capacity, max_segments, max_loss):
                at = 0
                for k, (i, start, n) in enumerate(bin_):
                    doc, ids = group[i]
                    piece = ids[start:start + n]
                    rows.append((doc, start, n, zlib.crc32(piece.tobytes()), len(ids), sequence, at, int(bearing(piece).sum()), k))
                    if with_ids:
                        parts.append(piece)
                    at += n
                sequence += 1
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            names = [x.split()[0] for x in PIECES.split(", ")]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts).astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
