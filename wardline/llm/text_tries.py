"""Audit of how document filters interact, with exact duplicates found in tries of whole texts."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import need, shuffle_partitions

FILTERS = "ABCDE"
#: Bits of a mask: bit i is set when the text fails FILTERS[i].
DUPLICATE = 1 << FILTERS.index("E")
MIN_WORDS, SIGNS = 200, b"#$%&*|"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Texts that a task holds in a trie before the shuffle, and that one trie is meant to hold after it: as much as gives every
#: shuffle partition a cell, but no less than LEAST_BYTES and no more than CELL_BYTES.
BLOCK_BYTES, CELL_BYTES, LEAST_BYTES = 16 << 20, 32 << 20, 1 << 20
#: A prefix that is too heavy is split by so many further bytes behind what all its texts share. For that, so many bytes of
#: a text are compared in the first round, and twice as many in each later one up to the most.
SPLIT_BYTES, SHARED_BYTES, MOST_SHARED = 2, 1024, 1 << 16
#: Rounds of splitting for the cells. Near copies part at every place where one was edited, a round each; what is still too
#: heavy then is dealt to several cells by a hash of the whole text, which equal texts share.
ROUNDS = 3


def mask_of(text: bytes) -> int:
    """Bits of A to D for a text in UTF-8; ``bytes.split`` cuts at exactly the six separators."""
    words = text.split()
    n, chars = len(words), len(text.decode("utf-8", "replace"))
    upper = len(text) - len(text.translate(None, _UPPER))
    return ((n < MIN_WORDS) | (100 * len(set(words)) < 50 * n) << 1 | (100 * upper > 2 * chars) << 2
            | (len(text.translate(None, SIGNS)) != len(text)) << 3)


def shared(a: bytes, b: bytes) -> int:
    """Length of the longest prefix that both have."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is shared, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Trie:
    """Compressed radix trie of whole texts. A node is ``[label, children by first byte, terminal]``; a terminal is
    ``[smallest id, entries]`` of the texts that end there."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]

    def insert(self, text: bytes) -> list:
        """The text's terminal; new ones hold no id yet."""
        node, at = self.root, 0
        while at < len(text):
            children = node[1]
            child = children.get(text[at])
            if child is None:
                child = children[text[at]] = [text[at:], {}, None]
                at = len(text)
            elif text.startswith(child[0], at):
                at += len(child[0])
            else:
                n = shared(child[0], text[at:at + len(child[0])])
                upper = children[text[at]] = [child[0][:n], {child[0][n]: child}, None]
                child[0] = child[0][n:]
                child = upper
                at += n
            node = child
        if node[2] is None:
            node[2] = [None, []]
        return node[2]

    def add(self, text: bytes, id: int, entry: tuple) -> None:
        terminal = self.insert(text)
        if terminal[0] is None or id < terminal[0]:
            terminal[0] = id
        terminal[1].append((id, *entry))

    def terminals(self) -> Iterator[tuple[bytes, int, list]]:
        """``(text, smallest id, entries)`` of every distinct text, in byte order, without recursion."""
        stack = [(self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            text = prefix + node[0]
            if node[2] is not None:
                yield text, *node[2]
            stack.extend((node[1][b], text) for b in sorted(node[1], reverse=True))


def cut_points(texts: DataFrame, cell_bytes: int) -> list[bytes]:
    """Prefixes that cut all texts, in byte order, into ranges of about ``cell_bytes`` each, however many rounds that takes."""
    return [prefix for prefix, _ in ranges(texts, cell_bytes)[1:]]


def ranges(texts: DataFrame, cell_bytes: int, rounds: int | None = None) -> list[tuple[bytes, int]]:
    """``(first prefix, cells)`` of ranges of all texts in byte order, of about ``cell_bytes`` a cell. ``texts``: one binary column.

    A radix tree grows from the root: each round weighs, over all texts, the next bytes behind the prefixes that are still too
    heavy; a heavy one is then split behind what all of its texts share, so one round passes a long common head. A prefix
    whose texts are all equal (by hash) stays whole. One that is too heavy after the last of ``rounds`` is a range of several
    cells. The driver gets one row per child of a heavy prefix.
    """
    open_, leaves, heavy, reach, round_ = {b""}, [], {}, SHARED_BYTES, 0
    whole = F.col(texts.columns[0])
    while open_:
        round_ += 1
        last = round_ == rounds
        reach = 1 if last else reach  # nothing is split behind a shared head any more
        lengths = sorted({len(p) for p in open_}, reverse=True)
        wanted, compared = frozenset(open_), reach

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[tuple[int, bytes], list] = {}
            for batch in batches:
                for text, size, h in zip(*(c.to_pylist() for c in batch.columns)):
                    for n in lengths:
                        if len(text) >= n and text[:n] in wanted:
                            child = text[:n + SPLIT_BYTES]
                            head = text[:len(child) + compared]
                            held = seen.get((n, child))
                            if held is None:
                                seen[n, child] = [size + 64, head, head, h, h]
                            else:
                                held[0] += size + 64
                                held[1], held[2] = min(held[1], head), max(held[2], head)
                                held[3], held[4] = min(held[3], h), max(held[4], h)
                            break
            columns = list(zip(*((n, c, *v) for (n, c), v in seen.items()))) or [()] * 7
            types = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["n", "child", "weight", "low", "high", "least", "most"])

        heads = texts.select(
            F.substring(whole, 1, lengths[0] + SPLIT_BYTES + reach), F.octet_length(whole).cast("long"), F.xxhash64(whole))
        found = heads.mapInArrow(weigh, "n long, child binary, weight long, low binary, high binary, least long, most long").groupBy(
            "n", "child").agg(F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high"),
                              (F.min("least") == F.max("most")).alias("equal"))
        # Heads travel only for prefixes that are split further.
        split = (F.col("weight") > cell_bytes) & ~F.col("equal")
        rows = found.select("n", "child", "weight", F.when(split, F.col("low")).alias("low"), F.when(split, F.col("high")).alias("high")).collect()
        open_ = set()
        for r in rows:
            child = bytes(r["child"])
            if r["low"] is None or len(child) < r["n"] + SPLIT_BYTES:  # light, one text, or texts that end here
                leaves.append((child, r["weight"]))
            elif last:
                heavy[child] = -(-r["weight"] // cell_bytes)
                leaves.append((child, r["weight"]))
            else:
                low = bytes(r["low"])
                open_.add(low[:shared(low, bytes(r["high"]))])
        reach = min(2 * reach, MOST_SHARED)
    made, held = [(b"", 1)], 0
    for prefix, weight in sorted(leaves):
        if held and held + weight > cell_bytes:
            made.append((prefix, 1))
            held = 0
        held += weight
        if prefix in heavy:  # its range is its own: held is above the limit, so the next prefix begins another
            made[-1] = made[-1][0], heavy[prefix]
    return made


ROWS = "cell int, text binary, doc_id long, part string, mask int, n long"


def masks(docs: DataFrame, *, id: str = "doc_id", text: str = "text", part: str = "source", cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``doc_id, part, mask, n``: how many rows of an id and part fail which of the five filters.

    A task first puts its rows into tries of ``BLOCK_BYTES``. A row whose text the block holds under a smaller id is a duplicate
    for sure and goes on without its text; of each distinct text one row per id, part and block travels. Ranges of
    texts between adaptive prefixes, and hashes within a range that stayed too heavy, are the cells of the shuffle; each cell is
    one trie, whose terminals hold the smallest id of their text. A task holds one cell at a time.

    A null text is empty, a null part too. A row with a null id is no duplicate and makes none; rows of one id and text
    are none of each other.
    """
    need(docs, [id, text, part])
    source = docs.select(
        F.col(id).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8").alias("text"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    spark = docs.sparkSession
    total = source.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0]
    wanted = min(cell_bytes, max(LEAST_BYTES, (total or 0) // shuffle_partitions(spark)))
    parted = ranges(source.select("text"), wanted, ROUNDS) if total else [(b"", 1)]
    cuts, parts = [prefix for prefix, _ in parted[1:]], [n for _, n in parted]
    begins = list(accumulate(parts, initial=0))
    cells = begins.pop()

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, size, out = Trie(), 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            for whole, least, entries in trie.terminals():
                kept: dict[tuple, int] = {}
                for doc, name, mask in entries:
                    kept[doc, name, mask] = kept.get((doc, name, mask), 0) + 1
                at = bisect_right(cuts, whole)
                cell = begins[at] + (zlib.crc32(whole) % parts[at] if parts[at] > 1 else 0)
                for (doc, name, mask), n in kept.items():
                    if doc == least:
                        out.append((cell, whole, doc, name, mask, n))
                    else:
                        out.append((zlib.crc32(b"%d" % doc) % cells, None, doc, name, mask | DUPLICATE, n))
            yield from made()

        def made() -> Iterator[pa.RecordBatch]:
            types = (pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int64())
            names = [x.split()[0] for x in ROWS.split(", ")]
            for at in range(0, len(out), 4096):
                columns = zip(*out[at:at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            out.clear()

        spread = 0
        for batch in batches:
            for doc, whole, name in zip(*(c.to_pylist() for c in batch.columns)):
                mask = mask_of(whole)
                if doc is None:
                    out.append((spread % cells, None, None, name, mask, 1))
                    spread += 1
                    continue
                trie.add(whole, doc, (name, mask))
                size += len(whole) + 64
                if size >= BLOCK_BYTES:
                    yield from flush()
                    trie, size = Trie(), 0
        yield from flush()

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        counts: dict[tuple, int] = {}
        for batch in batches:
            for whole, doc, name, mask, n in zip(*(c.to_pylist() for c in batch.columns)):
                if whole is None:
                    counts[doc, name, mask] = counts.get((doc, name, mask), 0) + n
                else:
                    trie.add(whole, doc, (name, mask, n))
        for _, least, entries in trie.terminals():
            for doc, name, mask, n in entries:
                key = doc, name, mask | (DUPLICATE if doc > least else 0)
                counts[key] = counts.get(key, 0) + n
        rows = [(*k, n) for k, n in counts.items()]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows[at:at + 10_000]), (pa.int64(), pa.string(), pa.int32(), pa.int64()))],
                ["doc_id", "part", "mask", "n"])

    sent = source.select("doc_id", "text", "part").mapInArrow(before, ROWS)
    placed = sent.repartitionById(cells, F.col("cell")).drop("cell")
    return placed.mapInArrow(after, "doc_id long, part string, mask int, n long")


def orders(spark) -> DataFrame:
    """What each mask adds at each step of each of the 120 orders; a fixed table of 19,200 rows."""
    rows = []
    for order in permutations(FILTERS):
        bits = [1 << FILTERS.index(f) for f in order]
        for mask in range(1 << len(FILTERS)):
            at = next((i for i, b in enumerate(bits) if mask & b), len(bits))  # the step that removes it
            share = 120 // mask.bit_count() if mask else 0  # orders in which a given failing filter comes first of them
            for i, b in enumerate(bits):
                rows.append(("".join(order), i + 1, mask, int(at > i), int(at == i), int(bool(mask & b) and at < i), int(mask == b),
                             share if mask & b else 0))
    return spark.createDataFrame(
        rows, "filter_order string, step int, mask int, kept_x long, removed_x long, redundant_x long, unique_x long, shapley_x long")


def audit(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", part: str = "source", **sizes: int) -> DataFrame:
    """``part, filter_order, step`` and the counts ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    One row per part (null: empty) of ``docs``, order of the five filters and step, zeros included; no rows for an empty
    table. ``labels``: ``doc_id, quality, toxic``; an id that stands there more than once counts as good or toxic if any of its rows
    says so, ids that are null or missing there are neither. Texts are reduced to counts by part and mask before anything
    is multiplied by the orders; only ids and masks meet the labels.
    """
    need(labels, ["doc_id", "quality", "toxic"])
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("long")).alias("good"),
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("long")).alias("toxic"))
    found = masks(docs, id=id, text=text, part=part, **sizes).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    known = found.join(flags, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    total = lambda value, weight, name: F.sum(F.col(value) * F.col(weight)).alias(name)
    return known.join(F.broadcast(orders(docs.sparkSession)), "mask").groupBy("part", "filter_order", "step").agg(
        total("n", "kept_x", "kept"), total("n", "removed_x", "removed"), total("n", "redundant_x", "redundant"),
        total("n", "unique_x", "unique_fails"), total("good", "removed_x", "good_lost"), total("toxic", "removed_x", "toxic_lost"),
        total("n", "shapley_x", "shapley"))
