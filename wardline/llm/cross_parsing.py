"""Language of a text by cross-parsing against labelled text of each language."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut, need

#: Labelled text that teaches one language: about so many characters, in blocks spread evenly over all its labelled text.
SAMPLE_CHARS, BLOCK = 60_000, 500
#: Letters with a symbol of their own; rarer ones share ``HASHED`` symbols.
OWN, HASHED = 1000, 1000
GAP, FIRST = 1, 2
END_OF_BLOCK = FIRST + OWN + HASHED
ALPHABET = END_OF_BLOCK + 1
#: A phrase ends where a window of so many symbols ends; a text of more characters than PART is taken part by part.
WINDOW, PART, SLICE_ROWS = 512, 1 << 21, 1024
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter, 0 for all that is no letter."""
    made = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            made[cp] = ord(c.lower()[0])
    return made


def symbol_table(own: list[int]) -> np.ndarray:
    """Code point -> symbol: GAP for what is no letter, one symbol for each of ``own``, a shared one for other letters."""
    low = letters()
    lower = (FIRST + OWN + np.arange(0x110000, dtype=np.uint32) % HASHED).astype(np.uint16)
    lower[np.array(own, np.int64)] = FIRST + np.arange(len(own))
    return np.where(low > 0, lower[low], GAP).astype(np.uint16)


def without_runs(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which symbols stay when each run of gaps becomes one; ``first`` marks where a text starts."""
    gap = symbols == GAP
    before = np.concatenate([[False], gap[:-1]]) & ~first
    return ~(gap & before)


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of ``text``; state 0 is its start."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] != length[p] + 1:
                twin = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = twin
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                q = twin
            link[new] = q
        last = new
    return edges


def packed(edges: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions as arrays: state s goes on symbol c to ``target[base[s] + c]`` if ``owner[base[s] + c] == s``.

    States with most edges are placed first, each at the first base whose slots are all free; the many states of one edge
    then fill the holes.
    """
    n_edges = sum(map(len, edges))
    base = np.zeros(len(edges), np.int32)
    owner = np.full(2 * n_edges + 4 * ALPHABET, -1, np.int32)
    target = np.zeros_like(owner)
    taken = np.zeros(len(owner), bool)
    taken[:ALPHABET] = True  # so that no base is negative
    low = ALPHABET
    many = sorted((s for s, e in enumerate(edges) if len(e) > 1), key=lambda s: -len(edges[s]))
    for s in many:
        cs = np.array(sorted(edges[s]), np.int64)
        while taken[low]:
            low += 1
        at, width = low, 256
        while True:
            if at + width + 2 * ALPHABET > len(taken):
                more = len(taken)
                owner, target = np.append(owner, np.full(more, -1, np.int32)), np.append(target, np.zeros(more, np.int32))
                taken = np.append(taken, np.zeros(more, bool))
            free = at + np.flatnonzero(~taken[at:at + width])
            fits = free[~taken[(free - cs[0])[:, None] + cs].any(1)] if len(free) else free
            if len(fits):
                base[s] = fits[0] - cs[0]
                break
            low = at = at + width  # too full for states of many edges; those of one edge fill it later
        slots = base[s] + cs
        taken[slots] = True
        owner[slots] = s
        target[slots] = [edges[s][int(c)] for c in cs]
    one = [s for s, e in enumerate(edges) if len(e) == 1]
    holes = np.flatnonzero(~taken)
    if len(holes) < len(one):
        more = len(one) - len(holes) + ALPHABET
        holes = np.append(holes, len(taken) + np.arange(more))
        owner, target = np.append(owner, np.full(more, -1, np.int32)), np.append(target, np.zeros(more, np.int32))
    for s, slot in zip(one, holes[:len(one)]):
        (c, to), = edges[s].items()
        base[s], owner[slot], target[slot] = slot - c, s, to
    used = int(np.flatnonzero(owner >= 0).max(initial=0)) + ALPHABET + 1
    fit = lambda x, fill: np.append(x, np.full(max(0, used - len(x)), fill, np.int32))[:used]
    return base, fit(owner, -1), fit(target, 0)


def automaton(blocks: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed suffix automaton of all blocks; no match runs from one block into the next."""
    text: list[int] = []
    for block in blocks:
        symbols = table[np.frombuffer(block.encode("utf-32-le"), np.uint32)]
        first = np.zeros(len(symbols), bool)
        first[:1] = True
        text.extend(symbols[without_runs(symbols, first)].tolist())
        text.append(END_OF_BLOCK)
    edges = suffix_automaton(text)
    for e in edges:
        e.pop(END_OF_BLOCK, None)
    return packed(edges)


class Languages(NamedTuple):
    """All automata one after the other: one number for a state of any language. The last state goes nowhere."""

    names: list[str]
    own: list[int]
    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    #: State after one symbol from the start, per language; the last state where there is none.
    after: np.ndarray


def joined(names: list[str], own: list[int], parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Languages:
    states = np.concatenate([[0], np.cumsum([len(b) for b, _, _ in parts])])
    slots = np.concatenate([[0], np.cumsum([len(o) for _, o, _ in parts])])
    base = np.concatenate([*(b + slots[i] for i, (b, _, _) in enumerate(parts)), [0]]).astype(np.int64)
    owner = np.concatenate([np.where(o >= 0, o + states[i], -1) for i, (_, o, _) in enumerate(parts)]).astype(np.int32)
    target = np.concatenate([t + states[i] for i, (_, _, t) in enumerate(parts)]).astype(np.int32)
    roots = states[:-1]
    at = base[roots][:, None] + np.arange(ALPHABET)
    after = np.where(owner[at] == roots[:, None], target[at], states[-1]).astype(np.int32)
    return Languages(names, own, base, owner, target, after)


def phrases(model: Languages, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Phrases of each window in each language, ``(languages, windows)``: the longest match from where the last one ended,
    again and again; a symbol that the language never shows is a phrase of its own. All windows walk side by side, and each
    symbol that does not continue its phrase begins one."""
    count = np.zeros((len(model.after), len(start)), np.int32)
    if not len(start):
        return count
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    nowhere = len(model.base) - 1
    state = np.full(count.shape, nowhere, np.int64)
    going = np.searchsorted(-length, -np.arange(int(length[0])), side="left")  # windows longer than each step
    for step, n in enumerate(going):
        c = symbols.take(start[:n] + step).astype(np.int64)
        for after, own, begun in zip(model.after, state, count):
            s = own[:n]
            at = model.base.take(s)
            at += c
            hit = model.owner.take(at) == s
            own[:n] = np.where(hit, model.target.take(at), after.take(c))
            begun[:n] += ~hit
    back = np.empty_like(count)
    back[:, order] = count
    return back


def parse(model: Languages, table: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(languages, texts)`` phrases, and each text's symbols and letters."""
    n = len(texts)
    total, size, n_letters = np.zeros((len(model.after), n), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    parts = [(i, t[at:at + PART]) for i, t in enumerate(texts) for at in range(0, len(t), PART)]
    at = 0
    while at < len(parts):
        stop, chars = at, 0
        while stop < len(parts) and (stop == at or chars + len(parts[stop][1]) <= PART):
            chars += len(parts[stop][1])
            stop += 1
        some = parts[at:stop]
        at = stop
        symbols = table[np.frombuffer("".join(t for _, t in some).encode("utf-32-le"), np.uint32)]
        lengths = np.array([len(t) for _, t in some])
        first = np.zeros(len(symbols), bool)
        first[np.cumsum(lengths) - lengths] = True
        keep = without_runs(symbols, first)
        owner = np.repeat(np.arange(len(some)), lengths)[keep]
        symbols = symbols[keep]
        own = np.bincount(owner, minlength=len(some))
        begin = np.cumsum(own) - own
        windows = -(-own // WINDOW)
        part = np.repeat(np.arange(len(some)), windows)
        k = np.arange(len(part)) - np.repeat(np.cumsum(windows) - windows, windows)
        found = phrases(model, symbols, begin[part] + k * WINDOW, np.minimum(WINDOW, own[part] - k * WINDOW))
        text = np.array([i for i, _ in some])
        np.add.at(size, text, own)
        np.add.at(n_letters, text, np.bincount(owner[symbols != GAP], minlength=len(some)))
        for j in range(len(model.after)):
            total[j] += np.bincount(text[part], found[j], n).astype(np.int64)
    return total, size, n_letters


def held_out(id: Column) -> Column:
    """A third of the ids, by CRC-32 of their text."""
    return F.coalesce(F.crc32(id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id: str, text: str, lang: str, sample_chars: int) -> Languages | None:
    """Automata from the labelled rows that are not held out; None if no such row holds a letter.

    A block of ``BLOCK`` characters is taken by the hash of its content, at a rate known from the language's size, so the
    sample is spread over all labelled text and equal blocks count once; blocks that stand under several languages tell
    nothing and are left out. Each language's automaton is built in its own task.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"))).select("lang", "text")
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text").cast("long")).alias("chars"))
    # Twice the wanted size is gathered; equal and shared blocks leave, then the blocks of smallest hash stay.
    rates = {r["lang"]: min(1.0, 2 * sample_chars / max(1, r["chars"])) for r in sizes.collect()}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for name, whole in zip(*(c.to_pylist() for c in batch.columns)):
                limit = rates[name] * 2 ** 32
                for at in range(0, len(whole), BLOCK):
                    block = whole[at:at + BLOCK]
                    h = zlib.crc32(block.encode())
                    if h < limit:
                        made.append((name, block, h))
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string()),
                 pa.array([m[2] for m in made], pa.int64())], ["lang", "block", "h"])

    found = rows.mapInArrow(blocks, "lang string, block string, h long").groupBy("block", "h").agg(
        F.min("lang").alias("lang"), F.max("lang").alias("other")).where("lang = other").drop("other")
    sample = cut(found)
    seen = sample.select(F.explode(F.split("block", "")).alias("c")).where("c <> ''").groupBy("c").count().toLocalIterator()
    low, counts = letters(), {}
    for r in seen:
        if cp := int(low[ord(r["c"][0])]):
            counts[cp] = counts.get(cp, 0) + r["count"]
    if not counts:
        return None
    own = sorted(counts, key=lambda cp: (-counts[cp], cp))[:OWN]

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        picked, size = [], 0
        for block in frame.sort_values(["h", "block"])["block"]:
            if size >= sample_chars:
                break
            picked.append(block)
            size += len(block)
        arrays = automaton(picked, symbol_table(own))
        return pd.DataFrame([(frame["lang"].iloc[0], *(x.tobytes() for x in arrays))], columns=["lang", "base", "owner", "target"])

    made = sample.groupBy("lang").applyInPandas(build, "lang string, base binary, owner binary, target binary").toArrow()
    models = sorted(zip(*(made.column(c).to_pylist() for c in ("lang", "base", "owner", "target"))))
    return joined([m[0] for m in models], own, [tuple(np.frombuffer(x, np.int32) for x in m[1:]) for m in models])


@lru_cache(maxsize=2)
def _table(own: tuple[int, ...]) -> np.ndarray:
    return symbol_table(list(own))


def identify(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", sample_chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """All columns of ``docs`` and ``xp_lang``, ``xp_score``.

    Cross-parsing (Ziv and Merhav, 1993): the suffix automaton of a language's labelled text gives, from any place of a text,
    the longest match; the text is cut greedily into such matches, and the language that needs the fewest phrases for each
    symbol wins, ties to the smaller name. ``xp_score`` is 1 - fewest / second fewest (1.0 when only one language is known).

    Case is folded and each run of characters that are no letters is one symbol. Every whole text is parsed, in windows of
    ``WINDOW`` symbols. A null text, one without a letter, and every text when nothing could be learned is ``und`` with
    score 0. Labels teach only where ``held_out`` is false; a prediction is a function of the text alone. Rows with
    null or repeated ids are predicted like others. Predicting shuffles nothing; the model has at most about
    ``6 * sample_chars`` numbers of 4 bytes a language.
    """
    need(docs, [id, text, lang])
    keep = [c for c in docs.columns if c not in ("xp_lang", "xp_score")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep])
    model = learn(docs, id, text, lang, sample_chars)
    if model is None:
        return source.withColumns({"xp_lang": F.lit(UNKNOWN), "xp_score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        table = _table(tuple(known.own))
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                total, size, n_letters = parse(known, table, [t or "" for t in part.column(at).to_pylist()])
                rate = total / np.maximum(1, size)
                best = rate.argmin(0)
                low = rate.min(0)
                other = np.partition(rate, 1, 0)[1] if len(rate) > 1 else np.full(len(size), np.inf)
                score = np.where(n_letters > 0, 1.0 - low / np.maximum(other, 1e-12), 0.0)
                names = [known.names[b] if n else UNKNOWN for b, n in zip(best, n_letters)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score)], [*keep, "xp_lang", "xp_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    plain = source.toDF(*[f"c{i}" for i in range(len(source.columns))])  # mapInArrow reads a dot in a name as a path
    return plain.mapInArrow(run, f"{fields}{', ' if fields else ''}xp_lang string, xp_score double")
