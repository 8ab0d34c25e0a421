"""Term totals of one Arrow batch, vectorized over all its characters (helper of ``features``)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import chain, repeat

import numpy as np
import pandas as pd

TOKEN = re.compile(r"\w\w+")
SLAB_CHARS = 500_000


def slabs(texts: list[str], chars: int = SLAB_CHARS) -> Iterator[list[str]]:
    """Consecutive runs of about ``chars`` characters, so that working arrays stay small."""
    slab, size = [], 0
    for text in texts:
        slab.append(text)
        size += len(text)
        if size >= chars:
            yield slab
            slab, size = [], 0
    if slab:
        yield slab


def char_totals(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``terms, tf, df`` of the character n-grams (3 to 5) inside space-padded words."""
    padded = [f" {t} " for t in texts]
    letters = np.frombuffer("\0".join(padded).encode("utf-32-le", "replace"), dtype=np.uint32)
    alphabet, codes = np.unique(letters, return_inverse=True)
    codes = codes.astype(np.int64)
    owner = np.repeat(np.arange(len(padded)), [len(p) + 1 for p in padded])[: len(codes)]
    space, edge = letters == 32, letters == 0
    base = len(alphabet)
    terms, tf, df = [], [], []
    # Ranks stand for prefixes, so five characters fit one integer whatever the alphabet.
    state, at = codes, np.arange(len(codes))
    for n in range(2, 6):
        last = at + n - 1
        fits = last < len(codes)
        at, state, last = at[fits], state[fits], last[fits]
        # Inner characters must not be spaces; nothing crosses texts.
        good = ~edge[last] & ~edge[at] & (True if n == 2 else ~space[last - 1])
        at, state, last = at[good], state[good], last[good]
        pairs = state * base + codes[last]
        known, state = np.unique(pairs, return_inverse=True)
        if n < 3 or not len(known):
            continue
        first = np.zeros(len(known), dtype=np.int64)
        first[state] = at
        tf.append(np.bincount(state, minlength=len(known)))
        seen = np.unique(state * len(padded) + owner[at])
        df.append(np.bincount(seen // len(padded), minlength=len(known)))
        spelled = alphabet[codes[first[:, None] + np.arange(n)]].astype(np.uint32)
        terms += [row.tobytes().decode("utf-32-le") for row in spelled]
    if not terms:
        return [], np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return terms, np.concatenate(tf), np.concatenate(df)


def word_totals(texts: list[str]) -> tuple[Counter, Counter]:
    """``tf, df`` of words and adjacent word pairs."""
    tf, df = Counter(), Counter()
    for text in texts:
        tokens = TOKEN.findall(text)
        found = Counter(tokens)
        found.update(map(" ".join, zip(tokens, tokens[1:])))
        tf.update(found)
        df.update(found.keys())
    return tf, df


def _frame(kind: str, terms: list[str], tf, df) -> pd.DataFrame:
    return pd.DataFrame({
        "kind": [kind] * len(terms), "term": terms, "tf": np.asarray(tf, dtype=np.int64), "df": np.asarray(df, dtype=np.int64),
    })


def batch_totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch.iloc[:, 0].fillna("").tolist()
        for some in slabs(texts):
            terms, tf, df = char_totals(some)
            if terms:
                yield _frame("char", terms, tf, df)
        tf, df = word_totals(texts)
        if tf:
            yield _frame("word", list(tf), list(tf.values()), [df[t] for t in tf])
        if texts:
            yield _frame("none", [""], [len(texts)], [len(texts)])


#: Distinct words or terms that a task counts before it hands them on.
HELD_TERMS = 400_000


def grams_in(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size (3 to 5) of the character n-grams inside space-padded words: ``owners, grams, letters``.

    An occurrence is the number of its word and the number of its n-gram; ``letters`` spells the n-grams, in order of code points.
    """
    letters = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    alphabet, codes = np.unique(letters, return_inverse=True)
    codes, space = codes.astype(np.int64), letters == 32
    owner = np.cumsum(space) - 1
    state, at = codes, np.arange(len(codes))
    for n in range(2, 6):
        last = at + n - 1
        fits = last < len(codes)
        at, state, last = at[fits], state[fits], last[fits]
        # Inner characters must not be spaces, so nothing crosses words.
        good = ~space[last - 1] if n > 2 else ~(space[at] & space[last])
        at, state, last = at[good], state[good], last[good]
        known, first, state = np.unique(state * len(alphabet) + codes[last], return_index=True, return_inverse=True)
        if n > 2 and len(known):
            # The second character is an inner one, and so in the n-gram's own word.
            yield owner[at + 1], state, alphabet[codes[at[first][:, None] + np.arange(n)]].astype(np.uint32)


def spelled(letters: np.ndarray) -> list[str]:
    return [row.tobytes().decode("utf-32-le", "replace") for row in letters]


def word_counts(texts: list[str], found: Counter | None = None) -> Counter:
    """Words and adjacent word pairs."""
    found = Counter() if found is None else found
    for text in texts:
        tokens = TOKEN.findall(text)
        found.update(tokens)
        found.update(map(" ".join, zip(tokens, tokens[1:])))
    return found


def piece_counts(texts: list[str], found: Counter | None = None) -> Counter:
    """What stands between spaces."""
    found = Counter() if found is None else found
    for text in texts:
        found.update(text.split(" "))
    del found[""]
    return found


def counted(count):
    """``batches -> term, tf`` of a function that counts texts, handed on whenever ``HELD_TERMS`` are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Counter()
        for batch in batches:
            for some in slabs(batch.iloc[:, 0].fillna("").tolist()):
                count(some, held)
                if len(held) >= HELD_TERMS:
                    yield pd.DataFrame({"term": list(held), "tf": list(held.values())})
                    held = Counter()
        if held:
            yield pd.DataFrame({"term": list(held), "tf": list(held.values())})

    return run


def gram_totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``term, tf`` of the character n-grams of distinct words ``piece, n``."""
    for batch in batches:
        words, counts, at = batch.iloc[:, 0].tolist(), batch.iloc[:, 1].to_numpy(), 0
        for some in slabs(words):
            weight = counts[at:at + len(some)]
            at += len(some)
            for owner, gram, letters in grams_in(some):
                tf = np.bincount(gram, weights=weight[owner], minlength=len(letters))
                yield pd.DataFrame({"term": spelled(letters), "tf": tf.astype(np.int64)})


def token_totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``term, tf`` of the words in distinct pieces ``piece, n``: no word reaches over a space."""
    for batch in batches:
        held = Counter()
        for piece, n in zip(batch.iloc[:, 0].tolist(), batch.iloc[:, 1].tolist()):
            for token in TOKEN.findall(piece):
                held[token] += n
        yield pd.DataFrame({"term": list(held), "tf": list(held.values())})


#: Occurrences of word pairs that a task holds before it counts them and hands them on.
HELD_PAIRS = 2_000_000


def pair_counts(words: list[str]):
    """``batches -> pair, tf``: occurrences of adjacent words that are both among ``words``; a pair is the place of its first word
    times their number plus the place of its second."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, n = {w: i for i, w in enumerate(words)}, len(words)
        held, size = [], 0

        def counts() -> pd.DataFrame:
            pair, tf = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"pair": pair, "tf": tf.astype(np.int64)})

        for batch in batches:
            for some in slabs(batch.iloc[:, 0].fillna("").tolist()):
                codes, owner = coded([TOKEN.findall(t) for t in some], code, -1)
                good = (codes[:-1] >= 0) & (codes[1:] >= 0) & (owner[:-1] == owner[1:])
                held.append(codes[:-1][good] * n + codes[1:][good])
                size += len(held[-1])
                if size >= HELD_PAIRS:
                    yield counts()
                    held, size = [], 0
        if size:
            yield counts()

    return run


def pair_terms(words: list[str]):
    """``batches -> term, tf`` of ``pair, tf``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first, second = np.divmod(batch["pair"].to_numpy(), len(words))
            yield pd.DataFrame({"term": [f"{words[a]} {words[b]}" for a, b in zip(first, second)], "tf": batch["tf"]})

    return run


def keyed(owner: np.ndarray, term: np.ndarray, n_owners: int, n: int) -> np.ndarray:
    """One whole number a pair, of half the size if it can be: these are sorted."""
    size = np.int32 if n_owners * n < 2**31 else np.int64
    return owner.astype(size, copy=False) * size(n) + term.astype(size, copy=False)


def coded(lists: list[list[str]], code: Mapping[str, int], unknown: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all strings of ``lists`` in a row, and which list each is of."""
    lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    owner = np.repeat(np.arange(len(lists)), lengths)
    numbers = map(code.get, chain.from_iterable(lists), repeat(unknown))
    return np.fromiter(numbers, dtype=np.int64, count=len(owner)), owner


#: So many codes are looked up in a table, more are searched.
MOST_DIRECT = 4_000_000
#: Characters of distinct pieces whose n-grams are remembered.
HELD_CHARS = 2_500_000


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted; ``np.unique`` hashes whole numbers, which takes several times as long here."""
    found = np.sort(values)
    return found[np.flatnonzero(np.r_[True, found[1:] != found[:-1]])] if len(found) else found


class KnownTerms:
    """Where the terms of two dictionaries ``term -> number`` occur in many texts at once.

    Words and pairs are found by the codes of their tokens. Character n-grams never cross a space, so they are looked up once
    for a distinct piece between spaces: a code for three characters is searched among the known trigrams and prefixes, and
    survivors are extended to four and five characters.
    """

    def __init__(self, words: Mapping[str, int], grams: Mapping[str, int]):
        apart = {w: w.split(" ") for w in words}
        self.code = {t: i for i, t in enumerate(dict.fromkeys(chain.from_iterable(apart.values())))}
        # The last code stands for all other tokens.
        self.single = np.full(len(self.code) + 1, -1, dtype=np.int64)
        pairs = {}
        for word, tokens in apart.items():
            if len(tokens) == 1:
                self.single[self.code[word]] = words[word]
            elif len(tokens) == 2:
                pairs[self.code[tokens[0]] * len(self.single) + self.code[tokens[1]]] = words[word]
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.pair_terms = np.array([pairs[p] for p in self.pairs.tolist()], dtype=np.int64)
        alphabet = sorted({c for g in grams for c in g})
        self.size = len(alphabet) + 1
        number = {c: i + 1 for i, c in enumerate(alphabet)}
        # The last place stands for all characters beyond.
        self.number_of = np.zeros(max(map(ord, alphabet), default=0) + 2, dtype=np.int64)
        self.number_of[[ord(c) for c in alphabet]] = np.arange(1, self.size)
        self.levels = []
        parents: dict[str, int] = {}
        for n in (3, 4, 5):
            prefixes = sorted({g[:n] for g in grams if len(g) >= n})
            codes = np.empty(len(prefixes), dtype=np.int64)
            for i, p in enumerate(prefixes):
                if n == 3:
                    codes[i] = (number[p[0]] * self.size + number[p[1]]) * self.size + number[p[2]]
                else:
                    codes[i] = parents[p[:-1]] * self.size + number[p[-1]]
            order = np.argsort(codes, kind="stable")
            codes, terms = codes[order], np.array([grams.get(prefixes[i], -1) for i in order], dtype=np.int64)
            direct = None
            if (most := (len(parents) or self.size**2) * self.size) <= MOST_DIRECT:
                direct = np.full(most, -1, dtype=np.int32)
                direct[codes] = np.arange(len(codes))
            self.levels.append((codes, terms, direct))
            parents = {prefixes[j]: rank for rank, j in enumerate(order)}
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[str, int] = {}
        self.chars = 0
        # The n-grams of all remembered pieces, one after the other, and where each piece's begin.
        self.inside, self.starts = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def _letters(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        return self.number_of[np.minimum(raw, len(self.number_of) - 1)]

    def char_hits(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """``positions, term numbers`` of every known character n-gram occurrence."""
        letters = self._letters(text)
        positions = np.arange(max(len(letters) - 2, 0))
        if not len(positions) or not len(self.levels[0][0]):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        code = (letters[:-2] * self.size + letters[1:-1]) * self.size + letters[2:]
        found_at, found = [], []
        for n, (codes, terms, direct) in zip((3, 4, 5), self.levels):
            if n > 3:
                inside = positions + n - 1 < len(letters)
                positions, state = positions[inside], state[inside]
                code = state * self.size + letters[positions + n - 1]
            if not len(codes) or not len(positions):
                break
            if direct is not None:
                rank = direct[code]
                hit = rank >= 0
            else:
                rank = np.searchsorted(codes, code)
                rank[rank == len(codes)] = 0
                hit = codes[rank] == code
            positions, state = positions[hit], rank[hit].astype(np.int64)
            term = terms[state]
            found_at.append(positions[term >= 0])
            found.append(term[term >= 0])
        return np.concatenate(found_at), np.concatenate(found)

    def _learn(self, pieces: list[str]) -> None:
        """Look up the n-grams of pieces that are not remembered yet."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.pieces]
        if self.pieces and self.chars + sum(map(len, new)) > HELD_CHARS:
            self._forget()
            new = list(dict.fromkeys(pieces))
        self.chars += sum(map(len, new))
        first = len(self.pieces)
        self.pieces.update(zip(new, range(first, first + len(new))))
        for some in slabs(new):
            where, term = self.char_hits("\0".join(f" {p} " for p in some))
            begins = np.cumsum([0, *[len(p) + 3 for p in some]])
            owner = np.searchsorted(begins, where, side="right") - 1
            ends = self.starts[-1] + np.cumsum(np.bincount(owner, minlength=len(some)))
            self.inside = np.concatenate([self.inside, term[np.argsort(owner, kind="stable")].astype(np.int32)])
            self.starts = np.concatenate([self.starts, ends])

    def gram_hits(self, texts: list[str], once: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """``owners, terms`` of the character n-grams of each text; ``once`` takes a piece that a text repeats a single time."""
        pieces = [t.split(" ") for t in texts]
        self._learn(list(chain.from_iterable(pieces)))
        piece, owner = coded(pieces, self.pieces, -1)
        if once:
            owner, piece = np.divmod(distinct(owner * len(self.pieces) + piece), max(len(self.pieces), 1))
        counts = self.starts[piece + 1] - self.starts[piece]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        size = np.int32 if max(total, len(self.inside)) < 2**31 else np.int64
        place = np.repeat((self.starts[piece] - ends + counts).astype(size), counts)
        place += np.arange(total, dtype=size)
        return np.repeat(owner.astype(np.int32), counts), self.inside[place]

    def word_hits(self, texts: list[str], row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``owners, terms, inner`` of the words and pairs of each text. A pair may reach over into the next text of the same row;
        ``inner`` is false there, and the owner is the first of both."""
        codes, owner = coded([TOKEN.findall(t) for t in texts], self.code, len(self.code))
        term = self.single[codes]
        at = np.flatnonzero(term >= 0)
        if not len(self.pairs):
            return owner[at], term[at], np.ones(len(at), dtype=bool)
        keys = codes[:-1] * len(self.single) + codes[1:]
        rank = np.searchsorted(self.pairs, keys)
        rank[rank == len(self.pairs)] = 0
        row = row_of[owner]
        both = np.flatnonzero((self.pairs[rank] == keys) & (row[:-1] == row[1:]))
        inner = owner[both] == owner[both + 1]
        return (
            np.concatenate([owner[at], owner[both]]), np.concatenate([term[at], self.pair_terms[rank[both]]]),
            np.concatenate([np.ones(len(at), dtype=bool), inner]),
        )


def frequencies(words: dict[str, int], grams: dict[str, int], n: int):
    """``batches -> id, df``: in how many texts each of ``n`` known terms occurs, and under id -1 how many texts there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, seen, known = np.zeros(n, dtype=np.int64), 0, KnownTerms(words, grams)
        for batch in batches:
            for texts in slabs(batch.iloc[:, 0].fillna("").tolist()):
                seen += len(texts)
                owner, term, _ = known.word_hits(texts, np.arange(len(texts)))
                for owners, terms in ((owner, term), known.gram_hits(texts, once=True)):
                    df += np.bincount(distinct(keyed(owners, terms, len(texts), n)) % max(n, 1), minlength=n)
        yield pd.DataFrame({"id": np.r_[np.flatnonzero(df), -1], "df": np.r_[df[df > 0], seen]})

    return run


def word_profile(texts: list[str]) -> list[tuple[int, int, int, str] | None]:
    """Per text its distinct words and word pairs, their occurrences, the most of one, and the last by code points."""
    rows = []
    for text in texts:
        found = word_counts([text])
        rows.append((len(found), sum(found.values()), max(found.values()), max(found)) if found else None)
    return rows


def char_profile(texts: list[str]) -> list[tuple[int, int, int, str] | None]:
    """``word_profile`` of character n-grams."""
    words, weight, text_of = [], [], []
    for row, text in enumerate(texts):
        found = piece_counts([text])
        words += found.keys()
        weight += found.values()
        text_of += [row] * len(found)
    weight, text_of = np.array(weight, dtype=np.int64), np.array(text_of, dtype=np.int64)
    terms, total, most, last = *np.zeros((3, len(texts)), dtype=np.int64), [""] * len(texts)
    for owner, gram, letters in grams_in(words) if words else ():
        pairs, place = np.unique(text_of[owner] * len(letters) + gram, return_inverse=True)
        tf = np.bincount(place, weights=weight[owner]).astype(np.int64)
        row, gram = pairs // len(letters), pairs % len(letters)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        at, end = row[first], np.r_[first[1:], len(row)] - 1
        terms[at] += end - first + 1
        total[at] += np.add.reduceat(tf, first)
        most[at] = np.maximum(most[at], np.maximum.reduceat(tf, first))
        for i, term in zip(at.tolist(), spelled(letters[gram[end]])):
            last[i] = max(last[i], term)
    return [(int(a), int(b), int(c), d) if a else None for a, b, c, d in zip(terms, total, most, last)]
