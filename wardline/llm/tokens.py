"""Token ids from a public tokenizer file, inside tasks."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces of text whose ids a worker remembers, and once more as many older ones (a piece longer than 64 characters is never kept).
MEMORY = 700_000

#: A control character, one token by itself; pieces that hold it are encoded alone.
MARK = "\x01"

#: A word and the signs after it: many unseen pieces are a known word in another case or before another sign. Apostrophes may
#: begin a piece of the tokenizer's own and ``<`` a marker, so neither is a sign here.
WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")
LETTERS = [chr(c) for c in range(0x61, 0x100) if WORD.fullmatch(chr(c)) and chr(c).islower()]
#: Pieces that are encoded in one call.
TOGETHER = 500


@lru_cache(maxsize=1)
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Ids of whole texts, one white-space piece at a time.

    Exact for tokenizers that drop white space before they split words and look at nothing across it: the ids of a text
    are then those of its pieces in a row. Pieces recur, so most are looked up. ``ids`` equals ``encode`` of the whole text,
    also where a text spells out a marker of the tokenizer. If the tokenizer folds case and parts words from signs, an unseen
    piece of Latin letters and signs is looked up by its small letters and its signs. ``many`` parts its texts in Arrow and looks
    each distinct piece of them up once.
    """

    def __init__(self, path: str, memory: int | None = None):
        from tokenizers import pre_tokenizers

        self.tokenizer, self.memory = load(path), MEMORY if memory is None else memory
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before it grew too large; a piece that recurs moves back
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        a, b, c = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("AÉb$.,", "aéb", "$.,"))
        self.folds = a == b + c
        # A word of small Latin letters is one part of the text: the model alone gives its ids, once its letters are spelled in bytes.
        byte = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {ord(c): byte.pre_tokenize_str(c)[0][0] for c in LETTERS if not c.isascii()}
        probes = [x for c in LETTERS for x in (c, f"th{c}", f"{c}tion", f"{c}{c}é{c}")] + ["".join(LETTERS)] if self.folds else []
        self.direct = self.folds and all(
            self.word(x) == array("I", self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes() for x in probes)

    def word(self, word: str) -> bytes:
        """Ids of a word of small Latin letters."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.translate(self.spelled))]).tobytes()

    def encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. Pieces are encoded as one text with a mark between them, which costs far less than one by one."""
        if self.mark is not None and not any(MARK in p for p in pieces):
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) == len(pieces) - 1:
                begin, end = np.r_[0, cut + 1], np.r_[cut, len(ids)]
                return [ids[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())]
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(pa.array([t or "" for t in texts], pa.string()), "\n", " "), " ")
        column = lists.flatten().dictionary_encode()
        pieces, at = column.dictionary.to_numpy(zero_copy_only=False).tolist(), column.indices.to_numpy()
        found = self.pieces(pieces)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        whole, begin = np.frombuffer(b"".join(found), np.uint32), np.cumsum(size) - size
        # Ids of all pieces in a row: a piece's ids stand together, so each one's place is its piece's begin and a count from there.
        size, begin = size[at], begin[at]
        end = np.cumsum(size)
        ids = whole[np.repeat(begin - end + size, size) + np.arange(end[-1] if len(end) else 0)]
        cuts = np.r_[0, end][lists.offsets.to_numpy()].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, known ones from memory."""
        if len(self.known) > self.memory:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = list(map(known.get, pieces))
        unseen = {w for w, ids in zip(pieces, found) if ids is None}
        if not unseen:
            return found
        if older:
            known.update((w, older[w]) for w in unseen if w in older)
            unseen = {w for w in unseen if w not in known}
        parts: dict[str, tuple[str, str]] = {}
        if self.folds:
            for w in unseen:
                m = WORD.fullmatch(w)
                if m:
                    parts[w] = m[1].lower(), m[2]
        apart = {x for pair in parts.values() for x in pair if x not in known}
        new = [w for w in unseen if w not in parts or w in apart] + [x for x in apart if x not in unseen]
        rare: dict[str, bytes] = {}

        def keep(w: str, ids: bytes) -> None:
            (known if len(w) <= 64 else rare)[w] = ids

        words = {word for word, _ in parts.values()} if self.direct else set()
        some = [w for w in new if w not in words]
        for i in range(0, len(some), TOGETHER):
            for w, ids in zip(some[i:i + TOGETHER], self.encoded(some[i:i + TOGETHER])):
                keep(w, ids)
        for w in new:
            if w in words:
                keep(w, self.word(w))
        for w, (word, signs) in parts.items():
            if w not in apart:
                keep(w, (known[word] if word in known else rare[word]) + (known[signs] if signs in known else rare[signs]))
        return [ids if ids is not None else known[w] if w in known else rare[w] for w, ids in zip(pieces, found)]


@lru_cache(maxsize=1)
def word_ids(path: str, memory: int | None = None) -> WordIds:
    """One memory for all tasks of a worker."""
    return WordIds(path, memory)
