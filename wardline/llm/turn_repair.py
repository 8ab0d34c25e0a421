"""Repair of broken conversations at the least cost, by branch and bound."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import need

#: Costs: another role, a row out, an empty row in, a row kept although its text is cut short.
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: What the next row may be: s, u (start), u (after s), a, u (after a whole pair). Only START and PAIR may end.
START, ASKED, ANSWER, PAIR = 0, 1, 2, 3
_NEXT = {START: {"s": ASKED, "u": ANSWER}, ASKED: {"u": ANSWER}, ANSWER: {"a": PAIR}, PAIR: {"u": ANSWER}}
_ROLE = {"u": "user", "a": "assistant"}
#: Row codes: the role's first letter (x: any other), in capitals where the text is cut short; ``-`` must go.
MUST_GO = "-"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def bounds(codes: str) -> tuple[list[int], list[int], list[int]]:
    """Least cost of the rows from each place on: before anything was kept, when next comes a user's row, and when an
    assistant's.

    A relaxed grammar, in which a lone s may end too (ASKED is taken for PAIR), so it is never above the true cost.
    """
    n = len(codes)
    start, user, answer = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    answer[n] = INSERT
    for i in range(n - 1, -1, -1):
        code = codes[i]
        first, u, a = start[i + 1] + DELETE, user[i + 1] + DELETE, answer[i + 1] + DELETE
        if code != MUST_GO:
            extra, letter = CUT_SHORT * code.isupper(), code.lower()
            u = min(u, answer[i + 1] + extra + (0 if letter == "u" else REROLE))
            a = min(a, user[i + 1] + extra + (0 if letter == "a" else REROLE))
            if letter == "s":
                first = min(first, user[i + 1] + extra)
        user[i], answer[i] = min(u, a + INSERT), min(a, u + INSERT)
        start[i] = min(first, user[i])
    return start, user, answer


class Paths:
    """Every prefix of edits that was looked at, as a tree: one number a prefix, with its last edit and a jump towards the
    root, so that two prefixes are compared by ASCII in a logarithm of their length."""

    def __init__(self) -> None:
        self.above, self.jump, self.depth, self.edit = [0], [0], [0], [""]

    def add(self, above: int, edit: str) -> int:
        j = self.jump[above]
        far = self.depth[above] - self.depth[j] == self.depth[j] - self.depth[self.jump[j]]
        self.above.append(above)
        self.jump.append(self.jump[j] if far else above)
        self.depth.append(self.depth[above] + 1)
        self.edit.append(edit)
        return len(self.edit) - 1

    def lift(self, path: int, depth: int) -> int:
        while self.depth[path] > depth:
            path = self.jump[path] if self.depth[self.jump[path]] >= depth else self.above[path]
        return path

    def less(self, a: int, b: int) -> bool:
        """Whether a comes before b; a prefix of the other comes first."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, depth), self.lift(b, depth)
        if x == y:
            return self.depth[a] < self.depth[b]
        while self.above[x] != self.above[y]:
            if self.jump[x] != self.jump[y]:
                x, y = self.jump[x], self.jump[y]
            else:
                x, y = self.above[x], self.above[y]
        return self.edit[x] < self.edit[y]

    def text(self, path: int) -> str:
        made = []
        while path:
            made.append(self.edit[path])
            path = self.above[path]
        return "".join(reversed(made))


def steps(code: str | None, state: int) -> Iterator[tuple[str, int, int, int]]:
    """Edits that the grammar allows at a row (None: behind the last one): ``edit, cost, rows taken, next state``."""
    if code is not None:
        yield "D", DELETE, 1, state
    inserted = "a" if state == ANSWER else "u"
    yield "I", INSERT, 0, _NEXT[state][inserted]
    if code is not None and code != MUST_GO:
        extra, letter = CUT_SHORT * code.isupper(), code.lower()
        if letter in _NEXT[state]:
            yield "K", extra, 1, _NEXT[state][letter]
        if letter != inserted:
            yield "R", REROLE + extra, 1, _NEXT[state][inserted]


def search(codes: str) -> tuple[int, str, int]:
    """``(cost, audit, prefixes opened)``: the cheapest edits, among those the ASCII-least, by depth-first branch and bound.

    The stack holds open prefixes, the most promising on top (cost so far plus ``bounds``, then ASCII). A prefix is dropped when
    its bound exceeds the incumbent's cost, when it equals it and is no smaller in ASCII, or when the dominance table of its
    node (rows done, grammar state) holds a cheaper prefix or an equal one that is smaller in ASCII: what follows a node does
    not depend on the way to it. The empty stack proves the incumbent.
    """
    start, user, answer = bounds(codes)
    least_from = {START: start, ASKED: user, ANSWER: answer, PAIR: user}
    n, paths = len(codes), Paths()
    best: list[tuple[int, int] | None] = [None] * (4 * (n + 1))
    incumbent: tuple[int, int] | None = None
    stack = [(start[0], 0, 0, 0, START)]
    opened = 0

    def beaten(cost: int, path: int, by: tuple[int, int] | None) -> bool:
        return by is not None and (by[0] < cost or by[0] == cost and by[1] != path and paths.less(by[1], path))

    while stack:
        bound, cost, path, i, state = stack.pop()
        if beaten(bound, path, incumbent) or beaten(cost, path, best[4 * i + state]):
            continue
        opened += 1
        if i == n and state in (START, PAIR):
            incumbent = (cost, path)
            continue
        found = []
        for edit, price, taken, to in steps(codes[i] if i < n else None, state):
            j, total = i + taken, cost + price
            least = total + least_from[to][j]
            if incumbent is not None and least > incumbent[0]:
                continue
            held = best[4 * j + to]
            if held is not None and held[0] < total:
                continue
            made = paths.add(path, edit)
            if beaten(total, made, held):
                continue
            best[4 * j + to] = (total, made)
            found.append((least, total, made, j, to))
        # Last in is first out: the least bound on top, of equal bounds the ASCII-least edit (steps come in that order).
        found.reverse()
        stack.extend(sorted(found, key=lambda f: -f[0]))
    return incumbent[0], paths.text(incumbent[1]), opened


@lru_cache(maxsize=20_000)
def _remembered(codes: str) -> tuple[int, str]:
    return search(codes)[:2]


def repair_of(codes: str) -> tuple[int, str]:
    """Cost and audit; short conversations of the same shape are solved once."""
    return _remembered(codes) if len(codes) <= 64 else search(codes)[:2]


class Repaired:
    """Walks the rows of one conversation along its audit."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield ("I", *self._placed(""))

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """``(edit, role, text)`` of the repaired rows up to this one."""
        yield from self.inserted()
        edit = self.audit[self.at]
        if edit == "R":
            yield ("R", *self._placed(text))
            return
        self.at += 1
        if edit == "K":
            self.state = _NEXT[self.state][role[:1]]
            yield "K", role, text

    def _placed(self, text: str) -> tuple[str, str]:
        letter = "a" if self.state == ANSWER else "u"
        self.at += 1
        self.state = _NEXT[self.state][letter]
        return _ROLE[letter], text


class Conversation:
    """What a task holds of one conversation while its rows stream by: a code and a digest a row, never a text."""

    def __init__(self) -> None:
        self.codes, self.seen, self.turns = [], set(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last: str | None = None

    def learn(self, turn: int | None, role: str, digest: bytes, is_blank: bool, is_cut: bool) -> None:
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if turn is not None:
            self.turns.add(turn)
        if self.last is not None and self.last + letter not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = letter
        if is_blank:
            self.blank += 1
            code = MUST_GO
        elif digest in self.seen:
            self.duplicate += 1
            code = MUST_GO
        else:
            self.truncated += is_cut
            code = letter.upper() if is_cut else letter
        self.seen.add(digest)
        self.codes.append(code)

    def solve(self) -> None:
        self.seen = set()
        self.cost, self.audit = repair_of("".join(self.codes))
        self.walk = Repaired(self.audit)

    @property
    def gaps(self) -> int:
        return max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0


BLANK = r"[^\x20\x09-\x0D]"


def _twice(turns: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """Each row once without its text (pass 0) and once with it (pass 1), all rows of a conversation in one task, in order."""
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), (F.lit(True) if present is None else present).alias("present"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    told = rows.select(
        "conv", "turn", "role", "text", "present", F.unhex(F.md5("text")).alias("digest"), (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"))
    # A row that only names its conversation takes no part in the second pass.
    copies = told.withColumn("pass", F.explode(F.when(F.col("present"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    slim = copies.withColumn("text", F.when(F.col("pass") == 1, F.col("text")))
    names = ["conv", "pass", F.col("turn").asc_nulls_first(), "role", "digest"]
    return slim.repartition("conv").sortWithinPartitions(*names).select("conv", "pass", "turn", "role", "text", "present", "digest", "blank", "cut")


def _walk(batches: Iterator[pa.RecordBatch], begun: Callable, row: Callable, ended: Callable) -> Iterator[None]:
    """Feeds conversation after conversation: ``begun(conv, state)`` once solved, ``row(..)`` per repaired row, ``ended(..)``.
    Yields after each batch."""
    now: Conversation | None = None
    key, solved = object(), False

    def finish() -> None:
        if not solved:
            now.solve()
            begun(key, now)
        for made in now.walk.inserted():
            row(key, made)
        ended(key, now)

    for batch in batches:
        for conv, phase, turn, role, text, present, digest, blank, is_cut in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv != key:
                if now is not None:
                    finish()
                now, key, solved = Conversation(), conv, False
            if phase == 0:
                if present:
                    now.learn(turn, role, hashlib.md5(role.encode() + b"\0" + digest).digest(), blank, is_cut)
                continue
            if not solved:
                now.solve()
                begun(key, now)
                solved = True
            for made in now.walk.row(role, text):
                row(key, made)
        yield
    if now is not None:
        finish()
        yield


def repair(
    turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None,
) -> DataFrame:
    """The repaired rows: ``conv, position (from 0), edit (K, R or I), role, text``; see ``report`` for the rules."""
    need(turns, [conv, turn, role, text])
    kind = turns.schema[conv].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, place = [], [0]

        def begun(key, now):
            place[0] = 0

        def row(key, x):
            made.append((key, place[0], *x))
            place[0] += 1

        for _ in _walk(batches, begun, row, lambda key, now: None):
            for at in range(0, len(made), 10_000):
                part = list(zip(*made[at:at + 10_000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[0]), pa.array(part[1], pa.int64()), *(pa.array(c, pa.string()) for c in part[2:])],
                    ["conv", "position", "edit", "role", "text"])
            made.clear()

    return _twice(turns, conv, turn, role, text, present).mapInArrow(
        run, f"conv {kind.simpleString()}, position long, edit string, role string, text string")


def report(
    turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None,
) -> DataFrame:
    """One row per conversation: ``conv`` and ``REPORT``.

    Rows stand by turn (nulls first), rows of one turn by role and then by the MD5 of their text, so equal rows are neighbours; a
    null role or text is one space. A null conversation id is a conversation of its own. ``present`` false: the row only
    names its conversation, which is then reported even if nothing else is left of it (zeros, no edit, hash of nothing).

    A row's first fault counts: blank, duplicate (role and text stood earlier), truncated (its last visible character ends no
    sentence). Edits: keep 0, rerole to user or assistant 3, delete 4 (blank and duplicate rows must go), insert an empty
    user's or assistant's row 3; a truncated row that stays adds 3. The roles' first letters must read ``(s?(ua)+)?``; an empty role
    has no letter, so its row is reroled or deleted. ``audit`` has the cheapest edits, of these the ASCII-least;
    ``repaired_sha256`` is of the repaired rows, ``role:text`` by line.

    One shuffle brings a conversation's rows to one task, first all without text, then all with it, both in order: the task
    searches over one letter a row and hashes the texts as they stream by. Its memory grows with a conversation's rows (some
    hundred bytes each), never with its texts.
    """
    need(turns, [conv, turn, role, text])
    kind = turns.schema[conv].dataType
    names = ["conv", *(x.split()[0] for x in REPORT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, hash_ = [], [None, False]

        def begun(key, now):
            hash_[:] = [hashlib.sha256(), False]

        def row(key, made):
            hash_[0].update(("\n" * hash_[1] + made[1] + ":" + made[2]).encode())
            hash_[1] = True

        def ended(key, now):
            rows.append((key, now.gaps, now.blank, now.duplicate, now.truncated, now.illegal, now.cost, now.audit, hash_[0].hexdigest()))

        for _ in _walk(batches, begun, row, ended):
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0]), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])],
                    names)
                rows.clear()

    return _twice(turns, conv, turn, role, text, present).mapInArrow(run, f"conv {kind.simpleString()}, {REPORT}")


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present``: rows broken by the CRC-32 of ``conv_id:turn``; nulls are one space.

    Of 20 remainders, 0 drops the row (``present`` false), 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it a user's.
    """
    need(turns, ["conv_id", "turn", "role", "text"])
    space = F.lit(" ")
    of = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn"))) % 20
    rows = turns.select("conv_id", "turn", of("role").alias("role"), of("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("present"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
