"""Conversation repair against an exhaustive dynamic program, its rows, and odd input."""

import hashlib
import random
import re

import pytest

from wardline.llm import turn_repair as T

TURNS = "conv_id long, turn long, role string, text string, pass int, present int, digest string"


def cheapest(codes):
    """Least (cost, audit) over every sequence of edits, row by row, with up to two insertions between rows."""
    def opened(now):
        for _ in range(3):
            for state, (cost, audit) in list(now.items()):
                letter = "a" if state == 2 else "u"
                to = {"a": 3, "u": 2}[letter]
                now[to] = min(now.get(to, (10 ** 9, "")), (cost + 3, audit + "I"))
        return now

    now = opened({0: (0, "")})
    for code in codes:
        after = {}
        for state, (cost, audit) in now.items():
            ways = [("D", 4, state)]
            if code != "-":
                extra, letter = 3 * code.isupper(), code.lower()
                keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, letter))
                ways += [("K", extra, keep)] if keep is not None else []
                ways.append(("R", 3 + extra, 3 if state == 2 else 2))
            for edit, price, to in ways:
                after[to] = min(after.get(to, (10 ** 9, "")), (cost + price, audit + edit))
        now = opened(after)
    return min(v for state, v in now.items() if state in (0, 3))


def test_search_is_optimal_and_ascii_least():
    rng = random.Random(5)
    for _ in range(3000):
        letters = rng.choice(["uasxUASX-", "ua", "uas", "sS-ua", "uaUA-", "s", "-"])
        codes = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 16)))
        assert T.search(codes)[:2] == cheapest(codes), codes


def test_bounds_never_exceed_the_cost():
    rng = random.Random(6)
    for _ in range(500):
        codes = "".join(rng.choice("uasxUASX-") for _ in range(rng.randrange(0, 12)))
        assert T.bounds(codes)[0][0] <= cheapest(codes)[0]


def test_long_conversations_open_few_prefixes():
    rng = random.Random(7)
    for letters in ("uasxUASX-", "s", "ususa", "uuuaaasssX-"):
        codes = "".join(rng.choice(letters) for _ in range(20_000))
        cost, audit, opened = T.search(codes)
        assert opened < 2 * len(codes) and len(re.sub("I", "", audit)) == len(codes)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "user", "cut"), (2, 1, "assistant", "Fine."), (2, 4, "user", "Fine."),
        (3, 0, "user", "a."), (3, 1, "user", "a."), (3, 2, "assistant", "b!"), (4, None, "system", "s."), (4, 0, None, None), (4, None, "system", "s."),
        (5, None, "user", None), (5, None, "user", ""), (None, 3, "assistant", "lone?"), (None, 3, "assistant", "lone?"),
        (6, 0, "", "x."), (6, 1, "", "y."), (7, 0, "user", "w " * 40_000 + "."), (7, 1, "assistant", "é\U0001F600。\x00."), (8, 0, "understudy", "z.\n \t"),
        (8, 1, "assistant", "ok.")]
    return spark.createDataFrame([(*r, 0, 0, "own") for r in rows], TURNS)


def plain(rows):
    """The report of one conversation, from the rules."""
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    blank = dup = short = 0
    codes, seen = "", set()
    for _, role, text in rows:
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        if not last:
            blank, code = blank + 1, "-"
        elif (role, text) in seen:
            dup, code = dup + 1, "-"
        elif last[0] not in ".!?":
            short, code = short + 1, letter.upper()
        else:
            code = letter
        seen.add((role, text))
        codes += code
    first = [r[1][:1] for r in rows]
    turns = {r[0] for r in rows if r[0] is not None}
    cost, audit = cheapest(codes)
    state, at, out = "u", 0, []
    for edit in audit:
        role, text = (None, "") if edit == "I" else rows[at][1:]
        at += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == "a" else "user"
        state = "a" if role[:1] == "u" else "u"
        out.append((edit, role, text))
    joined = "\n".join(f"{r}:{t}" for _, r, t in out)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, blank, dup, short,
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256(joined.encode()).hexdigest()), out


def test_report_and_rows_follow_the_rules(odd):
    by = {}
    for r in odd.collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    made = {r.conv: tuple(r)[1:] for r in T.report(odd).collect()}
    fixed = {}
    for r in sorted(T.repair(odd).collect(), key=lambda r: r.position):
        fixed.setdefault(r.conv, []).append((r.edit, r.role, r.text))
    assert set(made) == set(by)
    for conv, rows in by.items():
        told, out = plain(rows)
        assert made[conv] == told, conv
        assert fixed.get(conv, []) == out, conv
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in out))


def test_order_does_not_matter(odd):
    assert sorted(map(str, T.report(odd).collect())) == sorted(map(str, T.report(odd.repartition(6)).collect()))


def test_absent_rows_and_empty_tables(spark, odd):
    from pyspark.sql import functions as F

    gone = T.report(odd, present=F.col("conv_id") != 1).where("conv = 1").first()
    assert tuple(gone) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert T.report(odd.where("false")).count() == 0 and T.repair(odd.where("false")).count() == 0


def test_random_conversations(spark):
    rng = random.Random(9)
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["a.", "b", " ", "c!", None, "d?"]))
            for c in range(120) for _ in range(rng.randrange(1, 12))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(tuple(r))
    for r in T.report(frame).collect():
        assert tuple(r)[1:] == plain(by[r.conv])[0], r.conv


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", f"One. Two! {c}") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    made = T.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    found = {}
    for r in made:
        found.setdefault((r.conv_id, r.turn), []).append(r)
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        got = found[c, t]
        assert len(got) == 1 + (kind == 3) and all(r.present == (kind != 0) for r in got)
        assert got[0].role == ("user" if kind == 4 else role or " ")
        assert got[0].text == ("" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text or " ")
