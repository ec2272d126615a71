"""Conversation repair against a plain search over turns, with chunks of any size."""

import functools
import hashlib
import random
import sys
import zlib

import pytest

from lodestar.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, at string, codes int, said string, what int"
sys.setrecursionlimit(20_000)
WHITE = " \t\n\x0b\x0c\r"
OTHER = {"user": "assistant", "assistant": "user"}


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        if kind:
            out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repaired(turns):
    """turns (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in turns:
        said = text.rstrip(WHITE)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, last, inserted):
        """(cost, audit, lines) from turn i on; last: what was said before."""
        options = []
        want = "user" if last != "user" else "assistant"
        if inserted < 3:
            c, a, x = best(i, want, inserted + 1)
            options.append((c + 2, "I" + a, (f"{want}:", *x)))
        if i == len(turns):
            if last in (None, "assistant"):
                options.append((0, "", ()))
            return min(options, default=(1 << 30, "", ()))
        _, role, text = turns[i]
        c, a, x = best(i + 1, last, 0)
        options.append((c + 3, "D" + a, x))
        if faults[i] in ("", "truncated"):
            more = faults[i] == "truncated"
            c, a, x = best(i + 1, want, 0)
            options.append((c + 2 + more, "R" + a, (f"{want}:{text}", *x)))
            if role[:1] == "s" and last is None or role[:1] == want[0]:
                c, a, x = best(i + 1, "system" if role[:1] == "s" else want, 0)
                options.append((c + more, "K" + a, (f"{role}:{text}", *x)))
        return min(options)

    cost, audit, lines = best(0, None, 0)
    known = [t for t, _, _ in turns if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(lines)


def plain(rows):
    groups = {r[0]: [] for r in rows}
    for c, t, role, text in damage(rows):
        groups[c].append((t, role, text))
    digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    out = []
    for c, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
        *counts, text = repaired(turns)
        out.append((c, *counts, hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(out, key=str)


def rows(seed):
    rng, out = random.Random(seed), []
    roles = ["user", "assistant", "system", "tool", "u", "", None, "svc"]
    for c in range(30):
        natural = c % 2
        for t in range(rng.choice([1, 2, 3, 5, 8, 12])):
            role = ("user", "assistant")[t % 2] if natural and rng.random() < 0.8 else rng.choice(roles)
            out.append((c, t * rng.choice([1, 1, 2]), role, rng.choice([f"turn {t}.", f"turn {t}", "again!", " \t", None, "why?  \n", "ü。", "no end"])))
    out += [(None, None, "user", "without ids."), (None, 3, "assistant", "yes."), (77, None, None, None), (78, 5, "user", "x."), (78, 5, "user", "x.")]
    return out


def found(spark, data, **how):
    d = spark.createDataFrame([(*r, "a", 1, "s", 2) for r in data], SCHEMA).repartition(3)
    got = cv.repair(cv.damaged(d), d, with_text=True, **how).collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("seed, size", [(1, 1), (2, 3), (3, 64)])
def test_repair_is_the_plain_search(spark, seed, size):
    data, stats = rows(seed), {}
    assert found(spark, data, size=size, stats=stats) == plain(data)
    assert (stats["passes"] > 0) == (size < 64)


def test_one_long_conversation_in_many_chunks(spark):
    rng = random.Random(9)
    data = [(1, t, rng.choice(["user", "assistant"]) if rng.random() < 0.5 else ("user", "assistant")[t % 2], f"said at {t}" + "." * (rng.random() < 0.7)) for t in range(300)]
    data += [(2, t, "tool", f"{t}.") for t in range(41)]  # roles that fit nowhere
    stats = {}
    got = found(spark, data, size=8, stats=stats)
    want = plain(data)
    assert got == want
    assert stats["passes"] >= 1


def test_dropped_whole_and_no_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = found(spark, [(gone, 0, "user", "x.")])
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), "")]
    assert found(spark, []) == []


def test_a_vector_that_only_differs_by_a_constant_is_the_same():
    a, _ = cv.step((0, 4, 2, 0), "u")
    b, more = cv.step((5, 9, 7, 5), "u")
    assert a == b and more == cv.step((0, 4, 2, 0), "u")[1] + 5
    assert cv.rerun((0, 0, 2, 0), (0, 4, 2, 0), "uaua") is None
