"""Edits equal those of a plain search over all repairs; conversations of any shape hold little."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from postlake.llm.conversations import MOVES, Survivors, repair, summaries
from postlake.llm.queries import op11_conversations

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def _cheapest(rows, faults):
    """Cost, letters and repaired rows of the best repair, from the end backwards."""

    @cache
    def best(i, state, more):
        found = []
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            _, role, text = rows[i]
            cost, letters, rest = best(i + 1, state, 2)
            found.append((cost + 3, "D" + letters, rest))
            late = faults[i] == "truncated"
            if faults[i] in (None, "truncated"):
                for to in NEXT[state]:
                    options = [(0, "K", role)] if role[:1] == to else []
                    options += [(2, "R", {"u": "user", "a": "assistant"}[to])] if to != "s" else []
                    for price, letter, name in options:
                        cost, letters, rest = best(i + 1, to, 2)
                        found.append((cost + price + late, letter + letters, ((name, text), *rest)))
        if more:
            for to in NEXT[state]:
                if to != "s":
                    cost, letters, rest = best(i, to, more - 1)
                    found.append((cost + 2, "I" + letters, (({"u": "user", "a": "assistant"}[to], ""), *rest)))
        return min(found) if found else (10 ** 9, "", ())

    return best(0, "", 2)


def _digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest()


def _brute(rows):
    """All conversations of (conv, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, _digest(*r[1:])))
        faults = _faults(own)
        cost, audit, repaired = _cheapest(own, faults)
        turns = {t for t, _, _ in own if t is not None}
        names = [r[:1] for _, r, _ in own]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(names, names[1:], strict=False)), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest())
    return out


def _random(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "u", "Assistant", "", None]
    texts = ["Yes.", "No!", "why?  \n", "cut off", "", " \t", None, "é。", "x" * 3000 + ".", "other", "more"]
    rows = []
    for conv in [*range(250), None]:
        n, usual = rng.choice([1, 2, 3, 5, 8, 12, 20]), rng.random()
        for turn in range(n):
            plain = rng.random() < usual
            rows.append((conv, rng.choice([turn, turn, turn, turn, 2 * turn, turn // 2, None, -turn]) if not plain else turn,
                         ["user", "assistant"][turn % 2] if plain else rng.choice(roles), f"Text {turn}." if plain else rng.choice(texts)))
            if rng.random() < 0.1:
                rows += [rows[-1]] * rng.randrange(1, 3)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_search(spark, seed):
    rows = _random(seed)
    frame = spark.createDataFrame([(*r, 7, "z") for r in rows], "conv_id long, turn long, role string, text string, place int, `a.b` string").repartition(4)
    edits = repair(frame)
    got = {r.conv: tuple(r)[1:] for r in summaries(edits).collect()}
    want = _brute(rows)
    assert got.keys() == want.keys()
    for conv, row in want.items():
        assert got[conv] == row, (conv, [r for r in rows if r[0] == conv])
    if seed == 1:
        assert edits.columns == ["conv", "place", "edit", "turn", "was", "fault", "role", "text"]
        assert edits.where("edit <> 'I'").count() == len(rows)
        assert repair(frame.limit(0)).count() == 0


def test_the_query_damages_and_keeps_every_conversation(spark, tmp_path):
    rows = [(c, t, r, f"{c} {t}{e}" if e else None) for c in range(300) for t, (r, e) in enumerate([("user", "?"), ("assistant", "."), ("user", ""), (None, "x")][:c % 4 + 1])]
    rows += [(None, None, "user", "Hi."), (777, None, "user", "Hi.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    hurt = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if fate == 1 else "".join(ch for ch in x if ch not in ".!?") if fate == 2 else x
        hurt += [(c, t, "user" if fate == 4 else r, x)] * {0: 0, 3: 2}.get(fate, 1)
    want = _brute(hurt)
    none = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    got = {r.conv_id: tuple(r)[1:] for r in op11_conversations(spark, str(tmp_path)).collect()}
    assert got == {c: want.get(c, none) for c in {r[0] for r in rows}}
    assert none in got.values()


def test_survivors_hold_only_what_is_not_certain():
    search, out, held = Survivors(), 0, 0
    for i in range(20_000):
        out += len(list(search.step(i, MOVES["ua"[i % 2] if i % 97 else "", i % 13 == 0])))
        held = max(held, len(search.rows))
    rest, closing = search.close()
    assert out + len(rest) == 20_000 and held < 50 and len(search.parent) < 500


def test_long_unresolved_stretches_stay_cheap():
    """Rows of unknown roles keep two ends open for good: nothing is certain, yet a step does not grow."""
    search = Survivors()
    for i in range(100_000):
        list(search.step(i, MOVES["", False]))
    rest, closing = search.close()
    assert [e[0] for *_, e in rest] == ["R"] * 100_000 and closing == ()
