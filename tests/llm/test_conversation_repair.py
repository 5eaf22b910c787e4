import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import types as T

from blotter.llm import conversation_repair as cr

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                     T.StructField("audit", T.StringType()), T.StructField("print", T.LongType())])  # clashing names
STATES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def brute(letters):
    """(cost, audit) by extending every path row by row, all tied audits kept as text."""
    def with_inserts(at):
        for _ in range(3):
            for (state, (cost, audit)) in list(at.items()):
                for x in "ua":
                    if to := STATES.get((state, x)):
                        at[to] = min(at.get(to, (10**9, "")), (cost + 3, audit + "I"))
        return at

    at = with_inserts({"": (0, "")})
    for row in letters:
        new = {}
        for state, (cost, audit) in at.items():
            moves = [(state, 4, "D")]
            if row != "-":
                extra = 3 if row.isupper() else 0
                moves += [(to, extra, "K") for x, to in [(row.lower(), STATES.get((state, row.lower())))] if to]
                moves += [(STATES[state, x], 3 + extra, "R") for x in "ua" if (state, x) in STATES]
            for to, w, e in moves:
                new[to] = min(new.get(to, (10**9, "")), (cost + w, audit + e))
        at = with_inserts(new)
    return min(v for s, v in at.items() if s in ("", "a"))


def test_cheapest_equals_brute_force():
    for n in range(5):
        for letters in itertools.product("suaxUA-", repeat=n):
            assert cr.cheapest("".join(letters)) == brute(letters), letters
    rng = random.Random(5)
    for _ in range(400):
        letters = "".join(rng.choice("suaxSUAX-uaua") for _ in range(rng.randint(5, 60)))
        assert cr.cheapest(letters) == brute(letters), letters


def test_equal_costs_choose_the_least_audit():
    assert cr.cheapest("") == (0, "")
    assert cr.cheapest("s") == (4, "D")  # a lone system turn is no conversation
    assert cr.cheapest("ua") == (0, "KK")
    assert cr.cheapest("a") == (3, "IK")
    assert cr.cheapest("uua") == (3, "KIKK")
    assert cr.cheapest("ux") == (3, "KR") and cr.cheapest("xx") == (6, "RR")


def expected(rows):
    """Independent plain-Python version of the whole report, by conversation."""
    convs = {}
    for conv, turn, role, text in (r[:4] for r in rows):
        own = convs.setdefault(conv, [])
        part = lambda v: " " if v is None else str(v)
        h = zlib.crc32(f"{part(conv)}:{part(turn)}".encode()) % 20
        role, text = part(role), part(text)
        if h == 0:
            continue
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, letters, faults = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            first = role[:1] if role[:1] in ("s", "u", "a") else "x"
            letters += "-" if fault in ("b", "d") and fault else first.upper() if fault else first
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = brute(letters)
        left, lines, at = len(audit) - audit.count("D"), [], 0
        for e in audit:
            if e != "I":
                _, role, text = own[at]
                at += 1
            if e == "D":
                continue
            turn = len(lines) - left % 2
            given = "assistant" if turn % 2 else "user"
            lines.append(f"{role}:{text}" if e == "K" else f"{given}:{text if e == 'R' else ''}")
        out[conv] = (gaps, faults["b"], faults["d"], faults["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = ["Yes.", "No!", "Why?", "and", " ", "", None, "naïve é.", "tab.\t\n", "x" * 300_000 + ".", "Yes."]
    out = []
    for conv in [*range(150), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            out.append((conv, rng.choice([turn, turn, turn, None]), role, rng.choice(texts), "DD", 7))
    out += [(777, t, "user" if t % 2 == 0 else "assistant", f"turn {t}." if t % 7 else "open", None, None) for t in range(600)]  # a long one
    out += [(778, 1, "user", "again.", None, None)] * 5  # repeated rows
    return out


def test_report_equals_plain_python(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    got = cr.repair_report(cr.damage(df)).collect()
    want = expected(rows)
    assert {r.conv for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.sha256) == want[r.conv], r.conv


def test_repaired_rows_have_the_digest(spark, rows):
    df = cr.damage(spark.createDataFrame(rows, ROWS))
    plans = cr.plan(df)
    lines = {}
    for r in sorted(cr.repaired(df, plans).collect(), key=lambda r: (r.conv is not None, r.conv or 0, r.place)):
        lines.setdefault(r.conv, []).append((r.place, r.edit, f"{r.role}:{r.text}"))
    for r in cr.digests(df, plans).collect():
        own = lines.get(r.conv, [])
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(x for _, _, x in own).encode()).hexdigest() == r.sha256


def test_empty_table(spark):
    assert cr.repair_report(cr.damage(spark.createDataFrame([], ROWS))).count() == 0
