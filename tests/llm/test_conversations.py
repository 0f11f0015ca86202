import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from listwright.llm import conversations, queries
from listwright.llm.conversations import Repair, Ropes, damage, edited, pair_grammar, repair_conversations, shorten, symbol
from tests.conftest import SF

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = BLANK.findall(text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_edits(rows, faults):
    """Least cost and first audit, forward over rows and last kept initial, texts compared as they are."""
    def insertions(best):
        for _ in range(2):
            for last, new in (("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                if last in best:
                    best[new] = min(best.get(new, (10**9, "")), (best[last][0] + 5, best[last][1] + "I"))
        return best

    best = insertions({"": (0, "")})
    for (role, _), fault in zip(rows, faults, strict=True):
        nxt = defaultdict(lambda: (10**9, ""))
        for last, (cost, audit) in best.items():
            nxt[last] = min(nxt[last], (cost + 2, audit + "D"))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            for new in "sua":
                if last + new in ("s", "u", "su", "ua", "au"):
                    if role[:1] == new:
                        nxt[new] = min(nxt[new], (cost + more, audit + "K"))
                    if new != "s":
                        nxt[new] = min(nxt[new], (cost + more + 1, audit + "R"))
        best = insertions(dict(nxt))
    return min(best[x] for x in ("", "a") if x in best)


def brute(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda x: x[:3])
        turns = [t for known, t, _, _ in own if known]
        pairs = [x[2:] for x in own]
        faults = brute_faults(pairs)
        cost, audit = brute_edits(pairs, faults)
        lines, todo, last = [], list(pairs), ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else todo.pop(0)
            if edit != "D":
                role = role if edit == "K" else "assistant" if last == "u" else "user"
                lines.append(f"{role}:{text}")
                last = role[:1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        illegal = sum(x[:1] + y[:1] not in ("su", "ua", "au") for (x, _), (y, _) in zip(pairs, pairs[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(lines))
    return out


NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def made(seed, n):
    rng = np.random.default_rng(seed)
    roles = ["system", "user", "assistant", "tool", "user", "assistant", None, ""]
    texts = ["Fine.", "Fine!", "cut off", "", " \n", "What?  ", "again. \t", None]
    rows = []
    for conv in range(n):
        turns = rng.choice(40, rng.integers(1, 14), replace=False)
        rows += [(conv if conv else None, int(t) if t else None, roles[rng.integers(8)], texts[rng.integers(8)]) for t in turns]
    return rows


@pytest.mark.parametrize("piece, most", [(4096, 2048), (3, 7)])
def test_repair_equals_brute_force(spark, monkeypatch, piece, most):
    monkeypatch.setattr(conversations, "PIECE_ROWS", piece)
    monkeypatch.setattr(conversations, "MAX_RULES", most)
    rows = made(piece, 150) + [(900, t, ("user", "assistant")[t % 2], f"text {t}.") for t in range(60)] * 2
    rows += [(901, None, "user", "same"), (901, None, "user", "same"), (901, 4, "assistant", "ok."), (902, 7, " ", " ")]
    cleaned = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = brute(cleaned)
    got = repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    assert {r["conv_id"]: (*(r[x] for x in NUMBERS), r["repaired"]) for r in got.collect()} == want


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(brute_damage(rows))
    got = {r["conv_id"]: r for r in queries.QUERIES["op13_conversations"](spark, SF).collect()}
    assert set(got) == {x[0] for x in rows}
    for conv, r in got.items():
        x = want.get(conv, (0,) * 6 + ("", ""))
        assert (*(r[n] for n in NUMBERS), r["repaired_sha256"]) == (*x[:-1], sha256(x[-1].encode()).hexdigest())


def test_damage_equals_brute_force(spark):
    rows = made(5, 60)
    got = damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert Counter(map(tuple, got.collect())) == Counter(brute_damage(rows))


def test_least_of_all_edit_sequences():
    """Every sequence of edits up to some insertions, tried one by one."""
    from itertools import product

    def tries(row, fault):
        yield 2, "D", ""
        if fault < 2:
            more = 5 if fault == 1 else 0
            if row in "sua":
                yield more, "K", row
            yield from ((1 + more, "R", x) for x in "ua")

    gaps = [(0, "", ""), (5, "I", "u"), (5, "I", "a"), (10, "II", "ua"), (10, "II", "au")]
    for rows in product("sua?", (0, 1, 2), "ua", (0, 2), "as", (0, 1)):
        roles, faults = rows[::2], rows[1::2]
        options = [x for r, f in zip(roles, faults, strict=True) for x in (gaps, list(tries(r, f)))] + [gaps]
        want = min((sum(x[0] for x in pick), "".join(x[1] for x in pick)) for pick in product(*options) if re.fullmatch("(s?(ua)+)?", "".join(x[2] for x in pick)))
        own = Repair()
        symbols = "".join(symbol("sua?".index(r), {0: 0, 1: 2, 2: 1}[f]) for r, f in zip(roles, faults, strict=True))
        assert own.cheapest(own.product(symbols)) == want


def test_ropes_compare_as_texts():
    rng = np.random.default_rng(8)
    ropes = Ropes()
    found = [ropes.leaf(x) for x in ("", "D", "I", "KK", "DDK")]
    for _ in range(300):
        found.append(ropes.join(*(found[k] for k in rng.integers(0, len(found), 2))))
    for a, b in rng.choice(found, (2000, 2)):
        assert ropes.less(a, b) == (ropes.write(a) < ropes.write(b))
    ropes.forget(3)
    assert len(ropes.known) == 3


def test_rules_shorten_and_spell_the_same(spark):
    rows = [("BAHBAHBAH", 3), ("BAHHBA", 2), ("AAAAAAA", 1), ("EK", 1)]
    rules = pair_grammar(spark.createDataFrame(rows, "symbols string, n long"))
    assert rules and len(shorten("BAHBAHBAH", rules)) < 4
    plain, ruled = Repair(), Repair(rules)
    for symbols, _ in rows:
        x = shorten(symbols, rules)
        for k in reversed(range(len(rules))):
            x = x.replace(chr(conversations.FIRST_RULE + k), rules[k])
        assert x == symbols
        assert ruled.cheapest(ruled.product(shorten(symbols, rules))) == plain.cheapest(plain.product(symbols))


def test_edits_give_roles():
    assert list(edited([("system", "x"), ("tool", "y"), ("user", "z")], "KRID")) == ["system:x", "user:y", "assistant:"]


def test_awkward(spark):
    schema = "conv_id long, turn long, role string, text string, kind string, audit long, h long, piece string"
    rows = [(None, None, None, None, "a", 1, 1, "x"), (1, None, None, "x" * 200_000, None, None, None, None), (1, 2, "user", None, "", 0, 0, "")]
    got = {r["conv_id"]: r for r in repair_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert got[None]["audit"] == "D" and got[1]["audit"] == "DD" and got[1]["blank"] == 1 and got[1]["truncated"] == 1
    assert repair_conversations(spark.createDataFrame([], schema)).count() == 0
    assert damage(spark.createDataFrame([], schema)).count() == 0
