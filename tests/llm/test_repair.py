"""Repair against a search through all edits, and the trie's sharing."""

import hashlib
import heapq
import random
import zlib

import pytest
from oracle import duck, same_rows

from sifterra.llm import repair
from sifterra.llm.queries import ORACLES, QUERIES
from sifterra.llm.repair import RepairTrie

WHITE = " \t\n\x0b\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, signature string, plan long"


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(key.encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(c for c in text if c not in ".!?")
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def _accepts(roles):
    s = "".join(r[:1] or "_" for r in roles)
    s = s[1:] if s.startswith("s") and len(s) > 1 else s
    return s == "ua" * (len(s) // 2)


def _cheapest(rows):
    """(cost, audit, repaired rows) by uniform-cost search in the order (cost, audit)."""
    most, heap, done = len(rows), [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, made = heapq.heappop(heap)
        if at == most and _accepts([r for r, _ in made]):
            return cost, audit, made
        state = (at, tuple(r for r, _ in made[-1:]), len(made) == 0)
        if (state, audit) in done:
            continue
        done.add((state, audit))
        if audit.count("I") < 2 * most + 3 and not audit.endswith("III"):
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 3, audit + "I", at, (*made, (role, ""))))
        if at < most:
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, made))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*made, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, (*made, (new, text))))
        # prune what can not be extended to the grammar
        heap = [h for h in heap if _prefix([r for r, _ in h[3]])]
        heapq.heapify(heap)


def _prefix(roles):
    s = "".join(r[:1] or "_" for r in roles)
    s = s[1:] if s.startswith("s") else s
    return s == ("ua" * len(s))[: len(s)]


def _plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in _damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults, illegal = set(), [], 0
        for i, (_, _, role, text) in enumerate(mine):
            kept = text.rstrip(WHITE)
            faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None)
            seen.add((role, text))
            illegal += i > 0 and mine[i - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, made = _cheapest([(r[2], r[3], f) for r, f in zip(mine, faults, strict=True)])
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)


def _same(spark, rows):
    got = repair.repair_report(repair.damaged(_frame(spark, rows))).collect()
    assert len(got) == len({r.conv_id for r in got})
    assert {r.conv_id: tuple(r)[1:] for r in got} == _plain(rows)


def _random(seed, convs, most):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["A.", "B", "c!", "", " \n", "d? ", None, "é", "A."]
    rows = [(c, rng.choice([None, *range(most)]), rng.choice(roles[: rng.choice([2, 3, 6])]), rng.choice(texts)) for c in range(convs) for _ in range(rng.randrange(1, most))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_conversations_against_search(spark, seed):
    _same(spark, _random(seed, 60, 6))


def test_nulls_ties_repeats_and_gone(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    _same(spark, [(None, 1, "user", "a."), (None, None, None, None), (gone, 0, "user", "x."), (5000, 3, "user", "a."), (5000, 3, "user", "a."), (5000, 3, "assistant", "a."), (5001, -4, "system", "s."), (5001, 9, "user", "q?")])


def test_empty_table(spark):
    assert repair.repair_report(repair.damaged(_frame(spark, []))).collect() == []


def test_long_conversation_and_repaired_turns(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"text {i}.") for i in range(3000)]
    rows += [(2, 0, "assistant", "x " * 200_000 + ".")]
    turns = _frame(spark, rows)
    got = {r.conv_id: r for r in repair.repair_report(turns).collect()}
    assert got[1].cost == 0 and got[1].audit == "K" * 3000
    assert got[2].cost == 3 and got[2].audit == "IK"
    lines = repair.repaired_turns(turns).orderBy("conv_id", "position").collect()
    for conv in (1, 2):
        mine = [r for r in lines if r.conv_id == conv]
        assert [r.position for r in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == got[conv].repaired_sha256


def test_layers_are_computed_once_for_each_shared_prefix():
    rng = random.Random(4)
    known = sorted({"".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(12))) for _ in range(400)})
    trie = RepairTrie()
    got = [trie.insert(s) for s in known]
    assert trie.computed == len({s[:i] for s in known for i in range(1, len(s) + 1)})
    assert got == [RepairTrie().insert(s) for s in known]


def test_query_oracle(spark, sf_dir):
    same_rows(duck(sf_dir), QUERIES["op11_repair"](spark, sf_dir), ORACLES["op11_repair"])
