"""Prefix trie and structure repair of conversations against brute-force versions."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexarium.llm import conversation_repair as cr
from lexarium.llm import prefix_trie as pt
from lexarium.llm import turns as tn


def conversation_rows(seed=5, n=60):
    rng = random.Random(seed)
    texts = ["Hello there.", "What is it?", "It is so", "Yes!", "", " \n", "No.  ", "ends with space. \t", "é ü.", "a.b,c"]
    out = []
    for c in range(n):
        if c % 17 == 16:
            continue  # absent
        k = rng.choice([1, 2, 3, 5, 8, 12]) if c != 20 else 70
        for t in range(k):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else (["user", "assistant"][t % 2])
            if t == 0 and rng.random() < 0.4:
                role = "system"
            out.append((c, t if rng.random() > 0.1 else t + 100, rng.choice([role] * 9 + ["tool", None, "Ugly"]), rng.choice(texts + [None, f"text {c} {t}."])))
    out += [(200, None, "user", "Null turn."), (200, 0, "assistant", "So."), (201, None, None, None), (203, -4, "user", "x."), (203, 9, "assistant", "y.")]
    out += [(300, 0, "user", "Same."), (300, 0, "user", "Same."), (300, 1, "user", "Same."), (9_000_000_001, 0, "user", "Far."), (9_000_000_000, 0, "user", "Far.")]
    return out


def order_key(turn, role, text):
    whole = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    return (turn is not None, turn or 0, whole[:15], whole[15:30])


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.select("*", *[F.lit("c").alias(x) for x in ("pos", "depth", "kind", "d1", "_range", "copy", "letter", "n", "a")]).repartition(5)


def plain_trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append((t is not None, t or 0, r, order_key(t, r, x)[2:], x))
    for v in by.values():
        v.sort()
    seqs = {}
    for c, v in by.items():
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = [(x[2], x[4]) for x in by.get(c - c % 5, [])[:h] + v[h:]]
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids, out = defaultdict(list), {}
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    total = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        total[node] = (sum(total[k][0] for k in kids[node]) or 1, own + sum(total[k][1] for k in kids[node]))
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(node))
        out[min(m), len(node)] = (min(members[node[:-1]]) if node else None, len(m), len(kids[node]), *total[node], hashlib.sha256(ends.encode()).hexdigest())
    return out


def got_trie(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def test_trie(spark):
    rows = conversation_rows() + [(None, 0, "user", "nobody")]
    assert got_trie(pt.prefix_trie(pt.turn_rows(frame(spark, rows)))) == plain_trie(rows)


def test_trie_of_alike_long_and_sparse_conversations(spark, monkeypatch):
    """Blocks and pieces of a few rows, many copies, one path of 300 turns."""
    monkeypatch.setattr(pt, "BLOCK", 7)
    monkeypatch.setattr(pt, "PIECE", 3)
    rows = [(c, t, "user" if t % 2 else "assistant", f"t{t}") for c in range(1000, 1060) for t in range(4)]
    rows += [(5, t, "user", f"deep {t}") for t in range(300)] + [(6, t, "user", f"deep {t}") for t in range(290)]
    rows += [(7 * 10**15 + k, 0, "user", "t1") for k in range(5)] + [(-5, 0, "user", "neg"), (-4, 0, "user", "neg")]
    assert got_trie(pt.prefix_trie(pt.turn_rows(frame(spark, rows)))) == plain_trie(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert pt.prefix_trie(pt.turn_rows(none)).count() == 0 and cr.repair(none).count() == 0


def test_places_cross_ranges(spark):
    """One group over many ranges, others inside one; null groups and keys come first."""
    rows = [(1, k, None) for k in range(500)] + [(2, None, 0), (2, 5, 1), (2, None, 1), (None, 3, 0), (None, 2, 0)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in tn.placed(spark.createDataFrame(rows, "g long, x long, y long").repartition(7), "g", ["x", "y"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(1, k, None, k) for k in range(500)} | {(2, None, 0, 0), (2, None, 1, 1), (2, 5, 1, 2), (None, 2, 0, 0), (None, 3, 0, 1)}


def cheapest(kinds):
    """(cost, audit) by Dijkstra over (cost, audit): the first end reached is cheapest and ASCII-least. kinds: (initial, fault)."""
    need = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, k, last = heapq.heappop(heap)
        if k == len(kinds) and last in ("", "a"):
            return cost, audit
        if (k, last, audit) in done or len(audit) > 2 * len(kinds) + 4:
            continue
        done.add((k, last, audit))
        heapq.heappush(heap, (cost + 5, audit + "I", k, need[last]))
        if k < len(kinds):
            initial, fault = kinds[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, last))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if initial == need[last] or (initial == "s" and last == ""):
                    heapq.heappush(heap, (cost + extra, audit + "K", k + 1, initial))
                heapq.heappush(heap, (cost + extra + 1, audit + "R", k + 1, need[last]))
    raise AssertionError


def test_solve_is_cheapest_and_least():
    rng = random.Random(1)
    letters = "suaosuaoSUAO12345678"
    for k in range(250):
        s = "".join(rng.choices(letters, k=rng.randint(0, 6)))
        assert cr.solve(s) == cheapest([cr.read_letter(x) for x in s]), s
    cost, audit = cr.solve("ua" * 50_000 + "u")
    assert cost == 2 and len(audit) == 100_001 and audit.count("D") == 1


def plain_repair(rows):
    by, ids = defaultdict(list), set()
    for c, t, r, x in rows:
        ids.add(c)
        r, x = " " if r is None else r, " " if x is None else x
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if code == 0:
            continue
        x = "" if code == 1 else "".join(ch for ch in x if ch not in ".!?") if code == 2 else x
        r = "user" if code == 4 else r
        by[c] += [(t, r, x)] * (2 if code == 3 else 1)
    out = {}
    for c in ids:
        v = sorted(by[c], key=lambda y: order_key(*y))
        turns = [t for t, _, _ in v if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, kinds = set(), []
        for _, r, x in v:
            bare = x.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((r, x))
            kinds.append((r[:1] if r[:1] in ("s", "u", "a") else "o", fault))
        count = lambda f: sum(k[1] == f for k in kinds)
        illegal = sum(p[1][:1] + q[1][:1] not in ("su", "ua", "au") for p, q in zip(v, v[1:], strict=False))
        cost, audit = cr.solve("".join(encoded(*k) for k in kinds)) if len(kinds) > 8 else cheapest(kinds)
        done, last, k = [], "", 0
        need = {"": "user", "s": "user", "u": "assistant", "a": "user"}
        for e in audit:
            if e == "I":
                done.append(f"{need[last]}:")
            elif e == "K":
                done.append(f"{v[k][1]}:{v[k][2]}")
            elif e == "R":
                done.append(f"{need[last]}:{v[k][2]}")
            last, k = done[-1][0] if e != "D" else last, k + (e != "I")
        assert k == len(v)
        out[c] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def encoded(initial, fault):
    at = "suao".index(initial)
    return cr.FAULTS[fault][at] if fault else initial


@pytest.mark.parametrize("piece", [4096, 3])
def test_repair(spark, monkeypatch, piece):
    monkeypatch.setattr(cr, "PIECE", piece)
    rows = conversation_rows() + [(None, 3, "user", "nobody."), (None, None, "assistant", None), (77_777, 0, "user", "long " * 300_000 + ".")]
    dropped = next(c for c in range(5000, 6000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    got = cr.repair(frame(spark, rows)).collect()
    want = plain_repair(rows)
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got} == want
    assert len(got) == len(want) and want[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
