import hashlib
import random
import zlib

import duckdb
import pytest

from hazardframe.llm import conversation_sql, prefix_trie

NAMES = prefix_trie.NAMES


def rebuild(rows: list[tuple]) -> dict[int, list[tuple]]:
    own: dict = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs: dict[int, list[tuple]]) -> list[tuple]:
    members: dict = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    inner = {p[:-1] for p in members if p}
    leaves = [p for p in members if p not in inner]
    cost = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in members.items()}
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        below = [q for q in members if q[: len(p)] == p]
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(q[:-1] == p and q != () for q in members),
            sum(q[: len(p)] == p for q in leaves), sum(cost[q] for q in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def conversations() -> list[tuple]:
    r = random.Random(8)
    starts = [[("system", "Be kind.")], [("user", "hé?"), ("assistant", "no.")], [("user", "hé?")], []]
    rows = []
    for c in [*range(-12, 60), 99, 101, 205]:
        turns = [*r.choice(starts), *[(r.choice(["user", "assistant"]), r.choice(["a", "b", ""])) for _ in range(r.randint(0, 9))]]
        rows += [(c, t, *turn) for t, turn in enumerate(turns)]
    rows += [(c, t, "user", f"copy {t}") for c in range(300, 340) for t in range(12)]  # a large group of copies
    rows += [(c, t, "user", f"long {t if t < 70 or c % 2 else -t}") for c in range(400, 406) for t in range(90)]  # long ones that part late
    rows += [(410, t, "user", f"alone {t}") for t in range(75)]
    rows += [(None, 0, "user", "of no id"), (500, None, None, None), (500, 1, "user", None), (501, 0, None, ""), (501, 0, "a", "tie"), (501, 0, "a", "also"), (502, 3, "user", "é" * 40_000)]
    return rows + [(503, 0, "user", "same"), (503, 0, "user", "same"), (504, 0, "user", "same")]


def frame(spark, rows):
    """With further columns whose names clash with internal ones."""
    wide = [(c, t, r, x, 1, b"k", 2, 3) for c, t, r, x in rows]
    return spark.createDataFrame(wide, "conv_id long, turn long, role string, text string, rank int, key binary, size int, w int").repartition(3)


@pytest.mark.parametrize("window, splitter_bytes, shard_bytes", [(512, 1 << 22, 1 << 23), (5, 1 << 20, 500), (32, 300, 1000)])
def test_nodes_equal_brute_force(spark, window, splitter_bytes, shard_bytes):
    rows = conversations()
    got = prefix_trie.nodes(*prefix_trie.rebuilt(prefix_trie.turns_of(frame(spark, rows))), window, splitter_bytes, shard_bytes)
    assert sorted((tuple(x[n] for n in NAMES) for x in got.collect()), key=repr) == sorted(brute(rebuild(rows)), key=repr)


def test_sql_equals_brute_force():
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    rows = [x for x in conversations() if x[0] is None or x[0] >= 0]
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = db.sql(f"SELECT {', '.join(NAMES)} FROM ({conversation_sql.TRIE})").fetchall()
    assert sorted(got, key=repr) == sorted(brute(rebuild(rows)), key=repr)


def test_a_group_of_copies_is_split(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(200) for t in range(4)]
    turns, lengths = prefix_trie.rebuilt(prefix_trie.turns_of(frame(spark, rows)))
    keys = spark.createDataFrame([(bytes(64), c) for c in range(200)], "key binary, conv_id long")
    assert len(prefix_trie._splitters(keys, 1 << 20, 1000)) > 10
    got = {tuple(x[n] for n in NAMES) for x in prefix_trie.nodes(turns, lengths, 512, 1 << 20, 1000).collect()}
    assert got == set(brute(rebuild(rows)))


def test_empty_table(spark):
    empty = frame(spark, [(1, 1, "a", "b")]).limit(0)
    assert prefix_trie.nodes(*prefix_trie.rebuilt(prefix_trie.turns_of(empty))).count() == 0
