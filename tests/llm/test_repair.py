import hashlib
import random
import re
import zlib

import pytest

from hazardframe.llm import auction, conversation_repair

WHITE = " \t\n\x0b\x0c\r"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """By dynamic programming over the roles so far: (cost, first audit)."""
    follow = {"": "s u".split(), "s": ["u"], "u": ["a"], "a": ["u"]}

    def insert(best):
        for _ in range(3):
            for end, (cost, text) in list(best.items()):
                new = follow[end][-1]
                best[new] = min(best.get(new, (1 << 60, "")), (cost + 3, text + "I"))
        return best

    best = {"": (0, "")}
    for initial, forced, truncated in rows:
        insert(best)
        new = {}
        for end, (cost, text) in best.items():
            options = [(end, cost + 4, "D")]
            extra = 3 * truncated
            if not forced:
                options += [(initial, cost + extra, "K")] if initial in follow[end] else []
                options.append((follow[end][-1], cost + 3 + extra, "R"))
            for to, c, edit in options:
                new[to] = min(new.get(to, (1 << 60, "")), (c, text + edit))
        best = new
    insert(best)
    return min(best[end] for end in ("", "a") if end in best)


def damage(rows: list[tuple]) -> dict:
    out: dict = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Reports and repaired rows."""
    reports, kept = [], []
    for conv, own in damage(rows).items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, count, signs = set(), [0, 0, 0], []
        for _, role, text in own:
            end = text.strip(WHITE)
            kind = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else 3
            seen.add((role, text))
            if kind < 3:
                count[kind] += 1
            signs.append((role[:1], kind < 2, kind == 2))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(signs)
        at, out = iter(own), []
        for edit in audit:
            row = None if edit == "I" else next(at)
            wanted = "assistant" if out and out[-1][0][:1] == "u" else "user"
            if edit != "D":
                out.append((row[1] if edit == "K" else wanted, "" if edit == "I" else row[2], edit))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _, _ in out))
        said = "\n".join(f"{r}:{t}" for r, t, _ in out)
        reports.append((conv, gaps, *count, illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()))
        kept += [(conv, i, e, r, t) for i, (r, t, e) in enumerate(out)]
    return reports, kept


def conversations() -> list[tuple]:
    r, rows = random.Random(4), []
    for c in range(-3, 60):
        for t in range(r.randint(1, 9)):
            rows.append((c, t + (5 if t > 3 and r.random() < 0.2 else 0), r.choice(["user", "assistant"]) if r.random() < 0.3 else ["user", "assistant"][t % 2], r.choice(["ok.", "no", "Yes! ", "", "fine.\n", f"t{r.random()}."])))
        if r.random() < 0.4:
            rows.append((c, -1, "system", "Be kind."))
    rows += [(70, None, "user", "null turn."), (70, None, None, None), (70, 2, "assistant", None), (71, None, "user", "a?"), (72, 0, "", "no role."), (72, 1, "unicorn", "kept."), (72, 2, "assistant", "é" * 50_000)]
    rows += [(None, t, "user" if t % 2 else "assistant", "of no id.") for t in range(6)]
    rows += [(80, 3, "user", "same.")] * 40 + [(81, 1, "user", "tie."), (81, 1, "assistant", "tie."), (81, 1, "assistant", "also.")]
    dropped = next(c for c in range(90, 900) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "gone.")] * 30
    return rows + [(1000, t, ["user", "assistant"][(t + t // 37) % 2], f"turn {t % 90}{'.' if t % 5 else ''}") for t in range(400)]


def frame(spark, rows):
    """With further columns whose names clash with internal ones."""
    wide = [(c, t, r, x, 1, "b", 2, True) for c, t, r, x in rows]
    return spark.createDataFrame(wide, "conv_id long, turn long, role string, text string, rank int, block string, place int, aside boolean").repartition(3)


@pytest.mark.parametrize("piece, fan", [(1, 2), (2, 3), (5, 2), (48, 64)])
def test_auction_equals_dynamic_programming(monkeypatch, piece, fan):
    monkeypatch.setattr(auction, "PIECE", piece)
    monkeypatch.setattr(auction, "FAN", fan)
    auction.piece.cache_clear()
    r = random.Random(piece)
    for _ in range(400):
        kinds = [(r.choice("suax" if r.random() < 0.4 else "ua"), r.random() < 0.2, r.random() < 0.2) for _ in range(r.randint(0, 30))]
        assert auction.solve("".join(auction.sign(*k) for k in kinds)) == cheapest(kinds)


def test_prices_are_a_proof():
    """Prices never overrun an arc, and the path's arcs are tight."""
    arcs, price = auction._lattice("sUadxuaAud", auction.PAIR, True)
    auction.settle(arcs, 0, len(arcs) - 1, price)
    assert all(price[i] <= cost + price[head] for i, own in enumerate(arcs) for cost, head, _ in own)
    nodes, _ = auction.first_tight(arcs, 0, len(arcs) - 1, price)
    assert price[0] == sum(min(c for c, h, _ in arcs[i] if h == j) for i, j in zip(nodes, nodes[1:]))


@pytest.mark.parametrize("block", [5, conversation_repair.BLOCK])
def test_reports_equal_brute_force(spark, block):
    rows = conversations()
    damaged = conversation_repair.damaged(frame(spark, rows))
    reports, kept = brute(rows)
    got = [tuple(r[c] for c in COLUMNS) for r in conversation_repair.report(damaged, block).collect()]
    assert sorted(got, key=repr) == sorted(reports, key=repr)
    out = [tuple(r[c] for c in ("conv_id", "place", "edit", "role", "text")) for r in conversation_repair.repaired(damaged, block).collect()]
    assert sorted(out, key=repr) == sorted(kept, key=repr)


def test_sound_conversations_stay(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "q?"), (1, 2, "assistant", "a."), (2, 0, "user", "q?"), (2, 1, "assistant", "a!")]
    got = conversation_repair.repaired(conversation_repair.rows_of(frame(spark, rows)))
    assert sorted(tuple(r) for r in got.collect()) == [(c, p, "K", r, t) for (c, _, r, t), p in zip(rows, (0, 1, 2, 0, 1))]


def test_empty_table(spark):
    assert conversation_repair.report(conversation_repair.damaged(frame(spark, [(1, 1, "a", "b")]).limit(0))).count() == 0
