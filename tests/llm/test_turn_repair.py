"""Turn repair: alignments against a plain search, blocks against whole, SQL, odd rows."""

import hashlib
import itertools
import random

import duckdb
import pytest

from tesserae.llm import queries, turn_repair
from tesserae.llm.turn_repair import Aligner, Repair

NEXT = {"0": "su", "s": "u", "u": "a", "a": "u"}


def plain(codes):
    """Least cost and audit by trying every edit from every state, shortest ways first."""
    layer = {"0": (0, "")}

    def inserted(states):
        for _ in range(3):
            for p, (cost, audit) in list(states.items()):
                for q in NEXT[p].replace("s", ""):
                    way = (cost + 5, audit + "I")
                    states[q] = min(states.get(q, way), way)
        return states

    layer = inserted(layer)
    for c in codes:
        after = {}
        for p, (cost, audit) in layer.items():
            moves = [(p, turn_repair.DELETE, "D")]
            if c not in "bd":
                extra = 5 if c.isupper() else 0
                moves += [(q, extra, "K") if c.lower() == q else (q, 1 + extra, "R") for q in NEXT[p] if c.lower() == q or q != "s"]
            for q, more, edit in moves:
                way = (cost + more, audit + edit)
                after[q] = min(after.get(q, way), way)
        layer = inserted(after)
    return min(layer[p] for p in "0a" if p in layer)


def whole(codes):
    """One alignment of all turns, without blocks."""
    found = Aligner().block(codes, "0")
    return min(found[p] for p in "0a" if p in found)


def test_every_short_conversation():
    for n in range(5):
        for codes in itertools.product("suaoSUAbd", repeat=n):
            assert whole("".join(codes)) == plain(codes), codes


def test_longer_conversations():
    rng = random.Random(7)
    for _ in range(120):
        codes = "".join(rng.choices("suaoSUAObd", [1, 8, 8, 1, 1, 2, 2, 1, 2, 2], k=rng.randrange(5, 31)))
        assert whole(codes) == plain(codes), codes


def test_insertions_where_deleting_is_dear(monkeypatch):
    monkeypatch.setattr(turn_repair, "DELETE", 9)
    rng = random.Random(9)
    audits = ""
    for n in (1, 2, 3, 5, 8, 20):
        for _ in range(40):
            codes = "".join(rng.choices("suaoSUAbd", [2, 8, 8, 1, 1, 2, 2, 1, 1], k=n))
            assert whole(codes) == plain(codes), codes
            audits += whole(codes)[1]
    assert set(audits) == set("DIKR")


def streamed(rows):
    one = Repair(Aligner())
    for turn, role, text, letter in rows:
        one.add(turn, role, text, letter)
    return one.result()


def test_blocks_give_what_the_whole_gives():
    rng = random.Random(8)
    for n in [31, 32, 33, 64, 150, 400]:
        codes = "".join(rng.choices("suaoSUAbd", [1, 9, 9, 1, 1, 1, 1, 1, 1], k=n))
        names = {"s": "system", "u": "user", "a": "assistant"}
        rows = [(i, names.get(c.lower(), "tool"), f"t{i}", c) for i, c in enumerate(codes)]
        got = streamed(rows)
        cost, audit = plain(codes)
        assert (got["cost"], got["audit"]) == (cost, audit)
        out, at = [], iter(rows)
        for edit in audit:
            row = next(at) if edit != "I" else None
            if edit == "K":
                out.append((row[1], row[2]))
            elif edit != "D":
                out.append(("assistant" if out and out[-1][0] == "user" else "user", row[2] if row else ""))
        assert got["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


def test_only_deletions_and_no_turns():
    assert whole("bbd") == (6, "DDD")
    assert whole("") == (0, "")
    assert streamed([])["audit"] == ""


def conversations():
    rng = random.Random(11)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 10)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "What", " ", "", None, "Really? ", "So.\n", "é。", f"t{rng.randrange(99)}.", "..."])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), role, text))
    rows += [(None, 0, "user", "Hm."), (None, 1, "assistant", "Well."), (None, None, "user", "Null turn."), (500, 3, None, None)]
    rows += [(600, t, "user" if t % 2 == 0 else "assistant", f"T{t}.") for t in range(150)]
    rows += [(601, 1, "user", "Same."), (601, 1, "user", "Same."), (601, 1, "user", "Same."), (602, 5, "user", "x" * 300_000 + ".")]
    return rows


def test_against_sql(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1, "x") for r in conversations()], "conv_id long, turn long, role string, text string, code int, seen string")
    df.repartition(3).write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op12_turn_repair"](spark, f"file://{tmp_path}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    columns = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES['op12_turn_repair']})").fetchall()
    rows = got.collect()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in rows))) == sorted(map(repr, expected))
    assert len(rows) == len({r[0] for r in conversations()})
    assert {"D", "K", "R"} == {edit for r in rows for edit in r["audit"]}  # an insertion is never cheapest at these costs


def test_lost_conversation_and_empty_table(spark):
    zeros = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
    gone = spark.createDataFrame([(1, 0, "user", "a.", True), (2, 0, "user", "a.", False), (2, 4, "assistant", "b.", False)], "conv_id int, turn int, role string, text string, gone boolean")
    rows = {r["conv_id"]: r.asDict() for r in turn_repair.repair(gone).collect()}
    assert rows[1] == {"conv_id": 1, **zeros, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert rows[2] == {"conv_id": 2, **zeros, "gaps": 3, "audit": "KK", "repaired_sha256": hashlib.sha256(b"user:a.\nassistant:b.").hexdigest()}
    empty = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert turn_repair.repair(turn_repair.damage(empty)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_order_of_rows_does_not_matter(spark, seed):
    rows = conversations()
    rng = random.Random(seed)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(1 + 3 * seed)
    once = {r["conv_id"]: r for r in turn_repair.repair(turn_repair.damage(df)).collect()}
    sorted_ = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    assert once == {r["conv_id"]: r for r in turn_repair.repair(turn_repair.damage(sorted_)).collect()}
