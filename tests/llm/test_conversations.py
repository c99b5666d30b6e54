import random
import sys

import brute
from tracklake.llm import conversations
from tracklake.llm.conversations import op13_conversations

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
sys.setrecursionlimit(10_000)
SCHEMA = "conv_id long, turn long, role string, text string"


def report(frame):
    out = conversations.repair_report(conversations.repair_turns(conversations.turn_faults(frame)))
    return sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=repr)


def made(seed, n):
    """Conversations of odd rows: null and repeated turns, null, blank, empty and cut texts, unknown and empty roles."""
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut", "cut  ", " \t", "", None, "a\nb.", "é。", "a. "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "User", None, ""]
    return [(conv if conv else None, rng.choice([None, t, t, t, rng.randint(0, 9)]), rng.choice(roles), rng.choice(texts)) for conv in range(n) for t in range(rng.choice([1, 2, 3, 4, 6, 9, 14]))]


def test_op13_whole_tables(spark, sf_dir):
    for folder in (sf_dir, sf_dir.replace("0.001", "0.01")):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        got = [tuple(r[c] for c in COLUMNS) for r in op13_conversations(spark, folder).collect()]
        assert sorted(got) == sorted(brute.conversations(rows))
        assert sum(r[6] > 0 for r in got) > 0 and any("I" in r[7] for r in got) and any("R" in r[7] for r in got)


def test_odd_rows_and_ties(spark):
    rows = made(11, 600)
    assert report(spark.createDataFrame(rows, SCHEMA).repartition(5)) == sorted(brute.conversations(rows, damage=False), key=repr)


def test_spilled_conversations_are_the_same(monkeypatch):
    rng = random.Random(3)
    rows = [(t, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{t}.", "cut", f"x {t}", ""]), rng.choice([None, None, "truncated", "blank"])) for t in range(300)]

    def turns(held):
        monkeypatch.setattr(conversations, "HELD_ROWS", held)
        opened = conversations._Open(1)
        for row in rows:
            opened.add(*row)
        return len(opened.blocks), list(opened.turns())

    blocks, spilled = turns(7)
    assert blocks == 42 and (0, spilled) == turns(10_000)
    cost, audit, _ = brute._cheapest(tuple(r[1:] for r in rows))
    assert "".join(r[1] for r in spilled) == audit


def test_large_ids_and_batches(spark):
    big = 2**60 + 1
    rows = [(big, None, "user", "Hi."), (big, big, "assistant", "Yes."), (None, 1, "assistant", "Late.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert report(spark.createDataFrame(rows, SCHEMA)) == sorted(brute.conversations(rows, damage=False), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, 0, "user", "A.", "x", 5, "D")], SCHEMA + ", fault string, place long, edit string")
    assert [tuple(r) for r in conversations.repair_conversations(frame).collect()] == [(1, 0, "user", "A."), (1, 1, "assistant", "")]
    assert conversations.repair_conversations(frame.where("false")).count() == 0
    assert report(frame.where("false")) == []


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "Yes.")]
    out = report(spark.createDataFrame(rows, SCHEMA))
    assert out == brute.conversations(rows, damage=False) and out[0][7] == "KK"
