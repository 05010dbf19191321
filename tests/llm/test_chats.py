"""Fill-in-the-middle, chat formatting and conversation repair against plain rules."""

import hashlib
import itertools
import json
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricelark.llm import chat, fim, queries, repair
from pricelark.llm.oracles import SQL_OP11, SQL_OP12, SQL_OP13

# --- fill in the middle ----------------------------------------------------------


@given(st.lists(st.booleans(), max_size=3000))
@settings(max_examples=40, deadline=None)
def test_rank_select(bits):
    v = fim.Bits.of(len(bits), lambda lo, hi: np.array(bits[lo:hi], bool))
    ones = [k for k, b in enumerate(bits) if b]
    at = np.arange(len(bits) + 1)
    assert v.rank(at).tolist() == [0, *itertools.accumulate(map(int, bits))]
    assert v.select(np.arange(len(ones))).tolist() == ones


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "Hola, señor!\n", "<P>", "a <M> b", "<", "<<S", "é😀x", "x" * 300_000 + "é" + "y z " * 700_000]
    texts += ["".join(rng.choice("ab<>PSM é\n\t😀Z1") for _ in range(rng.randrange(90))) for _ in range(400)]
    rows = [(k if k % 50 else None, t, k, "n", None) for k, t in enumerate(texts)] + [(3, "Hola, señor!\n", 1, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form string, output binary")
    made = fim.fill_in_middle(docs).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[5])
    assert sorted((tuple(r)[:6] for r in made), key=key) == sorted((plain_fim(i, t) for i, t, *_ in rows), key=key)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert sorted(r["again"] for r in made) == sorted(t or "" for _, t, *_ in rows)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    named = spark.createDataFrame([("x7", "one two three")], "doc_id string, text string")
    assert tuple(fim.fill_in_middle(named).first()) == plain_fim("x7", "one two three")


# --- chats -------------------------------------------------------------------------

RECORDS = [
    ({"prompt": "p", "completion": "c", "id": 4}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "", "system": "s"}, "prompt_response", [("system", "s"), ("user", "p"), ("assistant", "")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, "messages", [("user", "a"), ("assistant", "")]),
    ({"messages": [], "system": "s"}, "messages", [("system", "s")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "tool", "value": "c"}]}, "conversations", [("user", "a"), ("assistant", "b"), ("tool", "c")]),
    ({"prompt": "p"}, None, []),
    ({"prompt": "p", "completion": "c", "messages": []}, None, []),
    ({}, None, []),
]


def test_layouts(spark):
    rows = [(k, json.dumps(r), "own", "own") for k, (r, _, _) in enumerate(RECORDS)] + [(98, "not json", "", ""), (99, None, "", "")]
    made = chat.canonical(spark.createDataFrame(rows, "id int, record string, chat string, rows string"), "record").orderBy("id").collect()
    assert [(r["layout"], [tuple(t) for t in r["turns"]]) for r in made] == [(name, turns) for _, name, turns in RECORDS] + [(None, [])] * 2
    typed = spark.createDataFrame([(1, (("p", "c", 3),)[0]), (2, None)], "id int, record struct<prompt: string, completion: string, score: int>")
    assert [(r["layout"], [tuple(t) for t in r["turns"]]) for r in chat.canonical(typed, "record").orderBy("id").collect()] == [("prompt", [("user", "p"), ("assistant", "c")]), (None, [])]
    listed = spark.createDataFrame([(1, ([("a", "user", 1)],))], "id int, record struct<messages: array<struct<content: string, role: string, weight: int>>>")
    assert [tuple(t) for t in chat.canonical(listed, "record").first()["turns"]] == [("user", "a")]


def test_template(spark):
    rng = random.Random(5)
    bits = ["### ", "</turn>", "\\", "\n", "#", "<", "/turn>", ": ", ":", " ", "é", "😀", "assistant", "x", "", "</turn>\n", "$1"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
    rows = [(k, [(rng.choice(["user", "assistant", "system", text()]), text()) for _ in range(rng.randrange(5))]) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, turns array<struct<role: string, text: string>>").withColumn("m", chat.formatted(F.col("turns")))
    df = df.select("*", chat.parsed(F.col("m.text")).alias("back"), chat.learnt(F.col("m.text"), F.col("m.mask")).alias("learnt"))
    for r in df.collect():
        assert r["back"] == r["turns"]
        assert r["learnt"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
        assert sum(x["chars"] for x in r["m"]["mask"]) == len(r["m"]["text"])
        assert r["m"]["text"].count("</turn>") == len(r["turns"])


CONV = "conv_id long, turn long, role string, text string, fault string, rows int, seen int, record int"


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    """Conversations with nulls, repeated rows, equal turns, odd roles and long texts."""
    rng = random.Random(11)
    texts = ["Hi.", "Hi", "", " \t\n", "What?", None, "ok!  \n", "é", "x " * 50_000 + "."]
    rows = []
    for conv in [None, *range(160)]:
        for k in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([k, k, k, k + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]), rng.choice(texts), "f", 1, 2, 3))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    path = tmp_path_factory.mktemp("talks")
    spark.createDataFrame(rows, CONV).write.parquet(f"{path}/conversations.parquet")
    return str(path), rows


def same_as_sql(spark, path, name, sql, tmp_path):
    queries.queries()[name](spark, path).write.parquet(f"{tmp_path}/out")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    got, want = duck.execute(f"SELECT * FROM '{tmp_path}/out/*.parquet'").df(), duck.execute(sql).df()
    by = list(got.columns)
    assert sorted(want.columns) == sorted(by)
    rows = lambda df: sorted((tuple(map(str, r)) for r in df[by].itertuples(index=False)))
    assert rows(got) == rows(want)
    return got


def test_chat_query(spark, talks, tmp_path):
    got = same_as_sql(spark, talks[0], "op12_chat_format", SQL_OP12, tmp_path)
    assert (got["conv_id"] == -7).sum() == 1
    layouts = {r[0] for r in chat.canonical(chat.records_of(spark.read.parquet(f"{talks[0]}/conversations.parquet")), "record").select("layout").distinct().collect()}
    assert None not in layouts and len(layouts) >= 2


def test_chat_query_on_given_table(spark, sf):
    """The layouts that conversations are turned into, and that each is met through its fingerprint."""
    made = chat.format_chats(chat.records_of(spark.read.parquet(f"{sf}/conversations.parquet")), "record")
    counts = {r[0]: r[1] for r in made.groupBy("layout").count().collect()}
    assert set(counts) <= {"prompt", "instruction", "messages", "conversations"} and len(counts) >= 3


# --- repair ------------------------------------------------------------------------


def plain_repair(rows, c):
    """rows: (initial, fault). The least (cost, audit) of all edits with at most three insertions."""
    best = None

    def go(k, cost, audit, said, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if k == len(rows) and re.fullmatch(r"(s?(ua)+)?", said) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if inserted < 3:
            for x in "ua":
                go(k, cost + c.insert, audit + "I", said + x, inserted + 1)
        if k < len(rows):
            initial, fault = rows[k]
            go(k + 1, cost + c.delete, audit + "D", said, inserted)
            if fault not in ("blank", "duplicate"):
                more = c.truncated if fault == "truncated" else 0
                go(k + 1, cost + c.keep + more, audit + "K", said + initial, inserted)
                for x in "ua":
                    go(k + 1, cost + c.rerole + more, audit + "R", said + x, inserted)

    go(0, 0, "", "", 0)
    return best


@pytest.mark.parametrize("costs", [repair.Costs(), repair.Costs(delete=9, insert=2, truncated=1), repair.Costs(rerole=3, delete=4, insert=2)])
def test_fold(spark, costs):
    rng = random.Random(1)
    rows = [(k, [(rng.choice("uuaasx"), rng.choice([None, None, "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(5))]) for k in range(150)]
    df = spark.createDataFrame(rows, "id int, rows array<struct<initial: string, fault: string>>").withColumn("best", repair.cheapest(F.col("rows"), costs))
    for r in df.collect():
        assert tuple(r["best"]) == plain_repair([tuple(x) for x in r["rows"]], costs), r["rows"]


def test_repair_query(spark, talks, tmp_path):
    got = same_as_sql(spark, talks[0], "op13_conversation_repair", SQL_OP13, tmp_path)
    assert len(got) == len({r[0] for r in talks[1]}) and (got["truncated"] > 0).any() and (got["blank"] > 0).any() and (got["duplicate"] > 0).any() and (got["gaps"] > 0).any()


def test_damage(spark, talks):
    """Each fault by the crc of the key, and what all rows of a conversation are once they are dropped."""
    path, rows = talks
    got = sorted(map(str, (tuple(r) for r in repair.damage(spark.read.parquet(f"{path}/conversations.parquet")).collect())))
    want = []
    for conv, turn, role, text, *_ in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        changed = (conv, turn, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)
        want += [changed] * (0 if d == 0 else 2 if d == 3 else 1)
    assert got == sorted(map(str, want))


def test_repair_cases(spark, tmp_path):
    empty = spark.createDataFrame([], CONV)
    assert repair.repair(empty).count() == 0 and chat.format_chats(chat.records_of(empty), "record").count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi.", "", 1, 2, 3)], CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    row = queries.queries()["op13_conversation_repair"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    # a repeated row that lacks its end: the first is truncated, the second a duplicate
    talk = spark.createDataFrame([(1, 0, "user", "Hi"), (1, 0, "user", "Hi"), (1, 3, "assistant", "Yes."), (2, None, "user", "A."), (2, 5, "user", "B.")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in repair.repair(talk).collect()}
    assert tuple(got[1])[1:8] == (2, 0, 1, 1, 1, 4 + 2, "DDD") and got[1]["repaired"] == []
    assert (got[2]["gaps"], got[2]["cost"], got[2]["audit"], [tuple(t) for t in got[2]["repaired"]]) == (0, 1, "KR", [("user", "A."), ("assistant", "B.")])


@pytest.mark.parametrize("name,sql", [("op11_fill_in_middle", SQL_OP11), ("op12_chat_format", SQL_OP12), ("op13_conversation_repair", SQL_OP13)])
def test_given_tables(spark, sf, tmp_path, name, sql):
    queries.queries()[name](spark, sf).write.parquet(f"{tmp_path}/out")
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = duck.execute(f"SELECT * FROM '{tmp_path}/out/*.parquet'").df(), duck.execute(sql).df()
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
