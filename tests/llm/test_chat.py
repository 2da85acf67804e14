import duckdb
from helpers import folder, write

from layerkv.llm import query_chat
from layerkv.llm.chat import CLOSE, OPEN, dialogues, perspectives

SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_agrees_with_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder()}/conversations.parquet'")
    got = query_chat.query(spark, folder())
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(sorted(got.columns)).collect())) == sorted(map(key, duck.sql(f"SELECT {', '.join(f'"{c}"' for c in sorted(got.columns))} FROM ({query_chat.SQL})").fetchall()))


def test_every_speaker_is_the_assistant_once(spark):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_start|>x"), (1, 2, "bob", "Hello"), (1, 3, "cy", None), (1, 4, "ann", "Bye"), (2, 0, "system", "alone")]
    out = {r["assistant"]: r for r in dialogues(spark.createDataFrame(turns, SCHEMA)).collect()}
    assert set(out) == {"ann", "bob", "cy"}
    assert out["bob"]["text"] == (
        f"{OPEN}system\nBe kind.{CLOSE}\n{OPEN}user name=ann\nHi < |im_start|>x{CLOSE}\n{OPEN}assistant\nHello{CLOSE}\n{OPEN}user name=cy\n{CLOSE}\n{OPEN}user name=ann\nBye{CLOSE}\n"
    )
    marked = lambda r: [r["text"][m["start"] : m["end"]] for m in r["masks"]]
    assert marked(out["bob"]) == ["Hello" + CLOSE] and marked(out["ann"]) == ["Hi < |im_start|>x" + CLOSE, "Bye" + CLOSE] and marked(out["cy"]) == [CLOSE]


def test_segments_fit_together_in_long_conversations(spark):
    turns = [(1, k, "ab"[k % 2], "t" * (k % 7)) for k in range(3000)] + [(None, 5, None, "x"), (None, None, None, "y"), (3, 1, "a", "same"), (3, 1, "a", "same"), (3, 1, "b", "other")]
    rows = perspectives(spark.createDataFrame(turns, SCHEMA)).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r["conv_id"], r["assistant"]), []).append(r)
    assert set(groups) == {(1, "a"), (1, "b"), (None, "unknown"), (3, "a"), (3, "b")}
    for g in groups.values():
        g.sort(key=lambda r: r["turn_no"])
        assert [r["turn_no"] for r in g] == list(range(len(g)))
        text = "".join(r["segment"] for r in g)
        assert all(text[r["start"] : r["end"]] == r["segment"] for r in g)
        assert all((r["loss_start"] is not None) == (r["speaker"] == r["assistant"]) for r in g)
    assert len(groups[1, "a"]) == 3000 and [r["turn"] for r in groups[None, "unknown"]] == [None, 5]


def test_edges(spark, tmp_path):
    assert query_chat.query(spark, write(spark, tmp_path, conversations=spark.createDataFrame([], SCHEMA))).collect() == []
    extra = spark.createDataFrame([(1, 0, "a", "hi", 9)], SCHEMA + ", segment long")
    assert len(query_chat.query(spark, write(spark, tmp_path, conversations=extra)).collect()) == 1
