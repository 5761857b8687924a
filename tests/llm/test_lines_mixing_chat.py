import collections
import hashlib
import json
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheaf.llm import chat_format as cf
from sheaf.llm import mixing
from sheaf.llm.line_dedup import Spread, dedup_lines
from sheaf.llm.oracles import LINE_DEDUP, MIXING

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line = lambda n=8: " ".join(word() for _ in range(n))
    spread, passage, copy = line(), [line(), line()], [line() for _ in range(6)]
    rows = []
    for d in range(240):
        lines = [line() for _ in range(rng.randint(1, 6))]
        if d % 3 == 0:
            lines.append(spread)
        if d % 4 == 0:
            lines[1:1] = passage
        if d % 10 == 1:
            lines = [x if rng.random() < 0.9 else line() for x in copy]
        if d % 20 == 5:
            lines = [spread]
        rows.append((d, "\n".join(lines + ["short line"]), "en", f"s{rng.randrange(15)}", 1))
    return rows + [(900, None, None, None, None), (901, "", "en", None, 0), (902, spread + "\r\n" + spread, "en", "s1", 0),
                   (903, "x " * 50_000, "en", "s2", 0)]


def oracle(rows, sql):
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in DOC.split(", ")])
    con = duckdb.connect()
    con.register("frame", frame)
    con.execute("create table documents as select cast(doc_id as bigint) doc_id, cast(text as varchar) text, cast(source as varchar) source from frame")
    return con.execute(sql)


def test_line_dedup_equals_exact_counts(spark):
    rows = documents()
    got = dedup_lines(spark.createDataFrame(rows, DOC).repartition(5)).select("doc_id", "n_lines", "n_removed", "text").collect()
    want = oracle(rows, LINE_DEDUP).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want, key=lambda r: r[0])
    removed = {r.doc_id: r.n_removed for r in got}
    assert removed[0] == 0 and removed[3] >= 1 and removed[900] == removed[901] == 0
    # the near copies lose the line that all documents have, not those they share among themselves
    assert all(removed[d] == 1 for d in range(1, 240, 10) if d % 3 and d % 4 and d % 20 != 5)


def test_line_dedup_clashing_columns_and_empty(spark):
    names = ["n_lines", "line", "_drop", "gone", "rest", "row", "site", "marks", "_salt", "keys", "a", "first_doc", "x.y"]
    df = spark.createDataFrame([(1, "a", "s", *["q"] * len(names)), (1, "a", "s", *["q"] * len(names)), (2, "a\nb", "t", *["r"] * len(names))],
                               ["doc_id", "text", "source", *names])
    out = dedup_lines(df, params=Spread(sites=2))
    assert out.columns == ["doc_id", "text", "source", *names[1:], "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed, r.line, r["_drop"], r["x.y"]) for r in out.collect()) == [
        (1, "a", 1, 0, "q", "q", "q")] * 2 + [(2, "b", 2, 1, "r", "r", "r")]
    assert dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("line, copies", [("All rights reserved.", 0), ("this line stands on a great many sites", 0),
                                          ("this line stands on a great many sites", 300)])
def test_a_line_of_many_texts_goes_whatever_copies_there_are(spark, line, copies):
    rng = random.Random(5)
    own = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(9))
    rows = [(d, "\n".join([own(), line, own()]), "en", f"s{d % 30}", 1) for d in range(200)]
    text = "\n".join([own(), own(), line, own(), own()])
    rows += [(1000 + d, text, "en", f"s{d % 30}", 1) for d in range(copies)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert sum(line not in got[d].text for d in range(200)) == 199 and line in got[0].text
    assert all(got[d].text == text.replace(line + "\n", "") for d in range(1000, 1000 + copies))
    assert sorted((d, r.n_lines, r.n_removed, r.text) for d, r in got.items()) == sorted(oracle(rows, LINE_DEDUP).fetchall())


def test_copies_alone_are_no_boilerplate(spark):
    rng = random.Random(6)
    own = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(9))
    text = [own() for _ in range(12)]
    rows = [(d, "\n".join(text), "en", f"s{d % 30}", 1) for d in range(100)]
    for d in range(100, 160):  # near copies: one line is another
        k = rng.randrange(12)
        rows.append((d, "\n".join([*text[:k], own(), *text[k + 1:]]), "en", f"s{d % 30}", 1))
    assert dedup_lines(spark.createDataFrame(rows, DOC)).agg(F.sum("n_removed")).first()[0] == 0


def test_mixing_equals_sql_and_rules(spark):
    rows = documents(2) + [(950, "one two", "en", "z", 1), (951, None, "en", "only empty", 1)]
    df = spark.createDataFrame(rows, DOC).repartition(5)
    out = mixing.mix(df).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                                F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted(oracle(rows, MIXING).fetchall())
    assert all(t <= 3 * s for _, s, _, _, t in got)
    target = {s[3]: g for s, g in zip(sorted(rows, key=lambda r: r[0]), got)}
    assert sum(g[3] for g in target.values()) == pytest.approx(sum(g[1] for g in got))
    copies = collections.Counter(r.doc_id for r in mixing.mixed_documents(df).collect())
    assert all(copies[d] * size == taken for d, size, _, _, taken in got if size)
    assert mixing.mixed_documents(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).columns == mixing.mix(df).columns


def test_mixing_with_clashing_columns(spark):
    names = ["size", "source_size", "target", "rate", "copies", "copy", "row", "weight", "_s", "_at", "_w", "_cap", "mix_target", "mix_size", "mix_rate", "mix_copies", "mix_source_size", "x.y"]
    rows = [(d, "one two three", f"s{d % 3}", *["v"] * len(names)) for d in range(30)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "text", "source", *[c for c in names if not c.startswith("mix_")], *[f"mix_{c}" for c in mixing.PARTS]]
    assert all(r["_s"] == r["x.y"] == r["copies"] == "v" and r.mix_size == 3 for r in out.collect())
    taken = mixing.mixed_documents(df)
    assert taken.columns == df.columns and all(r["mix_target"] == "v" for r in taken.collect())


def read_back(df):
    out = cf.format_chats(df)
    return {r.conv_id: ([tuple(t) for t in r.turns], r.loss, r.formatted) for r in out.select(
        "conv_id", "formatted", cf.read_turns(F.col("formatted")).alias("turns"),
        cf.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


def test_chat_round_trip(spark):
    rng = random.Random(4)
    parts = ["<|", "|>", "<|role|>", "<|text|>", "<|end|>", "\\", "\\\\", "<", "<\\|", "</s>", "[INST]", "[\\INST]", "s>", "\n", "é😀", " a ", "<<SYS>>", "<</SYS>>"]
    text = lambda: rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))])
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|end|>"]), text()) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(70, 1, "assistant", "x" * 200_000), (70, 0, "user", "q"), (71, None, "user", "n"), (71, 0, "user", "n"), (None, 0, "assistant", "w"), (0, 0, rows[0][2], rows[0][3])]
    got = read_back(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string"))
    want = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    assert {k: v[0] for k, v in got.items()} == dict(want)
    for k, (turns, loss, formatted) in got.items():
        assert loss == "".join(x for r, x in turns if r == "assistant")
        assert "</s>" not in formatted and formatted.count("<|role|>") == formatted.count("<|end|>") == len(turns)
    assert cf.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_layouts_by_fingerprint(spark):
    turns = [("user", "q"), ("assistant", "a")]
    tables = [spark.createDataFrame([(1, "q", "a", 9)], "conv_id long, prompt string, response string, extra int"),
              spark.createDataFrame([(1, "a", "q")], "conv_id long, completion string, prompt string"),
              spark.createDataFrame([(1, "q", "", "a")], "conv_id long, instruction string, input string, output string"),
              spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from:string,value:string>>"),
              spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role:string,content:string>>")]
    for t in tables:
        assert [(r.role, r.text) for r in cf.canonical_turns(t).orderBy("turn").collect()] == turns
    with pytest.raises(ValueError):
        cf.canonical_turns(spark.createDataFrame([(1, "q")], "conv_id long, prompt string"))
    records = [{"prompt": "q", "response": "a", "id": 3}, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
               {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"instruction": "q", "input": "", "output": "a"},
               {"question": "q", "answer": "a", "source": {"x": 1}}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(50, "{}"), (51, None), (52, "no json")], "id long, record string")
    out = collections.defaultdict(list)
    for r in cf.canonical_turns_of_json(df, "id", "record").orderBy("conv_id", "turn").collect():
        out[r.conv_id].append((r.role, r.text))
    assert dict(out) == {i: turns for i in range(len(records))}
    # every record is either formatted or rejected with a reason
    records = [{"messages": [{"role": "user"}, {"role": "assistant", "content": "a"}]}, {"prompt": "q", "response": "a", "input": "x", "turn": 3},
               {"messages": []}, {"prompt": "q"}, {"messages": [1, {"role": "user", "content": "q"}]}]
    df = spark.createDataFrame([(i, json.dumps(r), "k", "m") for i, r in enumerate(records)] + [(7, "no json", "", ""), (8, None, "", ""), (9, "[1]", "", "")],
                               "id long, record string, paths string, turns string")
    turns_, rejected = cf.canonical_json(df, "id", "record")
    assert {r.key: r.reason for r in rejected.collect()} | {r.conv_id: "" for r in turns_.collect()} == {
        0: "", 1: "", 2: "no layout", 3: "no layout", 4: "", 7: "not a JSON object", 8: "not a JSON object", 9: "not a JSON object"}
    assert [(r.role, r.text) for r in turns_.where("conv_id < 2").orderBy("conv_id", "turn").collect()] == [
        ("user", None), ("assistant", "a"), ("user", "q"), ("assistant", "a")]
    # columns of other layouts do not matter, the layout with most paths wins
    rows_ = spark.createDataFrame([(1, 0, "user", "q", "p", "i", "s")], "conv_id long, turn long, role string, text string, prompt string, input string, system string")
    assert [tuple(r) for r in cf.canonical_turns(rows_).collect()] == [(1, 0, "user", "q")]
    none = spark.createDataFrame([(1, []), (2, None), (3, [("user", "q")])], "conv_id long, messages array<struct<role:string,content:string>>")
    kept, rejected = cf.canonical_table(none)
    assert [r.conv_id for r in kept.collect()] == [3] and sorted((r.key, r.reason) for r in rejected.collect()) == [(1, "no turns"), (2, "no turns")]
    assert cf.fingerprint(["role", "text", "turn", "conv_id", "other"]) == hashlib.md5(b"conv_id\nrole\ntext\nturn").hexdigest()
