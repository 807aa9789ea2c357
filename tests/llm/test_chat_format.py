from __future__ import annotations

import hashlib
import json

import pytest

from stoneloom.llm import chat_format as op

SCHEMA = "conv_id long, turn long, role string, text string, piece string"
NASTY = ["</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\s>", "[\\INST]", "[INST][[INST]]<<s>>", "\\", "", "a\\nb", "<|endoftext|>" * 3]


def digests(rows):
    out = []
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        whole = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return df, op.read_back(op.format_turns(op.convert_table(df)))


def test_reads_back_what_was_written(spark):
    rows = [(i % 7, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY * 3)]
    rows += [(9, 1, "assistant", "é🙂" * 50_000), (9, 0, None, None), (10, None, "a\nb\\n", "x"), (10, 1, "assistant", "same"), (10, 1, "assistant", "same")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "yes"), (11, 3, "user", "late"), (11, 2, "user", "early"), (11, 2, "assistant", "tie")]
    _, found = run(spark, rows)
    got = found.collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == digests(rows)
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got)


def test_pieces_hold_no_bare_control_string(spark):
    df, _ = run(spark, [(0, i, "user", t) for i, t in enumerate(NASTY)])
    for r in op.format_turns(op.convert_table(df)).collect():
        inner = r["piece"][len(op.OPEN) : -len(op.CLOSE)]
        assert not any(a + rest in inner for a, rests in op.CONTROLS.items() for rest in rests)
        assert op.parse_piece(r["piece"]) == ("user", NASTY[r["turn"]])


def test_query_adds_to_a_conversation_of_the_same_id(spark, tmp_path):
    own = [(-1, 0, "assistant", "before"), (-1, 5, "user", "after"), (3, 0, "user", "x")]
    tricky = "</s>[INST] ok [/INST]"
    spark.createDataFrame(own, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = op.op9_chat_format(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == digests([*own, (-1, 0, "user", tricky), (-1, 1, "assistant", tricky)])


def test_empty(spark):
    assert run(spark, [])[1].count() == 0


@pytest.mark.parametrize(
    "record,want",
    [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 4}, [("user", "q"), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
        ({"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
        ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
        ({"system": "be", "instruction": "do", "input": "x", "output": "y"}, [("system", "be"), ("user", "do\n\nx"), ("assistant", "y")]),
        ({"prompt": "p", "completion": "c", "meta": {"role": 1}}, [("user", "p"), ("assistant", "c")]),
        ({"question": "p", "answer": "c"}, [("user", "p"), ("assistant", "c")]),
        ({"prompt": "p", "response": "c", "answer": "z"}, [("user", "p"), ("assistant", "c")]),
        ({"other": 1}, [(None, None)]),
        ("text", [(None, None)]),
        (None, [(None, None)]),
    ],
)
def test_layouts(spark, record, want):
    df = spark.createDataFrame([(1, json.dumps(record))], "conv_id long, json string")
    got = op.convert_json(df, "json").orderBy("turn").collect()
    assert [(r["role"], r["text"]) for r in got] == want


def test_broken_json_keeps_its_row(spark):
    df = spark.createDataFrame([(1, "{"), (2, None)], "conv_id long, json string")
    assert sorted((r["conv_id"], r["text"]) for r in op.convert_json(df, "json").collect()) == [(1, None), (2, None)]


def test_tables_by_fingerprint(spark):
    nested = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from: string, value: string>>")
    flat = spark.createDataFrame([(1, "do", "a", 5)], "conv_id long, instruction string, output string, more int")
    assert [tuple(r) for r in op.convert_table(nested).collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    assert [tuple(r) for r in op.convert_table(flat).collect()] == [(1, 0, "user", "do"), (1, 1, "assistant", "a")]
    with pytest.raises(ValueError, match="no mapping"):
        op.convert_table(spark.createDataFrame([(1,)], "conv_id long"))
    assert len(op.BY_PRINT) == len(op.MAPPINGS)
