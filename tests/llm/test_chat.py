from oracle import differ

from lodestone.llm.chat import rotate
from lodestone.llm.oracles import ORACLES
from lodestone.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, start int, tie string"


def test_same_as_sql(spark, sf_dir):
    assert differ(spark, sf_dir, QUERIES["op2_chat_perspectives"], ORACLES["op2_chat_perspectives"]) == ""


def test_renderings(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello"), (1, 3, "cid", None), (1, 2, "bob", "hello"), (2, None, None, "?"), (None, 1, "ann", ""), (3, 0, "system", "alone")]
    made = rotate(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
    sides = {}
    for r in sorted(made, key=lambda r: (str(r["conv_id"]), r["perspective"], r["start"])):
        text, masks = sides.setdefault((r["conv_id"], r["perspective"]), ("", []))
        assert r["start"] == len(text) and r["stop"] == len(text) + len(r["rendered"])
        whole = text + r["rendered"]
        if r["mask_stop"] > r["mask_start"]:
            masks.append(whole[r["mask_start"] : r["mask_stop"]])
        sides[r["conv_id"], r["perspective"]] = (whole, masks)
    assert set(sides) == {(1, "ann"), (1, "bob"), (1, "cid"), (2, "unknown"), (None, "ann")}
    text, masks = sides[1, "bob"]
    assert text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n" + "<|im_start|>assistant\nhello<|im_end|>\n" * 2 + "<|im_start|>user name=cid\n<|im_end|>\n"
    assert masks == ["hello<|im_end|>\n"] * 2 and sides[1, "cid"][1] == ["<|im_end|>\n"]
    assert rotate(spark.createDataFrame([], SCHEMA)).count() == 0
