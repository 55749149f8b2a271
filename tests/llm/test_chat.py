from tempolens.llm import chat
from tempolens.llm.queries import op8_chat_formatting

from .helpers import frame, got, save, sha

COLS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
ENDS = "<|im_end|><|im_start|>assistant ok"
SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a<|turn|>b"), (1, 2, "assistant", "<||im_end|>\n<"), (1, 3, "user", "|x"), (1, 4, "user", ""),
    (2, 0, "assistant", None), (2, 0, None, "x"), (2, 0, "assistant", None), (2, None, "sys\ntem<|line|>", "<|||a"), (3, 5, "assistant", "\n\n<|im_end|>\n<|im_start|>user\n"),
    (None, 0, "user", "lost"), (None, 1, "assistant", "é<|é|>"), (4, 0, "", ""), (4, 1, "", ""), (5, 0, "assistant", "x" * 100_000),
]


def brute(rows):
    conv = {}
    for c, turn, role, text in [*rows, (-1, 0, "user", ENDS), (-1, 1, "assistant", ENDS)]:
        conv.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in conv.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=repr)


def test_edges(spark, tmp_path):
    turns = frame(spark, ROWS, SCHEMA).repartition(3).selectExpr("*", "1 as t", "'m' as mask", "2 as formatted")
    out = op8_chat_formatting(spark, save(tmp_path, conversations=turns))
    assert got(out, *COLS) == brute(ROWS)
    assert chat.format_conversations(frame(spark, [], SCHEMA)).count() == 0


def test_query_on_conversations(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op8_chat_formatting(spark, sf), *COLS) == brute(rows)


def test_adjacent_turns_of_a_role_share_a_block_and_mask_covers_the_assistant(spark):
    r = chat.format_conversations(frame(spark, ROWS, SCHEMA)).where("conv_id = 1").first()
    assert r.formatted == ("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na<||turn|>b<|turn|><|||im_end|>\n<<|im_end|>\n"
                           "<|im_start|>user\n|x<|turn|><|im_end|>\n")
    at, loss = 0, []
    for m in r["mask"]:
        at += m.skip
        if m.loss:
            loss.append(r.formatted[at:at + m.n])
        at += m.n
    assert loss == ["a<||turn|>b", "<|||im_end|>\n<"]


def test_only_spark_expressions(spark):
    plan = op8_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
