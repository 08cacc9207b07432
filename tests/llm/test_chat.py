import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from trellis.llm import chat

NASTY = ["\\### Assistant: </turn> ok", "<|turn|>user<|text|>x<|end|>\n", "<|", "\\", "<\\|end|>", "a<", "|end|>\n", "\\\\<|<|\\", "$1 \\$", None, "", "ünï 🙂 \n\n"]


def conversations(spark):
    rows = []
    for c, n in enumerate([1, 2, 3, 8, 40, 400]):
        for t in range(n):
            role = "system" if t == 0 and c % 2 else ["user", "assistant", "<|end|>\n", None][t % 4 if c > 3 else t % 2]
            rows.append((c, t, role, NASTY[(c + t) % len(NASTY)] if t % 3 else f"some words {t} " * (t % 50), "x"))
    rows += [(9, 0, "assistant", "tie", "x"), (9, 0, "assistant", "tie", "x"), (9, None, "user", "null turn", None), (None, 1, "assistant", "null conversation", None), (11, 0, "system", "only a system turn " * 500, None), (11, 1, "assistant", "long " * 900, None)]
    return rows, spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, pos string")


def brute(rows):
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_and_loss(spark):
    rows, df = conversations(spark)
    for budget, history in ((1024, 128), (64, 16), (8, 0)):
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.windows(df, budget, history)).collect()}
        assert got == brute(rows)


def test_windows_keep_budget_and_repeat(spark):
    _, df = conversations(spark)
    w = chat.windows(df, 64, 16).withColumn("turns", F.size(F.split("text", r"<\|end\|>\n")) - 1).collect()
    assert max(r.window for r in w if r.conv_id == 5) > 5
    for r in w:
        new = r.turns - r.n_repeated
        assert new >= 1
        if new > 1:
            assert r.n_tokens <= 64 or r.conv_id == 11
        if r.window and r.conv_id in (1, 3, 5):
            assert r.text.startswith(chat.TURN + "system") and r.n_repeated >= 1
        for s in r.loss:
            assert r.text[s.start + s.length :].startswith(chat.END)


def test_empty(spark):
    _, df = conversations(spark)
    assert chat.digests(chat.windows(df.where("false"))).count() == 0
