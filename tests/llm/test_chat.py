import time
from collections import defaultdict

from pyspark.sql import functions as F

from strataline.llm import chat
from tests.llm.helpers import sha

SCHEMA = "conv_id long, turn long, role string, text string"


def unescape(s):
    out, i = [], 0
    while i < len(s):
        i += s[i] == "\\"
        out.append(s[i])
        i += 1
    return "".join(out)


def plain_windows(turns, budget, history, parts=None):
    """Turns (role, text) of a conversation: windows as (n_context, indexes); parts: the part of each turn."""
    parts = parts or [0] * len(turns)
    cost = [-(-len(t) // 4) + 3 for _, t in turns]
    system = turns[0][0] == "system"
    room = max(1, budget - history - (cost[0] if system else 0))
    spans, used = [[]], 0
    for i, c in enumerate(cost):
        if spans[-1] and (used + c > room or parts[i] != parts[i - 1]):
            spans.append([])
            used = 0
        spans[-1].append(i)
        used += c
    out = []
    for own in spans:
        back, j, total = [], own[0] - 1, 0
        while j >= (1 if system else 0) and parts[j] == parts[own[0]] and total + cost[j] <= history:
            total += cost[j]
            back.insert(0, j)
            j -= 1
        lead = ([0] if system and own[0] > 0 else []) + back
        out.append((len(lead), lead + own))
    return out


def grouped(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    return {k: [x[2:] for x in sorted(v)] for k, v in by.items()}


def parts_of(rows, part):
    by = defaultdict(list)
    for r in rows:
        by[r.conv_id].append((r.turn is not None, r.turn or 0))
    return {k: [t // part if known else None for known, t in sorted(v)] for k, v in by.items()}


def formatted_chars(turns):
    """Code points of all windows of a conversation, by the template."""
    name = {"system": "System", "user": "User", "assistant": "Assistant"}
    marks = [t.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>") for _, t in turns]
    whole = [f"### {name[r]}:\n{t}\n</turn>\n" for (r, _), t in zip(turns, marks)]
    return sum(len(whole[i]) for _, idx in plain_windows(turns, chat.BUDGET, chat.HISTORY) for i in idx)


def check(spark, df, budget=chat.BUDGET, history=chat.HISTORY, part=chat.PART):
    rows = df.collect()
    want, got, part_of = grouped(rows), defaultdict(list), parts_of(rows, part)
    for w in chat.windows(df, budget, history, part=part).collect():
        got[w.conv_id].append(w)
    assert set(got) == set(want)
    for conv, turns in want.items():
        ws, losses = sorted(got[conv], key=lambda w: (w.part, w.window)), []
        plan = plain_windows(turns, budget, history, part_of[conv])
        assert len(ws) == len(plan)
        for w, (n, idx) in zip(ws, plan):
            assert w.n_context == n
            parts = w.formatted.split("\n</turn>\n")[:-1]
            assert [unescape(p.split("\n", 1)[1]) for p in parts] == [turns[i][1] for i in idx]
            losses += [unescape(w.formatted[s.start : s.start + s.length]) for s in w.loss]
        assert losses == [t for r, t in turns if r == "assistant"]


def test_query(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    want = grouped(df.collect())
    want[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    rows = {r.conv_id: r for r in chat.op9_chat_formatting(spark, sf).collect()}
    assert set(rows) == set(want)
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert rows[k].n_turns == len(turns)
        assert rows[k].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (rows[k].loss_chars, rows[k].loss_sha256) == (len(loss), sha(loss))
        assert rows[k].formatted_chars == formatted_chars(turns)


def test_windows(spark, sf):
    check(spark, spark.read.parquet(f"{sf}/conversations.parquet"))


def test_awkward(spark):
    nasty = ["", None, "\\", "\\\\### </turn>\n", "\n</turn>\n### User:\nx", "###", "### Assistant:\n", "a\\\n", "😀 \\### é" * 40, "x" * 5000]
    rows = [(c, t, r, nasty[(t + c) % len(nasty)]) for c in range(6) for t, r in enumerate(["system", "user", "assistant", "tool\n:x", None, "assistant", "user", "", "=a"] * 2)]
    rows += [(None, 1, "assistant", "n"), (None, None, "user", "first"), (9, 1, "user", "b"), (9, 1, "user", "a"), (9, 1, "user", "a"), (10, 0, "system", "s" * 9000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for budget, history in ((512, 128), (40, 10), (20, 0), (1, 5)):
        check(spark, df.withColumn("window", F.lit(1)), budget, history)
        check(spark, df, budget, history, part=4)
    assert chat.windows(df.limit(0)).count() == 0
    back = chat.windows(df).select("conv_id", "window", F.explode(chat.read_turns(F.col("formatted"))).alias("t")).select("t.role").distinct().collect()
    assert {r.role for r in back} == {"system", "user", "assistant", "tool\n:x", "", "=a"}


def test_parts_begin_with_the_system_turn_only(spark):
    rows = [(1, i, "system" if i == 0 else "assistant" if i % 2 else "user", f"s{i}") for i in range(40)]
    rows += [(2, i, "system" if i % 8 == 0 and i else "user", f"u{i}") for i in range(40)]
    rows += [(3, 0, "assistant", "tied"), (3, 0, "system", "s"), (3, 30, "user", "u"), (4, None, "system", "n"), (4, 25, "user", "u")]
    df = spark.createDataFrame(rows, SCHEMA)
    for budget, history in ((40, 10), (512, 128)):
        check(spark, df, budget, history, part=8)


def test_long_conversation_takes_linear_time(spark):
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id = 0, 'system', if(id % 2 = 1, 'user', 'assistant'))").alias("role"), F.repeat(F.lit("text "), 144).alias("text"))
    begin = time.time()
    got = chat.windows(rows).agg(F.count("*").alias("n"), F.sum(F.size("loss")).alias("losses")).first()
    assert got.losses == 9999 and got.n > 5000 and time.time() - begin < 20
