"""Chat formatting into budgeted windows, with DataFrame functions only.

Each conversation becomes one or more windows of formatted turns. Prefix sums
of turn tokens choose spans that end between turns; every window but the first
repeats the system turn and a limited run of the turns before its span. The
loss mask covers each assistant text once: in the window whose span holds it,
not where it is repeated. Conversations are worked on in parts of ``PART`` turn
numbers: a part begins a window, without history but with the system turn.

The template is ``### Role:\\n``, the text, ``\\n</turn>\\n``. Inside texts a
backslash, ``###`` and ``</turn>`` get a backslash in front, so both marks stand
for themselves nowhere but in the template, and ``unescape`` takes it off again.
A role other than the three known ones is written ``=`` and its base64 form.

Defined cases: a null text is empty; a null role is an empty role; a null
conv_id is a conversation of its own; a null turn comes first; rows that tie in
turn go by role, then text; repeated rows are turns of their own; a turn longer
than the budget has a window to itself and is never cut, however long its text; an
empty table gives no windows; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEAD, MARK, END = "###", "</turn>", "\n</turn>\n"
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
BUDGET, HISTORY = 512, 128
#: Turn numbers of a part.
PART = 1024


def tokens(text: Column) -> Column:
    """The default token count of a turn: a token for four code points, and three for its template."""
    return F.ceil(F.length(text) / 4).cast("long") + 3


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (HEAD, MARK):
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role_out(role: Column) -> Column:
    out = F.concat(F.lit("="), F.regexp_replace(F.base64(role.cast("binary")), r"\s", ""))
    for name, shown in ROLES.items():
        out = F.when(role == name, F.lit(shown)).otherwise(out)
    return out


def _role_in(shown: Column) -> Column:
    out = F.unbase64(F.substring(shown, 2, 1 << 30)).cast("string")
    for name, word in ROLES.items():
        out = F.when(shown == word, F.lit(name)).otherwise(out)
    return out


def _parts(rows: DataFrame, count, part: int) -> DataFrame:
    """conv_id, part and turns in order (kind, at, role, text, before, tokens); before: tokens ahead of it in the part.

    A conversation is cut into parts by turn number, so that none of them is a task's load. Each part after
    the first begins with a turn that is not its own: the system turn (kind 0), or a blank where there is none (kind -1).
    """
    base = rows.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("at"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("part", F.expr(f"at div {part}"))
    # skinny: a row per part, then per conversation of several parts
    parts = base.groupBy("conv_id", "part").agg(F.min("at").alias("low"), F.min(F.when(F.col("role") < "system", F.col("at"))).alias("other"))
    several = parts.groupBy("conv_id").agg(F.min("part").alias("first"), F.min("low").alias("low"), F.min("other").alias("other"), F.count("*").alias("n")).filter("n > 1")
    several = several.select(F.col("conv_id").alias("conv"), "first", "low", (F.col("other").isNull() | (F.col("other") > F.col("low"))).alias("may"))
    begins = base.filter(F.col("role") == "system").join(several.filter("may"), F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("at") == F.col("low")))
    heads = begins.groupBy("conv").agg(F.min("text").alias("text"))
    leads = (
        parts.select("conv_id", "part")
        .join(several.select("conv", "first"), F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") > F.col("first")))
        .select("conv_id", "part")
        .join(heads, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
        .select("conv_id", "part", F.when(F.col("text").isNull(), -1).otherwise(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.lit("system").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    )
    every = base.withColumn("kind", F.lit(1)).unionByName(leads).withColumn("tokens", count(F.col("text")).cast("long"))
    ahead = Window.partitionBy("conv_id", "part").orderBy("kind", "at", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    summed = every.withColumn("before", F.coalesce(F.sum("tokens").over(ahead), F.lit(0).cast("long")))
    one = F.struct("kind", "at", "role", "text", "before", "tokens")
    return summed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(one)).alias("turns"))


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, count=tokens, part: int = PART) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as windows.

    Columns: conv_id, part and window (the order of the windows), n_context (leading turns
    that repeat earlier ones), n_tokens, formatted, loss (array of start and length, in
    code points from 0). A window holds ``budget`` tokens at most, unless its first own
    turn alone takes more. Work and memory are linear in the turns of a part.
    """
    head, own = F.col("turns")[0], F.col("own")
    is_system = (head["kind"] == 0) | ((head["kind"] == 1) & (head["role"] == "system"))
    room = F.greatest(F.lit(budget - history) - F.when(is_system, head["tokens"]).otherwise(0), F.lit(1)).cast("long")
    long0 = F.lit(0).cast("long")
    grouped = (
        _parts(rows, count, part)
        .withColumn("room", room)
        .withColumn("system", is_system)
        .withColumn("own", F.when(head["kind"] < 1, F.slice("turns", F.lit(2), F.greatest(F.size("turns") - 1, F.lit(0)))).otherwise(F.col("turns")))
        # a system turn that is the part's own stands in its first window and is no history
        .withColumn("low", (F.col("system") & (head["kind"] == 1)).cast("int"))
    )
    # first turns of the spans: a turn opens a span if with it the span would hold more than the room
    start = F.struct(own[0]["before"].alias("at"), F.array(F.lit(0)).alias("first"))

    def opens(acc: Column, i: Column) -> Column:
        turn = F.get(own, i)
        new = F.struct(turn["before"].alias("at"), F.array_append(acc["first"], i).alias("first"))
        return F.when(turn["before"] + turn["tokens"] - acc["at"] > F.col("room"), new).otherwise(acc)

    inner = F.when(F.size(own) > 1, F.sequence(F.lit(1), F.size(own) - 1)).otherwise(F.array().cast("array<int>"))
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(own) + 1)).cast("int"))

    def reach(a: Column) -> Column:
        """The first turn of the history before turn a: the smallest from ``low`` on with no more than ``history`` tokens up to a."""
        limit = F.get(own, a)["before"] - history

        def halve(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
            near = F.get(own, mid)["before"] >= limit
            narrower = F.when(near, F.struct(acc["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi")))
            return F.when(acc["lo"] < acc["hi"], narrower).otherwise(acc)

        return F.aggregate(halvings, F.struct(F.least(F.col("low"), a).alias("lo"), a.alias("hi")), halve)["lo"]

    def window(a: Column, i: Column) -> Column:
        stop, begin = F.coalesce(F.get("first", i + 1), F.size(own)), reach(a)
        keeps = F.col("system") & ((a > 0) | (head["kind"] == 0))
        chosen = F.concat(F.when(keeps, F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0)), F.slice(own, begin + 1, stop - begin))
        return F.struct(i.alias("window"), (a - begin + keeps.cast("int")).alias("n_context"), chosen.alias("turns"))

    spans = grouped.withColumn("first", F.aggregate(inner, start, opens)["first"]).select("conv_id", "part", F.inline(F.transform("first", window)))
    shown = spans.withColumn(
        "shown",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(HEAD + " "), _role_out(t["role"]), F.lit(":\n")).alias("head"),
                escape(t["text"]).alias("body"),
                (t["role"] == "assistant").alias("target"),
            ),
        ),
    )
    state = F.struct(long0.alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))

    def step(acc: Column, p: Column) -> Column:
        start, n = acc["at"] + F.length(p["head"]), F.length(p["body"]).cast("long")
        mine = p["target"] & (acc["i"] >= F.col("n_context"))
        loss = F.when(mine, F.array_append(acc["loss"], F.struct(start.alias("start"), n.alias("length")))).otherwise(acc["loss"])
        return F.struct((start + n + len(END)).alias("at"), (acc["i"] + 1).alias("i"), loss.alias("loss"))

    return shown.select(
        "conv_id",
        "part",
        "window",
        "n_context",
        F.aggregate(F.col("turns.tokens"), long0, lambda acc, n: acc + n).alias("n_tokens"),
        F.array_join(F.transform("shown", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("shown", state, step)["loss"].alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of formatted text, unescaped."""
    parts = F.split(formatted, END)
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda p: F.struct(
            _role_in(F.regexp_extract(p, "(?s)^### ([^\n]*):\n", 1)).alias("role"),
            unescape(F.regexp_replace(p, "(?s)^### [^\n]*:\n", "")).alias("text"),
        ),
    )


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and conversation -7, read back from the formatted windows."""
    own = spark.sql(
        r"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(id AS BIGINT) AS turn, IF(id = 0, 'user', 'assistant') AS role, "
        r"'\\### Assistant: </turn> ok' AS text FROM range(0, 2, 1, 1)"
    )
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    back = windows(rows).select(
        "conv_id",
        F.struct(
            "part",
            "window",
            F.slice(read_turns(F.col("formatted")), F.col("n_context") + 1, 1 << 30).alias("turns"),
            F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))).alias("loss"),
            F.length("formatted").cast("long").alias("chars"),
        ).alias("w"),
    )
    whole = back.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    turns, loss = F.flatten(F.col("w.turns")), F.array_join(F.flatten(F.col("w.loss")), "")
    return (
        whole.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.col("w.chars").alias("chars"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            F.aggregate("chars", F.lit(0).cast("long"), lambda a, n: a + n).alias("formatted_chars"),
            F.size("chars").cast("long").alias("n_windows"),
        )
    )


#: For conversations of one part, as those of the tables are.
QUERIES = {"op9_chat_formatting": op9_chat_formatting}
ORACLES = {
    "op9_chat_formatting": rf"""
        WITH RECURSIVE raw AS (
            SELECT conv_id, turn, role, text FROM conversations
            UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: {MARK} ok' FROM unnest(range(0, 2)) AS v(i)
        ), one AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM raw
        ), sized AS (
            SELECT conv_id, role, text, i, CAST(ceil(length(text) / 4.0) AS BIGINT) + 3 AS tokens,
                length('{HEAD} ') + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) ELSE 1 + length(base64(encode(role))) END + 2
                + length(replace(replace(replace(text, '\', '\\'), '{HEAD}', '\{HEAD}'), '{MARK}', '\{MARK}')) + length('{MARK}') + 2 AS chars
            FROM one
        ), placed AS (
            SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY i) - tokens AS before, first_value(role = 'system') OVER (PARTITION BY conv_id ORDER BY i) AS sys,
                greatest({BUDGET - HISTORY} - CASE WHEN first_value(role) OVER (PARTITION BY conv_id ORDER BY i) = 'system' THEN first_value(tokens) OVER (PARTITION BY conv_id ORDER BY i) ELSE 0 END, 1) AS room
            FROM sized
        ), spans(conv_id, i, a, ahead) AS (
            SELECT conv_id, i, i, before FROM placed WHERE i = 0
            UNION ALL
            SELECT p.conv_id, p.i, CASE WHEN p.before + p.tokens - s.ahead > p.room THEN p.i ELSE s.a END, CASE WHEN p.before + p.tokens - s.ahead > p.room THEN p.before ELSE s.ahead END
            FROM spans s JOIN placed p ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.i = s.i + 1
        ), wins AS (SELECT DISTINCT conv_id, a, ahead FROM spans
        ), context AS (
            SELECT w.conv_id, sum(p.chars) AS chars FROM wins w JOIN placed p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i < w.a
            WHERE (p.sys AND p.i = 0) OR w.ahead - p.before <= {HISTORY} GROUP BY w.conv_id
        ), counted AS (SELECT conv_id, count(*) AS n FROM wins GROUP BY conv_id
        ), whole AS (
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
                coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars) AS chars FROM placed GROUP BY conv_id
        )
        SELECT w.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(w.chars + coalesce(context.chars, 0) AS BIGINT) AS formatted_chars, counted.n AS n_windows
        FROM whole w JOIN counted ON counted.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN context ON context.conv_id IS NOT DISTINCT FROM w.conv_id
    """
}
