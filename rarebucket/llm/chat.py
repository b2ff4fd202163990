"""Chat formatting: reply trees to one conversation text per chosen path, with DataFrame functions only.

A message table has tree, message, parent, role, text and score. Self-joins that double their reach (each message's ancestor at
1, 2, 4, ... steps) give depth and summed score of every message, so a path of n messages takes log2(n) joins rather
than n, and no row ever holds a path. A leaf's rank is the mean score of its path. The messages on the
chosen paths are marked by the same joins in reverse, and one aggregation per path writes the text.

The template is ``[INST]user text[/INST]``, ``assistant text</s>``, ``<<SYS>>system text<</SYS>>`` and
``[ROLE]name[TEXT]text[/ROLE]`` for any other role, after ``<s>``. In texts and role names a backslash is put after each
``<``, ``[`` and backslash, so no control string can occur in them, and taking it out restores them exactly.
Loss covers the assistant texts without the closing mark, as spans of code points.

Null texts and roles are empty. Rows without a conversation (a null tree or conv_id) are together one of their own, named
null. A null turn comes first; equal turns of a conversation are all kept, ordered by role and text. Messages whose parent is null
or missing are roots. Messages on a cycle have no root and appear in no path. An empty table gives an empty result.
Other columns are not read, whatever their names. A text of any length is one value; a conversation is one row of the result and so
one task's work, which is linear in its turns and characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rarebucket.llm.common import reliable

BEGIN = "<s>"
#: What opens and closes the text of a role; other roles get ROLE.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE = ("[ROLE]", "[TEXT]", "[/ROLE]")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def best_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """(tree, path, depth, message) of the ``paths`` best leaves of each tree; path 1 ranks first.

    ``messages`` has tree, message (unique in its tree), parent and score. Leaves rank by mean score, then by
    smaller message.
    """
    own = messages.select("tree", "message", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = own.select(F.col("tree").alias("t"), F.col("message").alias("m"))
    up = own.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("m")), "left")
    # above: the ancestor so far reached; depth and total: of the messages passed, own included
    state = reliable(up.select("tree", "message", F.col("m").alias("above"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")))
    longest = state.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    hops, reach = [], 1
    while reach < longest and state.filter("above IS NOT NULL").limit(1).count():
        hops.append(state.select("tree", "message", "above").filter("above IS NOT NULL"))
        far = state.select(F.col("tree").alias("t"), F.col("message").alias("m"), F.col("above").alias("further"), F.col("depth").alias("d"), F.col("total").alias("s"))
        moved = state.filter("above IS NOT NULL").join(far, F.col("tree").eqNullSafe(F.col("t")) & (F.col("above") == F.col("m"))).select(
            "tree", "message", F.col("further").alias("above"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("total") + F.col("s")).alias("total"))
        state, reach = reliable(state.filter("above IS NULL").union(moved)), 2 * reach
    rooted = state.filter("above IS NULL")  # what still has an ancestor is on or under a cycle
    replied = own.select(F.col("tree").alias("t"), F.col("parent").alias("p")).filter("p IS NOT NULL").distinct()
    leaves = rooted.join(replied, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("p")), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), "message")
    marked = leaves.withColumn("path", F.row_number().over(order)).filter(F.col("path") <= paths).select("tree", "path", "message")
    for hop in reversed(hops):
        step = hop.select(F.col("tree").alias("t"), F.col("message").alias("m"), "above")
        more = marked.join(step, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m"))).select("tree", "path", F.col("above").alias("message"))
        marked = reliable(marked.union(more))
    at = rooted.select(F.col("tree").alias("t"), F.col("message").alias("m"), "depth")
    return marked.join(at, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m"))).select("tree", "path", "depth", "message")


def formatted(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree, path, conversation, loss_spans) with spans of (start, length) in code points from 1."""
    texts = messages.select(F.col("tree").alias("t"), F.col("message").alias("m"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m")))
    open_, close = F.concat(F.lit(ROLE[0]), escaped(F.col("role")), F.lit(ROLE[1])), F.lit(ROLE[2])
    for role, (a, b) in MARKS.items():
        open_, close = F.when(F.col("role") == role, F.lit(a)).otherwise(open_), F.when(F.col("role") == role, F.lit(b)).otherwise(close)
    turns = turns.select("tree", "path", "depth", (F.col("role") == "assistant").alias("loss"), open_.alias("open"), escaped(F.col("text")).alias("body"), close.alias("close"))
    # where each turn starts is a running sum over its path, which is dealt and sorted as the aggregation needs it
    before = Window.partitionBy("tree", "path").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("open") + F.length("body") + F.length("close")
    start = F.lit(len(BEGIN) + 1) + F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("open")
    turn = F.struct("depth", F.concat("open", "body", "close").alias("whole"), "loss", F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length")).alias("span"))
    whole = turns.withColumn("start", start).groupBy("tree", "path").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["span"])
    text = F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda x: x["whole"]), ""))
    return whole.select("tree", "path", text.alias("conversation"), spans.alias("loss_spans"))


def parsed(conversation: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    body = F.substring(conversation, len(BEGIN) + 1, 2147483647)
    ends = r"\[/INST\]|</s>|<</SYS>>|\[/ROLE\]"
    turns = F.regexp_extract_all(body, F.lit(rf"(?s)(?:(?!{ends}).)*+(?:{ends})"), F.lit(0))

    def turn(x: Column) -> Column:
        whole = r"(?s)^\[ROLE\](.*?)\[TEXT\](.*)\[/ROLE\]$"
        out = F.struct(unescaped(F.regexp_extract(x, whole, 1)).alias("role"), unescaped(F.regexp_extract(x, whole, 2)).alias("text"))
        for role, (a, b) in MARKS.items():
            if a:
                out = F.when(x.startswith(a), F.struct(F.lit(role).alias("role"), unescaped(F.substr(x, F.lit(len(a) + 1), F.length(x) - len(a) - len(b))).alias("text"))).otherwise(out)
            else:
                out = F.when(x.endswith(b), F.struct(F.lit(role).alias("role"), unescaped(F.substr(x, F.lit(1), F.length(x) - len(b))).alias("text"))).otherwise(out)
        return out

    return F.transform(turns, turn)


def masked_text(conversation: Column, spans: Column) -> Column:
    """All text under the loss mask, read from the conversation."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(conversation, s["start"].cast("int"), s["length"].cast("int")))), "")


def from_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of conversations by turn as a message table: each turn replies to the one before it."""
    own = turns.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    number = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    own = own.withColumn("message", number.cast("long"))
    return own.select("tree", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def format_conversations(turns: DataFrame, paths: int = 1) -> DataFrame:
    messages = from_turns(turns)
    return formatted(best_paths(messages, paths), messages)


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1: control strings of the template as texts."""
    said = F.lit("</s>[INST] ok [/INST]")
    rows = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"))
    return rows.withColumn("text", said)


def digests(formatted_rows: DataFrame) -> DataFrame:
    """conv_id and what the formatted text gives back: turns, loss and lengths."""
    turns = parsed(F.col("conversation"))
    rows = formatted_rows.select(F.col("tree").alias("conv_id"), "conversation", "loss_spans", turns.alias("turns"), masked_text(F.col("conversation"), F.col("loss_spans")).alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("conversation").cast("long").alias("formatted_chars"))
