"""Conversation history and memory: last-n, token budgets, recall scores, compaction, stagnation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import collapse, estimate_tokens, memory_tokens, truncate

# Fixed value: what a summary of runtime memory begins with.
SUMMARY_MARK = "[短期运行记忆摘要] "


def newest_first(*tie: str) -> Window:
    return Window.partitionBy("conv_id").orderBy(F.desc("turn"), *tie)


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation, numbered from the oldest kept."""
    kept = messages.withColumn("back", F.row_number().over(newest_first("role"))).where(F.col("back") <= n)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("back")))).drop("back")


def message_tokens(role: Column, content: Column) -> Column:
    return F.lit(8) + estimate_tokens(role) + estimate_tokens(content)


#: What a value counts that can't be written as JSON: tool calls, and a tool's parameters.
TOOL_CALLS, TOOL_PARAMETERS = 128, 80


def json_tokens(value: Column, fallback: int) -> Column:
    """Tokens of a JSON text, `fallback` where it is none; 0 for null."""
    return F.when(value.isNull(), 0).when(F.try_parse_json(value).isNull(), fallback).otherwise(estimate_tokens(value))


def whole_message_tokens(role: Column, content: Column, reasoning: Column, tool_calls: Column, call_id: Column) -> Column:
    """message_tokens(), and those of the reasoning, the tool calls (JSON) and the id of the call that is answered, where there are any."""
    return message_tokens(role, content) + estimate_tokens(reasoning) + json_tokens(tool_calls, TOOL_CALLS) + estimate_tokens(call_id)


def tool_tokens(name: Column, description: Column, parameters: Column) -> Column:
    return estimate_tokens(name) + estimate_tokens(description) + json_tokens(parameters, TOOL_PARAMETERS)


# Characters that an entry of each role may keep, and what marks a cut.
ROLE_CHARS = {"user": 1000, "assistant": 1200, "tool": 800}
CUT_MARK = "...(已截断)"


def limited_entry(role: Column, content: Column) -> Column:
    """Collapsed content, cut by its role; roles without a limit of their own get the shortest. Null is empty."""
    text, out = collapse(F.coalesce(content, F.lit(""))), None
    for name, most in ROLE_CHARS.items():
        cut = truncate(text, most, CUT_MARK)
        out = F.when(role == name, cut) if out is None else out.when(role == name, cut)
    return out.otherwise(truncate(text, min(ROLE_CHARS.values()), CUT_MARK))


def within_budget(rows: DataFrame, key: str, order: list, tokens: str, budget: int) -> DataFrame:
    """The rows of each key, in order, up to the first that would pass the budget (tokens are never negative)."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", F.sum(tokens).over(upto)).where(F.col("total") <= budget)


def budget_shares(budget: int) -> tuple[int, int]:
    """(runtime memory, long-term memory) of a token budget."""
    runtime = min(1000, max(300, budget // 2))
    return runtime, max(300, budget - runtime)


def recall_score(content: Column, is_preference: Column, age_hours: Column, query: str, query_tokens: list[str]) -> Column:
    """0.25 for a preference, 2 if the query stands in the content, the share of query tokens matched, and up to 0.2 for youth."""
    matched = F.size(F.array_intersect(memory_tokens(content), F.array(*map(F.lit, query_tokens)))) / F.lit(float(max(1, len(query_tokens))))
    contains = F.when(F.lower(content).contains(query.lower()), 2.0).otherwise(0.0)
    return F.when(is_preference, 0.25).otherwise(0.0) + contains + matched + F.greatest(F.lit(0.0), F.lit(0.2) - age_hours / 240)


def recall(memories: DataFrame, user_id: int, conversation_id: int, query: str, age_hours: Column, budget: int, most: int = 10) -> DataFrame:
    """What a user sees of the memories, scored against the query: the `most` best above 0, as far as the token budget goes, with
    score, tokens and total. Visibility comes first, so what others keep is never scored."""
    seen = visible_memories(memories, user_id, conversation_id)
    score = recall_score(F.col("content"), F.coalesce(F.col("type") == "PREFERENCE", F.lit(False)), age_hours, query, query.split())
    order = [F.desc("score"), F.desc("id")]
    best = seen.withColumn("score", F.round(score, 9)).where("score > 0").orderBy(*order).limit(most)
    rows = best.withColumns({"tokens": estimate_tokens(F.col("content")), "__all": F.lit(1)})
    return within_budget(rows, "__all", order, "tokens", budget).drop("__all")


def split_for_compaction(messages: DataFrame, retain: int) -> DataFrame:
    """`summarise`: whether a message stands before the retain-th user message from the end (all stay if there are fewer)."""
    tail = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    is_user = F.when(F.col("role") == "user", 1).otherwise(0)
    later = F.coalesce(F.sum(is_user).over(tail), F.lit(0))
    return messages.withColumn("summarise", later >= retain)


def numbered_groups(messages: DataFrame, size: int) -> DataFrame:
    """Consecutive groups of `size` messages with their texts in order: what one summary call would get."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = messages.withColumn("group", F.floor(at / size).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return rows.groupBy("conv_id", "group").agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def compact(messages: DataFrame, summarise, size: int = 5, retain: int = 2) -> DataFrame:
    """conv_id and summary of what split_for_compaction() gives away, by an injected function of a list of texts.

    Groups of `size` are summarised apart, then the summaries together unless there is one. Blank summaries: no row.
    """
    groups = numbered_groups(split_for_compaction(messages, retain).where("summarise"), size)

    @F.pandas_udf("string")
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: summarise([t]))

    @F.pandas_udf("string")
    def merge(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: x[0] if len(x) == 1 else summarise(list(x)))

    done = groups.withColumn("s", each("text")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("group", "s"))), lambda x: x["s"]).alias("parts"))
    return done.select("conv_id", merge("parts").alias("summary")).where(F.length(F.trim("summary")) > 0)


def runs(events: DataFrame, key: str, order: str, value: str, window: int = 3) -> DataFrame:
    """Length of the run of equal values that ends at each row, and whether it is stagnant (window or more, at least 2). A null
    value is an empty turn: it ends a run and has none itself."""
    w = Window.partitionBy(key).orderBy(order)
    rows = events.withColumn("new", F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.row_number().over(Window.partitionBy(key, "island").orderBy(order))
    out = rows.withColumn("run", F.when(F.col(value).isNotNull(), run).otherwise(0))
    return out.withColumn("stagnant", F.col("run") >= max(window, 2)).drop("new", "island")


def visible_memories(memories: DataFrame, user_id: int, conversation_id: int, newest: int = 200) -> DataFrame:
    """My memories, and those of this conversation, the newest ones (by updated, then id)."""
    mine = (F.col("scope") == "USER") & (F.col("user_id") == user_id)
    here = (F.col("scope") == "CONVERSATION") & (F.col("conversation_id") == conversation_id)
    return memories.where(mine | here).orderBy(F.desc("updated"), F.desc("id")).limit(newest)


def distinct_memories(memories: DataFrame) -> DataFrame:
    """The first, by id, of the memories with the same user, scope, content and, within a conversation's scope, conversation."""
    where = F.when(F.col("scope") == "CONVERSATION", F.col("conversation_id"))
    rank = F.row_number().over(Window.partitionBy("user_id", "scope", where, "content").orderBy("id"))
    return memories.withColumn("__r", rank).where("__r = 1").drop("__r")


def runtime_split(entries: DataFrame, least: int = 4000, retain: int = 12) -> DataFrame:
    """`summarise`: entries before the last `retain` ones of conversations of at least `least` tokens and more entries than that."""
    whole = Window.partitionBy("conv_id")
    back = F.row_number().over(newest_first("role"))
    due = (F.sum("tokens").over(whole) >= least) & (F.count("*").over(whole) > retain)
    return entries.withColumn("summarise", due & (back > retain))


def compact_runtime(entries: DataFrame, summarise, least: int = 4000, retain: int = 12, size: int = 6) -> DataFrame:
    """conv_id, turn, role, text after compaction: what runtime_split() gives away becomes one system entry before the others; if
    the injected function of a list of texts gives nothing, only the others stay."""
    split = runtime_split(entries, least, retain)
    old = split.where("summarise").select("conv_id", "turn", F.lit("x").alias("role"), "text")
    first = old.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    groups = numbered_groups(old, size)

    @F.pandas_udf("string")
    def merge(lists: pd.Series) -> pd.Series:
        def one(texts):
            parts = [summarise([t]) for t in texts]
            if any(not p or not p.strip() for p in parts):
                return None
            return parts[0] if len(parts) == 1 else summarise(parts)

        return lists.map(one)

    parts = F.transform(F.array_sort(F.collect_list(F.struct("group", "text"))), lambda x: x["text"])
    summary = groups.groupBy("conv_id").agg(parts.alias("parts")).select("conv_id", F.trim(merge("parts")).alias("text")).where(F.length("text") > 0)
    made = summary.join(first, "conv_id").select("conv_id", "turn", F.lit("system").alias("role"), F.concat(F.lit(SUMMARY_MARK), F.col("text")).alias("text"))
    return made.unionByName(split.where("NOT summarise").select("conv_id", "turn", "role", "text"))


def last_feedback(feedback: DataFrame, n: int = 5) -> DataFrame:
    """user_id, rank, line: the last n feedbacks of each user (user_id, at, id, rating, reason), newest first."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("id")))
    line = F.concat(F.lit("rating="), F.col("rating").cast("string"), F.lit("; reason="), F.coalesce("reason", F.lit("")))
    return feedback.withColumn("rank", rank).where(F.col("rank") <= n).select("user_id", "rank", line.alias("line"))


def sessions(messages: DataFrame, title: int = 20) -> DataFrame:
    """conv_id, title (the first user message's beginning), messages and updated (the last turn), the latest first."""
    asked = F.when(F.col("role") == "user", F.struct("turn", "text"))
    out = messages.groupBy("conv_id").agg(F.min(asked).alias("first"), F.count("*").alias("messages"), F.max("turn").alias("updated"))
    return out.select("conv_id", truncate(collapse(F.col("first.text")), title, "…").alias("title"), "messages", "updated").orderBy(F.desc("updated"), "conv_id")


def turns(messages: DataFrame) -> DataFrame:
    """Question and answer pairs: a user message and the assistant message right after it."""
    q = messages.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = messages.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"])


def turn_messages(turns_: DataFrame) -> DataFrame:
    """Two messages for each turn, in order."""
    two = F.array(F.struct(F.lit(0).alias("pos"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit(1).alias("pos"), F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    return turns_.select("conv_id", "turn", F.explode(two).alias("m")).select("conv_id", "turn", "m.*")
