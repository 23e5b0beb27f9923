"""Usage ledger: daily sums, date spine, balances, snapshots, rankings, alerts, anchored limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.shared import written

START_BALANCE = 10_000
LOW_BALANCE = 9_300
WARNING_SHARE = 0.8


def consumed_by_day(ledger: DataFrame) -> DataFrame:
    rows = ledger.where("change_type = 'CONSUME'")
    return rows.groupBy("record_date", "token_type").agg(F.sum("amount").alias("tokens"), F.count("*").alias("requests"))


def chats_by_day(ledger: DataFrame) -> DataFrame:
    per_user = ledger.groupBy("user_id", "record_date").agg(F.count("*").alias("n"))
    return per_user.groupBy("record_date").agg(F.sum("n").alias("chats"), F.count("*").alias("users"))


def normal_days(days: int) -> int:
    return 7 if days <= 7 else 30


def daily_spine(ledger: DataFrame, days: int) -> DataFrame:
    """One row for each of the last days (7 or 30) before and with the ledger's last day; 0 where nothing happened."""
    return _spine(ledger, normal_days(days))


def quota_days(ledger: DataFrame, days: int, retention: int = 35) -> DataFrame:
    """daily_spine of the users whose quota is kept, over as many days as counters live: 1 to `retention`."""
    return _spine(ledger.where(quota_managed(F.col("user_id"))), min(max(days, 1), retention))


def _spine(ledger: DataFrame, days: int) -> DataFrame:
    last = ledger.agg(F.max("record_date").alias("last"))
    spine = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("record_date"))
    used = consumed_by_day(ledger).groupBy("record_date").pivot("token_type", ["LLM", "EMBEDDING"]).agg(F.sum("tokens").alias("tokens"), F.sum("requests").alias("requests"))
    out = spine.join(used, "record_date", "left").join(chats_by_day(ledger), "record_date", "left")
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0)).alias(name)
    return out.select("record_date", zero("LLM_tokens", "llm_tokens"), zero("LLM_requests", "llm_requests"), zero("EMBEDDING_tokens", "embedding_tokens"), zero("EMBEDDING_requests", "embedding_requests"), zero("chats", "chats"))


def with_balance(ledger: DataFrame, start: int = START_BALANCE) -> DataFrame:
    """balance_before and balance_after of each row, in each user's order of events. The balance may fall below 0."""
    change = F.when(F.col("change_type") == "INCREASE", F.col("amount")).otherwise(-F.col("amount"))
    order = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return ledger.withColumn("balance_after", start + F.sum(change).over(order)).withColumn("balance_before", F.col("balance_after") - change)


def daily_ledger(ledger: DataFrame, start: int = START_BALANCE) -> DataFrame:
    """A day's consumption of a user and type as one row: the balance before its first and after its last event."""
    rows = with_balance(ledger, start).where("change_type = 'CONSUME'")
    return rows.groupBy("user_id", "record_date", "token_type").agg(
        F.sum("amount").alias("amount"), F.count("*").alias("requests"), F.min_by("balance_before", "event_id").alias("balance_before"), F.max_by("balance_after", "event_id").alias("balance_after")
    )


def snapshot(ledger: DataFrame, limit: int) -> DataFrame:
    """Of each user and type on the ledger's last day: used, requests, remaining and ratio under a daily limit."""
    last = F.broadcast(ledger.agg(F.max("record_date").alias("record_date")))
    day = ledger.join(last, "record_date").where("change_type = 'CONSUME'")
    used = day.groupBy("user_id", "token_type").agg(F.sum("amount").alias("used"), F.count("*").alias("requests"))
    return used.select("*", F.greatest(limit - F.col("used"), F.lit(0)).alias("remaining"), F.round(F.col("used") / limit, 6).alias("ratio"))


def top_consumers(snapshot_: DataFrame, users: DataFrame, token_type: str, n: int = 5) -> DataFrame:
    """The n heaviest users of a type, by name; only then those who used nothing go."""
    top = snapshot_.where(F.col("token_type") == token_type).orderBy(F.desc("used"), "user_id").limit(n).where("used > 0")
    names = users.select(F.col("id").cast("string").alias("user_id"), "username")
    return top.join(names, "user_id", "left").select("user_id", F.coalesce("username", F.lit("Unknown User")).alias("username"), "used", "requests")


def low_balances(daily: DataFrame, threshold: int = LOW_BALANCE) -> DataFrame:
    """Each user's latest day and type rows with a balance of at most the threshold; critical iff nothing was consumed."""
    latest = daily.withColumn("last", F.max("record_date").over(Window.partitionBy("user_id", "token_type"))).where("record_date = last")
    rows = latest.where(F.col("balance_after") <= threshold)
    return rows.select("user_id", "token_type", "record_date", "amount", "balance_after", F.when(F.col("amount") <= 0, "critical").otherwise("warning").alias("level"))


def alert_level(used: Column, limit: Column, remaining: Column, enabled: Column | None = None) -> Column:
    """Null without use or limit, and where the quota is switched off."""
    level = F.when(remaining == 0, "critical").when(used / limit >= WARNING_SHARE, "warning")
    return F.when((limit > 0) & (used > 0) & (F.lit(True) if enabled is None else F.coalesce(enabled, F.lit(False))), level)


def alerts(snapshot_: DataFrame, limit: int, critical_first: bool = False) -> DataFrame:
    """Alerts of both types with rank: as the dashboards show them, warnings stand before criticals unless asked otherwise.

    Sorted by range, numbered within each part, and shifted by the parts before: no task gets more than its part of the alerts.
    """
    one = lambda kind: snapshot_.where(F.col("token_type") == kind)
    rows = one("LLM").unionByName(one("EMBEDDING")).withColumn("level", alert_level(F.col("used"), F.lit(limit), F.col("remaining"))).where("level is not null")
    level = F.col("level") == "critical"
    return numbered(rows.select("user_id", "token_type", "used", "ratio", "level"), [level.desc() if critical_first else level.asc(), F.desc("ratio"), "user_id", "token_type"], "rank")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with `name`, 1..n in a total order over all of them."""
    parts = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")  # a row for each part
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__own", own).join(before, "__part").withColumn(name, (F.col("__own") + F.col("__before")).cast("int")).drop("__part", "__own", "__before")


def _fold(key: list[str], decide, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            verdicts = []
            for row in b.itertuples(index=False):
                own = tuple(getattr(row, k) for k in key)
                if own != now:
                    now, state = own, None
                state, verdict = decide(state, row)
                verdicts.append(verdict)
            yield b[columns].assign(accepted=verdicts)

    return run


def in_order(rows: DataFrame, key: list[str], order: list[str], decide, columns: list[str]) -> DataFrame:
    """Rows with `accepted`, decided one after the other within each key; the state of one key is held at a time, not its rows."""
    kept = list(dict.fromkeys([*key, *order, *columns]))
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns) + ", accepted boolean"
    return rows.select(kept).repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(_fold(key, decide, columns), schema)


def anchored_limit(state, at: float, most: int, seconds: float):
    """A window begins with its first event and counts rejected ones too: (state, accepted)."""
    if state is None or at >= state[0] + seconds:
        state = (at, 0)
    return (state[0], state[1] + 1), state[1] + 1 <= most


def anchored_windows(rows: DataFrame, most: int, seconds: int) -> DataFrame:
    timed = rows.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return in_order(timed, ["user_id"], ["event_id"], lambda s, r: anchored_limit(s, r.at, most, seconds), ["event_id", "user_id", "at"]).drop("at")


def daily_quota(rows: DataFrame, limit: int) -> DataFrame:
    """Reservations of a user's day in order; one that would pass the limit is rejected and leaves nothing behind."""

    def decide(used, row):
        used = used or 0
        fits = used + row.amount <= limit
        return used + (row.amount if fits else 0), fits

    return in_order(rows, ["user_id", "record_date"], ["event_id"], decide, ["event_id", "user_id", "record_date", "amount"])


def anchored_budget(state, at: float, amount: int, limit: int, seconds: float):
    """(state, accepted) of a token budget whose window begins with the first amount counted in it; a rejected amount isn't
    counted. No limit or no window: everything is accepted."""
    if limit <= 0 or seconds <= 0:
        return state, True
    start, used = state or (at, 0)
    if at >= start + seconds:
        used = 0
    start = at if used == 0 else start
    fits = used + amount <= limit
    return (start, used + amount if fits else used), fits


def token_budgets(rows: DataFrame, limit: int, seconds: int) -> DataFrame:
    """event_id, user_id, accepted under a budget of each user."""
    timed = rows.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return in_order(timed, ["user_id"], ["event_id"], lambda s, r: anchored_budget(s, r.at, r.amount, limit, seconds), ["event_id", "user_id", "at", "amount"]).drop("at", "amount")


def compound_reservation(state, day: str, at: float, amount: int, daily: int, budgets: tuple[tuple[int, float], ...]):
    """(state, accepted): an amount must fit the calendar day's quota and every anchored budget; where one rejects it, none of those
    before it keeps it."""
    quota, windows = state or (("", 0), (None,) * len(budgets))
    used = quota[1] if quota[0] == day else 0
    fits, moved = daily <= 0 or used + amount <= daily, list(windows)
    for i, (limit, seconds) in enumerate(budgets):
        if fits:
            moved[i], fits = anchored_budget(windows[i], at, amount, limit, seconds)
    if fits:
        return ((day, used + amount), tuple(moved)), True
    return ((day, used), windows), False


def compound_reservations(rows: DataFrame, daily: int, budgets: tuple[tuple[int, float], ...]) -> DataFrame:
    """event_id, user_id, accepted under a daily quota and anchored budgets (limit, seconds) of each user together."""
    timed = rows.withColumns({"at": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "day": F.date_format("ts", "yyyy-MM-dd")})
    decide = lambda s, r: compound_reservation(s, r.day, r.at, r.amount, daily, budgets)
    return in_order(timed, ["user_id"], ["event_id"], decide, ["event_id", "user_id", "at", "day", "amount"]).drop("at", "day", "amount")


def settled_usage(reservations: DataFrame) -> DataFrame:
    """user_id, record_date, used from rows of kind RESERVE (reserved), SETTLE (reserved, actual) and ABORT (reserved): a settlement
    counts the difference, an abortion gives all back; never below 0."""
    change = F.when(F.col("kind") == "RESERVE", F.col("reserved")).when(F.col("kind") == "SETTLE", F.col("actual") - F.col("reserved")).otherwise(-F.col("reserved"))
    return reservations.groupBy("user_id", "record_date").agg(F.greatest(F.sum(change), F.lit(0)).alias("used"))


def totals(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    """user_id, token_type, change_type, amount of each wanted key; 0 where the ledger has none."""
    names = ["user_id", "token_type", "change_type"]
    sums = ledger.groupBy(*names).agg(F.sum("amount").alias("amount"))
    return keys.join(sums, names, "left").select(*names, F.coalesce("amount", F.lit(0)).alias("amount"))


def balance_snapshot(ledger: DataFrame, start: int = START_BALANCE) -> DataFrame:
    """user_id, granted, balance and used (granted less balance) of each user, the start being granted too."""
    inc, out = (F.sum(F.when(F.col("change_type") == k, F.col("amount")).otherwise(0)) for k in ("INCREASE", "CONSUME"))
    sums = ledger.groupBy("user_id").agg((inc + start).alias("granted"), (inc - out + start).alias("balance"))
    return sums.withColumn("used", F.col("granted") - F.col("balance"))


def top_by_scope(snapshot_: DataFrame, n: int = 5) -> DataFrame:
    """The n heaviest users of each type among those who used something, with rank."""
    at = F.row_number().over(Window.partitionBy("token_type").orderBy(F.desc("used"), "user_id"))
    return snapshot_.where("used > 0").withColumn("rank", at).where(F.col("rank") <= n).select("token_type", "rank", "user_id", "used")


def with_snapshots(users: DataFrame, snapshot_: DataFrame, limit: int) -> DataFrame:
    """id, username, used, remaining, requests of quota-managed users, for one type of tokens; nothing used where there is no snapshot."""
    rows = users.where(quota_managed(F.col("username"))).withColumn("user_id", F.col("id").cast("string"))
    out = rows.join(snapshot_.select("user_id", "used", "remaining", "requests"), "user_id", "left")
    return out.select("id", "username", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("remaining", F.lit(limit)).cast("long").alias("remaining"), F.coalesce("requests", F.lit(0)).alias("requests"))


def quota_managed(user: Column) -> Column:
    return F.coalesce((F.length(F.trim(user)) > 0) & ~user.startswith("system"), F.lit(False))


def result_limit(asked: Column, default: int = 5, most: int = 20) -> Column:
    """How many results a tool call gets."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(asked, F.lit(default)))).cast("int")


def idle_sessions(events: DataFrame, days: int = 7) -> DataFrame:
    """user_id, start, events of stretches in which each event renews a lease of so many days."""
    w = F.session_window(F.col("ts").cast("timestamp"), f"{days} days")
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), "events")
