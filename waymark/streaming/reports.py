"""Visitor reports: batch summaries and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from waymark.functions import vocabulary as V


def printed(x):
    """A mean from 1 to 200 to one place, as its exact binary value would be printed: only halves that a double holds exactly go to even. Whole numbers of 2 ** -52 are counted, so nothing is lost."""
    whole = (x * 2.0**52).cast("bigint") * 10
    low, rest = F.shiftright(whole, 52), whole.bitwiseAND((1 << 52) - 1)
    up = (rest > (1 << 51)) | ((rest == (1 << 51)) & (low % 2 == 1))
    return (low + up.cast("int")) / 10.0


def summary(reports: DataFrame, as_of: str) -> DataFrame:
    """Of each key's reports (key, reporter, difficulty 1-5 or null, access, tags, at) since the day three years (1,096 days) before as_of: count, mean difficulty to one place, levels, access counts, tags by count, latest day."""
    cut = F.date_sub(F.to_date(F.lit(as_of)), round(365.25 * V.REPORT_YEARS))
    recent = reports.where(F.to_date("at") >= cut)
    levels = [F.count_if(F.col("difficulty") == n).alias(f"level_{n}") for n in range(1, 6)]
    access = [F.count_if(F.col("access") == a).alias(a) for a in V.ACCESS]
    tags = [F.count_if(F.array_contains("tags", t)).alias(f"t_{i}") for i, t in enumerate(V.REPORT_TAGS)]
    found = recent.groupBy("key").agg(F.count("*").alias("n"), F.count("difficulty").alias("rated"), F.avg("difficulty").alias("mean"), *levels, *access, *tags, F.max("at").cast("date").alias("latest"))
    counted = F.filter(F.array(*[F.struct((-F.col(f"t_{i}")).alias("o"), F.lit(i).alias("i"), F.lit(t).alias("tag")) for i, t in enumerate(V.REPORT_TAGS)]), lambda x: x["o"] < 0)
    told = F.array_join(F.transform(F.array_sort(counted), lambda x: F.concat_ws(":", x["tag"], (-x["o"]).cast("string"))), ",")
    return found.withColumns({"tags": told, "mean": printed(F.col("mean"))}).drop(*[f"t_{i}" for i in range(len(V.REPORT_TAGS))])


def parsed(sent: DataFrame) -> DataFrame:
    """Reports as sent (key, device, clear, difficulty, access, tags) with `error`: what is wrong with each, or null; tags are put in their order, once each."""
    known = F.array(*map(F.lit, V.REPORT_TAGS))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    clear = F.coalesce("clear", F.lit(False))
    error = (
        F.when(F.coalesce(F.length("key"), F.lit(0)).between(1, 200) == F.lit(False), "Which place?").when(~F.coalesce(F.col("device").rlike(V.DEVICE), F.lit(False)), "This device has no id").when(clear, F.lit(None))
        .when(~F.col("difficulty").between(1, 5), "Access difficulty is 1 to 5").when(~F.col("access").isin(V.ACCESS), "Accessible or inaccessible").when(F.size(F.array_except(tags, known)) > 0, "Unknown tag")
        .when(F.col("difficulty").isNull() & F.col("access").isNull() & (F.size(tags) == 0), "Nothing to report")
    )
    return sent.withColumns({"error": error, "tags": F.array_intersect(known, tags)})


def reporter_id(device, key):
    """A device as one place sees it, so that its reports on two places can't be told to be one device's."""
    return F.substr(F.sha2(F.concat_ws("\x1f", device, key), 256), F.lit(1), F.lit(24))


def own_reports(reports: DataFrame, device: str) -> DataFrame:
    """The keys that a device has reported on: each report's reporter is compared with what the device would be there."""
    return reports.where(F.col("reporter") == reporter_id(F.lit(device), F.col("key"))).select("key").distinct()


def touched_since(log: DataFrame, read_at: str) -> DataFrame:
    """Keys whose reports changed at or after a rebuild read them; their summaries are made again."""
    return log.where(F.col("at") >= F.to_timestamp_ntz(F.lit(read_at))).select("key").distinct()


def latest_reports(reports: DataFrame) -> DataFrame:
    """Each device's last report on each key."""
    rank = F.row_number().over(Window.partitionBy("key", "reporter").orderBy(F.desc("at"), F.desc("id")))
    return reports.withColumn("rank", rank).where("rank = 1").drop("rank")


def log(reports: DataFrame) -> DataFrame:
    """Reports with an access that differs from the device's previous report on the key, or come on another day."""
    w = Window.partitionBy("key", "reporter").orderBy("at", "id")
    changed = F.lag("at").over(w).isNull() | ~F.col("access").eqNullSafe(F.lag("access").over(w)) | (F.to_date("at") != F.to_date(F.lag("at").over(w)))
    return reports.withColumn("changed", changed).where("changed and access is not null").drop("changed")


HOUR = 3_600_000_000  # fixed value: the limit's span, in microseconds


def _accepted(times: list[int], kept: list[int], most: int) -> list[bool]:
    """Which of some reports (times in order) are accepted after those of `kept`, which goes on to hold the accepted ones of the last hour. What is refused doesn't count."""
    out = []
    for at in times:
        kept[:] = [k for k in kept if at - k < HOUR]
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(at)
    return out


def allowed(reports: DataFrame, most: int = V.REPORTS_PER_HOUR) -> DataFrame:
    """Reports with whether they are accepted: a device has at most `most` accepted ones in the 3,600 seconds up to each. What is refused doesn't count, so reports are gone through in order (by id where times are equal).

    Where a device is silent for an hour nothing before counts any more, so its reports fall into spells that are judged apart; and only spells with more than `most` reports in some hour are gone through at all."""

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__us", "id"])
        pdf["allowed"] = _accepted(pdf["__us"].tolist(), [], most)
        return pdf[[*names, "allowed"]]

    names = reports.columns
    us = F.unix_micros(F.col("at").cast("timestamp"))
    device = Window.partitionBy("reporter")
    marked = reports.withColumn("__us", us).withColumn("__n", F.count("*").over(device.orderBy("__us").rangeBetween(1 - HOUR, 0)))
    begins = F.coalesce((F.col("__us") - F.lag("__us").over(device.orderBy("__us", "id")) >= HOUR).cast("long"), F.lit(1).cast("long"))
    marked = marked.withColumn("__begins", begins).withColumn("__spell", F.sum("__begins").over(device.orderBy("__us", "id").rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("__peak", F.max("__n").over(Window.partitionBy("reporter", "__spell")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reports.schema.fields)
    judged = marked.where(F.col("__peak") > most).drop("__n", "__begins", "__peak").groupBy("reporter", "__spell").applyInPandas(judge, f"{fields}, allowed boolean")
    return judged.unionByName(marked.where(F.col("__peak") <= most).select(*names, F.lit(True).alias("allowed")))


def allowed_as_they_come(stream: DataFrame, most: int = V.REPORTS_PER_HOUR, late: str = "10 minutes") -> DataFrame:
    """The same on a stream of reports (reporter, id, at): (reporter, id, at, allowed), each once the watermark has passed it, so that reports that come out of order are judged in order. Those later than `late` are dropped.

    A device's state is its accepted reports of the last hour, at most `most`, and those that still wait; an event-time timer wakes it when the first of them is due, and forgets a device an hour after its last accepted report."""

    def step(key, batches, state: GroupState):
        kept, waiting = ([*state.get[0]], [*zip(state.get[1], state.get[2])]) if state.exists else ([], [])
        if not state.hasTimedOut:
            for pdf in batches:
                waiting += zip(pdf["at"].astype("datetime64[us]").astype("int64").tolist(), pdf["id"].tolist())
        mark = state.getCurrentWatermarkMs() * 1000
        due = sorted(x for x in waiting if x[0] < mark)
        waiting = [x for x in waiting if x[0] >= mark]
        verdicts = _accepted([at for at, _ in due], kept, most)
        kept = [k for k in kept if mark - k < HOUR]
        if waiting or kept:
            state.update((kept, [at for at, _ in waiting], [i for _, i in waiting]))
            wake = min(at for at, _ in waiting) if waiting else kept[-1] + HOUR
            state.setTimeoutTimestamp(max(wake // 1000 + 1, mark // 1000 + 1))
        elif state.exists:
            state.remove()
        made = pd.DataFrame({"reporter": [key[0]] * len(due), "id": [i for _, i in due], "at": pd.to_datetime([at for at, _ in due], unit="us"), "allowed": verdicts})
        yield made.astype({"id": "int64", "at": "datetime64[ns]", "allowed": "bool"})

    timed = stream.select(F.col("reporter").cast("string").alias("reporter"), F.col("id").cast("long").alias("id"), F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return timed.groupBy("reporter").applyInPandasWithState(step, "reporter string, id long, at timestamp, allowed boolean", "kept array<long>, at array<long>, id array<long>", "append", "EventTimeTimeout")


LOGGED = "key string, reporter string, at timestamp, access string, difficulty int, change string"


def follow(stream: DataFrame) -> DataFrame:
    """A stream of reports (key, reporter, at, access, difficulty, clear) as a stream of changes to the log: `log` when an access is given that differs from the device's last report there or comes on another day, `clear` when a device takes its report back.

    The state of a device at a place is its last report's access and time; reports of one batch are taken in order of time."""

    def step(key, batches, state: GroupState):
        before = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        out = []
        for r in rows.itertuples():
            if r.clear:
                out.append((*key, r.at, None, None, "clear"))
                before = None
                continue
            access = r.access if isinstance(r.access, str) else None
            day = r.at.strftime("%Y-%m-%d")
            if access and (before is None or before[0] != access or before[1] != day):
                out.append((*key, r.at, access, None if pd.isna(r.difficulty) else int(r.difficulty), "log"))
            before = (access, day)
        if before is None:
            state.remove()
        else:
            state.update(before)
        made = pd.DataFrame(out, columns=["key", "reporter", "at", "access", "difficulty", "change"])
        yield made.astype({"difficulty": "Int32"})

    return stream.groupBy("key", "reporter").applyInPandasWithState(step, LOGGED, "access string, day string", "append", "NoTimeout")


def once(stream: DataFrame, key: str, at: str, late: str = "14 days") -> DataFrame:
    """A stream of records read again and again over overlapping spans, each let through once."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Reports by key and hour; works on streams (late ones wait `late`) and tables alike."""
    return stream.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).groupBy("key", F.window("at", "1 hour").alias("hour")).agg(F.count("*").alias("n"))
