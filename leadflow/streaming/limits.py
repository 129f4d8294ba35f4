"""Request limits: a daily window anchored on its first request, and a sliding window of accepted ones.

Both rules look back one window, so a request can only be refused where its window and the one before
hold more than ``limit`` requests. The batch form counts requests per key and window first and accepts
everything in quiet windows at once. Crowded stretches of the daily rule follow pointers from window to window by
doubling; those of the sliding rule are walked block by block, blocks apart from each other.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leadflow.functions import fixed
from leadflow.functions.tables import first_per_key
from leadflow.functions.text import micros
from leadflow.functions.workspace import workspace

MICROS = 1_000_000


class Daily:
    """Window opens with the first request and stays for its length; refused requests do not count."""

    def __init__(self, limit: int, window: int, start: int | None = None, count: int = 0):
        self.limit, self.window, self.start, self.count = limit, window, start, count

    def accept(self, ts: int) -> bool:
        if self.start is None or ts - self.start > self.window:
            self.start, self.count = ts, 0
        if self.count >= self.limit:
            return False
        self.count += 1
        return True


class Sliding:
    """At most ``limit`` accepted requests younger than the window."""

    def __init__(self, limit: int, window: int, accepted: Sequence[int] = ()):
        self.window = window
        # the limit-th last accepted request is all that can refuse one
        self.recent = deque(accepted, maxlen=max(1, limit))
        self.limit = limit

    def accept(self, ts: int) -> bool:
        full = len(self.recent) >= self.limit
        if self.limit < 1 or (full and ts - self.recent[0] < self.window):
            return False
        self.recent.append(ts)
        return True


def _crowded(events: DataFrame, keys: Sequence[str], limit: int, window: int, anchored: bool) -> DataFrame:
    """One row per key and window-long slot: the stretch it belongs to and whether that must be walked."""
    slots = events.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*keys).orderBy("_slot")
    before = F.lag("_slot").over(by_key) == F.col("_slot") - 1
    dense = F.col("_n") + F.when(before, F.lag("_n").over(by_key)).otherwise(0) > limit
    # anchored: an empty slot ends every window, so a stretch is a run of non-empty slots. Sliding: a quiet
    # slot is accepted as a whole and is all that the dense slots behind it can see.
    joined = F.coalesce(before, F.lit(False))
    opens = ~joined if anchored else ~(joined & dense)
    slots = slots.withColumn("_dense", dense).withColumn("_opens", opens.cast("int"))
    slots = slots.withColumn("_stretch", F.sum("_opens").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    walk = F.max("_dense").over(Window.partitionBy(*keys, "_stretch"))
    return slots.select(*keys, "_slot", "_stretch", walk.alias("_walk"))


def _limited(events: DataFrame, keys: Sequence[str], order: str, limit: int, seconds: int, anchored: bool) -> DataFrame:
    window = seconds * MICROS
    untimed = events.filter(F.col("ts").isNull()).withColumn("allowed", F.lit(None).cast("boolean"))
    events = events.filter(F.col("ts").isNotNull()).withColumn("_slot", F.floor(micros("ts") / window))
    same = [*keys, "_slot"]
    crowds = _crowded(events, keys, limit, window, anchored).withColumnsRenamed({c: f"_of_{c}" for c in same})
    # requests without a key are one client of their own
    marked = events.join(crowds, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in same]).drop(*[f"_of_{c}" for c in same])
    quiet = marked.filter(~F.col("_walk")).withColumn("allowed", F.lit(True)).drop("_slot", "_stretch", "_walk")
    out_cols = quiet.columns
    crowded = marked.filter("_walk").withColumn("_us", micros("ts"))
    if anchored:
        walked = _anchored(crowded, keys, order, limit, window).select(out_cols)
    else:
        walked = _slid(crowded, keys, order, limit, window, quiet.schema)
    return quiet.unionByName(walked).unionByName(untimed)


def _slid(
    crowded: DataFrame, keys: Sequence[str], order: str, limit: int, window: int, schema, block_windows: int = 64, rounds: int = 4
) -> DataFrame:
    """Crowded stretches of the sliding rule, with ``allowed``.

    A stretch is cut into blocks of ``block_windows`` windows, which tasks walk apart, first as if nothing came before.
    What a block accepts in its last window is where the next one begins; blocks that began from something else are
    walked again from there, until none is left. A client that comes below its limit now and then forgets how a block
    began, so two or three rounds do. Where ``rounds`` rounds leave blocks (a client without any rest), those from the
    first one of a stretch on are walked in one go: that much is sequential by nature, and streamed.
    """
    block, spark = [*keys, "_stretch", "_part"], crowded.sparkSession
    columns = [c for c in schema.names if c != "allowed"]
    part = F.floor(F.col("_slot") / block_windows).alias("_part")
    events = _kept(crowded.select(*columns, "_stretch", part, "_us"), spark, "limit-events")
    firsts = events.groupBy(*block).agg(F.min("_us").alias("_first"))
    used = firsts.select(*block, F.array().cast("array<bigint>").alias("_in"))
    walked = _kept(_walked(events, used, block, order, limit, window), spark, "limit-walked")
    following = firsts.select(*keys, "_stretch", (F.col("_part") - 1).alias("_part"), F.col("_first").alias("_next"))
    for left in reversed(range(rounds)):
        late = _same(walked.filter("allowed"), following, block).filter(F.col("_us") > F.col("_next") - window)
        ends = late.groupBy(*block).agg(F.sort_array(F.collect_list("_us")).alias("_in"))  # a window holds `limit` at most
        ends = ends.withColumn("_part", F.col("_part") + 1)
        begins = _same(firsts.drop("_first"), ends, block, "left")
        begins = _kept(begins.withColumn("_in", F.coalesce("_in", F.array().cast("array<bigint>"))), spark, "limit-states")
        changed = _same(begins, used.withColumnRenamed("_in", "_was"), block).filter(F.col("_in") != F.col("_was")).drop("_was")
        changed = _kept(changed, spark, "limit-changed")
        if changed.isEmpty():
            break
        used, group = begins, block
        if not left:  # all blocks from the first one on, as one group that begins like it
            group = [*keys, "_stretch"]
            start = changed.groupBy(*group).agg(F.min("_part").alias("_from"))
            begin = _same(changed, start, group).filter(F.col("_part") == F.col("_from")).drop("_from", "_part")
            again = _same(firsts.drop("_first"), start, group).filter(F.col("_part") >= F.col("_from")).drop("_from")
        else:
            begin, again = changed, changed.drop("_in")
        marked = _same(walked, again.withColumn("_again", F.lit(True)), block, "left")
        rest = marked.filter(F.col("_again").isNull()).drop("_again")
        anew = _walked(marked.filter("_again").drop("_again", "allowed"), begin, group, order, limit, window)
        walked = _kept(rest.unionByName(anew), spark, "limit-walked")
    return walked.select(*schema.names)


def _walked(events: DataFrame, begins: DataFrame, group: Sequence[str], order: str, limit: int, window: int) -> DataFrame:
    """The events with ``allowed``, every group walked in time order from the accepted times in ``begins._in``."""
    name = F.to_json(F.struct(*group), {"ignoreNullFields": "false"}).alias("_group")
    heads = begins.select(name, "_in")
    rows = events.select("*", name).unionByName(heads, allowMissingColumns=True)
    ordered = rows.repartition("_group").sortWithinPartitions("_group", F.col("_in").isNull(), "_us", order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Sliding(limit, window)
        for batch in batches:
            heads, verdicts, event = batch.column("_in"), [], []
            for begun, us in zip(heads.to_pylist(), batch.column("_us").to_pylist(), strict=True):
                event.append(begun is None)
                if begun is not None:
                    state = Sliding(limit, window, begun)
                verdicts.append(begun is None and state.accept(us))
            made = pa.RecordBatch.from_arrays([*(batch.column(c) for c in events_names), pa.array(verdicts, pa.bool_())], names=kind.names)
            yield made.filter(pa.array(event))

    kind = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType())])
    events_names = events.columns
    return ordered.mapInArrow(walk, kind)


def _successors(times: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """(keys, _us, _to): of every time that of the first event more than a window later; the last ones have none.

    Times and the ends of their windows are sorted together inside cells of a 64th of a window, and an end with no later
    time in its cell takes the first time of the next cell that has one. So a client's times spread over its cells.
    """
    cell = max(1, window // 64)
    at = lambda us: F.floor(us / cell).alias("_cell")
    ends = times.select(*keys, (F.col("_us") + window).alias("_t"), F.col("_us").alias("_of")).withColumn("_cell", at(F.col("_t")))
    places = times.select(*keys, F.col("_us").alias("_t"), F.lit(None).cast("long").alias("_of"), at(F.col("_us")))
    # from the latest down, so that what comes later is what a running frame has seen; an equal time is not later
    later = Window.partitionBy(*keys, "_cell").orderBy(F.desc("_t"), F.col("_of").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.last(F.when(F.col("_of").isNull(), F.col("_t")), ignorenulls=True).over(later)
    found = ends.unionByName(places).withColumn("_to", inside).filter(F.col("_of").isNotNull())
    cells = places.groupBy(*keys, "_cell").agg(F.min("_t").alias("_first"))
    every = cells.unionByName(found.select(*keys, "_cell").distinct().withColumn("_first", F.lit(None).cast("long")))
    every = every.groupBy(*keys, "_cell").agg(F.min("_first").alias("_first"))  # one row a client and cell
    after = Window.partitionBy(*keys).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("_next", F.last("_first", ignorenulls=True).over(after)).drop("_first")
    joined = _same(found, every, [*keys, "_cell"])
    return joined.select(*keys, F.col("_of").alias("_us"), F.coalesce("_to", "_next").alias("_to")).filter(F.col("_to").isNotNull())


def _same(rows: DataFrame, facts: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal values, null ones too."""
    other = facts.withColumnsRenamed({c: f"_of_{c}" for c in on})
    joined = rows.join(other, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on], how)
    return joined.drop(*[f"_of_{c}" for c in on]) if how != "left_semi" else joined


def _window_starts(events: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """(keys, _us) of the first requests of all windows.

    Every time points to the start of the window that would follow one begun there. From the first time of a stretch the
    pointers are followed by doubling: in round n all starts found so far are moved on by 2 ** n windows, so a chain of a
    thousand windows takes ten joins, each over keys of client and time.
    """
    spark = events.sparkSession
    times = _kept(events.select(*keys, "_stretch", "_us").distinct(), spark, "limit-times")
    reached = times.groupBy(*keys, "_stretch").agg(F.min("_us").alias("_us")).drop("_stretch")
    jump = _successors(times.select(*keys, "_us").distinct(), keys, window)
    while True:  # one table a round: starts have no pointer
        state = _kept(jump.unionByName(reached, allowMissingColumns=True), spark, "limit-pointers")
        reached, jump = state.filter(F.col("_to").isNull()).drop("_to"), state.filter(F.col("_to").isNotNull())
        if jump.isEmpty():
            return reached
        moved = _same(reached, jump, [*keys, "_us"]).select(*keys, F.col("_to").alias("_us"))
        onward = jump.select(*keys, F.col("_us").alias("_to"), F.col("_to").alias("_on"))
        reached = reached.unionByName(moved).distinct()
        jump = _same(jump, onward, [*keys, "_to"]).select(*keys, "_us", F.col("_on").alias("_to"))


def _kept(df: DataFrame, spark, label: str) -> DataFrame:
    path = workspace(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)


def _anchored(crowded: DataFrame, keys: Sequence[str], order: str, limit: int, window: int) -> DataFrame:
    """Crowded stretches of the daily rule, with ``allowed``: the first ``limit`` requests of each window.

    A window begins in the slot of a request or in the one before. The limit-th request of a window is sought among the
    first ones of its cells, so that a window with very many requests is never sorted in one task.
    """
    starts = _window_starts(crowded, keys, window).withColumn("_slot", F.floor(F.col("_us") / window))
    own = starts.withColumnRenamed("_us", "_own")
    earlier = starts.select(*keys, (F.col("_slot") + 1).alias("_slot"), F.col("_us").alias("_earlier"))
    placed = _same(_same(crowded, own, [*keys, "_slot"], "left"), earlier, [*keys, "_slot"], "left")
    begun = F.when(F.col("_own") <= F.col("_us"), F.col("_own")).otherwise(F.col("_earlier"))
    placed = _kept(placed.withColumn("_start", begun).drop("_own", "_earlier"), crowded.sparkSession, "limit-windows")
    place, cell = F.struct("_us", F.col(order).alias("_order")), F.floor((F.col("_us") - F.col("_start")) * 64 / window).alias("_cell")
    some = placed.select(*keys, "_start", place.alias("_place"), cell)
    for parts in ([*keys, "_start", "_cell"], [*keys, "_start"]):
        rank = F.row_number().over(Window.partitionBy(*parts).orderBy("_place"))
        some = some.withColumn("_rank", rank).filter(F.col("_rank") <= max(limit, 1))
    last = some.groupBy(*keys, "_start").agg(F.max("_place").alias("_last"))  # the limit-th, or the last of fewer
    judged = _same(placed, last, [*keys, "_start"])
    return judged.withColumn("allowed", (place <= F.col("_last")) if limit > 0 else F.lit(False)).drop("_start", "_last")


def daily_limits(
    events: DataFrame,
    limit: int | None = None,
    keys: Sequence[str] = ("identifier", "identifier_type", "action"),
    order: str = "event_id",
    seconds: int = 86_400,
) -> DataFrame:
    """Add ``allowed`` per request. ``limit`` None takes the fixed limits; an unknown action passes.

    A request without a time cannot be placed: ``allowed`` is null. Null keys count as a value.
    """
    if limit is not None:
        return _limited(events, keys, order, limit, seconds, anchored=True)
    kinds = F.concat_ws("|", F.coalesce("identifier_type", F.lit("")), F.coalesce("action", F.lit("")))
    known = [f"{t}|{a}" for t, a in fixed.DAILY_LIMITS]
    free = events.filter(~kinds.isin(known)).withColumn("allowed", F.lit(True))
    for size in sorted(set(fixed.DAILY_LIMITS.values())):
        names = [f"{t}|{a}" for (t, a), v in fixed.DAILY_LIMITS.items() if v == size]
        free = free.unionByName(_limited(events.filter(kinds.isin(names)), keys, order, size, seconds, True))
    return free


def sliding_limits(
    events: DataFrame, limit: int = 10, seconds: int = 60, keys: Sequence[str] = ("client",), order: str = "event_id"
) -> DataFrame:
    """Add ``allowed``: at most ``limit`` accepted requests per client in any ``seconds``."""
    return _limited(events, keys, order, limit, seconds, anchored=False)


class _LimitKeeper(StatefulProcessor):
    """Judges the requests of one client. The accepted times are a list, the open window a value, a timer ends both."""

    def __init__(self, order: str, columns: list[str], window: int, anchored: bool):
        self.order, self.columns, self.window, self.anchored = order, columns, window, anchored

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.anchored:
            self.opened = handle.getValueState("opened", "start bigint, used bigint")
        else:
            self.accepted = handle.getListState("accepted", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked, limit = [], None
        for pdf in rows:  # of a micro-batch only times and order are held, to take them in time order
            place, us, limits = (pdf.iloc[:, len(self.columns) + i] for i in (0, 2, 3))
            limit = limits.iloc[0]
            asked += zip(us, place)
        asked.sort()
        if limit < 0:  # no limit is set for these
            allowed = [None if us < 0 else True for us, _ in asked]
        else:
            allowed = self._judged(int(limit), [us for us, _ in asked])
        made = {c: [k] * len(asked) for c, k in zip(self.columns, key, strict=True)}
        yield pd.DataFrame(made | {self.order: [o for _, o in asked], "allowed": pd.Series(allowed, dtype="object")})

    def _judged(self, limit: int, times: list[int]) -> list[bool | None]:
        if self.anchored:
            rule = Daily(limit, self.window, *(self.opened.get() if self.opened.exists() else (None, 0)))
        else:
            rule = Sliding(limit, self.window, [us for (us,) in self.accepted.get()] if self.accepted.exists() else ())
        out = [None if us < 0 else rule.accept(int(us)) for us in times]
        if times and times[-1] >= 0:
            if not self.anchored:
                self.accepted.put([(us,) for us in rule.recent]) if rule.recent else self.accepted.clear()
            elif rule.start is not None:
                self.opened.update((rule.start, rule.count))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            # after two windows without a request nothing of the state can refuse one
            self.handle.registerTimer((int(times[-1]) + 2 * self.window) // 1000)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (self.opened if self.anchored else self.accepted).clear()
        return iter([])

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and list states of streams need this state store, which must be set when a stream starts."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )


def _limit_stream(
    events: DataFrame, keys: str | Sequence[str], limits: int | DataFrame, order: str, seconds: int, anchored: bool, delay: str
) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    use_rocksdb(events.sparkSession)
    # before the epoch there are no requests, so -1 marks one without a time
    rows = events.withWatermark("ts", delay).select(*keys, order, "ts", F.coalesce(micros("ts"), F.lit(-1)).alias("_us"))
    if isinstance(limits, int):
        rows = rows.withColumn("_limit", F.lit(limits))
    else:
        kinds = [c for c in limits.columns if c != "limit"]
        known = first_per_key(limits, kinds, ["limit"]).withColumnRenamed("limit", "_limit")
        rows = rows.join(known, kinds, "left").withColumn("_limit", F.coalesce(F.col("_limit").cast("int"), F.lit(-1)))
    rows = rows.select(*keys, order, "ts", "_us", "_limit")  # taken by place: not every name reaches the worker
    fields = [*(events.schema[c] for c in (*keys, order)), T.StructField("allowed", T.BooleanType())]
    keeper = _LimitKeeper(order, keys, seconds * MICROS, anchored)
    return rows.groupBy(*keys).transformWithStateInPandas(keeper, T.StructType(fields), "append", "eventtime")


def daily_limit_table(spark: SparkSession) -> DataFrame:
    """(identifier_type, action, limit): the fixed daily limits."""
    rows = [(kind, action, n) for (kind, action), n in fixed.DAILY_LIMITS.items()]
    return spark.createDataFrame(rows, "identifier_type string, action string, `limit` int")


def daily_limit_stream(
    events: DataFrame, keys: str | Sequence[str] = ("identifier", "identifier_type", "action"), limits: int | DataFrame | None = None,
    order: str = "event_id", seconds: int = 86_400, delay: str = "1 day",
) -> DataFrame:
    """(keys, order, allowed) of a stream of requests, by windows that open with a client's first request.

    ``limits`` is a number for all, or a table of some of the key columns and ``limit`` (None: the fixed daily limits),
    joined to the stream; requests of unlisted kinds pass. Requests are judged as they come, those of one micro-batch in
    time order; one without a time gets null. State of a client ends two windows after its last request.
    """
    limits = daily_limit_table(events.sparkSession) if limits is None else limits
    return _limit_stream(events, keys, limits, order, seconds, True, delay)


def sliding_limit_stream(
    events: DataFrame, keys: str | Sequence[str], limits: int | DataFrame = 10, order: str = "event_id", seconds: int = 60,
    delay: str = "1 hour",
) -> DataFrame:
    """The same with at most ``limit`` accepted requests in any ``seconds``."""
    return _limit_stream(events, keys, limits, order, seconds, False, delay)
