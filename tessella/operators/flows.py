"""Event streams and logs: order checks, framing, folds that depend on what was accepted before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Names of events in their order, those that may be missing, those that may come several times, and how a stream may end.
ORDER = (
    "query_started", "realm_resolved", "rewrite_completed", "retrieval_completed", "rerank_completed", "context_assembled",
    "generation_started", "answer_delta", "citation_ready", "query_done", "query_error",
)
OPTIONAL, SEVERAL, DONE, ERROR = ("rewrite_completed",), ("answer_delta",), "query_done", "query_error"


def order_errors(events: DataFrame, order: tuple[str, ...] = ORDER, optional: tuple[str, ...] = OPTIONAL, several: tuple[str, ...] = SEVERAL, done: str = DONE, error: str = ERROR) -> DataFrame:
    """request_id, error of streams (request_id, seq, name); null: in order.

    In this order of precedence: unknown names, no end, more than one end, rows
    after the end, steps back, an event twice that comes once, and (of streams
    that are done) events that are missing.  A stream that ends with the error
    may end anywhere.
    """
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("name"))
    by = Window.partitionBy("request_id").orderBy("seq")
    is_end = F.col("name").isin(done, error)
    seen = events.withColumn("place", place).withColumn("back", (F.col("place") < F.lag("place").over(by)) & ~is_end).withColumn("after", F.coalesce(F.sum(is_end.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0)
    twice = F.coalesce((F.col("place") == F.lag("place").over(by)) & ~F.col("name").isin(*several), F.lit(False))
    needed = [x for x in order if x not in (*optional, error)]
    got = seen.withColumn("twice", twice).groupBy("request_id").agg(
        F.count_if(F.col("place") == 0).alias("unknown"), F.count_if("back").alias("back"), F.count_if(is_end).alias("ends"), F.count_if("after").alias("after"), F.count_if("twice").alias("twice"),
        F.count_if(F.col("name") == error).alias("errors"), F.countDistinct(F.when(F.col("name").isin(*needed), F.col("name"))).alias("there"),
    )
    message = (
        F.when(F.col("unknown") > 0, "unknown event").when(F.col("ends") == 0, "no end").when(F.col("ends") > 1, "several ends").when(F.col("after") > 0, "event after the end")
        .when(F.col("back") > 0, "out of order").when(F.col("twice") > 0, "event twice").when((F.col("errors") == 0) & (F.col("there") < len(needed)), "event is missing")
    )
    return got.select("request_id", message.alias("error"))


def frames_of(text: Column) -> Column:
    """array<struct<event, data>>: the frames of an event-stream text.

    Frames end at a blank line or the end of the text; lines that begin with a
    colon are comments; one blank after a field's colon is dropped; several
    data lines are joined by LF; a frame without data isn't one.
    """
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    begin = F.struct(F.lit(None).cast("string").alias("event"), F.array().cast("array<string>").alias("data"), F.array().cast("array<struct<event: string, data: string>>").alias("frames"))
    value = lambda line: F.regexp_replace(F.regexp_extract(line, "(?s)^[^:]*:?(.*)$", 1), "^ ", "")

    def state(event, data, frames):
        return F.struct(event.alias("event"), data.alias("data"), frames.alias("frames"))

    def sent(acc):
        one = F.struct(F.coalesce(acc["event"], F.lit("message")).alias("event"), F.array_join(acc["data"], "\n").alias("data"))
        return F.when(F.size(acc["data"]) > 0, F.array_append(acc["frames"], one)).otherwise(acc["frames"])

    def step(acc, line):
        none = F.lit(None).cast("string")
        field = F.regexp_extract(line, "^([^:]*)", 1)
        return (
            F.when(line == "", state(none, F.array().cast("array<string>"), sent(acc)))
            .when(field == "event", state(value(line), acc["data"], acc["frames"]))
            .when(field == "data", state(acc["event"], F.array_append(acc["data"], value(line)), acc["frames"]))
            .otherwise(acc)
        )

    return F.aggregate(lines, begin, step, sent)


def until_done(frames: Column) -> tuple[Column, Column]:
    """The frames before [DONE], all without one, and whether it is there."""
    stop = F.array_position(F.transform(frames, lambda x: x["data"]), F.lit("[DONE]")).cast("int")
    return F.when(stop > 0, F.slice(frames, F.lit(1), stop - 1)).otherwise(frames), F.coalesce(stop > 0, F.lit(False))


def parse_stream(streams: DataFrame, text: str = "stream") -> DataFrame:
    """streams with place, event, data of each frame of an event-stream text; what follows [DONE] is ignored."""
    rest = [c for c in streams.columns if c != text]
    made = streams.select(*rest, frames_of(F.col(text)).alias("frames"))
    return made.select(*rest, F.posexplode(until_done(F.col("frames"))[0]).alias("place", "f")).select(*rest, F.col("place").cast("long").alias("place"), "f.event", "f.data")


def shown_frames(streams: DataFrame, text: str = "stream", ends: tuple[str, ...] = ("query_done", "done", "error")) -> DataFrame:
    """What a browser acts on: as ``parse_stream``, but nothing after the first frame that ends the stream, be it the end or an error."""
    rest = [c for c in streams.columns if c != text]
    made = streams.select(*rest, until_done(frames_of(F.col(text)))[0].alias("frames"))
    first = F.array_position(F.transform("frames", lambda x: x["event"].isin(*ends)), F.lit(True)).cast("int")
    kept = F.when(first > 0, F.slice("frames", F.lit(1), first)).otherwise(F.col("frames"))
    return made.select(*rest, F.posexplode(kept).alias("place", "f")).select(*rest, F.col("place").cast("long").alias("place"), "f.event", "f.data")


def provider_answers(streams: DataFrame, text: str = "stream") -> DataFrame:
    """streams with answer and error of a model's streamed completion.

    The answer is the content of all deltas; what the model thinks aloud
    (reasoning_content) is left out.  A frame that isn't a JSON object with
    choices, and a stream that ends without [DONE], as it may be cut, are
    errors, and then there is no answer.
    """
    rest = [c for c in streams.columns if c != text]
    frames, done = until_done(F.col("frames"))
    made = streams.select(*rest, frames_of(F.col(text)).alias("frames")).select(*rest, frames.alias("frames"), done.alias("done"))
    values = made.select(*rest, "done", F.transform("frames", lambda x: F.try_parse_json(x["data"])).alias("vs"))
    bad = F.exists("vs", lambda v: F.try_variant_get(v, "$.choices", "array<variant>").isNull())
    deltas = F.array_join(F.transform("vs", lambda v: F.coalesce(F.try_variant_get(v, "$.choices[0].delta.content", "string"), F.lit(""))), "")
    error = F.when(bad, "a frame has no choices").when(~F.col("done"), "the stream ends without [DONE]")
    return values.select(*rest, F.when(error.isNull(), deltas).alias("answer"), error.alias("error"))


def folded(rows: DataFrame, key: str, order: list[str], columns: list[str], out: str, start, step) -> DataFrame:
    """rows with the columns of the schema out from a fold over each key's rows in order.

    start() makes a key's state; step(state, *columns) returns (state, value),
    a tuple where out has several columns.  Sorted batches go by, so memory is
    one state, whatever a key holds.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(out)
    kinds = [to_arrow_type(f.dataType) for f in made]
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    at, used = rows.columns.index(key), [rows.columns.index(c) for c in columns]

    def run(batches):
        held, state = object(), None
        for batch in batches:
            values: list[list] = [[] for _ in kinds]
            for k, *own in zip(batch.column(at).to_pylist(), *(batch.column(i).to_pylist() for i in used), strict=True):
                if k != held:
                    held, state = k, start()
                state, value = step(state, *own)
                for column, x in zip(values, value if len(kinds) > 1 else (value,), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, values, kinds)], names=[*fields, *made.names])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in fields.items()], out]))


def split_fold(rows: DataFrame, key: str, order: list[str], columns: list[str], out: str, start, step, may_change: Column, simple: Column) -> DataFrame:
    """``folded`` for the keys with a row of may_change; all other rows get simple, without leaving Spark.

    may_change is a window expression over the key's rows.  The keys that have
    one are found first, so a key far below every limit costs a comparison a row.
    """
    marked = rows.withColumn("__may", F.coalesce(may_change, F.lit(False)))
    keys = marked.where("__may").select(key).distinct()
    name = out.split(" ")[0]
    hot = folded(rows.join(keys, key, "left_semi"), key, order, columns, out, start, step)
    return hot.unionByName(rows.join(keys, key, "left_anti").withColumn(name, simple))


def throttled(attempts: DataFrame, most: int = 5, window_s: float = 900.0, lock_s: float = 900.0) -> DataFrame:
    """attempts (address, at in seconds, failed) with state: locked, failed or ok.

    most failures within the window lock the address for lock_s; attempts while
    it is locked count for nothing; a success forgets the failures.  An address
    that never has most failures of any kind within the window is never locked,
    and isn't folded.
    """

    def step(state, at, failed):
        failures, until = state
        if at < until:
            return state, "locked"
        if not failed:
            return ([], 0.0), "ok"
        failures = [t for t in failures if at - t < window_s] + [at]
        return ([], at + lock_s) if len(failures) >= most else (failures, 0.0), "failed"

    # failures of any kind in the window, a microsecond wider as times are rounded
    by = Window.partitionBy("address").orderBy((F.col("at") * 1_000_000).cast("long"))
    failed = F.coalesce(F.col("failed"), F.lit(False))
    recent = F.count(F.when(failed, 1)).over(by.rangeBetween(-int(window_s * 1_000_000) - 1, 0))
    simple = F.when(failed, "failed").otherwise("ok")
    return split_fold(attempts, "address", ["at"], ["at", "failed"], "state string", lambda: ([], float("-inf")), step, recent >= most, simple)


def touched(visits: DataFrame, every_s: float = 300.0) -> DataFrame:
    """visits (session_id, at in seconds) with written: the first, and each at least every_s after the last one written.

    Where every visit comes every_s or more after the one before, all are
    written, and the session isn't folded.
    """

    def step(last, at):
        return (at, True) if last is None or at - last >= every_s else (last, False)

    by = Window.partitionBy("session_id").orderBy("at")
    return split_fold(visits, "session_id", ["at"], ["at"], "written boolean", lambda: None, step, F.col("at") - F.lag("at").over(by) < every_s, F.lit(True))


def unsummarised(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """messages after their session's mark (session_id, upto); no mark: all."""
    return messages.join(marks, "session_id", "left").where(F.coalesce(F.col("seq") > F.col("upto"), F.lit(True))).drop("upto")


def advance(marks: DataFrame, results: DataFrame) -> DataFrame:
    """marks (session_id, upto, summary) after summarising results (session_id, upto, summary): blank or missing summaries move nothing."""
    good = results.where(F.trim(F.coalesce("summary", F.lit(""))) != "").select("session_id", F.col("upto").alias("new_upto"), F.col("summary").alias("new_summary"))
    both = marks.join(good, "session_id", "left")
    on = F.coalesce(F.col("new_upto") > F.col("upto"), F.col("new_upto").isNotNull())
    return both.select("session_id", F.when(on, F.col("new_upto")).otherwise(F.col("upto")).alias("upto"), F.when(on, F.col("new_summary")).otherwise(F.col("summary")).alias("summary"))


def owned(asked: DataFrame, sessions: DataFrame) -> DataFrame:
    """asked (session_id, user_id) with state: not_found, forbidden or ok."""
    known = sessions.select("session_id", F.col("user_id").alias("owner"))
    state = F.when(F.col("owner").isNull(), "not_found").when(F.col("owner") != F.col("user_id"), "forbidden").otherwise("ok")
    return asked.join(known, "session_id", "left").select("session_id", "user_id", state.alias("state"))


def minute_wait(oldest: Column, now: Column, window_s: int = 60) -> Column:
    """Seconds until the oldest attempt leaves the window, at least one."""
    return F.greatest(F.lit(1), F.ceil(oldest + window_s - now)).cast("long")


def midnight_wait(at: Column) -> Column:
    """Seconds until the next day, at least one."""
    end = F.date_trunc("day", at) + F.make_dt_interval(F.lit(1))
    return F.greatest(F.lit(1), F.ceil((F.unix_micros(end) - F.unix_micros(at)) / 1_000_000)).cast("long")


def short_time(at: Column, today: Column) -> Column:
    """HH:mm on the day of today, MM-dd before; nothing for what isn't a time."""
    return F.coalesce(F.when(F.to_date(at) == today, F.date_format(at, "HH:mm")).otherwise(F.date_format(at, "MM-dd")), F.lit(""))
