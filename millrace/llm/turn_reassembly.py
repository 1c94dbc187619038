"""Conversations put together again from turns that arrive late, twice and in any order, by a stateful streaming query.

Event time is the number of the batch that a row arrives in, so the watermark is a clock of batches: each batch is fed with one
tick of its number, whether other rows come or not, and once it is through, the watermark stands at that number. The state
of a conversation, by transformWithState, is a value (the batch of its last arrival and what has been released and counted),
a map from turn to what was kept first, and a tombstone. Each arrival deletes the event-time timer and registers it anew at
last + idle; its expiry closes the conversation, clears the maps and leaves the tombstone, which rejects all later turns. A
timer that is due fires beside the next batch's rows; the closing bears the batch that it belongs to.

The query is started anew for each batch on one checkpoint, and its rows go to a file sink that keeps each exactly once.
State is on disk (RocksDB) and read by turn, so that a task's memory holds no conversation: a conversation's rows of one batch
pass through one task one by one, as short rows (turn, role, hash), and at its closing the numbers of its unreleased turns.

Defined results: rows with a null turn are dropped; null roles and texts are empty; rows with a null conv_id are one
conversation, with a null id; of the rows of a turn in a batch the smallest (payload, role) arrives; an empty table gives an
empty result. Texts may be of any length: only their hashes reach the state. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager
from itertools import chain

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .shared import read_table, remove_at_exit, shared_dir, stage_table

BATCHES = 12
#: So many batches in a row without an arrival close a conversation.
IDLE = 3
#: Turns of one conversation and batch that are held before they go to the state.
FRESH = 10_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A commit writes what has changed, not the whole store; files of small stores are not allocated ahead.
STATE = {
    "stateStore.providerClass": STORE, "stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "stateStore.rocksdb.allowFAllocate": "false", "stateStore.rocksdb.trackTotalNumberOfRows": "false",
}
ARRIVAL = "tick boolean, conv_id long, turn long, batch int, at timestamp, role string, sha256 string, first long"
EVENT = "event string, sha256 string, conv_id long, turn long, batch long, n_missing long, n_breaks long"


def clock(batch: int) -> int:
    """A batch's event time in milliseconds; rows at or before the watermark's start, 0, would be late."""
    return 1000 * (batch + 1)


class Reassembly(StatefulProcessor):
    """State of one conversation; ends is the batch that closes what is open at the end."""

    def __init__(self, idle: int, ends: int):
        self.idle, self.ends = idle, ends

    def init(self, handle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "last int, first long, next long, largest long, n_kept long, n_breaks long")
        self.roles = handle.getMapState("roles", "turn long", "role string")
        self.waiting = handle.getMapState("waiting", "turn long", "sha256 string")
        self.tombstone = handle.getValueState("tombstone", "closed int")

    def expiry(self, last: int) -> int:
        """Between the clock's batches last + idle - 1 and last + idle."""
        return clock(last + self.idle) - 500

    def handleInputRows(self, key, rows, timerValues):
        tick, conv_id = key
        if tick:
            return
        first = next(rows)
        rows, batch = chain([first], rows), first.batch
        life = self.life.get()
        closed = self.tombstone.get() if life is None else None
        if life is not None and life[0] + self.idle < batch:  # the timer is due and has not fired yet
            yield from self.end(conv_id, life)
            closed = (life[0] + self.idle,)
        if closed is not None:
            for row in rows:
                yield event("reject", row.sha256, conv_id, row.turn, batch)
            return
        life = list(life or (None, first.first, first.first, first.first, 0, 0))
        roles: dict = {}  # what this batch has looked up, and has kept but not released
        fresh: dict = {}
        for row in rows:
            self.keep(life, row, roles, fresh)
            if len(fresh) > FRESH:
                self.wait(fresh)
                roles.clear()
        while sha256 := fresh.pop(life[2], None) or self.waited(life[2]):
            yield event("release", sha256, conv_id, life[2], batch)
            life[2] += 1
        self.wait(fresh)
        if life[0] is not None:
            self.handle.deleteTimer(self.expiry(life[0]))
        self.handle.registerTimer(self.expiry(batch))
        life[0] = batch
        self.life.update(tuple(life))

    def role(self, turn: int, roles: dict):
        """The role of a kept turn, else None."""
        if turn not in roles:
            found = self.roles.getValue((turn,))
            roles[turn] = None if found is None else found[0]
        return roles[turn]

    def keep(self, life: list, row, roles: dict, fresh: dict) -> None:
        """The turn, if it is the first of its number."""
        if self.role(row.turn, roles) is not None:
            return
        life[5] += sum(self.role(near, roles) == row.role for near in (row.turn - 1, row.turn + 1))
        self.roles.updateValue((row.turn,), (row.role,))
        roles[row.turn], fresh[row.turn] = row.role, row.sha256
        life[3] = max(life[3], row.turn)
        life[4] += 1

    def wait(self, fresh: dict) -> None:
        for turn, sha256 in fresh.items():
            self.waiting.updateValue((turn,), (sha256,))
        fresh.clear()

    def waited(self, turn: int):
        """The hash of a turn that waits, which then waits no longer."""
        found = self.waiting.getValue((turn,))
        if found is not None:
            self.waiting.removeKey((turn,))
            return found[0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        life = self.life.get()
        if not key[0] and life is not None and self.expiry(life[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            yield from self.end(key[1], life)

    def end(self, conv_id, life):
        left = sorted(turn for (turn,) in self.waiting.keys())
        last, first, _, largest, n_kept, n_breaks = life
        closed = min(last + self.idle, self.ends)
        digest = hashlib.sha256(",".join(map(str, left)).encode()).hexdigest()
        self.handle.deleteTimer(self.expiry(last))
        for state in (self.waiting, self.roles, self.life):
            state.clear()
        self.tombstone.update((closed,))
        yield event("close", digest, conv_id, -1, closed, largest - first + 1 - n_kept, n_breaks)

    def close(self) -> None:
        pass


def event(name, sha256, conv_id, turn, batch, n_missing=None, n_breaks=None) -> Row:
    return Row(event=name, sha256=sha256, conv_id=conv_id, turn=turn, batch=batch, n_missing=n_missing, n_breaks=n_breaks)


def arrivals(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, batch) as rows of ARRIVAL: of a turn in a batch the smallest payload, and its role."""
    turns = turns.where("turn is not null").select("conv_id", "turn", "batch", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    payload = F.concat("role", F.lit("|"), "text").alias("payload")
    least = turns.groupBy("conv_id", "turn", "batch").agg(F.min(F.struct(payload, "role")).alias("least"))
    short = least.select("conv_id", "turn", "batch", F.col("least.role").alias("role"), F.sha2("least.payload", 256).alias("sha256"))
    firsts = turns.groupBy("conv_id").agg(F.min("turn").alias("first")).withColumnRenamed("conv_id", "of")
    return short.join(firsts, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        F.lit(False).alias("tick"), "conv_id", "turn", F.col("batch").cast("int").alias("batch"), at("batch"), "role", "sha256", "first"
    )


def at(batch: str):
    return F.timestamp_millis((F.col(batch).cast("long") + 1) * 1000).alias("at")


def tick(spark: SparkSession, batch: int) -> DataFrame:
    """The one row that moves the clock to a batch."""
    row = spark.range(1).select(F.lit(True).alias("tick"), F.lit(batch).alias("batch"))
    return row.select("tick", *(F.lit(None).cast("long").alias(c) for c in ("conv_id", "turn")), "batch", at("batch"), *(F.lit(None).cast("string").alias(c) for c in ("role", "sha256")), F.lit(None).cast("long").alias("first"))


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Settings of the session for a while."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def feed_batch(rows: DataFrame, folder: str, idle: int, ends: int) -> None:
    """Add rows to the feed, and run the query over them, from where its checkpoint stands, until nothing is left to do."""
    spark = rows.sparkSession
    rows.write.mode("append").parquet(f"{folder}/feed")
    source = spark.readStream.schema(ARRIVAL).parquet(f"{folder}/feed").withWatermark("at", "0 seconds")
    events = source.groupBy("tick", "conv_id").transformWithState(Reassembly(idle, ends), EVENT, "Append", "eventTime")
    query = events.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def reassemble(turns: DataFrame, batches: int = BATCHES, idle: int = IDLE) -> DataFrame:
    """The rows EVENT of turns (conv_id, turn, role, text, batch), batch from 0 to batches - 1."""
    spark = turns.sparkSession
    folder = f"{shared_dir(spark)}/millrace-turns-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    staged = stage_table(arrivals(turns), "arrivals", "batch")
    named = {f"spark.sql.streaming.{k}": v for k, v in STATE.items()}
    # Timers fire beside the next batch's rows; only after the last one a batch without rows is needed.
    with settings(spark, named | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        for batch in range(batches):
            feed_batch(staged.where(F.col("batch") == batch).unionByName(tick(spark, batch)), folder, idle, batches)
    with settings(spark, named | {"spark.sql.streaming.noDataMicroBatches.enabled": "true"}):
        feed_batch(tick(spark, batches + idle), folder, idle, batches)
    return spark.read.schema(EVENT).parquet(f"{folder}/events")


def dealt(conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """conversations with the batch that each row arrives in; two in seven rows arrive once more, with role user."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string"))
    rows = conversations.where("turn is not null").select("conv_id", "turn", "role", "text", F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long").alias("h"))
    plain = F.struct((F.col("h") % batches).alias("batch"), F.col("role").alias("role"))
    again = F.struct(((F.col("h") + 3) % batches).alias("batch"), F.lit("user").alias("role"))
    sent = F.when(F.col("h") % 7 < 2, F.array(plain, again)).otherwise(F.array(plain))
    return rows.select("conv_id", "turn", "text", F.explode(sent).alias("sent")).select("conv_id", "turn", "sent.role", "text", "sent.batch")


def op13_turn_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reassemble(dealt(read_table(spark, sf_dir, "conversations")))


OP13_SQL = f"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
    cast('0x' || substr(sha256(coalesce(conv_id::varchar, '') || ':' || turn::varchar), 1, 8) as bigint) as h
  from conversations where turn is not null
),
sent as (
  select conv_id, turn, role, role || '|' || text as payload, h % {BATCHES} as batch from rows_
  union all
  select conv_id, turn, 'user', 'user|' || text, (h + 3) % {BATCHES} from rows_ where h % 7 < 2
),
arrived as (
  select conv_id, turn, batch, role, sha256(payload) as sha256 from sent
  qualify row_number() over (partition by conv_id, turn, batch order by payload, role) = 1
),
times as (select conv_id, batch, lead(batch) over (partition by conv_id order by batch) as later from (select distinct conv_id, batch from arrived)),
closing as (
  select conv_id, least(min(batch) + {IDLE}, {BATCHES}) as closed from times where later is null or later > batch + {IDLE} group by conv_id
),
firsts as (select conv_id, min(turn) as first from rows_ group by conv_id),
kept as (
  select a.*, f.first from arrived a join closing c on a.conv_id is not distinct from c.conv_id join firsts f on a.conv_id is not distinct from f.conv_id
  where batch <= closed qualify row_number() over (partition by a.conv_id, turn order by batch) = 1
),
placed as (
  select *, row_number() over w - 1 = turn - first as gapless, max(batch) over w as upto, lag(turn) over w as before, lag(role) over w as role_before
  from kept window w as (partition by conv_id order by turn rows between unbounded preceding and current row)
),
sums as (
  select conv_id, sha256(coalesce(string_agg(case when not gapless then turn::varchar end, ',' order by turn), '')) as sha256,
    (max(turn) - min(first) + 1 - count(*))::bigint as n_missing, count(case when before = turn - 1 and role_before = role then 1 end)::bigint as n_breaks
  from placed group by conv_id
)
select 'release' as event, sha256, conv_id, turn, upto::bigint as batch, null::bigint as n_missing, null::bigint as n_breaks from placed where gapless
union all
select 'reject', sha256, a.conv_id, turn, batch, null, null from arrived a join closing c on a.conv_id is not distinct from c.conv_id where batch > closed
union all
select 'close', sha256, s.conv_id, -1, closed, n_missing, n_breaks from sums s join closing c on s.conv_id is not distinct from c.conv_id
"""
