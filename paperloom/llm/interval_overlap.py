"""Interval overlap join of sales and click sessions, summed per sale and relation.

Two tables of intervals ``client, start, end`` (slots, both ends inclusive, an
open end is ``OPEN``) are joined where a client's intervals share a slot, and
the pairs are summed by how they lie to each other (``RELATIONS``). Pairs are
never made:

1. Intervals of one client with equal ends are one class (count and sum).
2. Classes are range-partitioned by client and start over the whole table, so a
   client with a third of all rows fills many partitions. A scan of each
   partition puts out, for its first and last client only, what ends when: a few
   rows a partition, since only those two can lie in other partitions too.
3. From these rows a join on the client gives every later partition the ends of
   sessions and sales that are still active where the client begins there.
   What a pair adds once one side began in an earlier partition depends on
   the ends alone, so ends are carried, summed up, not intervals. Nothing is
   broadcast.
4. Each partition sweeps its starts in order with the ends that are active: a
   pair is counted where its later start lies.
5. Sums that a carried sale end found in later partitions are added to those of
   the sales that it stands for, and every sale reads the sums of its class.

A sweep holds the distinct ends active at a time, which slots bound; classes of
one client are bounded by slots as well, not by rows.

Defined cases: rows without client or start take no part. An end before its
start, or null, is the start. Rows that repeat a sale id are separate sales
(each gets its rows), a null sale id is a sale without lines; repeated clicks
are one. Other columns are not read; ids and clients may be of any type that
sorts, as no column of the inputs keeps its name on the way. Times may be with
or without a zone; without one they count as UTC. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paperloom.llm import arrow, scratch

#: How the left interval lies to the right one: it starts earlier, equally, later; within each it ends earlier, equally, later.
RELATIONS = ("overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by")
#: An end that never comes.
OPEN = (1 << 63) - 1
GAP = 15 * 60 * 1_000_000
SLOT = 6 * 3600 * 1_000_000
_DAY = 86_400_000_000
#: Rows put out at a time.
BATCH = 20_000


def micros(df: DataFrame, column: str) -> Column:
    """Whole microseconds since 1970 of a time, whatever the session's zone."""
    at = F.col(column)
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        days = F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        seconds = (F.hour(at) * 3600 + F.minute(at) * 60).cast("long") * 1_000_000
        return days * _DAY + seconds + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")
    return F.unix_micros(at.cast("timestamp"))


def slot_of(at: Column, slot: int) -> Column:
    """Number of the slot that a time lies in (whole numbers only, rounded down)."""
    return F.floor((at - F.pmod(at, F.lit(slot))) / F.lit(slot)) if slot > 1 else at


# --- intervals of the shop -----------------------------------------------------


def sessions(clicks: DataFrame, gap: int = GAP) -> DataFrame:
    """``client, first, last, open``: a click more than ``gap`` after the client's last one begins another session.

    First within stretches of ``SLOT`` of a client, then over the stretches'
    pieces, of which a client has at most ``SLOT / gap`` each: no task sorts all
    clicks of a client.
    """
    rows = clicks.select(F.col("client_id").alias("client"), micros(clicks, "ts").alias("at"), F.coalesce(F.col("kind") == "error", F.lit(False)).alias("error"))
    rows = rows.filter("client is not null and at is not null").withColumn("stretch", slot_of(F.col("at"), SLOT))
    near = Window.partitionBy("client", "stretch").orderBy("at")
    begins = F.coalesce((F.col("at") - F.lag("at").over(near) > gap).cast("int"), F.lit(1))
    rows = rows.withColumn("begins", begins).withColumn("piece", F.sum("begins").over(near.rangeBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.struct("at", "error")).alias("last")
    pieces = rows.groupBy("client", "stretch", "piece").agg(F.min("at").alias("first"), last)
    order = Window.partitionBy("client").orderBy("first")
    begins = F.coalesce((F.col("first") - F.lag("last.at").over(order) > gap).cast("int"), F.lit(1))
    pieces = pieces.withColumn("begins", begins).withColumn("session", F.sum("begins").over(order))
    whole = pieces.groupBy("client", "session").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return whole.select("client", "first", F.col("last.at").alias("last"), F.col("last.error").alias("open"))


def sale_times(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """``sale_id, client, first, last, open``: from the sale to the last shipment of its lines."""
    shipped = lines.select(F.col("sale_id").alias("_sale"), micros(lines, "shipped_at").alias("at")).filter("_sale is not null")
    shipped = shipped.groupBy("_sale").agg(F.max("at").alias("shipped"))
    rows = sales.select("sale_id", F.col("client_id").alias("client"), micros(sales, "sold_at").alias("first"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("open"))
    rows = rows.filter("client is not null and first is not null")
    rows = rows.join(shipped.hint("merge"), rows["sale_id"] == shipped["_sale"], "left")
    return rows.select("sale_id", "client", "first", F.greatest("first", "shipped").alias("last"), "open")


def in_slots(times: DataFrame, slot: int = SLOT) -> DataFrame:
    """``times`` with ``start`` and ``end`` slots; an open interval ends at ``OPEN``."""
    end = F.when(F.col("open"), F.lit(OPEN)).otherwise(slot_of(F.col("last"), slot))
    return times.withColumn("start", slot_of(F.col("first"), slot)).withColumn("end", end)


# --- the join --------------------------------------------------------------------

_CODED = "kind int, part int, client {}, start long, end long, n long, crc long"
_SESSION, _SALE, _EDGE_SESSION, _EDGE_SALE = range(4)


def _runs(client: pa.Array) -> list[int]:
    """Where runs of equal clients begin in a sorted batch, and its length."""
    n = len(client)
    if not n:
        return [0]
    same = pa.compute.equal(client.slice(1), client.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(~same) + 1).tolist(), n]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted partition with its number, and the ends of its first and last client."""
    part, first, now, ends = TaskContext.get().partitionId(), None, None, {}
    names = ["kind", "part", "client", "start", "end", "n", "crc"]
    kind_of = None

    def edge(client: object, found: dict) -> pa.RecordBatch:
        at = min(v[2] for v in found.values())
        rows = [(k + _EDGE_SESSION, part, client, at, end, n, crc) for (k, end), (n, crc, _) in found.items()]
        cols = list(zip(*rows, strict=True))
        types = (pa.int32(), pa.int32(), kind_of, *[pa.int64()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        clients, kind_of, n = batch.column(1), batch.column(1).type, batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part, np.int32)), *batch.columns[1:]], names)
        edges = _runs(clients)
        kind, start, end, count, crc = (batch.column(i).to_numpy() for i in (0, 2, 3, 4, 5))
        for a, b in {edges[0]: edges[1], edges[-2]: edges[-1]}.items():  # clients in between are whole
            client = clients[a].as_py()
            if client != now:
                if first is None and ends:
                    first = now
                    yield edge(now, ends)
                now, ends = client, {}
            for k, s, e, c, x in zip(*(v[a:b].tolist() for v in (kind, start, end, count, crc)), strict=True):
                held = ends.get((k, e))
                ends[k, e] = (c, x, s) if held is None else (held[0] + c, held[1] + x, min(held[2], s))
    if ends:
        yield edge(now, ends)


class _Sweep:
    """One client's starts in one partition, in order."""

    def __init__(self) -> None:
        self.active: dict[int, list[int]] = {}  # session ends: count, sum
        self.found: dict[int, list[int]] = {}  # sale ends: what sessions that began later added, three relations of three sums
        self.waiting: dict[int, list[tuple]] = {}  # sale ends: sales and what was found before them
        self.carried: set[int] = set()
        self.out: list[tuple[bool, int, int, list[tuple]]] = []

    def carry(self, kind: int, end: int, n: int, crc: int) -> None:
        if kind == _SESSION:
            self.active[end] = [n, crc]
        else:
            self.found[end] = [0] * 9
            self.carried.add(end)

    def _close(self, end: int) -> None:
        found = self.found.pop(end)
        for start, before, sums in self.waiting.pop(end, ()):
            rows = [(i // 3, *(found[i + j] - before[i + j] for j in range(3))) for i in range(0, 9, 3) if found[i] > before[i]]
            self.out.append((False, start, end, rows + sums))
        if end in self.carried:
            rows = [(i // 3, *found[i : i + 3]) for i in range(0, 9, 3) if found[i]]
            if rows:
                self.out.append((True, 0, end, rows))

    def at(self, t: int, sessions_here: list[tuple], sales_here: list[int]) -> None:
        active, found = self.active, self.found
        for end in [e for e in active if e < t]:
            del active[end]
        for end in [e for e in found if e < t]:
            self._close(end)
        for end, sums in found.items():
            for d, n, crc in sessions_here:
                i = 0 if end < d else 3 if end == d else 6
                sums[i] += n
                if end != OPEN or d != OPEN:
                    sums[i + 1] += (min(end, d) - t + 1) * n
                sums[i + 2] += crc
        for end in sales_here:
            rows = []
            for base, others in ((3, sessions_here), (6, [(d, *v) for d, v in active.items()])):
                sums = [0] * 9
                for d, n, crc in others:
                    i = 0 if end < d else 3 if end == d else 6
                    sums[i] += n
                    if end != OPEN or d != OPEN:
                        sums[i + 1] += (min(end, d) - t + 1) * n
                    sums[i + 2] += crc
                rows += [(base + i // 3, *sums[i : i + 3]) for i in range(0, 9, 3) if sums[i]]
            self.waiting.setdefault(end, []).append((t, list(found.setdefault(end, [0] * 9)), rows))
        for d, n, crc in sessions_here:
            held = active.setdefault(d, [0, 0])
            held[0] += n
            held[1] += crc

    def close(self) -> list[tuple[bool, int, int, list[tuple]]]:
        for end in list(self.found):
            self._close(end)
        return self.out


_SUMS = "array<struct<relation:int,n:long,overlap:long,crc:long>>"


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by ``part, client, start`` (carried ends first) to sums of classes and of carried ends.

    ``edge`` marks the first and last client of a partition.
    """
    held, size, kind_of = [], 0, None
    pair = pa.struct([("relation", pa.int32()), ("n", pa.int64()), ("overlap", pa.int64()), ("crc", pa.int64())])

    def batch_of() -> pa.RecordBatch:
        part, client, edge, carried, start, end, sums = zip(*held, strict=True)
        counts = np.array([len(s) for s in sums])
        flat = np.array([x for s in sums for row in s for x in row], np.int64).reshape(-1, 4)
        items = pa.StructArray.from_arrays([pa.array(flat[:, 0].astype(np.int32)), *(pa.array(flat[:, i]) for i in (1, 2, 3))], fields=list(pair))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        cols = [pa.array(part, pa.int32()), pa.array(client, kind_of), pa.array(edge), pa.array(carried), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
        return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(offsets, items)], ["part", "client", "edge", "carried", "start", "end", "sums"])

    part = client = sweep = None
    first, t, here, ends = True, None, [], []

    def take(edge: bool) -> None:
        nonlocal size
        if t is not None:
            sweep.at(t, here, ends)
        for carried, start, end, sums in sweep.close():
            held.append((part, client, edge, carried, start, end, sums))
            size += len(sums) + 1

    for batch in batches:
        kind_of = batch.column(2).type
        edges, clients = _runs(batch.column(2)), batch.column(2)
        columns = [batch.column(i).to_numpy().tolist() for i in (0, 1, 3, 4, 5, 6)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = clients[a].as_py()
            for kind, p, start, end, n, crc in zip(*(c[a:b] for c in columns), strict=True):
                if p != part or own != client:
                    if sweep is not None:
                        take(first or p != part)
                        first = p != part
                        if size >= BATCH:
                            yield batch_of()
                            held, size = [], 0
                    part, client, sweep, t, here, ends = p, own, _Sweep(), None, [], []
                if kind >= _EDGE_SESSION:
                    sweep.carry(kind - _EDGE_SESSION, end, n, crc)
                    continue
                if start != t:
                    if t is not None:
                        sweep.at(t, here, ends)
                    t, here, ends = start, [], []
                if kind == _SESSION:
                    here.append((end, n, crc))
                else:
                    ends.append(end)
    if sweep is not None:
        take(True)
    if held:
        yield batch_of()


def _classes(intervals: DataFrame, kind: int, crc: Column) -> DataFrame:
    own = intervals.filter("client is not null and start is not null").withColumn("end", F.greatest("start", "end"))
    sums = own.groupBy("client", "start", "end").agg(F.count("*").alias("n"), F.sum(crc).alias("crc"))
    return sums.select(F.lit(kind).alias("kind"), "client", "start", "end", "n", F.coalesce("crc", F.lit(0)).cast("long").alias("crc"))


def class_sums(sales: DataFrame, sessions_of: DataFrame, weight: Column) -> DataFrame:
    """``client, start, end, sums``: per class of sales, for each relation pairs, shared slots and summed weights."""
    spark = sales.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = _classes(sessions_of, _SESSION, weight).unionByName(_classes(sales, _SALE, F.lit(0)))
    both = scratch.written(both, "intervals")  # ranges are sampled from it, then it is read again
    client = both.schema["client"].dataType.simpleString()
    ranged = both.repartitionByRange(parts, "client", "start").sortWithinPartitions("client", "start")
    coded = scratch.written(arrow.mapped(ranged, _CODED.format(client), _scan), "ranges")
    scratch.discard(both)

    rows, edges = coded.filter(F.col("kind") < _EDGE_SESSION), coded.filter(F.col("kind") >= _EDGE_SESSION)
    begins = edges.groupBy("client", "part").agg(F.min("start").alias("begin"))
    begins = begins.select(F.col("client").alias("_client"), F.col("part").alias("_part"), "begin").hint("merge")
    met = edges.join(begins, (edges["client"] == begins["_client"]) & (edges["part"] < begins["_part"]) & (edges["end"] >= begins["begin"]))
    carried = met.groupBy("kind", F.col("_part").alias("part"), "client", "end").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc"))
    carried = carried.select("kind", "part", "client", F.lit(None).cast("long").alias("start"), "end", "n", "crc")
    whole = rows.unionByName(carried.select(*rows.columns)).withColumn("start", F.coalesce("start", F.lit(-OPEN)))
    dealt = whole.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "client", "start")
    schema = f"part int, client {client}, edge boolean, carried boolean, start long, end long, sums {_SUMS}"
    found = scratch.written(arrow.mapped(dealt, schema, _swept), "sums")

    done = found.filter("not edge").select("client", "start", "end", "sums")
    own = found.filter("edge and not carried")
    later = found.filter("edge and carried").select(F.col("client").alias("_client"), F.col("end").alias("_end"), F.col("part").alias("_part"), F.col("sums").alias("_sums"))
    more = own.join(later.hint("merge"), (own["client"] == later["_client"]) & (own["end"] == later["_end"]) & (own["part"] < later["_part"]))
    key = ["client", "start", "end"]
    each = own.select(*key, F.inline("sums")).unionByName(more.select(*key, F.inline("_sums")))
    merged = each.groupBy(*key, "relation").agg(*[F.sum(c).alias(c) for c in ("n", "overlap", "crc")])
    merged = merged.groupBy(*key).agg(F.collect_list(F.struct("relation", "n", "overlap", "crc")).alias("sums"))
    return done.unionByName(merged)


def overlaps(sales: DataFrame, sessions_of: DataFrame, weight: Column) -> DataFrame:
    """Per row of ``sales`` (id ``sale_id``) and relation: ``n_pairs``, ``overlap_slots``, ``weights``.

    Both tables have ``client``, ``start`` and ``end``; ``weight`` is a column of ``sessions_of``.
    """
    sums = class_sums(sales, sessions_of, weight)
    own = sales.filter("client is not null and start is not null").select("sale_id", "client", "start", F.greatest("start", "end").alias("end"))
    sums = sums.select(F.col("client").alias("_client"), F.col("start").alias("_start"), F.col("end").alias("_end"), "sums").hint("merge")
    met = own.join(sums, (own["client"] == sums["_client"]) & (own["start"] == sums["_start"]) & (own["end"] == sums["_end"]))
    each = met.select("sale_id", "end", F.inline("sums"))
    both_open = (F.col("end") == OPEN) & (F.col("relation") % 3 == 1)
    return each.select(
        "sale_id",
        F.element_at(F.array(*[F.lit(r) for r in RELATIONS]), F.col("relation") + 1).alias("relation"),
        F.col("n").alias("n_pairs"),
        F.when(~both_open, F.col("overlap")).alias("overlap_slots"),
        F.col("crc").alias("weights"),
    )


def sales_in_sessions(sales: DataFrame, lines: DataFrame, clicks: DataFrame, gap: int = GAP, slot: int = SLOT) -> DataFrame:
    """Sales joined with their clients' click sessions: ``sale_id, relation, n_pairs, overlap_slots, sessions_crc``."""
    held = scratch.written(in_slots(sale_times(sales, lines), slot).select("sale_id", "client", "start", "end"), "sales")
    visits = in_slots(sessions(clicks, gap), slot)
    found = overlaps(held, visits, F.crc32(F.col("first").cast("string")))
    return found.withColumnRenamed("weights", "sessions_crc")
