"""Tables as immutable segments with tombstones, so that a change writes what it changes.

A publication adds rows in one segment, and keys whose earlier rows are over in another: its
tombstones. Every row and tombstone has the number of its publication; a tombstone ends rows
of its key with a smaller number, so replacing a row is a tombstone and a row in one
publication. Reading is one scan of all segments and an anti join with the tombstones.

Segments are merged by size: once FAN of them are of one tier (each tier holds FAN times the
rows of the one below), they become one of the next, without the rows that are over. So a
row is rewritten as often as the table has tiers, and there are few segments. A segment
knows up to which publication tombstones have been applied to it; tombstones that all
segments have behind them go. Where tombstones outnumber half of the rows, everything is merged.

State is a plain value (`Table`) that the caller keeps; folders are in any store that Spark
writes. Null keys match nothing: such rows stay until everything is rewritten.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN, SMALLEST = 8, 10_000
SEQ = "_publication"


@dataclass(frozen=True)
class Segment:
    place: str
    rows: int
    seq: int  # of the newest publication in it
    applied: int  # tombstones up to this publication have no rows here any more


@dataclass(frozen=True)
class Table:
    """What a table consists of: segments of rows, and of tombstones."""

    rows: tuple[Segment, ...] = ()
    dead: tuple[Segment, ...] = ()

    def state(self) -> dict:
        return asdict(self)

    @staticmethod
    def of(state: dict) -> Table:
        return Table(*(tuple(Segment(**s) for s in state.get(kind, ())) for kind in ("rows", "dead")))


@dataclass(frozen=True)
class Segments:
    """How a table is kept: its columns, the key of its tombstones, and what its files are sorted by."""

    schema: str
    key: str
    order: tuple[str, ...] = ()
    fan: int = FAN
    smallest: int = SMALLEST
    written: list[int] = field(default_factory=list, compare=False)  # rows of each segment that was written

    def _key_schema(self) -> str:
        kinds = dict(c.strip().split(" ", 1) for c in _columns(self.schema))
        return f"{self.key} {kinds[self.key]}, {SEQ} bigint"

    def _write(self, df: DataFrame, folder: str, seq: int, applied: int) -> Segment | None:
        place = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
        order = [c for c in self.order if c in df.columns]
        (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.parquet(place)
        n = df.sparkSession.read.schema(df.schema).parquet(place).count()  # from the files' footers
        self.written.append(n)
        return Segment(place, n, seq, applied) if n else None

    def _tombstones(self, spark: SparkSession, dead: tuple[Segment, ...]) -> DataFrame:
        found = spark.read.schema(self._key_schema()).parquet(*[s.place for s in dead])
        return found.groupBy(self.key).agg(F.max(SEQ).alias(SEQ))

    def _live(self, spark: SparkSession, some: tuple[Segment, ...], dead: tuple[Segment, ...]) -> DataFrame:
        rows = spark.read.schema(f"{self.schema}, {SEQ} bigint").parquet(*[s.place for s in some])
        after = min(s.applied for s in some)
        dead = tuple(s for s in dead if s.seq > after)
        if not dead:
            return rows
        over = self._tombstones(spark, dead).withColumnsRenamed({self.key: "_key", SEQ: "_over"})
        return rows.join(over, (rows[self.key] == over["_key"]) & (rows[SEQ] < over["_over"]), "left_anti")

    def read(self, spark: SparkSession, table: Table) -> DataFrame:
        """The rows that are not over."""
        if not table.rows:
            return spark.createDataFrame([], self.schema)
        return self._live(spark, table.rows, table.dead).drop(SEQ)

    def publish(self, spark: SparkSession, table: Table, folder: str, seq: int, rows: DataFrame | None = None, over: DataFrame | None = None) -> Table:
        """The table after publication `seq`: over (keys) ends earlier rows, rows come in. Then tiers that are full are merged."""
        kept, dead = list(table.rows), list(table.dead)
        if over is not None and kept:
            made = self._write(over.select(self.key).where(F.col(self.key).isNotNull()).distinct().withColumn(SEQ, F.lit(seq).cast("bigint")), f"{folder}/over", seq, seq)
            dead += [made] if made else []
        if rows is not None:
            names = [c.strip().split(" ", 1)[0] for c in _columns(self.schema)]
            made = self._write(rows.select(*names, F.lit(seq).cast("bigint").alias(SEQ)), f"{folder}/rows", seq, seq)
            kept += [made] if made else []
        return self._merged(spark, Table(tuple(kept), tuple(dead)), folder, seq)

    def tier(self, segment: Segment) -> int:
        tier, room = 0, self.smallest
        while segment.rows > room:
            tier, room = tier + 1, room * self.fan
        return tier

    def _full(self, some: tuple[Segment, ...]) -> tuple[Segment, ...]:
        """Segments of the lowest tier that is full."""
        tiers: dict[int, list[Segment]] = {}
        for s in some:
            tiers.setdefault(self.tier(s), []).append(s)
        full = [t for t, found in sorted(tiers.items()) if len(found) >= self.fan]
        return tuple(tiers[full[0]]) if full else ()

    def _merged(self, spark: SparkSession, table: Table, folder: str, seq: int) -> Table:
        kept, dead = table.rows, table.dead
        if 2 * sum(s.rows for s in dead) > sum(s.rows for s in kept) > self.smallest:
            kept = self._one(spark, kept, dead, folder, seq)
        while some := self._full(kept):
            kept = tuple(s for s in kept if s not in some) + self._one(spark, some, dead, folder, seq)
        behind = min((s.applied for s in kept), default=seq)
        dead = tuple(s for s in dead if s.seq > behind)
        while some := self._full(dead):
            made = self._write(self._tombstones(spark, some), f"{folder}/over", max(s.seq for s in some), seq)
            dead = tuple(s for s in dead if s not in some) + ((made,) if made else ())
        return Table(kept, dead)

    def _one(self, spark: SparkSession, some: tuple[Segment, ...], dead: tuple[Segment, ...], folder: str, seq: int) -> tuple[Segment, ...]:
        made = self._write(self._live(spark, some, dead), f"{folder}/rows", max(s.seq for s in some), seq)
        return (made,) if made else ()


def _columns(schema: str) -> list[str]:
    """The columns of a schema's text: commas inside of brackets don't part them."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
