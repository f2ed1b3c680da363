"""The ledger of automatic captures: what is under way or done, within a daily number for each namespace."""

from __future__ import annotations

import datetime
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.syntax import Atom, Clause, DatalogError, Lit, canonical
from .journal import Store, engine_of

STATES = ("stored", "empty", "failed")


class _Refused(Exception):
    pass


class Ledger:
    """Captures as facts of a store: captured(id, namespace, day, status).

    A capture is reserved before it is made, once for each text of a namespace, and finished afterwards; failed ones may be reserved
    again and don't count for the day.
    """

    NAMESPACE = "captures"

    def __init__(self, spark: SparkSession, store: Store | None = None, daily: int = 100):
        self.spark, self.store, self.daily = spark, store or Store(spark), daily

    def review(self) -> DataFrame:
        """(capture, namespace, day, status) of all captures."""
        found = engine_of(self.store.state().where(F.col("namespace") == self.NAMESPACE)).base.get(("captured", 4))
        names = ["capture", "namespace", "day", "status"]
        return found.df.toDF(*names) if found else self.spark.createDataFrame([], ", ".join(f"{n} string" for n in names))

    def usage(self) -> DataFrame:
        """(namespace, day, n): captures of each UTC day that count."""
        return self.review().where("status <> 'failed'").groupBy("namespace", "day").agg(F.count("*").alias("n"))

    @staticmethod
    def _fact(*values: str) -> str:
        return canonical(Clause(Lit("captured", tuple(map(Atom, values)))))

    def _rows(self, old: list[str], new: list[str]) -> list[DataFrame]:
        return [self.store._rows([*((0, self.NAMESPACE, "retract", c, None, None, None) for c in old), *((1, self.NAMESPACE, "assert", c, None, "accepted", None) for c in new)])]

    def reserve(self, namespace: str, text: str, now: datetime.datetime) -> tuple[str, str]:
        """(id of the capture, 'reserved', 'duplicate' or 'daily_cap'); decided while no other writer can change the ledger."""
        capture = "c" + hashlib.sha256(f"{namespace}\0{text}".encode()).hexdigest()
        day = "d" + now.astimezone(datetime.timezone.utc).strftime("%Y%m%d")

        def rows() -> list[DataFrame]:
            known = self.review().where(F.col("capture") == capture).first()
            if known and known["status"] != "failed":
                raise _Refused("duplicate")
            used = self.usage().where((F.col("namespace") == namespace) & (F.col("day") == day)).first()
            if used and used["n"] >= self.daily:
                raise _Refused("daily_cap")
            return self._rows([self._fact(*known)] if known else [], [self._fact(capture, namespace, day, "reserved")])

        try:
            self.store._append(f"reserve {capture} {uuid.uuid4().hex}", {"reserve": capture}, rows, now.isoformat())
        except _Refused as e:
            return capture, str(e)
        return capture, "reserved"

    def finish(self, capture: str, status: str, now: datetime.datetime) -> None:
        """Ends a reserved capture as stored, empty or failed."""
        if status not in STATES:
            raise DatalogError(f"no such state: {status}")

        def rows() -> list[DataFrame]:
            known = self.review().where(F.col("capture") == capture).first()
            if known is None or known["status"] != "reserved":
                raise DatalogError("the capture is not under way")
            return self._rows([self._fact(*known)], [self._fact(*known[:3], status)])

        self.store._append(f"finish {capture} {uuid.uuid4().hex}", {"finish": capture, "status": status}, rows, now.isoformat())

    def prune(self, before: datetime.date, now: datetime.datetime) -> int:
        """Forgets finished captures of UTC days before one: how many, at most 10,000 at a time."""
        day = "d" + before.strftime("%Y%m%d")
        gone = [self._fact(*r) for r in self.review().where((F.col("day") < day) & (F.col("status") != "reserved")).limit(10_000).collect()]
        if gone:
            self.store._append(f"prune {day} {uuid.uuid4().hex}", {"prune": day}, lambda: self._rows(gone, []), now.isoformat())
        return len(gone)
