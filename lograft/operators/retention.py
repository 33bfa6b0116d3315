"""Retention: which rows age, device limits and the size cap remove, under one batch budget.

The driver works out a few thresholds (a cut-off time, a boundary id) from small aggregates. After
that a row's fate depends on the row alone, so the log is labelled in one scan. Limits of up to SENT
devices are sent to all tasks and the log is not shuffled; more are joined, salted by row where a device is hot.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lograft import fixed
from lograft.functions import times
from lograft.operators import filters
from lograft.plans import ordered, salted

EVENT_FIELDS = (
    "ts", "device", "address", "session_id", "event_type", "level", "component", "device_time", "message", "raw",
)
NO_BUDGET = 1 << 62
#: Limited devices, of about a hundred bytes each, that are sent to all tasks.
SENT = 50_000
POLICIES = ("events_age", "events_device", "events_size")


@dataclass(frozen=True)
class Limit:
    max_age_days: float | None = None
    max_events: int | None = None


@dataclass(frozen=True)
class Policy:
    max_age_days: float | None = None
    max_total_bytes: int | None = None
    per_device: Mapping[str, Limit] = field(default_factory=dict)
    batch_size: int = 5000
    max_batches: int | None = None

    def __post_init__(self) -> None:
        """``max_batches``: a budget for one run, given by the caller; by default a run deletes all that the rules reach."""
        ages = [self.max_age_days, *(x.max_age_days for x in self.per_device.values())]
        counts = [self.max_total_bytes, self.batch_size, *(x.max_events for x in self.per_device.values())]
        if any(x is not None and x <= 0 for x in [*ages, *counts]) or (self.max_batches or 0) < 0:
            raise ValueError("ages, sizes, counts and the batch size must be above 0")


def _limited(events: DataFrame, limits: DataFrame, count: int, how: str) -> DataFrame:
    """The log with the limits of its devices; their number is known, as they come from the configuration."""
    if count <= SENT:
        return events.join(F.broadcast(limits), "device", how)
    return salted.salted_join(events, limits, ["device"], how)


@dataclass(frozen=True)
class Step:
    """One row of the plan: a policy, how much it matches, and what the budget lets it delete."""

    number: int
    policy: str
    rule: str
    device: str | None
    matching: int
    demand: int
    batches: int
    deleted: int


def logical_bytes(events: DataFrame) -> Column:
    """Stored size of a row: bytes of all texts, times as 27 characters, 8 for the id."""
    if "row_bytes" in events.columns:
        return F.col("row_bytes")
    total = F.lit(8 + 27).cast("long")
    for name in EVENT_FIELDS:
        if name != "ts":
            total = total + F.coalesce(F.octet_length(name), F.lit(0))
    return total


def stored_bytes(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.sum(logical_bytes(events)), F.lit(0)).cast("long").alias("stored_bytes"))


class Plan:
    """Thresholds of one retention run over ``events``."""

    def __init__(self, events: DataFrame, policy: Policy, now: str | datetime, bits: int = ordered.CHUNK_BITS) -> None:
        self.events, self.policy, self.now, self.bits = events, policy, now, bits
        self.steps: list[Step] = []
        self.budget = NO_BUDGET if policy.max_batches is None else policy.max_batches
        self._ts = events.schema["ts"].dataType
        self._age_end: tuple | None = None  # last (ts, id) the age rule reaches when cut short
        self._limits: dict[str, dict] = {}
        self._size_end: int | None = None
        self._plan()

    # --- keeping a plan ---

    def stored(self) -> dict:
        """The policy and all thresholds as plain values for JSON."""
        end = self._age_end and [times.literal_text(self._age_end[0]), self._age_end[1]]
        return {
            "policy": asdict(self.policy), "now": self.now if isinstance(self.now, str) else self.now.isoformat(" "), "age_end": end,
            "limits": self._limits, "size_end": self._size_end, "budget": self.budget, "steps": [asdict(s) for s in self.steps],
        }

    @classmethod
    def restored(cls, events: DataFrame, kept: dict) -> Plan:
        """A stored plan for rows of the same log, as they are now; nothing is counted again."""
        plan = cls.__new__(cls)
        limits = {d: Limit(**l) for d, l in kept["policy"]["per_device"].items()}
        plan.events, plan.policy, plan.now, plan.bits = events, Policy(**kept["policy"] | {"per_device": limits}), kept["now"], ordered.CHUNK_BITS
        plan.steps, plan.budget, plan._ts = [Step(**s) for s in kept["steps"]], kept["budget"], events.schema["ts"].dataType
        plan._age_end, plan._limits, plan._size_end = kept["age_end"] and tuple(kept["age_end"]), kept["limits"], kept["size_end"]
        return plan

    # --- labelling ---

    def _age_applies(self) -> bool:
        return bool(self.policy.max_age_days) and not (self.steps and self.steps[0].rule == "age" and not self.steps[0].batches)

    def _age(self, events: DataFrame) -> Column:
        if not self._age_applies():
            return F.lit(False)
        return self._until(filters.older_than("ts", self.policy.max_age_days, self.now, events), self._age_end)

    def _until(self, condition: Column, end: tuple | None) -> Column:
        if end is None:
            return condition
        moment = F.lit(end[0]).cast(self._ts)
        return condition & ((F.col("ts") < moment) | ((F.col("ts") == moment) & (F.col("id") <= end[1])))

    def _limit_rows(self, spark: SparkSession) -> DataFrame:
        """One row per limited device, as many as the configuration names."""
        rows = [
            (device, l.get("cutoff"), l.get("end_ts"), l.get("end_id"), l.get("boundary"))
            for device, l in self._limits.items()
        ]
        schema = "device string, _cutoff string, _end_ts string, _end_id long, _boundary long"
        limits = spark.createDataFrame(rows, schema)
        return limits.select(
            "device", F.col("_cutoff").cast(self._ts).alias("_cutoff"), F.col("_end_ts").cast(self._ts).alias("_end_ts"),
            "_end_id", "_boundary",
        )

    def label(self, events: DataFrame | None = None) -> DataFrame:
        """Add ``policy``: the rule that deletes the row, NULL for a row that stays."""
        events = self.events if events is None else events
        rows = events
        device_rule = F.lit(False)
        if self._limits:
            rows = _limited(events, self._limit_rows(events.sparkSession), len(self._limits), "left")
            aged = (F.col("ts") < F.col("_cutoff")) & (
                F.col("_end_ts").isNull() | (F.col("ts") < F.col("_end_ts"))
                | ((F.col("ts") == F.col("_end_ts")) & (F.col("id") <= F.col("_end_id")))
            )
            device_rule = F.coalesce(aged, F.lit(False)) | F.coalesce(F.col("id") <= F.col("_boundary"), F.lit(False))
        label = F.when(self._age(events), POLICIES[0]).when(device_rule, POLICIES[1])
        if self._size_end is not None:
            label = label.when(F.col("id") <= self._size_end, POLICIES[2])
        return rows.select(*events.columns, label.alias("policy"))

    def survivors(self) -> DataFrame:
        """Days that age takes as a whole are not read."""
        events = self.events
        if self._age_applies() and self._age_end is None and "event_date" in events.columns:
            first = F.to_date(filters.age_cutoff(self.policy.max_age_days, self.now, self._ts))
            events = events.filter(F.col("event_date").isNull() | (F.col("event_date") >= first))
        return self.label(events).filter(F.col("policy").isNull()).drop("policy")

    def deleted(self) -> DataFrame:
        """Where age is the only rule, days after the cut-off are not read."""
        alone = not self._limits and self._size_end is None
        events = self.events.filter(self._age(self.events)) if alone else self.events
        return self.label(events).filter(F.col("policy").isNotNull())

    @property
    def exhausted(self) -> bool:
        return self.budget <= 0

    def step_table(self) -> DataFrame:
        rows = [tuple(s.__dict__.values()) for s in self.steps]
        schema = "step long, policy string, rule string, device string, matching long, demand long, batches long, deleted long"
        return self.events.sparkSession.createDataFrame(rows, schema)

    # --- planning ---

    def _spend(self, policy: str, rule: str, device: str | None, matching: int, demand: int) -> int | None:
        """Take batches from the budget; returns the rows to delete if the step is cut short."""
        used = max(0, min(self.budget, demand))
        self.budget -= used
        deleted = min(matching, used * self.policy.batch_size)
        self.steps.append(Step(len(self.steps) + 1, policy, rule, device, matching, demand, used, deleted))
        return deleted if deleted < matching else None

    def _batches(self, matching: int) -> int:
        """An exact multiple costs one more, empty batch; so does having nothing to delete."""
        return matching // self.policy.batch_size + 1

    def _counts(self) -> tuple[int, dict[str, tuple[int, int]]]:
        """Rows the age rule matches; per limited device the rows its age limit matches, and the rest."""
        policy, ts = self.policy, self.events.schema["ts"].dataType
        read = self.events.select("device", "ts", *[c for c in ("event_date",) if c in self.events.columns])
        aged = F.lit(False)
        if policy.max_age_days:
            aged = filters.older_than("ts", policy.max_age_days, self.now, read)
        rows = [
            (d, times.literal_text(filters.cutoff_moment(l.max_age_days, self.now)) if l.max_age_days else None)
            for d, l in policy.per_device.items()
        ]
        if not rows:
            return (read.filter(aged).count() if policy.max_age_days else 0), {}
        limits = self.events.sparkSession.createDataFrame(rows, "device string, _cutoff string").withColumn("_limited", F.col("device"))
        joined = _limited(read, limits, len(rows), "left")
        own = ~aged & F.coalesce(F.col("ts") < F.col("_cutoff").cast(ts), F.lit(False))
        found = joined.groupBy("_limited").agg(
            F.count_if(aged).alias("aged"), F.count_if(own).alias("own"), F.count("*").alias("n")
        ).collect()
        per_device = {r["_limited"]: (r["own"], r["n"] - r["aged"] - r["own"]) for r in found if r["_limited"] is not None}
        return sum(r["aged"] for r in found), per_device

    def _plan(self) -> None:
        policy = self.policy
        aged, per_device = self._counts()
        if policy.max_age_days and self.budget > 0:
            cut = self._spend(POLICIES[0], "age", None, aged, self._batches(aged))
            if cut is not None:
                rows = self.events.filter(filters.older_than("ts", policy.max_age_days, self.now, self.events))
                self._age_end = self._nth(rows, cut)
        over: dict[str, int] = {}
        for device, limit in policy.per_device.items():
            own, rest = per_device.get(device, (0, 0))
            entry = self._limits.setdefault(device, {})
            if limit.max_age_days and self.budget > 0:
                cut = self._spend(POLICIES[1], "device age", device, own, self._batches(own))
                entry["cutoff"] = times.literal_text(filters.cutoff_moment(limit.max_age_days, self.now))
                if cut is not None:
                    rows = self._after_age().filter(
                        (F.col("device") == device) & (F.col("ts") < F.lit(entry["cutoff"]).cast(self._ts))
                    )
                    end = self._nth(rows, cut)
                    entry["end_ts"], entry["end_id"] = (times.literal_text(end[0]), end[1]) if end else (entry["cutoff"], -1)
                    if end is None:
                        entry["cutoff"] = None
            if limit.max_events and rest > limit.max_events and self.budget > 0:
                matching = rest - limit.max_events
                cut = self._spend(POLICIES[1], "device count", device, matching, self._batches(matching))
                if cut is None:
                    over[device] = limit.max_events + 1
                else:
                    rows = self._device_rest(device)
                    end = ordered.locate(rows, cut, ordered.id_levels(bits=self.bits), ["id"], self.bits) if cut else None
                    entry["boundary"] = end["id"] if end else None
        if over:
            for device, boundary in self._boundaries(over):
                self._limits[device]["boundary"] = boundary
        self._limits = {d: l for d, l in self._limits.items() if any(v is not None for v in l.values())}
        if policy.max_total_bytes is not None and self.budget > 0:
            self._plan_size(policy.max_total_bytes)

    def _nth(self, rows: DataFrame, n: int) -> tuple | None:
        if n <= 0:
            return None
        end = ordered.locate(rows.select("ts", "id"), n, ordered.time_levels(bits=self.bits), ["ts", "id"], self.bits)
        return end["ts"], end["id"]

    def _after_age(self) -> DataFrame:
        return self.events.filter(~self._age(self.events))

    def _device_rest(self, device: str) -> DataFrame:
        rows = self._after_age().filter(F.col("device") == device)
        cutoff = self._limits[device].get("cutoff")
        return rows.filter(F.col("ts") >= F.lit(cutoff).cast(self._ts)) if cutoff else rows

    def _boundaries(self, over: Mapping[str, int]) -> list:
        """Newest id each over-full device loses, for all of them in one job."""
        rows = [(d, n, self._limits[d].get("cutoff")) for d, n in over.items()]
        wanted = self.events.sparkSession.createDataFrame(rows, "device string, _n long, _cutoff string")
        kept = _limited(self._after_age().select("device", "ts", "id"), wanted, len(rows), "inner").filter(
            F.col("_cutoff").isNull() | (F.col("ts") >= F.col("_cutoff").cast(self._ts))
        )
        return ordered.nth_newest(kept, ["device"], "id", "_n", bits=self.bits).collect()

    def _plan_size(self, limit: int) -> None:
        """Whole batches of the oldest ids go until the rest fits."""
        rows = self.survivors().select("id", logical_bytes(self.events).alias("_bytes"))
        chunked = rows.withColumn("_chunk", F.shiftright("id", self.bits))
        chunks = chunked.groupBy("_chunk").agg(F.count("*").alias("_rows"), F.sum("_bytes").alias("_bytes"))
        running = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
        everything = Window.partitionBy()
        hit = chunks.select(
            "_chunk", "_rows", "_bytes", F.sum("_rows").over(running).alias("_n"), F.sum("_bytes").over(running).alias("_b"),
            F.sum("_rows").over(everything).alias("count"), (F.sum("_bytes").over(everything) - limit).alias("excess"),
        ).filter((F.col("excess") > 0) & (F.col("_b") >= F.col("excess"))).orderBy("_chunk").first()
        if hit is None:
            return
        size, rows_before, bytes_before = self.policy.batch_size, hit["_n"] - hit["_rows"], hit["_b"] - hit["_bytes"]
        by_id = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
        inside = chunked.filter(F.col("_chunk") == hit["_chunk"]).select(
            "id", F.row_number().over(Window.orderBy("id")).alias("_place"), F.sum("_bytes").over(by_id).alias("_b"))
        place = inside.filter(F.col("_b") >= hit["excess"] - bytes_before).agg(F.min("_place")).first()[0]
        batches = -(-(rows_before + place) // size)
        matching = min(hit["count"], batches * size)
        cut = self._spend(POLICIES[2], "size", None, matching, batches)
        wanted = matching if cut is None else cut
        if rows_before < wanted <= hit["_n"]:  # the last batch ends in the same chunk
            self._size_end = inside.filter(F.col("_place") == wanted - rows_before).first()["id"]
        elif wanted:
            self._size_end = ordered.locate(rows.select("id"), wanted, ordered.id_levels(bits=self.bits), ["id"], self.bits)["id"]

    # --- results ---

    def statistics(self) -> DataFrame:
        """Rows per policy, and how many of them are log lines."""
        counts = [F.count_if(F.col("policy") == p).alias(p) for p in POLICIES]
        lines = F.count_if(F.col("policy").isNotNull() & (F.col("event_type") == "log")).alias("deleted_log_lines")
        return self.label().agg(*counts, lines)


def orphan_sessions(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Ended sessions none of whose rows is left."""
    present = events.select("session_id").distinct()
    return sessions.filter(F.col("ended_at").isNotNull()).join(present, "session_id", "left_anti")


def archive_plan(
    listing: DataFrame, now: str | datetime, prefix: str, max_age_days: float | None = 14.0,
    max_total_bytes: int | None = None,
) -> DataFrame:
    """Files to remove from an export folder: stale temporaries, old exports, then the oldest ones
    while the rest is over the size limit. Other files are never touched."""
    kind = listing.schema["mtime"].dataType
    temp = F.startswith("name", F.lit(".export-tmp-"))
    ours = ~temp & filters.export_file(F.col("name"), prefix)
    moment = times.instant(now, kind)
    stale = temp & (times.exact_seconds(F.col("mtime"), moment) > fixed.STALE_TEMP_SECONDS)
    old = F.lit(False)
    if max_age_days:
        old = ours & (times.exact_seconds(F.col("mtime"), moment) > max_age_days * 86400)
    rows = listing.withColumn("action", F.when(stale, "tmp").when(old, "exports_age"))
    if max_total_bytes is not None:
        kept = F.when(ours & F.col("action").isNull(), F.col("length")).otherwise(0)
        # the newest files that fit together stay
        newest = ordered.running_sum("_newer", kept)
        rows = ordered.scan(
            rows.withColumn("_all", F.lit(1)).withColumn("_age", -F.unix_micros(F.col("mtime").cast("timestamp")))
            .withColumn("_name", F.col("name")),
            ["_all"], "_age", [newest], chunk=-F.unix_date(F.col("mtime").cast("date")), ties=["_name"],
        )
        over = ours & F.col("action").isNull() & (F.col("_newer") > max_total_bytes)
        rows = rows.withColumn("action", F.coalesce("action", F.when(over, F.lit("exports_size"))))
    return rows.filter(F.col("action").isNotNull()).select(*listing.columns, "action")


def run_statistics(
    plan: Plan, sessions: DataFrame, snapshots: DataFrame | None = None, snapshots_left: DataFrame | None = None,
    archives: DataFrame | None = None,
) -> DataFrame:
    """One row: what a whole run removes, by policy."""
    spark = plan.events.sparkSession
    parts = [plan.label().groupBy("policy").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "log").alias("lines"))]
    single = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("policy"), "n", F.lit(0).cast("long").alias("lines"))
    parts.append(single(orphan_sessions(sessions, plan.survivors()), "sessions"))
    if snapshots is not None:
        gone = snapshots.select("id").join(snapshots_left.select("id"), "id", "left_anti")
        parts.append(single(gone, "config_snapshots"))
    if archives is not None:
        parts.append(single(archives.filter(F.col("action") != "tmp"), "exports"))
        parts.append(single(archives.filter(F.col("action") == "tmp"), "tmp"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    total = lambda p: F.coalesce(F.sum(F.when(F.col("policy") == p, F.col("n"))), F.lit(0)).alias(p)
    names = (*POLICIES, "sessions", "config_snapshots", "exports", "tmp")
    lines = F.coalesce(F.sum(F.when(F.col("policy").isNotNull(), F.col("lines"))), F.lit(0)).alias("deleted_log_lines")
    return rows.agg(*[total(p) for p in names], lines)


def cumulative_deleted(runs: DataFrame) -> DataFrame:
    """Log lines deleted over all runs so far; 0 without any run."""
    return runs.agg(F.coalesce(F.sum("deleted_log_lines"), F.lit(0)).cast("long").alias("retention_deleted_log_lines"))
