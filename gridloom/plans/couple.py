"""Coupling of programs that write and programs that read: rules, request logs, match plans, transfers.

A rule says which datasets two components exchange. Each component appends its requests, boxes with an epoch and a sequence
number, to a log. A transfer of an epoch joins the reads' boxes with the writes' boxes (:func:`match_plan`), then the
plan with the cells; only what was asked for moves. A plan can be kept and replayed for later epochs of the same pattern.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.functions.index import dims
from gridloom.operators.boxes import box_join, cells_in_boxes, coverage, resolve, volume
from gridloom.plans.catalog import Schema
from gridloom.plans.errors import ArrayError, StallError
from gridloom.sources.cdf import decode_header, encode_header


class ConfigError(ValueError):
    pass


def written_gate(spark: SparkSession, path: str) -> bool:
    """File mode: whether a writer has finished, by the success mark of its directory."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(mark)


@dataclass
class Rule:
    """What two components exchange, and how."""

    pattern: str
    comp1: str = ""
    comp2: str = ""
    mode: str = "transfer"
    excludes: list[str] = field(default_factory=list)
    replay: bool = False
    write_only: bool = False
    num_sessions: int = 1
    mirror_io_root: bool = False

    def matches(self, name: str, fold_case: bool = True) -> bool:
        if fold_case:
            name = name.lower()
        return names_match(self.pattern, name) and not any(names_match(x, name) for x in self.excludes)


def names_match(pattern: str, name: str) -> bool:
    """Containment either way, or the pattern's ``%``-separated parts in their order."""
    if "%" not in pattern:
        return pattern in name or name in pattern
    at = 0
    for part in pattern.split("%"):
        found = name.find(part, at)
        if found < 0:
            return False
        at = found + len(part)
    return True


@dataclass
class Config:
    components: list[str]
    rules: list[Rule]
    options: dict[str, str]

    def rule_for(self, name: str, fold_case: bool = True) -> Rule | None:
        """The rule that counts for a dataset: of several, the one declared last."""
        return next((r for r in reversed(self.rules) if r.matches(name, fold_case)), None)


# The keys of the configuration, and which of them are switches.
GENERAL_KEYS = ("ncomp", "comp_name", "buffer_data", "iodb_build_mode", "iodb_range", "do_checksum", "log_ioreqs")
RULE_KEYS = ("filename", "exclude_name", "comp1", "comp2", "mode", "replay_io", "mirror_io_root", "write_only", "num_sessions")
SWITCHES = ("buffer_data", "do_checksum", "log_ioreqs", "replay_io", "mirror_io_root", "write_only")


def parse_config(text: str, fold_case: bool = True) -> Config:
    """Reads a configuration: an [INFO] section, then one [FILE] section for each rule. Unknown keys are errors."""
    components: list[str] = []
    options: dict[str, str] = {}
    rules: list[Rule] = []
    current: Rule | None = None
    for number, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"[#!;].*", "", raw).strip()
        if fold_case:
            line = line.lower()
        if not line:
            continue
        if line.startswith("["):
            section = line.strip("[]").lower()
            if section == "file":
                current = Rule("")
                rules.append(current)
            elif section != "info":
                raise ConfigError(f"line {number}: unknown section {section}")
            continue
        key, sep, value = (x.strip().strip('"') for x in line.partition("="))
        if not sep or key not in GENERAL_KEYS + RULE_KEYS:
            raise ConfigError(f"line {number}: unknown parameter {key}")
        if key in SWITCHES and value not in ("0", "1"):
            raise ConfigError(f"line {number}: {key} is 0 or 1")
        if key == "comp_name":
            components.append(value)
        elif key in GENERAL_KEYS:
            options[key] = value
        elif current is None:
            raise ConfigError(f"line {number}: {key} outside a file section")
        elif key == "filename":
            current.pattern = value
        elif key == "exclude_name":
            current.excludes.append(value)
        elif key in ("comp1", "comp2"):
            if value not in components:
                raise ConfigError(f"line {number}: unknown component {value}")
            setattr(current, key, value)
        elif key == "mode":
            if value not in ("file", "transfer"):
                raise ConfigError(f"line {number}: mode is file or transfer")
            current.mode = value
        elif key == "replay_io":
            current.replay = value == "1"
        elif key == "num_sessions":
            current.num_sessions = int(value)
        else:
            setattr(current, key, value == "1")
    if "ncomp" in options and int(options["ncomp"]) != len(components):
        raise ConfigError(f"{options['ncomp']} components are stated and {len(components)} named")
    if options.get("iodb_build_mode", "range") not in ("varid", "range"):
        raise ConfigError("iodb_build_mode is varid or range")
    for r in rules:
        if not r.pattern:
            raise ConfigError("a file section names no file")
        if not r.comp1 or not r.comp2:
            raise ConfigError(f"{r.pattern}: both components are needed")
        if r.mode == "file":
            r.replay = False
    return Config(components, rules, options)


def rule_matches(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, rule) of each name and the last declared rule (rule, ord, pattern, excludes) that it fits.

    Rules are configuration: a handful of rows, whose number is checked before they are broadcast.
    """
    if rules.count() > 10_000:
        raise ConfigError("more than 10000 rules")

    def fits(name: Column, pattern: Column) -> Column:
        ordered = F.rlike(name, F.concat(F.lit("(?s)"), F.array_join(F.transform(F.split(pattern, "%"), lambda p: F.concat(F.lit("\\Q"), p, F.lit("\\E"))), ".*")))
        return F.when(F.contains(pattern, F.lit("%")), ordered).otherwise(F.contains(name, pattern) | F.contains(pattern, name))

    hit = names.join(F.broadcast(rules), fits(F.col("name"), F.col("pattern")) & ~F.exists("excludes", lambda x: fits(F.col("name"), x)))
    return hit.groupBy("name").agg(F.max_by("rule", "ord").alias("rule"))


#: Columns of a request log before the box.
REQUEST = ("req_id", "component", "rank", "varid", "rw", "epoch", "seq")


def reads(requests: DataFrame) -> DataFrame:
    return requests.filter("rw = 'r'").withColumnRenamed("req_id", "id")


def writes(requests: DataFrame) -> DataFrame:
    return requests.filter("rw = 'w'").withColumnRenamed("req_id", "id")


def announced(requests: DataFrame) -> DataFrame:
    """Requests once each, however often they were announced: the one of the highest ``seq``, then of the largest row hash."""
    rest = [c for c in requests.columns if c != "req_id"]
    newest = F.max_by(F.struct(*rest), F.struct(F.col("seq"), F.xxhash64(*rest)))
    return requests.groupBy("req_id").agg(newest.alias("_r")).select(*[F.col("_r").getField(c).alias(c) if c != "req_id" else F.col(c) for c in requests.columns])


def match_plan(requests: DataFrame, ndims: int, width: int | None = None) -> DataFrame:
    """(epoch, varid, r_id, w_id, lo.., hi..): the full intersection of every read with every write of its epoch and variable."""
    log = announced(requests)
    return box_join(reads(log), writes(log), ndims, ["epoch", "varid"], width)


def strict_overlaps(requests: DataFrame, ndims: int) -> DataFrame:
    """Pairs of different writes of one epoch and variable whose boxes overlap."""
    w = writes(announced(requests))
    return box_join(w, w, ndims, ["epoch", "varid"]).filter("r_id < w_id")


def deliver(plan: DataFrame, cells: DataFrame, ndims: int, on_overlap: str = "last") -> DataFrame:
    """(r_id, index, value) of what each read gets: the plan joined with the written cells (w_id, seq, index, value).

    Cells meet the pieces of their write by cells of a grid, so that a large write with many readers is many keys.
    """
    got = cells_in_boxes(cells, plan.select("r_id", "w_id", *[f"{e}{i}" for e in ("lo", "hi") for i in range(ndims)]), ndims, ["w_id"]).select("r_id", "seq", *dims(ndims), "value")
    return resolve(got, ["r_id", *dims(ndims)], on_overlap).select("r_id", *dims(ndims), "value")


def pattern_of(plan: DataFrame, requests: DataFrame, ndims: int) -> DataFrame:
    """A plan without request ids: which rank's box is met by which rank's, to be replayed for other epochs."""
    log = announced(requests)
    box = lambda df, p: df.select("epoch", F.col("id").alias(f"{p}_id"), F.col("rank").alias(f"{p}_rank"), *[F.col(f"{x}{i}").alias(f"{p}_{x}{i}") for x in "sc" for i in range(ndims)])
    keys = ["varid", "r_rank", "w_rank", *[f"{p}_{x}{i}" for p in "rw" for x in "sc" for i in range(ndims)]]
    met = plan.join(box(reads(log), "r"), ["epoch", "r_id"]).join(box(writes(log), "w"), ["epoch", "w_id"])
    return met.select(*keys, *[f"lo{i}" for i in range(ndims)], *[f"hi{i}" for i in range(ndims)]).distinct()


def replay(pattern: DataFrame, requests: DataFrame, ndims: int) -> DataFrame:
    """The plan of epochs whose requests have a recorded pattern, by equi-joins alone."""
    log = announced(requests)

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select("epoch", "varid", F.col("id").alias(f"{p}_id"), F.col("rank").alias(f"{p}_rank"), *[F.col(f"{x}{i}").alias(f"{p}_{x}{i}") for x in "sc" for i in range(ndims)])

    r_keys = ["varid", "r_rank", *[f"r_{x}{i}" for x in "sc" for i in range(ndims)]]
    w_keys = ["epoch", "varid", "w_rank", *[f"w_{x}{i}" for x in "sc" for i in range(ndims)]]
    met = side(reads(log), "r").join(pattern, r_keys).join(side(writes(log), "w"), w_keys)
    return met.select("epoch", "varid", "r_id", "w_id", *[f"lo{i}" for i in range(ndims)], *[f"hi{i}" for i in range(ndims)])


@dataclass
class Transfer:
    """The result of one epoch."""

    plan: DataFrame
    delivered: DataFrame
    coverage: DataFrame

    def incomplete(self) -> DataFrame:
        return self.coverage.filter("not complete")


def schema_frame(spark: SparkSession, name: str, schema: Schema) -> DataFrame:
    """A schema as a row (name, header), to be handed to a reader that opens the dataset before there is a file."""
    return spark.createDataFrame([(name, encode_header(schema, schema.layout()[0]))], "name string, header binary")


def schema_of(frame: DataFrame, name: str) -> Schema:
    """The schema that was handed over for a dataset."""
    row = frame.filter(F.col("name") == name).first()
    if row is None:
        raise ArrayError("NC_ENOENT", name)
    return decode_header(bytes(row["header"])).schema


class Coupler:
    """Exchange of named datasets between components under a configuration, epoch by epoch.

    ``control`` is a folder that the components share, in which they leave marks for each other: that a reader needs no more epochs,
    that a component has ended.
    """

    def __init__(self, spark: SparkSession, config: Config, component: str, control: str | None = None):
        if component.lower() not in [c.lower() for c in config.components]:
            raise ConfigError(f"unknown component {component}")
        self.spark, self.config, self.component = spark, config, component
        self.epochs: dict[str, int] = {}
        self.patterns: dict[str, DataFrame] = {}
        self.sessions: dict[str, int] = {}
        self.control = control
        self.finished = False
        self.roles: dict[str, str] = {}
        self.seen: list[DataFrame] = []
        self.times: dict[str, list[float]] = {}
        self.streams: list[StreamingQuery] = []

    # marks

    def _mark(self, what: str) -> None:
        if self.control:
            self.spark.range(1).write.mode("overwrite").parquet(f"{self.control}/{what}")

    def _marked(self, what: str) -> bool:
        return bool(self.control) and written_gate(self.spark, f"{self.control}/{what}")

    def peer_finished(self, name: str) -> bool:
        """Whether the other component of a dataset's rule has ended."""
        rule = self.config.rule_for(name)
        peers = {c.lower() for c in (rule.comp1, rule.comp2)} - {self.component.lower()} if rule else set()
        return any(self._marked(f"ended-{c}") for c in peers)

    # timers and logs

    @contextmanager
    def timed(self, what: str) -> Iterator[None]:
        """Adds the time of a block to a timer."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.times.setdefault(what, []).append(time.perf_counter() - began)

    def timings(self) -> DataFrame:
        """(component, what, calls, seconds) of all timers; rows that :func:`gridloom.operators.reduce.statistics` takes."""
        rows = [(self.component, what, len(t), sum(t)) for what, t in self.times.items()]
        return self.spark.createDataFrame(rows, "component string, what string, calls long, seconds double")

    def audit(self) -> DataFrame:
        """The requests of all transfers so far, with their dataset, if ``log_ioreqs`` is on."""
        if not self.seen:
            return self.spark.createDataFrame([], "dataset string, req_id string, component string, rw string, epoch long")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self.seen)

    def transfer(self, name: str, requests: DataFrame, cells: DataFrame, ndims: int, on_overlap: str = "last") -> Transfer | None:
        """One epoch of a dataset. Writes that only go out, under a write-only rule, are acknowledged and dropped."""
        if self.finished:
            raise ConfigError(f"{self.component} has ended")
        rule = self.config.rule_for(name)
        if rule is None or rule.mode != "transfer":
            raise ConfigError(f"{name} is under no transfer rule")
        epoch = self.epochs.get(name, 0)
        self.epochs[name] = epoch + 1
        now = requests.filter(F.col("epoch") == epoch)
        if self.config.options.get("log_ioreqs") == "1":
            self.seen.append(announced(now).withColumn("dataset", F.lit(name)))
        if rule.write_only:
            return None
        with self.timed(f"transfer {name}"):
            return self._transfer(name, rule, now, cells, ndims, on_overlap)

    def _transfer(self, name: str, rule: Rule, now: DataFrame, cells: DataFrame, ndims: int, on_overlap: str) -> Transfer:
        if on_overlap == "error" and (hit := strict_overlaps(now, ndims).first()):
            raise ArrayError("NC_EINVAL", f"writes {hit['r_id']} and {hit['w_id']} overlap")
        if rule.replay and name in self.patterns:
            plan = replay(self.patterns[name], now, ndims)
            # Reads that the recorded pattern does not cover are matched anew.
            told = coverage(reads(announced(now)), plan, ndims).filter("not complete").select(F.col("id").alias("req_id"))
            if not told.isEmpty():
                again = announced(now).join(told.withColumn("_open", F.lit(True)), "req_id", "left").filter("rw = 'w' OR _open").drop("_open")
                plan = plan.join(told.withColumnRenamed("req_id", "r_id"), "r_id", "left_anti").select(*plan.columns).unionByName(match_plan(again, ndims))
        else:
            plan = match_plan(now, ndims)
            if rule.replay:
                self.patterns[name] = pattern_of(plan, now, ndims).cache()
        delivered = deliver(plan, cells, ndims, on_overlap if on_overlap != "error" else "last")
        return Transfer(plan, delivered, coverage(reads(announced(now)), plan, ndims))

    def transfer_all(self, datasets: dict[str, tuple[DataFrame, DataFrame, int]]) -> dict[str, Transfer | None]:
        """One epoch of every dataset."""
        return {name: self.transfer(name, *args) for name, args in datasets.items()}

    def transfer_multiple(
        self, name: str, epoch: Callable[[int], tuple[DataFrame, DataFrame] | None], ndims: int, on_transfer: Callable[[int, Transfer], None] | None = None, timeout: float = 180.0
    ) -> int:
        """A writer serves a reader's epochs until the reader needs no more, or ends; returns how many.

        ``epoch(k)`` gives the requests and cells of epoch k, or None while they are not there. Only a component that writes may call it.
        """
        served, began = 0, time.monotonic()
        while not (self._marked(f"done-{name}") or self.peer_finished(name)):
            given = epoch(self.epochs.get(name, 0))
            if given is None:
                if time.monotonic() - began > timeout:
                    raise StallError(f"{name}: no requests for {timeout:g} s")
                time.sleep(min(0.2, timeout))
                continue
            requests, cells = given
            if requests.filter((F.lower("component") == self.component.lower()) & (F.col("rw") == "w")).isEmpty():
                raise ConfigError(f"{self.component} writes nothing of {name}")
            self.roles[name] = "writer"
            out = self.transfer(name, requests, cells, ndims)
            if on_transfer and out is not None:
                on_transfer(served, out)
            served, began = served + 1, time.monotonic()
        return served

    def complete_multiple(self, name: str) -> None:
        """A reader tells the writer that it needs no more epochs."""
        if self.roles.get(name) == "writer":
            raise ConfigError(f"{self.component} writes {name}")
        self.roles[name] = "reader"
        self._mark(f"done-{name}")

    def watch(self, query: StreamingQuery) -> StreamingQuery:
        """A stream that :meth:`finalize` is to drain."""
        self.streams.append(query)
        return query

    def finalize(self) -> DataFrame:
        """Drains the streams, lets all plans go, tells the other components, and returns the timings; nothing can be exchanged after it."""
        if self.finished:
            raise ConfigError(f"{self.component} has ended")
        with self.timed("finalize"):
            for query in self.streams:
                if query.isActive:
                    query.processAllAvailable()
                    query.stop()
            for pattern in self.patterns.values():
                pattern.unpersist()
            self.patterns.clear()
            self._mark(f"ended-{self.component.lower()}")
        self.finished = True
        return self.timings()

    def close(self, name: str) -> bool:
        """Ends a session; True if it was the last, and the dataset's plan is let go."""
        rule = self.config.rule_for(name)
        self.sessions[name] = self.sessions.get(name, 0) + 1
        if rule is None or self.sessions[name] < rule.num_sessions:
            return False
        if name in self.patterns:
            self.patterns.pop(name).unpersist()
        return True


def moved_cells(plan: DataFrame, ndims: int, by: Sequence[str] = ("epoch",)) -> DataFrame:
    """Cells that a plan moves."""
    return plan.groupBy(*by).agg(F.sum(volume(ndims)).alias("cells"), F.count("*").alias("pieces"))
