"""The load engine: infer, compare, evolve, merge and publish.

``Engine(spark, path)`` keeps tables under ``path``.  ``load`` takes any rows or
frame; ``load_chunks`` a sequence of them; ``open_stream`` a session; ``preview``
plans without writing.  Loads do not raise: a result tells what happened.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Mapping, Sequence
from contextlib import nullcontext
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import LoadConfig
from .errors import ConcurrentLoadError, DuplicateKeyError, LoadError, RejectedRowsError, UniqueConflictError
from .functions.numbers import dataset_separators
from .functions.values import store_value
from .header import ColumnDef, Header, overlay
from .operators import merge, rejects, reshape
from .operators.evolve import project
from .plans import ddl
from .plans.diff import Changes, apply_gates, blocked, compare, warnings_of
from .plans.keys import apply_surrogate, predict_indexes
from .plans.profile import infer_header, quoted
from .plans.shape import add_stamps, history_name, split_parts, too_wide
from .sources.catalog import Catalog
from .sources.rows import as_frame, frames
from .sources.scratch import materialize, remove, small_methods, spread
from .sources.store import Store

HISTORY_TIME = "dwh_as_at"
ORDINAL = "_ordinal"


@dataclass
class Unit:
    """What one target table gets in a load."""

    table: str
    data: DataFrame
    current: Header | None
    header: Header
    changes: Changes
    separators: tuple[str, str] | None = None


@dataclass
class LoadResult:
    success: bool
    table: str
    rows: int = 0
    inserted: int = 0
    updated: int = 0
    rejected: int = 0
    duration_ms: int = 0
    phases: dict[str, int] = field(default_factory=dict)
    tables: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    error: str | None = None
    error_code: str | None = None

    @property
    def rows_per_second(self) -> float:
        return self.rows / max(self.duration_ms, 1) * 1000


@dataclass
class TablePreview:
    table: str
    action: str
    inferred: Header
    current: Header | None
    ddl: list[str]
    blocked: list[str]
    not_restorable: list[str] = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession, path: str, config: LoadConfig | None = None):
        self.spark, self.config = spark, config or LoadConfig()
        self.store = Store(spark, path)
        for name in self.config.moot():
            self.config.log("warn", f"{name} has no effect: Spark's partitions and columnar writer decide")
        self.catalog = Catalog(self.store, self.config)

    # Planning

    def plan(self, table: str, df: DataFrame, config: LoadConfig, primary_key: Sequence[str] = (), assume: Mapping[str, ColumnDef] | None = None, existing: Header | None = None, freeze_keys: bool = False, extend_key: bool = False, seen: dict | None = None) -> list[Unit]:
        """Units of a load: the table itself or its parts, and its nested tables.

        ``seen`` keeps what the batch alone tells, for another plan of it.
        """
        whole, df = df, spread(df)
        seen = {} if seen is None else seen
        if "pair" not in seen:
            seen["pair"] = dataset_separators(df, config)
        pair = seen["pair"]
        if pair:
            config = config.with_(thousands_separator=pair[0], decimal_separator=pair[1])
        current = existing if existing is not None else self._current(table)
        if assume and all(c in assume for c in df.columns):
            header = Header({c: assume[c] for c in df.columns})
        else:
            if "inferred" not in seen:
                seen["inferred"] = infer_header(df, config, voted=True)
            header, stats, rows = seen["inferred"]
            header = overlay(header, {k: v for k, v in (assume or {}).items() if k in df.columns})
            if config.auto_indexing and not freeze_keys:
                known = primary_key or (current.primary_keys if current else ())
                header = predict_indexes(header, df, stats, rows, config, [k for k in known if k in header], extend_key and current is None)
        if current and not (config.update_primary_key or primary_key):
            header = Header((n, c.with_(primary=n in current and current[n].primary)) for n, c in header.items())
        header = apply_surrogate(header, current, config)
        if config.add_timestamps:
            header = add_stamps(header)
        return self._units(table, whole, current, header, config, pair)

    def _current(self, table: str) -> Header | None:
        own = self.store.header(table)
        if own is None and (parts := self.store.parts(table)):
            own = Header({n: c for p in parts for n, c in self.store.header(p).items()})
        return own

    def _units(self, table: str, df: DataFrame, current: Header | None, header: Header, config: LoadConfig, pair: tuple[str, str] | None) -> list[Unit]:
        nested = [c for c in df.columns if config.add_nested and f"{table}_{c}" in config.nested_tables]
        changes, merged = compare(current, Header({n: c for n, c in header.items() if n not in nested}), config)
        changes.drop = [n for n in changes.drop if not (current and (current[n].calculated or current[n].auto_increment))]
        merged = apply_gates(current, changes, merged, config)
        units = []
        if config.auto_split and (self.store.parts(table) or too_wide(merged, config)):
            placed = {p: self.store.header(p) for p in self.store.parts(table)}
            parts = split_parts(table, merged, placed, config)
            for part, frame in reshape.split_columns(df, parts).items():
                own = placed.get(part)
                diff, whole = compare(own, parts[part], config)
                units.append(Unit(part, frame, own, apply_gates(own, diff, whole, config), diff, pair))
        else:
            units.append(Unit(table, df, current, merged, changes, pair))
        keys = merged.primary_keys
        for c in nested:
            source = df if df.schema[c].dataType.typeName() in ("array", "struct", "map") else reshape.parse_json_column(df, c)
            child = reshape.extract_nested(source, c, keys)
            if child is not None and not child.isEmpty():
                units += self.plan(f"{table}_{c}", child, config.with_(add_nested=False, nested_tables=()), () if self.store.exists(f"{table}_{c}") else keys, extend_key=True)
        return units

    def preview(self, table: str, data: DataFrame | list[Mapping], primary_key: Sequence[str] = (), **options: object) -> list[TablePreview]:
        """What a load would do, without doing it."""
        config = self.config.with_(**options)
        out = []
        for u in self.plan(table, as_frame(self.spark, data), config, primary_key):
            action = "create" if u.current is None else "alter" if u.changes.exist() and u.header != u.current else "noop"
            statements = ddl.create_table(u.table, u.header, config) if u.current is None else ddl.alter_table(u.table, u.current, u.header, u.changes, config)
            out.append(TablePreview(u.table, action, u.header, u.current, statements if action != "noop" else [], blocked(u.changes, config), warnings_of(u.changes) if action == "alter" else []))
        return out

    # Loading

    def load(self, table: str, data: DataFrame | list[Mapping], primary_key: Sequence[str] = (), assume: Mapping[str, ColumnDef] | None = None, mark: tuple[str, int] | None = None, freeze_keys: bool = False, **options: object) -> LoadResult:
        """Load a batch; the result tells success, counts and warnings.

        A load is planned and published on one state of the store.  If another
        load publishes one of its tables meanwhile, it is done again on top of
        that, up to ``max_retries`` times; with ``use_schema_lock`` loads of one
        table wait for each other instead.
        """
        began, started = time.monotonic(), time.time()
        result = LoadResult(False, table)
        try:
            config = self.config.with_(**options)
            df = as_frame(self.spark, data)
            guard = self.store.files.lock(f"{self.store.path}/_locks/{table}.lock", config.schema_lock_timeout) if config.use_schema_lock else nullcontext()
            with guard:
                seen: dict = {}  # the batch is profiled once, however often its load is planned
                for left in reversed(range(config.max_retries)):
                    result = LoadResult(False, table)
                    try:
                        with self.store.pinned():
                            self._attempt(table, df, config, result, primary_key, assume, mark, freeze_keys, seen)
                        break
                    except ConcurrentLoadError:
                        if not left:
                            raise
            result.success = True
        except Exception as e:
            result.error, result.error_code = str(e), getattr(e, "code", None) or getattr(e, "getCondition", lambda: None)() or type(e).__name__
        result.duration_ms = int((time.monotonic() - began) * 1000)
        self._report(result, started)
        return result

    def _attempt(
        self, table: str, df: DataFrame, config: LoadConfig, result: LoadResult, primary_key: Sequence[str], assume: Mapping[str, ColumnDef] | None, mark: tuple[str, int] | None, freeze_keys: bool, seen: dict
    ) -> None:
        t = time.monotonic()
        units = self.plan(table, df, config, primary_key, assume, freeze_keys=freeze_keys, seen=seen)
        result.phases["plan"] = int((time.monotonic() - t) * 1000)
        result.tables = [u.table for u in units]
        for u in units:
            result.warnings += [f"{u.table}: {w}" for w in blocked(u.changes, config)]
            if config.schema_history and config.detect_drift:
                self.catalog.check_drift(u.table, u.current)
        for w in result.warnings:
            config.log("warn", w)
        versions = {u.table: self.catalog.start(u.table, u.current, u.changes.as_json()) if config.schema_history and (u.current is None or u.header != u.current) else None for u in units}
        t = time.monotonic()
        try:
            self._apply(units, config, result, mark)
        except Exception:
            for name, v in versions.items():
                self.catalog.finish(name, v, "rolled_back")
            raise
        for u in units:
            self.catalog.finish(u.table, versions[u.table], "applied", u.header)
        result.phases["load"] = int((time.monotonic() - t) * 1000)

    def _report(self, r: LoadResult, started: float) -> None:
        run = {
            "run_id": uuid.uuid4().hex, "table_name": r.table, "started_at": datetime.fromtimestamp(started, UTC).isoformat(), "finished_at": datetime.now(UTC).isoformat(),
            "duration_ms": r.duration_ms, "mode": self.config.insert_type, "success": r.success, "rows": r.rows, "inserted": r.inserted, "updated": r.updated,
            "rejected": r.rejected, "rows_per_second": r.rows_per_second, "schema_changed": bool(r.warnings), "error_code": r.error_code, "error_message": r.error,
        }
        self.catalog.audit(run)
        self.config.log("stats", str(run))

    def _typed(self, u: Unit, config: LoadConfig) -> tuple[DataFrame, dict[str, Column]]:
        """The batch and the typed value of each of its columns."""
        if u.separators:
            config = config.with_(thousands_separator=u.separators[0], decimal_separator=u.separators[1])
        columns = [c for c in u.data.columns if c in u.header]
        return u.data, {c: store_value(quoted(c), u.data.schema[c].dataType, u.header[c].type or "varchar", u.header[c].length, u.header[c].decimal, config).cast(u.header[c].data_type) for c in columns}

    def _apply(self, units: list[Unit], config: LoadConfig, result: LoadResult, mark: tuple[str, int] | None) -> None:
        now = datetime.now(UTC).replace(tzinfo=None)
        run_time = F.lit(now).cast("timestamp_ntz")
        tables: dict[str, tuple[DataFrame | None, Header]] = {}
        appends: dict[str, tuple[DataFrame, Header]] = {}
        replaced: dict[str, set[str]] = {}
        refused: list[DataFrame] = []
        stage: list[DataFrame] = []
        for u in units:
            marked, typed, counts = self._staged(u, config, result)
            stage.append(marked)
            filled = {n: run_time for n, c in u.header.items() if c.calculated and n not in typed}
            bad = marked.filter(F.col("error_message").isNotNull())
            good = marked.filter(F.col("error_message").isNull()).drop("error_message", "_raw")
            if u is units[0]:
                result.rows = counts[0]
            keys = [k for k in u.header.primary_keys if k in typed]
            whole_key = keys == u.header.primary_keys
            target = None if u.current is None else project(self.store.read(u.table), u.current, u.header, u.changes.rename, filled)
            if keys and whole_key:
                if config.on_duplicate == "error" and not (again := merge.repeated_keys(good, keys)).isEmpty():
                    raise DuplicateKeyError(f"{u.table}: a key is in the batch more than once: {again.first().asDict()}")
                good = merge.last_by_key(good, keys, [F.col(ORDINAL)])
            bad_rows = [bad.select("error_message", "_raw.*")] if counts[1] else []
            good, clashes = self._without_conflicts(u, good, target, keys, config, result)
            if clashes is not None:
                bad_rows.append(clashes.select("error_message", *[quoted(c) for c in clashes.columns if c in u.header]))
            for rows in bad_rows:
                refused.append(rejects.reject_rows(rows, u.table, run_time))
            if bad_rows and not config.rejected_rows_table:
                example = bad_rows[0].first()
                raise RejectedRowsError(f"{u.table}: {example['error_message']}")
            staged = good.drop(ORDINAL)
            fixed = {n: (c.default if c.default is not None else None) for n, c in u.header.items() if n not in typed and not c.calculated and not c.auto_increment}
            if target is None:
                staged = staged.withColumns({n: F.lit(v).cast(u.header[n].data_type) for n, v in fixed.items()})
            staged = staged.withColumns({n: v.cast(u.header[n].data_type) for n, v in filled.items()})
            staged = self._numbered(u, staged, target)
            order = [c for c in u.header if c in staged.columns]
            staged = staged.select(*[quoted(c).cast(u.header[c].data_type).alias(c) for c in order])
            if target is None:
                tables[u.table] = (staged.select(*[quoted(c) for c in u.header]), u.header)
                if u is units[0]:
                    result.inserted = staged.count()
                continue
            if not (keys and whole_key):
                missing = [c for c in u.header if c not in staged.columns]
                appended = staged.withColumns({c: F.lit(None).cast(u.header[c].data_type) for c in missing}).select(*[quoted(c) for c in u.header])
                if u.header == u.current and config.insert_type == "UPDATE" and not u.header.primary_keys:
                    config.log("warn", f"{u.table}: no primary key, rows are appended")
                if u.header == u.current:
                    appends[u.table] = (appended, u.header)
                else:
                    tables[u.table] = (target.unionByName(appended), u.header)
                if u is units[0]:
                    result.inserted = staged.count()
                continue
            staged = materialize(staged, "batch")  # named by every step of a merge; one row a key takes a shuffle and a sort
            stage.append(staged)
            keep = [n for n, c in u.header.items() if c.calculated and not c.updated_calculated]
            insert_only = config.insert_type == "INSERT"
            shape = [[(n, c.data_type) for n, c in h.items()] for h in (u.current, u.header)]
            own = self.store.read(u.table) if shape[0] == shape[1] and not u.changes.rename else None  # single files can stay as they are
            if own is not None:
                hits, files = merge.matched(own, staged, keys)
            else:
                hits, files = staged.select(*[quoted(k) for k in keys]).join(target.select(*[quoted(k) for k in keys]), keys, "left_semi").count(), set()
            if u is units[0]:
                total = staged.count()
                result.inserted, result.updated = total - hits, 0 if insert_only else hits
            if insert_only and u is units[0] and hits:
                raise DuplicateKeyError(f"{u.table}: a key of the batch is in the table")
            if own is not None:  # only files that hold a key of the batch are read and written again
                target = project(self.store.read(u.table, files=files), u.current, u.header, u.changes.rename, filled)
                replaced[u.table] = files
            if config.add_history and (not config.history_tables or u.table in config.history_tables):
                compared = [c for c in u.header.updatable() if not u.header[c].calculated]
                self._history(u, merge.before_image(target, staged, keys, compared), run_time, tables, appends)
            tables[u.table] = (merge.upsert(target, staged, keys, keep, insert_only), u.header)
        if refused:
            name = config.rejected_rows_table
            rows = refused[0]
            for r in refused[1:]:
                rows = rows.unionByName(r)
            rows = materialize(rows, "rejects")
            result.rejected = rows.count()
            appends[name] = (rows, Header.from_struct(rows.schema))
        self.store.commit(tables, appends, mark, replaced)
        for marked in stage:
            remove(marked)

    def _staged(self, u: Unit, config: LoadConfig, result: LoadResult) -> tuple[DataFrame, dict[str, Column], tuple[int, int]]:
        """The batch with its typed values, the reason why a row is refused, and the counts of all rows and refused ones.

        Where refused rows have a table to go to, the columns they do not fit are
        widened first, round by round, up to ``max_retries`` rounds in all: their
        header is inferred, and what the table allows is taken over (R3, R4).
        """
        for left in reversed(range(config.max_retries)):
            df, typed = self._typed(u, config)
            own = "_typed"
            while any(c.startswith(own) for c in df.columns):
                own = f"_{own}"
            # Each step's columns are made once, however often the next names them; only refused rows need their raw form.
            made = {c: F.col(f"{own}{i}") for i, c in enumerate(typed)}
            reason = rejects.reason_of(df, made, Header({n: c for n, c in u.header.items() if n in typed}), dict(config.checks))
            rows = spread(df.withColumn(ORDINAL, F.monotonically_increasing_id()))
            rows = rows.withColumns({f"{own}{i}": v for i, v in enumerate(typed.values())}).withColumn(f"{own}_error", reason)
            refused, raw = F.col(f"{own}_error"), F.struct(*[quoted(c) for c in df.columns])
            marked = rows.select(ORDINAL, refused.alias("error_message"), *[v.alias(c) for c, v in made.items()], F.when(refused.isNotNull(), raw).alias("_raw"))
            with small_methods(self.spark):
                marked = materialize(marked, "staged")
            counts = tuple(marked.agg(F.count(F.lit(1)), F.count("error_message")).first())
            if not (left and counts[1] and config.rejected_rows_table) or config.safe_mode:
                break
            wider = self._widened(u, marked.filter(F.col("error_message").isNotNull()).select("_raw.*"), config)
            if wider == u.header:
                break
            result.warnings.append(f"{u.table}: widened for rows that did not fit: {', '.join(n for n in wider if wider[n] != u.header[n])}")
            u.header = wider
            remove(marked)
        return marked, typed, counts

    def _widened(self, u: Unit, refused: DataFrame, config: LoadConfig) -> Header:
        """The unit's header with types and sizes that hold the refused rows; keys, constraints and declared types stay."""
        if u.separators:
            config = config.with_(thousands_separator=u.separators[0], decimal_separator=u.separators[1])
        found, _, _ = infer_header(refused, config.with_(boolean_columns=(), sampling=0.0), voted=True)
        _, merged = compare(u.header, Header((n, c) for n, c in found.items() if n in u.header), config)
        wider = u.header.copy()
        for n in found:
            if n in wider and n not in config.boolean_columns:
                m = merged[n]
                wider.change(n, type=m.type, length=m.length, decimal=m.decimal, previous_type=m.previous_type)
        return wider

    def _numbered(self, u: Unit, staged: DataFrame, target: DataFrame | None) -> DataFrame:
        """Numbers for a surrogate column."""
        name = next((n for n, c in u.header.items() if c.auto_increment and n not in staged.columns), None)
        if name is None:
            return staged
        start = 1 if target is None else (target.agg(F.max(quoted(name))).first()[0] or 0) + 1
        return materialize(merge.number_new_rows(staged, name, start), "numbered")

    def _without_conflicts(self, u: Unit, good: DataFrame, target: DataFrame | None, keys: list[str], config: LoadConfig, result: LoadResult) -> tuple[DataFrame, DataFrame | None]:
        """Rows that break no unique column, and those that do."""
        unique = [g for g in u.header.unique_groups if all(c in good.columns for c in g)]
        if target is None or not keys or not unique:
            return good, None
        found = {r["unique_index"]: r["conflicts"] for r in merge.unique_conflicts(target, good, keys, unique).collect()}
        bad = [g for g in unique if found[",".join(g)]]
        if not bad:
            return good, None
        if config.drop_unique_constraints:
            for g in bad:
                for c in g:
                    u.header.change(c, unique=False, unique_name=None)
                result.warnings.append(f"{u.table}: {', '.join(g)} is no longer unique")
            return good, None
        if not config.rejected_rows_table:
            conflicts = ", ".join(f"{found[','.join(g)]} conflicts on {','.join(g)}" for g in bad)
            raise UniqueConflictError(f"{u.table}: {conflicts}")
        clashes = None
        for g in bad:
            rows = merge.conflicting_rows(target, good, keys, g).withColumn("error_message", F.lit(f"{','.join(g)}: value is in another row"))
            clashes = rows if clashes is None else clashes.unionByName(rows)
        clashes = materialize(clashes.dropDuplicates([ORDINAL]), "clashes")
        return good.join(clashes.select(ORDINAL), ORDINAL, "left_anti"), clashes

    def _history(self, u: Unit, rows: DataFrame, run_time: Column, tables: dict, appends: dict) -> None:
        """Before-images go to the history table, which takes the table's columns without its constraints."""
        name = history_name(u.table, self.config)
        plain = Header((n, c.with_(unique=False, index=False, auto_increment=False)) for n, c in u.header.items())
        header = Header({HISTORY_TIME: ColumnDef("datetime", primary=True), **plain})
        rows = rows.withColumn(HISTORY_TIME, run_time).select(*[quoted(c) for c in header])
        current = self.store.header(name)
        if current is None or current == header:
            appends[name] = (rows, header)
        else:
            tables[name] = (project(self.store.read(name), current, header).unionByName(rows), header)

    # Chunks and streams

    def load_chunks(self, table: str, chunks: Iterable[DataFrame | list[Mapping]], primary_key: Sequence[str] = (), **options: object) -> LoadResult:
        """Load chunks one after another: the first fixes keys and number layout, later ones may widen columns."""
        began = time.monotonic()
        total = LoadResult(True, table)
        pair: tuple[str, str] | None = None
        for i, df in enumerate(frames(self.spark, chunks)):
            more = dict(options)
            if i == 0:
                pair = dataset_separators(df, self.config.with_(**options))
            if pair:
                more |= {"thousands_separator": pair[0], "decimal_separator": pair[1]}
            r = self.load(table, df, primary_key if i == 0 else (), freeze_keys=i > 0, **more)
            total.rows += r.rows
            total.inserted += r.inserted
            total.updated += r.updated
            total.rejected += r.rejected
            total.warnings += r.warnings
            total.tables = r.tables or total.tables
            if not r.success:
                total.success, total.error, total.error_code = False, r.error, r.error_code
                break
        total.duration_ms = int((time.monotonic() - began) * 1000)
        return total

    def open_stream(self, table: str, primary_key: Sequence[str] = (), **options: object):
        from .streaming.session import StreamSession

        return StreamSession(self, table, primary_key, options)

    def read(self, table: str) -> DataFrame:
        return self.store.read(table)

    def drop_table(self, table: str) -> None:
        self.store.drop(table)


__all__ = ["Engine", "LoadConfig", "LoadError", "LoadResult", "TablePreview", "Unit"]
