"""Platforms: where the tables of a case are. All of them are read into a Spark session, and statements run there."""

from __future__ import annotations

import os
import re
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from assayer.sources import databases
from assayer.sources.engine import Engine


@dataclass(frozen=True)
class Platform:
    """A name and what it takes to reach it, without secrets. Building one needs no driver and opens nothing."""

    name: str
    kind: str
    options: tuple[tuple[str, str], ...] = ()
    tables: tuple[str, ...] = ()  # none: all that can be listed

    def option(self, key: str, default: str | None = None) -> str | None:
        return dict(self.options).get(key, default)


def _platform(name: str, kind: str, tables: tuple[str, ...] = (), **options: str | None) -> Platform:
    return Platform(name, kind, tuple((k, v) for k, v in options.items() if v is not None), tuple(tables))


def spark_platform(name: str, catalog: str | None = None, schema: str | None = None) -> Platform:
    """Tables of a Spark catalog, a lakehouse's too."""
    return _platform(name, "spark", catalog=catalog, schema=schema)


def parquet_platform(name: str, path: str, tables: tuple[str, ...]) -> Platform:
    """`<path>/<table>.parquet`."""
    return _platform(name, "parquet", tables, path=path)


def sqlite_platform(name: str, path: str) -> Platform:
    return _platform(name, "sqlite", path=path)


def duckdb_platform(name: str, path: str) -> Platform:
    return _platform(name, "duckdb", path=path)


def postgres_platform(name: str, conninfo: str = "", tables: tuple[str, ...] = ()) -> Platform:
    """`conninfo`: key=value pairs or a postgresql:// URI. The password comes from PGPASSWORD. Needs the JDBC driver on Spark's class path."""
    return _platform(name, "postgres", tables, conninfo=conninfo)


def snowflake_platform(name: str, account: str, tables: tuple[str, ...], user: str | None = None, warehouse: str | None = None, role: str | None = None, database: str | None = None, schema: str | None = None, authenticator: str | None = None) -> Platform:
    """Needs the Spark connector on the class path."""
    return _platform(name, "snowflake", tables, sfURL=f"{account}.snowflakecomputing.com", sfUser=user, sfWarehouse=warehouse, sfRole=role, sfDatabase=database, sfSchema=schema, sfAuthenticator=authenticator)


def bigquery_platform(name: str, project: str, tables: tuple[str, ...], dataset: str | None = None) -> Platform:
    """Needs the Spark connector on the class path."""
    return _platform(name, "bigquery", tables, parentProject=project, project=project, dataset=dataset)


class PlatformUnavailable(RuntimeError):
    """The platform can't be reached: a driver or connector is not there, or the connection fails."""


def jdbc_options(conninfo: str) -> dict[str, str]:
    """JDBC address, user and password of a PostgreSQL conninfo."""
    if m := re.match(r"postgres(?:ql)?://(?:([^:@/]+)(?::([^@/]*))?@)?([^/?]*)/?([^?]*)", conninfo):
        user, password, address, database = m.groups()
        host, _, port = address.partition(":")
        parts = {"user": user, "password": password, "host": host, "port": port, "dbname": database}
    else:
        parts = dict(p.split("=", 1) for p in conninfo.split())
    get = lambda key, env, default: parts.get(key) or os.environ.get(env) or default
    user = get("user", "PGUSER", "postgres")
    url = f"jdbc:postgresql://{get('host', 'PGHOST', 'localhost')}:{get('port', 'PGPORT', '5432')}/{get('dbname', 'PGDATABASE', user)}"
    out = {"url": url, "user": user, "driver": "org.postgresql.Driver"}
    return out | ({"password": password} if (password := get("password", "PGPASSWORD", "")) else {})


def connect(spark: SparkSession, platform: Platform) -> Engine:
    """An engine over the platform's tables, in a session of its own; PlatformUnavailable if they can't be reached."""
    own = spark.newSession()
    try:
        _open(own, platform)
    except Exception as e:
        raise PlatformUnavailable(f"{platform.name}: {str(e).splitlines()[0] if str(e) else type(e).__name__}") from e
    return Engine(own)


def _open(own: SparkSession, p: Platform) -> None:
    path = p.option("path")
    match p.kind:
        case "spark":
            if catalog := p.option("catalog"):
                own.catalog.setCurrentCatalog(catalog)
            if schema := p.option("schema"):
                own.catalog.setCurrentDatabase(schema)
            return
        case "parquet":
            frames = {t: own.read.parquet(f"{path}/{t}.parquet") for t in p.tables}
        case "sqlite" | "duckdb":
            databases.register(own)
            names = p.tables or tuple((databases.sqlite_tables if p.kind == "sqlite" else databases.duckdb_tables)(path))
            frames = {t: own.read.format(p.kind).options(path=path, table=t).load() for t in names}
        case "postgres":
            options = jdbc_options(p.option("conninfo", ""))
            load = lambda **more: own.read.format("jdbc").options(**options, **more).load()
            listed = "SELECT table_name FROM information_schema.tables WHERE table_schema = current_schema()"
            frames = {t: load(dbtable=t) for t in p.tables or [r[0] for r in load(query=listed).collect()]}
        case "snowflake" | "bigquery":
            key = {"snowflake": "dbtable", "bigquery": "table"}[p.kind]
            frames = {t: own.read.format({"snowflake": "net.snowflake.spark.snowflake", "bigquery": "bigquery"}[p.kind]).options(**dict(p.options), **{key: t}).load() for t in p.tables}
        case _:
            raise ValueError(f"no platform of kind {p.kind}")
    for name, df in frames.items():
        df.createOrReplaceTempView("`" + name.replace("`", "``") + "`")


#: How many sessions of a kind are open at once, and how long one is waited for.
SIZES, OTHERS, WAIT = {"duckdb": 8, "sqlite": 1}, 4, 30.0


class Pool:
    """At most `size` engines at a time, each in a session of its own, for cases that run side by side.

    An engine is asked for a value before it is lent again; one that does not answer, or is older than `max_age` seconds, is
    replaced. After `close` nothing is lent, and engines that are out go when they come back.
    """

    def __init__(self, open_: Callable[[], Engine], size: int = OTHERS, wait: float = WAIT, max_age: float | None = None):
        self.open, self.size, self.wait, self.max_age = open_, size, wait, max_age
        self._idle: list[tuple[Engine, float]] = []
        self._out: dict[int, tuple[Engine, float]] = {}
        self._opening, self._closed = 0, False
        self._changed = threading.Condition()

    def acquire(self) -> Engine:
        with self._changed:
            if not self._changed.wait_for(lambda: self._closed or self._idle or len(self._out) + self._opening < self.size, self.wait):
                raise PlatformUnavailable(f"no session came free in {self.wait:g} s")
            if self._closed:
                raise PlatformUnavailable("the pool is closed")
            kept = self._idle.pop() if self._idle else None
            self._opening += 1
        try:
            if kept and not (self.max_age is not None and time.monotonic() - kept[1] > self.max_age) and kept[0].healthy():
                engine = kept
            else:
                if kept:
                    _forget(kept[0])
                engine = self.open(), time.monotonic()
        except BaseException:
            with self._changed:
                self._opening -= 1
                self._changed.notify()
            raise
        with self._changed:
            self._opening -= 1
            self._out[id(engine[0])] = engine
        return engine[0]

    def release(self, engine: Engine) -> None:
        with self._changed:
            found = self._out.pop(id(engine), None)
            if found is None:
                raise ValueError("this engine is not lent by the pool")
            if not self._closed:
                self._idle.append(found)
            self._changed.notify()
        if self._closed:
            _forget(engine)

    @contextmanager
    def lease(self) -> Iterator[Engine]:
        engine = self.acquire()
        try:
            yield engine
        finally:
            self.release(engine)

    def close(self) -> None:
        with self._changed:
            self._closed, idle, self._idle = True, self._idle, []
            self._changed.notify_all()
        for engine, _ in idle:
            _forget(engine)


def _forget(engine: Engine) -> None:
    """Drop the session's views; a session that is gone has none."""
    try:
        for t in engine.spark.catalog.listTables():
            if t.isTemporary:
                engine.spark.catalog.dropTempView(t.name)
    except Exception:  # noqa: S110
        pass


class Registry:
    """One engine, and one pool of them, for each platform name. A name that stands for two configurations is refused."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._open: dict[str, tuple[Platform, Engine]] = {}
        self._pools: dict[str, tuple[Platform, Pool]] = {}
        self._lock = threading.Lock()

    def _only(self, platform: Platform) -> None:
        for known in (self._open, self._pools):
            if known.get(platform.name, (platform,))[0] != platform:
                raise ValueError(f"platform {platform.name} has another configuration already")

    def pool(self, platform: Platform) -> Pool:
        """For cases that run side by side; `engine` is apart from it and never waits."""
        with self._lock:
            self._only(platform)
            if platform.name not in self._pools:
                self._pools[platform.name] = platform, Pool(lambda: connect(self.spark, platform), SIZES.get(platform.kind, OTHERS))
            return self._pools[platform.name][1]

    def engine(self, platform: Platform) -> Engine:
        with self._lock:
            self._only(platform)
            if platform.name not in self._open:
                self._open[platform.name] = platform, connect(self.spark, platform)
            return self._open[platform.name][1]

    def close_all(self) -> None:
        with self._lock:
            for _, engine in self._open.values():
                _forget(engine)
            for _, pool in self._pools.values():
                pool.close()
            self._open.clear()
            self._pools.clear()


class ProfileError(ValueError):
    """kind: profile_not_found or unsupported_adapter."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def read_yaml(path: Path):
    try:
        import yaml
    except ImportError as e:
        raise ProfileError("profile_not_found", "reading YAML needs the yaml module") from e
    try:
        return yaml.safe_load(path.read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError) as e:
        raise ProfileError("profile_not_found", f"{path} can't be read: {e}") from e


def platform_from_profile(project_dir: str | Path, profiles_dir: str | Path | None = None, target: str | None = None) -> Platform:
    """The platform that a transformation project runs on: its `dbt_project.yml` names a profile, and `profiles.yml` (beside it, or
    in `profiles_dir`) the profile's outputs. DuckDB paths are relative to the project; passwords stay where they are."""

    def part(of, key, what: str) -> dict:
        found = of.get(key) if isinstance(of, dict) and isinstance(key, str) else None
        if not isinstance(found, dict):
            raise ProfileError("profile_not_found", f"no {what}")
        return found

    project = read_yaml(Path(project_dir) / "dbt_project.yml")
    name = project.get("profile") if isinstance(project, dict) else None
    if not isinstance(name, str):
        raise ProfileError("profile_not_found", "the project names no profile")
    profile = part(read_yaml(Path(profiles_dir or project_dir) / "profiles.yml"), name, f"profile {name}")
    chosen = target or profile.get("target")
    output = part(part(profile, "outputs", f"outputs in profile {name}"), chosen, f"target {chosen} in profile {name}")
    named = f"dbt:{name}:{chosen}"
    match output.get("type"):
        case "duckdb":
            return duckdb_platform(named, str(Path(project_dir) / output.get("path", ":memory:")) if output.get("path", ":memory:") != ":memory:" else ":memory:")
        case "postgres":
            return postgres_platform(named, " ".join(f"{k}={output[k]}" for k in ("host", "port", "dbname", "user") if output.get(k) is not None))
        case other:
            raise ProfileError("unsupported_adapter", f"no platform for adapter {other}")
