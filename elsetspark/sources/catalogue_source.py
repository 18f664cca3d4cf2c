"""Element catalogues as a Spark data source: one request an object, with the bounds of the epoch in the request.

    register(spark)
    history = spark.read.format("elements").option("source", "spacetrack").option("path", landed).load()
    history.where("norad_id in (25544, 8820) and t >= 1704067200000000")

`norad_id =` and `in` choose the objects asked for, comparisons of t with a number bound each request
as the catalogue's own predicate, and Spark still applies them to the rows (a request has whole
seconds). Rows: norad_id, t (µs, UTC), record (the message as JSON; `elsets` types it), request,
fetched_at, stale.

Transports. `path` reads landed answers: packs (Parquet files of norad_id and value, an answer a row; `land`
writes them, as many as it has tasks whatever the number of objects), folders `norad_id=<id>` with JSON
arrays, one a line, or both. They also hold the objects' list. Without `path` requests go to `url`
(the catalogue's own by default) over HTTP: a login where the catalogue wants one, kept as a cookie and
repeated once when it has run out, and at least `interval` seconds between requests of a lane. Requests over HTTP share one lane unless
`lanes` says otherwise, so that the pause holds for the whole cluster. `fallback` names landed answers that
are served, marked stale, when the catalogue cannot be reached.

Defined cases: an object without an answer has no rows (landed) or raises (HTTP, without fallback); an
answer that is no JSON array of records with an epoch raises; contradictory filters ask for nothing; a source
without history gets no epoch in its request; an object asked for twice is asked once.
"""

from __future__ import annotations

import http.cookiejar
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from bisect import bisect_left
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import omm

SCHEMA = "norad_id long, t long, record string, request string, fetched_at long, stale boolean"
EPOCH_ZERO = datetime(1970, 1, 1, tzinfo=UTC)
MOST_LANES = 64
PACK_ROWS = 16  # answers of a pack in memory at a time
#: Row groups of packs stay small, also where a few answers are large.
PACK_OPTIONS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


class Catalogue(NamedTuple):
    """Fixed values of a catalogue: where it is, whether it holds history and wants a login, pause between requests, seconds an answer stays fresh."""

    url: str
    history: bool
    login: str | None
    cookie: str | None
    interval: float
    ttl: int


CATALOGUES = {
    "spacetrack": Catalogue("https://www.space-track.org", True, "/ajaxauth/login", "chocolatechip", 13.0, 86_400),
    "celestrak": Catalogue("https://celestrak.org", False, None, None, 1.0, 7_200),
}
DEFAULT = "spacetrack"


def catalogue(name: str) -> Catalogue:
    if name not in CATALOGUES:
        raise ValueError(f"unknown source {name!r}; available sources: {sorted(CATALOGUES)}")
    return CATALOGUES[name]


def bounds_text(lo: int | None, hi: int | None) -> str:
    """Bounds in µs as the catalogue writes them, outwards to whole seconds."""
    text = lambda t: (EPOCH_ZERO + timedelta(seconds=t)).strftime("%Y-%m-%d %H:%M:%S")
    low, high = None if lo is None else text(lo // 1_000_000), None if hi is None else text(-(-hi // 1_000_000))
    return f"{low}--{high}" if low and high else f">{low}" if low else f"<{high}" if high else ""


def request_of(name: str, norad_id: int, lo: int | None, hi: int | None) -> str:
    if not catalogue(name).history:
        return f"/NORAD/elements/gp.php?CATNR={norad_id}&FORMAT=json"
    # A bound without the other is exclusive in the catalogue: one second further holds the bound itself.
    lo, hi = (lo - 1_000_000 if lo is not None and hi is None else lo), (hi + 1_000_000 if hi is not None and lo is None else hi)
    epoch = bounds_text(lo, hi)
    parts = [f"NORAD_CAT_ID/{norad_id}", *([f"EPOCH/{epoch}"] if epoch else []), "orderby/EPOCH asc"]
    return f"/basicspacedata/query/class/gp_history/{'/'.join(parts)}/format/json"


class Landed:
    """Answers in packs and in the folders of objects."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(path.replace("s3a://", "s3://").replace("file:///", "/").replace("file:/", "/"))
        self.selector = fs.FileSelector

    def objects(self) -> list[int]:
        found = self.files.get_file_info(self.selector(self.root))
        return sorted(int(x.base_name.partition("=")[2]) for x in found if x.base_name.startswith("norad_id="))

    def answer(self, norad_id: int, request: str) -> list[tuple[str, int]]:
        """(body, time it was landed) of an object; a record that is in several answers comes from each."""
        found = self.files.get_file_info(self.selector(f"{self.root}/norad_id={norad_id}", allow_not_found=True))
        out = []
        for x in sorted((x for x in found if x.is_file and x.base_name[0] not in "._"), key=lambda x: x.path):
            with self.files.open_input_stream(x.path) as file:
                out += [(line, x.mtime_ns // 1000) for line in file.read().decode().splitlines() if line.strip()]
        return out

    def packs(self) -> list[tuple[str, int]]:
        """(path, time it was landed) of each pack."""
        found = self.files.get_file_info(self.selector(self.root, allow_not_found=True))
        return sorted((x.path, x.mtime_ns // 1000) for x in found if x.is_file and x.extension == "parquet" and x.base_name[0] not in "._")

    def packed(self, packs: list[tuple[str, int]], objects: set[int] | None) -> Iterator[tuple[int, str, int]]:
        """(object, body, time it was landed) of the answers in packs; row groups beside the wanted objects are not read."""
        from pyarrow import parquet

        wanted = None if objects is None else sorted(objects)
        for path, landed_at in packs:
            with self.files.open_input_file(path) as file:
                pack = parquet.ParquetFile(file)
                key, groups = pack.schema_arrow.names.index("norad_id"), []
                for g in range(pack.num_row_groups):
                    seen = pack.metadata.row_group(g).column(key).statistics
                    if wanted is None or seen is None or not seen.has_min_max or bisect_left(wanted, seen.min) < bisect_left(wanted, seen.max + 1):
                        groups.append(g)
                for batch in pack.iter_batches(PACK_ROWS, groups, ["norad_id", "value"]) if groups else ():
                    for norad_id, body in zip(batch["norad_id"].to_pylist(), batch["value"].to_pylist(), strict=True):
                        if objects is None or norad_id in objects:
                            yield norad_id, body, landed_at


class Http:
    """Answers of a catalogue over HTTP, one after the other."""

    def __init__(self, name: str, url: str | None, interval: float | None, timeout: float = 60.0):
        self.about, self.last = catalogue(name), 0.0
        self.url, self.interval, self.timeout = url or self.about.url, self.about.interval if interval is None else interval, timeout
        self.cookies = http.cookiejar.CookieJar()
        self.opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(self.cookies))

    def logged_in(self) -> bool:
        return self.about.cookie is None or any(c.name == self.about.cookie for c in self.cookies)

    def log_in(self) -> None:
        name, word = os.environ.get("SPACETRACK_USERNAME"), os.environ.get("SPACETRACK_PASSWORD")
        if not name or not word:
            raise PermissionError("SPACETRACK_USERNAME and SPACETRACK_PASSWORD must be set for requests to this catalogue")
        form = urllib.parse.urlencode({"identity": name, "password": word}).encode()
        self.opener.open(self.url + self.about.login, form, self.timeout).close()
        if not self.logged_in():  # a refused login answers 200 as well
            raise PermissionError("the catalogue refused the login")

    def send(self, request: str) -> str:
        time.sleep(max(0.0, self.last + self.interval - time.monotonic()))
        self.last = time.monotonic()
        with self.opener.open(self.url + urllib.parse.quote(request, safe="/?=&%"), timeout=self.timeout) as response:
            return response.read().decode()

    def answer(self, norad_id: int, request: str) -> list[tuple[str, int]]:
        if not self.logged_in():
            self.log_in()
        try:
            body = self.send(request)
        except urllib.error.HTTPError as error:
            if error.code not in (401, 403) or self.about.cookie is None:
                raise
            self.cookies.clear()  # the session has run out
            self.log_in()
            body = self.send(request)
        return [(body, time.time_ns() // 1000)]


def epoch_of(record: dict) -> int:
    """µs of a record's epoch (UTC)."""
    at = datetime.fromisoformat(record["EPOCH"].strip().replace("Z", ""))
    return (at.replace(tzinfo=UTC) - EPOCH_ZERO) // timedelta(microseconds=1)


def records(body: str | None, norad_id: int) -> list[dict]:
    found = None if body is None else json.loads(body)
    if not isinstance(found, list) or not all(isinstance(x, dict) and isinstance(x.get("EPOCH"), str) for x in found):
        raise ValueError(f"the answer for object {norad_id} is not an array of records with an epoch")
    return found


class Lane(InputPartition):
    def __init__(self, objects: list[int], packs: list[tuple[str, int]] = ()):
        self.objects, self.packs = objects, packs


class ElementReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.name = options.get("source", DEFAULT)
        self.about, self.path, self.fallback, self.url = catalogue(self.name), options.get("path"), options.get("fallback"), options.get("url")
        self.interval = float(options["interval"]) if "interval" in options else None
        self.lanes = int(options.get("lanes", MOST_LANES if self.path else 1))
        named = options.get("objects")
        self.objects = None if named is None else {int(x) for x in named.split(",") if x.strip()}
        self.lo: int | None = None
        self.hi: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("norad_id",) and isinstance(f, EqualTo | In):
                asked = set(value if isinstance(f, In) else [value]) - {None}
                self.objects = asked if self.objects is None else self.objects & asked
                continue
            if column == ("t",) and isinstance(value, int) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.lo = value if self.lo is None else max(self.lo, value)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.hi = value if self.hi is None else min(self.hi, value)
            yield f  # requests have whole seconds: Spark compares the rows

    def partitions(self) -> list[Lane]:
        if self.lo is not None and self.hi is not None and self.lo > self.hi:
            return [Lane([])]
        if self.objects is None and not self.path:
            raise ValueError("requests need their objects: filter by norad_id, or give the option objects")
        landed = Landed(self.path) if self.path else None
        objects = sorted(self.objects) if self.objects is not None else landed.objects()
        packs = landed.packs() if landed and (self.objects is None or self.objects) else []
        lanes = max(1, min(self.lanes, max(len(objects), len(packs))))
        return [Lane(objects[i::lanes], packs[i::lanes]) for i in range(lanes)]

    def rows(self, norad_id: int, body: str | None, request: str, fetched_at: int, stale: bool) -> Iterator[tuple]:
        for x in records(body, norad_id):
            t = epoch_of(x)
            if (self.lo is None or t >= self.lo) and (self.hi is None or t <= self.hi):
                yield norad_id, t, json.dumps(x), request, fetched_at, stale

    def read(self, lane: Lane) -> Iterator[tuple]:
        transport = Landed(self.path) if self.path else Http(self.name, self.url, self.interval)
        for norad_id in lane.objects:
            request, stale = request_of(self.name, norad_id, self.lo, self.hi), False
            try:
                answers = transport.answer(norad_id, request)
            except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
                answers = self.fallen_back(norad_id, request) if self.fallback else []
                if not answers:
                    raise ConnectionError(f"{self.name} cannot be reached for object {norad_id}: {error}") from error
                stale = True
            for body, fetched_at in answers:
                yield from self.rows(norad_id, body, request, fetched_at, stale)
        if lane.packs:
            for norad_id, body, fetched_at in transport.packed(lane.packs, self.objects):
                yield from self.rows(norad_id, body, request_of(self.name, norad_id, self.lo, self.hi), fetched_at, False)

    def fallen_back(self, norad_id: int, request: str) -> list[tuple[str, int]]:
        landed = Landed(self.fallback)
        return landed.answer(norad_id, request) + [x[1:] for x in landed.packed(landed.packs(), {norad_id})]


class Elements(DataSource):
    @classmethod
    def name(cls) -> str:
        return "elements"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ElementReader:  # noqa: ANN001
        return ElementReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format `elements` known to the session, and lets Spark offer filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Elements)


def land(answers: DataFrame, path: str) -> None:
    """Adds answers (norad_id, value: JSON arrays) to path as packs, each sorted by object."""
    answers.select(F.col("norad_id").cast("long").alias("norad_id"), "value").sortWithinPartitions("norad_id").write.mode("append").options(**PACK_OPTIONS).parquet(path)


def read(spark: SparkSession, source: str = DEFAULT, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("elements").options(source=source, **options).load()


def elsets(found: DataFrame) -> DataFrame:
    """Typed elsets of the source's rows, with request, fetched_at and stale. A malformed record raises."""
    fields = F.from_json("record", f"struct<{', '.join(f'{k}:STRING' for k in (*omm.REQUIRED, *omm.DEFAULTS))}>")
    rows = found.select(fields.alias("x"), "request", "fetched_at", "stale")
    return omm.parsed(rows.select("x.*", "request", "fetched_at", "stale"), ["request", "fetched_at", "stale"])
