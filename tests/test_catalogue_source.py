"""The element data source over landed answers and over HTTP (a server on this machine), and the landing table."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from elsetspark.sources import catalogue_source, landing

DAY = 86_400_000_000
T0 = 1_704_067_200_000_000  # 2024-01-01


def record(norad_id, day, **more):
    at = f"2024-01-{day:02d}T06:00:00.250000"
    base = {"NORAD_CAT_ID": norad_id, "EPOCH": at, "MEAN_MOTION": 15.5, "ECCENTRICITY": 0.001, "INCLINATION": 66, "RA_OF_ASC_NODE": day, "ARG_OF_PERICENTER": 90, "MEAN_ANOMALY": 1, "BSTAR": 0, "MEAN_MOTION_DOT": 0, "MEAN_MOTION_DDOT": 0}
    return base | more


def t_of(day):
    return T0 + (day - 1) * DAY + 6 * 3_600_000_000 + 250_000


@pytest.fixture
def landed(tmp_path):
    for norad_id in (5, 7, 9):
        folder = tmp_path / f"norad_id={norad_id}"
        folder.mkdir()
        (folder / "part-0.txt").write_text(json.dumps([record(norad_id, d) for d in range(1, 21)]) + "\n")
    return str(tmp_path)


def test_filters_reach_the_request_and_the_plan(spark, landed):
    found = catalogue_source.read(spark, path=landed).where(F.col("norad_id").isin(5, 9, 77) & (F.col("t") >= T0 + 3 * DAY) & (F.col("t") < T0 + 6 * DAY))
    rows = found.collect()
    assert sorted((r["norad_id"], r["t"]) for r in rows) == [(i, t_of(d)) for i in (5, 9) for d in (4, 5, 6)]
    assert {r["request"] for r in rows} == {f"/basicspacedata/query/class/gp_history/NORAD_CAT_ID/{i}/EPOCH/2024-01-04 00:00:00--2024-01-07 00:00:00/orderby/EPOCH asc/format/json" for i in (5, 9)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and " IN (" not in plan and "t#" in plan.split("Filter")[1]  # objects are the source's, times are compared again
    one = catalogue_source.read(spark, path=landed).where(f"norad_id = 7 and t > {t_of(18)}").collect()
    assert [r["t"] for r in one] == [t_of(19), t_of(20)] and "/EPOCH/>2024-01-18 05:59:59/" in one[0]["request"]
    assert catalogue_source.read(spark, path=landed).where(f"t > {t_of(9)} and t < {t_of(3)}").count() == 0
    assert catalogue_source.read(spark, path=landed).where("norad_id = 5 and norad_id = 7").count() == 0


def test_all_landed_objects_without_filters(spark, landed):
    found = catalogue_source.read(spark, path=landed)
    assert found.count() == 60 and found.select("norad_id").distinct().count() == 3
    typed = catalogue_source.elsets(found.where("norad_id = 5")).collect()
    assert len(typed) == 20 and typed[0]["mean_motion"] == 15.5 and not typed[0]["stale"] and typed[0]["fetched_at"] > T0
    current = catalogue_source.read(spark, "celestrak", path=landed).where(f"norad_id = 5 and t >= {t_of(20)}").collect()
    assert [r["request"] for r in current] == ["/NORAD/elements/gp.php?CATNR=5&FORMAT=json"]


def test_sources_by_name_and_malformed_answers(spark, landed, tmp_path):
    with pytest.raises(ValueError, match="celestrak"):
        catalogue_source.catalogue("nowhere")
    for bad in ("{}", "[1]", '[{"EPOCH": 3}]', "[cut"):
        (tmp_path / "norad_id=5" / "part-0.txt").write_text(bad)
        with pytest.raises(Exception, match="array of records|Expecting"):
            catalogue_source.read(spark, path=landed).where("norad_id = 5").collect()
    with pytest.raises(Exception, match="need their objects"):
        catalogue_source.read(spark).collect()


class Server(BaseHTTPRequestHandler):
    seen: list = []
    sessions, down = 0, False

    def log_message(self, *_):
        pass

    def do_POST(self):
        form = self.rfile.read(int(self.headers["Content-Length"])).decode()
        Server.seen.append("login")
        self.send_response(200)
        if "password=right" in form:
            Server.sessions += 1
            self.send_header("Set-Cookie", f"chocolatechip=s{Server.sessions}; Path=/")
        self.end_headers()

    def do_GET(self):
        Server.seen.append(unquote(self.path))
        if Server.down:
            self.send_response(503)
            self.end_headers()
        elif f"chocolatechip=s{max(2, Server.sessions)}" not in self.headers.get("Cookie", ""):  # the first session has run out
            self.send_response(401)
            self.end_headers()
        else:
            self.send_response(200)
            self.end_headers()
            norad_id = int(self.path.split("NORAD_CAT_ID/")[1].split("/")[0])
            self.wfile.write(json.dumps([record(norad_id, d) for d in (1, 2, 3)]).encode())


@pytest.fixture
def server(monkeypatch):
    Server.seen, Server.sessions, Server.down = [], 0, False
    s = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    monkeypatch.setenv("no_proxy", "127.0.0.1")
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def over_http(server, *objects):
    """What a lane's task does, in this process, where the credentials of the test are."""
    reader = catalogue_source.ElementReader({"source": "spacetrack", "url": server, "interval": "0", "objects": ",".join(map(str, objects))})
    (lane,) = reader.partitions()
    return list(reader.read(lane))


def test_http_login_is_reused_and_renewed(server, monkeypatch):
    monkeypatch.setenv("SPACETRACK_USERNAME", "me")
    monkeypatch.setenv("SPACETRACK_PASSWORD", "right")
    rows = over_http(server, 5, 7, 5)
    assert [(r[0], r[1]) for r in rows] == [(i, t_of(d)) for i in (5, 7) for d in (1, 2, 3)]
    ask = "/basicspacedata/query/class/gp_history/NORAD_CAT_ID/{}/orderby/EPOCH asc/format/json".format
    assert Server.seen == ["login", ask(5), "login", ask(5), ask(7)]


def test_http_refusals_and_outage(server, monkeypatch, landed):
    monkeypatch.delenv("SPACETRACK_USERNAME", raising=False)
    with pytest.raises(PermissionError, match="must be set"):
        over_http(server, 5)
    monkeypatch.setenv("SPACETRACK_USERNAME", "me")
    monkeypatch.setenv("SPACETRACK_PASSWORD", "wrong")
    with pytest.raises(PermissionError, match="refused"):
        over_http(server, 5)
    monkeypatch.setenv("SPACETRACK_PASSWORD", "right")
    Server.down = True
    with pytest.raises(ConnectionError, match="cannot be reached for object 5"):
        over_http(server, 5)
    reader = catalogue_source.ElementReader({"url": server, "interval": "0", "objects": "5", "fallback": landed})
    rows = list(reader.read(reader.partitions()[0]))
    assert len(rows) == 20 and all(r[5] for r in rows)


def test_requests_of_a_lane_keep_their_distance(server, monkeypatch):
    pauses = []
    monkeypatch.setenv("SPACETRACK_USERNAME", "me")
    monkeypatch.setenv("SPACETRACK_PASSWORD", "right")
    monkeypatch.setattr(catalogue_source.time, "sleep", pauses.append)
    reader = catalogue_source.ElementReader({"url": server, "interval": "50", "objects": "5,7,9"})
    list(reader.read(reader.partitions()[0]))
    assert len(reader.partitions()) == 1 and sum(p > 45 for p in pauses) == 3  # 5 twice (the session had run out), 7, 9


# Landing table

KINDS = "source string, norad_id long, fetched_at long, payload string"
NOW = T0 + DAY


@pytest.fixture(scope="module")
def snapshots(spark):
    hour = 3_600_000_000
    rows = [
        ("celestrak", 1, NOW - hour, "[1]"), ("celestrak", 1, NOW - 9 * hour, "[0]"), ("celestrak", 1, NOW + hour, "[2]"), ("celestrak", 2, NOW - 3 * hour, "[5]"), ("spacetrack", 2, NOW - 3 * hour, "[6]"),
        ("celestrak", 3, NOW - hour, "[cut"), ("celestrak", 3, NOW - 5 * hour, "[3]"), ("celestrak", 4, NOW - hour, "{}"), ("celestrak", 4, NOW - hour, None), ("celestrak", 5, NOW - 7_200_000_000, "[]"), ("other", 1, NOW, "[]"),
    ]
    return spark.createDataFrame(rows, KINDS)


def test_landing_as_of_a_time(snapshots):
    got = {(r["source"], r["norad_id"]): (r["payload"], r["age_s"], r["fresh"], r["n_corrupt"]) for r in landing.as_of(snapshots, NOW).collect()}
    assert got == {
        ("celestrak", 1): ("[1]", 3600, True, 0), ("celestrak", 2): ("[5]", 10800, False, 0), ("spacetrack", 2): ("[6]", 10800, True, 0), ("celestrak", 3): ("[3]", 18000, False, 1),
        ("celestrak", 4): (None, None, False, 2), ("celestrak", 5): ("[]", 7200, True, 0), ("other", 1): ("[]", 0, False, 0),
    }
    assert {(r["norad_id"], r["since"]) for r in landing.wanted(snapshots, snapshots.select("source", "norad_id").where("source = 'celestrak'"), NOW).collect()} == {(2, NOW - 10_800_000_000), (3, NOW - 18_000_000_000), (4, None)}


def test_landing_serves_fresh_new_unchanged_stale_and_nothing(spark, snapshots, tmp_path):
    asked = spark.createDataFrame([("celestrak", i) for i in (1, 2, 3, 4, 6, 6)], "source string, norad_id long")
    answers = spark.createDataFrame([("celestrak", 1, 200, "[9]"), ("celestrak", 2, 304, None), ("celestrak", 3, 200, "[cut"), ("celestrak", 4, 304, None), ("celestrak", 6, 200, "[7]")], "source string, norad_id long, status int, payload string")
    shown = landing.served(snapshots, asked, answers, NOW)
    got = {r["norad_id"]: (r["payload"], r["fetched_at"] == NOW, r["stale"], r["state"]) for r in shown.collect()}
    assert got == {1: ("[1]", False, False, "cached"), 2: ("[5]", True, False, "unchanged"), 3: ("[3]", False, True, "stale"), 4: (None, False, False, "unreachable"), 6: ("[7]", True, False, "fetched")}
    path = str(tmp_path / "landing")
    landing.land(snapshots, path)
    landing.land(landing.after(shown), path)
    landing.land(landing.after(shown), path)  # a repeated run changes nothing
    again = {(r["source"], r["norad_id"]): (r["payload"], r["fresh"]) for r in landing.as_of(spark.read.schema(KINDS).parquet(path), NOW).collect()}
    assert again["celestrak", 2] == ("[5]", True) and again["celestrak", 6] == ("[7]", True) and again["celestrak", 3] == ("[3]", False)


# Packs of answers


def pack_files(path):
    return [x for x in path.rglob("*") if x.is_file() and x.suffix == ".parquet"]


def test_packs_hold_many_objects_and_are_read_like_folders(spark, tmp_path):
    bodies = {i: json.dumps([record(i, d) for d in range(1, 21)], indent=1) for i in range(1, 301)}  # answers of several lines
    path = tmp_path / "landed"
    catalogue_source.land(spark.createDataFrame(list(bodies.items()), "norad_id long, value string").repartition(3, "norad_id"), str(path))
    assert len(pack_files(path)) == 3 and not list(path.glob("norad_id=*"))
    found = catalogue_source.read(spark, path=str(path))
    assert found.count() == 6000 and found.select("norad_id").distinct().count() == 300
    some = found.where(F.col("norad_id").isin(5, 300, 777) & (F.col("t") >= T0 + 3 * DAY) & (F.col("t") < T0 + 5 * DAY)).collect()
    assert sorted((r["norad_id"], r["t"]) for r in some) == [(i, t_of(d)) for i in (5, 300) for d in (4, 5)]
    assert {r["request"] for r in some} == {f"/basicspacedata/query/class/gp_history/NORAD_CAT_ID/{i}/EPOCH/2024-01-04 00:00:00--2024-01-06 00:00:00/orderby/EPOCH asc/format/json" for i in (5, 300)}
    assert all(r["fetched_at"] > T0 and not r["stale"] for r in some)
    assert catalogue_source.read(spark, path=str(path)).where("norad_id = 5 and norad_id = 7").count() == 0
    assert len(catalogue_source.elsets(found.where("norad_id = 9")).collect()) == 20


def test_packs_add_to_folders_and_serve_an_outage(spark, landed, tmp_path):
    more = spark.createDataFrame([(5, json.dumps([record(5, 25)])), (8, json.dumps([record(8, 26)]))], "norad_id long, value string")
    catalogue_source.land(more, landed)
    catalogue_source.land(more.where("norad_id = 8"), landed)  # what was landed twice comes twice
    rows = catalogue_source.read(spark, path=landed).collect()
    assert sorted((r["norad_id"], r["t"]) for r in rows if r["t"] > t_of(20)) == [(5, t_of(25)), (8, t_of(26)), (8, t_of(26))] and len(rows) == 63
    assert [r["t"] for r in catalogue_source.read(spark, path=landed).where("norad_id = 8").collect()] == [t_of(26)] * 2
    reader = catalogue_source.ElementReader({"source": "celestrak", "url": "http://127.0.0.1:9", "interval": "0", "objects": "5,8", "fallback": landed})
    kept = list(reader.read(reader.partitions()[0]))
    assert sorted(r[0] for r in kept) == [5] * 21 + [8] * 2 and all(r[5] for r in kept)


def test_packs_with_malformed_answers_raise(spark, tmp_path):
    for k, bad in enumerate((None, "{}", "[cut", '[{"EPOCH": 3}]')):
        path = str(tmp_path / str(k))
        catalogue_source.land(spark.createDataFrame([(5, bad), (6, "[]")], "norad_id long, value string"), path)
        assert catalogue_source.read(spark, path=path).where("norad_id = 6").count() == 0
        with pytest.raises(Exception, match="array of records|Expecting"):
            catalogue_source.read(spark, path=path).collect()


def test_reading_a_pack_skips_groups_without_the_objects(spark, tmp_path):
    from pyarrow import Table, parquet

    parquet.write_table(Table.from_pydict({"norad_id": [1, 2, 3, 7, 8, 9], "value": ["[]", "[]", "[]", "[7]", "[8]", "[9]"]}), tmp_path / "a.parquet", row_group_size=2)
    at = catalogue_source.Landed(str(tmp_path))
    assert [x[:2] for x in at.packed(at.packs(), {2, 8})] == [(2, "[]"), (8, "[8]")]
    assert [x[0] for x in at.packed(at.packs(), None)] == [1, 2, 3, 7, 8, 9] and not list(at.packed(at.packs(), {4, 5}))


def test_catalogue_query_lands_no_file_an_object(spark, tmp_path, monkeypatch):
    from elsetspark.plans import QUERIES, queries

    monkeypatch.setattr(queries.ordered, "shared_folder", lambda _: str(tmp_path / "answers"))
    rows = QUERIES["src_catalogue"](spark, "/root/testdata/sf0.01")
    assert rows.select("norad_id").distinct().count() == 150 and rows.count() == 1660
    assert 1 <= len(pack_files(tmp_path)) <= 8 and len([x for x in (tmp_path / "answers").iterdir() if x.is_dir()]) == 0
