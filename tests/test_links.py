"""Links: what is kept, refused, read from parameters, pages and URLs, and the life of a stored one."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from masar.functions import links as L
from masar.operators import linkstore as S


def rows(spark, values, f):
    d = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["x"] for r in d.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_links_that_are_kept_and_refused(spark):
    bad = [{"kind": "place", "point": {"lat": 95, "lng": 31}}, {"kind": "coordinate", "point": {"lat": "x", "lng": 31}}, {"kind": "live", "id": "x"}, {"kind": "route", "destination": {}}, {"kind": "query"}]
    assert rows(spark, [*map(json.dumps, bad), '"nope"', "{", None], L.normalised) == [None] * 8
    place, query, route, spot = rows(spark, [json.dumps(x) for x in (
        {"kind": "place", "point": {"lat": 30.044412345678, "lng": 31.235767891234}, "label": "‏كافيه‎", "address": "  x\ny  "}, {"kind": "query", "placeId": "abc", "near": {"lat": 30, "lng": 31}, "hintLabel": "h" * 500},
        {"kind": "route", "destination": {"point": {"lat": 29.9792, "lng": 31.1342}, "label": "Pyramids"}, "waypoints": [{}, {"query": "Giza"}], "profile": "flying", "navigate": True}, {"kind": "coordinate", "point": {"lat": 30, "lng": 31}, "zoom": 99},
    )], L.normalised)
    assert tuple(place["point"]) == (30.044412345678, 31.235767891234) and place["label"] == "كافيه" and place["address"] == "x y"
    assert query["query"] == "" and query["placeId"] == "abc" and tuple(query["near"]) == (30, 31) and len(query["hintLabel"]) == 120
    assert route["destination"]["label"] == "Pyramids" and [w["query"] for w in route["waypoints"]] == ["Giza"] and route["profile"] is None and route["navigate"]
    assert spot["zoom"] is None and spot["kind"] == "coordinate"


GO = [
    ({"lat": "30.0444", "lng": "31.2357", "name": "Cafe"}, "place"), ({"lat": "30.0444", "lng": "31.2357", "z": "16"}, "coordinate"), ({"kind": "route", "d": "29.9792,31.1342", "dn": "Pyramids", "o": "30.0444,31.2357", "w": "30.01,31.2|30.02,31.21", "mode": "walk", "nav": "1"}, "route"),
    ({"text": "Cairo Tower"}, "query"), ({"lat": "999", "lng": "1"}, None), ({}, None), ({"name": "only a name"}, "query"), ({"ll": "30,31"}, "coordinate"), ({"d": "the pyramids"}, "route"),
]


def test_parameters(spark):
    d = spark.createDataFrame([(k, q) for k, (q, _) in enumerate(GO)], "k int, q map<string,string>")
    got = [r["x"] for r in d.select("k", L.from_parameters(F.col("q")).alias("x")).orderBy("k").collect()]
    assert [x and x["kind"] for x in got] == [k for _, k in GO]
    route = got[2]
    assert route["profile"] == "walking" and len(route["waypoints"]) == 2 and route["navigate"] and tuple(route["origin"]["point"]) == (30.0444, 31.2357)
    assert got[1]["zoom"] == 16.0 and got[8]["destination"]["query"] == "the pyramids"


def test_titles_and_other_maps(spark):
    links = [{"kind": "place", "point": {"lat": 30.0444, "lng": 31.2357}, "label": "Cafe"}, {"kind": "route", "destination": {"point": {"lat": 29.9792, "lng": 31.1342}}, "origin": {"point": {"lat": 30, "lng": 31}}, "profile": "walking"}, {"kind": "query", "query": "Cairo Tower"}]
    got = rows(spark, [json.dumps(x) for x in links], lambda v: F.struct(L.title_of(L.normalised(v), F.lit("en")).alias("t"), L.other_maps(L.normalised(v)).alias("m")))
    assert [r["t"] for r in got] == ["Cafe", "Route", "Cairo Tower"]
    assert got[0]["m"]["google"] == "https://www.google.com/maps/search/?api=1&query=30.0444%2C31.2357" and got[0]["m"]["apple"] == "https://maps.apple.com/?ll=30.0444%2C31.2357&q=Cafe" and got[0]["m"]["waze"] == "https://waze.com/ul?ll=30.0444%2C31.2357&navigate=yes"
    assert got[1]["m"]["google"] == "https://www.google.com/maps/dir/?api=1&destination=29.9792%2C31.1342&travelmode=walking&origin=30%2C31" and "dirflg=w" in got[1]["m"]["apple"]
    assert got[2]["m"]["waze"] == "https://waze.com/ul?q=Cairo+Tower&navigate=yes"


def test_pages(spark):
    page = '<meta property="og:title" content="Cafe &amp; Co - Google Maps"><meta property="og:image" content="https://maps.google.com/maps/api/staticmap?center=30.1%2C31.2&zoom=15">data=!3d30.0459!4d31.2243'
    a, b, c, d, e = rows(spark, [page, '<meta property="og:image" content="x?center=30.1%2C31.2&z=1">', "<html>nothing here</html>", '<title>Home</title>{"latitude": 30.5, "longitude": 31.5}', "x" * 200_000 + "@30.25,31.75,15z"], L.from_page)
    assert tuple(a["point"]) == (30.0459, 31.2243) and a["label"] == "Cafe & Co"
    assert tuple(b["point"]) == (30.1, 31.2) and b["kind"] == "coordinate" and c is None and d["label"] == "Home" and tuple(e["point"]) == (30.25, 31.75)
    consent = rows(spark, ['<input name="continue" value="https://www.google.com/maps?q=1&amp;x=2">', "<p>plain</p>"], lambda v: L.continue_url(v, F.lit("https://consent.google.com/x")))
    assert consent == ["https://www.google.com/maps?q=1&x=2", None]


def test_urls_and_addresses(spark):
    urls = {"https://maps.app.goo.gl/AbC": None, "javascript:alert(1)": "scheme_not_allowed", "https:///x": "no_host", "https://u:p@google.com/": "credentials_in_url", "https://evil.com": "host_not_allowed", "http://google.com.:8080/": "port_not_allowed", "HTTPS://Maps.Google.com.eg:443/x#y": None, "https://notgoogle.com/": "host_not_allowed"}
    assert dict(zip(urls, rows(spark, list(urls), L.url_error), strict=True)) == urls
    ips = {"8.8.8.8": True, "10.1.2.3": False, "172.31.0.1": False, "172.32.0.1": True, "100.64.0.1": False, "127.0.0.1": False, "999.1.1.1": False, "x": False, "::1": False, "fe80::1": False, "2001:4860::8888": True, "fd00::1": False, "255.255.255.255": False}
    assert dict(zip(ips, rows(spark, list(ips), L.is_public_ip), strict=True)) == ips


T = datetime(2026, 1, 1)
OK = json.dumps({"kind": "query", "query": "x"})


@pytest.mark.parametrize("parts", [1, 3])
def test_the_life_of_a_link(spark, parts):
    log = [("mint", "a", "t1", OK, 3600, 0), ("get", "a", None, None, None, 10), ("revoke", "a", "wrong", None, None, 20), ("get", "a", None, None, None, 30), ("revoke", "a", "t1", None, None, 40), ("get", "a", None, None, None, 50), ("mint", "b", "t2", '{"kind":"place"}', 0, 60), ("get", "b", None, None, None, 70), ("mint", "c", "t3", OK, 60, 80), ("get", "c", None, None, None, 140), ("get", "c", None, None, None, 141), ("get", "none", None, None, None, 150), ("revoke", "none", "t", None, None, 160), ("mint", "d", "t4", OK, 0, 170), ("get", "d", None, None, None, 10**8)]
    want = [201, 200, 403, 200, 200, 410, 422, 404, 201, 200, 410, 404, 404, 201, 200]
    d = spark.createDataFrame([(k, op, i, tok, body, ttl, T + timedelta(seconds=s)) for k, (op, i, tok, body, ttl, s) in enumerate(log)], S.REQUEST).repartition(parts)
    got = S.links_served(d).orderBy("seq").collect()
    assert [r["status"] for r in got] == want and got[5]["state"] == "revoked" and got[10]["state"] == "expired"


def test_live_trips(spark):
    p = lambda **x: json.dumps(x)
    log = [("start", "l", "t", p(label="Ahmed"), 1800, 0), ("progress", "l", "bad", p(lat=1, lng=1), None, 5), ("progress", "l", "t", p(lat=30.05, lng=31.24, eta_seconds=600), None, 10), ("progress", "l", "t", p(lat=30.06, lng=31.25, eta_seconds=500), None, 20), ("end", "l", "t", None, None, 30), ("progress", "l", "t", p(lat=9, lng=9), None, 40), ("start", "m", "u", p(label="B"), 60, 0), ("progress", "m", "u", p(lat=2, lng=2, eta_seconds=1), None, 61)]
    d = spark.createDataFrame([(k, op, i, tok, body, ttl, T + timedelta(seconds=s)) for k, (op, i, tok, body, ttl, s) in enumerate(log)], S.REQUEST)
    assert sorted(map(tuple, S.live_trips(d).collect())) == [("l", "Ahmed", 30.06, 31.25, 500, True), ("m", "B", None, None, None, False)]


def test_ids(spark):
    ids = [r["x"] for r in spark.range(500).select(L.new_id(8).alias("x")).collect()]
    assert len(set(ids)) == 500 and all(len(i) == 8 and i.isalnum() and i.isascii() for i in ids)
