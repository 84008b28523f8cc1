"""Location links: their JSON checked and normalised, links of query parameters, titles and points, the same place in other maps, what pages and URLs hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from masar.functions import text as X

STOP = "struct<point:struct<lat:string,lng:string>,query:string,label:string,placeId:string>"
RAW = f"kind string, navigate boolean, hintLabel string, point struct<lat:string,lng:string>, label string, address string, placeId string, zoom string, query string, near struct<lat:string,lng:string>, origin {STOP}, destination {STOP}, waypoints array<{STOP}>, profile string"
POINT = "struct<lat:double,lng:double>"
NORMAL_STOP = f"struct<point:{POINT},query:string,label:string,placeId:string>"
LINK = f"struct<kind:string,navigate:boolean,hintLabel:string,point:{POINT},label:string,address:string,placeId:string,zoom:double,query:string,near:{POINT},origin:{NORMAL_STOP},destination:{NORMAL_STOP},waypoints:array<{NORMAL_STOP}>,profile:string>"
MOST_LABEL, MOST_TEXT, MOST_STOPS = 120, 200, 25
PROFILES = {"drive": "driving", "walk": "walking", "bike": "cycling", "transit": "transit"}
TRAVEL = {"walking": "walking", "cycling": "bicycling", "transit": "transit"}
# Hosts that may be followed, ends of hosts, networks that are nobody's public address, and how pages write a point.
HOSTS = (
    "maps.app.goo.gl goo.gl g.page g.co maps.google.com www.google.com google.com consent.google.com maps.googleapis.com maps.apple maps.apple.com waze.com www.waze.com ul.waze.com waze.to osm.org www.openstreetmap.org openstreetmap.org omaps.app share.here.com wego.here.com mapy.cz mapy.com go.2gis.com 2gis.com petalmaps.com www.petalmaps.com plus.codes "
    "w3w.co what3words.com www.what3words.com yandex.ru yandex.com ya.ru osmand.net bit.ly t.co tinyurl.com fb.me lnkd.in cutt.ly rb.gy is.gd ow.ly buff.ly rebrand.ly s.id shorturl.at t.ly tiny.cc v.gd l.facebook.com lm.facebook.com l.instagram.com l.messenger.com"
).split()
SUFFIXES = (".google.com", ".google.com.eg", ".google.co.uk", ".google.ae", ".google.com.sa", ".waze.com", ".here.com", ".2gis.com", ".2gis.ae", ".yandex.ru", ".yandex.com")
PRIVATE_4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4")
PRIVATE_6 = r"(?i)^(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|::ffff:.*|64:ff9b::.*)$"
NUMBER = r"(-?\d{1,3}\.\d+)"
IN_PAGE = (rf"!3d{NUMBER}!4d{NUMBER}", None, rf"(?i)center={NUMBER}(?:%2C|,){NUMBER}", rf"@{NUMBER},{NUMBER},\d{{1,2}}(?:\.\d+)?z", rf'"lat(?:itude)?"\s*:\s*{NUMBER}\s*,\s*"l(?:ng|on|ongitude)"\s*:\s*{NUMBER}')
META = '(?i)<meta[^>]+(?:property|name)="(?:place:location:WHICH|og:WHICH)"[^>]+content="' + NUMBER + '"'


def valid_point(lat: Column, lng: Column) -> Column:
    """struct<lat, lng> of what can be read as a point of the earth; else null."""
    a, b = lat.try_cast("double"), lng.try_cast("double")
    return F.when(a.between(-90, 90) & b.between(-180, 180) & ~F.isnan(a) & ~F.isnan(b), F.struct(a.alias("lat"), b.alias("lng")))


def clean(text: Column, most: int) -> Column:
    """Without line breaks at the ends and inside, and without controls that break a layout; empty is null."""
    s = F.regexp_replace(F.trim(F.translate(text, "\r\n", "  ")), "[​-‏‪-‮⁠-⁤⁦-⁩﻿]", "")
    return F.substring(F.nullif(s, F.lit("")), 1, most)


def _stop(s: Column) -> Column:
    point, query, label, pid = valid_point(s["point"]["lat"], s["point"]["lng"]), clean(s["query"], MOST_TEXT), clean(s["label"], MOST_LABEL), clean(s["placeId"], 200)
    return F.when(F.coalesce(query, pid).isNotNull() | point.isNotNull(), F.struct(point.alias("point"), query.alias("query"), label.alias("label"), pid.alias("placeId")))


def _zoom(z: Column) -> Column:
    n = z.try_cast("double")
    return F.when((n > 0) & (n <= 24), n)


def _link(**parts: Column) -> Column:
    """A struct of LINK; what isn't given is null."""
    names = ("kind", "navigate", "hintLabel", "point", "label", "address", "placeId", "zoom", "query", "near", "origin", "destination", "waypoints", "profile")
    return F.struct(*(parts[n].alias(n) if n in parts else F.lit(None).alias(n) for n in names)).cast(LINK)


def normalised(link: Column) -> Column:
    """A link of LINK from its JSON; null where it isn't one that can be kept."""
    return X.let(F.from_json(link, RAW), _checked)


def _checked(d: Column) -> Column:
    point, pid, query = valid_point(d["point"]["lat"], d["point"]["lng"]), clean(d["placeId"], 200), clean(d["query"], MOST_TEXT)
    both = {"navigate": F.when(d["navigate"], True), "hintLabel": clean(d["hintLabel"], MOST_LABEL)}
    coordinate = F.when(point.isNotNull(), _link(kind=F.lit("coordinate"), point=point, zoom=_zoom(d["zoom"]), **both))
    place = F.when(point.isNotNull(), _link(kind=F.lit("place"), point=point, label=F.coalesce(clean(d["label"], MOST_LABEL), F.lit("")), address=clean(d["address"], MOST_TEXT), placeId=pid, **both))
    asked = F.when(F.coalesce(query, pid).isNotNull(), _link(kind=F.lit("query"), query=F.coalesce(query, F.lit("")), placeId=pid, near=valid_point(d["near"]["lat"], d["near"]["lng"]), **both))
    end, stops = _stop(d["destination"]), F.array_compact(F.transform(F.slice(d["waypoints"], 1, MOST_STOPS), _stop))
    route = F.when(end.isNotNull(), _link(kind=F.lit("route"), destination=end, origin=_stop(d["origin"]), waypoints=F.when(F.size(stops) > 0, stops), profile=F.when(d["profile"].isin(*PROFILES.values()), d["profile"]), **both))
    return F.when(d["kind"] == "coordinate", coordinate).when(d["kind"] == "place", place).when(d["kind"] == "query", asked).when(d["kind"] == "route", route)


def _pair(s: Column) -> Column:
    parts = F.split(s, ",")
    return F.when(F.size(parts) == 2, valid_point(F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))))


def from_parameters(q: Column) -> Column:
    """A link of LINK from a map of query parameters (names in lower case); null where they make none."""
    get = lambda *names: F.coalesce(*(F.nullif(F.try_element_at(q, F.lit(n)), F.lit("")) for n in names))

    def stop(value: Column, name: Column) -> Column:
        point = _pair(value)
        return F.when(value.isNotNull(), F.struct(point.alias("point"), F.when(point.isNull(), F.coalesce(clean(value, MOST_TEXT), F.lit(""))).alias("query"), clean(name, MOST_LABEL).alias("label"), F.lit(None).cast("string").alias("placeId")))

    kind, nav = get("kind"), F.when(get("nav").isin("1", "true", "yes"), True)
    end = get("d", "dest", "destination")
    via, names = F.filter(F.split(F.coalesce(get("w"), F.lit("")), r"\|"), lambda x: F.trim(x) != ""), F.split(F.coalesce(F.try_element_at(q, F.lit("wn")), F.lit("")), r"\|")
    stops = F.transform(F.slice(via, 1, MOST_STOPS), lambda x, i: stop(x, F.get(names, i)))
    mode = reduce(lambda rest, m: F.when(get("mode") == m, PROFILES[m]).otherwise(rest), PROFILES, F.lit(None).cast("string"))
    route = F.when(end.isNotNull(), _link(kind=F.lit("route"), destination=stop(end, get("dn")), origin=stop(get("o", "origin"), get("on")), waypoints=F.when(F.size(stops) > 0, stops), profile=mode, navigate=nav))
    text = clean(get("text", "q"), MOST_TEXT)
    query = F.when(F.coalesce(text, get("pid")).isNotNull(), _link(kind=F.lit("query"), query=F.coalesce(text, F.lit("")), placeId=get("pid"), near=_pair(get("near")), navigate=nav))
    point, name, address = F.coalesce(valid_point(get("lat"), get("lng")), _pair(get("ll"))), clean(get("name", "n"), MOST_LABEL), get("addr", "address")
    place = _link(kind=F.lit("place"), point=point, label=F.coalesce(name, F.lit("")), address=clean(address, MOST_TEXT), placeId=get("pid"), navigate=nav)
    spot = _link(kind=F.lit("coordinate"), point=point, zoom=_zoom(get("z")), navigate=nav)
    named = F.when(name.isNotNull(), _link(kind=F.lit("query"), query=name, navigate=nav))
    at = F.when(point.isNull(), named).when(F.coalesce(name, get("addr"), get("pid")).isNotNull(), place).otherwise(spot)
    has = lambda n: F.try_element_at(q, F.lit(n)).isNotNull()
    return F.when(F.coalesce(kind == "route", F.lit(False)) | has("d"), route).when(F.coalesce(kind == "q", F.lit(False)) | has("text"), query).otherwise(at)


def point_of(link: Column) -> Column:
    """What a link is about: its point, or a route's end."""
    return F.when(link["kind"].isin("coordinate", "place"), link["point"]).when(link["kind"] == "route", link["destination"]["point"])


def title_of(link: Column, lang: Column) -> Column:
    filled = lambda c: F.nullif(c, F.lit(""))
    by_kind = F.when(link["kind"] == "place", filled(link["label"])).when(link["kind"] == "query", filled(link["query"])).when(link["kind"] == "route", F.coalesce(filled(link["destination"]["label"]), filled(link["destination"]["query"]), F.when(lang == "ar", "مسار").otherwise("Route")))
    return F.coalesce(by_kind, filled(link["hintLabel"]), F.when(lang == "ar", "مكان اتبعتلك").otherwise("Shared location"))


def _ll(p: Column) -> Column:
    return F.concat(X.six_digits(p["lat"]), F.lit(","), X.six_digits(p["lng"]))


def _query(*pairs: tuple[str, Column]) -> Column:
    """Encoded parameters without those that are null."""
    return F.concat_ws("&", *(F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(v))) for k, v in pairs))


def other_maps(link: Column) -> Column:
    """struct<google, apple, waze>: the same place or route in other maps."""
    return X.let(link, _other_maps)


def _other_maps(link: Column) -> Column:
    route, at = link["kind"] == "route", _ll(point_of(link))
    words = F.coalesce(F.nullif(link["query"], F.lit("")), F.nullif(link["label"], F.lit("")), F.lit(""))
    start = _ll(link["origin"]["point"])
    stops = F.filter(link["waypoints"], lambda w: w["point"].isNotNull())
    via = F.when(F.size(stops) > 0, F.array_join(F.transform(stops, lambda w: _ll(w["point"])), "|"))
    mode = reduce(lambda rest, m: F.when(link["profile"] == m, TRAVEL[m]).otherwise(rest), TRAVEL, F.lit("driving"))
    found, one = point_of(link).isNotNull(), F.lit("1")
    drive = _query(("api", one), ("destination", at), ("travelmode", mode), ("origin", start), ("waypoints", via))
    google = F.when(found & route, F.concat(F.lit("https://www.google.com/maps/dir/?"), drive)).otherwise(F.concat(F.lit("https://www.google.com/maps/search/?"), _query(("api", one), ("query", F.when(found, at).otherwise(words)))))
    apple = F.when(found & route, _query(("daddr", at), ("dirflg", F.when(F.coalesce(link["profile"] == "walking", F.lit(False)), "w").otherwise("d")), ("saddr", start))).when(found, _query(("ll", at), ("q", F.nullif(link["label"], F.lit(""))))).otherwise(_query(("q", words)))
    waze = F.when(found, _query(("ll", at), ("navigate", F.lit("yes")))).otherwise(_query(("q", words), ("navigate", F.lit("yes"))))
    return F.struct(google.alias("google"), F.concat(F.lit("https://maps.apple.com/?"), apple).alias("apple"), F.concat(F.lit("https://waze.com/ul?"), waze).alias("waze"))


def _unescaped(text: Column) -> Column:
    """The five entities of HTML that titles hold, the ampersand last."""
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def from_page(html: Column) -> Column:
    """A place or coordinate that a page shows, by the first of five ways of writing one; null without any."""
    def by(pattern: str | None) -> Column:
        if pattern is None:
            return valid_point(F.regexp_extract(html, META.replace("WHICH", "latitude"), 1), F.regexp_extract(html, META.replace("WHICH", "longitude"), 1))
        return valid_point(F.regexp_extract(html, pattern, 1), F.regexp_extract(html, pattern, 2))

    point = F.coalesce(*map(by, IN_PAGE))
    written = F.coalesce(F.nullif(F.regexp_extract(html, '(?i)<meta[^>]+property="og:title"[^>]+content="([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(html, "(?i)<title[^>]*>([^<]{1,200})</title>", 1), F.lit("")))
    title = clean(F.trim(F.regexp_replace(F.trim(_unescaped(written)), r"\s*[-–|·]\s*Google Maps.*$", "")), MOST_LABEL)
    return F.when(point.isNotNull(), F.when(title.isNotNull(), _link(kind=F.lit("place"), point=point, label=title)).otherwise(_link(kind=F.lit("coordinate"), point=point)))


def continue_url(html: Column, base: Column) -> Column:
    """Where a consent page leads on to; null for other pages."""
    field, link = F.regexp_extract(html, r'name="continue"\s+value="([^"]+)"', 1), F.regexp_extract(html, r'href="(https://www\.google\.com/maps[^"]+)"', 1)
    target = F.replace(F.coalesce(F.nullif(field, F.lit("")), F.nullif(link, F.lit(""))), F.lit("&amp;"), F.lit("&"))
    return F.when(base.contains("consent.google") | html.contains('name="continue"'), target)


def url_error(url: Column) -> Column:
    """Why a URL mustn't be followed: scheme, host, credentials, host that isn't listed, port; null for one that may be."""
    u = F.trim(url)
    scheme, authority = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    address = F.regexp_replace(authority, "^.*@", "")
    host, port = F.lower(F.regexp_extract(address, r"^(\[[^\]]*\]|[^:]*)", 1)), F.regexp_extract(address, r":(\d*)$", 1)
    bare = F.regexp_replace(host, r"\.$", "")
    allowed = bare.isin(*HOSTS) | reduce(lambda a, b: a | b, (bare.endswith(s) for s in SUFFIXES))
    return F.when(~F.coalesce(scheme.isin("http", "https"), F.lit(False)), "scheme_not_allowed").when(host == "", "no_host").when(authority.contains("@"), "credentials_in_url").when(~allowed, "host_not_allowed").when(~port.isin("", "80", "443"), "port_not_allowed")


def is_public_ip(ip: Column) -> Column:
    """Whether an address is one of the public internet; what is no address isn't."""
    parts = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("long"))
    four = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda x: x <= 255)
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)

    def inside(net: str) -> Column:
        base, bits = net.split("/")
        low = sum(int(x) << 24 - 8 * k for k, x in enumerate(base.split(".")))
        return number.between(low, low + (1 << 32 - int(bits)) - 1)

    six = ip.contains(":") & ip.rlike(r"(?i)^[0-9a-f:.]+$") & ~ip.rlike(PRIVATE_6)
    return F.coalesce(F.when(four, ~reduce(lambda a, b: a | b, map(inside, PRIVATE_4))).otherwise(six), F.lit(False))


def new_id(length: int = 8) -> Column:
    """A random id of letters and digits."""
    return F.randstr(F.lit(length))


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)
