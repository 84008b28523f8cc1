"""Shared links and live trips as logs of requests: what each is answered, and what is stored after all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from masar.functions import links as L

#: A request: op is mint, get or revoke; live trips: start, progress, end or view.
REQUEST = "seq long, op string, id string, token string, body string, ttl_seconds long, at timestamp"


def links_served(requests: DataFrame) -> DataFrame:
    """(seq, status, state): 201 or 422 for a mint, 200, 404 or 410 for a get, 200, 403 or 404 for a revoke; the state is why a link is gone.

    The first good mint of an id holds; a link is revoked by the first request with its token and expires ``ttl_seconds`` after it was made (0: never).
    """
    good = requests.filter("op = 'mint'").filter(L.normalised(F.col("body")).isNotNull())
    made = good.groupBy(F.col("id").alias("mid")).agg(F.min_by(F.struct("seq", L.token_hash(F.col("token")).alias("hash"), "at", "ttl_seconds"), "seq").alias("m"))
    rows = requests.join(made, F.col("id") == F.col("mid"), "left")
    there = F.col("m").isNotNull() & (F.col("m.seq") < F.col("seq"))
    own = L.token_hash(F.col("token")) == F.col("m.hash")
    revoking = (F.col("op") == "revoke") & there & own
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("revoked", F.coalesce(F.max(F.coalesce(revoking, F.lit(False))).over(before), F.lit(False)))
    ends = F.col("m.at") + F.make_dt_interval(secs=F.col("m.ttl_seconds").cast("decimal(18,6)"))
    expired = (F.col("m.ttl_seconds") > 0) & (F.col("at") > ends)
    state = F.when(~F.coalesce(there, F.lit(False)), None).when(F.col("revoked"), "revoked").when(expired, "expired").otherwise("live")
    get = F.when(state.isNull(), 404).when(state == "live", 200).otherwise(410)
    status = F.when(F.col("op") == "mint", F.when(L.normalised(F.col("body")).isNotNull(), 201).otherwise(422)).when(F.col("op") == "get", get).when(F.col("op") == "revoke", F.when(state.isNull(), 404).when(own, 200).otherwise(403))
    return rows.select("seq", status.alias("status"), F.when(F.col("op") == "get", state).alias("state"))


def live_trips(requests: DataFrame) -> DataFrame:
    """(id, label, lat, lng, eta_seconds, ended): each trip after all requests; only those with its token count, and none after its end.

    body: JSON of label on a start, lat, lng and eta_seconds on progress.
    """
    body = F.from_json("body", "label string, lat double, lng double, eta_seconds int")
    rows = requests.withColumn("b", body)
    made = rows.filter("op = 'start'").groupBy(F.col("id").alias("sid")).agg(F.min_by(F.struct("seq", L.token_hash(F.col("token")).alias("hash"), F.col("b.label").alias("label"), "at", "ttl_seconds"), "seq").alias("m"))
    ends = F.col("m.at") + F.make_dt_interval(secs=F.col("m.ttl_seconds").cast("decimal(18,6)"))
    own = rows.filter("op in ('progress', 'end')").join(made, F.col("id") == F.col("sid")).filter((F.col("seq") > F.col("m.seq")) & (L.token_hash(F.col("token")) == F.col("m.hash")) & (F.col("at") <= ends))
    stop = own.filter("op = 'end'").groupBy(F.col("id").alias("eid")).agg(F.min("seq").alias("end"))
    last = own.filter("op = 'progress'").join(stop, F.col("id") == F.col("eid"), "left").filter("end is null or seq < end").groupBy(F.col("id").alias("pid")).agg(F.max_by("b", "seq").alias("p"))
    return made.join(last, F.col("sid") == F.col("pid"), "left").join(stop, F.col("sid") == F.col("eid"), "left").select(F.col("sid").alias("id"), "m.label", "p.lat", "p.lng", "p.eta_seconds", F.col("end").isNotNull().alias("ended"))
