"""Queries of a search service's derivations, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import canonical, service
from skyloom.plans.canonical import RECORDS, records
from skyloom.plans.catalogue import query


@query(f"""WITH {RECORDS}, s AS (SELECT *, upper(category) AS type FROM r) SELECT id, type, country, name FROM s ORDER BY type, country, city, iata, name, id LIMIT 50""")
def listed_by_type(db):
    """The first fifty in order of type, then country, city, code and name."""
    return service.ordered(canonical.features_of(records(db)), "type").select("id", "type", "country", "name").limit(50)


@query(f"""WITH {RECORDS}, d AS (SELECT *, row_number() OVER (PARTITION BY iata ORDER BY name, id) AS k FROM r WHERE lat IS NOT NULL AND iata <> 'ASI') SELECT iata AS airport_code,
  string_agg('- ' || name || ' (' || upper(category) || ') in ' || terminal || '; key facilities: ' || CASE WHEN len(amenities) > 0 THEN array_to_string(amenities[1:4], ', ') ELSE 'not listed' END, chr(10) ORDER BY k) AS text FROM d WHERE k <= 10 GROUP BY iata""")
def prompt_facts(db):
    """What a prompt may say of each airport but one: ten records, four facilities each."""
    return service.prompt_lines(canonical.search_documents(records(db)), F.col("airport_code") != "ASI")


@query("""WITH f AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'A' || c_custkey // 6 ELSE 'B' || c_custkey END AS code, printf('%.5f:%.5f', c_nationkey / 3.0::DOUBLE, (c_custkey % 7)::DOUBLE) AS spot, c_name AS name FROM customer), n AS (SELECT code, count(*) AS n FROM f GROUP BY 1)
SELECT a.id AS chosen, b.id, b.name FROM f a JOIN n USING (code) JOIN f b ON CASE WHEN n > 1 THEN a.code = b.code ELSE a.spot = b.spot END WHERE a.id % 20 = 0 OR a.id % 20 = 7""")
def same_spot_list(db):
    """Records of the same airport, or of the same coordinates where it is alone, for some chosen ones against all."""
    key = F.col("c_custkey")
    features = db.customer.select(key.alias("id"), F.when(key % 2 == 0, F.concat(F.lit("A"), F.floor(key / 6).cast("string"))).otherwise(F.concat(F.lit("B"), key.cast("string"))).alias("airport_code"), (F.col("c_nationkey") / F.lit(3.0)).alias("lat"), (key % 7).cast("double").alias("lon"), F.col("c_name").alias("name"))
    return service.same_spot(features, features.where("id % 20 = 0 OR id % 20 = 7"))


@query("""SELECT event_id, sha256(CASE event_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN '10.0.0.' || user_id ELSE '::' || user_id END || '|' || CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE substr(repeat(event_type || ' ', 40), 1, 160) END) AS key FROM events""")
def client_keys(db):
    """Keys of clients by the first of their addresses and the start of their agents."""
    user = F.col("user_id").cast("string")
    address = F.when(F.col("event_id") % 4 == 0, F.lit(None)).when(F.col("event_id") % 4 == 1, F.concat(F.lit(" 10.0.0."), user, F.lit(" , 10.1.1.1"))).otherwise(F.concat(F.lit("::"), user))
    agent = F.when(F.col("event_id") % 3 != 0, F.repeat(F.concat("event_type", F.lit(" ")), 40))
    return db.events.select("event_id", service.client_key(address, agent).alias("key"))
