"""Top-N reports keep their N rows for every tenant."""

from pyspark.sql import functions as F

from tallyspark.operators.ledger import spend_by_session
from tallyspark.operators.pricing import derive_rate_card
from tallyspark.testbed.tables import Testbed


def test_every_tenant_keeps_its_dearest_sessions(spark):
    requests = Testbed(spark, "/root/testdata/sf0.001").request.withColumn("tenant", F.pmod(F.xxhash64("session_id"), F.lit(2)))
    card = derive_rate_card(requests, ["tenant"])
    kept = spend_by_session(requests, card, ["tenant"], top=3).groupBy("tenant").count().collect()
    assert sorted(r["count"] for r in kept) == [3, 3]
