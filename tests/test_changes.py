from pyspark.sql import functions as F

from rillstone.operators.changes import applied, captured, invalidated

BEFORE = "id int, owner string, day int, x double, locked boolean"


def tables(spark):
    before = spark.createDataFrame([(1, "a", 10, 1.0, False), (2, "a", 11, None, True), (3, "b", 12, 3.0, False), (None, "b", 13, 4.0, None)], BEFORE)
    sent = [
        (1, "a", 10, 1.0, False, 1, "upsert"), (2, "a", 99, 5.0, False, 1, "upsert"), (3, "b", 12, 3.0, False, 2, "delete"), (3, "b", 12, 8.0, False, 1, "upsert"),
        (None, "b", 14, 4.0, None, 1, "upsert"), (9, "c", 20, 9.0, False, 1, "upsert"), (9, "c", 21, 9.5, False, 1, "upsert"), (7, "c", 1, 1.0, False, 1, "delete"),
    ]
    return before, spark.createDataFrame(sent, BEFORE + ", sent int, op string")


def test_changes_and_the_table_they_lead_to(spark):
    before, incoming = tables(spark)
    values = ["owner", "day", "x", "locked"]
    changes = captured(before, incoming, ["id"], values, "sent", ["day", "locked"], "locked")
    got = {r["id"]: (r["change"], r["before"] and r["before"]["day"], r["after"] and (r["after"]["day"], r["after"]["x"])) for r in changes.collect()}
    # 1 is equal; 2 keeps its locked day; 3 is deleted by its later row; a tie (9) is settled by the columns.
    assert got == {2: ("update", 11, (11, 5.0)), 3: ("delete", 12, None), None: ("update", 13, (14, 4.0)), 9: ("insert", None, (21, 9.5))}
    table = before.withColumn("version", F.lit(4)).withColumn("updated_at", F.lit(0))
    after = {r["id"]: (r["day"], r["version"], r["updated_at"]) for r in applied(table, changes, ["id"], values, F.lit(1)).collect()}
    assert after == {1: (10, 4, 0), 2: (11, 5, 1), None: (14, 5, 1), 9: (21, 1, 1)}
    days = invalidated(changes.withColumn("owner", F.coalesce("after.owner", "before.owner")), "owner", "day", "k")
    assert sorted((r["owner"], r["day"]) for r in days.collect()) == [("a", 11), ("b", 12), ("b", 13), ("b", 14), ("c", 21)]


def test_nothing_comes_in(spark):
    before, incoming = tables(spark)
    changes = captured(before, incoming.limit(0), ["id"], ["owner", "day", "x", "locked"], "sent")
    assert changes.count() == 0
    assert captured(before.limit(0), incoming, ["id"], ["owner", "day", "x", "locked"], "sent").groupBy("change").count().collect() == [("insert", 4)]
