"""Keyed tables: whole versions, touched buckets, replays; leads across batches."""

from __future__ import annotations

import pytest
from helpers import at, events
from pyspark.sql import functions as F

from trailmark.operators import identity, leads
from trailmark.session import clear_folders, shared_folder
from trailmark.sources.keyed import Keyed, KeyedStore, keyed_writer

COUNTS = Keyed("who string, n bigint", ["who"], 4)


def summed(rows):
    return rows.groupBy("who").agg(F.sum("n").alias("n"))


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "store"), {"counts": COUNTS, "other": COUNTS})


def counts(spark, *rows):
    return spark.createDataFrame(list(rows), "who string, n bigint")


def test_versions_are_whole_and_replays_change_nothing(spark, store):
    assert store.read("counts").count() == 0 and store.version().number == 0
    assert store.upsert({"counts": (counts(spark, ("a", 1), ("b", 2)), summed)}, "w", 0)
    first = store.version()
    assert store.upsert({"counts": (counts(spark, ("a", 5), (None, 7)), summed), "other": (counts(spark, ("x", 1)), summed)}, "w", 1)
    assert not store.upsert({"counts": (counts(spark, ("a", 5)), summed)}, "w", 1)
    assert not store.upsert({"counts": (counts(spark, ("a", 5)), summed)}, "w", 0)
    assert sorted(map(tuple, store.read("counts").collect()), key=repr) == [("a", 6), ("b", 2), (None, 7)]
    assert sorted(map(tuple, store.read("counts", version=first).collect())) == [("a", 1), ("b", 2)]  # a reader keeps its version
    assert store.upsert({"counts": (counts(spark, ("b", 1)), summed)}, "another writer", 0)
    assert dict(map(tuple, store.read("counts").collect()))["b"] == 3


def test_only_touched_buckets_are_rewritten(spark, store):
    many = counts(spark, *((f"k{n}", n) for n in range(50)))
    store.upsert({"counts": (many, summed)}, "w", 0)
    before = store.version()
    change = counts(spark, ("k7", 1))
    touched = store.buckets_of("counts", change)
    store.upsert({"counts": (change, summed)}, "w", 1)
    after = store.version()
    assert len(touched) == 1 and {k for k in after.folders if after.folders[k] != before.folders[k]} == {("counts", touched[0])}
    gone = counts(spark, *((f"k{n}", 0) for n in range(50)))
    store.upsert({"counts": (gone, lambda rows: summed(rows).where("n > 40"))}, "w", 2)
    assert sorted(r.n for r in store.read("counts").collect()) == list(range(41, 50))
    store.upsert({"counts": (gone.limit(0), summed)}, "w", 3)
    assert store.version().number == 4 and store.read("counts").count() == 9


def test_a_failed_batch_leaves_the_version(spark, store):
    store.upsert({"counts": (counts(spark, ("a", 1)), summed)}, "w", 0)
    broken = lambda rows: rows.select("who", F.raise_error(F.lit("no")).cast("bigint").alias("n"))
    with pytest.raises(Exception):
        store.upsert({"counts": (counts(spark, ("a", 1)), summed), "other": (counts(spark, ("a", 1)), broken)}, "w", 1)
    assert store.version().batches == {"w": 0} and [tuple(r) for r in store.read("counts").collect()] == [("a", 1)]
    assert store.upsert({"counts": (counts(spark, ("a", 1)), summed)}, "w", 1)
    assert [tuple(r) for r in store.read("counts").collect()] == [("a", 2)]


def identifies(spark, *rows):
    """(seconds, visitor, e-mail, phone) with fingerprints that are the values themselves."""
    return spark.createDataFrame(
        [(int(t), 1, 1, who, at(t), email, phone) for t, who, email, phone in rows],
        "id bigint, tenant_id bigint, workspace_id bigint, anonymous_id string, timestamp timestamp, email_fingerprint string, phone_fingerprint string")


def lead_rows(store):
    return {r.lead_key: (r.phone_fingerprint, r.identifies) for r in store.read("leads").collect()}


def test_a_phone_finds_the_lead_of_an_earlier_batch(spark, tmp_path):
    store = leads.lead_store(spark, str(tmp_path / "leads"), 4)
    batches = [identifies(spark, (1, "a_1", "x@", "5"), (2, "a_2", "y@", None), (3, "a_9", None, "8")),
               identifies(spark, (10, "a_3", None, "5"), (11, "a_4", None, "8"), (12, "a_5", None, None)),
               identifies(spark, (20, "a_1", "x@", "6"), (21, "a_6", None, "5"), (22, "a_7", None, "6"), (23, "a_2", "y@", "5"))]
    for number, batch in enumerate(batches):
        assert leads.upsert_leads(store, batch, number)
        assert not leads.upsert_leads(store, batch, number)
    assert lead_rows(store) == {"e:x@": ("6", 4), "e:y@": ("5", 3), "p:8": ("8", 2), "n:12": (None, 1)}
    links = {(r.anonymous_id, r.lead_key) for r in store.read("links").collect()}
    assert {("a_3", "e:x@"), ("a_6", "e:y@"), ("a_7", "e:x@"), ("a_4", "p:8")} <= links
    assert {(r.phone_fingerprint, r.email_fingerprint) for r in store.read("holders").collect()} == {("6", "x@"), ("5", "y@")}


def test_of_two_holders_the_first_is_found(spark, tmp_path):
    store = leads.lead_store(spark, str(tmp_path / "leads"), 2)
    leads.upsert_leads(store, identifies(spark, (50, "a_1", "late@", "5")), 0)
    leads.upsert_leads(store, identifies(spark, (60, "a_2", "early@", "5"), (5, "a_2", "early@", None), (70, "a_3", None, "5")), 1)
    assert lead_rows(store)["e:early@"] == ("5", 3)
    leads.upsert_leads(store, identifies(spark, (1, "a_1", "late@", None), (80, "a_4", None, "5")), 2)
    assert lead_rows(store) == {"e:early@": ("5", 3), "e:late@": ("5", 3)}


def test_batches_give_what_one_batch_gives_without_phone_only_rows(spark, tmp_path):
    rows = [(t * 7 % 100, f"a_{t % 9}", f"m{t % 5}@" if t % 3 else None, f"{t % 4}" if t % 3 and t % 2 else None) for t in range(60)]
    parts, whole = leads.lead_store(spark, str(tmp_path / "parts"), 4), leads.lead_store(spark, str(tmp_path / "whole"), 4)
    for number in range(4):
        leads.upsert_leads(parts, identifies(spark, *rows[number::4]), number)
    leads.upsert_leads(whole, identifies(spark, *rows), 0)
    for name in ("leads", "links"):
        assert sorted(map(repr, parts.read(name).collect())) == sorted(map(repr, whole.read(name).collect()))


def test_visitors_from_a_stream(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "visitors"), {"visitors": Keyed(identity.VISITORS, identity.VISITOR, 4)})
    made = events(spark, [{"who": f"a_{n % 5}", "t": (n * 37) % 101, "source": f"s{n}"} for n in range(40)] + [{"who": "a_q"}])
    made.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(keyed_writer(store, "visitors", identity.fold_visitors, identity.visitor_changes)).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    columns = [*identity.VISITOR, "first_seen_at", "last_seen_at", "first_utm", "last_utm", "last_device", "last_geo"]
    assert store.version().number > 1
    assert sorted(map(repr, store.read("visitors").select(columns).collect())) == sorted(map(repr, identity.visitors(made).select(columns).collect()))


def test_lead_numbers_and_folders(spark):
    frame = spark.createDataFrame([(1, 1, "e:x"), (1, 2, "e:x"), (1, 1, None)], "tenant_id bigint, workspace_id bigint, lead_key string")
    found = [r[0] for r in frame.select(leads.lead_id()).collect()]
    assert found[0] != found[1] and found[2] is None
    path = shared_folder(spark, "test")
    frame.write.parquet(path)
    assert clear_folders(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path)
