"""Documents, vocabularies, intervals, slices, publication and history on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import aggregates, documents, intervals, joins, slices, vocabulary, windows


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def diff(spark, old, new):
    side = lambda docs: spark.createDataFrame([(k, v if isinstance(v, (str, type(None))) else json.dumps(v)) for k, v in docs.items()], "k long, json string")
    return sorted(tuple(r)[1:] for r in documents.deep_diff(side(old), side(new), "k", "json").collect())


def test_differences_are_told_by_path(spark):
    old = {"boats": [{"id": "a", "guests": 12, "fees": [1, 2]}, {"id": "b", "guests": 8}], "as_of": "x", "rates": {"EUR": 1}, "kept": [True, None]}
    new = {"boats": [{"id": "b", "guests": 8.5}, {"id": "a", "guests": 13, "fees": [1, 2, 3]}], "rates": [1], "kept": [True, None], "more": {"deep": {"er": 1}}}
    assert diff(spark, {1: old}, {1: new}) == [
        ("as_of", "removed", '"x"', None), ("boats[a].fees", "length", "2 entries", "3 entries"), ("boats[a].guests", "changed", "12", "13"), ("boats[b].guests", "type", "integer", "number"),
        ("more", "added", None, "object"), ("rates", "type", "object", "list"),
    ]


def test_lists_of_one_length_tell_entries_that_came_and_went(spark):
    old, new = [{"id": 1, "x": 1}, {"id": 2}, {"x": 5}], [{"id": 3, "x": 1}, {"id": 2}, {"x": 6}]
    assert diff(spark, {1: old}, {1: new}) == [("[#2].x", "changed", "5", "6"), ("[1]", "removed", "object", None), ("[3]", "added", None, "object")]
    assert diff(spark, {1: [{"id": 1}, {"id": 1}]}, {1: [{"id": 1}, {"id": 1, "y": 0}]}) == [("[#1].y", "added", None, "0")]


def test_whole_documents_odd_keys_and_texts_that_are_no_json(spark):
    assert diff(spark, {1: {"a.b": 1, "a": {"b": 2}}, 2: "{", 3: {"x": 1}, 4: None}, {1: {"a.b": 2, "a": {"b": 2}}, 2: "}", 5: [], 4: "1"}) == [
        ("", "added", None, "0 entries"), ("", "added", None, "1"), ("", "changed", "{", "}"), ("", "removed", "object", None), ('["a.b"]', "changed", "1", "2"),
    ]


def test_a_report_is_capped_and_says_what_is_left(spark):
    old, new = {f"k{i}": 0 for i in range(9)}, {f"k{i}": 1 for i in range(9)}
    side = lambda x: spark.createDataFrame([(1, json.dumps(x))], "k long, json string")
    report = documents.drift_report(documents.deep_diff(side(old), side(new), "k", "json"), "k", cap=4)
    assert [(r.path, r.more) for r in report.orderBy("nth").collect()] == [(f"k{i}", 5) for i in range(4)]
    assert documents.deep_diff(side(old), side(old), "k", "json").count() == 0


def test_a_diff_ships_documents_and_not_their_nodes(spark):
    rows = [(i, json.dumps({"xs": [{"id": j, "v": j} for j in range(50)]}), json.dumps({"xs": [{"id": j, "v": j + (j == i)} for j in range(50)]})) for i in range(20)]
    pairs = spark.createDataFrame(rows, "k long, was string, now string")
    out = documents.paired_diff(pairs, "k", "was", "now")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [(i, f"xs[{i}].v", "changed", str(i), str(i + 1)) for i in range(20)]


# --- revisions -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    import os
    import subprocess

    folder = str(tmp_path_factory.mktemp("history"))
    run = lambda *a, **e: subprocess.run(["git", "-C", folder, *a], check=True, capture_output=True, env=os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", **e})
    run("init", "-q")
    for i, (when, subject) in enumerate([("2026-01-01T08:00:00", "refresh one"), ("2026-01-01T20:00:00", "edit"), ("2026-01-02T09:00:00", "refresh two"), ("2026-01-04T09:00:00", "refresh three")]):
        os.makedirs(f"{folder}/data", exist_ok=True)
        with open(f"{folder}/data/book.json", "w") as f:
            json.dump({"n": i, "rows": [{"id": "x", "price": 10 + i}]}, f)
        with open(f"{folder}/data/other.json", "w") as f:
            json.dump({"n": -i}, f)
        run("add", "-A")
        run("commit", "-qm", subject, GIT_AUTHOR_DATE=f"{when}Z", GIT_COMMITTER_DATE=f"{when}Z")
    run("rm", "-q", "data/other.json")
    run("commit", "-qm", "gone", GIT_AUTHOR_DATE="2026-01-05T00:00:00Z", GIT_COMMITTER_DATE="2026-01-05T00:00:00Z")
    return folder


def test_revisions_are_rows(spark, repository):
    from plumbline.sources import archive

    df = archive.revisions(spark, repository, "data/book.json", per_task=1)
    assert [json.loads(r.content)["n"] for r in df.orderBy("committed").collect()] == [0, 1, 2, 3]
    last = aggregates.kept(df, ["day", "path"], ["committed"], last=True)
    assert [(str(r.day), r.subject) for r in last.orderBy("day").collect()] == [("2026-01-01", "edit"), ("2026-01-02", "refresh two"), ("2026-01-04", "refresh three")]
    read = archive.documents_of(last, "n int, rows array<struct<id: string, price: int>>").orderBy("day")
    assert [(r.n, r.rows[0].price) for r in read.collect()] == [(1, 11), (2, 12), (3, 13)]
    assert df.where(F.col("subject").startswith("refresh")).count() == 3
    one = df.where(F.col("revision") == df.orderBy("committed").first().revision).collect()
    assert [r.subject for r in one] == ["refresh one"]
    assert archive.revisions(spark, repository, "data/book.json", limit=2).count() == 2


def test_revisions_that_cannot_match_are_not_opened(spark, repository):
    import datetime as dt

    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, StringContains

    from plumbline.sources import archive

    options = {"repository": repository, "path": "data/*.json", "revisionspertask": "1"}
    reader = archive.RevisionsReader(options)
    assert len(reader.partitions()) == 5 and {p for s in reader.partitions() for r in s.revisions for p in r[3]} == {"data/book.json", "data/other.json"}
    kept = StringContains(("content",), "x")
    assert list(reader.pushFilters([GreaterThanOrEqual(("day",), dt.date(2026, 1, 2)), EqualTo(("path",), "data/book.json"), kept])) == [kept]
    assert [r[2] for s in reader.partitions() for r in s.revisions] == ["gone", "refresh three", "refresh two"] and {p for s in reader.partitions() for r in s.revisions for p in r[3]} == {"data/book.json"}
    df = archive.revisions(spark, repository, "data/*.json", per_task=1).where("day = '2026-01-04'")
    assert df.rdd.getNumPartitions() == 1 and {r.path for r in df.collect()} == {"data/book.json", "data/other.json"}
    assert archive.revisions(spark, repository, "data/other.json").where("committed > timestamp'2026-01-04 10:00:00'").count() == 0


# --- vocabulary ------------------------------------------------------------------------------------------------------


def test_vocabulary_join_gives_what_the_expression_gives(spark):
    import random

    from plumbline.functions import text

    rng = random.Random(7)
    words = ["blue", "reef", "north", "Élphinstone", "b", "hole", "&", "wall", "st", "john's"]
    hints = [("blue hole", "Blue Hole"), ("elphinstone", "Elphinstone"), ("reef", "Reef"), ("!!", "nothing")]
    names = [("reef", "Reef"), ("north wall reef", "North Wall Reef"), ("and", "And"), ("st johns", "St John's"), ("b", "B")]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(900, None), (901, ""), (902, "  --  "), (903, "reef " * 3000)]
    df = spark.createDataFrame(docs, "id long, body string").repartition(3)
    book = spark.createDataFrame([(k, v, r) for r, (k, v) in enumerate([*hints, *names])], "key string, name string, rank int")
    got = {r.id: r.names for r in vocabulary.match_lists(df, "id", "body", book).collect()}
    want = {r.id: [x for x in r.names or [] if x != "nothing"] for r in df.select("id", text.vocabulary_matches(F.col("body"), hints, names).alias("names")).collect()}
    assert got == want and sum(map(len, want.values())) > 300
    assert vocabulary.matches(df, "id", "body", book.limit(0)).count() == 0


# --- intervals -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["int", "double", "date", "timestamp"])
def test_first_interval_equals_the_plain_join(spark, kind):
    import datetime as dt
    import random

    rng = random.Random(kind)
    make = {"int": lambda x: x, "double": lambda x: x / 7 - 3, "date": lambda x: dt.date(2024, 1, 1) + dt.timedelta(x), "timestamp": lambda x: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=x * 1000)}[kind]
    points = [(i, "hot" if i % 3 else f"k{i % 7}", make(rng.randint(-5, 400)) if i % 50 else None) for i in range(1500)]
    runs = []
    for i in range(200):
        a = rng.randint(-10, 400)
        runs.append((rng.choice(["hot", "k0", "k3"]), make(a), make(a + rng.choice([0, 0, 1, 5, 300, -4])), f"r{i}"))
    runs += [("hot", None, make(3), "open"), ("hot", make(3), None, "open")]
    if kind == "double":
        runs += [("k1", float("-inf"), float("inf"), "all"), ("k2", 1e300, float("inf"), "far")]
        points += [(9000, "k2", 2e300), (9001, "k1", -1e308), (9002, "k1", float("nan"))]
    p = spark.createDataFrame(points, f"id int, key string, at {kind}")
    r = spark.createDataFrame(runs, f"key string, lo {kind}, hi {kind}, run string")
    want = {}
    for i, k, x in points:
        fits = [(lo, hi, n) for key, lo, hi, n in runs if key == k and None not in (x, lo, hi) and lo <= x <= hi]
        want[i] = min(fits)[2] if fits else None
    got = {x.id: x.run for x in intervals.first_interval(p, r, "id", ["key"], "at", "lo", "hi", ["lo", "hi", "run"]).collect()}
    assert got == want
    assert {x.run for x in intervals.first_interval(p, r.limit(0), "id", ["key"], "at", "lo", "hi", ["lo"]).collect()} == {None}


def test_a_hot_key_of_intervals_is_spread(spark):
    points = spark.range(60_000).select("id", F.lit("hot").alias("key"), (F.col("id") % 5).cast("int").alias("at"))
    runs = spark.createDataFrame([("hot", 0, 9, "wide"), ("hot", 3, 4, "narrow")], "key string, lo int, hi int, run string")
    out = intervals.first_interval(points, runs, "id", ["key"], "at", "lo", "hi", ["run"])
    assert {r.run: r["count"] for r in out.groupBy("run").count().collect()} == {"narrow": 24_000, "wide": 36_000}


def test_many_intervals_about_many_points_make_no_pairs(spark):
    points = spark.range(20_000).select("id", F.lit("hot").alias("key"), (F.col("id") % 2_000 + 10_000).alias("at"))
    runs = spark.range(20_000).select(F.lit("hot").alias("key"), (F.col("id") % 100).alias("lo"), (F.col("id") % 100 + 30_000).alias("hi"), (20_000 - F.col("id")).alias("run"))
    out = intervals.first_interval(points, runs, "id", ["key"], "at", "lo", "hi", ["run"])
    assert [tuple(r) for r in out.groupBy("run", "lo").count().collect()] == [(1, 99, 20_000)]
    assert "_part" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("frequent", [4, 2048])
def test_first_interval_in_slices(spark, monkeypatch, frequent):
    import random

    rng, sliced = random.Random(frequent), slices.sliced
    monkeypatch.setattr(slices, "sliced", lambda df, keys, order: sliced(df, keys, order, 16, frequent))
    points = [(i, "hot", rng.randint(-50, 1050)) for i in range(1500)]
    runs = [("hot", a, a + rng.choice([0, 1, 3, 40, 700, 1000]), i) for i, a in ((i, rng.randint(0, 1000)) for i in rng.sample(range(500), 60))]
    out = intervals.first_interval(spark.createDataFrame(points, "id int, key string, at int"), spark.createDataFrame(runs, "key string, lo int, hi int, run int"), "id", ["key"], "at", "lo", "hi", ["run"])
    assert {r.id: r.run for r in out.collect()} == {i: min((n for _, a, b, n in runs if a <= x <= b), default=None) for i, _, x in points}


# --- slices ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def readings(spark):
    import random

    rng = random.Random(11)
    rows = [(i, "hot" if i % 10 < 3 else f"k{i % 97}", rng.randint(0, 300) if i % 40 else None, rng.random() < 0.6, round(rng.random(), 3)) for i in range(4000)]
    return spark.createDataFrame(rows, "id int, key string, at int, flag boolean, value double").repartition(4).cache()


def test_a_hot_key_is_cut_into_slices(readings):
    sizes = slices.sliced(readings, ["key"], "at", slices=16, frequent=8).groupBy("key", "_slice").count().collect()
    hot = [r["count"] for r in sizes if r.key == "hot"]
    assert len(hot) > 10 and max(hot) < 300 and all(r._slice == 0 for r in sizes if r.key != "hot")


def test_sliced_scans_equal_windows(readings):
    same = lambda a, b: sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(a.columns)).collect()))
    how = {"slices": 16, "frequent": 8}
    assert same(slices.as_of(readings.where("at IS NOT NULL"), ["key"], "at", ["value"], tie=["id"], **how), joins.as_of(readings.where("at IS NOT NULL"), ["key"], "at", ["value"], tie=["id"]))
    assert same(slices.runs(readings, ["key"], ["at", "id"], "flag", **how), windows.runs(readings, ["key"], ["at", "id"], "flag"))
    places = windows.numbered(readings, ["key"], ["at", "id"]).withColumn("number", F.col("number") + 1)
    assert same(slices.numbered(readings, ["key"], ["at", "id"], **how), places.withColumn("number", F.col("number").cast("long")))
    one = readings.dropDuplicates(["key", "at"])
    assert same(slices.steps(one, ["key"], "at", ["value"], **how), windows.steps(one, ["key"], "at", ["value"]))
    with_nulls = slices.as_of(readings, ["key"], "at", ["value"], tie=["id"], **how)
    assert with_nulls.count() == 4000 and with_nulls.where("at IS NULL AND prev_value IS NOT NULL").count() == 0


def test_equal_times_are_told_apart_by_id(spark, tmp_path):
    import datetime as dt

    from plumbline.plans import queries

    at = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), None]
    spark.createDataFrame([(i, x, "view", float(i)) for i, x in enumerate(at)], "event_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    out = queries.QUERIES["join_as_of_sliced"](spark, str(tmp_path))
    assert {r.event_id: (r.prev_value, r.prev_ts) for r in out.collect()} == {0: (None, None), 1: (0.0, at[0]), 2: (1.0, at[1]), 3: (2.0, at[2]), 4: (3.0, at[3])}


def test_sliced_lag_equals_the_window(readings):
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy(F.col("at").asc_nulls_last(), "id")
    want = readings.select("id", F.lag("value").over(w), F.lag("at").over(w))
    got = slices.lagged(readings, ["key"], "at", ["value"], tie=["id"], slices=16, frequent=8).select("id", "prev_value", "prev_at")
    assert rows(got, "id") == rows(want, "id")


def test_medians_with_a_hot_key(readings):
    import statistics

    values = {}
    for r in readings.collect():
        values.setdefault(r.key, []).append(r.value)
    want = {k: (statistics.median(v), len(v)) for k, v in values.items()}
    for split in (0, 8):
        assert {r.key: (r.middle, r.n) for r in aggregates.medians(readings, ["key"], "value", count="n", split=split).collect()} == want
    assert aggregates.medians(readings, [], "value").first().middle == statistics.median([x for v in values.values() for x in v])


def test_frequent_keys_are_dealt(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, -7).otherwise(F.col("id")).alias("key"), "id")
    facts = rows.groupBy("key").agg(F.count("*").alias("n"))
    out = joins.looked_up(rows, facts, ["key"])
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    big = rows.select("key", F.sha2(F.col("id").cast("string"), 256).alias("id"))
    split = joins.looked_up(big.repartition(8), facts, ["key"])
    assert split.count() == 40_000
    split.write.format("noop").mode("overwrite").save()
    plan = split._jdf.queryExecution()
    plan.executedPlan().execute().count()
    assert "skewed" in plan.executedPlan().toString() or "skew=true" in plan.executedPlan().toString()
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert out.where("key = -7 AND n = 13334").count() == 13_334 and out.count() == 40_000


# --- publication -----------------------------------------------------------------------------------------------------


def test_a_failed_gate_leaves_the_published_table(spark, tmp_path):
    from plumbline.sources import publish

    root = str(tmp_path / "table")
    with pytest.raises(publish.NotPublished):
        publish.published(spark, root)
    one = publish.publish(spark.range(100), root, "one")
    assert (one["number"], one["rows"]) == (1, 100)
    with pytest.raises(publish.NotPublished, match="enough rows"):
        publish.publish(spark.range(59), root, "two")
    assert publish.published(spark, root).count() == 100 and publish.manifest(spark, root)["version"] == "one"
    rules = {"no null": F.col("nulls") == 0, "unknown fails": F.lit(None).cast("boolean")}
    with pytest.raises(publish.NotPublished) as e:
        publish.publish(spark.range(100), root, "two", measures={"nulls": F.count_if(F.col("id").isNull())}, rules=rules)
    assert e.value.args == ("unknown fails",)
    # The same attempt again, now whole; and once more after its success, with other rows: nothing changes.
    two = publish.publish(spark.range(60), root, "two")
    assert two["number"] == 2 and publish.publish(spark.range(7), root, "two") == two and publish.published(spark, root).count() == 60
    publish.publish(spark.range(3), root, "three", force=True)
    publish.publish(spark.range(4), root, "four", keep=1)
    assert publish.published(spark, root).count() == 4 and publish.Store(spark, root).names("versions") == ["four", "three"]
    assert not publish.Store(spark, root).write_once("manifests/000000000004.json", "{}")


def test_a_day_written_twice_changes_nothing(spark, tmp_path):
    import datetime as dt

    from plumbline.sources import publish

    root, schema = str(tmp_path / "book"), "n long, day date"
    assert publish.book(spark, root, schema).count() == 0
    days = lambda first, n: spark.range(n).select(F.col("id").alias("n"), F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")).alias("day"))
    assert len(publish.append_days(days("2026-01-01", 5), root, keep=10)) == 5
    before = rows(publish.book(spark, root, schema), "day")
    publish.append_days(days("2026-01-01", 5).where("n = 4"), root, keep=10)
    assert rows(publish.book(spark, root, schema), "day") == before
    publish.append_days(days("2026-01-05", 1).withColumn("n", F.lit(99).cast("long")), root, keep=10)  # a day read anew
    assert rows(publish.book(spark, root, schema), "day") == [*before[:4], (99, dt.date(2026, 1, 5))]
    kept = publish.append_days(days("2026-01-12", 1), root, keep=10)
    assert kept == [dt.date(2026, 1, 3), dt.date(2026, 1, 4), dt.date(2026, 1, 5), dt.date(2026, 1, 12)]
    assert [n for n in publish.Store(spark, root).names() if n.startswith("day=")] == [f"day={d}" for d in kept]
    with pytest.raises(Exception, match="a row without day"):
        publish.append_days(spark.createDataFrame([(1, None)], schema), root)


# --- history ---------------------------------------------------------------------------------------------------------


def test_a_page_not_read_is_no_withdrawal(spark):
    from plumbline.operators import history

    seen = [("a", "p", 1, 10), ("a", "p", 3, 12), ("b", "p", 1, 5), ("b", "p", 5, 5), ("c", "q", 2, 1), ("d", "p", 3, 7)]
    read = [("p", 1), ("p", 3), ("p", 4), ("p", 5), ("q", 2)]
    snapshots = spark.createDataFrame([(k, p, f"2026-01-0{d}", v) for k, p, d, v in seen], "key string, page string, day string, price int").withColumn("day", F.col("day").cast("date"))
    coverage = spark.createDataFrame([(p, f"2026-01-0{d}") for p, d in read], "page string, day string").withColumn("day", F.col("day").cast("date"))
    got = history.events(snapshots, coverage, "key", "page", "day", ["price"])
    assert sorted((r.key, r.day.day, r.event, r.was and r.was.price, r.now and r.now.price) for r in got.collect()) == [
        ("a", 1, "added", None, 10), ("a", 3, "changed", 10, 12), ("a", 4, "withdrawn", 12, None), ("b", 1, "added", None, 5), ("b", 3, "withdrawn", 5, None), ("b", 5, "returned", 5, 5),
        ("c", 2, "added", None, 1), ("d", 3, "added", None, 7), ("d", 4, "withdrawn", 7, None),
    ]
    # Day 2: page p unread, so a and b are unread, not absent.
    states = lambda day: {r.key: r.state for r in history.states(snapshots, coverage, "key", "page", "day", day).collect()}
    assert states("2026-01-02") == {"a": "unread", "b": "unread", "c": "seen"}
    assert states("2026-01-05") == {"a": "absent", "b": "seen", "c": "unread", "d": "absent"}


# --- payloads --------------------------------------------------------------------------------------------------------

RULES = [("(?i)nitrox", "nitrox"), ("(?i)port|harbour", "port"), ("(?i)park", "park"), ("(?i)transfer", "transfer"), ("(?i)guide", "guide")]
ARRAYS = [("onBoard", "mandatory"), ("inAdvance", "mandatory"), ("extras", "optional"), ("rental", "optional"), ("included", "included")]


def lines_of(spark, *payloads):
    from plumbline.sources import payloads as source

    df = spark.createDataFrame([(i, json.dumps(p) if isinstance(p, dict) else p) for i, p in enumerate(payloads)], "trip int, json string")
    found = source.entries(df, "trip", "json", ARRAYS, "2026-06-01", "2026-09-30")
    lines, bills = source.fee_lines(found, "trip", RULES, {"1": "per_trip", "2": "per_night"}, "(?i)onboard purchases", ["guide"])
    return sorted(((r.trip, r.code, r.tier, r.basis, r.amount and float(r.amount), r.included, r.note) for r in lines.collect()), key=repr), {r.trip: (r.complete, r.unreadable, r.on_purchases) for r in bills.collect()}


def entry(title, price=None, per="1", **more):
    return {"title": title, "price": price, "payedPer": per, **more}


def test_payload_arrays_become_lines_and_a_verdict(spark):
    lines, bills = lines_of(
        spark,
        {"onBoard": [entry("Park fee", 90), entry("Park fee", 20), entry("Harbour", None, extraValue="15.5"), entry("Guide", 9, "2"), entry("14% GST (on onboard purchases)", 14)], "extras": [entry("Nitrox (EAN)"), entry("Nitrox", 70), entry("Park pass", 1), entry("Torch", 3)], "included": [entry("Free nitrox", per=None), entry("Transfers (port)", per=None), entry("Coffee", per=None)]},
        {"onBoard": [entry("Park fee")], "inAdvance": [entry("Local fee", 5), entry("Port", 5, "9"), entry("", 1, id="77")], "rental": [entry("Nitrox set", 50, contents="12 l"), entry("Transfer", 5, "9")], "included": [entry("Nitrox for free", per=None), entry("Port fee", per=None)]},
        {"onBoard": [entry("Park fee", 90, validTo="2026-05-31"), entry("Park fee", 95, validFrom="2026-06-01")], "extras": [entry("Transfer")], "included": []},
        "no json", {"included": [entry("Water")]},
    )
    assert lines == sorted([
        (0, "park", "mandatory", "per_trip", 90.0, False, "Park fee"), (0, "park", "mandatory", "per_trip", 20.0, False, "Park fee"), (0, "port", "mandatory", "per_trip", 15.5, False, "Harbour"),
        (0, "guide", "optional", "per_night", 9.0, False, "Guide"), (0, "nitrox", "optional", "per_trip", None, True, "Free nitrox"), (0, "transfer", "optional", "per_trip", None, True, "Transfers (port)"),
        (1, "park", "mandatory", "per_trip", None, False, "Park fee"), (1, "nitrox", "optional", "per_trip", 50.0, False, "Nitrox set: 12 l"), (1, "port", "optional", "per_trip", None, True, "Port fee"),
        (2, "park", "mandatory", "per_trip", 95.0, False, "Park fee"), (2, "transfer", "optional", "per_trip", None, False, "Transfer"),
    ], key=repr)
    assert bills == {0: (True, [], ["14% GST (on onboard purchases)"]), 1: (False, ["<untitled 77>", "Local fee", "Port"], []), 2: (True, [], []), 4: (True, [], [])}


def payload_tables(spark, tmp_path):
    rows = [(1, 7, 2, 20.0, 0.0, 0.0, "A", "F"), (1, 7, 1, 5.0, 0.0, 0.0, "N", "F"), (1, None, 1, 20.0, 0.0, 0.06, "A", "O"), (1, None, 3, 20.0, 0.0, 0.0, "N", "O"), (2, 1, 1, 20.0, 0.0, 0.04, "R", "O")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (2,), (3,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["extract_payload_lines", "extract_payload_bills", "bill_records"])
def test_reading_payloads_is_code_that_the_jvm_compiles(spark, tmp_path, name):
    from plumbline.plans import queries

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = queries.QUERIES[name](spark, payload_tables(spark, tmp_path))._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
    assert 0 < max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000


def test_lines_of_a_payload_are_shuffled_once(spark, tmp_path):
    from plumbline.plans import queries

    found = queries.QUERIES["extract_payload_bills"](spark, payload_tables(spark, tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.l_orderkey, r.complete, r.unreadable) for r in found.collect()) == [(1, False, []), (2, True, [])]


def test_records_read_their_payloads_once(spark, tmp_path):
    from plumbline.plans import queries

    found = queries.QUERIES["bill_records"](spark, payload_tables(spark, tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1
    assert sorted(map(tuple, found.collect())) == [(1, 2, 1, False), (2, 1, 0, True), (3, 0, 0, True)]


@pytest.mark.parametrize("name", ["extract_trip", "extract_cabins"])
def test_heavy_rows_of_a_small_table_are_dealt(spark, tmp_path, name):
    from plumbline.plans import queries

    part = spark.createDataFrame([(i, "a b", "Brand#1", "ECONOMY", i % 50 + 1) for i in range(100)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 4


def test_a_text_is_keyed_once(spark):
    from plumbline.functions import text

    df = spark.createDataFrame([("Le thé, the end", ), (None,)], "text string")
    plan = lambda out: out._jdf.queryExecution().optimizedPlan().toString()
    found = aggregates.tally(df, text.vocabulary_matches(F.col("text"), [("the", "THE"), ("end", "END")]), "v")
    assert sorted(map(tuple, found.collect())) == [("END", 1), ("THE", 1)] and plan(found).count("[^a-z0-9]+") == 1
    book = spark.createDataFrame([("the end", "E", 0)], "key string, name string, rank int")
    met = vocabulary.matches(df.withColumn("id", F.lit(1)), "id", "text", book)
    assert [tuple(r) for r in met.collect()] == [(1, "E", 0)]
    assert plan(vocabulary.matches(df.select("text", F.lit(1).alias("id")), "id", "text", book)).count("translate(translate(text") == 1


def test_berth_blocks_hold_no_groups_beside_their_rows(spark):
    from plumbline.operators import sales

    rooms = spark.createDataFrame([(1, 1, "b", 10.0, 2), (1, 1, "a", 10.0, 3), (1, 1, "c", 20.0, None), (1, 2, "a", 5.0, None), (1, 2, "b", None, 4), (2, 1, "x", None, None)], "sailing long, seller long, name string, price double, places long")
    out = sales.berth_blocks(rooms)
    assert "Aggregate" not in out.drop("ladder")._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.sailing, r.seller, r.least, r.at_price, r.aboard, [(x.name, x.places) for x in r.ladder if x.name != "b" or r.seller == 1]) for r in out.collect()) == [
        (1, 1, 10.0, 5, None, [("a", 3), ("b", 2), ("c", None)]), (1, 2, 5.0, None, None, [("a", None)]), (2, 1, None, None, None, [("x", None)]),
    ]


def test_bills_are_completed_before_they_are_joined(spark, tmp_path):
    from plumbline.plans import queries

    lines = [(1, "A", 20.0, 0.0), (1, "N", 1.0, 0.0), (2, "A", 20.0, 0.0), (2, "R", 2.0, 0.0), (3, "A", 20.0, 0.0), (4, "A", 20.0, 0.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_returnflag string, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "1-URGENT"), (2, "1-URGENT"), (3, "3-MEDIUM")], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = queries.QUERIES["bill_completed"](spark, str(tmp_path))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("LeftSemi") < plan.index("Aggregate")
    assert sorted(map(tuple, out.collect())) == [(1, True), (2, False), (3, False)]


def test_inferred_lines_meet_bills_in_one_aggregate(spark):
    """Lines that no free one may replace are neither sorted nor joined; nulls and open lines are as by the joins before."""
    from decimal import Decimal

    from plumbline.operators import bills
    from plumbline.plans import queries

    plan = queries.QUERIES["bill_inferred"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    schema = "bill_id long, code string, tier string, amount decimal(18,4), included boolean, level int, position int"
    rows = [(1, "nitrox", 5, False), (2, "nitrox", None, True), (3, "nitrox", None, False), (3, "nitrox", None, None), (4, "park", None, False), (None, "nitrox", 5, False), (None, "nitrox", None, False), (5, None, 5, False), (6, "nitrox", None, False)]
    lines = spark.createDataFrame([(b, c, "optional", a and Decimal(a), i, 0, 1) for b, c, a, i in rows], schema)
    vessels = spark.createDataFrame([(1, True), (2, True), (3, True), (3, True), (4, True), (None, True), (5, True), (6, False), (7, None)], "bill_id long, includes boolean")
    got = sorted((tuple(r) for r in bills.inferred_inclusion(lines, vessels, "nitrox").select("bill_id", "code", F.col("amount").cast("int"), "included", "position").collect()), key=repr)
    kept = [(b, c, a, i, 1) for b, c, a, i in rows if (b, c) != (3, "nitrox")]
    assert got == sorted(kept + [(b, "nitrox", None, True, 10_000) for b in (3, 4, 5, None)], key=repr)
