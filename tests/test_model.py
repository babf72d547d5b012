"""Random crawls and change streams against a sequential model."""

import os
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lotlake.functions import payload
from lotlake.operators import dedup, entities, merge, numbering, runs
from lotlake.plans import ingest, models
from lotlake.schemas import ITEMS, OBSERVATIONS
from lotlake.sources import tables
from lotlake.sources.pages import frontier, read_html, requested_pages
from lotlake.sources.scratch import scratch_dir
from lotlake.streaming import upsert

SHORT = 3


def model_crawl(crawl, limit):
    """crawl: category -> pages in order, each (status, error, ids)."""
    taken, errors, found = [], 0, 0
    for category in sorted(crawl):
        seen, total = set(), 0
        for number, (status, error, ids) in enumerate(crawl[category], 1):
            if limit is not None and total >= limit:
                break
            errors += error
            if status != "ok":
                break
            new = []
            for pos, i in enumerate(ids):
                if i is not None and i not in seen:
                    seen.add(i)
                    new.append((pos, i))
            if not new:
                break
            full = False
            for pos, i in new:
                if limit is not None and total >= limit:
                    full = True
                    break
                total += 1
                taken.append((category, number, pos, i))
            if full or len(ids) < SHORT:
                break
        found += total
        if limit is not None and found >= limit:
            break
    return sorted(taken), errors


def test_random_crawls(spark):
    random.seed(5)
    pages, lots, crawls = [], [], {}
    for run in range(60):
        crawl = {}
        for category in range(random.randint(1, 3)):
            crawl[category] = []
            for number in range(1, random.randint(2, 7)):
                status, error = random.choice([("ok", 0)] * 9 + [("fetch_failed", 1), ("no_script", 0), ("bad_json", 1)])
                ids = [random.choice([None, *"abcdefghijklmnop"]) for _ in range(random.choice([0, 1, 2, 3, 4, 5, 6]))] if status == "ok" else []
                if status == "ok" and not ids:
                    ids = [None]
                crawl[category].append((status, error, ids))
                pages.append((run, category, number, status, error))
                lots += [(run, category, number, pos, i) for pos, i in enumerate(ids)]
        crawls[run] = crawl
    p = spark.createDataFrame(pages, "run_id long, category_idx int, page int, status string, errors int")
    l = spark.createDataFrame(lots, "run_id long, category_idx int, page int, pos int, item_id string")
    firsts = dedup.first_seen(l)
    counted = dedup.page_counts(p, l, firsts)
    for limit in (None, 4):
        got = dedup.reached(counted, SHORT, limit)
        if limit is not None:
            got = dedup.within_run_limit(got, limit)
        taken, errors = defaultdict(list), defaultdict(int)
        for r in dedup.emitted(firsts, got).collect():
            taken[r["run_id"]].append((r["category_idx"], r["page"], r["pos"], r["item_id"]))
        for r in got.collect():
            errors[r["run_id"]] += r["errors"]
        for run, crawl in crawls.items():
            assert (sorted(taken[run]), errors[run]) == model_crawl(crawl, limit), (run, limit, crawl)


def test_limit_restarts_with_each_category(spark):
    p = spark.createDataFrame([(1, c, 1, "ok", 0) for c in (0, 1, 2)], "run_id long, category_idx int, page int, status string, errors int")
    l = spark.createDataFrame([(1, c, 1, k, f"{c}-{k}") for c, n in ((0, 12), (1, 30), (2, 5)) for k in range(n)], "run_id long, category_idx int, page int, pos int, item_id string")
    firsts = dedup.first_seen(l)
    got = dedup.within_run_limit(dedup.reached(dedup.page_counts(p, l, firsts), limit=20), 20)
    assert dedup.emitted(firsts, got).count() == 32


def test_random_merges(spark):
    random.seed(6)
    stored, batch, want_rows, want_classes = [], [], {}, []
    for item in range(120):
        name, state = f"i{item:03d}", None
        if random.random() < 0.4:
            state = random.choice("abc")
            stored.append((item + 1, name, state, None, "z", 10, None, None, None))
            want_rows[name] = (item + 1, state, None)
        for seq in sorted(random.sample(range(1000), random.randint(0, 6))):
            raw = random.choice("abc")
            seq = seq * 1000 + item
            batch.append((1, seq, name, raw, None, str(seq), 10, None))
            change = "new" if state is None else "updated" if raw != state else "unchanged"
            want_classes.append((name, seq, change))
            if change != "unchanged":
                want_rows[name] = (want_rows.get(name, (None,))[0], raw, seq)
            state = raw
    s, b = spark.createDataFrame(stored, ITEMS), spark.createDataFrame(batch, OBSERVATIONS)
    assert sorted(tuple(r) for r in merge.change_classes(s, b).drop("run_id").collect()) == sorted(want_classes)
    assert sorted(tuple(r) for r in merge.change_classes(s, b, hot_rows=3).drop("run_id").collect()) == sorted(want_classes)  # items of over three rows by ranges
    items = {r["item_id"]: r for r in ingest.upsert(s, b, scratch_dir(spark, "t")).items.collect()}
    assert set(items) == set(want_rows)
    first_seq = {}
    for _, seq, name, *_ in sorted(batch, key=lambda r: r[1]):
        first_seq.setdefault(name, seq)
    fresh = sorted((n for n, r in want_rows.items() if r[0] is None), key=first_seq.get)
    top = max(r[0] for r in stored)
    for name, (own, raw, seq) in want_rows.items():
        assert items[name]["raw_json"] == raw
        assert items[name]["id"] == (own if own is not None else top + 1 + fresh.index(name))
        if seq is not None:
            assert items[name]["zip_code"] == str(seq)


def test_to_and_fro_counts_twice(spark):
    b = spark.createDataFrame([(1, k, "x", raw, None, "z", 10, None) for k, raw in enumerate("ABA")], OBSERVATIONS)
    row = ingest.counters(spark.createDataFrame([], ITEMS), b).first()
    assert (row["items_found"], row["items_added"], row["items_updated"]) == (3, 1, 2)


def test_top_n_is_taken_without_a_sort(spark):
    from lotlake.operators import reports

    items = spark.createDataFrame([], ITEMS)
    assert "TakeOrderedAndProject" in reports.recent(items)._jdf.queryExecution().executedPlan().toString()


def test_runs_of_any_number_stay_in_order(spark):
    """The last run to see an item decides, however large run numbers get; ids follow the runs."""
    ids = [8_191, 8_192, 16_384, 2**40]
    rows = [(run, 0, "c", 1, k, f"i{k}" if k else "same", f"{run}", k + 1) for run in ids for k in (0, run % 7 + 1)]
    seen = spark.createDataFrame(rows, "run_id long, category_idx int, category string, page int, pos int, item_id string, raw_json string, nth int")
    batch = ingest.observations(seen, "z", 10, F.lit(None).cast("timestamp"))
    items = {r["item_id"]: r for r in ingest.upsert(spark.createDataFrame([], ITEMS), batch, scratch_dir(spark, "t")).items.collect()}
    assert items["same"]["raw_json"] == str(2**40) and items["same"]["id"] == 1
    order = list(dict.fromkeys(r[5] for r in sorted(rows, key=lambda r: (r[0], r[7]))))
    assert sorted(items, key=lambda k: items[k]["id"]) == order


def test_ranges_hold_about_as_many_rows(spark):
    rows = spark.range(24_000).select(F.struct(F.expr("id % 3 * 5000").alias("run"), F.expr("id % 2").cast("int").alias("category"), F.col("id").alias("nth")).alias("seq"), F.lit(1).alias("place of"))
    path = scratch_dir(spark, "ranges")
    got = numbering.numbered(rows, ["seq"], path)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(numbering.RANGE).count().collect()]
    assert max(sizes) < 2 * 24_000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [r["place"] for r in got.orderBy("seq").collect()] == list(range(1, 24_001))
    by = numbering.numbered(rows.select("seq.*").withColumn("run", F.nullif("run", F.lit(0))), ["nth"], scratch_dir(spark, "ranges"), ["run"]).groupBy("run").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.count_distinct("place").alias("n")).collect()
    assert {(r["run"], r["a"], r["b"], r["n"]) for r in by} == {(None, 1, 8000, 8000), (5000, 1, 8000, 8000), (10000, 1, 8000, 8000)}


def shuffled(spark):
    """Bytes that shuffles have written so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()


def test_whole_rows_shuffle_once_to_be_numbered(spark):
    rows = spark.range(20_000).select((F.xxhash64("id") % 1_000).alias("nth"), F.xxhash64("id").cast("string").alias("text"))
    at = [shuffled(spark)]
    for deal in (lambda: rows.repartitionByRange(4, "nth"), lambda: numbering.numbered(rows, ["nth"], scratch_dir(spark, "ranges"))):
        deal().write.format("noop").mode("overwrite").save()
        at.append(shuffled(spark))
    assert at[2] - at[1] < 1.5 * (at[1] - at[0])


def observed(spark, *rows):
    return spark.createDataFrame([(1, seq, item, raw, None, "z", 10, None) for seq, item, raw in rows], OBSERVATIONS)


def payloads(spark, root):
    return {r["item_id"]: r["raw_json"] for r in tables.read_items(spark, root).collect()}


def test_a_batch_that_was_cut_off_runs_again(spark, monkeypatch):
    root, counters = scratch_dir(spark, "items"), scratch_dir(spark, "counters")
    batch = lambda raw: observed(spark, (5, "x", raw), (6, raw, "p"))
    run = upsert.merge_batch(root, counters)
    run(batch("a"), 0)

    def dies(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(tables, "_bytes", dies)  # the snapshot is written, the pointer isn't
        with pytest.raises(KeyboardInterrupt):
            run(batch("b"), 1)
    assert tables.current_version(spark, root) == 1 and payloads(spark, root) == {"x": "a", "a": "p"}
    for k in range(1, 5):
        run(batch("abcde"[k]), k)
        run(batch("never"), k)  # finished already
    assert payloads(spark, root) == {"x": "e", **{k: "p" for k in "abcde"}} and tables.current_version(spark, root) == 5
    left = os.listdir(root.removeprefix("file://"))
    assert len([f for f in left if f.startswith("v")]) == tables.KEPT and not [f for f in left if f.startswith("work")]
    assert len(os.listdir(f"{root}/{tables.POINTER}".removeprefix("file://"))) == tables.KEPT
    totals = [tuple(r) for r in spark.read.parquet(counters).orderBy("batch_id").select("items_found", "items_added", "items_updated").collect()]
    assert totals == [(2, 2, 0)] + [(2, 1, 1)] * 4


def test_a_batch_writes_only_its_buckets(spark):
    """Buckets that a batch doesn't touch stay in their folders; ids go on over all buckets; old folders of a bucket go."""
    root, counters = scratch_dir(spark, "items"), scratch_dir(spark, "counters")
    run = upsert.merge_batch(root, counters, buckets=8)
    run(observed(spark, *[(k, f"i{k}", "p") for k in range(40)]), 0)
    before = tables.current(spark, root)["parts"]
    assert len(before) == 8 and all(before)
    one = observed(spark, (50, "i3", "q"), (51, None, "n"))
    touched = tables.touched_buckets(one, 8)
    run(one, 1)
    after = tables.current(spark, root)["parts"]
    assert [k for k in range(8) if before[k] != after[k]] == touched and len(touched) <= 2
    run(observed(spark, (60, "fresh", "f")), 2)
    run(observed(spark), 3)
    items = {r["item_id"]: (r["id"], r["raw_json"]) for r in tables.read_items(spark, root).collect()}
    want = {f"i{k}": (k + 1, "p") for k in range(40)} | {"i3": (4, "q"), None: (41, "n"), "fresh": (42, "f")}
    now = tables.current(spark, root)
    assert items == want and now["last_id"] == 42 and now["version"] == 4
    here = root.removeprefix("file://")
    held = {f"{v}/{p}" for v in os.listdir(here) if v.startswith("v") for p in os.listdir(f"{here}/{v}") if p.startswith(tables.BUCKET)}
    assert held == set(now["parts"])  # the last two snapshots are the same
    size = lambda part: sum(os.path.getsize(f"{here}/{part}/{f}") for f in os.listdir(f"{here}/{part}"))
    assert 0.5 < now["bytes"] / sum(map(size, now["parts"])) < 1.5


def test_buckets_follow_the_bytes(spark, monkeypatch):
    root, counters = scratch_dir(spark, "items"), scratch_dir(spark, "counters")
    run = upsert.merge_batch(root, counters)
    run(observed(spark, *[(k, f"i{k}", "p") for k in range(30)]), 0)
    assert len(tables.current(spark, root)["parts"]) == 1
    monkeypatch.setattr(tables, "BUCKET_BYTES", 500)
    run(observed(spark, (40, "i7", "q"), (41, "new", "n")), 1)
    n = len(tables.current(spark, root)["parts"])
    assert n >= 4 and payloads(spark, root) == {f"i{k}": "p" for k in range(30)} | {"i7": "q", "new": "n"}
    monkeypatch.setattr(tables, "BUCKET_BYTES", 50_000)
    run(observed(spark, (50, "i8", "r")), 2)
    assert len(tables.current(spark, root)["parts"]) == n and payloads(spark, root)["i8"] == "r"


def arriving(spark, folder, *rows):
    observed(spark, *rows).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def test_a_stream_joins_a_table_that_exists(spark):
    """No batch is lost, whatever the table's version; a new checkpoint is a stream of its own."""
    root, counters = scratch_dir(spark, "items"), scratch_dir(spark, "counters")
    for version in (1, 2, 3):
        tables.write_items(ingest.upsert(tables.read_items(spark, root), observed(spark, (version, "x", f"v{version}")), scratch_dir(spark, "t")).items, root, version)
    landing, checkpoint = scratch_dir(spark, "landing"), scratch_dir(spark, "at")
    go = lambda stream, at: upsert.start_upsert(stream, root, counters, at).awaitTermination()
    go(arriving(spark, landing, (10, "y", "first")), checkpoint)
    assert payloads(spark, root) == {"x": "v3", "y": "first"} and tables.current_version(spark, root) == 4
    go(arriving(spark, landing, (11, "y", "second"), (12, "z", "p")), checkpoint)
    assert payloads(spark, root) == {"x": "v3", "y": "second", "z": "p"}
    go(arriving(spark, scratch_dir(spark, "landing"), (20, "x", "other")), scratch_dir(spark, "at"))  # a new checkpoint over other files
    assert payloads(spark, root) == {"x": "other", "y": "second", "z": "p"} and tables.current_version(spark, root) == 6
    assert sorted(tables.current(spark, root)["streams"].values()) == [0, 1]
    again = upsert.merge_batch(root, counters, stream=upsert.stream_name(spark, checkpoint))
    again(observed(spark, (30, "y", "never")), 1)
    assert payloads(spark, root)["y"] == "second" and tables.current_version(spark, root) == 6
    assert spark.read.parquet(counters).agg(F.sum("items_found")).first()[0] == 4


def test_a_hot_item_is_many_tasks(spark):
    """An item with a third of all observations: no task has much more than its share, and classes and the current row stay right."""
    n = 30_000
    rows = spark.range(n).select(
        F.lit(1).cast("bigint").alias("run_id"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("i"), (F.col("id") % 5_000).cast("string"))).alias("item_id"),
        (F.col("id") / 7).cast("int").cast("string").alias("raw_json"), F.lit(None).cast("timestamp").alias("scraped_at"), F.lit("z").alias("zip_code"), F.lit(10).alias("radius_miles"), F.lit(None).cast("string").alias("category"),
    )
    none, path = spark.createDataFrame([], ITEMS), scratch_dir(spark, "ranges")
    key = lambda r: tuple(str(v) for v in r)
    plain = sorted(merge.change_classes(none, rows).collect(), key=key)
    split = merge.classified(none, rows, hot_rows=2_000, path=path)
    assert sorted(split.select("run_id", "item_id", "seq", "change").collect(), key=key) == plain
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(numbering.RANGE).count().collect()]
    assert len(sizes) > 2 and max(sizes) < 2 * n / 3 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = lambda **kind: sorted(merge.merged(none, rows, **kind).drop("search_terms").collect(), key=key)
    assert at(hot_rows=2_000) == at()


def test_search_terms_unite(spark):
    """Terms of an item stay over merges, whether an observation changes it or not."""
    root = scratch_dir(spark, "items")

    def found(*rows):
        return spark.createDataFrame([(1, seq, item, raw, None, "z", 10, None, term) for seq, item, raw, term in rows], OBSERVATIONS + ", search_term string")

    for version, batch in enumerate([found((1, "a", "p", "red"), (2, "b", "p", None), (3, "a", "p", "ring")), found((4, "a", "p", "old"), (5, "a", "q", "red"), (6, "b", "q", None)), observed(spark, (7, "a", "r"))], 1):
        tables.write_items(ingest.upsert(tables.read_items(spark, root), batch, scratch_dir(spark, "t")).items, root, version)
    assert {r["item_id"]: (r["raw_json"], r["search_terms"]) for r in tables.read_items(spark, root).collect()} == {"a": ("r", ["old", "red", "ring"]), "b": ("q", None)}


def test_one_shuffle_by_item(spark):
    """Classes, the current row and counters of a batch share one exchange."""
    plan = merge.merged(spark.createDataFrame([], ITEMS), spark.createDataFrame([], OBSERVATIONS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_fingerprints_do_not_shuffle(spark):
    """A merge shuffles what the items are, not 64 hexadecimal digits more for each."""
    batch = spark.range(20_000).select(
        F.lit(1).cast("bigint").alias("run_id"), F.col("id").alias("seq"), F.col("id").cast("string").alias("item_id"), F.col("id").cast("string").alias("raw_json"),
        F.lit(None).cast("timestamp").alias("scraped_at"), F.lit("z").alias("zip_code"), F.lit(10).alias("radius_miles"), F.lit(None).cast("string").alias("category"),
    )
    before = shuffled(spark)
    merge.merged(spark.createDataFrame([], ITEMS), batch).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 20_000 * 64


def test_search_terms_leave_nothing_but_what_they_found(spark):
    """No listing, no work of a finished merge and no shuffle file stays."""
    from lotlake.queries import QUERIES

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    files = lambda: {f.getName() for f in iter_scala(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
    before, held = set(os.listdir(shared)), files()
    rows = QUERIES["search_terms"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len({r["item_id"] for r in rows}) > 0
    made = set(os.listdir(shared)) - before
    assert sorted(name.rsplit("-", 1)[0] for name in made) == ["found", "items"]
    for _ in range(50):  # they go in the background
        if not (left := [f for f in files() - held if f.startswith("shuffle_")]):
            break
        time.sleep(0.1)
    assert not left


def iter_scala(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def test_page_files(spark, tmp_path):
    """Empty files are empty pages, pages without a file weren't fetched, files that nobody asked for don't count."""
    for name, data in {"0 +%.html": b"<a>\n</a>", "1.html": b"", "2.html": "é".encode() + b"\xff", "sub/3.html": b"", "9.html": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = read_html(spark, str(tmp_path))
    assert {r["url"].rsplit("/", 1)[-1]: r["html"] for r in files.collect()} == {"0%20+%25.html": "<a>\n</a>", "1.html": "", "2.html": "é\ufffd", "3.html": "", "9.html": "x"}
    asked = spark.createDataFrame([(1, 0, None, k) for k in (1, 2, 3, 4)], "run_id long, category_idx int, category string, page int")
    pages = requested_pages(asked, files, F.col("page").cast("string"), F.regexp_extract("url", r"(\d+)\.html$", 1))
    assert {r["page"]: r["html"] for r in pages.collect()} == {1: "", 2: "é\ufffd", 3: "", 4: None}
    states = entities.page_states(pages).collect()
    assert {r["page"]: (r["status"], r["errors"]) for r in states} == {1: ("empty_body", 0), 2: ("no_script", 0), 3: ("empty_body", 0), 4: ("fetch_failed", 1)}


def test_terms_in_urls(spark):
    asked = spark.createDataFrame([(1, "art", "04217", 25, "red ring & é"), (2, None, "04217", 25, None), (3, None, "04217", 25, "")], "run_id long, categories string, zip_code string, radius_miles int, search_term string")
    got = {r["run_id"]: (r["url"], r["search_term"]) for r in frontier(asked, "b", 1).collect()}
    plain = "?status=open&zip=04217&miles=25&apage=1&ipp=100"
    assert got == {1: (f"b/lots/art/{plain}&q=red+ring+%26+%C3%A9", "red ring & é"), 2: (f"b/lots/{plain}", None), 3: (f"b/lots/{plain}", "")}


def test_lots_without_id(spark):
    lots = spark.createDataFrame([(1, 0, None), (1, 0, "a"), (1, 1, "b"), (2, 0, None), (2, 0, None)], "run_id long, category_idx int, item_id string")
    assert {tuple(r) for r in dedup.without_id(lots).collect()} == {(1, 0, 1), (2, 0, 2)}


def test_failed_runs_keep_page_errors(spark):
    started = spark.createDataFrame([(k, None, None, "z", 10, False, s) for k, s in enumerate(["completed", "failed", "interrupted"])], "run_id long, started_at timestamp, completed_at timestamp, zip_code string, radius_miles int, test_mode boolean, status string")
    changes = spark.createDataFrame([(k, 5, 3, 2) for k in range(3)], "run_id long, items_found long, items_added long, items_updated long")
    pages = spark.createDataFrame([(k, 4, 7, 5) for k in range(3)], "run_id long, errors long, pages_scraped long, lots_found long")
    got = {r["status"]: (r["items_found"], r["items_added"], r["items_updated"], r["errors"]) for r in runs.finished(started, changes, pages).collect()}
    assert got == {"completed": (5, 3, 2, 4), "failed": (5, 0, 0, 5), "interrupted": (5, 0, 0, 4)}


def test_builds_go_on_where_they_ended(spark):
    """A run that is whole keeps its files; one that a dead writer left half is replaced; a build without new runs writes nothing."""
    path = scratch_dir(spark, "facts")
    rows = lambda *runs, n=4: spark.createDataFrame([(f"run {r}:00", k, "x") for r in runs for k in range(n)], "sys_run_name string, seq long, v string")
    models.build_runs(rows("1", "2"), path)
    files = lambda: {f"{d}/{f}" for d, _, names in os.walk(path.removeprefix("file://")) for f in names if f.startswith("part") and models.DONE not in d}
    before = files()
    rows("3", n=2).write.mode("append").partitionBy("sys_run_name").parquet(path)  # cut off
    models.build_runs(rows("1", "2", "3", "4", n=5), path, lambda r: r.withColumn("v", F.lit("y")))
    got = sorted(tuple(r) for r in spark.read.parquet(path).groupBy("sys_run_name", "v").count().collect())
    assert got == [("run 1:00", "x", 4), ("run 2:00", "x", 4), ("run 3:00", "y", 5), ("run 4:00", "y", 5)] and before <= files()
    after = files()
    models.build_runs(rows("1", "2", "3", "4"), path)
    assert files() == after
    assert sorted(r[0] for r in models.finished_runs(spark, path).collect()) == [f"run {k}:00" for k in (1, 2, 3, 4)]


def test_first_seen_whatever_the_arrival(spark):
    """Shuffled arrivals give what the batch form gives; state goes with the watermark."""
    random.seed(9)
    lots = [(run, c, p, q, random.choice([None, *"abcdefg"]), run) for run in range(8) for c in range(2) for p in range(1, 4) for q in range(4)]
    random.shuffle(lots)
    folder, out, at = scratch_dir(spark, "landing"), scratch_dir(spark, "out"), scratch_dir(spark, "at")
    schema = "run_id long, category_idx int, page int, pos int, item_id string, day long"
    query = None
    for part in (sorted(lots, key=lambda r: r[0] // 2 * 2)[k : k + 48] for k in range(0, len(lots), 48)):  # two runs at a time, shuffled
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        rows = spark.readStream.schema(schema).parquet(folder).withColumn("started_at", F.timestamp_seconds((100 + F.col("day")) * 86_400))
        query = upsert.first_in_order(rows, "1 day").writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("run_id", "category_idx", "item_id", "page", "pos").collect())
    batch = dedup.first_seen(spark.createDataFrame(lots, schema)).select("run_id", "category_idx", "item_id", "page", "pos").collect()
    assert got == sorted(tuple(r) for r in batch if r["run_id"] < 7)  # the last run is open
    left = sum(r["run_id"] == 7 for r in batch)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == left


def test_display(spark):
    row = spark.range(1).select(
        payload.category_list(F.lit(" a,,b ,")).alias("set"), payload.category_list(F.lit(" a,,b ,"), keep_empty=True).alias("line"), payload.title(F.lit("x" * 80), 60).alias("title"), payload.title(F.lit(None).cast("string"), 60).alias("none"),
        *[payload.stored_time(F.lit(t)).cast("string").alias(f"t{k}") for k, t in enumerate(["2024-01-02T03:04:05", "2024-01-02 03:04:05.25", "later", "2024-01-02T05:04:05.5+02:00"])],
    ).first()
    assert row["set"] == ["a", "b"] and row["line"] == ["a", "", "b", ""] and row["title"] == "x" * 60 and row["none"] == "No title"
    assert (row["t0"], row["t1"], row["t2"], row["t3"]) == ("2024-01-02 03:04:05", "2024-01-02 03:04:05.25", None, "2024-01-02 03:04:05.5")


def test_written_files_take_no_job_each(spark):
    from lotlake.sources import fixtures

    path = scratch_dir(spark, "written")
    rows = spark.createDataFrame([("p1", "é\n"), ("p2", ""), ("p3", None)], "name string, html string")
    fixtures.write_files(rows, path)
    read = read_html(spark, path).select(F.regexp_extract("url", "/(p[0-9]+)[.]html$", 1).alias("name"), "html")
    assert sorted(map(tuple, read.collect())) == [("p1", "é\n"), ("p2", ""), ("p3", "")]


def test_first_places_are_hashed_and_not_sorted(spark):
    lots = spark.createDataFrame([(1, 0, p, q, "a") for p, q in ((3, 0), (2, 2**31 - 1), (2, 7), (2**31 - 1, 0))], "run_id long, category_idx int, page int, pos int, item_id string")
    got = dedup.first_seen(lots)
    assert [tuple(r) for r in got.collect()] == [(1, 0, "a", 2, 7)] and got.schema["page"].dataType == got.schema["pos"].dataType == lots.schema["pos"].dataType
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_pages_are_grouped_as_they_come_sorted(spark):
    from lotlake.session import prepare
    from lotlake.sources import fixtures

    plan = fixtures.pages(prepare(spark), "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    made = fixtures.pages(spark, "/root/testdata/sf0.001")
    made.collect()
    final = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "collect_list" in plan and "ObjectHashAggregate" not in final


def test_lines_shuffle_by_part_and_by_order_only(spark):
    """What hangs on an order is joined per order, so that lines aren't dealt by customer and once more by line."""
    from lotlake.sources import fixtures

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fixtures.items(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(l_") == 2


def test_tags_take_the_text_once(spark):
    rows = spark.createDataFrame([(1, '{"lead":"Red RING"}'), (2, '{"lead":"\\u0072ed"}'), (3, '{"lead":null}'), (4, None), (5, '{"lead":"gold"}')], "id long, raw_json string")
    got = models.tagged(rows, ["red", "Ring", "red"], payload.field(F.col("raw_json"), "lead"))
    assert sorted(tuple(r) for r in got.select("id", "search_term").collect()) == [(1, "Ring"), (1, "red"), (1, "red"), (2, "red"), (2, "red")]
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()


def test_one_bucket_is_written_as_it_comes(spark):
    root = scratch_dir(spark, "items")
    rows = spark.range(0, 300, 1, 3).select("id", F.col("id").cast("string").alias("item_id"), *[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in ITEMS.split(", ")[2:])])
    folder = tables.write_items(rows, root, 1).removeprefix("file://")
    assert sum(f.endswith(".parquet") for _, _, names in os.walk(folder) for f in names) == 3
    assert sorted(r["id"] for r in tables.read_items(spark, root).collect()) == list(range(300)) and tables.current(spark, root)["last_id"] == 299
    tables.write_items(rows.limit(0), root, 2)
    assert tables.read_items(spark, root).count() == 0 and tables.current(spark, root)["last_id"] == 299


def test_faulty_pages_are_made_in_one_pass(spark):
    """The page that repeats another is made from it, so lots are read, sorted and grouped once."""
    from lotlake.session import prepare
    from lotlake.sources import fixtures

    made = fixtures.pages(prepare(spark), "/root/testdata/sf0.01", faults=True)
    rows = {(r["category"], r["page"]): r["html"] for r in made.where("page IN (4, 5) AND category = 'ECONOMY'").collect()}
    assert len(rows) == 2 and rows["ECONOMY", 4] == rows["ECONOMY", 5]
    made.collect()
    final = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan parquet") == 2 and "Union" not in final and "ObjectHashAggregate" not in final


def test_lots_behind_the_last_taken_page_are_looked_at_once(spark):
    from lotlake.session import prepare
    from lotlake.sources import fixtures

    done = ingest.crawl(fixtures.pages(prepare(spark), "/root/testdata/sf0.001", faults=True).where("page < 3"), scratch_dir(spark, "crawl"))
    plan = done.observed._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(page," in plan and done.observed.count() == done.pages.agg(F.sum("take")).first()[0] > 0
