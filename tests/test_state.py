import json

from pyspark.sql import functions as F

from lotlake.operators import entities
from lotlake.schemas import PAGES
from lotlake.session import prepare


def page(spark, *htmls):
    rows = [(1, 0, None, k + 1, "u", h, None) for k, h in enumerate(htmls)]
    return spark.createDataFrame(rows, PAGES)


def script(doc):
    text = doc if isinstance(doc, str) else json.dumps({"apollo.state": doc})
    return f'<html><SCRIPT type="a" id=page-state>{text}</SCRIPT></html>'


def test_page_status(spark):
    prepare(spark)
    htmls = {
        "fetch_failed": None,
        "empty_body": "",
        "no_script": '<script id="other">{}</script><script data-id="page-state">{}</script><script id="PAGE-STATE">{}</script>',
        "bad_json": script('{"apollo.state": {"a": 1}'),
        "not_object": script("[1]"),
        "empty_state": script({}),
        "ok": script({"Lot:1": {"id": 1}}),
    }
    got = entities.page_states(page(spark, *htmls.values())).orderBy("page").collect()
    assert [r["status"] for r in got] == list(htmls)
    assert [r["errors"] for r in got] == [1, 0, 0, 1, 1, 0, 0]
    more = entities.page_states(page(spark, script('{"a":1} xyz'), script('{"other":1}'), script({"a": 1}).replace('{"a": 1}', "[1]"), script('{"apollo.state":null}'), '<script id="page-state"></script>')).orderBy("page").collect()
    assert [r["status"] for r in more] == ["bad_json", "empty_state", "not_object", "empty_state", "no_script"]


def lots_of(spark, state):
    prepare(spark)
    return entities.lots(entities.page_states(page(spark, script(state))))


def test_lots_are_recognised_by_type_or_key(spark):
    state = {"Lot:1": {"id": 1}, "x": {"__typename": "Lot", "id": 2}, "Lot:3": 5, "Lot:4": None, "y": {"__typename": "Auction"}, "z": [1]}
    assert sorted(r["key"] for r in lots_of(spark, state).collect()) == ["Lot:1", "x"]


def test_item_ids(spark):
    cases = [
        ({"id": 7}, "7"),
        ({"id": "a"}, "a"),
        ({"id": True}, "True"),
        ({"id": "False"}, "False"),
        ({"id": "0"}, "0"),
        ({"id": 0.0, "itemId": [], "eventItemId": 1.5}, "1.5"),
        ({"id": {"a": 1}}, '{"a":1}'),
        ({"id": 0, "itemId": 8}, "8"),
        ({"id": "", "eventItemId": 9}, "9"),
        ({"__typename": "Lot", "id": 0}, "lot-0"),
        ({"__typename": "Lot", "id": ""}, "lot-"),
        ({"__typename": "Lot", "id": None}, "lot-None"),
        ({"__typename": "Lot", "id": False}, "lot-False"),
        ({"__typename": "Lot", "id": []}, "lot-[]"),
        ({"__typename": "Lot", "id": {}}, "lot-{}"),
        ({"__typename": "Lot"}, None),
        ({"id": 0}, None),
    ]
    state = {f"Lot:{k}": lot for k, (lot, _) in enumerate(cases)}
    got = {r["key"]: r["item_id"] for r in lots_of(spark, state).collect()}
    assert got == {f"Lot:{k}": want for k, (_, want) in enumerate(cases)}


def test_references_are_inlined(spark):
    state = {
        "Lot:1": {"id": 1, "auction": {"__ref": "Auction:9"}, "lotState": {"__ref": "S"}},
        "Lot:2": {"id": 2, "auction": {"__ref": "Auction:8"}, "lotState": {"__ref": "none"}},
        "Lot:3": {"id": 3, "auction": {"name": "plain"}, "lotState": 4},
        "Auction:9": {"id": 1, "v": "first"},
        "other": {"__typename": "Auction", "id": 9, "v": "alias"},
        "S": None,
    }
    rows = entities.payloads(lots_of(spark, state)).collect()
    got = {r["key"]: json.loads(r["raw_json"]) for r in rows}
    assert got["Lot:1"] == {"id": 1, "auction_data": {"__typename": "Auction", "id": 9, "v": "alias"}, "lot_state_data": None, "auction_ref": "Auction:9", "lot_state_ref": "S"}
    assert got["Lot:2"] == {"id": 2, "auction_ref": "Auction:8", "lot_state_ref": "none"}
    assert got["Lot:3"] == {"id": 3, "auction": {"name": "plain"}, "lotState": 4}


def test_repeated_keys_take_the_last(spark):
    prepare(spark)
    text = '{"apollo.state":{"Lot:1":{"id":1,"id":2}}}'
    assert [r["item_id"] for r in entities.lots(entities.page_states(page(spark, script(text)))).collect()] == ["2"]


def test_repeated_cache_keys_take_the_last(spark):
    prepare(spark)
    text = '{"apollo.state":{"x":1},"apollo.state":{"Lot:1":{"id":1},"Lot:2":{"id":2},"Lot:1":{"id":3}}}'
    rows = entities.lots(entities.page_states(page(spark, script(text)))).collect()
    assert [(r["pos"], r["key"], r["item_id"]) for r in rows] == [(0, "Lot:1", "3"), (1, "Lot:2", "2")]


def texts(spark, *htmls):
    from lotlake.functions import state

    rows = spark.createDataFrame(list(enumerate(htmls)), "k int, html string").select("k", state.state_text(F.col("html")).alias("text"))
    return [r["text"] for r in rows.orderBy("k").collect()]


def test_scripts_are_found_by_tokens(spark):
    own = '<script id="page-state">{}</script>'
    cases = {
        '<script data-x="a>b" id="page-state">{"a":"<b>"}</script>': '{"a":"<b>"}',
        "<SCRIPT type=a ID = 'page-state' >x</SCRIPT >": "x",
        f"<!-- {own} --><p>{own.replace('{}', '1')}": "1",
        f"<!-- never closed {own}": None,
        f"<div title='{own}'></div>": None,
        f"<div title='{own}'>{own}": "{}",
        f"<style>{own}</style><title>{own}</title><textarea>{own}</textarea>": None,
        f"<b title=it's>it's</b> < > \" {own}": "{}",
        "<script>var s = '<!--';</script>" + own: "{}",
        '<script id="page-state">a\n\nb</script><script id="page-state">c</script>': "a\n\nb",
        '<script data-id="page-state" x=" id=page-state ">a</script><scripts id="page-state">b</scripts>': None,
        '<script id="page-state">open to the end': "open to the end",
        '<script id="page-state"></script>': None,
        '<script id="page-state"': None,
        "": None,
    }
    assert texts(spark, *cases, None) == [*cases.values(), None]


def test_large_pages_take_linear_time(spark):
    import time

    state = '{"a":"' + "<x> ' " * 300_000 + '"}'
    noise = "<a href='y'>it's</a> < b > \" ' " * 150_000
    pages = [f'{noise}<script id="page-state">{state}</script>', noise * 2, "<script " + 'a="' * 2_000_000, "<!--" * 2_000_000, '<script id="page-state" ' + "b=c " * 1_000_000 + ">{}</script>"]
    began = time.time()
    got = texts(spark, *pages)
    assert [g and len(g) for g in got] == [len(state), None, None, None, 2] and time.time() - began < 30


def test_ok_pages_are_parsed_once(spark):
    plan = entities.lots(entities.page_states(page(spark, "")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("struct<__typename") + plan.count("StructField(__typename") <= 2


def test_ids_alone_are_those_of_the_lots(spark):
    state = {"Lot:1": {"id": 1, "auction": {"__ref": "Auction:9"}}, "x": {"__typename": "Lot", "id": 0}, "Auction:9": {"id": 9}, "Lot:2": 5, "Lot:3": {"no": 1}}
    prepare(spark)
    states = entities.page_states(page(spark, script(state), None, script({"a": 1})))
    columns = [*entities.KEY, "pos", "key", "item_id"]
    ids = entities.lot_ids(states).select(columns).collect()
    assert ids == entities.lots(states).select(columns).collect() and [r["item_id"] for r in ids] == ["1", "lot-0", None]
    both = entities.lot_ids(states, pages_too=True)
    assert [(r["page"], r["status"]) for r in both.where("pos IS NULL").orderBy("page").collect()] == [(1, "ok"), (2, "fetch_failed"), (3, "ok")]
    assert both.where("pos IS NOT NULL").select(columns).collect() == ids


def test_resolution_stays_in_the_row(spark):
    plan = lots_of(spark, {"Lot:1": {"id": 1}})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_payload_predicates(spark):
    from lotlake.functions import payload as P

    rows = ['{"a":true}', '{"a":1}', '{"a":"true"}', '{"a":"1"}', '{"a":false}', "{}", '{"b":"x\\\\y%_"}', "not json", None]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, raw string")
    raw = F.col("raw")
    pick = lambda c: sorted(r["k"] for r in frame.where(c).collect())
    assert pick(P.is_true(raw, "a")) == [0, 1]
    assert pick(P.contains(raw, {"a": True})) == [0]
    assert pick(P.contains(raw, {"a": 1})) == [1]
    assert pick(P.contains(raw, {"a": "1"})) == [3]
    assert pick(P.contains_text(raw, "TRUE")) == [0, 2]
    assert pick(P.contains_text(raw, "x\\\\y")) == [6]
    assert pick(P.contains_text(raw, "n_t")) == [7]


def test_key_is_found_by_hash_and_told_from_another_with_the_same(spark):
    from lotlake.functions import state

    rows = spark.createDataFrame([(["a", "b", "c"], "b"), (["a", "b", "c"], "x"), (["a", "b", "c"], None)], "keys array<string>, key string")
    hashed = state.hashes(F.col("keys"))
    found = rows.select(state.place(F.col("keys"), state.hash_place(hashed, F.col("key")), F.col("key")).alias("at"))
    assert [r["at"] for r in found.collect()] == [1, None, None]
    # as if the first key had the hash of the one that is looked for
    forged = rows.select(state.place(F.col("keys"), F.lit(1).cast("bigint"), F.col("key")).alias("at"))
    assert [r["at"] for r in forged.collect()] == [1, None, None]


def test_page_scan_tries_no_match_at_each_character(spark):
    from lotlake.functions import state

    assert ".*?" not in state._TOKEN
    htmls = ["<!-- a - -- b --->" + script({"a": 1}), '<script id="page-state">a</scripty>b</SCRIPT >', '<script id="page-state">a</script', "<style>a</stylex></style><script id=page-state>b<c</script>"]
    rows = spark.createDataFrame(list(enumerate(htmls)), "k int, html string").select("k", state.state_text(F.col("html")).alias("text"))
    assert [r["text"] for r in rows.orderBy("k").collect()] == ['{"apollo.state": {"a": 1}}', "a</scripty>b", "a", "b<c"]


def test_long_runs_are_read_in_a_tight_loop(spark):
    from lotlake.functions import state

    assert "[^<]*+" not in state._TOKEN and '[^"]*+' not in state._TOKEN
    cut = spark.createDataFrame([("<SCRIPT x='é>' id=page-state >é\U0001f600<b></script>",)], "html string").select(state.state_text(F.col("html")))
    assert cut.first()[0] == "é\U0001f600<b>"
    assert "(.*+)" not in cut._jdf.queryExecution().optimizedPlan().toString()


def test_set_ids_of_every_kind(spark):
    from lotlake.functions import state

    prepare(spark)
    cases = {"1": "1", "0": None, "-0": None, "0.0": None, "1.50": "1.5", "1e3": "1000.0", '""': None, '"0"': "0", '"[]"': "[]", '"false"': "false", "false": None, "true": "True", "[]": None, "{}": None, "[0]": "[0]", "null": None}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", state._set(F.try_parse_json("raw")).alias("id"))
    assert {r["raw"]: r["id"] for r in rows.collect()} == cases
