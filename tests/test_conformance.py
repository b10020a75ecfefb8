"""Worked cases over a small fact with two lookups: exact sums, nulls, ratios, refusals, merges."""

from datetime import date
from decimal import Decimal

import pytest

from tallyloom.catalog import compose, digest, documents
from tallyloom.engine import Engine, rendered
from tallyloom.model import Limits, question
from tallyloom.operators.merge import full_merge
from tallyloom.refusal import Refusal

D1, D2 = date(2026, 1, 1), date(2026, 1, 2)
EVENTS = "day date, region string, amount_cents long, wide decimal(20,0), big long, rate double, share_cents long, code string"
ROWS = [
    (D1, "east", 150, Decimal(10**19), 2**63 - 1, 1.0, 70, "a"), (D1, "east", 200, Decimal(1), 1, 0.25, 0, "A"),
    (D1, "north", 400, Decimal(2), 0, 0.5, 200, "b"), (D1, None, 50, Decimal(3), 0, 0.5, 0, None),
    (D2, "east", 150, Decimal(4), 6, 1.25, 90, "a"), (D2, "north", 1300, Decimal(11), 0, 2.0, 0, "b"),
]
DOCS = ["""---
kind: model
name: events
source: facts
table: events
columns: [{name: day, type: DATE}, {name: region}, {name: amount_cents, type: BIGINT}, {name: wide}, {name: big}, {name: rate}, {name: share_cents}, {name: code}]
---
""", """---
kind: model
name: regions
source: %s
table: regions
columns: [{name: region}, {name: region_name}]
---
""", """---
kind: relationship
name: event_region
origin: {model: events, column: region}
target: {model: regions, column: region}
---
"""]  # fmt: skip
MEASURES = {
    "total": "simple: {aggregate: sum, column: amount_cents}", "mean": "simple: {aggregate: avg, column: amount_cents}",
    "wide_total": "simple: {aggregate: sum, column: wide}", "big_total": "simple: {aggregate: sum, column: big}", "rate_total": "simple: {aggregate: sum, column: rate}",
    "codes": "simple: {aggregate: count_distinct, column: code}",
    "share": "ratio: {numerator: {aggregate: sum, column: share_cents}, denominator: {aggregate: sum, column: amount_cents}, zero_denominator: yields_null}",
    "inverse": "ratio: {numerator: {aggregate: sum, column: amount_cents}, denominator: {aggregate: sum, column: share_cents}, zero_denominator: fails}",
}


def make(spark, split=True, extra=(), rows=ROWS, lookup=(("east", "Eastern"), ("north", "Northern")), lookup_schema="region string, region_name string", metric_extra=""):
    texts = [DOCS[0], DOCS[1] % ("names" if split else "facts"), DOCS[2], *extra]
    for name, m in MEASURES.items():
        texts.append(f"---\nkind: metric\nname: {name}\nmodel: events\nmeasure: {{{m}}}\ntime_column: day\ngrains: [day, month]\n{metric_extra}\ndimensions:\n  - {{name: region, column: region, values: [east, north]}}\n  - {{name: region_name, column: region_name, via: event_region, values: [Eastern, Northern]}}\n---\n")
    frames = {"events": spark.createDataFrame(rows, EVENTS), "regions": spark.createDataFrame(list(lookup), lookup_schema)}
    return Engine(spark, documents.catalog(texts), {"facts": frames.__getitem__, "names": frames.__getitem__})


def ask(e, metrics, dims=(), **more):
    more = {"grain": "day", "range": {"start": "2026-01-01", "end": "2026-01-03"}} | more
    return [tuple(r) for r in e.ask({"metrics": metrics, "dimensions": list(dims), **more}).rows()]


def test_totals_by_region_in_order(spark):
    assert ask(make(spark), ["total"], ["region"]) == [("east", D1, 350), ("east", D2, 150), ("north", D1, 400), ("north", D2, 1300), (None, D1, 50)]


def test_exact_sums(spark):
    e = make(spark)
    assert [r[1] for r in ask(e, ["wide_total"])] == [10**19 + 6, 15]
    assert [r[1] for r in ask(e, ["big_total"])] == [2**63, 6]
    assert [r[1] for r in ask(e, ["rate_total"])] == [2.25, 3.25]
    assert [r[1] for r in ask(e, ["mean"])] == [200.0, 725.0]


@pytest.mark.parametrize("metric", ["total", "mean", "codes", "share", "wide_total"])
def test_whole_and_split_agree(spark, metric):
    assert ask(make(spark, True), [metric], ["region_name"]) == ask(make(spark, False), [metric], ["region_name"])


def test_ratio_with_a_zero_subgroup_keeps_its_numerator(spark):
    assert ask(make(spark), ["share"], ["region_name"]) == [("Eastern", D1, 0.2), ("Eastern", D2, 0.6), ("Northern", D1, 0.5), ("Northern", D2, 0.0), (None, D1, 0.0)]


def test_remote_filter_drops_orphans(spark):
    filters = [{"dimension": "region_name", "op": "equals", "value": "Eastern"}]
    assert ask(make(spark), ["total"], (), filters=filters) == [(D1, 350), (D2, 150)]


def test_zero_denominator_that_fails(spark):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        ask(make(spark), ["inverse"], ["region"])
    assert ask(make(spark), ["inverse"], (), range={"start": "2026-01-02", "end": "2026-01-03"}) == [(D2, 1450 / 90)]


def test_ambiguous_lookup_fails_and_agreeing_copies_do_not(spark):
    same = (("east", "Eastern"), ("east", "Eastern"), ("north", "Northern"))
    assert ask(make(spark, lookup=same), ["total"], ["region_name"])[0] == ("Eastern", D1, 350)
    with pytest.raises(Exception, match="ambiguous_link"):
        ask(make(spark, lookup=(*same, ("east", "Orient"))), ["total"], ["region_name"])


def test_a_dimension_with_two_rows_for_one_key_is_refused(spark):
    same = (("east", "Eastern"), ("east", "Eastern"), ("north", "Northern"))
    e = make(spark, split=False, lookup=same)
    assert ask(e, ["total"], ["region_name"])[0] == ("Eastern", D1, 350) and sum(r[1] for r in ask(e, ["total"])) == 2250
    e = make(spark, split=False, lookup=(*same, ("east", "Orient")))
    with pytest.raises(Refusal, match="ambiguous_link"):
        ask(e, ["total"], ["region_name"])
    with pytest.raises(Refusal, match="ambiguous_link"):
        ask(make(spark, split=False, lookup=(*same, ("east", None))), ["total"], ["region_name"])
    with pytest.raises(Refusal, match="declared_key_not_unique"):
        e.check_keys()


@pytest.mark.parametrize("split", [True, False])
def test_a_link_value_that_does_not_cast_is_refused(spark, split):
    link = "---\nkind: relationship\nname: event_code\norigin: {model: events, column: code}\ntarget: {model: codes, column: n}\ncompare_as: exact_integer\n---\n"
    codes = f"---\nkind: model\nname: codes\nsource: {'names' if split else 'facts'}\ntable: codes\ncolumns: [{{name: n}}, {{name: word}}]\n---\n"
    metric = "---\nkind: metric\nname: coded\nmodel: events\nmeasure: {simple: {aggregate: sum, column: amount_cents}}\ntime_column: day\ngrains: [day]\ndimensions: [{name: word, column: word, via: event_code}]\n---\n"
    rows = [(D1, "east", 5, None, 0, 0.0, 0, "1"), (D1, "east", 7, None, 0, 0.0, 0, "02"), (D1, "east", 9, None, 0, 0.0, 0, None)]

    def run(extra):
        e = make(spark, split, extra=[codes, link, metric], rows=rows + extra)
        frames = {"codes": spark.createDataFrame([(1, "one"), (2, "two")], "n long, word string"), "events": spark.createDataFrame(rows + extra, EVENTS), "regions": spark.createDataFrame([], "region string, region_name string")}
        e.sources.places = dict.fromkeys(e.sources.places, frames.__getitem__)
        return ask(e, ["coded"], ["word"])

    assert run([]) == [("one", D1, 5), ("two", D1, 7), (None, D1, 9)]
    with pytest.raises(Refusal, match="link_value_not_cast"):
        run([(D1, "east", 1, None, 0, 0.0, 0, "x")])


def test_links_of_other_kinds_are_refused(spark):
    with pytest.raises(Refusal, match="federation_link_type_mismatch"):
        ask(make(spark, lookup=((1, "Eastern"),), lookup_schema="region long, region_name string"), ["total"], ["region_name"])
    with pytest.raises(Refusal, match="float_link_key"):
        ask(make(spark, lookup=((1.0, "Eastern"),), lookup_schema="region double, region_name string"), ["total"], ["region_name"])


def test_text_links_keep_case_and_blanks(spark):
    got = ask(make(spark, lookup=(("East", "Eastern"), ("north ", "Northern"))), ["total"], ["region_name"])
    assert got == [(None, D1, 800), (None, D2, 1450)]


def test_non_finite_measures_are_refused(spark):
    rows = [(D1, "east", 1, None, 0, float("inf"), 0, None)]
    with pytest.raises(Exception, match="non_finite"):
        ask(make(spark, rows=rows), ["rate_total"])


def test_rows_beyond_the_bound_are_refused(spark):
    e = make(spark)
    e.limits = e.planner.limits = Limits(rows=3)
    with pytest.raises(Refusal, match="result_too_large"):
        ask(e, ["total"], ["region"])


def test_top_puts_nulls_last_and_breaks_ties(spark):
    e = make(spark)
    assert ask(e, ["total"], ["region"], top={"n": 2}) == [("north", D2, 1300), ("north", D1, 400)]
    assert ask(e, ["codes"], ["region"], top={"n": 9, "direction": "asc"})[0] == (None, D1, 0)


def test_merge_has_one_row_for_null_keys(spark):
    a = spark.createDataFrame([(None, D1, 1), ("x", D1, 2)], "region string, period date, a int")
    b = spark.createDataFrame([(None, D1, 3), ("y", D1, 4)], "region string, period date, b int")
    c = spark.createDataFrame([("y", D1, 5)], "region string, period date, c int")
    got = {tuple(r) for r in full_merge([a, b, c], ["region", "period"]).collect()}
    assert got == {(None, D1, 1, 3, None), ("x", D1, 2, None, None), ("y", D1, None, 4, 5)}
    with pytest.raises(Refusal, match="key_kind_mismatch"):
        full_merge([a, b.withColumn("region", b.region.cast("int"))], ["region", "period"])


@pytest.mark.parametrize(
    ("code", "change"),
    [
        ("metric_unknown", {"metrics": ["nope"]}), ("duplicate_metric_name", {"metrics": ["total", "total"]}), ("grain_not_supported", {"grain": "year"}),
        ("too_many_metrics", {"metrics": [f"m{i}" for i in range(9)]}), ("dimension_not_permitted", {"dimensions": ["colour"]}),
        ("duplicate_dimension", {"dimensions": ["region", "region"]}), ("too_many_dimensions", {"dimensions": list("abcde")}),
        ("dimension_value_not_allowed", {"filters": [{"dimension": "region", "op": "in", "values": ["west"]}]}),
        ("time_range_too_long", {"range": {"start": "2000-01-01", "end": "2026-01-01"}}), ("result_too_large", {"top": {"n": 10_001}}),
        ("invalid_definition", {"colour": 1}), ("invalid_definition", {"range": {"start": "2026-01-02", "end": "2026-01-02"}}),
        ("too_many_filters", {"filters": [{"dimension": "region", "op": "equals", "value": "east"}] * 9}),
    ],
)
def test_refused_questions(spark, code, change):
    with pytest.raises(Refusal) as e:
        make(spark).ask({"metrics": ["total"], "grain": "day", "range": {"start": "2026-01-01", "end": "2026-01-03"}} | change)
    assert e.value.code == code and "west" not in str(e.value)


def test_relative_ranges():
    ask_ = lambda last: (lambda q: (q.start, q.end))(question({"metrics": ["m"], "grain": "day", "range": {"last": last}}, date(2026, 5, 20)))
    assert ask_({"count": 2, "unit": "week"}) == (date(2026, 5, 6), date(2026, 5, 20))
    assert ask_({"count": 1, "unit": "day", "include_current": True}) == (date(2026, 5, 20), date(2026, 5, 21))
    assert ask_({"count": 1, "unit": "quarter"}) == (date(2026, 1, 1), date(2026, 4, 1))
    assert ask_({"count": 2, "unit": "month", "include_current": True}) == (date(2026, 4, 1), date(2026, 5, 21))
    assert ask_({"count": 1, "unit": "year"}) == (date(2025, 1, 1), date(2026, 1, 1))


def test_catalog_rules(spark):
    bad = {
        "invalid_definition": ["---\nkind: relationship\nname: r2\norigin: {model: events, column: region}\ntarget: {model: regions, column: region}\njoin_type: one_to_many\n---\n", "---\nkind: relationship\nname: r3\norigin: {model: events}\ntarget: {model: regions}\n---\n", "---\nkind: verse\nname: x\n---\n", "no front matter"],
        "unknown_reference": ["---\nkind: relationship\nname: r4\norigin: {model: events, column: nope}\ntarget: {model: regions, column: region}\n---\n", "---\nkind: caveat\nname: c\nabout: [{metric: nope}]\n---\n"],
        "name_collision": [DOCS[0]],
    }
    for code, texts in bad.items():
        for text in texts:
            with pytest.raises(Refusal) as e:
                make(spark, extra=[text])
            assert e.value.code == code


def test_digest_and_composition(spark):
    a = documents.catalog([DOCS[0]])
    b = documents.catalog([DOCS[1] % "x"])
    assert digest(documents.catalog([DOCS[0] + "\n"])) == digest(a) != digest(b)
    assert set(compose(a, b).models) == {"events", "regions"}
    with pytest.raises(Refusal, match="name_collision"):
        compose(a, a)


def test_anchors_and_keys(spark):
    anchor = "anchor: {range: {start: 2026-01-01, end: 2026-01-03}, value: '2250'}"
    e = make(spark, metric_extra=anchor)
    with pytest.raises(Refusal, match="anchor_mismatch: mean"):
        e.check_anchors()
    assert rendered(Decimal("2250")) == "2250" and rendered(True) == "1" and rendered(None) is None
    keyed = DOCS[1].replace("columns:", "primary_key: region\ncolumns:").replace("regions", "places")
    e = make(spark, extra=[(keyed % "facts")])
    e.sources.places["facts"] = {"places": spark.createDataFrame([("a", "b"), ("a", "c")], "region string, region_name string")}.__getitem__
    with pytest.raises(Refusal, match="declared_key_not_unique"):
        e.check_keys() if "events" not in e.catalog.models else __import__("tallyloom.operators.probes", fromlist=["x"]).require_unique(e.sources.frame(e.catalog.models["places"]), ["region"], "places")


def test_describe_hides_other_audiences(spark):
    e = make(spark, metric_extra="audience: board")
    assert e.describe() == []
    with pytest.raises(Refusal, match="metric_unknown"):
        ask(e, ["total"])
    e.audience = "board"
    assert {m["metric"] for m in e.describe()} == set(MEASURES) and ask(e, ["total"])


def test_statements_over_models(spark):
    e = make(spark, extra=["---\nkind: model\nname: hidden\nsource: facts\ntable: secrets\naudience: board\ncolumns: [{name: region}]\n---\n"])
    text = "SELECT r.region_name, sum(e.amount_cents) AS s FROM events e JOIN regions r ON e.region = r.region GROUP BY r.region_name ORDER BY 1"
    assert [tuple(r) for r in e.sql(text).rows()] == [("Eastern", 500), ("Northern", 1700)]
    e.federated_statements = False
    with pytest.raises(Refusal, match="too_many_sources"):
        e.sql(text)
    assert e.sql("SELECT count(*) AS n FROM events").rows()[0]["n"] == 6
    for bad in ("SELECT region FROM secrets", "SELECT wide, nope FROM nowhere"):
        with pytest.raises(Refusal, match="unknown_table"):
            e.sql(bad)
    assert set(e.describe_tables()) == {"events", "regions"}


def test_masks_hold_beneath_statements(spark):
    notes = "---\nkind: model\nname: notes\nsource: facts\ntable: notes\ncolumns: [{name: id, type: BIGINT}, {name: body, text_policy: {redactions: [{pattern: 'key[0-9]+', replacement: '[key]'}], clip_bytes: 64}}]\n---\n"
    e = make(spark, extra=[notes])
    e.sources.places["facts"] = {"notes": spark.createDataFrame([(1, "a key12 b"), (2, "none")], "id long, body string")}.__getitem__
    assert e.sql("SELECT id FROM notes WHERE body LIKE '%key1%'", ["notes"]).rows() == []
    assert [tuple(r) for r in e.sql("SELECT body, length(body) AS n FROM notes WHERE body LIKE '%[key]%'", ["notes"]).rows()] == [("a [key] b", 9)]
    with pytest.raises(Refusal, match="protected"):
        make(spark, extra=[notes, "---\nkind: metric\nname: m\nmodel: notes\nmeasure: {simple: {aggregate: min, column: body}}\ntime_column: id\ngrains: [day]\n---\n"])


def test_answers_hold_all_rows_and_only_rows_refuses(spark):
    n = 10_050
    e = make(spark, rows=[(D1, f"r{i:05d}", 1, None, 0, 0.0, 0, None) for i in range(n)])
    asked = {"metrics": ["total"], "dimensions": ["region"], "grain": "day", "range": {"start": "2026-01-01", "end": "2026-01-03"}}
    for code, answer in (("result_too_large", e.ask(asked)), ("too_many_rows", e.sql("SELECT region, sum(amount_cents) AS total FROM events GROUP BY region ORDER BY region"))):
        assert [r["region"] for r in answer.df.collect()] == [f"r{i:05d}" for i in range(n)]
        with pytest.raises(Refusal, match=code):
            answer.rows()
