from pyspark.sql import functions as F

from leadflow.functions.tables import spread
from leadflow.functions.text import not_blank, strip
from leadflow.operators import contacts, verify
from leadflow.plans import tools
from leadflow.plans.stages import Providers

SEARCH = [("acme|", '{"organic": [{"title": "Acme", "link": "https://acme.com/a", "snippet": "s"}]}')]
VERDICT = '[{"row_index": 0, "match": true, "confidence": 0.9, "reason": "seen", "suggested_domain": null}]'


def test_verdicts_are_read_once_and_later_stages_leave_the_search(spark):
    kept = {}

    def stage(df, label):
        assert label not in kept
        kept[label] = df.localCheckpoint()
        return kept[label]

    none = spark.createDataFrame([], "domain string, ordinal long, url string, text string")
    p = Providers(
        search=spark.createDataFrame(SEARCH, "request_key string, body string"),
        verdicts=spark.createDataFrame([(0, VERDICT)], "batch_id long, body string"),
        crawled=none.select("domain"), site_pages=none,
    )
    rows = spark.createDataFrame([(0, "Acme", "name", ""), (1, "Nobody", "name", "")], "row_index long, input string, input_type string, location string")
    out = tools.company_intel(rows, p, ["homepage_raw_text"], stage=stage)
    assert [e.asDict()["match"] for e in kept["verdicts"].first().entries] == [True]
    assert "search_results" in kept["resolved"].columns and "search_results" not in kept["verified"].columns
    found = {r.row_index: (r.raw_domain, r.status, r.verification_confidence) for r in out.collect()}
    assert found == {0: ("acme.com", "extracted", 0.9), 1: (None, "not_found", None)}


def test_answers_read_before_give_the_same_verdicts(spark):
    bodies = [(0, VERDICT), (1, "no JSON"), (2, '{"results": [{"row_index": 400, "match": 0, "confidence": "0.5", "reason": 1}]}'), (None, VERDICT)]
    resp = spark.createDataFrame(bodies, "batch_id long, body string")
    sent = spark.createDataFrame([(0, 0), (1, 1), (20, 400), (None, 7)], "batch_id long, row_index long")
    direct = verify.parse_verdicts(sent, resp)
    twice = verify.settle_verdicts(sent, verify.read_verdicts(spread(resp, "batch_id")).localCheckpoint())
    assert sorted(map(repr, direct.collect())) == sorted(map(repr, twice.collect()))


def test_spread_keeps_its_tasks(spark):
    rows = spark.range(100).groupBy("id").count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    assert spread(rows, "id").rdd.getNumPartitions() == tasks


def test_strip_takes_every_white_space_at_both_ends(spark):
    texts = [None, "", "  ", "a", " a b ", "\xa0a", "a\x1f", "  é ", "\n a\n b\t", "\x7fa", "~", " \x85 "]
    white = "".join(c for c in map(chr, range(0x3100)) if c.isspace())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.orderBy("i").select(strip("t"), not_blank("t")).collect()
    assert [tuple(r) for r in got] == [(None, None) if t is None else (t.strip(white), t.strip(white) != "") for t in texts]


def test_titles_by_one_pattern(spark):
    titles = {
        "CEO office of | x": True, "CEO office of x": False, "CEO office of": True, "CEO office of x | y": False, "x | CEO": False,
        "CEO|assistant": True, "assistant|sales": True, "c.e.o": True, "to the CEO": False, "\xa0": False, "| CEO": False,
    }
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    kept = contacts.title_filter(df, ["CEO", "Sales"])
    assert {r.title for r in kept.collect()} == {t for t, fits in titles.items() if fits}
    # no function that Spark interprets row by row
    assert "exists" not in kept._jdf.queryExecution().optimizedPlan().toString()
