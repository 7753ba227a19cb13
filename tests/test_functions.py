"""Column functions against plain models, with random input."""

import random
import sqlite3

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fleetlens.functions import raft, rules, search, text

DELIMS = " \t\n\r[]{}(),:=;<>/\\|-#"


def model_fingerprint(message: str) -> str:
    out, i = [], 0
    while i < len(message):
        c = message[i]
        if c in "\"'":
            end = message.find(c, i + 1)
            out.append("<STR>")
            i = len(message) if end < 0 else end + 1
        elif c in DELIMS:
            out.append(c)
            i += 1
        else:
            j = i
            while j < len(message) and message[j] not in DELIMS:
                j += 1
            token = message[i:j]
            digits = [d for d in token if d in "0123456789"]
            if token[:2] in ("0x", "0X"):
                out.append("<HEX>")
            elif digits and all(d in "0123456789." for d in token):
                out.append("<NUM>")
            else:
                out.append("<*>" if digits else token)
            i = j
    return "".join(out)


def evaluate(spark, values, fn, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_fingerprint_random(spark):
    rng = random.Random(7)
    alphabet = list("ab0x9.X\"'é-: \n<>#/") + ["0x", "\"'", "12.5", "ts=", "\U0001f600"]
    values = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24))) for _ in range(20_000)]
    values += ["word " * 50_000 + "7", '"' * 30_001, "a'b" * 20_000, "." * 1000 + "5", "٢ arabic digit"]
    got = evaluate(spark, values, text.fingerprint)
    wrong = [(v[:80], g[:80], model_fingerprint(v)[:80]) for v, g in zip(values, got) if g != model_fingerprint(v)]
    assert not wrong, wrong[:5]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab 0x1.\"'-:\t", max_size=30), min_size=50, max_size=200))
def test_fingerprint_property(spark, values):
    assert evaluate(spark, values, text.fingerprint) == [model_fingerprint(v) for v in values]


@pytest.mark.parametrize("value, expected", [
    ("1.2M", 1258291), ("3G", 3 << 30), ("500K", 512000), ("500KB", 512000), ("2TB", 2 << 40), ("7B", 7), ("0", 0), ("", 0), (" 12 ", 12), ("1.5k", None), ("x", None), ("1e3", 1000)])
def test_size(spark, value, expected):
    assert evaluate(spark, [value], text.size_to_bytes) == [expected]


def test_units(spark):
    assert evaluate(spark, [0.0, 1023.0, 1024.0, 1152.0, 1.5 * 2**30], text.format_bytes, "double") == ["0 B", "1023 B", "1.00 KB", "1.12 KB", "1.50 GB"]
    assert evaluate(spark, [5.0, 999.994, 1500.0, 90_000.0, 7_260_000.0], text.format_ms, "double") == ["5.00 ms", "999.99 ms", "1.50 s", "1m 30.00s", "2h 1.00m"]
    assert evaluate(spark, [0.0, 4.0], lambda c: text.percent(F.lit(1.0), c), "double") == [0.0, 25.0]


def test_versions(spark):
    values = ["25.1.5", "v25.1.5", "25.1.4", "25.2", "25.1", "24.9.9", "25.1.5.1", "25.x.9"]
    assert evaluate(spark, values, lambda c: text.version_at_least(c, "25.1.5")) == [True, True, False, True, False, False, True, False]


def test_addresses(spark):
    values = ["8.8.8.8", "10.1.1.1", "172.15.0.1", "172.16.0.1", "172.31.9.9", "172.32.0.1", "192.168.1.1", "192.169.1.1", "100.63.0.1", "100.64.0.1", "100.128.0.1", "localhost", "a.b.local", "host", "::1", ""]
    expected = [True, False, True, False, False, True, False, True, True, False, True, False, False, False, False, False]
    assert evaluate(spark, values, text.is_public_address) == expected
    assert evaluate(spark, ["10.0.0.1:9092", "[::1]:5"], text.address_port) == ["9092", "5"]


def test_paths_and_names(spark):
    hit = evaluate(spark, ["/v/kafka/t-1/3_15/0-1-v1.log", "/v/kafka/t/3_15/0.index", "/kafka/a/kafka/t/1_2/x.log"], text.segment_path)
    assert tuple(hit[0]) == ("/v", "t-1", 3, 15) and hit[1]["topic"] is None and hit[2]["topic"] == "t"
    assert evaluate(spark, ["nvme0q1", "eth0-TxRx-0", "timer"], text.irq_base_device) == ["nvme0", "eth0", "timer"]
    assert evaluate(spark, ["always [madvise] never", "[never] x", "always"], text.selected_option) == ["madvise", "never", "unknown"]
    labels = [{"b": "2", "a": "1"}, {}, None]
    assert evaluate(spark, labels, text.series_label, "map<string,string>") == ["a=1, b=2", "value", "value"]


def test_json(spark):
    doc = '{"a":{"b":[{"c":7},{"c":"x"}]},"d e":1,"l":[3,1,2]}'
    for path, expected in (("a.b.[1].c", "x"), ("a.b.x[0].c", None), ("a.b.[0].c", "7"), ("d e", "1"), ("a.z", None), ("l.[2]", "2"), ("", doc)):
        want = expected if path != "a.b.x[0].c" else "7"
        assert evaluate(spark, [doc], lambda c, p=path: text.json_at(c, p)) == [want], path
    assert evaluate(spark, [doc, "[1,2,3]"], lambda c: text.json_children(c, 1, 2)) == [["d e", "l"], ["2", "3"]]


def test_highlight(spark):
    assert evaluate(spark, ['a <b> "Foo" foo & bar'], lambda c: text.highlight(c, ["foo", "<b"])) == ["a <mark>&lt;b</mark>&gt; &#34;<mark>Foo</mark>&#34; <mark>foo</mark> &amp; bar"]
    assert evaluate(spark, ["0123456789needle0123456789", "none"], lambda c: text.snippet(c, "Needle", 4)) == ["6789needle0123", None]


WORDS = ["leader", "term", "attempt", "to", "move", "replica", "down", "raft", "is", "a", "Timeout", "x9"]


def fts_rows(messages, query, ignore=None):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(message_lower, tokenize='trigram')")
    con.executemany("INSERT INTO t(rowid, message_lower) VALUES (?, ?)", [(i, m.lower()) for i, m in enumerate(messages)])
    return [r[0] for r in con.execute("SELECT rowid FROM t WHERE t MATCH ? ORDER BY rowid", (query,))]


@pytest.mark.parametrize("query, fts", [
    ("leader", '"leader"'), ("lead term", '"lead" "term"'), ("attempt to move", '"attempt" "to" "move"'), ("to", '"to"'), ("attempt AND to", '"attempt" AND "to"'),
    ("attempt OR timeout", '"attempt" OR "timeout"'), ("leader NOT term", '"leader" NOT "term"'), ("leader NOT to", '"leader" NOT "to"'),
    ('"leader term" OR raft', '"leader term" OR "raft"'), ("leader or term and raft", '"leader" OR "term" AND "raft"'), ("leader term NOT raft OR down", '"leader" "term" NOT "raft" OR "down"'),
    ("message:leader", 'message_lower:"leader"'), ("(leader OR raft)", '("leader" OR "raft")'), ("AND leader OR", '"leader"'), ("TIMEOUT", '"timeout"')])
def test_search_like_index(spark, query, fts):
    rng = random.Random(3)
    messages = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(messages)), "i int, m string")
    got = sorted(r["i"] for r in df.filter(search.search_predicate(query, F.col("m"))).collect())
    assert got == fts_rows(messages, fts)


def test_search_kept_operators(spark):
    df = spark.createDataFrame([(0, "alpha beta"), (1, "alpha"), (2, "beta"), (3, "gamma")], "i int, m string")

    def ids(query, ignore=None, **kw):
        p = search.search_predicate(query, F.col("m"), ignore=ignore, **kw)
        return sorted(r["i"] for r in (df if p is None else df.filter(p)).collect())

    assert ids("alpha AND NOT beta") == [1]
    assert ids("(alpha OR gamma) NOT beta") == [1, 3]
    assert ids("(alpha) AND (beta)") == [0]
    assert ids("NOT alpha") == [2, 3] and ids("NOT alpha AND beta") == [1, 2, 3]
    assert ids("", "alpha") == [2, 3] and ids("beta", "NOT alpha") == [2] and ids("") == [0, 1, 2, 3]
    assert ids("NOT alpha", "gamma") == [2]
    assert ids("be", min_term_len=2) == [0, 2] and ids("be") == []
    assert ids(") alpha (") == [0, 1] and ids("()") == [0, 1, 2, 3]


def test_insights(spark):
    messages = ["VOTE_STM.CC x error code: 10", "x raft::errc::timeout", "bad_alloc then broken pipe", "schema_registry has an ERROR", "nothing"]
    df = spark.createDataFrame(list(enumerate(messages)), "i int, message string")
    got = [r["description"] for r in rules.with_insight(df).orderBy("i").collect()]
    assert got == ["Raft vote timed out", "Raft request timed out", "Memory allocation failed", "The schema registry reported an error", None]
    assert len(rules.INSIGHT_RULES) == 35
    frames = [("x persistent_size", "main"), ("x persistent_size", "fetch"), ("SSL_accept reactor::run", "m"), ("plain", "m")]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(frames)], "i int, b string, g string")
    got = [r["o"] for r in df.select("i", rules.profile_insight(F.col("b"), F.col("g")).alias("o")).orderBy("i").collect()]
    assert [g[:5] for g in got] == ["Segme", "", "TLS: ", ""]


def test_raft(spark):
    m = ["[{kafka/t-1.x/7}] became the leader term 12", "[heartbeats_majority] Stepping down as leader in term 3", "x reasoning: leadership_transfer", "error code: 10", "is down", "plain"]
    assert evaluate(spark, m, lambda c: raft.event_type(F.lower(c))) == ["Elected", "Stepdown", None, "Timeout", "Health", None]
    assert evaluate(spark, m, raft.term)[:2] == [12, 3]
    assert evaluate(spark, m, raft.ntp)[0] == "kafka/t-1.x/7"
    assert evaluate(spark, m, raft.stepdown_reason)[1:3] == ["heartbeats_majority", "leadership_transfer"]
