"""Language, quality, pseudonyms and chat formatting."""

import json
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import chat_format as chat
from fleetlens.llm import language, perplexity, pseudonyms
from fleetlens.session import drop_staged, staging_scope
from tests.llm.conftest import SF


def test_forward_backward():
    rng = np.random.default_rng(0)
    for lengths in ([1], [31, 32, 33], [100, 1, 64, 65, 200]):
        scores, texts = rng.normal(0, 3, (sum(lengths), 3)), np.repeat(np.arange(len(lengths)) * 2, lengths)
        start, moves = rng.normal(0, 1, 3), rng.normal(0, 1, (3, 3))
        got, at = language.forward_backward(scores, texts, start, moves), 0
        for n in lengths:
            x = scores[at : at + n]
            ahead, back = np.zeros((n, 3)), np.zeros((n, 3))
            ahead[0] = start + x[0]
            for t in range(1, n):
                ahead[t] = np.logaddexp.reduce(ahead[t - 1][:, None] + moves, axis=0) + x[t]
            for t in range(n - 2, -1, -1):
                back[t] = np.logaddexp.reduce(moves + (x[t + 1] + back[t + 1])[None], axis=1)
            want = np.exp(ahead + back - (ahead + back).max(1, keepdims=True))
            assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
            at += n


@pytest.fixture(scope="module")
def crf(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language.train_on(docs.filter(language.learnable()), docs_per_lang=60)


def test_held_out_accuracy(spark, crf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(~language.learnable())
    out = language.predict(docs, crf).join(docs.select("doc_id", "lang"), "doc_id")
    assert out.filter(F.col("lang") == F.col("lang_pred")).count() >= 0.97 * docs.count()


def test_code_switched(spark, crf, documents):
    by = {r.lang: r.text for r in documents.groupBy("lang").agg(F.max_by("text", "n_chars").alias("text")).collect()}
    both = by["de"][:600] + " " + by["es"][:300]
    row = language.predict(spark.createDataFrame([(1, both)], "doc_id long, text string"), crf).first()
    assert row.lang_pred == "de" and 0.5 < row.score < 0.8 and row.shares["es"] > 0.2 and row.n_switches >= 1


def test_language_odd_rows(spark, crf, messy, empty):
    rows = language.predict(messy, crf).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == messy.count() and all(got[d].lang_pred == "und" and got[d].score == 0 for d in (1, 2, 3, 11))
    assert got[4].lang_pred != "und" and got[12].lang_pred != "und"
    assert language.predict(empty, crf).count() == 0
    none = language.train_on(empty)
    assert {r.lang_pred for r in language.predict(messy, none).collect()} == {"und"}


def brute_model(texts):
    """Interpolated modified Kneser-Ney of character 5-grams, by dictionaries."""
    n = perplexity.ORDER
    grams = Counter()
    for t in texts:
        line = "\0" * (n - 1) + t + "\1"
        grams.update(line[i : i + n] for i in range(len(t) + 1))
    counts = {n: grams}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, contexts = {}, {}
    for k, c in counts.items():
        seen = Counter(v for v in c.values() if v <= 4)
        y = seen[1] / (seen[1] + 2 * seen[2])
        d = [1 - 2 * y * seen[2] / seen[1], 2 - 3 * y * seen[3] / seen[2], 3 - 4 * y * seen[4] / seen[3]] if seen[1] and seen[2] and seen[3] else [0.5, 0.75, 0.9]
        discounts[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
        contexts[k] = defaultdict(lambda: [0, 0.0])
        for g, v in c.items():
            contexts[k][g[:-1]][0] += v
            contexts[k][g[:-1]][1] += discounts[k][min(v, 3) - 1]

    def p(g, k):
        if k == 0:
            return 1 / 4096
        below = p(g[1:], k - 1)
        if g[:-1] not in contexts[k]:
            return below
        total, left = contexts[k][g[:-1]]
        v = counts[k].get(g, 0)
        return (v - discounts[k][min(v, 3) - 1] if v else 0) / total + left / total * below

    def score(t):
        line = "\0" * (n - 1) + t + "\1"
        return math.exp(-sum(math.log(p(line[i : i + n], n)) for i in range(len(t) + 1)) / (len(t) + 1))

    return score


def test_perplexity_brute_force(spark, documents, sample):
    texts = {d: t for d, t in sample}
    trusted = [d for d in list(texts)[:60] if len(texts[d]) < 3000]
    model = perplexity.train(documents.filter(F.col("doc_id").isin(trusted)))
    score = brute_model([texts[d] for d in trusted])
    some = [d for d in texts if len(texts[d]) < 1500][:60]
    got = {r.doc_id: r.perplexity for r in perplexity.perplexities(documents.filter(F.col("doc_id").isin(some)), model).collect()}
    for d in some:
        assert got[d] == pytest.approx(score(texts[d]), rel=2e-3)


def test_perplexity_of_many_characters(spark):
    """Texts over some thousand characters beyond the first plane of Latin, and some beyond 16 bits: every gram counts as itself."""
    rng = np.random.default_rng(4)
    alphabet = [chr(c) for c in (*range(0x4E00, 0x4E00 + 3000), *range(0x0E01, 0x0E2E), *range(0x1F600, 0x1F640))]
    phrases = ["".join(rng.choice(alphabet, 12)) for _ in range(400)]
    texts = ["".join(phrases[k] for k in rng.integers(0, 400, 12)) for _ in range(90)]
    docs = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = perplexity.train(docs.filter("doc_id < 60"))
    score = brute_model(texts[:60])
    got = {r.doc_id: r.perplexity for r in perplexity.perplexities(docs, model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(score(t), rel=1e-5)
    # A model that leaves a part out is the model of the other part.
    part = {r.doc_id for r in docs.filter("doc_id < 60").filter(perplexity.fold_of() == 1).collect()}
    held = {r.doc_id: r.perplexity for r in perplexity.perplexities(docs, model, 1).collect()}
    score = brute_model([t for i, t in enumerate(texts) if i in part])
    for i, t in enumerate(texts):
        assert held[i] == pytest.approx(score(t), rel=1e-5)


def test_training_leaves_only_the_model(spark, documents):
    """A table per order from 0 to 5; the counts they are made of are deleted."""
    with staging_scope(spark, "training"):
        perplexity.train(documents.filter("doc_id < 20"))
    assert drop_staged(spark, "training") == perplexity.ORDER + 1


def test_blocks_of_scores():
    rng = np.random.default_rng(1)
    for n in (1, 2, 9000):
        hashes = rng.integers(0, 2**64 - 1, n, np.uint64, endpoint=True)
        logs = np.log(rng.random(n)).astype(np.float32)
        block = perplexity.packed_block(hashes, logs)
        again, values = perplexity.unpacked_block(block)
        order = np.argsort(hashes)
        assert (again == hashes[order]).all() and (values == logs[order]).all()
    assert len(block) < 11 * n


def test_quality_separates(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = perplexity.quality(docs, labels).join(labels, "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {(r.quality, r.toxic): r.kept for r in out}
    assert kept[1, 0] > 0.98 and kept[0, 0] < 0.3


def test_quality_of_unseen_texts(spark):
    """Clean texts that the model has not seen are kept as trusted ones are, with little trusted text too."""
    rng = np.random.default_rng(1)
    rows = [(d, "".join(chr(97 + c) for c in rng.integers(0, 26, 300)), "xx") for d in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1, 0) for d in range(40)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.keep for r in perplexity.quality(docs, labels).collect()}
    assert sum(kept[d] for d in range(40)) == 40 and sum(kept[d] for d in range(40, 80)) >= 38


def test_quality_odd_rows(spark, messy, empty):
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, 0), (5, 1, 0), (8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = perplexity.quality(messy, labels).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == messy.count() and got[6].keep and got[1].perplexity is None and not got[1].keep and not got[2].keep and not got[12].keep
    assert perplexity.quality(empty, labels).count() == 0
    assert not any(r.keep for r in perplexity.quality(messy, labels.limit(0)).collect())


VALUES = [
    ("card 4539 1488 0343 6467 and 4539148803436467.", ["card", "card"]), ("no 1234567890123456 x", []), ("+1 (743) 555-3824 or (212) 555-1234, 212-555-1234", ["phone"] * 3),
    ("1999-12-31 31/12/1999 12/31/1999 5/6/2000 31.12.1999 9999-12-31 2023-02-30", ["date"] * 6), ("ip 1.2.3.4 999.1.1.1 255.255.255.255. v1.2.3", ["ip", "ip"]), ("ssn 123-45-6789 000-12-3456 899-99-9999", ["ssn", "ssn"]),
    ("ab.12@mail8.example.com, x@y.com x@y.com", ["email"] * 3), ('TOKEN = "24be64439e3e49cf46b2d7c9"', ["secret"]), ("plain text 42", []), (None, []), ("", []),
]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


@pytest.fixture(scope="module")
def pseudonyms_of(spark):
    def run(texts, key="k", invert=False):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [(r.text, list(r.kinds), r.n_pseudonyms) for r in pseudonyms.pseudonymise(df, key, invert).orderBy("doc_id").collect()]

    return run


def test_pseudonyms(pseudonyms_of):
    texts = [t for t, _ in VALUES]
    out = pseudonyms_of(texts)
    assert [(k, n) for _, k, n in out] == [(k, len(k)) for _, k in VALUES]
    assert pseudonyms_of([t for t, _, _ in out], invert=True) == [(t, k, len(k)) for t, k in VALUES]
    assert pseudonyms_of(texts, key="other") != out
    first, second = out[0][0][5:24], out[0][0][29:45]
    assert first.replace(" ", "") == second and luhn(second) and out[6][0].split()[1:] == [out[6][0].split()[1]] * 2
    again = pseudonyms_of(["x 4539148803436467 y 1999-12-31"])[0][0]
    assert second in again and out[3][0][:10] in again


def test_pseudonyms_permute(pseudonyms_of):
    """A bijection on whole small domains: no two values meet, each keeps its format."""
    days = [f"{d:02d}/{m:02d}/2001" for m in range(1, 13) for d in range(1, 29)] + [f"{m:02d}/{d:02d}/2001" for m in range(1, 13) for d in range(13, 29)]
    out = [t for t, _, _ in pseudonyms_of(days)]
    assert len(set(out)) == len(days) and all(len(t) == 10 for t in out)
    numbers = [f"10.0.{a}.{b}" for a in range(3) for b in range(256)] + [f"665-{g:02d}-0001" for g in range(1, 100)] + [f"667-{g:02d}-9999" for g in range(1, 100)]
    out = [t for t, _, _ in pseudonyms_of(numbers)]
    assert len(set(out)) == len(numbers)


def test_cards_beside_numbers(pseudonyms_of):
    """A card does not stay in clear because a short number stands beside it, nor does what stands in its run."""
    card, parts = "4111111111111111", "4111 1111 1111 1111"
    texts = [f"{parts} 12/28", f"{card} 123", f"5 {card}", f"1234 {parts}", "3782 822463 10005 7", f"{parts} 123-45-6789", f"{parts} 5500-0000-0000-0004", f"{card} 212-555-1234 1999-12-31", "1234567890 2023-01-02 1"]
    kinds = [["card"]] * 5 + [["card", "ssn"], ["card", "card"], ["card", "phone", "date"], ["date"]]
    out = pseudonyms_of(texts)
    assert [k for _, k, _ in out] == kinds and [len(t) for t, _, _ in out] == [len(t) for t in texts]
    assert not any(x in t for t, _, _ in out for x in (card, parts, "3782 822463 10005", "5500-0000-0000-0004", "123-45-6789", "212-555-1234"))
    assert out[0][0].endswith(" 12/28") and out[1][0].endswith(" 123") and out[2][0].startswith("5 ") and out[3][0].startswith("1234 ")
    assert [t for t, _, _ in pseudonyms_of([t for t, _, _ in out], invert=True)] == texts


def test_pseudonyms_odd_rows(messy, empty):
    out = pseudonyms.pseudonymise(messy, "k")
    assert out.count() == messy.count() and set(messy.columns) <= set(out.columns) and out.filter("doc_id = 1").first().text is None
    assert out.filter("doc_id = 5").first().text == messy.filter("doc_id = 5").first().text
    assert pseudonyms.pseudonymise(empty, "k").count() == 0


def test_records_of_many_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
        ({"prompt": "a", "response": "b"}, [("user", "a"), ("assistant", "b")]), ({"completion": "b", "prompt": "a"}, [("user", "a"), ("assistant", "b")]),
        ({"instruction": "a", "input": "", "output": "b"}, [("user", "a"), ("assistant", "b")]), ({"instruction": "a", "input": "i", "output": "b"}, [("user", "a\ni"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
        ({"system": "s", "prompt": "a", "response": "b"}, [("system", "s"), ("user", "a"), ("assistant", "b")]), ({"unknown": 1}, None), ({"messages": []}, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(records)] + [(90, None), (91, "no json")], "id long, record string")
    got = {r.id: r.turns for r in chat.turns_of_records(df, "record").collect()}
    for i, (_, want) in enumerate(records):
        assert (got[i] and [(t.role, t.text) for t in got[i]]) == want
    assert got[90] is None and got[91] is None


def test_records_with_json_texts(spark):
    """A text that is JSON is a text, and a further field changes nothing; an object in place of a text is another layout."""
    call, rows = '{"ok": true, "args": {"a": 1}}', '[{"a": 1}, {"b": 2}]'
    records = [
        ({"prompt": rows, "response": call}, [("user", rows), ("assistant", call)]), ({"instruction": call, "output": rows, "id": 7}, [("user", call), ("assistant", rows)]),
        ({"messages": [{"role": "user", "content": call, "name": "n"}], "id": "x", "tags": ["t"]}, [("user", call)]), ({"conv_id": 1, "prompt": "a", "completion": "b"}, [("user", "a"), ("assistant", "b")]),
        ({"conv_id": 1, "turn": 0, "role": "user", "text": rows}, [("user", rows)]), ({"prompt": "a", "response": {"ok": True}}, None), ({"system": "s", "prompt": "a", "completion": "b"}, None),
        ({"messages": json.dumps([{"role": "user", "content": "a"}])}, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(records)], "id long, record string")
    got = {r.id: r.turns for r in chat.turns_of_records(df, "record").collect()}
    for i, (_, want) in enumerate(records):
        assert (got[i] and [(t.role, t.text) for t in got[i]]) == want, i


def test_format_is_reversible(spark):
    rows = [(1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "user", "<|end|>\n<|turn|>x\n "), (1, 3, "we\nird", "<<|end|>"), (1, 4, "assistant", ""), (2, None, None, None), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 0, "user", "<s>")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = out.select("conv_id", "formatted", "loss_runs", chat.parsed(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted"), F.col("loss_runs")).alias("loss"))
    got = {r.conv_id: r for r in back.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", rows[1][3]), ("assistant", rows[0][3]), ("we\nird", "<<|end|>"), ("assistant", "")]
    assert got[1].loss == [rows[0][3], ""] and got[2].loss == ["a", "a"] and [(t.role, t.text) for t in got[2].turns] == [("", ""), ("assistant", "a"), ("assistant", "a")]
    for r in got.values():
        assert sum(x.chars for x in r.loss_runs) == len(r.formatted) and r.formatted.count(chat.TURN) == len(r.turns)
    assert got[None].turns[0].text == "<s>" and "<s>" not in got[None].formatted


def test_layout_unknown(spark):
    with pytest.raises(ValueError, match="no mapping"):
        chat.format_chats(spark.createDataFrame([(1, "x")], "conv_id long, other string"))
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_conversations_contract(spark):
    row = {r.conv_id: r for r in chat.op7_chat_formatting(spark, SF).collect()}[-7]
    assert (row.n_turns, row.loss_chars) == (2, len(chat.TRICKY))
    assert len(row.asDict()) and duckdb.connect().execute(f"SELECT count(DISTINCT conv_id) FROM '{SF}/conversations.parquet'").fetchone()[0] > 0


def test_pseudonyms_of_a_long_run(spark):
    """Thousands of numbers in one run, with cards among them: found in time that follows the length."""
    card = "4111 1111 1111 1111"
    numbers = [f"{i * 37 % 90 + 10}" for i in range(8_000)]
    numbers[1000] = numbers[7000] = card
    out = pseudonyms.pseudonymise(spark.createDataFrame([(1, " ".join(numbers))], "doc_id long, text string"), "k").first()
    got = out.text.split(" ")
    assert out.kinds.count("card") >= 2 and len(got) == 8_006
    assert got[1000:1004] == got[7003:7007] != card.split(" ") and got[:990] == numbers[:990]
