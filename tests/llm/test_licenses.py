"""The licence scan: base phrases against SQL, notices against a plain search."""

import duckdb
from fleetlens.llm.licenses import BASE, NOTICES, scan_licenses

SF = "/root/testdata/sf0.001"
BASE_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), places AS (
  SELECT k, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS start
  FROM texts, (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')) AS phrases(p, label)
)
SELECT doc_id, len(w)::BIGINT AS n_words, count(start) AS n_base, min(start)::BIGINT AS first_word, max(start)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM texts LEFT JOIN places USING (k) GROUP BY k, doc_id, w
"""

BASE_COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]


def by_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    return sorted(map(str, con.execute(BASE_SQL).fetchall()))


def by_scan(docs):
    return sorted(str(tuple(r)) for r in scan_licenses(docs).select(BASE_COLUMNS).collect())


def test_base_phrases_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert by_scan(docs) == by_sql(docs)


def test_base_phrases_of_odd_texts(spark, messy, empty):
    texts = [
        "Under the MIT License", "under the mit license under the mit license", "UNDER  the\n*MIT*-license.", "under the the mit license", "under the mit licenses",
        "cc-by-nc cc by nc 4", "CC\u00a0BY NC", "cc by by nc", "apache license version 2.0; Apache License, Version 2", "apache license version 20",
        "mit license under the", "\u00e9under the mit license", "under the mit license" * 3, " ".join(["under the mit license cc by nc"] * 40), "nc by cc", "apache apache license version 2", None, "", "...",
    ]
    docs = spark.createDataFrame([(i, t, "labels", 1) for i, t in enumerate(texts)] + [(3, "cc by nc", "x", 2), (None, "under the mit license", "x", 3)], "doc_id long, text string, labels string, word int")
    assert by_scan(docs) == by_sql(docs)
    short = messy.filter("doc_id IS NULL OR doc_id <> 5")
    assert by_scan(short) == by_sql(short) and scan_licenses(messy).count() == messy.count()
    assert scan_licenses(empty).count() == 0
    long = spark.createDataFrame([(1, "under the mit license cc by nc " * 30_000)], "doc_id long, text string")
    assert [tuple(r) for r in scan_licenses(long).select(BASE_COLUMNS).collect()] == [(1, 210_000, 60_000, 0, 209_997, "cc-by-nc,mit")]
    rows = {r["doc_id"]: r for r in scan_licenses(docs).collect()}
    assert rows[13]["n_base"] == 80 and rows[13]["score"] == 1.0 and rows[13]["labels"] == "cc-by-nc,mit"
    assert rows[16]["labels"] == "" and rows[16]["score"] == 0.0 and rows[16]["places"] == []


def test_notices(spark):
    filler = " ".join(f"w{i}" for i in range(50))
    rows, expected = [], {}
    for i, (label, text, _) in enumerate(NOTICES):
        words = text.split()
        rows.append((i, f"{filler} // {text.upper()}. {filler}"))
        expected[i] = label
        # One word more in a long notice.
        rows.append((100 + i, f"{filler} {' '.join([*words[:-2], 'really', *words[-2:]])} {filler}"))
    rows += [(1000 + i, f"{filler} word{i}") for i in range(300)]
    # The words without their order, and a notice without its mandatory phrase.
    rows.append((2000, " ".join(reversed(NOTICES[0][1].split()))))
    rows.append((2001, NOTICES[0][1].replace("without restriction", "with limits")))
    found = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in expected.items():
        assert label in found[i]["labels"].split(","), (i, label, found[i])
        assert any(p["label"] == label and p["start"] == 50 and p["score"] > 0.99 for p in found[i]["places"])
        if len(NOTICES[i][1].split()) > 20:
            assert label in found[100 + i]["labels"].split(","), (i, found[100 + i])
    assert all(r["labels"] == "" for i, r in found.items() if 1000 <= i <= 2001)
    assert set(BASE.values()) <= {label for label, _, _ in NOTICES}
