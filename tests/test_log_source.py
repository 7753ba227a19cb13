"""Log files to entries: formats, numbering, stitching, encodings, any block size."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetlens.sources.fleet import Fleet
from fleetlens.sources import logs as src


def one(spark, text, fn):
    df = spark.createDataFrame([(text,)], "line string")
    return df.select(fn(F.col("line")).alias("e")).first()["e"]


@pytest.mark.parametrize(
    "line, expected",
    [
        ("WARN  2024-01-01 00:00:01,250 [shard 3:main] raft - slow reply", ("WARN", datetime(2024, 1, 1, 0, 0, 1, 250000), "3", "raft", "slow reply")),
        ("INFO  2024-01-01 00:00:01 [shard 11] kafka - a - b", ("INFO", datetime(2024, 1, 1, 0, 0, 1), "11", "kafka", "a - b")),
        ("ERROR 2024-01-01 00:00:01.5 storage - x", ("ERROR", datetime(2024, 1, 1, 0, 0, 1, 500000), None, "storage", "x")),
        ("DEBUG 2024-01-01 00:00:01,123456 [shard 0:a] comp message here", ("DEBUG", datetime(2024, 1, 1, 0, 0, 1, 123000), "0", "comp", "message here")),
        ("\ufeff TRACE 2024-01-01T00:00:01 [shard 0] single", ("TRACE", datetime(2024, 1, 1, 0, 0, 1), "0", "single", "")),
    ],
)
def test_standard_line(spark, line, expected):
    assert tuple(one(spark, line, src.parse_standard_line)) == expected


@pytest.mark.parametrize("line", ["NOTICE 2024-01-01 00:00:01,250 raft - x", "INFO 2024-01-01 a - b", "INFO  yesterday 00:00:01,250 raft - x", "  at frame 2"])
def test_not_standard(spark, line):
    assert one(spark, line, src.parse_standard_line) is None


def test_other_lines(spark):
    k8s = one(spark, '2024-01-01T00:00:01Z level="warn" retry', src.parse_k8s_line)
    assert tuple(k8s) == ("WARN", datetime(2024, 1, 1, 0, 0, 1), None, "k8s-sidecar", 'level="warn" retry')
    assert one(spark, "2024-01-01T00:00:01Z plain", src.parse_k8s_line)["level"] == "INFO"
    assert one(spark, "2024-01-01T00:00:01Z x level=debug y", src.parse_k8s_line)["level"] == "DEBUG"
    full = one(spark, '{"level":"info","ts":"2024-01-01T00:00:01Z","msg":"up","logger":"l"}', src.parse_json_line)
    assert tuple(full) == ("INFO", datetime(2024, 1, 1, 0, 0, 1), None, "l", "up")
    bare = one(spark, ' {"timestamp":"2024-01-01T00:00:01.5+01:00"} ', src.parse_json_line)
    assert tuple(bare) == ("INFO", datetime(2023, 12, 31, 23, 0, 1, 500000), None, "sidecar", '{"timestamp":"2024-01-01T00:00:01.5+01:00"}')
    assert one(spark, "{not json}", src.parse_json_line) is None
    csv = one(spark, '7,2024-01-01T00:00:01Z,error,"disk, ""slow"" today",x', src.parse_csv_line)
    assert tuple(csv) == ("ERROR", datetime(2024, 1, 1, 0, 0, 1), None, "csv-export", 'disk, "slow" today')
    zoned = one(spark, "2024-01-01 02:00:01.25 +0200 CEST,hello", src.parse_csv_line)
    assert tuple(zoned) == ("INFO", datetime(2024, 1, 1, 0, 0, 1, 250000), None, "csv-export", "hello")
    assert one(spark, "no,time", src.parse_csv_line) is None


def stitched_model(text: str):
    """Plain model: (line number, message) of the entries of one standard log."""
    out = []
    for number, line in enumerate(text.split("\n"), 1):
        if not line:
            continue
        if line.startswith("INFO  2024"):
            out.append([number, line.split(" - ", 1)[1].strip(), line])
        elif out:
            out[-1][1] += "\n" + line
            out[-1][2] += "\n" + line
        else:
            out.append([number, line, line])
    return [tuple(e) for e in out]


def make_log(n: int, lead: int = 0) -> str:
    lines = [f"banner {i}" for i in range(lead)]
    for i in range(n):
        lines.append(f"INFO  2024-01-01 00:00:{i % 60:02d},{i % 1000:03d} [shard {i % 4}] raft - message {i}")
        lines += [f"  at frame {j} of {i}" for j in range((i * 7) % 5)]
        if i % 11 == 0:
            lines.append("")
        if i % 97 == 0:
            lines.append("x" * 60_000)
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("split", [None, 700])
def test_stitch_any_split(spark, fleet_dir, split):
    texts = {"b1": make_log(200, lead=40), "b2": make_log(60), "b3": "only\nplain\n\ntext"}
    for bundle, text in texts.items():
        fleet_dir(bundle, "redpanda.log", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split or 1 << 27))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = src.scan_logs(Fleet(spark, fleet_dir.root))
        rows = df.select("bundle_id", "line_number", "message", "raw", "id", "node").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for bundle, text in texts.items():
        got = sorted((r["line_number"], r["message"], r["raw"]) for r in rows if r["bundle_id"] == bundle)
        assert got == stitched_model(text)
    assert len({(r["bundle_id"], r["id"]) for r in rows}) == len(rows)


def scan_in_splits(spark, fleet, split, **options):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return src.scan_logs(fleet, **options).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_file_without_headers_stays_in_pieces(spark, fleet_dir):
    """200 000 lines that no header opens: rows of bounded size that give the file back in order."""
    lines = [f"plain line {i} of a file that has no header" for i in range(200_000)]
    fleet_dir("b1", "redpanda.log", "\n".join(lines) + "\n")
    found = sorted(scan_in_splits(spark, Fleet(spark, fleet_dir.root), 300_000, piece_bytes=50_000, entry_bytes=1_000_000), key=lambda r: r["piece"])
    assert [r["piece"] for r in found] == list(range(len(found))) and len(found) > 150
    assert max(len(r["raw"]) for r in found) < 51_000 and "\n".join(r["raw"] for r in found) == "\n".join(lines)
    assert all(r["message"] == r["raw"] and r["component"] == "stdout" and r["level"] == "INFO" for r in found)
    assert [r["line_number"] for r in found] == sorted(r["line_number"] for r in found) and len({r["id"] for r in found}) == len(found)
    for r in found[:5]:
        assert r["raw"].split("\n")[0] == lines[r["line_number"] - 1]


@pytest.mark.parametrize("split", [400, 3000, 1 << 27])
@pytest.mark.parametrize("entry_bytes", [0, 500, 1 << 20])
def test_pieces_like_model(spark, fleet_dir, split, entry_bytes):
    """Entries over the bound come in pieces, others whole, at every split size."""
    text = make_log(120, lead=30)
    fleet_dir("b1", "redpanda.log", text)
    found = scan_in_splits(spark, Fleet(spark, fleet_dir.root), split, piece_bytes=90, entry_bytes=entry_bytes)
    rows = sorted((r["line_number"], r["piece"], r["message"], r["raw"], r["level"], r["component"]) for r in found)
    whole, at = [], []
    for number, piece, message, raw, level, component in rows:
        if piece == 0:
            whole.append([number, message, raw])
            at.append((level, component, 0))
        else:
            assert piece == at[-1][2] + 1 and (level, component) == at[-1][:2]
            at[-1] = (level, component, piece)
            whole[-1][1] += "\n" + message
            whole[-1][2] += "\n" + raw
    assert [tuple(e) for e in whole] == stitched_model(text)
    sizes = [sum(len(x) + 1 for x in e[2].split("\n")) for e in whole]
    assert all(a[2] == 0 for a, n in zip(at, sizes) if n <= entry_bytes)


def test_files_nodes_and_encodings(spark, fleet_dir):
    line = "WARN  2024-01-01 00:00:01,250 [shard 3:main] raft - slów reply"
    fleet_dir("b1", "redpanda.log", line + "\r\nmore\r\n")
    fleet_dir("b1", "logs/deep/node-1.txt", b"\xff\xfe" + f"{line}\r\n\u0142 tail\r\n{line}\n".encode("utf-16-le"))
    fleet_dir("b1", "logs/x.csv", "2024-01-01T00:00:01Z,ERROR,disk is slow\nrest\n")
    fleet_dir("b1", "logs/skipped.json", line)
    fleet_dir("b2", "logs/s.log", '{"level":"warn","msg":"m"}\n')
    rows = src.scan_logs(Fleet(spark, fleet_dir.root)).collect()
    seen = {(r["bundle_id"], r["node"], r["line_number"], r["level"], r["message"]) for r in rows}
    assert seen == {
        ("b1", "redpanda", 1, "WARN", "slów reply\nmore"),
        ("b1", "node-1", 1, "WARN", "slów reply\n\u0142 tail"),
        ("b1", "node-1", 3, "WARN", "slów reply"),
        ("b1", "x", 1, "ERROR", "disk is slow\nrest"),
        ("b2", "s", 1, "WARN", "m"),
    }


def test_logs_only(spark, fleet_dir):
    fleet_dir("b1", "a.log", "INFO  2024-01-01 00:00:01,250 [shard 3:main] raft - x\n")
    fleet_dir("b1", "b.txt", "INFO  2024-01-01 00:00:01,250 [shard 3:main] raft - y\n")
    fleet_dir("b1", ".hidden.log", "z\n")
    fleet_dir("b1", "messages", "INFO  2024-01-01 00:00:01,250 [shard 3:main] raft - z\n")
    fleet_dir("b1", "logs/in.log", "INFO  2024-01-01 00:00:01,250 [shard 3:main] raft - w\n")
    fleet_dir("b1", "t.csv", "2024-01-01T00:00:01Z,ERROR,from csv\n")
    rows = src.scan_logs(Fleet(spark, fleet_dir.root), logs_only=True).collect()
    assert sorted(r["message"] for r in rows) == ["from csv", "w", "x", "y", "z"]
