"""Host files of all bundles: one fact job, and narrow tables for lists.

The fact job reads every key/value file at once and applies a table of patterns; there
is no reader per file.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.text import to_number
from fleetlens.sources.fleet import Fleet, TableFleet


class FactRule(NamedTuple):
    """``pattern`` has two groups, key and value, and gives a fact per match; with a
    ``key`` it has one group and gives that fact from the first match."""

    source: str
    files: tuple[str, ...]
    pattern: str
    key: str | None = None


# Files and the facts in them.
FACT_RULES = [
    FactRule("sysctl", ("utils/sysctl.txt",), r"(?m)^[ \t]*([^=\n]+?)[ \t]*=[ \t]*([^\n]*?)[ \t\r]*$"),
    FactRule("meminfo", ("proc/meminfo",), r"(?m)^(AnonHugePages|Shmem|Slab|PageTables|Dirty|Writeback|Mapped|Active|Inactive):\s+(\d+)"),
    FactRule("vmstat", ("proc/vmstat",), r"(?m)^(ctxt|processes|procs_running|procs_blocked)\s+(\d+)"),
    FactRule("cpuinfo", ("proc/cpuinfo",), r"(?m)^model name\s*:[ \t]*([^\n]*)", "model name"),
    FactRule("cpuinfo", ("proc/cpuinfo",), r"(?m)^vendor_id\s*:[ \t]*([^\n]*)", "vendor_id"),
    FactRule("cpuinfo", ("proc/cpuinfo",), r"(?m)^cpu MHz\s*:[ \t]*([^\n]*)", "cpu MHz"),
    FactRule("cpuinfo", ("proc/cpuinfo",), r"(?m)^cache size\s*:[ \t]*([^\n]*)", "cache size"),
    FactRule("cpuinfo", ("proc/cpuinfo",), r"(?m)^flags\s*:[ \t]*([^\n]*)", "flags"),
    FactRule("mdstat", ("proc/mdstat",), r"(?m)^Personalities\s*:[ \t]*([^\n]*)", "personalities"),
    FactRule("free", ("utils/free.txt",), r"(?m)^Mem:\s+(\d+)(?:\s+\d+){5}", "mem_total"),
    FactRule("free", ("utils/free.txt",), r"(?m)^Mem:\s+\d+\s+(\d+)(?:\s+\d+){4}", "mem_used"),
    FactRule("free", ("utils/free.txt",), r"(?m)^Mem:(?:\s+\d+){2}\s+(\d+)(?:\s+\d+){3}", "mem_free"),
    FactRule("free", ("utils/free.txt",), r"(?m)^Mem:(?:\s+\d+){3}\s+(\d+)(?:\s+\d+){2}", "mem_shared"),
    FactRule("free", ("utils/free.txt",), r"(?m)^Mem:(?:\s+\d+){4}\s+(\d+)\s+\d+", "mem_buff_cache"),
    FactRule("free", ("utils/free.txt",), r"(?m)^Mem:(?:\s+\d+){5}\s+(\d+)", "mem_available"),
    FactRule("free", ("utils/free.txt",), r"(?m)^Swap:\s+(\d+)(?:\s+\d+){2}", "swap_total"),
    FactRule("free", ("utils/free.txt",), r"(?m)^Swap:\s+\d+\s+(\d+)\s+\d+", "swap_used"),
    FactRule("free", ("utils/free.txt",), r"(?m)^Swap:(?:\s+\d+){2}\s+(\d+)", "swap_free"),
    FactRule("dmi", ("utils/dmidecode.txt",), r"BIOS Information\s*\n(?:\t[^\n]*\n)*?\tVendor:[ \t]*([^\n]*)", "bios_vendor"),
    FactRule("dmi", ("utils/dmidecode.txt",), r"System Information\s*\n(?:\t[^\n]*\n)*?\tManufacturer:[ \t]*([^\n]*)", "manufacturer"),
    FactRule("dmi", ("utils/dmidecode.txt",), r"System Information\s*\n(?:\t[^\n]*\n)*?\tProduct Name:[ \t]*([^\n]*)", "product"),
    FactRule("thp", ("sys/kernel/mm/transparent_hugepage/enabled", "sys/kernel/mm/redhat_transparent_hugepage/enabled"), r"(?s)\A\s*(.*?)\s*\z", "enabled"),
    FactRule("dig", ("utils/dig.txt",), r"status:\s*([^,\n]*)", "status"),
    FactRule("ntp", ("utils/ntp.txt",), r'"(host|roundTripTimeMs|remoteTimeUTC|localTimeUTC|precisionMs|offset)"\s*:\s*"?([^",}\n]*)'),
    FactRule("cmdline", ("proc/cmdline", "proc/*/cmdline", "redpanda.cmdline"), r"(?s)\A(.*redpanda.*)\z", "cmdline"),
    FactRule("uname", ("utils/uname.txt",), r"(?s)\A\s*(\S+\s+\S+\s+\S+.*?)\s*\z", "line"),
    FactRule("top", ("utils/top.txt",), r"load average:\s*([0-9.]+),", "load_1m"),
    FactRule("top", ("utils/top.txt",), r"load average:\s*[0-9.]+,\s*([0-9.]+),", "load_5m"),
    FactRule("top", ("utils/top.txt",), r"load average:\s*[0-9.]+,\s*[0-9.]+,\s*([0-9.]+)", "load_15m"),
]
# Sources whose numbers are given in kB and reported in bytes.
KILOBYTES = {"meminfo", "free"}
CPU_FLAGS = ["avx", "avx2", "sse4_2", "fma", "hypervisor"]


def _pair_of(pattern: str):
    def build(hit: Column) -> Column:
        return F.struct(F.regexp_extract(hit, pattern, 1).alias("key"), F.regexp_extract(hit, pattern, 2).alias("value"))

    return build


def scan_host_facts(fleet: Fleet, rules: list[FactRule] = FACT_RULES) -> DataFrame:
    """(bundle_id, node, source, key, value) of all rules over all bundles.

    A file of a host lies in ``utils`` or ``proc``, or in a folder of these that has the name of its node
    (``utils/db-0/sysctl.txt``); without such a folder the node is empty. Several files of a node may
    carry one source: the first by path that yields the key counts.
    """
    by_source: dict[str, list[FactRule]] = {}
    for rule in rules:
        by_source.setdefault(rule.source, []).append(rule)
    parts = []
    # A folder of digits below proc is a process.
    folder = F.regexp_extract("file_path", r"/(?:utils|proc)/([^/]+)/[^/]+\z", 1)
    node = F.when(folder.rlike(r"\A\d+\z"), "").otherwise(folder)
    for source, group in by_source.items():
        text = F.replace(F.col("value"), F.lit("\u0000"), F.lit(" "))
        facts = []
        for rule in group:
            if rule.key is None:
                hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
                facts.append(F.transform(hits, _pair_of(rule.pattern)))
            else:
                one = F.struct(F.lit(rule.key).alias("key"), F.regexp_extract(text, rule.pattern, 1).alias("value"))
                facts.append(F.filter(F.array(one), lambda f: f["value"] != ""))
        files = group[0].files
        below = [re.sub(r"\A(utils|proc)/(?!\*)", r"\1/*/", f) for f in files]
        docs = fleet.documents(*dict.fromkeys([*files, *below]))
        rows = docs.select("bundle_id", node.alias("node"), "file_path", F.explode(F.concat(*facts)).alias("f"))
        value = F.trim(F.col("f.value"))
        if source in KILOBYTES:
            value = (value.try_cast("bigint") * 1024).cast("string")
        rows = rows.select("bundle_id", "node", F.lit(source).alias("source"), F.trim(F.col("f.key")).alias("key"), value.alias("value"), "file_path")
        parts.append(rows)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("bundle_id", "node", "source", "key").agg(F.min_by("value", "file_path").alias("value"))


def scan_core_counts(fleet: Fleet) -> DataFrame:
    """(bundle_id, cores): one processor file per core; only names are read."""
    files = fleet.binary("proc/cpuinfo-processor-*", content=False)
    return files.groupBy("bundle_id").agg(F.count("*").alias("cores"))


def _of_first_node(facts: DataFrame, source: str) -> DataFrame:
    """(bundle_id, value): one fact per bundle, of its first node by name."""
    rows = facts.filter(F.col("source") == source)
    return rows.groupBy("bundle_id").agg(F.min_by("value", F.struct(*[c for c in ("node", "key") if c in rows.columns])).alias("value"))


def command_lines(facts: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """(bundle_id, cmdline) of the broker process, else as its log prints it first."""
    known = _of_first_node(facts, "cmdline").select("bundle_id", F.col("value").alias("_known"))
    if logs is None:
        return known.withColumnRenamed("_known", "cmdline")
    printed = logs.filter(F.contains("raw", F.lit("command line:")))
    first = printed.groupBy("bundle_id").agg(F.min_by("raw", "id").alias("_printed"))
    both = known.join(first, "bundle_id", "full")
    return both.select("bundle_id", F.coalesce("_known", "_printed").alias("cmdline"))


def cpu_flags(facts: DataFrame) -> DataFrame:
    """The flags of interest among a host's CPU flags."""
    rows = facts.filter("source = 'cpuinfo' and key = 'flags'")
    return rows.select("bundle_id", F.filter(F.split("value", r"\s+"), lambda f: f.isin(CPU_FLAGS)).alias("flags"))


# Kernel release marks, in order of trial, and cloud marks in host names.
DISTROS = [
    (".el9", "RHEL/CentOS 9"), (".el8", "RHEL/CentOS 8"), (".el7", "RHEL/CentOS 7"), ("Ubuntu", "Ubuntu"), ("Debian", "Debian"),
    ("amzn2023", "Amazon Linux 2023"), ("amzn2", "Amazon Linux 2"), ("amzn", "Amazon Linux"), ("fc", "Fedora"), ("arch", "Arch Linux"),
    ("gentoo", "Gentoo"), ("alpine", "Alpine Linux"), ("rocky", "Rocky Linux"), ("alma", "AlmaLinux"),
]
CLOUDS = [("AWS", [".aws", "compute.internal"]), ("GCP", [".google", "gce"]), ("Azure", [".azure"])]
MACHINES = r"(?:^|\s)(x86_64|aarch64|arm64|x86|i386|i686)(?:\s|$)"
STATEFUL_POD = r"\A[a-z0-9]([-a-z0-9]*[a-z0-9])?(\.[a-z0-9]([-a-z0-9]*[a-z0-9])?)*-[0-9]+\z"
POD_PREFIX = "redpanda-"


def uname_facts(facts: DataFrame) -> DataFrame:
    """(bundle_id, kernel, hostname, release, version, distro, machine, operating_system,
    is_container, cloud), a row per bundle."""
    line = F.regexp_replace("value", r"\s+", " ")
    rows = _of_first_node(facts, "uname").select("bundle_id", line.alias("line")).withColumn("w", F.split("line", " "))
    rows = rows.select(
        "bundle_id", "line", F.col("w")[0].alias("kernel"), F.col("w")[1].alias("hostname"), F.col("w")[2].alias("release"),
        F.regexp_extract("line", r" (#.*?)(?= (?:x86_64|aarch64|arm64|GNU/Linux)(?: |$)|$)", 1).alias("version"),
    )
    distro = F.when(F.lit(False), F.lit(""))
    for mark, name in DISTROS:
        distro = distro.when(F.contains("release", F.lit(mark)), F.lit(name))
    for name in ("Ubuntu", "Debian"):
        distro = distro.when(F.contains("version", F.lit(name)), F.lit(name))
    cloud = F.when(F.lit(False), F.lit(""))
    for name, marks in CLOUDS:
        for mark in marks:
            cloud = cloud.when(F.contains("hostname", F.lit(mark)), F.lit(name))
    system = F.when(F.contains("line", F.lit("GNU/Linux")), "GNU/Linux").when(F.col("kernel") == "Linux", "Linux").otherwise("")
    container = F.col("hostname").rlike(STATEFUL_POD) | F.col("hostname").startswith(POD_PREFIX)
    return rows.select(
        "bundle_id", "kernel", "hostname", "release", "version", distro.otherwise("").alias("distro"),
        F.regexp_extract("line", MACHINES, 1).alias("machine"), system.alias("operating_system"), container.alias("is_container"),
        cloud.otherwise("").alias("cloud"),
    )


# --- tables -------------------------------------------------------------------------------

ORDER = ["block", "pos"]


def _split(line: Column) -> Column:
    return F.split(F.btrim(line, F.lit(" \t\r\n")), r"\s+")


def _fields(lines: DataFrame) -> DataFrame:
    return lines.withColumn("f", _split(F.col("value")))


def _int(column: Column) -> Column:
    return F.coalesce(column.try_cast("bigint"), F.lit(0).cast("bigint"))


def _f(at: int) -> Column:
    return F.get("f", F.lit(at))


def scan_filesystems(fleet: Fleet) -> DataFrame:
    """Mounts with sizes from the disk-free listing; a bundle without it gives its mount table."""
    df = _fields(fleet.lines("utils/df.txt")).filter((F.size("f") >= 7) & ~F.col("value").startswith("Filesystem"))
    listed = df.select(
        "bundle_id", _f(0).alias("filesystem"), _f(1).alias("type"), (_int(_f(2)) * 1024).alias("total"), (_int(_f(3)) * 1024).alias("used"),
        (_int(_f(4)) * 1024).alias("available"), _f(5).alias("use_percent"), _f(6).alias("mount_point"),
    )
    have = fleet.binary("utils/df.txt", content=False).select("bundle_id").distinct()
    mounts = _fields(fleet.lines("proc/mounts")).filter(F.size("f") >= 3).join(have, "bundle_id", "left_anti")
    zero = F.lit(0).cast("bigint")
    return listed.unionByName(
        mounts.select(
            "bundle_id", _f(0).alias("filesystem"), _f(2).alias("type"), zero.alias("total"), zero.alias("used"),
            zero.alias("available"), F.lit("-").alias("use_percent"), _f(1).alias("mount_point"),
        )
    )


def scan_processes(fleet: Fleet) -> DataFrame:
    """(bundle_id, pid, user, cpu, memory, command) below the process header."""
    rows = _fields(fleet.lines("utils/top.txt")).filter((F.size("f") >= 12) & _f(0).rlike(r"\A\d+\z"))
    return rows.select(
        "bundle_id", _f(0).alias("pid"), _f(1).alias("user"), F.coalesce(to_number(_f(8)), F.lit(0.0)).alias("cpu"),
        F.coalesce(to_number(_f(9)), F.lit(0.0)).alias("memory"), F.array_join(F.slice("f", F.lit(12), F.size("f")), " ").alias("command"),
    )


def _carried(lines: DataFrame, states: dict[str, Column]) -> DataFrame:
    """Adds a column per state: its last value that is not null, up to and with the line, in the order of the file.

    The state of a line depends on what its block has said, else on the last block before that said something. So each
    block is ordered by itself, and a table with a row per block carries values over block borders:
    files of any length are read by as many tasks as they have blocks. First blocks have nothing to take over, so
    only further ones are joined, one row for each split of a file.
    """
    # A number leads the keys: sorts hardly compare paths, which begin alike.
    file = ["_file", *[c for c in ("bundle_id", "file_path") if c in lines.columns]]
    block = [*file, "block"]
    lines = lines.withColumn("_file", F.xxhash64("file_path"))
    upto = Window.partitionBy(*block).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = lines.withColumns({f"_at_{name}": value for name, value in states.items()})
    said = local.groupBy(*block).agg(*[F.max_by(f"_at_{n}", F.when(F.col(f"_at_{n}").isNotNull(), F.col("pos"))).alias(f"_end_{n}") for n in states])
    before = Window.partitionBy(*file).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = said.select(*block, *[F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_in_{n}") for n in states]).filter("block > 0")
    joined = local.withColumns({n: F.last(f"_at_{n}", ignorenulls=True).over(upto) for n in states}).join(carried, block, "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.col(f"_in_{n}")) for n in states}).drop(*[f"_{k}_{n}" for n in states for k in ("at", "in")])


def _grouped(lines: DataFrame, opens: Column) -> DataFrame:
    """Adds ``group``: tells lines of different openings of a file apart, 0 before the first."""
    # The opening line's own place is as good as a running number, and needs no count over blocks.
    rows = _carried(lines, {"_opened": F.when(opens, F.xxhash64("block", "pos"))})
    return rows.withColumn("group", F.coalesce("_opened", F.lit(0).cast("bigint"))).drop("_opened")


# Socket states as printed.
STATES = ["ESTAB", "LISTEN", "TIME-WAIT", "CLOSE-WAIT", "FIN-WAIT-1", "FIN-WAIT-2", "SYN-SENT", "SYN-RECV"]


def scan_sockets(fleet: Fleet) -> DataFrame:
    """Sockets with TCP details from their continuation lines."""
    line = F.btrim("value", F.lit(" \t\r\n"))
    indented = F.col("value").startswith("\t") | F.col("value").startswith(" ")
    opens = ~indented & line.rlike(rf"\A(?:tcp|udp|ESTAB\S*|{'|'.join(STATES)})(?:\s|\z)") & (F.size(F.split(line, r"\s+")) >= 5)
    # Lines travel without their fields, and what a path tells is taken from it once a socket.
    lines = fleet.raw_lines("utils/ss.txt").select("file_path", *ORDER, "value", opens.alias("opens"), indented.alias("indented"))
    rows = _grouped(lines, F.col("opens")).filter("group <> 0 and (opens or indented)")
    text = F.when(F.col("indented"), F.struct(*ORDER, F.col("value").alias("t")))
    sockets = rows.groupBy("_file", "file_path", "group").agg(
        F.first(F.when(F.col("opens"), F.col("value")), ignorenulls=True).alias("value"),
        F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda x: x["t"]), " ").alias("info"),
    )
    named = _f(0).isin("tcp", "udp")
    shift = F.when(named, 1).otherwise(0)
    head = [F.get("f", shift + k).alias(name) for k, name in enumerate(("state", "recv_q", "send_q", "local_addr", "peer_addr"))]
    sockets = _fields(sockets).select(fleet.bundle_of(F.col("file_path")).alias("bundle_id"), F.when(named, _f(0)).otherwise("tcp").alias("netid"), *head, "info")

    def number(pattern: str, kind: str = "bigint") -> Column:
        # An empty text is no number; trying it would make and drop an exception a row.
        return F.nullif(F.regexp_extract("info", r"(?:^|\s)" + pattern, 1), F.lit("")).try_cast(kind)

    return sockets.select(
        "bundle_id", "netid", "state", "recv_q", "send_q", "local_addr", "peer_addr", number(r"retrans:(\d+)/").alias("retrans"), number(r"retrans:\d+/(\d+)").alias("retrans_total"),
        number(r"rto:([0-9.]+)", "double").alias("rto"), number(r"cwnd:(\d+)").alias("cwnd"), number(r"ssthresh:(\d+)").alias("ssthresh"),
        number(r"rtt:([0-9.]+)/", "double").alias("rtt"), number(r"rtt:[0-9.]+/([0-9.]+)", "double").alias("rtt_var"), number(r"mss:(\d+)").alias("mss"),
        F.nullif(F.regexp_extract("info", r"users:(\(\(.*?)\)\)", 1), F.lit("")).alias("process"),
    )


def scan_block_devices(fleet: Fleet) -> DataFrame:
    """(bundle_id, name, type, size, mount_point) from the tree listing or its JSON form."""
    docs = fleet.documents("utils/lsblk.txt")
    is_json = F.ltrim("value").startswith("{")
    kind = "struct<blockdevices:array<struct<name:string,type:string,size:string,mountpoint:string>>>"
    listed = docs.filter(is_json).select("bundle_id", F.explode(F.from_json("value", kind)["blockdevices"]).alias("d"))
    rows = docs.filter(~is_json).select("bundle_id", F.explode(F.split("value", "\n")).alias("line")).filter("line != '' and not startswith(line, 'NAME')")
    rows = rows.withColumn("f", F.split(F.btrim(F.regexp_replace("line", r"\A[ |\-└─├]+", ""), F.lit(" \t\r")), r"\s+")).filter(F.size("f") >= 4)
    mount = F.get(F.filter("f", lambda x: x.startswith("/")), F.lit(0))
    return listed.select("bundle_id", "d.name", "d.type", "d.size", F.col("d.mountpoint").alias("mount_point")).unionByName(
        rows.select("bundle_id", _f(0).alias("name"), _f(2).alias("type"), _f(3).alias("size"), mount.alias("mount_point"))
    )


def scan_interfaces(fleet: Fleet) -> DataFrame:
    """(bundle_id, name, flags, mtu, addresses) of the interface listing."""
    lines = fleet.lines("utils/ip.txt")
    opens = F.col("value").rlike(r"\A\d+: ")
    rows = _grouped(lines, opens).filter("group <> 0").withColumn("opens", opens)
    address = F.nullif(F.regexp_extract("value", r"\A\s+inet6? (\S+)", 1), F.lit(""))
    found = rows.groupBy("_file", "bundle_id", "file_path", "group").agg(
        F.max(F.when(F.col("opens"), F.col("value"))).alias("head"),
        F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, address.alias("a")))), lambda x: x["a"])).alias("addresses"),
    )
    return found.select(
        "bundle_id", F.regexp_extract("head", r"\A\d+: (.*?)(?:: |\z)", 1).alias("name"), F.regexp_extract("head", r"<([^>]*)>", 1).alias("flags"),
        F.coalesce(F.regexp_extract("head", r"mtu (\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint")).alias("mtu"), "addresses",
    )


def scan_raid(fleet: Fleet) -> DataFrame:
    """(bundle_id, name, state, devices, blocks, status) of software RAID arrays."""
    pattern = r"(?m)^(md[^:\n]*?)\s*:[ \t]*(\S+)[ \t]+(\S+)([^\n]*)(?:\n([^\n]*))?"
    docs = fleet.documents("proc/mdstat")
    rows = docs.select("bundle_id", F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("m"))
    group = lambda n: F.regexp_extract("m", pattern, n)
    devices = F.filter(F.split(F.trim(group(4)), r"\s+"), lambda d: d != "")
    return rows.select(
        "bundle_id", group(1).alias("name"), F.concat_ws(" ", group(2), group(3)).alias("state"), devices.alias("devices"),
        F.coalesce(F.regexp_extract(group(5), r"\A\s*(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint")).alias("blocks"),
        F.regexp_extract(group(5), r".*(\[[^\]]*\])", 1).alias("status"),
    )


def scan_irqs(fleet: Fleet, kind: str = "interrupts") -> DataFrame:
    """(bundle_id, irq_id, counts ARRAY<BIGINT>, controller, device) of ``interrupts`` or
    ``softirqs``; how many columns are counts is told by the header of the same file."""
    docs = fleet.documents(f"proc/{kind}")
    lines = F.split("value", "\n")
    header = F.size(F.filter(F.split(F.btrim(lines[0], F.lit(" \t\r")), r"\s+"), lambda c: c != ""))
    rows = docs.select("bundle_id", header.alias("cpus"), F.explode(F.slice(lines, F.lit(2), F.size(lines))).alias("line"))
    rows = rows.withColumn("f", F.split(F.btrim("line", F.lit(" \t\r")), r"\s+")).filter(F.size("f") >= F.col("cpus") + 1)
    counts = F.transform(F.slice("f", F.lit(2), F.col("cpus")), lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint")))
    rest = F.slice("f", F.col("cpus") + 2, F.size("f"))
    return rows.select(
        "bundle_id", F.regexp_replace(_f(0), r":\z", "").alias("irq_id"), counts.alias("counts"), rest.alias("rest")
    ).select(
        "bundle_id", "irq_id", "counts", F.get("rest", F.lit(0)).alias("controller"),
        F.when(F.size("rest") > 1, F.array_join(F.slice("rest", F.lit(2), F.size("rest")), " ")).otherwise(F.get("rest", F.lit(0))).alias("device"),
    )


def scan_vmstat(fleet: Fleet) -> DataFrame:
    """Means and maxima of runnable, blocked and I/O wait per bundle."""
    rows = _fields(fleet.lines("utils/vmstat.txt")).filter((F.size("f") >= 16) & _f(0).rlike(r"\A\d+\z"))
    r, b, wa = _int(_f(0)), _int(_f(1)), _int(_f(15))
    return rows.groupBy("bundle_id").agg(
        F.count("*").alias("samples"), F.avg(r).alias("avg_runnable"), F.avg(b).alias("avg_blocked"), F.avg(wa).alias("avg_iowait"),
        F.max(r).alias("max_runnable"), F.max(b).alias("max_blocked"), F.max(wa).alias("max_iowait"),
    )


def scan_oom(fleet: Fleet) -> DataFrame:
    """(bundle_id, kernel_time, process, message) of out-of-memory kills."""
    pattern = r"\[\s*(\d+\.\d+)\s*\]\s+(.*)\s+invoked oom-killer"
    rows = fleet.lines("utils/syslog.txt").filter(F.contains("value", F.lit("oom-killer")) & F.col("value").rlike(pattern))
    return rows.select(
        "bundle_id", F.regexp_extract("value", pattern, 1).alias("kernel_time"), F.regexp_extract("value", pattern, 2).alias("process"),
        F.col("value").alias("message"),
    )


# --- system activity report ----------------------------------------------------------------

# Files, the first of which counts, and sections.
SAR_FILES = ("utils/sar", "utils/sar.txt", "sar.txt", "sysstat/sar")
SAR_SECTIONS = ("cpu", "mem", "net", "tcp", "etcp")


def _sar_section(f: Column) -> Column:
    """The number of the section that a header opens; numbers aggregate without sorts."""
    at = lambda i: F.get(f, F.lit(i))
    return (
        F.when((at(1) == "CPU") & (at(2) == "%user"), SAR_SECTIONS.index("cpu"))
        .when(at(1).isin("kbmemfree", "kbmemused") & (F.size(f) >= 3), SAR_SECTIONS.index("mem"))
        .when((at(1) == "IFACE") & (at(2) == "rxpck/s"), SAR_SECTIONS.index("net"))
        .when((at(1) == "active/s") & (at(2) == "passive/s"), SAR_SECTIONS.index("tcp"))
        .when((at(1) == "atmptf/s") & (at(3) == "retrans/s"), SAR_SECTIONS.index("etcp"))
    )


def _sar_banner(f: Column) -> Column:
    return (F.get(f, F.lit(0)) == "Linux") & (F.size(f) >= 4)


def _sar_day(f: Column, line: Column) -> Column:
    us = F.regexp_extract(line, r"\s(\d\d/\d\d/\d\d)(?:\s|$)", 1)
    iso = F.regexp_extract(line, r"\s(\d{4}-\d\d-\d\d)(?:\s|$)", 1)
    return F.when(_sar_banner(f), F.coalesce(F.try_to_timestamp(us, F.lit("MM/dd/yy")).cast("date"), iso.try_cast("date")))


def _sar_rows(fleet: Fleet) -> tuple[DataFrame, DataFrame]:
    """(bundle_id, rank, f, section, day) of every line with two fields or more; (bundle_id, least), the lowest rank of each bundle's
    files that have such a line: their samples count.

    Files are read as lines, which are shuffled to carry section and day over blocks. A text of a table is cut before its
    banners and then before its headers, where it is: no line is shuffled or sorted. (Outer explosions are not preceded by a
    test of the array's size, for which Spark would make the array twice; a text without lines gives a row without ``f``.)
    """
    rank = F.array_position(F.array(*[F.col("file_path").endswith("/" + name) for name in SAR_FILES]), True).alias("rank")
    if not isinstance(fleet, TableFleet):
        lines = _fields(fleet.lines(*SAR_FILES)).filter(F.size("f") >= 2).select("bundle_id", "file_path", *ORDER, "value", "f", rank)
        best = lines.groupBy("bundle_id").agg(F.min("rank").alias("least"))
        return _carried(lines, {"section": _sar_section(F.col("f")), "day": _sar_day(F.col("f"), F.col("value"))}), best
    texts = fleet.texts(*SAR_FILES).select("bundle_id", rank, "lines")
    best = texts.filter(F.exists("lines", lambda x: F.size(_split(x)) >= 2)).groupBy("bundle_id").agg(F.min("rank").alias("least"))
    head, last = (lambda x: _sar_section(x["f"])), (lambda xs: F.get(xs, F.size(xs) - 1))
    lines = F.filter(F.transform("lines", lambda x: F.struct(x.alias("value"), _split(x).alias("f"))), lambda x: F.size(x["f"]) >= 2)
    runs = _cut(texts.withColumn("lines", lines), "lines", lambda x: _sar_day(x["f"], x["value"]).isNotNull())
    # What each run ends with; a run has the last of those before it to begin with.
    ends = F.transform("lines", lambda run: last(F.array_compact(F.transform(run, head))))
    runs = runs.select("bundle_id", "rank", ends.alias("ends"), F.posexplode_outer("lines").alias("at", "lines"))
    first = F.get("lines", F.lit(0))
    runs = runs.select("bundle_id", "rank", "lines", last(F.array_compact(F.slice("ends", F.lit(1), F.col("at")))).alias("before"), _sar_day(first["f"], first["value"]).alias("day"))
    parts = _cut(runs, "lines", lambda x: head(x).isNotNull()).select("bundle_id", "rank", "day", "before", F.explode_outer("lines").alias("lines"))
    parts = parts.select("bundle_id", "rank", "day", F.coalesce(head(first), "before").alias("section"), F.explode_outer("lines.f").alias("f"))
    return parts, best


def _cut(df: DataFrame, items: str, opens) -> DataFrame:
    """``df`` with the array ``items`` as an array of pieces, cut before each item that ``opens``."""
    at = F.array_compact(F.transform(items, lambda x, i: F.when((i == 0) | opens(x), i)))
    # Starts are a column of their own, so that they are found once, not once a piece.
    starts = df.withColumn("_starts", at)
    piece = lambda start, k: F.slice(items, start + 1, F.coalesce(F.get("_starts", k + 1), F.size(items)) - start)
    return starts.withColumn(items, F.transform("_starts", piece)).drop("_starts")


def scan_sar(fleet: Fleet) -> tuple[DataFrame, DataFrame]:
    """(samples, interfaces): one row per time, and one per time and interface.

    The section of a data row is the last header before it; rows of all sections with one
    day and time merge into one sample.
    """
    rows, best = _sar_rows(fleet)
    rows = rows.filter(_sar_section(F.col("f")).isNull() & ~_sar_banner(F.col("f")) & ~_f(0).isin("Average:", "Time", "HH:MM:SS"))
    clock = F.when(_f(0).rlike(r"\A\d\d:\d\d:\d\d\z"), _f(0))
    stamp = F.concat_ws(" ", F.col("day").cast("string"), clock).try_cast("timestamp")
    rows = rows.withColumns({"clock": _f(0), "ts": F.when(clock.isNotNull(), stamp).otherwise(F.col("day").cast("timestamp"))})

    def at(name: str, index: int, least: int, also: Column | None = None) -> Column:
        test = (F.col("section") == SAR_SECTIONS.index(name)) & (F.size("f") >= least)
        return F.max(F.when(test if also is None else test & also, to_number(_f(index))))

    every = _f(1) == "all"
    pct = F.get(F.filter("f", lambda x: F.contains(x, F.lit(".")) & (to_number(x) <= 100)), F.lit(0))
    # A row per bundle in ``best``: too many to broadcast for a large fleet. It meets samples, not lines.
    def chosen(found: DataFrame) -> DataFrame:
        # No rank is below the least; as an equality it would become a join key, by which all rows were shuffled anew.
        return found.join(best.hint("merge"), "bundle_id").filter("rank <= least").drop("rank", "least")

    samples = rows.groupBy("bundle_id", "rank", "day", "clock").agg(
        F.min("ts").alias("ts"), at("cpu", 2, 8, every).alias("cpu_user"), at("cpu", 4, 8, every).alias("cpu_system"),
        at("cpu", 5, 8, every).alias("cpu_iowait"), at("cpu", 7, 8, every).alias("cpu_idle"),
        F.max(F.when(F.col("section") == SAR_SECTIONS.index("mem"), to_number(pct))).alias("mem_used_pct"),
        at("tcp", 1, 5).alias("tcp_active"), at("tcp", 2, 5).alias("tcp_passive"), at("tcp", 3, 5).alias("tcp_in_segs"), at("tcp", 4, 5).alias("tcp_out_segs"),
        at("etcp", 3, 4).alias("tcp_retrans"), at("etcp", 4, 5).alias("tcp_in_errs"),
    )
    net = rows.filter((F.col("section") == SAR_SECTIONS.index("net")) & (F.size("f") >= 10)).select(
        "bundle_id", "rank", "clock", "ts", _f(1).alias("iface"),
        *[F.coalesce(to_number(_f(i)), F.lit(0.0)).alias(n) for i, n in ((2, "rx_pck"), (3, "tx_pck"), (4, "rx_kb"), (5, "tx_kb"), (8, "rx_mcst"), (9, "if_util"))],
    )
    return chosen(samples).drop("day"), chosen(net)
