"""Admin and client JSON: partitions, brokers, health, configuration, Kubernetes, profiles.

Schemas are fixed, as text; unknown keys are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import stage
from fleetlens.sources.fleet import Fleet

# Field names of the files.
PARTITION = (
    "struct<ns:string,topic:string,partition_id:bigint,status:string,leader_id:bigint,"
    "replicas:array<struct<node_id:bigint,core:bigint>>,revision:bigint>"
)
LEADER = "struct<ns:string,topic:string,partition_id:bigint,leader:bigint,previous_leader:bigint,last_stable_leader_term:bigint>"
FOLLOWER = (
    "struct<id:bigint,heartbeats_failed:bigint,ms_since_last_heartbeat:bigint,"
    "last_flushed_log_index:bigint,last_dirty_log_index:bigint>"
)
DEBUG = (
    "struct<ns:string,topic:string,partition_id:bigint,replicas:array<struct<committed_offset:bigint,"
    f"raft_state:struct<node_id:bigint,term:bigint,is_leader:boolean,is_elected_leader:boolean,followers:array<{FOLLOWER}>>>>>"
)
BROKER = (
    "struct<node_id:bigint,num_cores:bigint,rack:string,is_alive:boolean,draining:boolean,version:string,"
    "internal_rpc_address:string,maintenance_status:map<string,string>>"
)
HEALTH = "struct<is_healthy:boolean,under_replicated_count:bigint,leaderless_count:bigint,nodes_down:array<bigint>,all_nodes:array<bigint>>"
BALANCER = (
    "struct<status:string,violations:map<string,string>,seconds_since_last_tick:bigint,"
    "partitions_pending_force_recovery_count:bigint>"
)
USAGE = "struct<cpuPercentage:double,freeMemoryMB:double,freeSpaceMB:double>"
DISK = "struct<free_bytes:bigint,total_bytes:bigint>"
TEST = (
    "struct<name:string,info:string,type:string,test_id:string,timeouts:bigint,start_time:string,end_time:string,"
    "duration_ms:bigint,iops:double,throughput:bigint,latency_p50:bigint,latency_p90:bigint,latency_p99:bigint,"
    "latency_p999:bigint,latency_max:bigint>"
)
SELF_TEST = f"struct<node_id:bigint,status:string,results:array<{TEST}>>"


def scan_partitions(fleet: Fleet) -> DataFrame:
    """(bundle_id, ns, topic, partition_id, status, leader_id, replicas, revision)."""
    return fleet.json(PARTITION, "admin/cluster_partitions.json").select("bundle_id", "doc.*")


def partition_replicas(partitions: DataFrame) -> DataFrame:
    """A row per replica."""
    return partitions.select("bundle_id", "ns", "topic", "partition_id", F.explode("replicas").alias("r")).select(
        "bundle_id", "ns", "topic", "partition_id", "r.node_id", "r.core"
    )


def scan_leaders(fleet: Fleet) -> DataFrame:
    """The leader table; of several files of a bundle the first that has rows."""
    rows = fleet.json(LEADER, "admin/partition_leader_table_*.json").select("bundle_id", "file_name", "doc.*")
    first = rows.groupBy("bundle_id").agg(F.min("file_name").alias("file_name"))
    return rows.join(first, ["bundle_id", "file_name"]).drop("file_name")


def scan_partition_debug(fleet: Fleet) -> DataFrame:
    """Debug records; a missing name is recovered from the file's name."""
    rows = fleet.json(DEBUG, "admin/debug_partition_*.json")
    name = F.regexp_replace("file_name", r"\Adebug_partition_|\.json\z", "")
    parts = F.split(name, "_")
    unnamed = (F.coalesce(F.col("doc.topic"), F.lit("")) == "") & (F.size(parts) >= 3)
    pick = lambda at, field: F.when(unnamed, F.get(parts, at)).otherwise(F.col(f"doc.{field}"))
    number = F.when(unnamed, F.coalesce(F.get(parts, 2).try_cast("bigint"), F.lit(0))).otherwise(F.col("doc.partition_id"))
    return rows.select(
        "bundle_id", pick(0, "ns").alias("ns"), pick(1, "topic").alias("topic"), number.alias("partition_id"), F.col("doc.replicas").alias("replicas")
    )


def debug_replicas(debug: DataFrame) -> DataFrame:
    key = ["bundle_id", "ns", "topic", "partition_id"]
    rows = debug.select(*key, F.explode("replicas").alias("r"))
    leads = F.coalesce("r.raft_state.is_leader", F.lit(False)) | F.coalesce("r.raft_state.is_elected_leader", F.lit(False))
    return rows.select(*key, "r.raft_state.node_id", "r.committed_offset", "r.raft_state.term", leads.alias("is_leader"))


def debug_followers(debug: DataFrame) -> DataFrame:
    key = ["bundle_id", "ns", "topic", "partition_id"]
    rows = debug.select(*key, F.explode("replicas").alias("r"))
    rows = rows.select(*key, "r.raft_state.node_id", F.explode("r.raft_state.followers").alias("f"))
    return rows.select(
        *key, "node_id", F.col("f.id").alias("follower_id"), "f.heartbeats_failed", "f.ms_since_last_heartbeat",
        "f.last_flushed_log_index", "f.last_dirty_log_index",
    )


def scan_brokers(fleet: Fleet) -> DataFrame:
    """(bundle_id, node_id, num_cores, rack, is_alive, draining, version, address,
    in_maintenance). A broker without a word on it counts as alive."""
    rows = fleet.json(BROKER, "admin/brokers.json").select("bundle_id", "doc.*")
    drains = F.coalesce(F.col("maintenance_status")["draining"] == "true", F.lit(False))
    any_on = F.coalesce(F.exists(F.map_values("maintenance_status"), lambda v: v == "true"), F.lit(False))
    return rows.select(
        "bundle_id", "node_id", "num_cores", "rack", F.coalesce("is_alive", F.lit(True)).alias("is_alive"), drains.alias("draining"),
        "version", "internal_rpc_address", (any_on | F.coalesce("draining", F.lit(False))).alias("in_maintenance"),
    )


def scan_health(fleet: Fleet) -> DataFrame:
    return fleet.json(HEALTH, "admin/health_overview.json").select("bundle_id", "doc.*")


def scan_balancer(fleet: Fleet) -> DataFrame:
    return fleet.json(BALANCER, "admin/partition_balancer_status.json").select("bundle_id", "doc.*")


def scan_resource_usage(fleet: Fleet) -> DataFrame:
    return fleet.json(USAGE, "resource-usage.json").select("bundle_id", "doc.*")


def scan_self_test(fleet: Fleet) -> DataFrame:
    """A row per test result; the file holds one node or a list of nodes."""
    rows = fleet.json(SELF_TEST, "admin/self_test_status_*.json")
    return rows.select("bundle_id", F.col("doc.node_id").alias("node_id"), F.explode("doc.results").alias("r")).select(
        "bundle_id", "node_id", "r.*"
    )


def scan_disk_stats(fleet: Fleet) -> DataFrame:
    """(bundle_id, kind, file_name, total_bytes, free_bytes); match with brokers for the node."""
    rows = fleet.json(DISK, "admin/disk_stat_data_*.json", "admin/disk_stat_cache_*.json")
    kind = F.regexp_extract("file_name", r"\Adisk_stat_(data|cache)_", 1)
    return rows.select("bundle_id", kind.alias("kind"), "file_name", "doc.total_bytes", "doc.free_bytes")


# Fixed value: where the vendor documents a property.
DOC_LINK = "https://docs.redpanda.com/current/reference/properties/cluster-properties/#"


def scan_cluster_config(fleet: Fleet) -> DataFrame:
    """(bundle_id, key, value, doc_link) of the cluster configuration."""
    docs = fleet.documents("admin/cluster_config.json")
    rows = docs.select("bundle_id", F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    return rows.withColumn("doc_link", F.concat(F.lit(DOC_LINK), "key"))


def yaml_walker():
    """A function from YAML text to its scalars as (path, value) pairs.

    A path joins keys and list positions with dots. It covers block mappings and sequences at any
    indentation, comments, quoted scalars and block scalars; a flow collection is kept as its text.
    Defined inside a function so that it travels to the executors by value.
    """
    import re

    mapping = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#'"\[{][^#]*?)\s*:(?:\s+(.*))?$""")
    comment = re.compile(r"""^((?:[^"'#]|"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|(?<=\S)#)*?)\s+#.*$""")

    def plain(scalar: str) -> str:
        quoted = len(scalar) > 1 and scalar[0] == scalar[-1] and scalar[0] in "\"'"
        return scalar[1:-1] if quoted else scalar

    def walk(text: str) -> list[tuple[str, str]]:
        found, items = [], {}
        above: list[tuple[int, bool, tuple[str, ...]]] = []  # column, is a list item, path
        block = None  # column, style, path and lines of an open block scalar
        for line in [*text.splitlines(), "..."]:
            column = len(line) - len(line.lstrip(" "))
            if block and (not line.strip() or column > block[0]):
                block[3].append(line.strip())
                continue
            if block:
                found.append((".".join(block[2]), (" " if block[1] == ">" else "\n").join(block[3]).strip()))
                block = None
            rest = comment.sub(r"\1", line).strip()
            if not rest or rest.startswith("#") or rest in ("---", "..."):
                continue
            while rest == "-" or rest.startswith("- "):
                # A key at the same column may own the list; an item there is a sibling.
                while above and (above[-1][0] > column or (above[-1][0] == column and above[-1][1])):
                    above.pop()
                owner = above[-1][2] if above else ()
                items[owner] = items.get(owner, -1) + 1
                above.append((column, True, (*owner, str(items[owner]))))
                inner = rest[1:].lstrip()
                column += len(rest) - len(inner)
                rest = inner
            pair = mapping.match(rest)
            if pair:
                while above and above[-1][0] >= column:
                    above.pop()
                path = (*(above[-1][2] if above else ()), plain(pair[1]))
                value = (pair[2] or "").strip()
                if not value:
                    above.append((column, False, path))
                elif value[0] in "|>":
                    block = (column, value[0], path, [])
                else:
                    found.append((".".join(path), plain(value)))
            elif rest and above and above[-1][1]:
                found.append((".".join(above[-1][2]), plain(rest)))
        return found

    return walk


def scan_yaml_config(fleet: Fleet) -> DataFrame:
    """(bundle_id, key, value) of the broker's own file. Indentation needs an ordered pass
    over one small file, so each task walks the files it holds."""
    walk = yaml_walker()

    def flatten(batches):
        for batch in batches:
            out = batch[["bundle_id"]].assign(pair=batch["value"].fillna("").map(walk)).explode("pair").dropna(subset=["pair"])
            yield out.assign(key=out["pair"].str[0], value=out["pair"].str[1])[["bundle_id", "key", "value"]]

    docs = fleet.documents("redpanda.yaml").select("bundle_id", "value")
    return docs.mapInPandas(flatten, "bundle_id string, key string, value string")


def data_directory(config: DataFrame) -> DataFrame:
    """(bundle_id, data_dir) named in the broker's file."""
    named = F.col("key").endswith("data_directory")
    return config.filter(named).groupBy("bundle_id").agg(F.min("value").alias("data_dir"))


# --- client-side dump -------------------------------------------------------------------

METADATA = (
    "struct<Cluster:string,Controller:bigint,Brokers:array<struct<NodeID:bigint,Port:bigint,Host:string,Rack:string>>,"
    "Topics:map<string,struct<Topic:string,IsInternal:boolean,Partitions:map<string,struct<Partition:bigint,Leader:bigint,"
    "LeaderEpoch:bigint,Replicas:array<bigint>,ISR:array<bigint>>>>>>"
)
CONFIGS = (
    "array<struct<Name:string,ErrMessage:string,Configs:array<struct<Key:string,Value:string,Source:string,Sensitive:boolean,"
    "Synonyms:array<struct<Key:string,Value:string,Source:string>>>>>>"
)
GROUPS = (
    "map<string,struct<Group:string,State:string,ProtocolType:string,Protocol:string,Coordinator:struct<NodeID:bigint,Host:string>,"
    "Members:array<struct<MemberID:string,ClientID:string,ClientHost:string,Assigned:map<string,array<bigint>>>>>>"
)
MARKS = "map<string,map<string,struct<Topic:string,Partition:bigint,Offset:bigint>>>"
COMMITS = "map<string,map<string,struct<Topic:string,Partition:bigint,At:bigint>>>"
COMMIT_PREFIX = "group_commits_"


def _topic_partitions(rows: DataFrame, nested: str, *keep: str) -> DataFrame:
    by_topic = rows.select(*keep, F.explode(nested).alias("topic", "_parts"))
    return by_topic.select(*keep, "topic", F.explode("_parts").alias("_id", "p"))


def scan_kafka_dump(fleet: Fleet, materialize: bool = False) -> dict[str, DataFrame]:
    """Sections of the client-side dump: metadata, brokers, partitions, topic_configs,
    broker_configs, groups, members, commits, high_watermarks.

    A dump is split into its items once per section that is used; with ``materialize``
    the items are staged and split once in all.
    """
    docs = fleet.documents("kafka.json")
    items = docs.select("bundle_id", F.explode(F.from_json("value", "array<struct<Name:string,Response:string>>")).alias("i"))
    items = items.select("bundle_id", F.col("i.Name").alias("name"), F.col("i.Response").alias("response"))
    items = stage(items, "dump-items") if materialize else items

    def section(name: str, schema: str) -> DataFrame:
        rows = items.filter(F.col("name") == name)
        return rows.select("bundle_id", F.from_json("response", schema).alias("d")).filter("d is not null")

    meta = section("metadata", METADATA)
    brokers = meta.select("bundle_id", F.explode("d.Brokers").alias("b")).select(
        "bundle_id", F.col("b.NodeID").alias("node_id"), F.col("b.Host").alias("host"), F.col("b.Port").alias("port"), F.col("b.Rack").alias("rack")
    )
    topics = meta.select("bundle_id", F.explode("d.Topics").alias("topic", "t"))
    partitions = topics.select("bundle_id", "topic", F.explode("t.Partitions").alias("_id", "p")).select(
        "bundle_id", "topic", F.col("p.Partition").alias("partition_id"), F.col("p.Leader").alias("leader"),
        F.col("p.Replicas").alias("replicas"), F.col("p.ISR").alias("isr"),
    )

    def configs(name: str) -> DataFrame:
        rows = section(name, CONFIGS).select("bundle_id", F.explode("d").alias("c"))
        rows = rows.select("bundle_id", F.col("c.Name").alias("name"), F.explode("c.Configs").alias("e"))
        return rows.select(
            "bundle_id", "name", F.col("e.Key").alias("key"), F.col("e.Value").alias("value"), F.col("e.Source").alias("source"),
            F.col("e.Sensitive").alias("sensitive"), F.col("e.Synonyms").alias("synonyms"),
        )

    listed = section("groups", GROUPS).select("bundle_id", F.explode("d").alias("group_id", "g"))
    groups = listed.select("bundle_id", "group_id", F.col("g.State").alias("state"), F.col("g.Coordinator.NodeID").alias("coordinator"))
    members = listed.select("bundle_id", "group_id", F.col("g.State").alias("state"), F.explode("g.Members").alias("m")).select(
        "bundle_id", "group_id", "state", F.col("m.MemberID").alias("member_id"), F.col("m.ClientID").alias("client_id"), F.col("m.Assigned").alias("assigned")
    )
    marks = _topic_partitions(section("high_watermarks", MARKS), "d", "bundle_id").select(
        "bundle_id", "topic", F.coalesce(F.col("_id").try_cast("bigint"), F.col("p.Partition")).alias("partition_id"), F.col("p.Offset").alias("hwm")
    )
    committed = items.filter(F.col("name").startswith(COMMIT_PREFIX)).select(
        "bundle_id", F.substring("name", len(COMMIT_PREFIX) + 1, 1 << 20).alias("group_id"), F.from_json("response", COMMITS).alias("d")
    )
    commits = _topic_partitions(committed, "d", "bundle_id", "group_id").select(
        "bundle_id", "group_id", "topic", F.col("p.Partition").alias("partition_id"), F.col("p.At").alias("at")
    )
    return {
        "metadata": meta.select("bundle_id", F.col("d.Cluster").alias("cluster"), F.col("d.Controller").alias("controller")),
        "brokers": brokers, "partitions": partitions, "topic_configs": configs("topic_configs"), "broker_configs": configs("broker_configs"),
        "groups": groups, "members": members, "commits": commits, "high_watermarks": marks,
    }


# --- Kubernetes -------------------------------------------------------------------------

_RESOURCES = "struct<limits:map<string,string>,requests:map<string,string>>"
_PROBE = (
    "struct<initialDelaySeconds:bigint,timeoutSeconds:bigint,periodSeconds:bigint,successThreshold:bigint,failureThreshold:bigint,"
    "httpGet:struct<path:string,port:string>,exec:struct<command:array<string>>,tcpSocket:struct<port:string>>"
)
_STATE = "map<string,struct<reason:string,message:string,startedAt:timestamp,finishedAt:timestamp,exitCode:int>>"
K8S_ITEM = (
    "struct<metadata:struct<name:string,namespace:string,creationTimestamp:timestamp,labels:map<string,string>,"
    "ownerReferences:array<struct<kind:string,name:string>>>,"
    "spec:struct<nodeName:string,containers:array<struct<name:string,image:string,resources:" + _RESOURCES + ","
    "livenessProbe:" + _PROBE + ",readinessProbe:" + _PROBE + ",startupProbe:" + _PROBE + ">>,storageClassName:string,accessModes:array<string>,"
    "resources:" + _RESOURCES + ",type:string,clusterIP:string,ports:array<struct<name:string,port:bigint,targetPort:string,protocol:string>>,replicas:bigint>,"
    "status:struct<phase:string,podIP:string,containerStatuses:array<struct<name:string,state:" + _STATE + ",lastState:" + _STATE + ","
    "ready:boolean,restartCount:bigint,image:string>>,conditions:array<struct<type:string,status:string>>,capacity:map<string,string>,"
    "allocatable:map<string,string>,replicas:bigint,readyReplicas:bigint>,"
    "involvedObject:struct<kind:string,namespace:string,name:string>,reason:string,message:string,"
    "source:struct<component:string,host:string>,firstTimestamp:timestamp,lastTimestamp:timestamp,count:bigint,type:string,data:map<string,string>>"
)
K8S_KINDS = [
    "pods", "services", "configmaps", "endpoints", "events", "limitranges", "persistentvolumeclaims",
    "replicationcontrollers", "resourcequotas", "serviceaccounts", "statefulsets", "deployments", "nodes",
]


def scan_k8s(fleet: Fleet) -> DataFrame:
    """Resources of all kinds: (bundle_id, kind, metadata, spec, status, ...)."""
    lists = fleet.json(f"struct<kind:string,items:array<{K8S_ITEM}>>", *[f"k8s/{kind}.json" for kind in K8S_KINDS])
    kind = F.regexp_replace("file_name", r"\.json\z", "")
    return lists.select("bundle_id", kind.alias("kind"), F.explode("doc.items").alias("item")).select("bundle_id", "kind", "item.*")


def k8s_kind(resources: DataFrame, kind: str) -> DataFrame:
    return resources.filter(F.col("kind") == kind)


def k8s_events(resources: DataFrame) -> DataFrame:
    """Flat event rows."""
    return k8s_kind(resources, "events").select(
        "bundle_id", "type", "reason", "message", "count", F.col("firstTimestamp").alias("first_timestamp"),
        F.col("lastTimestamp").alias("last_timestamp"), F.col("involvedObject.kind").alias("involved_kind"),
        F.col("involvedObject.name").alias("involved_name"), F.col("involvedObject.namespace").alias("involved_namespace"),
        F.col("source.component").alias("source_component"), F.col("source.host").alias("source_host"),
    )


# --- CPU profiles -----------------------------------------------------------------------

_SAMPLES = "array<struct<user_backtrace:string,scheduling_group:string,group:string,occurrences:bigint>>"
_SHARD = f"struct<shard_id:bigint,dropped_samples:bigint,samples:{_SAMPLES}>"
PROFILE = f"struct<profile:array<{_SHARD}>,shard_id:bigint,samples:{_SAMPLES}>"


def scan_cpu_profiles(fleet: Fleet) -> DataFrame:
    """(bundle_id, node, shard_id, scheduling_group, user_backtrace, occurrences) from an
    object, a list of objects or a list of shards."""
    name = F.regexp_replace("file_name", r"\Acpu_profile_|\.json\z", "")
    node = F.regexp_replace(F.regexp_replace(name, r"\Ahttps---", ""), r"(?s)\.-(?!.*\.-).*\z", "")
    docs = fleet.json(PROFILE, "admin/cpu_profile_*.json").select("bundle_id", node.alias("node"), "doc")
    alone = F.struct(F.col("doc.shard_id").alias("shard_id"), F.lit(None).cast("bigint").alias("dropped_samples"), F.col("doc.samples").alias("samples"))
    shards = F.when(F.size("doc.profile") > 0, F.col("doc.profile")).when(F.col("doc.samples").isNotNull(), F.array(alone))
    rows = docs.select("bundle_id", "node", F.explode(shards).alias("s"))
    rows = rows.select("bundle_id", "node", F.coalesce("s.shard_id", F.lit(0)).alias("shard_id"), F.explode("s.samples").alias("x"))
    group = F.coalesce(F.nullif("x.scheduling_group", F.lit("")), F.nullif("x.group", F.lit("")), F.lit("unknown"))
    return rows.select("bundle_id", "node", "shard_id", group.alias("scheduling_group"), "x.user_backtrace", "x.occurrences")


