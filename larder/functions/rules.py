"""Predicates and classifications of requests, writes, nodes and runs, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.hashing import valid_key

#: The two namespaces, and the roles of a request between nodes ('' is a client's).
NAMESPACES = ("cas", "ac")
HOPS = ("coordinator", "replica", "repair", "read", "")
TERMINAL = ("replica", "read", "repair")
CLIENT_CLOSED = 499


def parse_namespace(x: Column) -> Column:
    """The namespace that a text names in any case, else null."""
    return F.when(F.lower(x).isin(*NAMESPACES), F.lower(x))


def valid_namespace(x: Column) -> Column:
    return F.coalesce(x.isin(*NAMESPACES), F.lit(False))


def content_addressed(ns: Column) -> Column:
    return ns == "cas"


def _stripped(path: Column) -> Column:
    """Without one leading and one trailing slash and then one "cache/" in front."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^/", ""), "/\\z", ""), "^cache/", "")


def parse_path(path: Column) -> tuple[Column, Column]:
    """(namespace, key) of an object's path, both null where it is none."""
    rest = _stripped(path)
    ns = parse_namespace(F.regexp_extract(rest, "^([^/]*)/", 1))
    key = F.regexp_extract(rest, "^[^/]*/(?s)([^/]*)\\z", 1)
    fine = ns.isNotNull() & valid_key(key)
    return F.when(fine, ns), F.when(fine, key)


def is_cache_path(path: Column) -> Column:
    """Whether a path goes to the object protocol at all; unlike the namespace in parse_path, in lower case only."""
    rest = F.regexp_replace(F.regexp_replace(path, "^/", ""), "^cache/", "")
    return rest.rlike("^(cas|ac)(/|\\z)")


def shard_dir(key: Column) -> Column:
    """The two directory levels under which a key's file lies."""
    return F.concat_ws("/", F.substring(key, 1, 2), F.substring(key, 3, 2))


def op_name(method: Column) -> Column:
    return F.when(method == "GET", "get").when(method == "HEAD", "head").when(method.isin("PUT", "POST"), "put").otherwise("other")


def parse_hop(x: Column) -> Column:
    """An unknown role is the most restricted one."""
    return F.when(x.isin(*HOPS), x).otherwise("replica")


def inbound_hop(forwarded_by: Column, hop: Column) -> Column:
    """Only a request that another node forwarded has the role that it claims."""
    return F.when(F.coalesce(forwarded_by, F.lit("")) == "", "").otherwise(parse_hop(F.coalesce(hop, F.lit(""))))


def terminal(hop: Column) -> Column:
    return hop.isin(*TERMINAL)


def forwarded(hop: Column) -> Column:
    return hop != ""


def admission(ns: Column, key: Column, declared: Column, written: Column, digest: Column, limit: Column) -> Column:
    """Why a write is refused, by the first rule that it breaks; 'ok' if none."""
    return (
        F.when(declared > limit, "too_large")
        .when(written > limit, "too_large")
        .when((declared >= 0) & (written != declared), "short_write")
        .when(content_addressed(ns) & (digest != key), "digest_mismatch")
        .otherwise("ok")
    )


def get_status(error: Column) -> Column:
    """HTTP status of a read by its error (null: served)."""
    return (
        F.when(error.isNull(), 200)
        .when(error.isin("not_found", "bad_key", "bad_namespace"), 404)
        .when(error == "closed", 503)
        .when(error == "canceled", CLIENT_CLOSED)
        .otherwise(503)
    )


def put_status(error: Column, already_stored: Column) -> Column:
    """HTTP status of a write by its error (null: stored)."""
    return (
        F.when(error.isNull(), F.when(already_stored, 200).otherwise(201))
        .when(error == "digest_mismatch", 400)
        .when(error == "too_large", 413)
        .when(error == "over_quota", 507)
        .when(error.isin("short_write", "bad_key", "bad_namespace", "upload_interrupted"), 400)
        .when(error.isin("closed", "insufficient_replicas"), 503)
        .when(error.isin("canceled", "deadline_exceeded"), CLIENT_CLOSED)
        .otherwise(500)
    )


def retryable(status: Column) -> Column:
    """Whether a peer's answer is worth another try; a null status is a transport error."""
    return status.isNull() | (status >= 500) | (status == 429)


def declined_over_quota(status: Column, error: Column) -> Column:
    return F.coalesce(status == 507, F.lit(False)) | F.coalesce(error == "over_quota", F.lit(False))


def error_class(message: Column) -> Column:
    """conn_refused before timeout, none else."""
    m = F.lower(message)
    refused = m.contains("connection refused") | m.contains("no such host") | m.contains("connection reset")
    return F.when(refused, "conn_refused").when(m.contains("timeout") | m.contains("deadline exceeded"), "timeout").otherwise("none")


def log_level(status: Column) -> Column:
    """A miss is no problem, so it is logged as debug."""
    return F.when(status >= 500, "error").when((status >= 400) & (status != 404), "warn").when(status == 404, "debug").otherwise("info")


def water_mark(max_bytes: Column, fraction: Column) -> Column:
    """max * fraction in double precision, truncated."""
    return (max_bytes.cast("double") * fraction).cast("long")


def quota_error(max_bytes: Column, high: Column, low: Column) -> Column:
    """Which part of a quota is unusable, else null."""
    return F.when(max_bytes <= 0, "max_bytes").when((high <= 0) | (high > 1), "high_water").when((low <= 0) | (low >= high), "low_water")


def page_cache_class(corpus_bytes: Column, ram_bytes: Column) -> Column:
    """How far a corpus fits the host's memory."""
    ratio = corpus_bytes.cast("double") / F.when(ram_bytes > 0, ram_bytes).cast("double")
    return F.when(ratio.isNull(), "unknown").when(ratio < 0.5, "WARM").when(ratio < 1.5, "MIXED").otherwise("COLD-ISH")


def hop_dispatch(hop: Column, holds: Column, used: Column, high_bytes: Column) -> Column:
    """What a node does with a write: store, decline, coordinate or proxy. A node that doesn't know its usage (null) accepts."""
    over = F.coalesce(used > high_bytes, F.lit(False))
    return (
        F.when(hop == "repair", F.when(over, "decline").otherwise("store"))
        .when(hop.isin("replica", "read"), "store")
        .when(hop == "coordinator", "coordinate")
        .when(holds, "coordinate")
        .otherwise("proxy")
    )


def verdict(corrupted_reads: Column, corrupted: Column, missing: Column, eviction_observed: Column, attempted: Column, converged: Column, faults_enabled: Column, n_faults: Column, error_rate: Column) -> Column:
    """The first rule that holds, in order of gravity."""
    return (
        F.when((corrupted_reads > 0) | (corrupted > 0), "FAIL: corrupted data was served")
        .when((missing > 0) & ~eviction_observed, "FAIL: acknowledged objects are gone and no eviction was observed")
        .when(attempted & ~converged, "FAIL: objects were still under-replicated")
        .when(faults_enabled & (error_rate == 0) & (n_faults > 0), "INCONCLUSIVE")
        .otherwise("PASS")
    )


@dataclass
class Settings:
    """A node's settings; `problems` lists what is wrong with them, in order."""

    node_name: str
    listen_addr: str
    data_dir: str
    max_bytes: int
    max_object_bytes: int
    replica_count: int
    peers: list[tuple[str, str]] = field(default_factory=list)
    high_water: float = 0.9
    low_water: float = 0.7
    repair_workers: int = 4
    repair_queue: int = 1024

    def problems(self) -> list[str]:
        names = [n for n, _ in self.peers]
        checks = [
            (not self.node_name.strip(), "node name is empty"),
            (not self.listen_addr.strip(), "listen address is empty"),
            (not self.data_dir.strip(), "data directory is empty"),
            (self.max_bytes <= 0, "max bytes is not positive"),
            (self.max_object_bytes <= 0, "max object bytes is not positive"),
            (not 0 < self.high_water <= 1, "high water is outside (0, 1]"),
            (not 0 < self.low_water < self.high_water, "low water is outside (0, high water)"),
            (self.replica_count < 1, "replica count is below 1"),
            (not names, "there are no peers"),
            (self.replica_count > len(names) > 0, "replica count exceeds the cluster"),
            (self.repair_workers < 0, "repair workers is negative"),
            (self.repair_queue < 1, "repair queue is below 1"),
            (any(not n.strip() for n in names), "a peer has no name"),
            (len(set(names)) < len(names), "a peer's name occurs twice"),
            (any(not u.startswith(("http://", "https://")) or not u.split("://", 1)[1].split("/")[0] for _, u in self.peers), "a peer's url is not http(s) with a host"),
            (self.node_name not in names, "the node is not among the peers"),
        ]
        return [what for wrong, what in checks if wrong]
