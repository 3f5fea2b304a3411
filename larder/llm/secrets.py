"""Secret scans by an incremental ledger of blobs.

Every version of every file is addressed by the SHA-256 of its text. The ledger lists which
rule (with its version) has been run over which blob; a scan takes the pairs that are not in it,
once per blob however many paths and versions hold that text, and its findings are joined back to all of them.
DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.llm.common import checkpoint, without


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` (leftmost, not overlapping) count where `group` has at least `least` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which kinds at one start are listed. The second and third need no count afterwards: a run too short for
#: the pattern holds no longer run.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
RULES = (*BASE, Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"))
#: What a corpus has masked: as RULES, but the whole key goes with its header, up to the END line, or where none comes before other
#: dashes over the base64 that follows.
_HEAD, _GAP = "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", r"(?:\s|\\[nrt])*+"
MASKED = (*BASE, Rule("pem", 2, _HEAD + r"(?:[^-]*+(?:-{1,4}+[^-]++)*+-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:" + _GAP + r"(?:Proc-Type|DEK-Info): ?[^\n\\]*+)*+(?:" + _GAP + r"[A-Za-z0-9+/]{20,}+={0,2}+)*+(?:(?<=[A-Za-z0-9+/])(?:\s|\\[nrt])++(?:[A-Za-z0-9+/]{4}){0,4}+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=))?+)"))
MASK = "[secret]"
#: Classes of blobs, in a table of bounded size.
CLASSES = 1 << 18


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _matches(text: Column, rule: Rule, order: int) -> Column:
    """One struct a match: its number, the length of the gap before it, its own and its group's."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    each = F.arrays_zip(found.alias("m"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("g"), F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)).alias("gap"))
    rows = F.transform(
        each,
        lambda x, i: F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(order).alias("order"), F.lit(rule.least).alias("least"), i.alias("n"),
            F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("length"), F.length(x["g"]).alias("size"), F.octet_length(x["gap"]).alias("gap_bytes"), F.octet_length(x["m"]).alias("bytes"),
        ),
    )
    return F.when(text.rlike(rule.pattern), rows)


def scan(history: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger rows to add) of the blobs of history that the ledger doesn't list under every rule.

    findings: blob_id, spans (array of start, order, end, kind by start and the rules' order; code points, end
    exclusive; start_byte and end_byte in UTF-8), a row per blob that has any. Ledger rows: blob_id, rule. ledger: the same two columns, or None for an empty one.
    A null text is the empty blob, which has no findings. Texts are grouped by blob before they are scanned, each task sending one
    copy of a text at most; equal texts cost one scan.
    """
    blobs = history.select(blob_id(F.col(text_col)).alias("blob_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob_id").agg(F.any_value("text").alias("text"))
    every = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("due", every)
    else:
        seen = ledger.groupBy(F.col("blob_id").alias("_b")).agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, F.col("blob_id") == F.col("_b"), "left")
        blobs = blobs.withColumn("due", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("due") > 0)
    found = F.concat(*[F.coalesce(F.when(F.array_contains("due", r.name), _matches(F.col("text"), r, i)), F.array()) for i, r in enumerate(rules)])
    rows = blobs.select("blob_id", F.inline(found))
    upto = W.partitionBy("blob_id", "order").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({"end": F.sum(F.col("gap") + F.col("length")).over(upto).cast("int"), "end_byte": F.sum(F.col("gap_bytes") + F.col("bytes")).over(upto).cast("int")})
    spans = rows.where("size >= least").select("blob_id", F.struct((F.col("end") - F.col("length")).alias("start"), "order", "end", "kind", (F.col("end_byte") - F.col("bytes")).alias("start_byte"), "end_byte").alias("span"))
    findings = spans.groupBy("blob_id").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    return findings, blobs.select("blob_id", F.explode("due").alias("rule"))


def findings_by_path(history: DataFrame, findings: DataFrame, text_col: str = "text") -> DataFrame:
    """history with `blob_id` and `spans` (empty where there are none). Columns of those names are replaced; every row stays, repeated or not.

    findings must not be the unfinished plan of scan(): checkpointed or written, both sides of the join can be split where one blob is very common.
    """
    history = without(history, ["blob_id", "spans"])
    rows = history.select(F.struct("*").alias("_row"), blob_id(F.col(text_col)).alias("blob_id"))
    joined = rows.join(findings, "blob_id", "left")
    return joined.select("_row.*", "blob_id", F.coalesce("spans", F.array().cast(findings.schema["spans"].dataType)).alias("spans"))


def update(history: DataFrame, folder: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger under folder doesn't list yet, adds to it, and returns the findings of all blobs scanned so far.

    Each run adds a part to the tables folder/findings and folder/ledger, the ledger's last: a run that broke off before is done again, over its own parts.
    """
    spark = history.sparkSession
    spans = "array<struct<start:int,`order`:int,end:int,kind:string,start_byte:int,end_byte:int>>"
    none = spark.createDataFrame([], f"blob_id string, spans {spans}"), spark.createDataFrame([], "blob_id string, rule string")
    tables = [f"{folder}/findings", f"{folder}/ledger"]
    for table, empty in zip(tables, none, strict=True):
        empty.write.mode("append").parquet(f"{table}/part=-1")
    read = lambda i: spark.read.schema(none[i].schema).option("basePath", tables[i]).parquet(tables[i])
    turn = read(1).withColumn("part", F.regexp_extract(F.input_file_name(), r"part=(-?\d+)", 1).cast("int")).agg(F.coalesce(F.max("part"), F.lit(-1))).first()[0] + 1
    findings, seen = scan(history, read(1), text_col, rules)
    findings.write.mode("overwrite").parquet(f"{tables[0]}/part={turn}")
    checkpoint(seen).write.mode("overwrite").parquet(f"{tables[1]}/part={turn}")
    return read(0).groupBy("blob_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def cuts(findings: DataFrame) -> DataFrame:
    """(blob_id, cuts): the stretches that a blob's spans cover, in bytes: where each starts and ends, and where the one before ends. Time and
    memory grow with the number of spans, however many one blob has."""
    rows = findings.select("blob_id", F.explode("spans").alias("s")).select("blob_id", "s.order", F.col("s.start_byte").alias("start"), F.col("s.end_byte").alias("end"))
    place = W.partitionBy("blob_id").orderBy("start", "order")
    before = F.max("end").over(place.rowsBetween(W.unboundedPreceding, -1))
    opens = rows.withColumn("opens", (before.isNull() | (F.col("start") >= before)).cast("int")).withColumn("stretch", F.sum("opens").over(place.rowsBetween(W.unboundedPreceding, W.currentRow)))
    wide = opens.groupBy("blob_id", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    wide = wide.withColumn("last", F.coalesce(F.lag("end").over(W.partitionBy("blob_id").orderBy("stretch")), F.lit(0)))
    return wide.groupBy("blob_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "last"))).alias("cuts"))


def masked(text: Column, stretches: Column) -> Column:
    """text with each of the stretches (cuts of its blob) replaced by MASK."""
    raw = text.cast("binary")
    kept = F.transform(stretches, lambda s: F.concat(F.substring(raw, s["last"] + 1, s["start"] - s["last"]).cast("string"), F.lit(MASK)))
    rest = F.element_at(stretches, -1)["end"]
    return F.concat(F.array_join(kept, ""), F.substring(raw, rest + 1, F.octet_length(text) - rest).cast("string"))


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with what the rules find masked in their texts (null stays null), with MASKED PEM keys whole; other columns as they were.

    Blobs fall into CLASSES classes, and those with findings are broadcast: only texts of such classes travel to their findings.
    """
    findings = checkpoint(scan(docs, text_col=text_col, rules=rules)[0])
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), docs[f"`{text_col}`"].alias("_text"))
    kind = lambda blob: F.pmod(F.xxhash64(blob), F.lit(CLASSES))
    kinds = F.broadcast(checkpoint(findings.select(kind(F.col("blob_id")).alias("kind")).distinct()))
    whole = whole.withColumn("blob_id", blob_id(F.col("_text")))
    own = kind(F.col("blob_id")) == F.col("kind")
    hit = whole.join(kinds, own, "left_semi").join(checkpoint(cuts(findings)), "blob_id", "left")
    text = F.when(F.col("cuts").isNull(), F.col("_text")).otherwise(masked(F.col("_text"), F.col("cuts")))
    hit = hit.select(*[(text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
    return hit.unionByName(whole.join(kinds, own, "left_anti").select("_row.*"))


def _either(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _sql_spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {order} AS ord, m[i] AS m, g[i] AS g,
      CAST(coalesce(list_sum([length(x) FOR x IN gaps[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:i-1]]), 0) AS BIGINT) AS s
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS g, string_split_regex(t, '{p}') AS gaps FROM d))
    WHERE length(g[i]) >= {least}"""


#: The same in DuckDB, over every document.
ORACLE = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ("
    + "\nUNION ALL ".join(
        _sql_spans(r.kind, i, r.pattern.replace("(?i)(password|passwd|secret|token|api_?key)", f"({'|'.join(map(_either, ('password', 'passwd', 'secret', 'token', 'api_?key')))})"), r.group, r.least)
        for i, r in enumerate(RULES)
    )
    + """), n AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, ord) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN n ON d.doc_id IS NOT DISTINCT FROM n.doc_id"""
)
