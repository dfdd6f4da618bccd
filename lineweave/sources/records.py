"""JSON records: the usage ledger, receipts and named packs."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = (
    "ts string, source string, tool string, query string, route string, query_class string, tokens_in bigint, tokens_out bigint, tokens_saved bigint, files_scanned int, round_trips_saved int, receipt_id string"
)
_COUNTS = ("tokens_in", "tokens_out")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Strict reader of JSON lines: any line that is no JSON object fails the read. A count that is no whole number of at least 0 is unknown."""
    raw = spark.read.option("lineSep", "\n").text(path).filter(F.trim("value") != "")
    v = raw.select(F.parse_json("value").alias("v"), "value")
    x = v.select(F.assert_true(F.schema_of_variant("v").startswith("OBJECT"), F.concat(F.lit("bad ledger line: "), F.substring("value", 1, 80))).alias("ok"), "v")
    fields = []
    for f in LEDGER.split(", "):
        name, kind = f.split()
        if kind == "string":
            fields.append(F.try_variant_get("v", f"$.{name}", "string").alias(name))
        else:
            whole = F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant")) == "BIGINT"
            n = F.try_variant_get("v", f"$.{name}", "bigint")
            fields.append(F.when(whole & (n >= 0), n).cast(kind).alias(name))
    return x.filter(F.col("ok").isNull()).select(*fields)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines; queries are cut to 160 characters."""
    rows.withColumn("query", F.substring("query", 1, 160)).write.mode("append").json(path)


def canonical(value: Any) -> str:
    """Compact JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content_hash(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def with_ids(rows: DataFrame, columns: list[str], out: str = "receipt_id") -> DataFrame:
    """Content-addressed rows: the hash of the columns as JSON."""
    return rows.withColumn(out, F.sha2(F.to_json(F.struct(*sorted(columns))), 256))


def write_records(rows: DataFrame, path: str) -> None:
    """Receipts and packs, one JSON line each, partitioned by nothing: readers look them up by identifier."""
    rows.write.mode("append").json(path)


def verified(rows: DataFrame, columns: list[str], ident: str = "receipt_id") -> DataFrame:
    """The rows whose content still has the hash that names them."""
    return rows.filter(F.sha2(F.to_json(F.struct(*sorted(columns))), 256) == F.col(ident))


def check_name(name: str) -> str:
    """Names of packs: 1 to 64 letters, digits, dots, dashes or underscores."""
    if not re.fullmatch(r"[A-Za-z0-9._-]{1,64}", name):
        raise ValueError(f"bad pack name: {name!r}")
    return name


def ledger_entry(selected: DataFrame, sizes: DataFrame, tool: str) -> DataFrame:
    """Ledger rows of selections: ``selected`` (query_id, query_text, route, source, n_tokens) against ``sizes`` (query_id, tokens_in, files_scanned)."""
    out = selected.groupBy("query_id", "query_text", "route").agg(F.sum("n_tokens").alias("tokens_out"))
    x = out.join(sizes, "query_id")
    return x.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.lit("api").alias("source"), F.lit(tool).alias("tool"), F.substring("query_text", 1, 160).alias("query"), "route", F.lit(None).cast("string").alias("query_class"),
        "tokens_in", "tokens_out", (F.col("tokens_in") - F.col("tokens_out")).alias("tokens_saved"), F.col("files_scanned").cast("int").alias("files_scanned"), F.greatest(F.col("files_scanned") - 1, F.lit(0)).cast("int").alias("round_trips_saved"),
        F.lit(None).cast("string").alias("receipt_id"),
    )


def percent(share: float | None) -> str:
    return "unknown" if share is None else f"{round(share * 100)}%"


def count(n: int | None) -> str:
    return "unknown" if n is None else f"{n:,}"


def render_report(days: list[dict[str, Any]]) -> str:
    """The ledger's summary (rows of ``ledger_summary``; the row without a day is the total) as text."""
    total = next((d for d in days if d["day"] is None), None)
    if not total or not total["calls"]:
        return "No usage recorded yet.\n"
    lines = [
        f"# Usage: {total['calls']} calls", "", f"- fully measured: {total['calls'] - total['unmeasured']}/{total['calls']}", f"- tokens given back: {count(total['tokens_out'])}",
        f"- tokens read less given back: {count(total['tokens_saved'])}", f"- reduction: {percent(total.get('reduction'))} of {count(total['tokens_in'])}", "", "| day | calls | difference |", "|---|---:|---:|",
    ]
    lines += [f"| {d['day']} | {d['calls']} | {count(d['tokens_saved'])} |" for d in sorted((d for d in days if d["day"] is not None), key=lambda d: d["day"])]
    return "\n".join(lines) + "\n"


def render_receipt(receipt: dict[str, Any]) -> str:
    """A receipt (id, query, route, token_count, budget, kept and dropped rows with provenance and n_tokens) as Markdown."""
    lines = [f"# Selection receipt `{receipt['id']}`", "", f"- Query: `{receipt['query']}`", f"- Route: **{receipt['route']}**, {receipt['token_count']}/{receipt['budget']} tokens", ""]
    for title, rows in (("Kept", receipt["kept"]), ("Dropped", receipt["dropped"])):
        lines += [f"## {title} ({len(rows)})", "", "| # | provenance | tokens |", "|--:|---|--:|"]
        lines += [f"| {n} | `{r['provenance']}` | {r['n_tokens']} |" for n, r in enumerate(rows, 1)]
        lines.append("")
    return "\n".join(lines)


def build_pack(name: str, query: str, config: dict[str, Any], context: str, fingerprints: dict[str, str], spans: list[dict[str, Any]]) -> dict[str, Any]:
    """A named pack: the context with its hash, the request and the fingerprints of the sources it came from."""
    pack = {"version": 1, "name": check_name(name), "query": query, "config": config, "context": context, "content_hash": content_hash(context), "sources": sorted(fingerprints), "fingerprints": dict(fingerprints), "spans": spans}
    return check_pack(pack)


def check_pack(pack: dict[str, Any]) -> dict[str, Any]:
    """The pack, if its version is known, its context has its hash, and its fingerprints are SHA-256 values of sources inside the workspace."""
    if pack.get("version") != 1:
        raise ValueError("unknown pack version")
    check_name(pack["name"])
    if pack.get("content_hash") != content_hash(pack.get("context")):
        raise ValueError("the pack's context was changed")
    prints = pack.get("fingerprints") or {}
    if sorted(prints) != sorted(set(pack.get("sources") or [])):
        raise ValueError("sources and fingerprints differ")
    for source, h in prints.items():
        if not re.fullmatch(r"[0-9a-f]{64}", h) or source.startswith("/") or ".." in source.split("/") or re.match(r"[A-Za-z]:", source):
            raise ValueError(f"bad source in pack: {source!r}")
    return pack


def pack_text(pack: dict[str, Any]) -> str:
    """Indented JSON with sorted keys and a final line end."""
    return json.dumps(check_pack(pack), indent=2, sort_keys=True, ensure_ascii=False) + "\n"
