"""History of reviews, rule sets and reports as files."""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "entry_id string, kind string, at string, title string, findings int, payload string"


def save_entries(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def read_entries(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Newest first; lines that can't be read are left out, and of entries with one id the last saved stays."""
    rows = spark.read.schema(ENTRY + ", broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    rows = rows.withColumn("file_time", F.col("_metadata.file_modification_time")).where("broken is null and entry_id is not null")
    last = rows.withColumn("turn", F.row_number().over(Window.partitionBy("entry_id").orderBy(F.desc("file_time")))).where("turn = 1").select("entry_id", "kind", "at", "title", "findings", "payload").orderBy(F.desc("entry_id"))
    return last.limit(most) if most else last


def pruned(entries: DataFrame, most: int = 200) -> DataFrame:
    """The newest entries, for writing to a new folder."""
    return entries.orderBy(F.desc("entry_id")).limit(most)


def updated(entries: DataFrame, patches: DataFrame, columns: tuple[str, ...] = ("title", "payload")) -> DataFrame:
    """Entries with the patches' values (entry_id, columns) where they have any; only the named columns change."""
    p = patches.select("entry_id", *[F.col(c).alias(f"new_{c}") for c in columns])
    out = entries.join(p, "entry_id", "left")
    return out.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else c for c in entries.columns])


def without(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("entry_id"), "entry_id", "left_anti")


def load_rules(path: str) -> list[dict]:
    """Rule sets under ``path``, JSON or, where its library is there, YAML; the layer comes from the folder, unknown keys into note."""
    try:
        import yaml
    except ImportError:
        yaml = None
    found = []
    for file in sorted(Path(path).rglob("*")):
        if file.suffix == ".json":
            data = json.loads(file.read_text(encoding="utf-8"))
        elif file.suffix in (".yaml", ".yml") and yaml:
            data = yaml.safe_load(file.read_text(encoding="utf-8"))
        else:
            continue
        known = {"no", "text", "group", "agent", "mode", "check", "params", "applies_to", "note"}
        for pos, item in enumerate((data or {}).get("items", [])):
            rest = {k: v for k, v in item.items() if k not in known}
            found.append({k: item.get(k) for k in known} | {"layer": file.parent.name, "pos": pos, "note": " ".join(filter(None, [item.get("note"), json.dumps(rest, ensure_ascii=False) if rest else None]))})
    return found


def write_reports(reports: DataFrame, path: str, kind: str = "json") -> None:
    """Reports (doc_id, report) as text files, or tables as JSON lines or CSV."""
    if kind == "text":
        reports.select("report").write.mode("overwrite").text(path)
    elif kind == "csv":
        reports.write.mode("overwrite").option("header", "true").csv(path)
    else:
        reports.write.mode("overwrite").json(path)


def _checklist_file(path: str, checklist_id: str) -> Path:
    if not re.fullmatch("[a-z0-9]{8,32}", checklist_id or ""):
        raise ValueError(f"not the id of a checklist: {checklist_id!r}")
    return Path(path) / f"{checklist_id}.json"


def save_checklist(path: str, name: str, source_filename: str, columns: dict, items: list[dict], scope: str = "업로드", team: str = "") -> str:
    """Write an uploaded rule set as a JSON file; its id is the file's name. One without items is refused."""
    if not items:
        raise ValueError("a checklist needs at least one item")
    key = uuid.uuid4().hex[:16]
    at = datetime.now(timezone.utc).isoformat(timespec="microseconds")
    entry = {"name": (name or "").strip() or source_filename or "checklist", "source_filename": source_filename or "", "registered_at": at, "columns": columns, "items": items, "scope": scope, "team": team}
    file = _checklist_file(path, key)
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps(entry, ensure_ascii=False), encoding="utf-8")
    return key


def checklists(spark: SparkSession, path: str) -> DataFrame:
    """id, name, source_filename, registered_at, scope, team, item_count of the saved rule sets, newest first; files that can't be read are left out."""
    schema = "name string, source_filename string, registered_at string, scope string, team string, items array<string>, broken string"
    rows = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "broken").option("pathGlobFilter", "*.json").json(path)
    named = rows.select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("id"), "*").where("broken IS NULL")
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("name", "source_filename", "registered_at", "scope", "team")]
    return named.select("id", *text, F.greatest(F.size(F.coalesce("items", F.array().cast("array<string>"))), F.lit(0)).alias("item_count")).orderBy(F.desc("registered_at"), F.desc("id"))


def checklist(path: str, checklist_id: str) -> dict:
    """A saved rule set with its items; the id is the file's, whatever the file says."""
    return json.loads(_checklist_file(path, checklist_id).read_text(encoding="utf-8")) | {"id": checklist_id}


def delete_checklist(path: str, checklist_id: str) -> bool:
    """Whether there was one to delete."""
    file = _checklist_file(path, checklist_id)
    there = file.exists()
    file.unlink(missing_ok=True)
    return there
