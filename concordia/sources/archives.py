"""Annotation archives: ZIP files of JSON and JSONL as a Python data source, one partition an archive.

The planning step only lists archives; entries are checked and read on executors. Guards: absolute or climbing paths, links,
encrypted entries, entries too large or too compressed, repeated names, archives without any JSON.
"""

from __future__ import annotations

import io
import json
import unicodedata
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTAINERS = ("annotations", "documents", "records", "items", "data")
MAX_ENTRY, MAX_RATIO, MAX_ENTRIES = 256 << 20, 200, 100_000


class ArchiveError(ValueError):
    pass


def entry_name(raw: str) -> str:
    name = unicodedata.normalize("NFC", raw).replace("\\", "/")
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if name.startswith("/") or ":" in name.split("/")[0] or ".." in parts or not parts:
        raise ArchiveError(f"unsafe entry name: {raw!r}")
    return "/".join(parts).casefold()


def check_entry(info: zipfile.ZipInfo) -> None:
    if (info.external_attr >> 16) & 0o170000 == 0o120000:
        raise ArchiveError(f"{info.filename}: a link")
    if info.flag_bits & 1:
        raise ArchiveError(f"{info.filename}: encrypted")
    if info.file_size > MAX_ENTRY or info.file_size > MAX_RATIO * max(1, info.compress_size):
        raise ArchiveError(f"{info.filename}: too large")


def entries(data: bytes) -> list[tuple[str, zipfile.ZipInfo]]:
    """Checked JSON entries by normalised name."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
    if len(infos) > MAX_ENTRIES:
        raise ArchiveError("too many entries")
    names: dict[str, zipfile.ZipInfo] = {}
    for info in infos:
        check_entry(info)
        name = entry_name(info.filename)
        if name in names:
            raise ArchiveError(f"repeated entry: {name}")
        names[name] = info
    found = [(n, i) for n, i in sorted(names.items()) if n.endswith((".json", ".jsonl"))]
    if not found:
        raise ArchiveError("no JSON entry")
    return found


def objects(payload) -> list[dict]:
    """A list, the list in a known container, or the object itself."""
    if isinstance(payload, dict):
        payload = next((payload[k] for k in CONTAINERS if isinstance(payload.get(k), list)), [payload])
    if not isinstance(payload, list) or not all(isinstance(x, dict) for x in payload):
        raise ArchiveError("records must be JSON objects")
    return payload


def records(data: bytes) -> Iterator[tuple[str, int, str]]:
    """(entry, number, JSON text) of every record."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name, info in entries(data):
            with z.open(info) as f:
                text = f.read(MAX_ENTRY + 1).decode("utf-8-sig")
            rows = [json.loads(line) for line in text.splitlines() if line.strip()] if name.endswith(".jsonl") else objects(json.loads(text))
            for i, row in enumerate(rows):
                yield name, i, json.dumps(row, ensure_ascii=False, sort_keys=True)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, entry_name, record_index, payload. Archives come through Spark's own file reader, so any store that Spark reads will do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(p, *r) for r in records(bytes(data))]
                yield pd.DataFrame(rows, columns=["archive", "entry_name", "record_index", "payload"])

    return files.mapInPandas(run, "archive string, entry_name string, record_index int, payload string")


def audit_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, entries, json_entries, bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                found = entries(bytes(data))
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    infos = [i for i in z.infolist() if not i.is_dir()]
                out.append((p, len(infos), len(found), sum(i.file_size for i in infos)))
            yield pd.DataFrame(out, columns=["archive", "entries", "json_entries", "bytes"])

    return files.mapInPandas(run, "archive string, entries int, json_entries int, bytes long")


def annotation_records(rows: DataFrame) -> DataFrame:
    """Payloads that are annotations (any of four keys), with a document id that both id fields agree on."""
    keys = F.json_object_keys("payload")
    known = F.arrays_overlap(keys, F.array(*map(F.lit, ("evrakId", "document_id", "current_references", "annotation"))))
    a, b = (F.nullif(F.trim(F.get_json_object("payload", f"$.{k}")), F.lit("")) for k in ("evrakId", "document_id"))
    done = F.coalesce(F.get_json_object("payload", "$.annotation.is_completed"), F.get_json_object("payload", "$.is_completed")).cast("boolean")
    return rows.where(known).select("*", F.coalesce(a, b).alias("doc_key"), (a.isNotNull() & b.isNotNull() & (a != b)).alias("id_conflict"), done.alias("completed"))
