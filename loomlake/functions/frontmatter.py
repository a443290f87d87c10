"""Front matter of Markdown texts: parsing, normalising, checking and rendering, with Arrow wrappers."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # the lenient parser then reads key: value lines only
    yaml = None

#: Required fields, kinds of fields, allowed values, and the order of fields.
REQUIRED = ["title", "source_type", "source_system", "source_key"]
LISTS = ["tags", "authors", "attachments", "aliases"]
DICTS = ["source_meta"]
STATUS = ["raw", "draft", "reviewed", "curated"]
VISIBILITY = ["internal", "restricted", "public"]
ORDER = (
    "title source_type source_system source_key source_url original_id original_path created_at updated_at imported_at status tags language authors visibility "
    "content_hash domain scope category subcategory customer project ingestion_source ingestion_job version attachments aliases source_meta"
).split()


def as_list(value: Any) -> list[str]:
    """A list, a comma-separated text or a scalar as trimmed, non-empty strings."""
    if value is None:
        return []
    items = value if isinstance(value, list | tuple | set) else value.split(",") if isinstance(value, str) else [value]
    return [s for x in items if (s := str(x).strip())]


def split(text: str) -> tuple[str | None, str]:
    """The front matter's lines and the body; None where the text does not begin with a closed block."""
    lines = text.splitlines(keepends=True)
    if lines and lines[0].strip() == "---":
        for i, line in enumerate(lines[1:], start=1):
            if line.strip() == "---":
                return "".join(lines[1:i]), "".join(lines[i + 1 :])
    return None, text


def parse(text: str, strict: bool = False) -> tuple[dict[str, Any], str]:
    """Metadata and body. Without ``strict``, broken YAML is read as key: value lines."""
    head, body = split(text)
    if head is None:
        return {}, text
    try:
        if yaml is None:
            raise ValueError("no YAML reader")
        data = yaml.safe_load(head)
        if not isinstance(data, dict | None):
            raise ValueError("front matter is no mapping")
        data = data or {}
    except Exception:
        if strict:
            raise
        pairs = (line.partition(":") for line in head.splitlines() if ":" in line)
        data = {k.strip(): v.strip().strip("\"'") for k, _, v in pairs if k.strip()}
    if "tags" in data:
        data["tags"] = as_list(data["tags"])
    return data, body.lstrip("\n")


def normalise(data: dict[str, Any]) -> dict[str, Any]:
    """Lists coerced, empty values dropped (0 and false stay), fields in order, unknown ones sorted behind."""
    data = {k: as_list(v) if k in LISTS else v for k, v in data.items()}
    data = {k: v for k, v in data.items() if v is not None and v not in ("", [], {})}
    return {k: data[k] for k in [*(k for k in ORDER if k in data), *sorted(set(data) - set(ORDER))]}


def merge(base: dict[str, Any], more: dict[str, Any]) -> dict[str, Any]:
    """``more`` wins; source_meta is merged key by key."""
    out = {**base, **more}
    if isinstance(base.get("source_meta"), dict) and isinstance(more.get("source_meta"), dict):
        out["source_meta"] = {**base["source_meta"], **more["source_meta"]}
    return normalise(out)


def problems(data: dict[str, Any]) -> list[str]:
    out = [f"missing: {k}" for k in REQUIRED if data.get(k) in (None, "")]
    out += [f"no list: {k}" for k in LISTS if k in data and not isinstance(data[k], list)]
    out += [f"no mapping: {k}" for k in DICTS if k in data and not isinstance(data[k], dict)]
    out += [f"invalid: {k}" for k, allowed in (("status", STATUS), ("visibility", VISIBILITY)) if data.get(k) and data[k] not in allowed]
    return out


def render(data: dict[str, Any], body: str) -> str:
    data = normalise(data)
    head = yaml.safe_dump(data, allow_unicode=True, sort_keys=False) if yaml else "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in data.items())
    return f"---\n{head}---\n\n{body.strip()}\n"


def parse_column(texts: Column) -> Column:
    """Front matter as JSON, body, and what is wrong with it: a struct column."""

    def parsed(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for t in batch:
            data, body = parse(t or "")
            rows.append((json.dumps(data, default=str, ensure_ascii=False, sort_keys=True), body, problems(data)))
        return pd.DataFrame(rows, columns=["meta", "body", "problems"])

    # made here, not at import: a worker that imports this module has no session
    return F.pandas_udf(parsed, "meta string, body string, problems array<string>")(texts)


def missing_fields(meta: Column, required: list[str] = REQUIRED) -> Column:
    """Required keys that a map<string,string> lacks or holds empty."""
    return F.filter(F.array(*[F.lit(k) for k in required]), lambda k: F.trim(F.coalesce(F.element_at(meta, k), F.lit(""))) == "")
