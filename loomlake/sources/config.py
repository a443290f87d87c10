"""Rule files: terms and source modes in YAML, mapping and publishing rules in TOML, as frames and plan constants.

Rule files are small and read on the driver; what a plan joins is a frame.
"""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loomlake.operators.terminology import CANDIDATE, Term

try:
    import yaml
except ImportError:
    yaml = None

TERMS = "ord int, term_id string, canonical string, label string, description string, term_class string, aliases array<string>, annotate string, block string, applies_to array<string>, related array<string>, case_sensitive boolean, priority int"
MODES = "source string, mode string, candidates_enabled boolean"
#: The files of a terminology folder.
FILES = {"settings": "settings.yml", "sources": "sources.yml", "terms": "terms.yml", "exclude": "candidate_exclude.yml"}
RULES = "ord int, id string, target_subpath string, path_prefix string, path_contains string, file_name_contains string"


@dataclass(frozen=True)
class TermSettings:
    """How terms are matched, listed and searched for; the defaults are the usual ones."""

    enabled: bool = True
    block_min_terms: int = 2
    show_aliases_in_block: bool = False
    candidate_detection_enabled: bool = True
    candidate_patterns: list[str] = field(default_factory=lambda: [CANDIDATE])


def read_yaml(path: str) -> dict:
    """A YAML mapping; an empty file is an empty one."""
    if yaml is None:
        raise RuntimeError("rule files in YAML need a YAML reader")
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(data, dict):
        raise ValueError(f"{path} is no mapping")
    return data


def term_rows(data: dict) -> list[tuple]:
    """Entries of a terms file as rows of TERMS, with the usual values for what they leave out."""
    out = []
    for k, e in enumerate(x for x in data.get("terms") or [] if isinstance(x, dict)):
        own = str(e.get("id") or "").strip()
        text = lambda name, default="": str(e.get(name, default)).strip()  # noqa: B023, E731
        items = lambda name: [s for x in e.get(name) or [] if (s := str(x).strip())]  # noqa: B023, E731
        links = [x for x in e.get("relations") or [] if isinstance(x, dict) and x.get("type") == "related_to"]
        related = [s for x in links if (s := str(x.get("target_term_id") or x.get("target_id") or x.get("target") or "").strip())]
        out.append((
            k, own, text("canonical", own), text("label", e.get("canonical", own)), text("description"), text("term_class", "business"), items("aliases"), text("annotate_policy", "first_occurrence"),
            text("block_policy", "include"), items("applies_to"), related, bool(e.get("case_sensitive", False)), int(e.get("priority", 100)),
        ))
    return out


def term_frame(spark: SparkSession, data: dict) -> DataFrame:
    return spark.createDataFrame(term_rows(data), TERMS)


def terms(data: dict) -> list[Term]:
    """The terms in force: entries without id are left out, a later entry of an id replaces an earlier one."""
    last = {r[1]: Term(r[1], r[2], tuple(r[6]), r[3], r[12], r[7], r[8], r[5], r[11], tuple(r[9]), tuple(r[10])) for r in term_rows(data) if r[1]}
    return list(last.values())


def settings(data: dict) -> TermSettings:
    given = data.get("settings", data)
    return TermSettings(**{k: type(v)(given.get(k, v)) for k, v in asdict(TermSettings()).items()})


def modes(spark: SparkSession, data: dict) -> DataFrame:
    """Modes by source; a boolean mode means off or annotate_and_block."""
    return spark.createDataFrame(mode_rows(data), MODES)


@dataclass(frozen=True)
class Glossary:
    """What a folder of terminology files says: terms, how each source is treated, settings, and forms that are no candidates."""

    terms: tuple[Term, ...] = ()
    modes: tuple[tuple[str, str, bool | None], ...] = ()
    settings: TermSettings = field(default_factory=TermSettings)
    exclude: tuple[str, ...] = ()


def mode_rows(data: dict) -> list[tuple[str, str, bool | None]]:
    rows = []
    for name, own in (data.get("sources") or {}).items():
        if isinstance(own, dict):
            mode = own.get("mode", "off")
            mode = ("annotate_and_block" if mode else "off") if isinstance(mode, bool) else str(mode).strip()
            rows.append((name, mode, own.get("candidates_enabled")))
    return rows


def glossary(folder: str) -> Glossary:
    """The files of a terminology folder; the list of excluded candidates may be missing."""
    read = lambda name: read_yaml(f"{folder}/{FILES[name]}")
    out = read("exclude").get("candidate_exclude") or [] if Path(folder, FILES["exclude"]).exists() else []
    return Glossary(tuple(terms(read("terms"))), tuple(mode_rows(read("sources"))), settings(read("settings")), tuple(s for x in out if (s := str(x).strip())))


def file_problems(folder: str) -> list[tuple[str, str, str | None, str]]:
    """(severity, code, term_id, detail) of terminology files that are missing, are no YAML or cannot be taken as what they should hold.

    Files that load as a whole are asked for only if each of them can be read.
    """
    out = []
    for name in ("settings", "sources", "terms"):
        place = Path(folder, FILES[name])
        if not place.exists():
            out.append(("error", "missing_file", None, str(place)))
            continue
        try:
            yaml.safe_load(place.read_text(encoding="utf-8"))
        except Exception as e:  # whatever the reader says is the finding
            out.append(("error", "invalid_yaml", None, f"{place}: {e}"))
    if out:
        return out
    try:
        glossary(folder)
    except Exception as e:
        return [("error", "load_failed", None, f"{folder}: {e}")]
    return []


def mapping_rules(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Rules of a mapping file, in order, and where everything else goes."""
    own = tomllib.loads(Path(path).read_text(encoding="utf-8")).get("mapping", {})
    some = lambda x: str(x).strip() or None if x is not None else None
    rows = [(k, str(r.get("id", f"rule-{k + 1}")), str(r["target_subpath"]), *(some(r.get(n)) for n in ("path_prefix", "path_contains", "file_name_contains"))) for k, r in enumerate(own.get("rules", [])) if isinstance(r, dict)]
    return spark.createDataFrame(rows, RULES), str(own.get("default_target_subpath", "external/unassigned"))


def publish_routes(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(space, domain_path) of a publishing file, and its other values."""
    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    own = (data.get("publish") or {}).get("confluence") or data.get("confluence_publish") or {}
    routes = [(k, str(v)) for k, v in (own.get("space_map") or {}).items()]
    return spark.createDataFrame(routes, "space string, domain_path string"), {k: v for k, v in own.items() if k != "space_map"}
