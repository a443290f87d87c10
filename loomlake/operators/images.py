"""Image attachments: a model of your own looks at them, its findings become text, front matter and files beside the page.

The model is a function from bytes and the page's context to an ``Analysis``; it
runs in the tasks that read the images.  No model comes with the package.
"""

from __future__ import annotations

import hashlib
import json
import mimetypes
import re
from collections.abc import Callable
from dataclasses import dataclass

from loomlake.operators.convert import Artifact, Converted, Converter, Parent

#: Endings of images, title and headings of an analysis.
EXTENSIONS = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tif", "tiff")
TITLE, SUMMARY, TEXT = "Bildanalyse", "Kurzbeschreibung", "Erkannter Text"


@dataclass(frozen=True)
class Analysis:
    """What a model finds in an image."""

    summary: str
    kind: str = "unknown"
    text: str = ""
    signals: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()
    ocr_provider: str = ""
    vision_provider: str = ""


def converter(analyse: Callable[[bytes, Parent], Analysis], name: str = "image", extensions: tuple[str, ...] = EXTENSIONS) -> Converter:
    """Images as text, with a reference for the front matter and the whole analysis as two files named after page and image."""

    def run(data: bytes, parent: Parent) -> Converted:
        found = analyse(data, parent)
        parts = [(SUMMARY, found.summary), (TEXT, found.text)]
        body = "\n\n".join(f"## {head}\n\n{said.strip()}" for head, said in parts if said.strip())
        stem = re.sub(r"[^\w.-]+", "-", parent.name.rpartition(".")[0] or parent.name).strip("-").lower() or "image"
        base = f"{parent.id}__image__{stem}"
        reference = {
            "attachment_name": parent.name, "attachment_path": parent.local_path, "mime_type": mimetypes.guess_type(parent.name)[0] or "application/octet-stream", "sha256": hashlib.sha256(data).hexdigest(),
            "image_kind": found.kind, "summary": found.summary, "signals": list(found.signals), "entities": list(found.entities), "ocr_provider": found.ocr_provider, "vision_provider": found.vision_provider,
            "derived_md_file": f"{base}.md", "derived_json_file": f"{base}.json",
        }
        head = {"title": f"{TITLE}: {parent.name}", "parent_id": parent.id, "parent_title": parent.title, "source_url": parent.source_url, "image": parent.name}
        lines = "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in head.items() if v)
        files = (
            Artifact(f"{base}.md", "text/markdown", f"---\n{lines}---\n\n{body}\n"),
            Artifact(f"{base}.json", "application/json", json.dumps({**reference, "text": found.text, "parent_id": parent.id}, ensure_ascii=False, indent=2) + "\n"),
        )
        return Converted(body, found.warnings, reference, files)

    return Converter(name, extensions, run, in_context=True)
