"""Wiki storage format, issue markup and HTML pages as Markdown.

The markup is parsed once into a tree, and one recursive walk renders it.  The
walk collects warnings, unsupported macros, tasks, key-value properties and
tables that are too complex for Markdown, so nested macros need no repeated
passes.  The cores are plain Python; ``render_pages`` runs them over pieces of Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.runtime import ensure_package, pieces

#: Macros by treatment, task words, and bounds of tables.
CALLOUTS = set("info note warning tip panel".split())
SECTIONS = {"expand", "details"}
DROPPED = set(
    "toc page-properties-report contentbylabel classifications-hierarchy classifications-category anchor create-from-template livesearch profile tasks-report-macro children "
    "classifications-status detailssummary content-report-table table-excerpt table-excerpt-include attachments table-joiner excerpt gadget multiexcerpt-include change-history include "
    "pagetree recently-updated c4c-property-report lastpageupdate glossary-navigation-bar macrosuite-button excerpt-include jirachart calendar spreadsheet-table roadmap glossary-term "
    "wireframe drawio draw.io diagrams.net drawio-sketch inc-drawio glossary-search-name contributors ISSUES_REPORTED_LIST TEST_RESULTS_OVERALL_PROGRES TEST_CASES_CREATED_OVER_TIME "
    "TEST_CASES_SUMMARY_BY_STATUS TEST_CASES_BY_PROJECT_LIST TEST_CASES_BY_FOLDER_LIST TEST_CASES_BY_COMPONENT_LIST TEST_RESULTS_ADVANCED TEST_RESULTS_SUMMARY_BY_COMPONENT "
    "TEST_RESULTS_SUMMARY_BY_LABEL TEST_RESULTS_SUMMARY_BY_STATUS TEST_RESULTS_SUMMARY_BY_TEST_RUN linkgraph leanix-widget listlabels viewxls viewpdf".lower().split()
)
UNWRAPPED = set(
    "task-list table-filter u7 tablefilter table-chart tablechart table-transformer details-summary column multiexcerpt macrosuite-cards "
    "classifications-combined-taxonomy macrosuite-panel section pivot-table code flowchart".split()
)
MACRO_NAME = re.compile(r"^[a-zA-Z0-9_.-]{1,80}$")
TRIVIAL = {"fyi", "ok", "okay", "done", "?", "bitte ansehen", "siehe oben", "passt", "erledigt", "anschauen", "bitte prüfen", "prüfen"}
DECISION = ["bestätigt", "freigegeben", "genehmigt", "reviewed", "approved", "abgenommen", "entschieden", "akzeptiert"]
DOMAIN = ["architektur", "schnittstelle", "integration", "s/4", "utilities", "emma", "cr", "review", "abnahme", "freigabe", "entscheidung"]
MOST_ROWS, MOST_COLUMNS, LABEL_CHARS, LABEL_WORDS = 15, 6, 40, 6
VOID = {"br", "hr", "img", "input", "meta", "link", "col", "ri:user", "ri:page", "ri:url", "ri:attachment"}
HEADER_PAIRS = ({"key", "field", "name", "property"}, {"value", "wert"})


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def find(self, *tags: str) -> Iterator[Node]:
        for x in self.children:
            if isinstance(x, Node):
                if x.tag in tags:
                    yield x
                yield from x.find(*tags)

    def nearest(self, tag: str, stop: str) -> list[Node]:
        """The nodes of a tag below this one, not those inside another node of the tag ``stop``; in order, each node is visited once."""
        out, left = [], [x for x in reversed(self.children) if isinstance(x, Node)]
        while left:
            x = left.pop()
            if x.tag == tag:
                out.append(x)
            if x.tag != stop:
                left += [y for y in reversed(x.children) if isinstance(y, Node)]
        return out

    def first(self, tag: str) -> Node | None:
        return next(self.find(tag), None)

    def text(self) -> str:
        return "".join(x if isinstance(x, str) else "\n" if x.tag == "br" else x.text() for x in self.children)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.open[-1].children.append(data[6:])


def read(markup: str) -> Node:
    # a reader of HTML ends CDATA at the first ">": sections are escaped before
    markup = re.sub(r"<!\[CDATA\[(.*?)\]\]>", lambda m: m.group(1).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"), markup, flags=re.DOTALL)
    r = _Reader()
    r.feed(markup)
    r.close()
    return r.root


@dataclass
class Task:
    text: str
    status: str
    people: list[str]
    links: list[str]
    due: str | None
    keep: str
    drop: str


def classify_task(text: str, people: list[str], links: list[str], due: str | None) -> tuple[str, str]:
    """Why a task is kept, or why it is dropped."""
    low = text.lower()
    says = len(text.split()) >= 3 or bool(re.search(r"\d|[A-Z][a-z]+", text))
    for drop, holds in (("missing_mention", not people), ("empty_after_cleanup", not text), ("trivial_communication", re.sub(r"[.!]+$", "", low).strip() in TRIVIAL)):
        if holds:
            return "", drop
    for keep, holds in (("has_link", links), ("has_due_date", due), ("decision_signal", any(w in low for w in DECISION)), ("domain_signal", any(w in low for w in DOMAIN)), ("assignee_with_statement", says)):
        if holds:
            return keep, ""
    return "", "insufficient_signal"


def property_name(key: str) -> str:
    """A property's label as rules compare it, as ``functions.text.property_key`` gives it in plans."""
    k = key.lower()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("/", " ")):
        k = k.replace(a, b)
    return re.sub(r"\s+", " ", re.sub("[_-]+", " ", re.sub(r"[^a-z0-9\s_-]", "", k))).strip()


class Renderer:
    """``hidden``: names of properties that are not repeated in the text where they have a value; ``stem``: how the page's file names begin;
    ``properties``: the page is about properties, so that complex tables of labels keep labels and first values only.

    Warnings are codes, messages say the same in words. Tables that are too complex for the text are
    (shape, rows) of documents of their own, named in the text.
    """

    def __init__(self, url: str | None = None, hidden: frozenset[str] = frozenset(), stem: str = "page", properties: bool = False):
        self.url, self.hidden, self.stem, self.properties_only = url, hidden, stem, properties
        self.warnings: list[str] = []
        self.messages: list[str] = []
        self.unsupported: list[str] = []
        self.tasks: list[Task] = []
        self.properties: dict[str, str] = {}
        self.tables: list[tuple[str, str]] = []

    def warn(self, code: str, message: str) -> None:
        self.warnings.append(code)
        self.messages.append(message)

    def degraded(self, message: str) -> None:
        self.warn("degraded_macro_rendering", message)

    def not_supported(self, name: str) -> None:
        self.unsupported.append(name)
        self.warn("unsupported_macro", f"Nicht unterstütztes Makro erkannt: {name}")

    def all(self, node: Node) -> str:
        return "".join(re.sub(r"[ \t\r\n]+", " ", x) if isinstance(x, str) else self.one(x) for x in node.children)

    def one(self, n: Node) -> str:
        if m := re.fullmatch(r"h([1-6])", n.tag):
            return f"\n{'#' * int(m.group(1))} {self.all(n).strip()}\n"
        plain = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
        if n.tag in plain:
            own = self.all(n).strip()
            return f"{plain[n.tag]}{own}{plain[n.tag]}" if own else ""
        if n.tag == "pre":
            return f"\n```\n{n.text().strip()}\n```\n"
        if n.tag in ("p", "div"):
            return f"{self.all(n)}\n\n"
        if n.tag == "br":
            return "\n"
        if n.tag in ("ul", "ol"):
            return f"\n{self.all(n)}\n"
        if n.tag == "li":
            return f"- {self.all(n).strip()}\n"
        if n.tag == "a" and n.attrs.get("href"):
            return f"[{n.text().strip() or n.attrs['href'].strip()}]({n.attrs['href'].strip()})"
        if n.tag == "ac:link":
            return self.page_link(n)
        if n.tag == "ri:user":
            return n.attrs.get("ri:display-name", "Benutzer")
        if n.tag == "table":
            return self.table(n)
        if n.tag == "ac:structured-macro":
            return self.macro(n)
        if n.tag == "ac:task-list":
            self.tasks += [self.task(t) for t in n.find("ac:task")]
            return "\n"
        if n.tag in ("ac:placeholder", "script", "style", "head", "title", "ac:parameter"):
            return ""
        return self.all(n)

    def page_link(self, n: Node) -> str:
        page = n.first("ri:page")
        title = page.attrs.get("ri:content-title", "").strip() if page else ""
        body = n.first("ac:plain-text-link-body")
        said = (body.text().strip() if body else "") or title
        if not title:
            return said
        slug = title.lower().replace(" ", "-")
        return f"[{said}]({urljoin(self.url, f'/wiki/{slug}') if self.url else f'wiki://page/{slug}'})"

    def macro(self, n: Node) -> str:
        given = n.attrs.get("ac:name", "")
        name = given.lower()
        params = {p.attrs.get("ac:name", ""): p.text().strip() for p in n.children if isinstance(p, Node) and p.tag == "ac:parameter"}
        body = next((x for x in n.children if isinstance(x, Node) and x.tag in ("ac:rich-text-body", "ac:plain-text-body")), None)
        if not MACRO_NAME.match(given):
            self.warn("macro_name_parse_error", f"Ungültiger Makroname erkannt und auf unknown_macro gesetzt: {given[:80]}" if given else "Makro ohne auslesbaren Namen erkannt.")
            self.not_supported("unknown_macro")
            return self.all(body) if body else ""
        if name in DROPPED:
            return ""
        if name in CALLOUTS:
            lines = (self.all(body).strip() if body else "").splitlines() or [""]
            return "\n" + "\n".join([f"> **{name.upper()}:** {lines[0]}", *(f"> {x}" for x in lines[1:])]).strip() + "\n"
        if name in SECTIONS:
            return f"\n## {params.get('title') or 'Details'}\n\n{self.all(body).strip() if body else ''}\n"
        if name in ("plantuml", "plantumlrender"):
            if body is None:
                self.degraded("PlantUML-Makro ohne lesbaren CDATA-Body erkannt.")
                return "\n[PLANTUML_BLOCK]\n"
            return f"\n```plantuml\n{body.text().strip()}\n```\n"
        if name == "status":
            return params.get("title") or "Unbekannt"
        if name in ("jira", "view-file"):
            label = "Jira-Vorgang" if name == "jira" else "Datei"
            at = n.first("ri:attachment")
            key = (params.get("key") or params.get("jqlQuery")) if name == "jira" else params.get("name") or (at.attrs.get("ri:filename") if at else None)
            link = n.first("ri:url")
            url = (params.get("server") if name == "jira" else None) or (link.attrs.get("ri:value") if link else None)
            if not key and not url:
                self.degraded("Jira-Makro ohne verwertbare Details erkannt." if name == "jira" else "view-file-Makro ohne Dateidetails erkannt.")
                return f"\n[{'JIRA' if name == 'jira' else 'FILE'}_BLOCK]\n"
            return f"\n**{label}:** {f'[{key}]({url})' if key and url else key or url}\n"
        if name not in UNWRAPPED:
            self.not_supported(given)
        if body is None:
            return ""
        return body.text() if body.tag == "ac:plain-text-body" else self.all(body)

    def task(self, n: Node) -> Task:
        body = n.first("ac:task-body") or Node("empty")
        status = n.first("ac:task-status")
        people = list(dict.fromkeys(u.attrs["ri:display-name"].strip() for u in body.find("ri:user") if u.attrs.get("ri:display-name", "").strip()))
        links = list(dict.fromkeys(x for x in [*(u.attrs.get("ri:value", "").strip() for u in body.find("ri:url")), *(a.attrs.get("href", "").strip() for a in body.find("a"))] if x))
        text = re.sub(r"\s+", " ", body.text()).strip()
        due = re.search(r"\b(\d{4}-\d{2}-\d{2})\b", text)
        text = re.sub(r"^[@,:\s-]+", "", text).strip(" .-")
        keep, drop = classify_task(text, people, links, due.group(1) if due else None)
        return Task(text, "completed" if status and status.text().strip().lower() == "complete" else "open", people, links, due.group(1) if due else None, keep, drop)

    def table(self, n: Node) -> str:
        own = n.nearest("tr", "table")
        rows = [[c for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in own]
        rows = [r for r in rows if r]
        if not rows:
            return ""
        said = [[re.sub(r"\s+", " ", self.all(c)).strip() for c in r] for r in rows]
        nested = n.first("table") is not None
        spans = any(c.attrs.get(a, "1") not in ("", "1") for r in rows for c in r for a in ("colspan", "rowspan"))
        if not nested and not spans and (pairs := key_values(rows, said)):
            self.properties |= {k: v for k, v in pairs if k and k not in self.properties}
            shown = [f"- **{k}:** {v}" for k, v in pairs if k and not (v and property_name(k) in self.hidden)]
            return "\n" + "\n".join(shown) + "\n" if shown else ""
        width = max(map(len, said))
        if nested or spans or len(rows) > MOST_ROWS or width > MOST_COLUMNS:
            if self.properties_only and all(len(r) == 2 for r in rows) | all(len(r) > 1 and r[0].tag == "th" for r in rows):
                rows, said = [r[:2] for r in rows], [r[:2] for r in said]
            self.tables.append((f"Zeilen={len(rows)}, Spalten={width}, nested_table={nested}, spans={spans}", flattened(rows, said)))
            return f"\n[Komplexe Tabelle ausgelagert: {table_file(self.stem, len(self.tables))}]\nHinweis: rows={len(rows)}, cols={width}, nested={nested}, spans={spans}.\n"
        cells = [[x.replace("|", "\\|") for x in r] + [""] * (width - len(r)) for r in said]
        head = cells[0] if any(c.tag == "th" for c in rows[0]) else [""] * width
        body = cells[1:] if head is cells[0] else cells
        return "\n" + "\n".join(f"| {' | '.join(r)} |" for r in [head, ["---"] * width, *body]) + "\n"


def label_like(text: str) -> bool:
    return bool(text) and len(text) <= LABEL_CHARS and len(text.split(" ")) <= LABEL_WORDS and bool(re.search(r"[A-Za-zÄÖÜäöüß0-9]", text))


def key_values(rows: list[list[Node]], said: list[list[str]]) -> list[tuple[str, str]] | None:
    """Label and value of each row where a table reads as properties, else None."""
    two = all(len(r) == 2 for r in rows)
    if not two and not (any(len(r) > 2 for r in rows) and all(len(r) >= 2 and r[0].tag == "th" for r in rows)):
        return None
    pairs = [(r[0], r[1]) for r in said]
    if pairs[0][0].lower() in HEADER_PAIRS[0] and pairs[0][1].lower() in HEADER_PAIRS[1]:
        return None
    if two and all(c.tag == "th" for c in rows[0]) and len(rows) > 1:
        return None
    n = len(pairs)
    return pairs if sum(label_like(k) for k, _ in pairs) >= 0.8 * n and sum(bool(v) for _, v in pairs) >= 0.6 * n else None


def table_file(stem: str, number: int) -> str:
    return f"{stem}__table_{number:02d}.md"


def flattened(rows: list[list[Node]], said: list[list[str]]) -> str:
    """A line for each row of a complex table, each cell by its column's header where the first row is one, with the cells' spans."""

    def value(cell: Node, text: str) -> str:
        across, down = (int(n) if (n := cell.attrs.get(a, "1").strip()).isdigit() else 1 for a in ("colspan", "rowspan"))
        return (text or "(leer)") + (f" [span c{across}/r{down}]" if across > 1 or down > 1 else "")

    headed = len(rows) > 1 and all(cell.tag == "th" for cell in rows[0])
    names = [text or f"Spalte {i}" for i, text in enumerate(said[0], 1)] if headed else []
    label = (lambda i: names[i - 1] if i <= len(names) else f"Spalte {i}") if headed else (lambda i: f"Zelle {i}")
    kind, first = ("Zeile", 1) if headed else ("Originalzeile", 0)
    lines = []
    for number, (cells, texts) in enumerate(zip(rows[first:], said[first:]), 1):
        pairs = (f"{label(i)}={value(cell, text)}" for i, (cell, text) in enumerate(zip(cells, texts), 1))
        lines.append(f"- {kind} {number}: {' | '.join(pairs)}")
    return "\n".join(lines)


def drop_empty_headings(text: str) -> str:
    """Removes headings without any line before the next heading of the same or a higher level, deepest first."""
    lines = text.split("\n")
    level = lambda x: len(m.group(1)) if (m := re.match(r"^(#{1,6})\s+", x)) else 0
    for depth in (3, 2, 1):
        kept = []
        for i, line in enumerate(lines):
            if level(line) == depth:
                after = next((x for x in lines[i + 1 :] if x.strip()), "")
                if not after or 0 < level(after) <= depth:
                    continue
            kept.append(line)
        lines = kept
    return "\n".join(lines)


def clean(text: str) -> str:
    text = re.sub(r"[ \t]+\n", "\n", text.replace("\r\n", "\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def to_markdown(markup: str, url: str | None = None, hidden: frozenset[str] = frozenset(), stem: str = "page", properties: bool = False) -> tuple[str, Renderer]:
    r = Renderer(url, hidden, stem, properties)
    text = r.all(read(markup))
    for title, status in (("Open Tasks", "open"), ("Completed Tasks", "completed")):
        own = [t for t in r.tasks if t.status == status and not t.drop]
        if own:
            parts = []
            for t in own:
                more = [("Mentions", ", ".join(t.people)), ("Status", t.status), ("Date", t.due), ("Links", ", ".join(t.links))]
                parts.append("\n".join([f"- {t.text}.", *(f"  {k}: {v}." for k, v in more if v)]))
            text = f"{text.rstrip()}\n\n## {title}\n\n" + "\n".join(parts) + "\n"
    return clean(drop_empty_headings(clean(text))), r


RENDERED = T.StructType([
    T.StructField("markdown", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("messages", T.ArrayType(T.StringType())), T.StructField("unsupported", T.ArrayType(T.StringType())),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("tables", T.ArrayType(T.StructType([T.StructField("shape", T.StringType()), T.StructField("rows", T.StringType())]))), T.StructField("n_tasks", T.IntegerType()), T.StructField("error", T.StringType()),
])


#: The rendered columns as Arrow makes them.
_ARROW = [pa.string(), *[pa.list_(pa.string())] * 3, pa.map_(pa.string(), pa.string()), pa.list_(pa.struct([("shape", pa.string()), ("rows", pa.string())])), pa.int32(), pa.string()]


def render_pages(pages: DataFrame, body: str, url: str | None = None, hidden: frozenset[str] = frozenset(), stem: Column | None = None, properties: Column | None = None) -> DataFrame:
    """All columns of ``pages`` with the rendered columns; ``stem``: how the names of a page's files begin, ``properties``: whether it is about properties. A page that cannot be read has an error and a null text."""
    ensure_package(pages.sparkSession)
    schema = T.StructType([*[f for f in pages.schema.fields if f.name not in RENDERED.names], *RENDERED.fields])
    kept = schema.names[: -len(RENDERED.names)]
    own = body if body in kept else "__body"  # what is kept is not sent twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            out = []
            for markup, at, stem, about in zip(*(piece.column(n).to_pylist() for n in (own, "__url", "__stem", "__properties"))):
                try:
                    text, r = to_markdown(markup or "", at, hidden, stem or "page", bool(about))
                    tables = [{"shape": shape, "rows": rows} for shape, rows in r.tables]
                    out.append((text, sorted(set(r.warnings)), r.messages, sorted(set(r.unsupported)), list(r.properties.items()), tables, len(r.tasks), None))
                except Exception as e:  # one page must not end the run; its row says why
                    out.append((None, [], [], [], [], [], 0, str(e)))
            columns = [pa.array(v, t) for v, t in zip(zip(*out), _ARROW)]
            yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in kept), *columns], names=schema.names)

    more = [] if own == body else [F.col(body).alias(own)]
    frame = pages.select(*kept, *more, (F.col(url) if url else F.lit(None)).cast("string").alias("__url"), (F.lit("page") if stem is None else stem).alias("__stem"), F.coalesce(F.lit(False) if properties is None else properties, F.lit(False)).alias("__properties"))
    return frame.mapInArrow(run, schema)


def macro_report(pages: DataFrame) -> DataFrame:
    """How often each unsupported macro occurs, most frequent first."""
    return pages.select(F.explode("unsupported").alias("macro")).groupBy("macro").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "macro")
