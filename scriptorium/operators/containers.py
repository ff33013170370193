"""Checks of finished containers, their findings and repairs. A container is a row; its checks are plain Python on its bytes, in Arrow batches."""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from scriptorium.operators.emit import MEDIA_TYPES
from scriptorium.sources.sinks import container_findings, read_entries

# findings' names and what mends them (none: it can only be said).
CONTAINER = "META-INF/container.xml"
FIXES = {"ACC-001": "alt", "NOTE-DANGLING": "plain-reference", "FIGURE-UNUSED": "drop-figure", "RSC-007": None, "RSC-012": None}
WORST = ["fatal", "error", "warning"]
REMOTE = ("http://", "https://", "//", "data:", "mailto:")


def attributes(text: str, name: str) -> list[str]:
    return re.findall(rf'\b{name}="([^"]*)"', text)


def parse_package(entries: dict[str, bytes]) -> tuple[str, dict[str, tuple[str, str, str]], list[str], str] | None:
    """(path, manifest by id: href, media type, properties; spine ids; text) of the package document, or None if there is none."""
    found = attributes(entries.get(CONTAINER, b"").decode("utf-8", "replace"), "full-path")
    if not found or found[0] not in entries:
        return None
    text, base = entries[found[0]].decode("utf-8", "replace"), posixpath.dirname(found[0])
    one = lambda tag, name: (attributes(tag, name) or [""])[0]
    items = {one(t, "id"): (posixpath.join(base, one(t, "href")), one(t, "media-type"), one(t, "properties")) for t in re.findall(r"<item\s[^>]*>", text)}
    return found[0], items, [one(t, "idref") for t in re.findall(r"<itemref\s[^>]*>", text)], text


def check_package(entries: dict[str, bytes]) -> Iterator[tuple[str, str, str]]:
    """Findings (id, severity, location): metadata that is missing, manifest and spine that don't agree with each other or the container, types that aren't the extension's, other than one navigation, items that nothing reaches."""
    package = parse_package(entries)
    if package is None:
        yield "RSC-002", "fatal", CONTAINER
        return
    path, items, spine, text = package
    try:
        ElementTree.fromstring(re.sub(r"<(/?)\w+:", r"<\1", re.sub(r'\s\w+:\w+="[^"]*"', "", text)))
    except ElementTree.ParseError:
        yield "RSC-005", "fatal", path
        return
    unique = attributes(text, "unique-identifier")
    if not unique or not re.search(rf'<dc:identifier[^>]*id="{re.escape(unique[0])}"', text):
        yield "OPF-030", "error", path
    for element in ("<dc:title", "<dc:language", "<dc:identifier", 'property="dcterms:modified"'):
        if element not in text:
            yield "RSC-005", "error", f"{path} {element}"
    for href, kind, _ in items.values():
        if href not in entries:
            yield "RSC-007", "error", href
        expected = MEDIA_TYPES.get(href.rpartition(".")[2].lower())
        if expected and kind != expected:
            yield "OPF-012", "error", href
    for ref in spine:
        if ref not in items:
            yield "RSC-005", "error", f"{path} spine {ref}"
    if sum("nav" in props.split() for _, _, props in items.values()) != 1:
        yield "RSC-005", "error", f"{path} nav"
    known = {href for href, _, _ in items.values()}
    for name in entries:
        if name not in known and name not in ("mimetype", path) and not name.startswith("META-INF/"):
            yield "OPF-003", "warning", name


def resolve(at: str, reference: str) -> str | None:
    """The entry that a reference in a document names; None for one elsewhere or within the document."""
    if reference.startswith(("#", *REMOTE)) or not reference.partition("#")[0]:
        return None
    path = posixpath.normpath(posixpath.join(posixpath.dirname(at), reference.partition("#")[0]))
    return None if path.startswith("..") else path


def check_documents(entries: dict[str, bytes], images: int | None = None) -> Iterator[tuple[str, str, str]]:
    """Findings on the content documents: not well formed, scripts, entities, remote resources, notes that aren't one to one with their references, fragments and resources that don't resolve, images without a text, more or fewer images than expected."""
    package = parse_package(entries)
    items = package[1] if package else {}
    documents = {href: entries[href].decode("utf-8", "replace") for href, kind, _ in items.values() if kind == MEDIA_TYPES["xhtml"] and href in entries}
    ids = {path: set(attributes(text, "id")) for path, text in documents.items()}
    for path, text in documents.items():
        try:
            ElementTree.fromstring(re.sub(r"<(/?)\w+:", r"<\1", re.sub(r'\s\w+:\w+="[^"]*"', "", text)))
        except ElementTree.ParseError:
            yield "RSC-005", "fatal", path
        if re.search(r"<script[ >]", text):
            yield "OPF-014", "error", path
        if re.search(r'(?:src|href)="(?:https?:)?//[^"]*\.(?:css|js|png|jpe?g|gif|svg)"', text):
            yield "RSC-006", "error", path
        for name in ("src", "href"):
            for ref in attributes(text, name):
                target = resolve(path, ref)
                if target is not None and target not in entries:
                    yield "RSC-007", "error", f"{path} → {ref}"
                anchor = ref.partition("#")[2]
                if anchor and not ref.startswith(REMOTE) and anchor not in ids.get(target or path, set()):
                    yield "NOTE-DANGLING" if f'epub:type="noteref" href="{ref}"' in text else "RSC-012", "error", f"{path} → {ref}"
        for tag in re.findall(r"<img\s[^>]*>", text):
            if not "".join(attributes(tag, "alt")).strip():
                yield "ACC-001", "error", path
    refs = [r.partition("#")[2] for text in documents.values() for t in re.findall(r'<a\s[^>]*epub:type="noteref"[^>]*>', text) for r in attributes(t, "href")]
    notes = {i for text in documents.values() for t in re.findall(r'<aside\s[^>]*epub:type="footnote"[^>]*>', text) for i in attributes(t, "id")}
    for r in sorted({r for r in refs if refs.count(r) > 1}):
        yield "NOTE-REPEATED", "error", r
    for n in sorted(notes - set(refs)):
        yield "NOTE-UNUSED", "warning", n
    if images is not None and (there := sum(kind.startswith("image/") and "cover-image" not in props for _, kind, props in items.values())) != images:
        yield "IMAGE-PARITY", "error", f"{there} of {images}"


def check(data: bytes, images: int | None = None) -> list[tuple[str, str, str]]:
    """All findings (id, severity, location) on a container."""
    found = [(i, "error", name) for i, name in container_findings(data)]
    entries = read_entries(data)
    return [*found, *check_package(entries), *check_documents(entries, images)]


def validate_containers(books: DataFrame) -> DataFrame:
    """(doc, id, severity, location) of books (doc, data binary, images or null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(doc, *f) for doc, data, n in zip(b["doc"], b["data"], b["images"], strict=True) for f in check(bytes(data), None if pd.isna(n) else int(n))]
            yield pd.DataFrame(rows, columns=["doc", "id", "severity", "location"])

    return books.select("doc", "data", "images").mapInPandas(run, f"doc {dict(books.dtypes)['doc']}, id string, severity string, location string")


def apply_fix(entries: dict[str, bytes], fix: str, location: str) -> bool:
    """Mend one finding in place; whether anything changed: images get a text, references to notes that aren't there become plain text, figures that nothing refers to and nothing explains go."""
    path, _, ref = location.partition(" → ")
    text = entries.get(path, b"").decode("utf-8", "replace")
    if fix == "alt":
        new = re.sub(r'(<img\s[^>]*?)\s*alt="\s*"', r'\1 alt="Figure"', text)
        new = re.sub(r"<img\s(?![^>]*\balt=)([^>]*)>", r'<img alt="Figure" \1>', new)
    elif fix == "plain-reference":
        new = re.sub(rf'<a\s[^>]*href="{re.escape(ref)}"[^>]*>(.*?)</a>', r"\1", text)
    elif fix == "drop-figure":
        used = set(attributes(" ".join(e.decode("utf-8", "replace") for n, e in entries.items() if n.endswith(".xhtml")), "href"))
        new = re.sub(r'<figure(?:\s+id="([^"]*)")?\s*>(?:(?!</figure>).)*</figure>', lambda m: m.group(0) if "<figcaption" in m.group(0) or any(h.endswith(f"#{m.group(1)}") for h in used) else "", text, flags=re.S)
    else:
        return False
    entries[path] = new.encode()
    return new != text


def measure(findings: list[tuple[str, str, str]]) -> tuple[int, ...]:
    return tuple(sum(s == w for _, s, _ in findings) for w in WORST)


def repair(entries: dict[str, bytes], look: Callable[[dict[str, bytes]], list[tuple[str, str, str]]], rounds: int = 3) -> tuple[dict[str, bytes], list[tuple[str, str, str]]]:
    """Entries after at most so many rounds of repairs, and what is left. A round is kept only if the findings grow strictly less, worst first, and none is of a new kind; a state that was seen before ends it."""
    findings, seen = look(entries), set()
    for _ in range(rounds):
        state = hashlib.sha256(b"".join(n.encode() + b"\0" + entries[n] for n in sorted(entries))).hexdigest()
        if state in seen:
            break
        seen.add(state)
        tried, changed, places = dict(entries), False, set()
        for i, _, place in sorted(findings, key=lambda f: (WORST.index(f[1]), f[0], f[2])):
            if FIXES.get(i) and place not in places:
                places.add(place)
                changed |= apply_fix(tried, FIXES[i], place)
        after = look(tried) if changed else findings
        if not changed or measure(after) >= measure(findings) or {f[0] for f in after} - {f[0] for f in findings}:
            break
        entries, findings = tried, after
    return entries, findings
