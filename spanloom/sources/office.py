"""Office packages by the standard library: text units with their runs, and writing masked runs back.

A unit is a paragraph (docx, pptx) or a string cell (xlsx). unit_id numbers the units of a file in order, and runs are the text nodes in it, so
replaced runs go back to the nodes they came from. A document's order is body, tables, headers and footers by section, text boxes, comments,
notes; a presentation's is that of its slides, each with its tables in place and followed by its notes. Paragraphs that stand elsewhere come
last, so that none stays unread. Only parts with replaced runs or blanked metadata are written anew, with the prefixes they declared.
"""

from __future__ import annotations

import copy
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanloom.sources.text_files import CorruptDocument

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SPACE = "{http://www.w3.org/XML/1998/namespace}space"
#: Metadata fields that are blanked, by part and local name, with their labels.
METADATA = {
    "docProps/core.xml": {"creator": "Auteur", "lastModifiedBy": "Dernier modifié par", "title": "Titre", "subject": "Sujet", "keywords": "Mots-clés", "description": "Commentaires", "category": "Catégorie"},
    "docProps/app.xml": {"Company": "Société", "Manager": "Manager"},
}


def _number(name: str) -> int:
    return int((re.findall(r"\d+", name.rsplit("/", 1)[-1]) or ["0"])[0])


def _nodes(e: ET.Element, p: str, t: str) -> Iterator[ET.Element]:
    """Text nodes of a paragraph; those of a paragraph nested in it are its own."""
    for c in e:
        if c.tag == t:
            yield c
        elif c.tag != p:
            yield from _nodes(c, p, t)


def _blocks(container: ET.Element, kinds: tuple[str, ...]) -> Iterator[ET.Element]:
    """The nearest elements of some kinds, in order."""
    for c in container:
        if c.tag in kinds:
            yield c
        else:
            yield from _blocks(c, kinds)


def _targets(rels: dict[str, ET.Element], part: str) -> dict[str, tuple[str, str]]:
    """(part, last word of its kind) that each relation of a part names."""
    folder, name = posixpath.split(part)
    found = rels.get(f"{folder}/_rels/{name}.rels")
    at = lambda target: target[1:] if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
    return {r.get("Id"): (at(r.get("Target", "")), r.get("Type", "").rsplit("/", 1)[-1]) for r in found} if found is not None else {}


Unit = tuple[str, list[ET.Element]]


def _word_table(table: ET.Element, prefix: str) -> Iterator[tuple[str, ET.Element]]:
    base = "" if prefix == "Corps" else f"{prefix} / "
    for r, row in enumerate(_blocks(table, (f"{W}tr",)), 1):
        c = 1
        for cell in _blocks(row, (f"{W}tc",)):
            yield from _word_blocks(cell, f"{base}Tableau L{r}C{c}")
            span = cell.find(f"{W}tcPr/{W}gridSpan")
            c += int(span.get(f"{W}val", "1")) if span is not None else 1


def _word_blocks(container: ET.Element, prefix: str) -> Iterator[tuple[str, ET.Element]]:
    """Paragraphs, then tables."""
    blocks = list(_blocks(container, (f"{W}p", f"{W}tbl")))
    for p in blocks:
        if p.tag == f"{W}p":
            yield prefix, p
    for table in blocks:
        if table.tag == f"{W}tbl":
            yield from _word_table(table, prefix)


def _word_paragraphs(trees: dict[str, ET.Element], rels: dict[str, ET.Element]) -> Iterator[tuple[str, ET.Element]]:
    main = "word/document.xml"
    if main not in trees:
        return
    root, targets = trees[main], _targets(rels, main)
    yield from _word_blocks(root, "Corps")
    heads = {f"{W}headerReference": "En-tête", f"{W}footerReference": "Pied"}
    edges = [(part, heads[e.tag]) for section in root.iter(f"{W}sectPr") for e in sorted((x for x in section if x.tag in heads), key=lambda x: (x.tag != f"{W}headerReference", x.get(f"{W}type") != "default")) if (part := targets.get(e.get(RELATION), ("",))[0]) in trees]
    edges += [(n, label) for stem, label in (("header", "En-tête"), ("footer", "Pied")) for n in sorted((n for n in trees if re.fullmatch(rf"word/{stem}\d*\.xml", n)), key=_number)]
    edges = list(dict(edges).items())
    for part, label in edges:
        yield from _word_blocks(trees[part], label)
    for part in (main, *(part for part, _ in edges)):
        for box in trees[part].iter(f"{W}txbxContent"):
            yield from (("Zone de texte", p) for p in box.iter(f"{W}p"))
    for part, tag, label in (("word/comments.xml", "comment", "Commentaire"), ("word/footnotes.xml", "footnote", "Note"), ("word/endnotes.xml", "endnote", "Note de fin")):
        notes = [e for e in trees[part].iter(f"{W}{tag}") if e.get(f"{W}type") not in ("separator", "continuationSeparator")] if part in trees else []
        for i, note in enumerate(notes, 1):
            yield from ((f"{label} {i}", p) for p in note.iter(f"{W}p"))
    for part in (main, *(part for part, _ in edges)):
        yield from (("Corps", p) for p in trees[part].iter(f"{W}p"))


def _shapes(container: ET.Element, prefix: str) -> Iterator[tuple[str, ET.Element]]:
    for shape in _blocks(container, (f"{A}p", f"{A}tbl")):
        if shape.tag == f"{A}p":
            yield prefix, shape
            continue
        for r, row in enumerate(shape.iter(f"{A}tr"), 1):
            for c, cell in enumerate(row.iter(f"{A}tc"), 1):
                yield from ((f"{prefix} / Tableau L{r}C{c}", p) for p in cell.iter(f"{A}p"))


def _slide_paragraphs(trees: dict[str, ET.Element], rels: dict[str, ET.Element]) -> Iterator[tuple[str, ET.Element]]:
    main = "ppt/presentation.xml"
    by_number = sorted((n for n in trees if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)
    targets = _targets(rels, main)
    listed = [targets.get(e.get(RELATION), ("",))[0] for e in trees[main].iter(f"{P}sldId")] if main in trees else []
    for i, part in enumerate(dict.fromkeys([*(n for n in listed if n in trees), *by_number]), 1):
        yield from _shapes(trees[part], f"Slide {i}")
        own = [n for n, kind in _targets(rels, part).values() if kind == "notesSlide"] or [f"ppt/notesSlides/notesSlide{_number(part)}.xml"]
        for notes in own:
            if notes in trees:
                yield from _shapes(trees[notes], f"Slide {i} / Notes")


def _sheets(trees: dict[str, ET.Element], rels: dict[str, ET.Element]) -> list[tuple[str, str]]:
    """(part, title) of the worksheets in the workbook's order; parts that it doesn't name come last, under their number."""
    targets = _targets(rels, "xl/workbook.xml")
    named = [(targets.get(e.get(RELATION), ("",))[0], e.get("name", "")) for e in trees["xl/workbook.xml"].iter(f"{S}sheet")]
    out = [(part, title) for part, title in named if part in trees and part.startswith("xl/worksheets/")]
    known = {part for part, _ in out}
    return out + [(n, f"Feuille {_number(n)}") for n in sorted((n for n in trees if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=_number) if n not in known]


def _xlsx_cells(trees: dict[str, ET.Element], rels: dict[str, ET.Element], own: bool) -> Iterator[Unit]:
    """Every string cell of all sheets, at title!coordinate; formulas aren't strings. Cells that use one shared string share its nodes, or
    with own each gets a copy of it, so that they can be written apart."""
    shared = trees.get("xl/sharedStrings.xml")
    items = list(shared.iter(f"{S}si")) if shared is not None else []
    seen: set[int] = set()
    count = len(items)
    for name, title in _sheets(trees, rels):
        for c in trees[name].iter(f"{S}c"):
            if c.find(f"{S}f") is not None:
                continue
            place, v = f"{title}!{c.get('r')}", c.find(f"{S}v")
            if c.get("t") == "s" and v is not None:
                item = items[int(v.text)]
                if own and int(v.text) in seen:
                    item = copy.deepcopy(item)
                    shared.append(item)
                    v.text = str(count)
                    count += 1
                    shared.set("uniqueCount", str(count))
                else:
                    seen.add(int(v.text))
                yield place, list(item.iter(f"{S}t"))
            elif c.get("t") == "inlineStr":
                yield place, list(c.iter(f"{S}t"))
            elif c.get("t") == "str" and v is not None:
                yield place, [v]


def _units(content: bytes, own: bool = False) -> tuple[dict[str, ET.Element], list[Unit]]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            trees = {n: ET.fromstring(z.read(n)) for n in z.namelist() if n.endswith(".xml")}
            rels = {n: ET.fromstring(z.read(n)) for n in z.namelist() if n.endswith(".rels")}
    except (zipfile.BadZipFile, ET.ParseError) as error:
        raise CorruptDocument(str(error)) from error
    units: list[Unit] = list(_xlsx_cells(trees, rels, own)) if "xl/workbook.xml" in trees else []
    seen: set[int] = set()
    for found, p, t in ((_word_paragraphs(trees, rels), f"{W}p", f"{W}t"), (_slide_paragraphs(trees, rels), f"{A}p", f"{A}t")):
        for label, e in found:
            if id(e) not in seen and (nodes := list(_nodes(e, p, t))):
                units.append((label, nodes))
            seen.add(id(e))
    return trees, units


def _serialized(root: ET.Element, original: bytes) -> bytes:
    """root as XML with the prefixes of the original, those too that only its attribute values name."""
    declared: dict[str, str] = {}
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(original), ["start-ns"]):
        declared.setdefault(prefix, uri)
    for prefix, uri in declared.items():
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    text = ET.tostring(root, encoding="unicode")
    end = text.index(">") - (text[text.index(">") - 1] == "/")
    missing = "".join(f' xmlns:{prefix}="{uri}"' for prefix, uri in declared.items() if prefix and f"xmlns:{prefix}=" not in text[:end])
    return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text[:end] + missing + text[end:]).encode()


def units_of(content: bytes) -> list[tuple[str, list[str]]]:
    """(location, runs) in document order."""
    return [(where, [n.text or "" for n in nodes]) for where, nodes in _units(content)[1]]


def rewritten(content: bytes, runs: dict[int, list[str]]) -> tuple[bytes, list[tuple[str, str]]]:
    """The package with the runs of some units replaced and, but for workbooks, its metadata blanked; (label, old value) of what was blanked."""
    trees, units = _units(content, own=True)
    touched: set[int] = set()
    for i, texts in runs.items():
        for node, text in zip(units[i][1], texts, strict=True):
            if node.text != text:
                touched.add(id(node))
                node.text = text
            if text != text.strip():
                node.set(SPACE, "preserve")
    purged = []
    for part, fields in METADATA.items():
        for e in trees[part].iter() if part in trees and "xl/workbook.xml" not in trees else ():
            label = fields.get(e.tag.rsplit("}", 1)[-1])
            if label and (e.text or "").strip():
                purged.append((label, e.text))
                touched.add(id(e))
                e.text = ""
    anew = {n for n, tree in trees.items() if touched and any(id(e) in touched for e in tree.iter())}
    if "xl/sharedStrings.xml" in anew:  # cells that got a copy of a shared string point to it
        anew |= {n for n in trees if n.startswith("xl/worksheets/")}
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in z.namelist():
            new.writestr(name, _serialized(trees[name], z.read(name)) if name in anew else z.read(name))
    return out.getvalue(), purged


def read_units(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, unit_id, location, runs, text of all units of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = units_of(content)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array([w for w, _ in found], pa.string()), pa.array([r for _, r in found], pa.list_(pa.string())), pa.array(["".join(r) for _, r in found], pa.string())],
                    names=["path", "unit_id", "location", "runs", "text"],
                )

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInArrow(run, "path string, unit_id long, location string, runs array<string>, text string")


def masked_packages(spark: SparkSession, path: str, masked: DataFrame, glob: str = "*") -> DataFrame:
    """path, content, purged of each file with the runs in masked (path, unit_id, runs) put back."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def write(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[dict] = []
        for f in left.to_pylist():
            content, purged = rewritten(f["content"], dict(zip(right.column("unit_id").to_pylist(), right.column("runs").to_pylist(), strict=True)))
            rows.append({"path": f["path"], "content": content, "purged": [{"label": a, "original": b} for a, b in purged]})
        kind = pa.schema([("path", pa.string()), ("content", pa.binary()), ("purged", pa.list_(pa.struct([("label", pa.string()), ("original", pa.string())])))])
        return pa.Table.from_pylist(rows, schema=kind)

    return files.groupBy("path").cogroup(masked.select("path", "unit_id", "runs").groupBy("path")).applyInArrow(write, "path string, content binary, purged array<struct<label:string,original:string>>")


Reader = Callable[[SparkSession, str], DataFrame]
