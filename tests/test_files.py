"""Whole files in and out, per format; review of units and pages."""

import io
import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from spanloom.functions import validators as V
from spanloom.model import Preferences, Referential
from spanloom.operators import audit, layout, retention
from spanloom.operators import detectors as D
from spanloom.plans.pipeline import Config, anonymize_cells
from spanloom.rules import Rule, Rules
from spanloom.sources import delimited, office, text_files
from spanloom.sources.files import anonymize_files

WHEN = "2026-01-02 03:04:05"
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def package(at, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("___rels__", "/_rels/").replace("__", "/").replace("_xml", ".xml"), text)
    at.write_bytes(out.getvalue())


def para(*runs):
    return "<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in runs) + "</w:p>"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("in")
    (at / "a.txt").write_bytes("Éric é@x.fr mail a@b.fr".encode("cp1252"))
    (at / "one.csv").write_bytes("Nom;Note;N\r\nÉric a@b.fr;z;12\r\nx;c@d.fr a@b.fr;13\r\n".encode("cp1252"))
    (at / "two.CSV").write_bytes(b"p@q.fr|1\nmail r@s.fr|2\n")
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    package(at / "book.xlsx", xl__workbook_xml='<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"/>', xl__worksheets__sheet1_xml=f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1">{cell("A1", "a@b.fr")}{cell("B1", "FR76 3000 6000 0112 3456 7890 188")}</row><row r="2">{cell("A2", "a@b.fr")}</row></sheetData></worksheet>')
    nested = f"<w:tbl><w:tr><w:tc>{para('n@n.fr')}</w:tc></w:tr></w:tbl>"
    table = f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{para("t@t.fr")}</w:tc><w:tc>{para("u@u.fr")}{nested}</w:tc></w:tr></w:tbl>'
    box = f'<w:p><w:r><w:t>avant </w:t></w:r><w:r><w:pict><w:txbxContent>{para("z@z.fr")}</w:txbxContent></w:pict></w:r></w:p>'
    package(
        at / "d.docx",
        word__document_xml=f'<w:document {W} xmlns:r="{R}" xmlns:x14="urn:x" xmlns:mc="urn:mc" mc:Ignorable="x14"><w:body>{table}{para("mail a@", "b.fr fin")}{box}<w:p/><w:sectPr><w:footerReference w:type="default" r:id="f"/><w:headerReference w:type="default" r:id="h"/></w:sectPr></w:body></w:document>',
        **{"word___rels__document_xml.rels": f'<Relationships {RELS}><Relationship Id="h" Type="{R}/header" Target="header2.xml"/><Relationship Id="f" Type="{R}/footer" Target="footer1.xml"/></Relationships>'},
        word__header2_xml=f"<w:hdr {W}>{para('h@h.fr')}</w:hdr>", word__footer1_xml=f"<w:ftr {W}>{para('f@f.fr')}</w:ftr>",
        word__comments_xml=f"<w:comments {W}><w:comment>{para('k1')}</w:comment><w:comment>{para('k@k.fr')}</w:comment></w:comments>",
        word__footnotes_xml=f'<w:footnotes {W}><w:footnote w:type="separator">{para("-")}</w:footnote><w:footnote>{para("m@m.fr")}</w:footnote></w:footnotes>',
        word__endnotes_xml=f"<w:endnotes {W}><w:endnote>{para('e@e.fr')}</w:endnote></w:endnotes>",
        docProps__core_xml='<c xmlns:dc="urn:dc"><dc:creator>Ann</dc:creator><dc:title> </dc:title></c>', docProps__app_xml="<Properties><Manager>Bob</Manager></Properties>", word__styles_xml="<s   a='1'/>",
    )
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    text = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    shape = lambda t: f"<p:sp><p:txBody>{text(t)}</p:txBody></p:sp>"
    grid = f"<p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody>{text('c1@x.fr')}</a:txBody></a:tc><a:tc><a:txBody>{text('c2@x.fr')}</a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>"
    package(
        at / "s.pptx",
        ppt__presentation_xml=f'<p:presentation {ns} xmlns:r="{R}"><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/></p:sldIdLst></p:presentation>',
        **{
            "ppt___rels__presentation_xml.rels": f'<Relationships {RELS}><Relationship Id="a" Type="{R}/slide" Target="slides/slide1.xml"/><Relationship Id="b" Type="{R}/slide" Target="slides/slide2.xml"/></Relationships>',
            "ppt__slides___rels__slide2_xml.rels": f'<Relationships {RELS}><Relationship Id="n" Type="{R}/notesSlide" Target="../notesSlides/notesSlide1.xml"/></Relationships>',
        },
        ppt__slides__slide1_xml=f"<p:sld {ns}><p:cSld><p:spTree><p:grpSp>{shape('g@g.fr')}</p:grpSp>{grid}</p:spTree></p:cSld></p:sld>",
        ppt__slides__slide2_xml=f"<p:sld {ns}><p:cSld><p:spTree>{shape('first@x.fr')}</p:spTree></p:cSld></p:sld>",
        ppt__notesSlides__notesSlide1_xml=f"<p:notes {ns}><p:cSld><p:spTree>{shape('note@x.fr')}</p:spTree></p:cSld></p:notes>",
    )
    (at / "other.pdf").write_bytes(b"no")
    return at


def test_places_in_packages(folder):
    where = lambda name: [(w, "".join(t)) for w, t in office.units_of((folder / name).read_bytes())]
    assert where("d.docx") == [
        ("Corps", "mail a@b.fr fin"), ("Corps", "avant "), ("Tableau L1C1", "t@t.fr"), ("Tableau L1C3", "u@u.fr"), ("Tableau L1C3 / Tableau L1C1", "n@n.fr"), ("En-tête", "h@h.fr"), ("Pied", "f@f.fr"),
        ("Zone de texte", "z@z.fr"), ("Commentaire 1", "k1"), ("Commentaire 2", "k@k.fr"), ("Note 1", "m@m.fr"), ("Note de fin 1", "e@e.fr"),
    ]
    assert where("s.pptx") == [("Slide 1", "first@x.fr"), ("Slide 1 / Notes", "note@x.fr"), ("Slide 2", "g@g.fr"), ("Slide 2 / Tableau L1C1", "c1@x.fr"), ("Slide 2 / Tableau L1C2", "c2@x.fr")]


def test_anonymize_files(spark, folder, tmp_path):
    done = anonymize_files(spark, str(folder), str(tmp_path), at=F.lit(WHEN).cast("timestamp"))
    out = {os.path.basename(r.path): r.output.rsplit("/", 1)[-1] for r in done.files.collect()}
    assert out == {n: n.rpartition(".")[0] + "_ano_20260102030405." + n.rpartition(".")[2] for n in ("a.txt", "one.csv", "two.CSV", "book.xlsx", "d.docx", "s.pptx")}
    assert sorted(os.listdir(tmp_path)) == sorted(out.values())
    read = lambda n: (tmp_path / out[n]).read_bytes()
    assert read("a.txt").decode("cp1252") == "Éric [EMAIL] mail [EMAIL]"
    assert read("one.csv").decode("cp1252") == "Nom;Note;N\r\nÉric [EMAIL];z;12\r\nx;[EMAIL] [EMAIL];13\r\n" and read("two.CSV") == b"[EMAIL]|1\nmail [EMAIL]|2\n"
    assert [t for _, t in office.units_of(read("book.xlsx"))] == [["[EMAIL]"], ["[IBAN]"], ["[EMAIL]"]]  # in workbooks unconfirmed ones too
    masked = [("".join(t)) for _, t in office.units_of(read("d.docx"))]
    assert masked == ["mail [EMAIL] fin", "avant ", *["[EMAIL]"] * 6, "k1", *["[EMAIL]"] * 3]
    with zipfile.ZipFile(io.BytesIO(read("d.docx"))) as z:
        assert "x14" in z.read("word/document.xml").decode().split(">")[1] + z.read("word/document.xml").decode() and 'xmlns:x14="urn:x"' in z.read("word/document.xml").decode() and "<w:p>" in z.read("word/document.xml").decode()
        assert z.read("word/styles.xml") == b"<s   a='1'/>" and b"Ann" not in z.read("docProps/core.xml")
    assert {t for _, (t, *_) in office.units_of(read("s.pptx"))} == {"[EMAIL]"}
    rows = {(os.path.basename(r.path), r.type, r.original): (r.tag, r.occurrences, r.locations, r.confirme) for r in done.audit.collect()}
    assert rows["a.txt", "EMAIL", "a@b.fr"] == ("[EMAIL]", 1, "texte", "oui")
    assert rows["one.csv", "EMAIL", "a@b.fr"] == ("[EMAIL]", 2, "Nom L2; Note L3", "oui") and rows["two.CSV", "EMAIL", "r@s.fr"][2] == "col0 L2"
    assert rows["book.xlsx", "EMAIL", "a@b.fr"][1:3] == (2, "Feuille 1!A1; Feuille 1!A2") and rows["book.xlsx", "IBAN", "FR76 3000 6000 0112 3456 7890 188"][3] == "non"
    assert rows["d.docx", "EMAIL", "u@u.fr"][2] == "Tableau L1C3" and rows["d.docx", "META", "Ann"] == ("", 1, "Métadonnées / Auteur", "oui") and rows["d.docx", "META", "Bob"][2] == "Métadonnées / Manager"
    assert rows["s.pptx", "EMAIL", "c2@x.fr"][2] == "Slide 2 / Tableau L1C2"


def test_one_file(spark, folder, tmp_path):
    one = str(folder / "one.csv")
    anonymize_files(spark, one, str(tmp_path), at=F.lit(WHEN).cast("timestamp"), exclude={0})
    assert (tmp_path / "one_ano_20260102030405.csv").read_bytes().decode("cp1252") == "Nom;Note;N\r\nÉric a@b.fr;z;12\r\nx;[EMAIL] [EMAIL];13\r\n"
    with pytest.raises(text_files.UnsupportedFormat):
        anonymize_files(spark, str(folder / "other.pdf"), str(tmp_path))
    with pytest.raises(NotImplementedError):
        anonymize_files(spark, str(folder / "book.xlsx"), str(tmp_path), include={0})
    for d in ("b", "c"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "same.txt").write_text(d)
    with pytest.raises(ValueError, match="several sources"):
        anonymize_files(spark, f"{tmp_path}/*/same.txt", str(tmp_path / "out"), at=F.lit(WHEN).cast("timestamp"))


def test_unencodable_characters(spark):
    """A character that a file's encoding doesn't have is an error, not a question mark."""
    rows = spark.createDataFrame([("p", "漢", "cp1252")], "path string, text string, encoding string")
    with pytest.raises(Exception, match="(?i)encode"):
        text_files.encoded(rows).collect()
    table = spark.createDataFrame([("p", 0, ["漢"], ";", "cp1252", "\n")], "path string, row_id long, cells array<string>, delimiter string, encoding string, line_end string")
    with pytest.raises(Exception, match="(?i)encode"):
        delimited.file_content(table).collect()


def test_cells_of_two_files(spark, folder):
    """Rows of different files stay apart and keep their other columns; nothing is shuffled."""
    rows = delimited.read_rows(spark, str(folder), "*.[cC][sS][vV]")
    done = anonymize_cells(rows, columns=F.col("text_columns"), header=F.col("has_header"))
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString() and done.columns == rows.columns
    content = {os.path.basename(r.path): bytes(r.content) for r in delimited.file_content(done).collect()}
    assert content == {"one.csv": "Nom;Note;N\r\nÉric [EMAIL];z;12\r\nx;[EMAIL] [EMAIL];13\r\n".encode("cp1252"), "two.CSV": b"[EMAIL]|1\nmail [EMAIL]|2\n"}


def test_cells_of_all_kinds(spark):
    rows = spark.createDataFrame([(0, ["a@b.fr", "x"], 7), (1, ["a@b.fr", None, "c@d.fr"], 8), (2, [], 9), (3, None, 1), (4, ["Bob x@y.fr", "e@f.fr"], 2)], "row_id long, cells array<string>, more int")

    def load():
        return lambda texts, labels: [[("personne", 0, 3, 0.9)] if t.startswith("Bob") else [] for t in texts]

    config = Config(recognizer=D.ModelRecognizer(load), rules=Rules((Rule("simple", "c@d.fr", "keep"),)))
    got = {r.row_id: (r.cells, r.more, [[s["type"] for s in c] for c in r.found] if r.found is not None else None) for r in anonymize_cells(rows, config, [0, 2], spans="found").collect()}
    assert got == {0: (["a@b.fr", "x"], 7, [[], []]), 1: (["[EMAIL]", None, "c@d.fr"], 8, [["EMAIL"], [], []]), 2: ([], 9, []), 3: (None, 1, None), 4: (["[PERSONNE] [EMAIL]", "e@f.fr"], 2, [["PERSON", "EMAIL"], []])}


def test_review_of_units(spark):
    rows = [(1, 0, "EMAIL", "a", True, False), (2, 0, "EMAIL", "a", False, False), (3, 0, "IBAN", "i", False, False), (4, 0, "IBAN", "i", True, False), (5, 0, "URL", "u", True, False), (6, 0, "URL", "u", True, True), (7, 0, "IBAN", "i", False, True)]
    spans = spark.createDataFrame(rows, "unit_id int, start int, type string, value string, confirmed boolean, side boolean")
    kept = lambda policy: {r.unit_id for r in retention.retain_units(spans, policy, F.col("side"), ["unit_id", "start"]).where("retained").collect()}
    assert kept(retention.Policy()) == {1, 2, 5, 6}  # a value follows its first occurrence
    assert kept(retention.Policy(types_off=("URL",), values={("IBAN", "i"): True})) == {1, 2, 3, 4, 6}


def test_review_of_pages(spark):
    rect = lambda x: (float(x), 0.0, x + 1.0, 1.0)
    kind = "struct<x0:double,y0:double,x1:double,y1:double>"
    rows = [(1, 0, 0, "EMAIL", "a", True, [rect(1), rect(2)]), (1, 0, 5, "PHONE", "p", True, [rect(2), rect(3)]), (1, 1, 0, "EMAIL", "a", True, [rect(4)]), (1, 2, 0, "IBAN", "i", False, [rect(5)])]
    spans = spark.createDataFrame(rows, f"doc_id int, page int, start int, type string, value string, confirmed boolean, rects array<{kind}>")
    out = spark.createDataFrame([(1, 1, 0)], "doc_id int, page int, start int")
    held = retention.retain_occurrences(spans, retention.Policy(), ["page", "start"], out, ["doc_id", "page", "start"])
    assert {(r.page, r.start) for r in held.where("retained").collect()} == {(0, 0), (0, 5)}
    drawn = spark.createDataFrame([(1, 1, rect(9)), (1, 0, rect(9))], f"doc_id int, page int, rect {kind}")
    pages = {r.page: [x["x0"] for x in r.rects] for r in retention.rects_by_page(held, drawn, ["start"]).collect()}
    assert pages == {0: [1.0, 2.0, 3.0, 9.0], 1: [9.0]}
    report = audit.audit_report(retention.zone_rows(drawn), Referential(), ["page"]).collect()
    assert [tuple(r) for r in report] == [("ZONE", "(zone manuelle)", "[ZONE]", 2, "page 1; page 2", "oui")]


def test_reports_without_one_text(spark):
    rows = spark.createDataFrame([("EMAIL", "a", k, f"L{k}", k != 3) for k in range(5)], "type string, value string, k int, location string, confirmed boolean")
    assert [tuple(r) for r in audit.audit_counts(rows, Referential()).collect()] == [("EMAIL", "a", "[EMAIL]", 5, "non")]
    assert sorted(r.location for r in audit.audit_locations(rows, ["k"]).collect()) == [f"L{k}" for k in range(5)]


def test_pages_by_key(spark):
    r = random.Random(1)
    keys = sorted({(r.randrange(9), r.randrange(40)) for _ in range(90)})
    rows = spark.createDataFrame(keys, "a int, b int").repartition(3)
    seen, last = [], None
    while page := [tuple(x) for x in retention.page_after(rows, ["a", "b"], last, 20).collect()]:
        seen, last = seen + page, page[-1]
    assert seen == keys


def test_counters_and_preferences(spark):
    assert Referential().counter() == "11 / 14 actifs"
    assert [r[0] for r in spark.createDataFrame([(0,), (999,), (1234567,)], "n long").select(V.grouped_digits(F.col("n"))).collect()] == ["0", "999", "1 234 567"]
    chosen = Preferences("out", {"URL": True}, ["x"])
    assert Preferences.from_json(chosen.to_json()) == chosen and chosen.referential().is_active("URL")
    assert Preferences.from_json(json.dumps({"theme": "t"})) == Preferences()
    pages = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (1, 1)], "doc_id int, page int")
    assert {tuple(r) for r in layout.page_counts(pages).collect()} == {(1, 2), (2, 1)}
