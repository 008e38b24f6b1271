"""Facts about single operators, and random spans against a plain restatement of the rules."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from spanloom.functions import validators as V
from spanloom.model import SPANS, Referential
from spanloom.operators import detectors as D
from spanloom.operators import layout, merge, retention
from spanloom.plans.pipeline import Config, anonymize, anonymize_cells, anonymize_distinct, detect
from spanloom.rules import Rule, Rules
from spanloom.sources import delimited, office, text_files


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def test_validators(spark):
    assert values(spark, ["552081317", "542107651", "775672272", "552081318", "542107652", "5", "0", ""], V.luhn_valid) == [True] * 3 + [False] * 5
    assert values(spark, ["FR76 3000 6000 0112 3456 7890 189", "FR76 3000 6000 0112 3456 7890 188", "FR76 300060000112345678901 89"], V.iban_valid) == [True, False, False]
    assert values(spark, ["155081308402417", "1 55 08 13 084 024 17", "155132A08402417", "155142A08402417"], V.nir_valid)[:2] == [True, True]
    assert values(spark, ["BNPAFRPP", "BNPAFRPPXXX", "FACTURES"], V.bic_plausible) == [True, True, False]
    assert values(spark, ["75008", "20000", "00123", "99000", "7500"], V.postal_code_plausible) == [True, True, False, False, False]
    assert values(spark, ["  Éléonore\tDUPONT ", "a"], V.normalize) == ["eleonore dupont", "a"]
    assert values(spark, ["", "12,5", "a1"], V.looks_structured) == [True, True, False]
    assert values(spark, ["12 34", "ab", "abc", "a b", ""], V.propagatable) == [False, False, True, True, False]


def found(spark, texts, make):
    return [[(s["type"], s["value"], s["start"], s["end"], s["confirmed"]) for s in v] for v in values(spark, texts, make)]


def test_deterministic(spark):
    assert found(spark, ["😀 é.a+b@c-d.fr. x", None, ""], lambda t: D.deterministic(t, "EMAIL")) == [[("EMAIL", "é.a+b@c-d.fr", 2, 14, True)], [], []]
    assert found(spark, ["a\u0001b x@y.fr"], lambda t: D.deterministic(t, "EMAIL")) == [[("EMAIL", "x@y.fr", 4, 10, True)]]
    assert found(spark, ["tel 06 12-34.56 78, +33 612345678"], lambda t: D.deterministic(t, "PHONE"))[0] == [("PHONE", "06 12-34.56 78", 4, 18, True), ("PHONE", "+33 612345678", 20, 33, True)]
    assert found(spark, ["73282932000074 et 73282932000075"], lambda t: D.deterministic(t, "SIRET"))[0] == [("SIRET", "73282932000074", 0, 14, True)]
    assert [s[4] for s in found(spark, ["155081308402418 155081308402417"], lambda t: D.deterministic(t, "NIR"))[0]] == [False, True]
    assert found(spark, ["12 bis, Rue de l'Église\nsuite"], lambda t: D.deterministic(t, "ADDRESS"))[0][0][1] == "12 bis, Rue de l'Église"


def test_secrets(spark):
    assert [s[1] for s in found(spark, ["mdp: Abc!1. puis"], lambda t: D.contextual(t, "PASSWORD"))[0]] == ["Abc!1"]
    assert [s[1] for s in found(spark, ["connectée la veille avec jdupont, puis login : bob)"], lambda t: D.contextual(t, "LOGIN"))[0]] == ["jdupont", "bob"]
    assert [s[1] for s in found(spark, ["(Abcdef12). abcdefg1 ABCDEFG1 12345678 Ab1"], D.secret_shapes)[0]] == ["Abcdef12"]


def reference_merge(spans):
    order = sorted(range(len(spans)), key=lambda i: (spans[i]["source"] not in ("deterministic", "rule"), -spans[i]["confidence"], -(spans[i]["end"] - spans[i]["start"]), i))
    kept = []
    for i in order:
        if not any(k["start"] < spans[i]["end"] and spans[i]["start"] < k["end"] for k in kept):
            kept.append(spans[i])
    return sorted(kept, key=lambda s: (s["start"], s["end"] - s["start"]))


def random_spans(r):
    out = []
    for k in range(r.randrange(9)):
        a = r.randrange(30)
        out.append({"type": r.choice(["EMAIL", "PHONE"]), "value": str(k), "start": a, "end": a + r.randrange(1, 9), "source": r.choice(["deterministic", "ner", "secret", "rule"]), "confidence": r.choice([0.5, 1.0]), "confirmed": True, "seq": 0})
    return out


def test_merge_mask_and_runs(spark):
    r = random.Random(3)
    cases = [random_spans(r) for _ in range(300)]
    text = "abcdéfghij" * 4
    runs = [[text[:a], text[a:b], "", text[b:]] for a, b in (sorted((r.randrange(41), r.randrange(41))) for _ in cases)]
    df = spark.createDataFrame([(i, c, u) for i, (c, u) in enumerate(zip(cases, runs, strict=True))], f"i int, s {SPANS}, u array<string>")
    df = df.withColumn("m", merge.merge(F.col("s"))).withColumn("x", merge.mask(F.lit(text), F.col("m"), Referential())).withColumn("y", merge.mask_runs(F.col("u"), F.col("m"), Referential()))
    for row in df.collect():
        want = reference_merge(cases[row.i])
        assert [s["value"] for s in row.m] == [s["value"] for s in want]
        out, at = "", 0
        for s in want:
            out += text[at : s["start"]] + {"EMAIL": "[EMAIL]", "PHONE": "[TEL]"}[s["type"]]
            at = s["end"]
        assert row.x == out + text[at:] == "".join(row.y)


def test_pipeline_order_of_rules(spark):
    rules = Rules((Rule("simple", "06 ##*", "keep"), Rule("regex", r"dossier \d+", "mask"), Rule("regex", "(", "mask"), Rule("simple", "x", "mask", enabled=False)))
    assert [r.pattern for r in rules.invalid()] == ["("]
    df = spark.createDataFrame([(1, "06 12 34 56 78 dossier 12 x a@b.fr"), (2, None)], "id int, text string")
    found_ = {r.id: [s["type"] for s in r.spans] for r in detect(df, Config(rules=rules)).collect()}
    assert found_ == {1: ["REGLE_INTERNE", "EMAIL"], 2: []}
    off = Config(Referential().with_overrides(EMAIL=False), rules)
    result = anonymize(df, "id", off)
    assert {r.id: r.masked for r in result.masked.collect()} == {1: "06 12 34 56 78 [REGLE-INTERNE] x a@b.fr", 2: None}
    assert [tuple(r) for r in result.audit.collect()] == [("REGLE_INTERNE", "dossier 12", "[REGLE-INTERNE]", 1, "1", "oui")]
    with pytest.raises(ValueError):
        rules.add(Rule("regex", "("))
    assert Rules.from_json(rules.to_json()) == rules and len(Rules.starting().rules) == 11


def test_unconfirmed_shadow(spark):
    df = spark.createDataFrame([(1, "FR76 3000 6000 0112 3456 7890 188 fin")], "id int, text string")
    assert anonymize(df, "id").masked.first().masked == "FR76 3000 6000 0112 3456 7890 188 fin"
    assert anonymize(df, "id", Config(mask_unconfirmed=True)).masked.first().masked.startswith("[IBAN]")


def test_recognizers_and_chunks(spark):
    def load():
        return lambda texts, labels: [[("personne", t.index("Bob"), t.index("Bob") + 3, 0.9), ("x", 0, 1, 0.2)] if "Bob" in t else [] for t in texts]

    text = "mot " * 300 + "Bob fin"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    config = Config(recognizer=D.ModelRecognizer(load))
    assert [(s["value"], s["start"]) for s in detect(df, config).first().spans] == [("Bob", 1200)]
    assert anonymize_distinct(df.union(df), config).count() == 2
    r = random.Random(5)
    texts = ["".join(r.choice("ab  ") for _ in range(r.randrange(60))) for _ in range(80)]
    got = values(spark, texts, lambda t: D.chunk_column(t, 7))
    assert [[tuple(c) for c in g] for g in got] == [D.chunks(t, 7) for t in texts]
    assert all("".join(t[a:b] for a, b in D.chunks(t, 7)) == t for t in texts)


def test_delimited(spark, tmp_path):
    assert [delimited.delimiter_of(x) for x in ("a;1,5\nb;2,5\n", "a|b\nc|d\n", "abc\n", "a,b\nc,d\n", "")] == [";", "|", ";", ",", ";"]
    (tmp_path / "a.csv").write_bytes("Nom;Note\r\nÉric a@b.fr;12\r\n\r\nx\r\n".encode("cp1252"))
    rows = delimited.read_rows(spark, str(tmp_path / "a.csv")).cache()
    assert [r.cells for r in rows.orderBy("row_id").collect()] == [["Nom", "Note"], ["Éric a@b.fr", "12"], [], ["x"]]
    assert retention.maskable_columns(rows) == [0] and retention.maskable_columns(rows, include={0, 1}, exclude={0}) == [1]
    content = delimited.file_content(anonymize_cells(rows)).first().content
    assert bytes(content).decode("cp1252") == "Nom;Note\r\nÉric [EMAIL];12\r\n\r\nx\r\n"


def test_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode("cp1252"))
    (tmp_path / "b.txt").write_bytes("é".encode())
    rows = {r.path[-5:]: (r.text, r.encoding, bytes(r.content)) for r in text_files.encoded(text_files.read_texts(spark, str(tmp_path))).collect()}
    assert rows == {"a.txt": ("é", "cp1252", b"\xe9"), "b.txt": ("é", "utf-8", "é".encode())}
    assert text_files.format_of("x/A.CSV") == "csv"
    with pytest.raises(text_files.UnsupportedFormat):
        text_files.format_of("a.pdf")


def test_office(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>mail a@</w:t></w:r><w:r><w:t>b.fr fin</w:t></w:r></w:p><w:p/></w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}><w:p><w:r><w:t>c@d.fr</w:t></w:r></w:p></w:hdr>")
        z.writestr("docProps/core.xml", '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Ann</dc:creator></c>')
    (tmp_path / "a.docx").write_bytes(out.getvalue())
    units = office.read_units(spark, str(tmp_path / "a.docx"))
    assert [(r.location, r.text) for r in units.orderBy("unit_id").collect()] == [("Corps", "mail a@b.fr fin"), ("En-tête", "c@d.fr")]
    masked = detect(units).withColumn("runs", merge.mask_runs(F.col("runs"), F.col("spans"), Referential()))
    row = office.masked_packages(spark, str(tmp_path / "a.docx"), masked).first()
    assert [r for _, r in office.units_of(bytes(row.content))] == [["mail [EMAIL]", " fin"], ["[EMAIL]"]]
    assert [(p["label"], p["original"]) for p in row.purged] == [("Auteur", "Ann")]
    with pytest.raises(text_files.CorruptDocument):
        office.units_of(b"no zip")


def test_workbook_cells(spark, tmp_path):
    """Every string cell is a unit with its sheet's title and place, also where cells share a string; each is written back by itself."""
    x, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda at, k: f'<c r="{at}" t="s"><v>{k}</v></c>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {x} xmlns:r="{r}"><sheets><sheet name="Tiers" sheetId="2" r:id="b"/><sheet name="Balance" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {x} count="4" uniqueCount="2"><si><t>a@b.fr</t></si><si><r><t>de </t></r><r><t>c@d.fr</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {x}><sheetData><row r="1">{cell("A1", 0)}{cell("B1", 1)}<c r="C1"><v>7</v></c></row><row r="2">{cell("A2", 0)}<c r="B2" t="str"><f>A1</f><v>a@b.fr</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {x}><sheetData><row r="3">{cell("D3", 0)}<c r="E3" t="inlineStr"><is><t>e@f.fr</t></is></c></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(out.getvalue())
    units = office.read_units(spark, str(tmp_path / "a.xlsx"))
    want = [("Tiers!D3", "a@b.fr"), ("Tiers!E3", "e@f.fr"), ("Balance!A1", "a@b.fr"), ("Balance!B1", "de c@d.fr"), ("Balance!A2", "a@b.fr")]
    assert [(u.location, u.text) for u in units.orderBy("unit_id").collect()] == want
    masked = detect(units).withColumn("runs", merge.mask_runs(F.col("runs"), F.col("spans"), Referential()))
    done = bytes(office.masked_packages(spark, str(tmp_path / "a.xlsx"), masked).first().content)
    assert office.units_of(done) == [("Tiers!D3", ["[EMAIL]"]), ("Tiers!E3", ["[EMAIL]"]), ("Balance!A1", ["[EMAIL]"]), ("Balance!B1", ["de ", "[EMAIL]"]), ("Balance!A2", ["[EMAIL]"])]
    one, _ = office.rewritten(out.getvalue(), {0: ["[EMAIL]"], 4: ["kept"]})
    assert [t for _, (t, *_) in office.units_of(one)] == ["[EMAIL]", "e@f.fr", "a@b.fr", "de ", "kept"]


def test_manual_rects(spark):
    rect = F.struct(F.lit(1.0).alias("x0"))
    spans = spark.range(1).select(F.lit(0).alias("page"), F.lit("EMAIL").alias("type"), F.lit("a").alias("value"), F.array(rect).alias("rects"), F.lit(False).alias("retained"))
    drawn = spark.range(1).select(F.lit(1).alias("page"), rect.alias("rect"))
    assert [(r.type, r.value, r.retained) for r in retention.with_manual_rects(spans, drawn).orderBy("page").collect()] == [("EMAIL", "a", False), ("ZONE", "(zone manuelle)", True)]


def test_propagation(spark):
    words = [(1, p, 0, 0, i, w, 0.0, 0.0, 30.0, 10.0) for p, t in enumerate(["Jean DUPONT dit", "chez jean Dupont et jean dupont"]) for i, w in enumerate(t.split())]
    df = spark.createDataFrame(words, "doc_id int, page int, block int, line int, word_no int, text string, x0 double, y0 double, x1 double, y1 double")
    placed = layout.page_words(layout.reading_order(df))
    spans = spark.createDataFrame([(1, 0, 0, "PERSON", "Jean Dupont", True), (1, 0, 1, "PERSON", "12", True)], "doc_id int, page int, seq int, type string, value string, confirmed boolean")
    got = layout.propagated(placed, layout.propagation_targets(spans))
    assert sorted((r.page, r.span["value"], r.span["start"], r.span["end"]) for r in got.collect()) == [(0, "Jean Dupont", 0, 11), (1, "Jean Dupont", 5, 16), (1, "Jean Dupont", 20, 31)]


def test_stream(spark, tmp_path):
    from spanloom.streaming.detect import audit_stream, masked_stream

    spark.createDataFrame([("a@b.fr et a@b.fr",), (None,)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    for name, df, mode in (("masked", masked_stream(stream), "append"), ("counts", audit_stream(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert {r.masked for r in spark.table("masked").collect()} == {"[EMAIL] et [EMAIL]", None}
    assert [tuple(r) for r in spark.table("counts").collect()] == [("EMAIL", "a@b.fr", 2)]


def test_span_view(spark):
    from spanloom.functions.sql import create_span_view

    spark.createDataFrame([(1, "a@b.fr")], "id int, text string").createOrReplaceTempView("texts")
    create_span_view(spark, "texts", "id", "text_spans")
    assert [tuple(r) for r in spark.sql("SELECT id, type, start FROM text_spans").collect()] == [(1, "EMAIL", 0)]
