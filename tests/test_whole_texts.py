"""Queries over documents read whole texts: held against plain Python on documents of many lengths."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from spanloom.model import SPANS, Referential
from spanloom.operators import detectors as D
from spanloom.operators import merge
from spanloom.plans import queries as Q


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    r = random.Random(5)
    rows = []
    for i, n in enumerate([0, 1, 199, 200, 201, 3999, 4000, 4001, 9000, 40000]):
        text = "".join(r.choice(["é", "ß", "A", "b", " ", "\n", "\t", "œ", "😀", "Ñ"]) for _ in range(n))
        if n > 4000:
            text = text[:3990] + " very.long.name@example.org " + text[3990:] + " End.É@late.fr, x@y.fr"
        rows.append((i, text))
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([*rows, (len(rows), None)], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at, dict(rows)


def test_normalize_whole(spark, documents):
    at, texts = documents
    got = {r.doc_id: r.norm for r in Q.QUERIES["f1_normalize"](spark, at).collect()}
    for i, text in texts.items():
        bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
        assert got[i] == re.sub(r"\s+", " ", bare).strip(), i
    assert got[len(texts)] is None


def plain_runs(runs, spans, tag):
    """Character by character: the tag where a span starts, or nothing, else the character."""
    out, at = [], 0
    for run in runs:
        got = ""
        for c in run:
            hit = next((s for s in spans if s[0] <= at < s[1]), None)
            got += c if hit is None else tag if at == hit[0] else ""
            at += 1
        out.append(got)
    return out


def test_run_remap_whole(spark, documents):
    at, texts = documents
    got = {r.doc_id: r.runs for r in Q.QUERIES["m7_run_remap"](spark, at).collect()}
    for i, text in texts.items():
        spans = [m.span() for m in re.finditer(r"[\w.+-]+@[\w-]+\.[\w.-]*\w", text)]
        assert (len(text) > 4001) == bool(spans)
        assert got[i] == "|".join(plain_runs([text[a : a + 40] for a in range(0, len(text), 40)], spans, "[EMAIL]")), i


def test_runs_of_any_length(spark):
    r, rows = random.Random(6), []
    for i in range(200):
        runs = ["".join(r.choice("aé😀") for _ in range(r.choice([0, 0, 1, 3, 50]))) for _ in range(r.randrange(40))]
        cuts = sorted({r.randrange(sum(map(len, runs)) + 1) for _ in range(2 * r.randrange(12))})
        rows.append((i, runs, [("EMAIL", "x", a, b, "rule", 1.0, True, 0) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]))
    df = spark.createDataFrame(rows, f"i int, runs array<string>, spans {SPANS}")
    for row in df.select("i", merge.mask_runs(F.col("runs"), F.col("spans"), Referential()).alias("m")).collect():
        _, runs, spans = rows[row.i]
        assert row.m == plain_runs(runs, [s[2:4] for s in spans], "[EMAIL]"), row.i


def plain_detection(text):
    """Every detector by Python's own regex engine, its checks and the resolution in plain loops."""
    from spanloom.functions.validators import country_codes

    def luhn(v):
        d = [int(c) for c in v[::-1]]
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0

    def iban(v):
        v = v.replace(" ", "").upper()
        return bool(re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", v)) and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1

    def nir(v):
        v = v.replace(" ", "").upper()
        if not re.fullmatch("[12][0-9]{2}(0[1-9]|1[0-2]|[02-9][0-9])([0-9]{2}|2[AB])[0-9]{8}", v):
            return False
        return 97 - int(v[:13].replace("2A", "19").replace("2B", "18")) % 97 == int(v[13:])

    checks = {"IBAN": iban, "NIR": nir, "BIC": lambda v: v[4:6] in country_codes(), "SIRET": luhn, "SIREN": luhn, "POSTAL_CODE": lambda v: 1 <= int(v[:2]) <= 98}
    found = []
    for type_, pattern in D.PATTERNS.items():
        flags, body = re.fullmatch(r"\(\?([a-zU]+)\)(.*)", pattern, re.S).groups()
        for m in re.finditer(body, text, re.I if "i" in flags else 0):
            ok = checks.get(type_, lambda v: True)(m.group())
            if ok or type_ in D.UNCONFIRMED:
                found.append((type_, m.group(), m.start(), m.end(), "deterministic", 1.0, ok))
    known = []
    for type_, pattern in D.CONTEXT.items():
        for m in re.finditer(pattern[len("(?iuU)"):], text, re.I):
            known.append((type_, m.group(2), m.start(2), m.end(2), "secret", 1.0, True))
    found += known
    outer = ".,;:()[]"
    for m in re.finditer(r"\S+", text):
        a, b = m.span()
        while a < b and text[a] in outer:
            a += 1
        while a < b and text[b - 1] in outer:
            b -= 1
        v = text[a:b]
        if len(v) >= 8 and any(map(str.islower, v)) and any(map(str.isupper, v)) and any(map(str.isdecimal, v)) and not any((a, b) == k[2:4] for k in known):
            found.append(("PASSWORD", v, a, b, "secret", 0.7, True))
    ranked = sorted(enumerate(found), key=lambda x: (x[1][4] != "deterministic", -x[1][5], x[1][2] - x[1][3], x[0]))
    kept = []
    for _, s in ranked:
        if not any(s[2] < k[3] and k[2] < s[3] for k in kept):
            kept.append(s)
    return sorted((t, v, a, b, source, ok) for t, v, a, b, source, _, ok in kept)


def test_every_detector_on_documents(spark, tmp_path):
    """Texts made of pieces that detectors look for, glued, cut and mixed with prose, against plain Python."""
    r = random.Random(17)
    pieces = [
        "a.b+c@ex-1.fr", "é.x@y.org.", "06 12 34 56 78", "+33612345678", "0033 1.23.45.67.89", "FR7630006000011234567890189", "FR76 3000 6000 0112 3456 7890 188", "BNPAFRPP", "BNPAFRPPXXX", "FACTURES",
        "552081317", "552081318", "73282932000074", "1 55 08 13 084 024 17", "255082A08402449", "12 bis, rue des Lilas", "3 AVENUE de l’Été, puis", "75008", "00123", "https://x.org/a?b=1,", "mot de passe : Ab1!x,", "Mots de passe provisoire (zz)",
        "mdp=Secret99", "login: bob", "Identifiant - éva1", "connectée la veille avec bob", "utilisateur", "Azerty123", "(Abc12345).", "ABCDEFGH1", "abcdefg1", "prose", "de", "Ümlaut", "😀", "\n", "\t", "\u00a0", "12", "x" * 30,
    ]
    texts = ["".join(r.choice(pieces) + r.choice([" ", " ", " ", "", ", ", "\n"]) for _ in range(r.choice([1, 3, 20, 200]))) for _ in range(250)]
    at = str(tmp_path)
    spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    got = {i: [] for i in range(len(texts))}
    for x in Q.QUERIES["m4_document_spans"](spark, at).collect():
        got[x.doc_id].append((x.type, x.value, x.start, x.stop, x.source, x.confirmed))
    for i, text in enumerate(texts):
        assert sorted(got[i]) == plain_detection(text), text
    counts = {(x.type, x.original): (x.occurrences, x.confirme) for x in Q.QUERIES["a1_document_audit"](spark, at).collect()}
    want = {}
    for t, v, _, _, _, ok in (s for found in got.values() for s in found):
        n, all_ok = want.get((t, v), (0, True))
        want[t, v] = n + 1, all_ok and ok
    assert counts == {k: (n, "oui" if ok else "non") for k, (n, ok) in want.items()} and len({t for t, _ in want}) == 12
