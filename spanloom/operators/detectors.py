"""Detectors: text column -> array of spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import validators as V
from spanloom.functions.spans import let, literal_spans, regex_spans, running_sums
from spanloom.model import SPANS, no_spans, span

#: What each type looks like. Java syntax, Unicode classes.
PATTERNS = {
    "EMAIL": r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "PHONE": r"(?U)(?:(?:\+33|0033)\s?|0)[1-9](?:[\s.\-]?\d{2}){4}",
    "IBAN": r"(?U)\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{2,4}){2,8}\b",
    "BIC": r"(?U)\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b",
    "SIRET": r"(?U)\b\d{14}\b",
    "SIREN": r"(?U)\b\d{9}\b",
    "NIR": r"(?U)\b[12]\s?\d{2}\s?\d{2}\s?(?:\d{2}|2[AB])\s?\d{3}\s?\d{3}\s?\d{2}\b",
    "ADDRESS": r"(?iuU)\b\d{1,4}(?:\s?(?:bis|ter|quater))?[,\s]+(?:rue|avenue|av|ave|bd|bld|boulevard|impasse|all[ée]e|allee|chemin|place|route|rte|quai|cours|passage|square|villa|voie|faubourg|fbg|sentier|r[ée]sidence|residence)\b(?:[ \t]+[\w'’&-]+){0,5}",
    "POSTAL_CODE": r"(?U)\b\d{5}\b",
    "URL": r"(?U)https?://[^\s]+",
}
#: Words that announce a credential, and what separates them from it.
_TOKEN = r"([^\s,;)\]]*[^\s,;)\].])"
_SEPARATOR = r"(?:\s*[:\-—(]\s*|\s+)"
CONTEXT = {
    "PASSWORD": rf"(?iuU)((?:mots? de passe|mdp|password|passe?)(?:\s+(?:provisoire|temporaire))?{_SEPARATOR}){_TOKEN}",
    "LOGIN": rf"(?iuU)((?:(?:login|identifiant|utilisateur|user(?:name)?|accès au compte)|connectée?s?(?:\s+\S+){{0,3}}?\s+avec){_SEPARATOR}){_TOKEN}",
}
#: Types that stay, unconfirmed, when their check key fails; matches of others go.
UNCONFIRMED = ("IBAN", "NIR")
_CHECKS: dict[str, Callable[[Column], Column]] = {
    "IBAN": V.iban_valid, "BIC": V.bic_plausible, "SIRET": V.luhn_valid, "SIREN": V.luhn_valid, "NIR": V.nir_valid, "POSTAL_CODE": V.postal_code_plausible,
}
#: What no match can do without, cheaper to find than the match.
_GATES: dict[str, Callable[[Column], Column]] = {
    "EMAIL": lambda t: t.contains("@"), "URL": lambda t: t.contains("://"), "PHONE": lambda t: t.contains("0") | t.contains("+33"), "IBAN": lambda t: t.rlike(r"[A-Z]{2}\p{Nd}"),
    "BIC": lambda t: t.rlike("[A-Z]{6}"), "SIRET": lambda t: t.rlike(r"\p{Nd}{14}"), "SIREN": lambda t: t.rlike(r"\p{Nd}{9}"), "NIR": lambda t: t.rlike(r"\p{Nd}{2}") & t.rlike("[12]"),
    "ADDRESS": lambda t: t.rlike(r"\p{Nd}"), "POSTAL_CODE": lambda t: t.rlike(r"\p{Nd}{5}"),
    "PASSWORD": lambda t: t.rlike("(?iu)pass|mots? de|mdp"), "LOGIN": lambda t: t.rlike("(?iu)login|identifiant|utilisateur|user|compte|connect"),
}


def deterministic(text: Column, type_: str) -> Column:
    """Spans of one of PATTERNS, checked."""
    found = regex_spans(text, PATTERNS[type_], type_, "deterministic", gate=_GATES[type_](text))
    check = _CHECKS.get(type_)
    if check is None:
        return found
    if type_ in UNCONFIRMED:
        return F.transform(found, lambda s: s.withField("confirmed", check(s["value"])))
    return F.filter(found, lambda s: check(s["value"]))


def contextual(text: Column, type_: str) -> Column:
    """Credentials that a keyword announces; the span is the credential alone."""
    return regex_spans(text, CONTEXT[type_], type_, "secret", gate=_GATES[type_](text), group=True)


def secret_shapes(text: Column, known: Column | None = None) -> Column:
    """Words of eight or more characters with lower case, upper case and digits, outer punctuation aside, unless known has the same place."""
    shaped = r"(?U)([\s.,;:()\[\]]*)((?:[^\s.,;:()\[\]](?:\S*[^\s.,;:()\[\]])?))"
    found = regex_spans(text, shaped, "PASSWORD", "secret", 0.7, gate=text.rlike(r"\d"), group=True)
    good = F.filter(found, lambda s: (F.length(s["value"]) >= 8) & s["value"].rlike(r"(?U)\p{Lower}") & s["value"].rlike(r"(?U)\p{Upper}") & s["value"].rlike(r"(?U)\d"))
    if known is None:
        return good
    places = F.transform(known, lambda k: F.struct(k["start"].alias("a"), k["end"].alias("b")))
    return F.filter(good, lambda s: ~F.array_contains(places, F.struct(s["start"].alias("a"), s["end"].alias("b"))))


@dataclass(frozen=True)
class NullRecognizer:
    """Finds nothing: what runs without a model."""

    def spans(self, text: Column, codes: list[str]) -> Column:
        return no_spans()


@dataclass(frozen=True)
class DictionaryRecognizer:
    """Literal surfaces by type; asks for no label."""

    surfaces: dict[str, str]

    def spans(self, text: Column, codes: list[str]) -> Column:
        found = [literal_spans(text, s, t, "ner") for s, t in self.surfaces.items()]
        return F.concat(*found) if found else no_spans()


#: Labels a zero-shot model is asked for, by type.
NER_LABELS = {"PERSON": "personne", "ADDRESS": "adresse", "ORG": "organisation"}


@dataclass(frozen=True)
class ModelRecognizer:
    """A model behind an Arrow UDF. load() runs once in each Python worker and returns texts, labels -> list of lists of
    (label, start, end, score); texts over chunk characters are cut at spaces and offsets put back."""

    load: Callable[[], Callable[[list[str], list[str]], list[list[tuple[str, int, int, float]]]]]
    threshold: float = 0.5
    chunk: int | None = 1000

    def _finder(self, codes: list[str]) -> Callable:
        load, threshold, chunk = self.load, self.threshold, self.chunk
        labels = {NER_LABELS.get(c, c.lower()): c for c in codes}

        def start() -> Callable[[list[str | None]], list[list[dict]]]:
            model = load()

            def find(texts: list[str | None]) -> list[list[dict]]:
                cuts = [(i, a, b) for i, t in enumerate(texts) for a, b in (chunks(t or "", chunk) if chunk else [(0, len(t or ""))])]
                found: list[list[dict]] = [[] for _ in texts]
                for (i, a, _), hits in zip(cuts, model([(texts[i] or "")[a:b] for i, a, b in cuts], list(labels)), strict=True):
                    for label, start, end, score in hits:
                        if score >= threshold:
                            found[i].append({"type": labels.get(label, label.upper()), "value": texts[i][a + start : a + end], "start": a + start, "end": a + end, "confidence": float(score)})
                return [sorted(x, key=lambda s: (s["start"], s["end"] - s["start"])) for x in found]

            return find

        return start

    def spans(self, text: Column, codes: list[str]) -> Column:
        start = self._finder(codes)

        @F.pandas_udf(_FOUND)
        def recognise(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            find = start()
            for texts in batches:
                yield pd.Series(find(list(texts)))

        return F.transform(recognise(text), _as_span).cast(SPANS)

    def array_spans(self, texts: Column, codes: list[str]) -> Column:
        """spans() of each entry of an array of texts."""
        start = self._finder(codes)

        @F.pandas_udf(f"array<{_FOUND}>")
        def recognise(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            find = start()
            for lists in batches:
                flat = find([t for texts in lists for t in (texts if texts is not None else ())])
                at, out = 0, []
                for texts in lists:
                    n = 0 if texts is None else len(texts)
                    out.append(flat[at : at + n])
                    at += n
                yield pd.Series(out)

        return F.transform(recognise(texts), lambda found: F.transform(found, _as_span).cast(SPANS))


_FOUND = "array<struct<type:string,value:string,start:int,end:int,confidence:double>>"


def _as_span(s: Column) -> Column:
    return F.struct(s["type"], s["value"], s["start"], s["end"], F.lit("ner").alias("source"), s["confidence"], F.lit(True).alias("confirmed"), F.lit(0).alias("seq"))


def chunks(text: str, most: int) -> list[tuple[int, int]]:
    """Cuts after the last space of each stretch of `most` characters, or hard where it has none past its first character."""
    out, at = [], 0
    while at < len(text):
        stop = min(at + most, len(text))
        space = text.rfind(" ", at + 1, stop) if stop < len(text) else -1
        out.append((at, space + 1 if space > 0 else stop))
        at = out[-1][1]
    return out


def chunk_column(text: Column, most: int = 1000) -> Column:
    """chunks() as a native expression: array of (start, end)."""
    cuts = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{most}}}\z|.{{1,{most - 1}}} |.{{{most}}}"), F.lit(0))  # the rest; up to the last space; or hard
    sizes = F.transform(cuts, lambda c: F.length(c))
    return let(sizes, lambda n: let(running_sums(n), lambda ends: F.transform(ends, lambda end, i: F.struct((end - F.get(n, i)).alias("start"), end.alias("end")))))
