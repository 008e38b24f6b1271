"""Spans and the dimension of their types."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<type:string,value:string,start:int,end:int,source:string,confidence:double,confirmed:boolean,seq:int>"
SPANS = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(type_: Column, value: Column, start: Column, end: Column, source: str, confidence: float = 1.0, confirmed: Column | None = None) -> Column:
    return F.struct(
        type_.alias("type"), value.alias("value"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(source).alias("source"),
        F.lit(float(confidence)).alias("confidence"), (F.lit(True) if confirmed is None else confirmed).alias("confirmed"), F.lit(0).alias("seq"),
    )


@dataclass(frozen=True)
class TypeInfo:
    code: str
    label: str
    method: str
    active: bool
    tag: str
    sensitivity: str


#: Code, label, method, active by default, tag, sensitivity.
DEFAULT_TYPES = tuple(TypeInfo(*row) for row in (
    ("PERSON", "Personne", "ner", True, "[PERSONNE]", "Haute"),
    ("ADDRESS", "Adresse", "ner", True, "[ADRESSE]", "Haute"),
    ("ORG", "Organisation", "ner", True, "[ORG]", "Moyenne"),
    ("EMAIL", "E-mail", "deterministic", True, "[EMAIL]", "Haute"),
    ("PHONE", "Téléphone", "deterministic", True, "[TEL]", "Haute"),
    ("IBAN", "IBAN", "deterministic", True, "[IBAN]", "Haute"),
    ("BIC", "BIC / SWIFT", "deterministic", False, "[BIC]", "Moyenne"),
    ("SIREN", "SIREN", "deterministic", True, "[SIREN]", "Moyenne"),
    ("SIRET", "SIRET", "deterministic", True, "[SIRET]", "Moyenne"),
    ("NIR", "N° sécu", "deterministic", True, "[NIR]", "Haute"),
    ("POSTAL_CODE", "Code postal", "deterministic", False, "[CP]", "Basse"),
    ("URL", "URL", "deterministic", False, "[URL]", "Basse"),
    ("LOGIN", "Identifiant", "contextual", True, "[LOGIN]", "Haute"),
    ("PASSWORD", "Mot de passe", "contextual", True, "[SECRET]", "Haute"),
    ("REGLE_INTERNE", "Règle interne", "rule", True, "[REGLE-INTERNE]", "Moyenne"),
))
SENSITIVITY_RANK = {"Haute": 3, "Moyenne": 2, "Basse": 1}


@dataclass(frozen=True)
class Referential:
    """Span types with per-type overrides of their active flag."""

    types: tuple[TypeInfo, ...] = DEFAULT_TYPES
    overrides: dict[str, bool] = field(default_factory=dict)

    def with_overrides(self, **active: bool) -> Referential:
        return replace(self, overrides=self.overrides | active)

    def is_active(self, code: str) -> bool:
        known = next((t.active for t in self.types if t.code == code), False)
        return self.overrides.get(code, known)

    def active_codes(self) -> list[str]:
        return [c for c in dict.fromkeys([*(t.code for t in self.types), *self.overrides]) if self.is_active(c)]

    def counter(self) -> str:
        """How many of the types that detectors find are active."""
        listed = [t for t in self.types if t.method != "rule"]
        return f"{sum(self.is_active(t.code) for t in listed)} / {len(listed)} actifs"

    def active_by_method(self, method: str) -> list[str]:
        return [t.code for t in self.types if t.method == method and self.is_active(t.code)]

    def _map(self, values: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])

    def tag_for(self, code: Column) -> Column:
        """Raises for an unknown code when it is evaluated."""
        tag = F.element_at(self._map({t.code: t.tag for t in self.types}), code)
        return F.when(code.isNotNull() & tag.isNull(), F.raise_error(F.concat(F.lit("unknown span type: "), code))).otherwise(tag)

    def label_for(self, code: Column) -> Column:
        return F.coalesce(F.element_at(self._map({t.code: t.label for t in self.types}), code), code)

    def sensitivity_for(self, code: Column) -> Column:
        return F.coalesce(F.element_at(self._map({t.code: t.sensitivity for t in self.types}), code), F.lit("Basse"))

    def rank_for(self, code: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in SENSITIVITY_RANK.items() for x in pair]), self.sensitivity_for(code))

    def active_column(self, code: Column) -> Column:
        return code.isin(self.active_codes())

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        rows = [(t.code, t.label, t.method, self.is_active(t.code), t.tag, t.sensitivity) for t in self.types]
        return spark.createDataFrame(rows, "code string, label string, method string, active boolean, tag string, sensitivity string")

    @classmethod
    def from_json(cls, text: str, overrides: dict[str, bool] | None = None) -> Referential:
        import json

        return cls(tuple(TypeInfo(**x) for x in json.loads(text)["entities"]), overrides or {})


@dataclass(frozen=True)
class Preferences:
    """What a user chose, kept as JSON; keys that are missing have their defaults."""

    output_dir: str | None = None
    entity_overrides: dict[str, bool] = field(default_factory=dict)
    ner_stoplist: list[str] | None = None

    def to_json(self) -> str:
        import json
        from dataclasses import asdict

        return json.dumps(asdict(self), ensure_ascii=False, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Preferences:
        import json

        return cls(**{k: v for k, v in json.loads(text).items() if k in cls.__dataclass_fields__})

    def referential(self) -> Referential:
        return Referential().with_overrides(**self.entity_overrides)
