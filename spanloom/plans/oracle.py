"""Pieces of DuckDB SQL that the queries' oracles are put together from."""

from __future__ import annotations

EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]*[\p{L}\p{N}_]"
PHONE = r"(?:(?:\+33|0033)\s?|0)[1-9](?:[\s.\-]?\d{2}){4}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spans(source: str, key: str, pattern: str, type_: str, text: str = "text", order: int = 0, group: bool = False) -> str:
    """key, type, value, start, stop, tord of all matches of an RE2 pattern (with group: of its second group after its first)."""
    to = r"\1' || chr(1) || '\2' || chr(1)" if group else None
    fenced = f"regexp_replace({text}, {quoted(pattern)}, '{to}, 'g')" if group else f"regexp_replace({text}, {quoted(pattern)}, chr(1) || '\\0' || chr(1), 'g')"
    return f"""(SELECT {key}, '{type_}' AS type, p AS value, CAST(before AS INTEGER) AS start, CAST(before + length(p) AS INTEGER) AS stop, {order} AS tord FROM (
      SELECT {key}, p, i, sum(length(p)) OVER (PARTITION BY {key} ORDER BY i) - length(p) AS before FROM (
        SELECT {key}, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM (SELECT {key}, string_split({fenced}, chr(1)) AS parts FROM {source}) WHERE len(parts) > 1)) WHERE i % 2 = 0)"""


def luhn(digits: str) -> str:
    """Whether a string of digits passes."""
    d = f"CAST(substr({digits}, length({digits}) - i, 1) AS INTEGER)"
    return f"(list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)) % 10 = 0)"


def iban(value: str) -> str:
    s = f"upper(replace({value}, ' ', ''))"
    turned = f"(substr({s}, 5) || substr({s}, 1, 4))"
    digits = f"array_to_string(list_transform(string_split({turned}, ''), lambda c: CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '')"
    rest = f"list_reduce(list_prepend(0, list_transform(string_split({digits}, ''), lambda c: CAST(c AS INTEGER))), lambda a, c: (a * 10 + c) % 97)"
    return f"(regexp_full_match({s}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{10,30}}') AND {rest} = 1)"


def nir(value: str) -> str:
    s = f"upper(replace({value}, ' ', ''))"
    body = f"replace(replace(substr({s}, 1, 13), '2A', '19'), '2B', '18')"
    return f"(regexp_full_match({s}, '[12][0-9]{{2}}(0[1-9]|1[0-2]|[02-9][0-9])([0-9]{{2}}|2[AB])[0-9]{{8}}') AND 97 - CAST({body} AS BIGINT) % 97 = CAST(substr({s}, 14, 2) AS BIGINT))"


def merged(candidates: str, key: str) -> str:
    """Common table expressions ending in kept (key, type, value, start, stop, ...) from cand (key, type, value, start, stop, strong, confidence, confirmed, tord)."""
    return f"""cand AS ({candidates}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY strong DESC, confidence DESC, stop - start DESC, tord, start) AS n FROM cand),
walk AS (SELECT {key}, 0 AS n, CAST([] AS STRUCT(a INTEGER, b INTEGER, n BIGINT)[]) AS got FROM (SELECT DISTINCT {key} FROM ranked)
  UNION ALL SELECT w.{key}, w.n + 1, CASE WHEN len(list_filter(got, lambda g: g.a < r.stop AND r.start < g.b)) > 0 THEN got ELSE list_append(got, {{'a': r.start, 'b': r.stop, 'n': r.n}}) END
  FROM walk w JOIN ranked r ON r.{key} = w.{key} AND r.n = w.n + 1),
final AS (SELECT {key}, unnest(got).n AS n FROM (SELECT {key}, got, row_number() OVER (PARTITION BY {key} ORDER BY n DESC) AS last FROM walk) WHERE last = 1),
kept AS (SELECT r.* FROM ranked r JOIN final f ON r.{key} = f.{key} AND r.n = f.n)"""


def masked(source: str, key: str, text: str = "text") -> str:
    """SELECT key, masked from kept (with tag) and a source of texts."""
    return f"""SELECT s.{key}, coalesce(g.head || substr(s.{text}, g.stop + 1), s.{text}) AS masked FROM {source} s LEFT JOIN (
  SELECT {key}, string_agg(gap || tag, '' ORDER BY start) AS head, max(stop) AS stop FROM (
    SELECT k.{key}, k.start, k.stop, k.tag, substr(x.{text}, coalesce(lag(k.stop) OVER (PARTITION BY k.{key} ORDER BY k.start), 0) + 1, k.start - coalesce(lag(k.stop) OVER (PARTITION BY k.{key} ORDER BY k.start), 0)) AS gap
    FROM kept k JOIN {source} x ON x.{key} = k.{key}) GROUP BY {key}) g ON g.{key} = s.{key}"""
