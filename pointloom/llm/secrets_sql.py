"""DuckDB SQL for the rows of secret_report: every window of a candidate is counted afresh."""

from __future__ import annotations

from math import log2

from .secrets import ALLOWED, CANDIDATE, KINDS

_WORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    """word in either case, ASCII letters only: folding would also take other letters that resemble them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Every match of the base rules; what is too short is dropped afterwards.
_ASSIGN = f"({'|'.join(map(_either_case, _WORDS))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
_ACCESS = "AKIA[A-Z0-9]+"
_HEX = "[0-9a-f]+"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(pattern: str, group: int = 0) -> str:
    """All matches with their places: r, lo, hit, value; lo in code points."""
    p = _quoted(pattern)
    return f"""
    SELECT r, hit, value,
           CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY i) - length(hit) AS BIGINT) AS lo
    FROM (SELECT r, unnest(range(len(hits))) AS i, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit, unnest(vals) AS value
          FROM (SELECT r, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {group}) AS vals
                FROM texts WHERE regexp_matches(text, {p})))"""


def secret_report_sql(documents: str, window: int = 20, hex_bits: float = 3.0, base64_bits: float = 3.9) -> str:
    allowed = " OR ".join(f"regexp_matches(hit, {_quoted(p)})" for p in ALLOWED)
    most = {kind: window * (log2(window) - bits) for kind, bits in (("hex", hex_bits), ("base64", base64_bits))}
    count = f"({window} - length(replace(win, c, '')))"
    names = ", ".join(_quoted(k) for k in KINDS)
    return f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {documents}),
base AS MATERIALIZED (
    SELECT r, lo, 0 AS kind, lo + length(hit) AS hi FROM ({_matches(_ASSIGN, 2)}) WHERE length(value) >= 6
    UNION ALL SELECT r, lo, 1, lo + length(hit) FROM ({_matches(_ACCESS)}) WHERE length(hit) >= 20
    UNION ALL SELECT r, lo, 2, lo + length(hit) FROM ({_matches(_HEX)}) WHERE length(hit) >= 24),
candidates AS (
    SELECT r, lo, hit, CASE WHEN regexp_matches(hit, '^[0-9a-fA-F]+$') THEN 3 ELSE 4 END AS kind FROM ({_matches(CANDIDATE)})
    WHERE regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT ({allowed})),
windows AS (
    SELECT r, lo, kind, i, substring(hit, i + 1, {window}) AS win
    FROM (SELECT r, lo, kind, hit, unnest(range(length(hit) - {window} + 1)) AS i FROM candidates)),
dense AS (
    SELECT r, lo, kind, i, lag(i) OVER (PARTITION BY r, lo ORDER BY i) AS prior FROM windows
    WHERE list_sum(list_transform(list_distinct(string_split(win, '')), lambda c: {count} * log2({count}))) <= CASE kind WHEN 3 THEN {most["hex"]!r}::DOUBLE ELSE {most["base64"]!r}::DOUBLE END),
runs AS (
    SELECT r, origin + min(i) AS lo, kind, origin + max(i) + {window} AS hi
    FROM (SELECT r, kind, i, lo AS origin, count(*) FILTER (prior IS NULL OR i > prior + {window}) OVER (PARTITION BY r, lo ORDER BY i) AS run FROM dense)
    GROUP BY r, origin, kind, run),
spans AS (
    SELECT r, lo, kind, hi FROM base
    UNION ALL SELECT r, lo, kind, hi FROM runs WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = runs.r AND base.lo <= runs.lo AND base.hi >= runs.hi)),
named AS (SELECT *, ([{names}])[kind + 1] || ':' || lo || ':' || hi AS name FROM spans),
told AS (
    SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind > 2) AS n_entropy,
           string_agg(name, ',' ORDER BY lo, kind, hi) FILTER (kind < 3) AS base, string_agg(name, ',' ORDER BY lo, kind, hi) AS spans
    FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (r)"""
