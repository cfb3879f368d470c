"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names literal tokens that any url it fits must hold as whole tokens.  The rule is filed
under the one of them that is rarest in the urls at hand; a url fetches the rules filed under its
own tokens and only those run their regular expressions.

Edge cases: a null url, or one without ``://``, has an empty host and path and gets the default
verdict.  Repeated rows are judged one by one.  A rule without a whole literal token is filed under
no token and runs for every url.  Of the rules that fit, the longest wins, then the first listed.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Rules travel to the executors with the task; this bounds their number.
MAX_RULES = 1_000_000

_TOKEN = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` runs on host followed by path; ``tokens`` are whole tokens of any url that it fits."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def host_rule(verdict: str, rule: str) -> UrlRule:
    """A rule like ``example.net/en/``: its host and all subdomains, the path by prefix."""
    host, slash, path = rule.partition("/")
    host = host.translate(_LOWER)
    path = slash + path
    tokens = _TOKEN.findall(host)
    whole = [m for m in _TOKEN.finditer(path) if m.end() < len(path)]  # a last token may go on in the url
    tokens += [m.group() for m in whole]
    return UrlRule(rule, verdict, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens))


def split_url(url: str | None) -> tuple[str, str]:
    m = _PARTS.search(url) if url is not None else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class RuleIndex:
    """Rules filed under their rarest token."""

    def __init__(self, rules: Iterable[UrlRule], counts: dict[str, int], default: str):
        self.default = default
        self.by_token: dict[str, list[tuple[int, int, re.Pattern[str], UrlRule]]] = defaultdict(list)
        self.always: list[tuple[int, int, re.Pattern[str], UrlRule]] = []
        for at, rule in enumerate(rules):
            entry = (-len(rule.name), at, re.compile(rule.pattern), rule)
            if rule.tokens:
                self.by_token[min(rule.tokens, key=lambda t: (counts.get(t, 0), t))].append(entry)
            else:
                self.always.append(entry)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        host, path = split_url(url)
        both = host + path
        found = list(self.always)
        for token in set(_TOKEN.findall(both)):
            found += self.by_token.get(token, ())
        best = min((e for e in found if e[2].match(both)), default=None, key=lambda e: e[:2])
        return host, path, best[3].name if best else None, best[3].verdict if best else self.default


def token_counts(pages: DataFrame, tokens: set[str], url_col: str = "url") -> dict[str, int]:
    """In how many urls each of ``tokens`` occurs, over all rows; the result is as small as ``tokens``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                host, path = split_url(url)
                seen.update(tokens.intersection(_TOKEN.findall(host + path)))
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    found = arrow_map(pages.select(F.col(url_col)), count, "token string, n long")
    return {r["token"]: r["n"] for r in found.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def filter_urls(pages: DataFrame, rules: list[UrlRule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, url, host, path, rule and verdict of every row; no shuffle, only two columns are read."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are sent to each task")
    counts = token_counts(pages, {t for r in rules for t in r.tokens}, url_col)
    slim = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    kind = slim.schema[0].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, counts, default)
        for batch in batches:
            rows = [index.judge(u) for u in batch.column(1).to_pylist()]
            columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[id_col, "url", "host", "path", "rule", "verdict"])

    return arrow_map(slim, judge, f"`{id_col}` {kind}, url string, host string, path string, rule string, verdict string")
