"""URL filter: host and path rules, then a weighted vocabulary of terms.

An Aho-Corasick automaton finds all terms of the vocabulary in one pass over the
lower-cased url. A hit counts only between boundaries (no ASCII letter or digit
on either side). A url is rejected on one strict term, or where distinct soft
terms weigh LIMIT or more together. A rule that fits decides before the terms.

Per row, no shuffle; rules and terms are driver-side lists, whose size the
caller bounds (they are built into an automaton once a Python worker).

Defined results: a null url, or one without ://, has an empty host and path and
no rule; terms are still looked for in the text after a missing ://, and a null
is allowed. Repeated rows give repeated rows; an empty table gives an empty result.
A url of any length is read once, in one pass of the automaton.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text as T
from .vocabulary import LIMIT, SOFT, STRICT

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SCHEMA = "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_weight double"
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_built: dict = {}


def _automaton(strict: tuple, soft: tuple) -> ahocorasick.Automaton:
    if (strict, soft) not in _built:
        a = ahocorasick.Automaton()
        for term, weight in soft:
            a.add_word(term, (term, weight))
        for term in strict:
            a.add_word(term, (term, None))
        a.make_automaton()
        _built[strict, soft] = a
    return _built[strict, soft]


def _parts(url: str) -> tuple[str, str]:
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:stop]


def _fitting(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    best, name = None, host
    while name:
        for start, verdict in rules.get(name, ()):
            if path.startswith(start) and (best is None or len(name + start) > len(best[0])):
                best = (name + start, verdict)
        name = name.partition(".")[2]
    return best


def _hits(url: str, terms: ahocorasick.Automaton) -> tuple[int, float]:
    strict, soft = set(), {}
    for end, (term, weight) in terms.iter(url):
        a = end - len(term)
        if (a < 0 or url[a] not in _WORD) and (end + 1 == len(url) or url[end + 1] not in _WORD):
            if weight is None:
                strict.add(term)
            else:
                soft[term] = weight
    return len(strict), float(sum(soft.values()))


def judge_batches(batches: Iterator[pa.RecordBatch], rules: tuple, strict: tuple, soft: tuple, limit: float) -> Iterator[pa.RecordBatch]:
    terms, by_host = _automaton(strict, soft), {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))
    for batch in batches:
        rows = []
        for url in batch.column("url").to_pylist():
            host, path = _parts(url or "")
            rule = _fitting(host, path, by_host)
            hard, weight = _hits((url or "").translate(_LOWER), terms)
            verdict = rule[1] if rule else "block" if hard or weight >= limit else "allow"
            rows.append((host, path, rule and rule[0], verdict, hard, weight))
        columns = list(zip(*rows)) or [()] * 6
        types = [pa.string()] * 4 + [pa.int32(), pa.float64()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_weight"])


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, strict: tuple = STRICT, soft: dict[str, float] | None = None, limit: float = LIMIT) -> DataFrame:
    """Host, path, fitting rule and verdict of every url; only the id and url columns are read."""
    chosen = tuple(sorted((SOFT if soft is None else soft).items()))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return rows.mapInArrow(T.shipped(__name__, "judge_batches", tuple(rules), tuple(strict), chosen, float(limit)), SCHEMA)
