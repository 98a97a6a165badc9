"""URL rules indexed by their rarest literal token.

A rule is ``block`` or ``allow`` with a pattern ``host/path``: it fits its host and all
subdomains if the url's path starts with the pattern's; ``*`` in a pattern stands for any
characters. A literal token is a run of letters and digits that must occur as such in
every url the rule fits. Each rule is filed under its token that is rarest in the urls at
hand; a url's tokens fetch the candidate rules, and only those run their regular
expressions. Rules without such a token are candidates for every url. Of the rules that
fit, the one with the longest pattern wins, of equally long ones the blocking one, then
the alphabetically first.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules are given to every task; more than this are refused.
MAX_RULES = 200_000
_TOKEN = re.compile(r"[^\W_]+")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def tokens(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall(host + path))


def literal_tokens(pattern: str) -> set[str]:
    """Tokens that every fitting url holds: not beside a ``*``, nor at the open end."""
    out = set()
    for m in _TOKEN.finditer(pattern):
        before, after = pattern[m.start() - 1:m.start()], pattern[m.end():m.end() + 1]
        if before != "*" and after not in ("", "*"):
            out.add(m[0])
    return out


def expression(pattern: str) -> str:
    """The regular expression of a pattern, over host and path joined by a blank. A host may
    hold blanks but no slash, and a path is empty or begins with one."""
    host, slash, path = pattern.partition("/")
    wild = lambda s, any_: any_.join(map(re.escape, s.split("*")))
    return rf"(?:[^/]*\.)?{wild(host, '[^/]*')} {wild(slash + path, '.*')}"


def _index(rules: list[tuple[str, str]], counts: dict[str, int]):
    by_token, always = defaultdict(list), []
    for verdict, pattern in rules:
        rule = (pattern, verdict, re.compile(expression(pattern), re.S))
        own = literal_tokens(pattern)
        if own:
            by_token[min(own, key=lambda t: (counts.get(t, 0), t))].append(rule)
        else:
            always.append(rule)
    return dict(by_token), always


def _judge(by_token, always, default: str):
    order = lambda r: (-len(r[0]), r[1] != "block", r[0])

    def run(batches):
        for batch in batches:
            hosts, paths, names, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rules = [r for t in tokens(host, path) for r in by_token.get(t, ())] + always
                text = f"{host} {path}"
                best = min((r for r in rules if r[2].match(text)), key=order, default=None)
                hosts.append(host)
                paths.append(path)
                names.append(best and best[0])
                verdicts.append(best[1] if best else default)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts))],
                names=["page_id", "host", "path", "rule", "verdict"])
    return run


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule`` (the pattern
    that won, or null), ``verdict`` (the rule's, else ``default``).

    A null url, or one without ``://``, has an empty host and path; hosts may hold blanks.
    Repeated rows are judged each, null ids are carried along, an empty table gives no rows,
    very long urls are judged whole, further columns are ignored. Raises for more than
    ``MAX_RULES`` rules.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be given to every task")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    wanted = sorted({t for _, p in rules for t in literal_tokens(p)})

    def seen(batches):
        known = set(wanted)
        for batch in batches:
            found = [t for u in batch.column(0).to_pylist() for t in tokens(*split_url(u)) & known]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["token"])

    counts = {r["token"]: r["count"] for r in
              rows.select("url").mapInArrow(seen, "token string").groupBy("token").count().collect()}
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_judge(*_index(rules, counts), default),
                           f"page_id {kind}, host string, path string, rule string, verdict string")
