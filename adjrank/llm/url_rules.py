"""URL filters: pattern rules looked up by their rarest literal token.

A rule is a host and a path, each possibly with ``*`` for any characters. It
fits its host and all subdomains if the URL's path starts with the rule's.
The tokens that every URL which fits must have are the rule's host labels and
those path segments that a separator closes. The rule is indexed by the one
that fewest URLs hold, counted over the whole table. A URL's tokens fetch its
candidates, and only those run their regular expressions.

The longest rule that fits decides, then the first given. What no rule of the
caller's decides, the default patterns do: a URL that one of them finds is
blocked, any other allowed.

Null URLs and those without ``://`` have an empty host and path; no rule fits
them, and they are allowed. Each row is judged where it is read: repeated rows
are judged alike and an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rules travel to every task; a longer list is refused.
MOST_RULES = 1_000_000
#: The separators that end tokens of hosts, paths and queries.
SEPARATED = r"[^A-Za-z0-9%_-]+"
TOKEN = re.compile(r"[A-Za-z0-9%_-]+")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        """Finds the rule in host, slash and path."""
        host = "[^/]*".join(re.escape(x) for x in self.host.split("*"))
        path = ".*".join(re.escape(x) for x in self.path.split("*"))
        return rf"\A(?:[^/]*\.)?{host}/{path}"

    def tokens(self) -> set[str]:
        """What every URL that fits has as whole tokens, ``host:`` or ``path:`` before them."""
        labels = {f"host:{x}" for x in self.host.split(".") if x and "*" not in x}
        # a token counts if it is closed on both sides, and not by a star
        closed = re.finditer(r"(?<![A-Za-z0-9%_*-])[A-Za-z0-9%_-]+(?=[^A-Za-z0-9%_*-])", self.path)
        return labels | {f"path:{x.group()}" for x in closed if x.start() > 0}


#: Patterns for URLs that no rule of the caller's fits: advertising, tracking, downloads.
DEFAULT_PATTERNS = (
    Rule("doubleclick.net", "", "block"),
    Rule("googlesyndication.com", "", "block"),
    Rule("*", "*/ads/", "block"),
    Rule("*", "*/adserver/", "block"),
    Rule("*", "*/banners/", "block"),
    Rule("*", "*/casino/", "block"),
    Rule("*", "*/porn/", "block"),
    Rule("*", "*/tracking/", "block"),
    Rule("*", "*/wp-login.php", "block"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, its A-Z in lower case, and path; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tokens_of(host: str, path: str) -> set[str]:
    return {f"host:{x}" for x in host.split(".")} | {f"path:{x}" for x in TOKEN.findall(path)}


def token_frequencies(parts: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many rows each token of the rules occurs; no more entries than the rules have tokens."""
    wanted = sorted(set().union(*(r.tokens() for r in rules)))
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("host:"), x))
    segments = F.transform(F.split("path", SEPARATED), lambda x: F.concat(F.lit("path:"), x))
    each = parts.select(F.explode(F.array_distinct(F.concat(labels, segments))).alias("token"))
    names = parts.sparkSession.createDataFrame([(x,) for x in wanted], "token string")
    return {x["token"]: x["count"] for x in each.join(names, "token", "left_semi").groupBy("token").count().collect()}


class Index:
    """Rules by their rarest token; those without any literal token are candidates for every URL."""

    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.by_token: dict[str, list[tuple[int, Rule, re.Pattern]]] = {}
        self.always: list[tuple[int, Rule, re.Pattern]] = []
        for i, rule in enumerate(rules):
            entry = (i, rule, re.compile(rule.regex(), re.DOTALL))
            tokens = rule.tokens()
            if tokens:
                rarest = min(tokens, key=lambda t: (frequency.get(t, 0), t))
                self.by_token.setdefault(rarest, []).append(entry)
            else:
                self.always.append(entry)

    def best(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits, the first of equal ones."""
        found, url = None, f"{host}/{path}"
        for token in tokens_of(host, path):
            for entry in self.by_token.get(token, ()):
                found = _longer(found, entry, url)
        for entry in self.always:
            found = _longer(found, entry, url)
        return found and found[1]


def _longer(found, entry, url):
    i, rule, pattern = entry
    if found and (len(found[1].name), -found[0]) >= (len(rule.name), -i):
        return found
    return entry if pattern.search(url) else found


def judge(
    pages: DataFrame,
    rules: list[Rule],
    key: str = "page_id",
    url: str = "url",
    patterns: tuple[Rule, ...] = DEFAULT_PATTERNS,
) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` for each row."""
    if len(rules) + len(patterns) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    host, path = split_url(F.col(url))
    parts = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    frequency = token_frequencies(parts, [*rules, *patterns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, others = Index(list(rules), frequency), Index(list(patterns), frequency)
        for batch in batches:
            names, verdicts = [], []
            for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rule = own.best(h, p) if h else None
                other = None if rule or not h else others.best(h, p)
                names.append(rule and rule.name)
                verdicts.append(rule.verdict if rule else other.verdict if other else "allow")
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "host", "path", "rule", "verdict"])

    schema = T.StructType([*parts.schema, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return parts.mapInArrow(run, schema).withColumnRenamed("key", key)
