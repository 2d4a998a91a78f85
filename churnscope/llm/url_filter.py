"""URL filtering with a token index over pattern rules.

Two kinds of rules share one index: host rules (a host with all its
subdomains and a path prefix) and patterns (wildcards over host and path).
Every rule is filed under the literal token that is rarest over all the URLs
judged, counted by Spark. A URL's tokens fetch the rules filed under them; only
these run their regular expression. Rules without a whole literal token are
tried on every URL.

The rule list is a bounded parameter that travels with the task; its token
counts are at most one row per token of the rules. URLs stay where they lie.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+")
AZ = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; the longest rule wins."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return rf"^(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        # A run at the end of the path may go on in the URL, so it is no whole token.
        text = (self.host + self.path).translate(AZ)
        return [m[0] for m in TOKEN.finditer(text) if m.end() < len(text)]


@dataclass(frozen=True)
class PatternRule:
    """A wildcard over lower-cased host + path.

    ``*`` is any run, ``^`` one separator (not a letter or digit) or an end of
    the URL; everything else is literal. Unanchored.
    """

    verdict: str
    pattern: str

    @property
    def name(self) -> str:
        return self.pattern

    @property
    def regex(self) -> str:
        special = {"*": ".*", "^": r"(?:^|[^a-z0-9]|$)"}
        return "".join(special.get(c, re.escape(c)) for c in self.pattern)

    @property
    def tokens(self) -> list[str]:
        ends = lambda c: c not in ("", "*")  # noqa: E731  a wildcard or the pattern's end may go on the run
        p = self.pattern
        return [m[0] for m in TOKEN.finditer(p) if ends(p[m.start() - 1 : m.start()]) and ends(p[m.end() : m.end() + 1])]


#: Host names and paths that a text corpus can do without: advertising, gambling, adult, drugs, spam.
PATTERNS = tuple(
    PatternRule("block", p)
    for p in (
        "^ads^", "^adserver^", "^doubleclick^", "^tracker^", "^popup^", "^casino^", "^poker^", "^bets^", "^betting^",
        "^gambling^", "^adult^", "^porn^", "^xxx^", "^sex^", "^escort^", "^pills^", "^viagra^", "^pharmacy^", "^spam^",
        "^warez^", "^torrent^", "^replica-watches^", "/wp-login.php", "/affiliate/*/click^",
    )
)


@dataclass
class RuleIndex:
    by_token: dict[str, list[int]]
    always: list[int]
    rules: list[HostRule | PatternRule]
    regexes: list[re.Pattern]

    def candidates(self, lowered: str) -> list[int]:
        found = list(self.always)
        for t in set(TOKEN.findall(lowered)):
            found += self.by_token.get(t, ())
        return found

    def judge(self, host: str, path: str, default: str) -> tuple[str | None, str, str | None]:
        """(host rule, verdict, deciding pattern): the longest host rule, else a blocking pattern, else ``default``."""
        url = host + path
        lowered = url.translate(AZ)
        best, pattern = None, None
        for i in self.candidates(lowered):
            rule = self.rules[i]
            if isinstance(rule, HostRule):
                if (best is None or len(rule.name) > len(best.name)) and self.regexes[i].search(url):
                    best = rule
            elif (pattern is None or rule.name < pattern.name) and self.regexes[i].search(lowered):
                pattern = rule
        if best is not None:
            return best.name, best.verdict, None
        if pattern is not None:
            return None, pattern.verdict, pattern.name
        return None, default, None


def build_index(rules: Iterable[HostRule | PatternRule], counts: dict[str, int]) -> RuleIndex:
    """File each rule under its rarest token (ties: the longer, then the smaller one)."""
    rules = list(rules)
    by_token, always = defaultdict(list), []
    for i, r in enumerate(rules):
        if r.tokens:
            by_token[min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))].append(i)
        else:
            always.append(i)
    return RuleIndex(dict(by_token), always, rules, [re.compile(r.regex) for r in rules])


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(urls: DataFrame, tokens: Iterable[str]) -> dict[str, int]:
    """URLs that hold each of ``tokens``, over all rows of ``urls`` (host, path): a row per token at most."""
    wanted = sorted(set(tokens))
    if not wanted:
        return {}
    found = F.array_distinct(F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+"))
    hit = F.array_intersect(found, F.array(*[F.lit(t) for t in wanted]))
    rows = urls.select(F.explode(hit).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return {r["t"]: r["n"] for r in rows.collect()}


def _judge(index: RuleIndex, default: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            judged = [index.judge(h, p, default) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            rest = [pa.array(list(c), pa.string()) for c in (zip(*judged) if judged else ([], [], []))]
            yield pa.RecordBatch.from_arrays([*b.columns, *rest], names=["id", "host", "path", "rule", "verdict", "pattern"])

    return run


def judge_urls(pages: DataFrame, rules: Iterable[HostRule | PatternRule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: ``id_col``, host, path, rule, verdict, pattern.

    ``rule`` is the longest fitting host rule (null: none), whose verdict
    holds; otherwise a fitting pattern decides (``pattern``), otherwise
    ``default``. A null URL or one without ``://`` has an empty host and path
    and gets ``default``. Repeated rows give repeated rows, an empty table
    none; other columns are not read.
    """
    rules = list(rules)
    urls = pages.select(F.col(id_col).cast("long").alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    index = build_index(rules, token_counts(urls, (t for r in rules for t in r.tokens)))
    out = urls.mapInArrow(_judge(index, default), "id long, host string, path string, rule string, verdict string, pattern string")
    return out.withColumnRenamed("id", id_col)
