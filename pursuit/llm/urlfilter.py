"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

_TOKEN = re.compile(r"[a-z0-9%]+")
#: Rules of a table are read up to so many: the index is broadcast.
MOST_RULES = 200_000
#: Host rules that hold in the query (fixed values): verdict and rule.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Pattern rules of the method: * any text, ^ a separator or the end, || the start of a host label, | an end of the url, @@ allows.
PATTERNS = (
    "||ads^", "||ads-*^", "||adserver*^", "||adult-*^", "||adult^", "||casino-*^", "||casino^", "||cheap-pills*^", "||free-money*^",
    "||free-download*^", "||malware*^", "||phishing*^", "||porn*^", "||spam-*^", "||spam^", "||tracker*^", "||xxx^", "/ads/banner*",
    "/wp-login.php|", "^affiliate_id=*", "@@||casino-history^", "@@/robots.txt|",
)


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str
    regex: str
    tokens: tuple[str, ...]  # literal tokens that any url it matches has, whole
    host: bool = False


def host_rule(verdict: str, text: str) -> Rule:
    """A rule host/path: its host and all subdomains, paths that start with the rule's."""
    host, _, path = text.partition("/")
    regex = r"^u://(?:[^/?#]*\.)?" + re.escape(host.lower()) + re.escape("/" + path)
    return Rule(verdict, text, regex, tuple(_TOKEN.findall(host.lower())), True)


def pattern_rule(text: str) -> Rule:
    """A pattern rule. Its tokens are literal runs with a separator of the pattern at both ends."""
    verdict, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    inner = body.removeprefix("||") if body.startswith("||") else body.removeprefix("|")
    start = r"^[^/?#]*?://(?:[^/?#]*[.@])?" if body.startswith("||") else "^" if body.startswith("|") else ""
    end = "$" if inner.endswith("|") else ""
    inner = inner.removesuffix("|").lower()
    regex = start + "".join(".*" if c == "*" else r"(?:[^a-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in inner) + end
    tokens = []
    for m in _TOKEN.finditer(inner):
        left = m.start() > 0 and inner[m.start() - 1] not in "*" or m.start() == 0 and body.startswith("|")
        right = m.end() < len(inner) and inner[m.end()] not in "*" or m.end() == len(inner) and bool(end)
        if left and right:
            tokens.append(m.group())
    return Rule(verdict, text, regex, tuple(tokens))


@dataclass(frozen=True)
class RuleIndex:
    """Rules by their rarest token; rules without one are candidates for every url."""

    rules: tuple[Rule, ...]
    by_token: dict[str, tuple[int, ...]]
    always: tuple[int, ...]

    @staticmethod
    def of(rules: list[Rule], counts: dict[str, int]) -> RuleIndex:
        by: dict[str, list[int]] = {}
        always = []
        for k, r in enumerate(rules):
            if r.tokens:
                by.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(k)
            else:
                always.append(k)
        return RuleIndex(tuple(rules), {t: tuple(v) for t, v in by.items()}, tuple(always))

    def judge(self, url: str | None, compiled: list[re.Pattern]) -> tuple[str | None, str]:
        """(host rule or null, verdict): the longest host rule that fits; else the patterns', where allow wins; else allow."""
        if url is None:
            return None, "allow"
        host, path = split_url(url)
        low = lower_ascii(url)
        tokens = set(_TOKEN.findall(low))
        near = [*self.always, *(k for t in tokens for k in self.by_token.get(t, ()))]
        own = f"u://{host}{path}" if "://" in url else ""
        best: Rule | None = None
        verdict = "allow"
        allowed = False
        for k in near:
            r = self.rules[k]
            if r.host:
                if own and compiled[k].match(own) and (best is None or len(r.text) > len(best.text)):
                    best = r
            elif not allowed and compiled[k].search(low):
                allowed = r.verdict == "allow"
                verdict = r.verdict
        return (best.text, best.verdict) if best else (None, verdict)


def lower_ascii(s: str) -> str:
    return s.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return lower_ascii(host), path


def token_counts(urls: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, int]:
    """How many urls have each of the rules' tokens: all urls counted, as many sums as the rules have tokens collected."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    found = F.array_distinct(F.regexp_extract_all(F.lower(url_col), F.lit("[a-z0-9%]+"), F.lit(0)))
    rows = urls.select(F.explode(found).alias("t")).where(F.col("t").isin(wanted)).groupBy("t").count()
    return {t: n for t, n in rows.collect()}


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """``pages`` with a struct column ``judged``: host, path, rule, verdict.

    Null urls and urls without ``://`` have empty host and path and fit no host rule; patterns still
    see the url (null: allow). Ties between equal rules go to the first. Rows stay as they are, but that a
    column ``judged`` of ``pages`` is replaced; no shuffle.
    """
    small_batches(pages.sparkSession, 5000)
    index = RuleIndex.of(rules, token_counts(pages, rules, url_col))
    held = pages.sparkSession.sparkContext.broadcast(index)

    def run(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled = [re.compile(r.regex, re.S) for r in held.value.rules]
        for some in urls:
            rows = [(*split_url(u), *held.value.judge(u, compiled)) for u in (x if isinstance(x, str) else None for x in some)]
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    return pages.withColumn("judged", F.pandas_udf(run, "host string, path string, rule string, verdict string")(F.col(url_col)))


def rules_of(rules: DataFrame, verdict_col: str = "verdict", rule_col: str = "rule", most: int = MOST_RULES) -> list[Rule]:
    """The rules of a table, in order of their texts: host rules (host/path) where verdict is allow or block, pattern rules where it is null.

    Null and blank rules are skipped, repeated ones count once; other verdicts raise ValueError, as do
    more than ``most`` rules, since every executor holds the index. Extra columns are not read; an
    empty table gives no rules, so that every url is allowed.
    """
    rows = rules.select(F.col(verdict_col).alias("verdict"), F.trim(rule_col).alias("rule")).where("rule <> ''").distinct()
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rules")
    if bad := {r.verdict for r in found} - {None, "allow", "block"}:
        raise ValueError(f"verdicts are allow, block or null, not {sorted(bad)}")
    return [pattern_rule(r.rule) if r.verdict is None else host_rule(r.verdict, r.rule) for r in sorted(found, key=lambda r: (r.rule, r.verdict or ""))]


def default_rules() -> list[Rule]:
    return [*(host_rule(v, r) for v, r in HOST_RULES), *(pattern_rule(p) for p in PATTERNS)]
