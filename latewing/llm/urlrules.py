"""URL filtering by pattern rules, each indexed by its rarest literal token.

Two kinds of rules share one index.  Host rules name a host and a path prefix; the longest that fits decides.  Pattern
rules decide the rest: ``^`` stands for one character that is neither letter nor digit (or an end), ``*`` for anything,
``||`` in front for the start of the host or of one of its labels, ``@@`` before all makes an exception that allows.

A token is a run of a-z and 0-9.  A rule can only match a URL that holds all its whole literal tokens, so it is filed
under the one that fewest URLs hold, counted over the whole table.  A URL looks up its own tokens and runs the regular
expressions of the rules filed there, no others.  The index grows with the rules, not with the URLs; lists longer than
``RULES_PER_PASS`` are looked up part by part, each part sent to the tasks on its own.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewing.llm import shared

RULES_PER_PASS = 50_000

_TOKENS = re.compile("[a-z0-9]+").findall
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class HostRule:
    """``allow`` or ``block`` for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def tokens(self) -> set[str]:
        whole = _TOKENS(self.host)
        inner = _TOKENS(self.path)
        if inner and self.path[-1:].translate(_LOWER).isalnum():
            inner.pop()  # the url may go on
        return {*whole, *(t for t in inner if self.path == self.path.translate(_LOWER))}

    def matcher(self) -> Callable[[str, str, str], bool]:
        # the path is compared as it stands, the host without regard to case
        host = re.compile(r"(?:.*\.)?" + re.escape(self.host.translate(_LOWER)), re.S).fullmatch
        return lambda url, host_of, path_of: path_of.startswith(self.path) and host(host_of) is not None


@dataclass(frozen=True)
class PatternRule:
    """A pattern over the whole lower-cased URL."""

    pattern: str

    @property
    def name(self) -> str:
        return self.pattern

    @property
    def verdict(self) -> str:
        return "allow" if self.pattern.startswith("@@") else "block"

    def body(self) -> str:
        return self.pattern.removeprefix("@@").translate(_LOWER)

    def regex(self) -> str:
        parts = {"^": "([^a-z0-9]|^|$)", "*": ".*"}
        body = self.body()
        start = "^[^/?#]*://([^/?#]*[.])?" if body.startswith("||") else ""
        return start + "".join(parts.get(c) or re.escape(c) for c in body.removeprefix("||"))

    def tokens(self) -> set[str]:
        """Literal tokens with a literal non-token or a separator on both sides."""
        body = self.body()
        spans = [(m.start(), m.end()) for m in re.finditer("[a-z0-9]+", body)]
        return {body[a:b] for a, b in spans if a > 0 and body[a - 1] != "*" and b < len(body) and body[b] != "*"}

    def matcher(self) -> Callable[[str, str, str], bool]:
        search = re.compile(self.regex(), re.S).search
        return lambda url, host_of, path_of: search(url) is not None


Rule = HostRule | PatternRule

#: The host rules of the query.
HOST_RULES = (
    HostRule("allow", "com"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)

#: Patterns of gambling, pills, betting, tracking and adult sites, for what no host rule decides.
PATTERN_RULES = tuple(
    PatternRule(p)
    for p in (
        "^casino^win^", "^online^casino^", "^casino^", "^free^bets^", "^sports^betting^", "^poker^", "^slots^",
        "^cheap^pills^", "^buy^viagra^", "^viagra^", "^cialis^", "^ads^track^", "^adserver^", "^doubleclick^",
        "^click^track^", "^porn^", "^xxx^", "^sex^chat^", "^warez^", "^crack^keygen^", "^torrent^download^",
        "@@^casino^museum^", "^banner*^click^", "^aff_id=*&offer=", "^track*^pixel.gif", "||ads.*^click", "^session*^redirect=http",
        "@@||docs.*^click^", "^win*^jackpot^",
    )
)


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or no ``://``."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _lower(url: Column) -> Column:
    return F.translate(F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def token_counts(urls: DataFrame, url: str, tokens: Sequence[str]) -> dict[str, int]:
    """How many rows of ``urls`` hold each of these tokens, a row for each at most, counted over all rows."""
    wanted = F.array(*[F.lit(t) for t in sorted(tokens)])
    held = F.array_intersect(F.split(_lower(F.col(url)), "[^a-z0-9]+"), wanted)
    return dict(urls.select(F.explode(held).alias("t")).groupBy("t").count().collect())


def index_rules(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token (ties: the smaller token); those without a whole token under the empty string."""
    index = defaultdict(list)
    for rule in rules:
        index[min(rule.tokens(), key=lambda t: (counts.get(t, 0), t), default="")].append(rule)
    return dict(index)


_MADE = "rule: string, rule_verdict: string, pattern: string, pattern_verdict: string, n_tried: bigint"


def _decider(index: dict[str, list[Rule]]):
    @F.arrow_udf(f"struct<{_MADE}>")
    def decide(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ready = {t: [(r, isinstance(r, HostRule), r.matcher()) for r in rs] for t, rs in index.items()}
        always = ready.get("", [])
        for url, host, path in batches:
            rows = []
            for u, h, p in zip(url.to_pylist(), host.to_pylist(), path.to_pylist(), strict=True):
                best, pattern, tried = None, None, 0
                for found in (always, *(ready[t] for t in {*_TOKENS(u)} if t in ready)):
                    for rule, by_host, matches in found:
                        tried += 1
                        if not matches(u, h, p):
                            continue
                        if by_host:
                            if best is None or (len(rule.name), rule.name) > (len(best.name), best.name):
                                best = rule
                        elif pattern is None or (rule.verdict, rule.name) < (pattern.verdict, pattern.name):
                            pattern = rule  # an exception goes before a block
                rows.append((best and best.name, best and best.verdict, pattern and pattern.name, pattern and pattern.verdict, tried))
            names = [x.split(":")[0] for x in _MADE.split(", ")]
            kinds = [pa.string()] * 4 + [pa.int64()]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return decide


def judge_urls(urls: DataFrame, url: str = "url", hosts: Sequence[HostRule] = HOST_RULES, patterns: Sequence[PatternRule] = PATTERN_RULES) -> DataFrame:
    """``urls`` with a struct column ``url_verdict``: host, path, rule, verdict, pattern, n_tried.  Other columns pass
    through, whatever their names; one of that name is replaced.

    The longest host rule decides (``rule``); else an exception pattern, else a blocking one, else ``allow``.  A null or
    empty URL, or one without ``://``, has an empty host and path and can only meet patterns.  Every row is judged on
    its own: repeated rows alike, an empty table gives an empty table.  Counting tokens is one small aggregation; the
    verdict needs no shuffle.
    """
    rules: list[Rule] = [*hosts, *patterns]
    tokens = {t for r in rules for t in r.tokens()}
    counts: dict[str, int] = {}
    ordered = sorted(tokens)
    for at in range(0, len(ordered), 2_000):
        counts |= token_counts(urls, url, ordered[at : at + 2_000])
    names = [c for c in urls.columns if c != "url_verdict"]
    host, path, *results = shared.free_names(names, "host", "path", *[f"r{at}" for at in range(0, len(rules), RULES_PER_PASS)])
    made = urls.withColumn(host, url_host(F.col(f"`{url}`"))).withColumn(path, url_path(F.col(f"`{url}`")))
    for at, into in zip(range(0, len(rules), RULES_PER_PASS), results, strict=True):
        decide = _decider(index_rules(rules[at : at + RULES_PER_PASS], counts))
        made = made.withColumn(into, decide(_lower(F.col(f"`{url}`")), F.col(host), F.col(path)))
    none = F.lit(None).cast(f"struct<{_MADE}>")
    parts = F.array(*[F.col(r) for r in results]) if results else F.array(none)
    # the longest host rule of all parts, the first pattern of all parts
    host_rule = F.array_max(F.transform(parts, lambda r: F.when(r["rule"].isNotNull(), F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["rule_verdict"].alias("verdict")))))
    pattern = F.array_min(F.array_compact(F.transform(parts, lambda r: F.when(r["pattern"].isNotNull(), F.struct(r["pattern_verdict"].alias("verdict"), r["pattern"].alias("pattern"))))))
    verdict = F.struct(
        F.col(host).alias("host"),
        F.col(path).alias("path"),
        host_rule["rule"].alias("rule"),
        F.coalesce(host_rule["verdict"], pattern["verdict"], F.lit("allow")).alias("verdict"),
        pattern["pattern"].alias("pattern"),
        F.aggregate(parts, F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r["n_tried"], F.lit(0))).alias("n_tried"),
    )
    return made.select(*[F.col(f"`{c}`") for c in names], verdict.alias("url_verdict"))


def op7(spark, sf_dir: str) -> DataFrame:
    pages = shared.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "url_verdict.*").drop("n_tried")


def _sql() -> str:
    fits = "(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    hosts = " union all ".join(f"select page_id, '{r.name}' as rule, '{r.verdict}' as verdict from parts where {fits.format(h=r.host, p=r.path)}" for r in HOST_RULES)
    tests = " union all ".join(
        f"select page_id, '{r.name}' as pattern, '{r.verdict}' as verdict from parts where regexp_matches(low, '{r.regex()}', 's')" for r in PATTERN_RULES
    )
    return rf"""
with parts as (
  select page_id, lower(coalesce(url, '')) as low,
    lower(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1), '')) as host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages
), hosts as ({hosts}), longest as (
  select page_id, max_by(rule, (length(rule), rule)) as rule, max_by(verdict, (length(rule), rule)) as verdict from hosts group by page_id
), tests as ({tests}), first as (
  select page_id, min_by(pattern, (verdict, pattern)) as pattern, min(verdict) as verdict from tests group by page_id
)
select page_id, host, path, longest.rule as rule, coalesce(longest.verdict, first.verdict, 'allow') as verdict, first.pattern as pattern
from parts left join longest using (page_id) left join first using (page_id)
"""


SQL = _sql()
